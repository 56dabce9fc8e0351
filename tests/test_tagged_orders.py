"""The stored batch reads its lines once; orders with odd rows give what the separate ways of reading them give."""

import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from setscope.operators import utility as U
from setscope.plans import batch, catalogue, stored
from setscope.plans.queries_utility import mined_frequent, mined_high_utility
from setscope.sources import bindings as D


@pytest.fixture
def tables(tmp_path):
    """Parts twice with equal and with other labels, lines without a part or key, quantities missing, orders twice or without metadata."""
    lines = [(o, p, float(1 + (o + p) % 9), 0.01 * ((o * p) % 5)) for o in range(1, 41) for p in range(1, 10) if (o * 7 + p) % 3]
    lines += lines[:5] + [(3, None, 4.0, 0.0), (4, 99, 4.0, 0.5), (60, 99, 1.0, 0.0), (None, 2, 5.0, 0.01), (None, 99, 5.0, 0.01), (7, 2, None, None), (8, 2, 3.0, None)]
    parts = [(p, f"Brand#{1 + p % 4}", ["ECONOMY", "LARGE", "PROMO", "NONE"][p % 4 if p < 9 else 3]) for p in range(1, 10)]
    parts += [parts[0], parts[0], (2, "Brand#7", "SMALL"), (2, "Brand#7", "LARGE"), (None, "Brand#9", "SMALL")]
    orders = [(o, 1 + o % 3, D.PRIORITIES[o % 5]) for o in range(1, 39)]
    orders += [orders[4], (6, 2, "1-URGENT"), (60, 1, "5-LOW"), (None, 1, "2-HIGH"), (9, None, "5-LOW")]
    written = {
        "lineitem": (("l_orderkey", "l_partkey", "l_quantity", "l_discount"), lines),
        "part": (("p_partkey", "p_brand", "p_type"), parts),
        "orders": (("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"), [(*o, "F") for o in orders]),
        "customer": (("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), [(1, "a", "BUILDING", 0), (2, "b", "MACHINERY", 0), (3, "c", "HOUSEHOLD", 1)]),
        "nation": (("n_nationkey", "n_name", "n_regionkey"), [(0, "N", 0), (1, "M", 0)]),
        "region": (("r_regionkey", "r_name"), [(0, "R")]),
    }
    for name, (columns, rows) in written.items():
        pq.write_table(pa.table(dict(zip(columns, map(list, zip(*rows))))), tmp_path / f"{name}.parquet")
    return str(tmp_path)


def rows_of(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize("name", ["serve_parallel_clust", "order_sweep", "serve_circ_clust_default", "serve_circular_ordered"])
def test_lines_are_read_once(spark, tables, monkeypatch, name):
    read = []
    table = D.table
    monkeypatch.setattr(D, "table", lambda s, sf, t: read.append(t) or table(s, sf, t))
    catalogue.load_all()
    catalogue.QUERIES[name](spark, tables).collect()
    assert read.count("lineitem") == 1 and read.count("part") == 1 and read.count("orders") == 1


def test_lines_are_dealt_once_for_both_labels(spark, tables):
    plan = D.order_labels(spark, tables, 0.6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<l_orderkey") == 1 and plan.count("Exchange hashpartitioning") == 1


def dealt_rows(frame):
    """Columns and hash keys of every shuffle in a plan."""
    plan = frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    found = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: hashpartitioning\((.*?), \d+\)", plan)
    return [tuple([re.sub(r"#\d+L?", "", x) for x in part.split(", ")] for part in row) for row in found]


def test_lines_are_dealt_with_the_kind_of_their_part(spark, tables):
    assert dealt_rows(D.order_labels(spark, tables, 0.6)) == [(["id", "kind", "l_quantity", "l_discount"], ["id"])]


def test_kinds_tell_the_labels_of_parts(spark, tables):
    parts, kinds = D.part_kinds(spark, tables)
    told = {r["kind"]: (r["brand"], r["type"], r["copies"]) for r in kinds.collect()}
    assert kinds.count() == len(told) == len(set(told)) < parts.count() == 11
    assert sorted(told[r["kind"]] for r in parts.filter("p_partkey < 3").collect()) == [
        ("Brand#2", "LARGE", 3), ("Brand#3", "PROMO", 1), ("Brand#7", "LARGE", 1), ("Brand#7", "SMALL", 1)
    ]
    assert parts.join(kinds.filter("lead"), "kind").count() == 9


def test_orders_are_dealt_by_customer_only(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = dealt_rows(D.metadata(spark, tables))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [keys for columns, keys in dealt if "o_orderkey" in columns] == [["o_custkey"]]


def test_order_labels_agree_with_separate_maps(spark, tables):
    got = {r["_id"]: r for r in D.order_labels(spark, tables, -9.0).collect()}
    plain = {r["_id"]: r["confidence"] for r in D.plain_tracks(spark, tables).collect()}
    assert {k: r["plain_confidence"] for k, r in got.items()} == plain and len(plain) == 42
    for label, column in (("p_brand", "brands"), ("p_type", "types")):
        maps = {r["_id"]: r for r in D.basket_maps(spark, tables, label).collect()}
        assert set(maps) == {k for k, r in got.items() if r["confidence"] is not None} == set(got) - {60}
        for k, r in maps.items():
            assert got[k][column] == r["weights"] and got[k]["confidence"] == r["confidence"]
            assert got[k]["total"] == sum(w for w in r["weights"].values() if w is not None)


def test_stored_runs_agree_with_separate_runs(spark, tables):
    columns = ["run_id", "tag_name", "tag", "rollup", "fi_type", "itemset", "k", "freq", "value", "n"]
    apart = mined_frequent(spark, tables).select(columns).unionByName(mined_high_utility(spark, tables).select(columns))
    assert rows_of(stored.stored_results(spark, tables).select(columns)) == rows_of(apart)
    sizes = batch.tag_sizes(D.plain_tracks(spark, tables), D.metadata(spark, tables), tag_name="genres", tags=D.TAGS)
    want = {r["tag"]: r["n"] for r in sizes.collect()}
    headers = stored.stored_headers(spark, tables).collect()
    assert len(headers) == 33 and all(r["n"] == want.get(r["tag"], 0) for r in headers)


def test_map_arrays_agree_with_transaction_arrays(spark):
    units = spark.createDataFrame([("a", 2), ("b", 3)], "item string, eutil long")
    held = {1: {"b": 2, "a": 1, "x": 5}, 2: {"x": 1}, 3: {}, 4: None, 5: {"a": None, "b": 0}}
    rows = spark.createDataFrame(list(held.items()), "tid long, m map<string, long>")
    long = spark.createDataFrame([(t, i, q) for t, m in held.items() for i, q in (m or {}).items()], "tid long, item string, qty long")
    want = U.transaction_arrays(U.item_utilities(long, units, unique=True))
    got = U.map_arrays(rows, "m", units)
    assert got.columns == ["tid", "items", "us"] and rows_of(got) == rows_of(want)
