"""How often the stored batch deals its tables out, and that it looks tags up once."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from setscope.plans import stored
from setscope.sources import bindings as D


@pytest.fixture
def tables(tmp_path):
    lines = [(o, p, float(1 + (o + p) % 9), 0.01 * ((o * p) % 5)) for o in range(1, 41) for p in range(1, 8) if (o * 7 + p) % 3]
    columns = dict(zip(("l_orderkey", "l_partkey", "l_quantity", "l_discount"), map(list, zip(*lines))))
    at = dt.datetime(2024, 1, 1)
    written = {
        "lineitem": columns,
        "part": {"p_partkey": list(range(1, 8)), "p_brand": [f"Brand#{1 + i % 4}" for i in range(7)], "p_type": ["ECONOMY", "LARGE", "PROMO"] * 2 + ["SMALL"]},
        "orders": {
            "o_orderkey": list(range(1, 39)),
            "o_custkey": [1 + i % 3 for i in range(38)],
            "o_orderpriority": [D.PRIORITIES[i % 5] for i in range(38)],
            "o_orderstatus": ["F"] * 38,
            "o_orderdate": [at] * 38,
        },
        "customer": {"c_custkey": [1, 2, 3], "c_name": ["a", "b", "c"], "c_mktsegment": ["BUILDING", "MACHINERY", "HOUSEHOLD"], "c_nationkey": [0, 0, 1]},
        "nation": {"n_nationkey": [0, 1], "n_name": ["N", "M"], "n_regionkey": [0, 0]},
        "region": {"r_regionkey": [0], "r_name": ["R"]},
    }
    for name, table in written.items():
        pq.write_table(pa.table(table), tmp_path / f"{name}.parquet")
    return str(tmp_path), lines


def test_lines_are_dealt_by_order_once(spark, tables):
    sf, lines = tables
    maps = D.basket_maps(spark, sf, "p_brand")
    plan = maps._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    rows = {r["_id"]: r for r in maps.collect()}
    assert len(rows) == 40
    for o, r in rows.items():
        want = {}
        for _, p, q, _ in (x for x in lines if x[0] == o):
            brand = f"Brand#{1 + (p - 1) % 4}"
            want[brand] = want.get(brand, 0) + int(q)
        percent = [round(x[3] * 100) for x in lines if x[0] == o]
        assert r["weights"] == want and r["confidence"] == pytest.approx(1 - sum(percent) / (10 * len(percent)))


def test_stored_batch_joins_tags_once(spark, tables, monkeypatch):
    sf, _ = tables
    calls = []
    metadata = D.metadata
    monkeypatch.setattr(D, "metadata", lambda *a: calls.append("metadata") or metadata(*a))
    headers = stored.stored_headers(spark, sf).collect()
    assert calls == ["metadata"]
    sure = [r["_id"] for r in D.plain_tracks(spark, sf).filter("confidence > 0.6").collect()]
    tags = {o: {D.PRIORITIES[(o - 1) % 5], ["building", "machinery", "household"][(o - 1) % 3]} for o in range(1, 39)}
    want = {t: sum(t in tags.get(o, ()) for o in sure) for t in D.TAGS} | {None: len(sure)}
    assert len(headers) == 33 and all(r["n"] == want[r["tag"]] for r in headers)
    assert stored.stored_results(spark, sf).filter("fi_type = 'hui'").count() > 0
