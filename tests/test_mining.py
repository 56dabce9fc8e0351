"""Miners against brute force, against each other, and on literal cases."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from setscope.functions.tables import materialise
from setscope.operators import itemsets as I
from setscope.operators import utility as U
from setscope.operators import utility_vertical as L

BASKETS = [
    ["a", "b", "c"], ["a", "b"], ["a", "c", "d", "e"], ["b", "c"], ["a", "b", "c", "d"], [], ["e"], ["a", "b", "c"], ["d", "e"],
    ["a", "b", "c", "d", "e"], ["a", "b", "c"], ["b", "e"],
]


def frame(spark):
    return spark.createDataFrame([(i, b) for i, b in enumerate(BASKETS)], "_id long, items array<string>")


def brute(floor):
    labels = sorted({x for b in BASKETS for x in b})
    out = {}
    for k in range(1, len(labels) + 1):
        for s in combinations(labels, k):
            n = sum(set(s) <= set(b) for b in BASKETS)
            if n >= floor:
                out[s] = n
    return out


def as_dict(df):
    rows = df.collect()
    assert len(rows) == len({tuple(r.itemset) for r in rows})
    return {tuple(r.itemset): r.freq for r in rows}


@pytest.mark.parametrize("rows", [0, 50_000_000])
def test_levelwise_equals_brute_force(spark, rows):
    got = I.frequent_itemsets_levelwise(frame(spark), min_support=0.25, enumeration_rows=rows)
    assert as_dict(got) == brute(3)
    assert {r.n for r in got.collect()} == {len(BASKETS)}


@pytest.mark.parametrize("rows", [0, 50_000_000])
def test_levelwise_max_len(spark, rows):
    got = I.frequent_itemsets_levelwise(frame(spark), min_support=0.1, max_len=2, enumeration_rows=rows)
    assert as_dict(got) == {s: n for s, n in brute(2).items() if len(s) <= 2}


def test_fpgrowth_equals_levelwise(spark):
    assert as_dict(I.frequent_itemsets(frame(spark), min_support=0.25)) == brute(3)


@pytest.mark.parametrize("rows", [0, 50_000_000])
@pytest.mark.parametrize("chunks", [1, 3])
def test_son_is_strict(spark, rows, chunks):
    got = I.frequent_itemsets_son(frame(spark), min_support=0.25, chunks=chunks, enumeration_rows=rows)
    assert as_dict(got) == brute(4)


def test_nothing_frequent(spark):
    assert I.frequent_itemsets_levelwise(frame(spark), min_support=1.0).count() == 0
    assert I.frequent_itemsets_levelwise(frame(spark), min_support=1.0, enumeration_rows=0).count() == 0
    assert I.frequent_itemsets_son(frame(spark), min_support=1.0).count() == 0


@pytest.mark.parametrize("rows", [0, 50_000_000])
def test_groups_with_null_key_and_hot_copies(spark, rows):
    data = frame(spark).select(F.lit(None).cast("string").alias("g"), "items").unionByName(
        spark.range(400).select(F.lit("hot").alias("g"), F.array(F.lit("x"), F.lit("y")).alias("items"))
    )
    got = I.frequent_itemsets_levelwise(data, min_support=0.25, group_cols=["g"], enumeration_rows=rows).collect()
    assert {tuple(r.itemset): r.freq for r in got if r.g is None} == brute(3)
    assert {tuple(r.itemset): r.freq for r in got if r.g == "hot"} == {("x",): 400, ("y",): 400, ("x", "y"): 400}


GOLDEN = [
    (0, "Coke 12oz", 6.0), (0, "Chips", 2.0), (0, "Dip", 1.0), (1, "Coke 12oz", 1.0), (2, "Coke 12oz", 2.0), (2, "Chips", 1.0),
    (3, "Chips", 1.0), (4, "Chips", 2.0), (5, "Coke 12oz", 6.0), (5, "Chips", 1.0),
]
PRICES = [("Coke 12oz", 1.29), ("Chips", 2.99), ("Dip", 3.49)]


@pytest.mark.parametrize("rows", [0, 50_000_000])
def test_high_utility_golden(spark, rows):
    got = U.high_utility_itemsets(
        spark.createDataFrame(GOLDEN, "tid long, item string, qty double"),
        spark.createDataFrame(PRICES, "item string, eutil double"),
        min_util=20,
        as_share=False,
        enumeration_rows=rows,
    ).collect()
    assert {tuple(r.itemset): round(r.value, 6) for r in got} == {("Chips",): 20.93, ("Chips", "Coke 12oz"): 30.02}


@pytest.mark.parametrize("rows", [0, 50_000_000])
def test_high_utility_three_labels(spark, rows):
    got = U.high_utility_itemsets(
        spark.createDataFrame([(1, x, 1) for x in "abc"], "tid long, item string, qty long"),
        spark.createDataFrame([(x, 1) for x in "abc"], "item string, eutil long"),
        min_util=1,
        as_share=False,
        enumeration_rows=rows,
    ).collect()
    assert {tuple(r.itemset): r.utility for r in got} == {s: k for k in (1, 2, 3) for s in combinations("abc", k)}


@pytest.mark.parametrize("rows", [0, 50_000_000])
@pytest.mark.parametrize("share", [0.02, 0.15, 0.4])
def test_high_utility_equals_brute_force(spark, rows, share):
    tx = [(i, x, 1 + (i * 7 + ord(x) * 3) % 5) for i, b in enumerate(BASKETS) for x in b]
    price = {"a": 1, "b": 2, "c": 7, "d": 3, "e": 4}
    total = sum(q * price[x] for _, x, q in tx)
    want = {}
    for k in range(1, 6):
        for s in combinations("abcde", k):
            u = sum(q * price[x] for i, x, q in tx if set(s) <= set(BASKETS[i]) and x in s)
            if u >= share * total and any(set(s) <= set(b) for b in BASKETS):
                want[s] = u
    got = U.high_utility_itemsets(
        spark.createDataFrame(tx, "tid long, item string, qty long"),
        spark.createDataFrame(sorted(price.items()), "item string, eutil long"),
        min_util=share,
        enumeration_rows=rows,
    ).collect()
    assert {tuple(r.itemset): r.utility for r in got} == want
    assert all(r.value == r.utility / total for r in got)


@pytest.mark.parametrize("rows", [0, 50_000_000])
def test_partition_count_does_not_matter(spark, rows):
    one = I.frequent_itemsets_levelwise(frame(spark).repartition(1), min_support=0.2, enumeration_rows=rows)
    many = I.frequent_itemsets_levelwise(frame(spark).repartition(9), min_support=0.2, enumeration_rows=rows)
    assert sorted(map(tuple, ((tuple(r.itemset), r.freq) for r in one.collect()))) == sorted(
        map(tuple, ((tuple(r.itemset), r.freq) for r in many.collect()))
    )


def test_wide_baskets_are_mined_level_by_level(spark):
    # 30 labels in one basket: 2**30 subsets, of which only those of the shared core are frequent.
    core = ["a", "b", "c"]
    rows = [(i, core + [f"x{i}_{j:02d}" for j in range(27)]) for i in range(6)] + [(9, [])]
    data = spark.createDataFrame(rows, "_id long, items array<string>")
    want = {s: 6 for k in (1, 2, 3) for s in combinations(core, k)}
    assert as_dict(I.frequent_itemsets_levelwise(data, min_support=0.5)) == want
    assert as_dict(I.frequent_itemsets_son(data, min_support=0.5, chunks=1)) == want
    price = spark.createDataFrame([(x, 1) for x in core] + [(f"x{i}_{j:02d}", 1) for i in range(6) for j in range(27)], "item string, eutil long")
    long = data.select(F.col("_id").alias("tid"), F.explode("items").alias("item"), F.lit(1).cast("bigint").alias("qty"))
    got = U.high_utility_itemsets(long.filter(F.col("item").isin(*core) | F.col("item").endswith("_00")), price, min_util=12, as_share=False)
    assert {tuple(r.itemset): r.utility for r in got.collect()} == {s: 6 * len(s) for k in (2, 3) for s in combinations(core, k)}
    repeated = spark.createDataFrame([(1, "a", 2), (1, "a", 3), (1, "b", 1)], "tid long, item string, qty long")
    got = U.high_utility_itemsets(repeated, price, min_util=1, as_share=False).collect()
    assert {tuple(r.itemset): r.utility for r in got} == {("a",): 5, ("b",): 1, ("a", "b"): 6}


@pytest.mark.parametrize("rows", [0, 50_000_000])
def test_a_basket_is_a_set(spark, rows):
    data = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a", "b", None]), (3, ["b"]), (4, None)], "_id long, items array<string>")
    want = {("a",): 2, ("b",): 3, ("a", "b"): 2}
    assert as_dict(I.frequent_itemsets_levelwise(data, min_support=0.3, enumeration_rows=rows)) == want
    assert as_dict(I.frequent_itemsets_son(data, min_support=0.3, chunks=2, enumeration_rows=rows)) == want
    weighted = spark.createDataFrame([(["a", "b", "a"], 2), (["b"], 1)], "items array<string>, times long")
    assert as_dict(I.frequent_itemsets_levelwise(weighted, min_support=0.3, times_col="times", enumeration_rows=rows)) == want


@pytest.mark.parametrize(("labels", "orders", "longest", "goal"), [(12, 80, 8, 0.02), (12, 80, 8, 0.2), (20_000, 1200, 9, 0.0002)])
def test_utility_lists_equal_the_array_miner(spark, labels, orders, longest, goal):
    rng = random.Random(labels)
    rows = []
    for tid in range(orders):
        size = rng.randrange(1, longest)
        kind = rng.randrange(3) if tid % 3 else None
        # A third of the baskets are copies of a few.
        basket = [rng.randrange(labels) for _ in range(size)] if tid % 3 else [(tid % 9 + j * 7) % labels for j in range(4)]
        rows += [(kind, tid, f"p{i}", rng.randrange(1, 20)) for i in basket]
    data = spark.createDataFrame(rows, "tag int, tid int, item string, qty long")
    values = spark.createDataFrame([(f"p{i}", 1 + i % 7) for i in range(labels)], "item string, eutil long")

    def as_rows(found):
        return sorted((str(r.tag), tuple(r.itemset), r.k, r.utility, round(r.value, 12)) for r in found.collect())

    want = as_rows(U.high_utility_itemsets(data, values, min_util=goal, group_cols=["tag"]))
    assert as_rows(L.high_utility_lists(data, values, min_util=goal, group_cols=["tag"])) == want and max(r[2] for r in want) > 1
    whole = as_rows(U.high_utility_itemsets(data, values, min_util=60, as_share=False).selectExpr("'' as tag", "*").filter("k < 9"))
    if labels < 100:
        assert as_rows(L.high_utility_lists(data, values, min_util=60, as_share=False).selectExpr("'' as tag", "*").filter("k < 9")) == whole
    assert L.high_utility_lists(data.limit(0), values, min_util=goal, group_cols=["tag"]).count() == 0
    assert L.high_utility_lists(data.limit(0), values, min_util=goal).count() == 0


@pytest.mark.parametrize("width", [None, 3])
def test_itemsets_of_one_transaction_need_no_lists(spark, monkeypatch, width):
    if width:
        monkeypatch.setattr(L, "ENUMERATION_WIDTH", width)
    written = {}

    def counted(df, label):
        out = materialise(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(L, "materialise", counted)
    # Orders 0 to 59 have labels of their own; 60 and 61 share one pair; 62 and 63 are equal, so merged; 64 has an unknown quantity.
    orders = {i: {5 * i + j: 10 + j for j in range(5)} for i in range(60)}
    orders |= {60: {900: 15, 901: 16, 902: 9}, 61: {900: 14, 901: 13, 903: 8}, 62: {910: 12, 911: 13}, 63: {910: 11, 911: 10}, 64: {920: 60, 921: None, 922: 2}}
    rows = [(tid, item, qty) for tid, basket in orders.items() for item, qty in basket.items()]
    data = spark.createDataFrame(rows, "tid long, item long, qty long")
    values = spark.createDataFrame([(item, 1) for item in {r[1] for r in rows}], "item long, eutil long")
    want = {}
    for basket in orders.values():
        for k in range(1, len(basket) + 1):
            for s in combinations(sorted(basket), k):
                if all(basket[x] is not None for x in s):
                    want[s] = want.get(s, 0) + sum(basket[x] for x in s)
    got = L.high_utility_lists(data, values, min_util=45, as_share=False).collect()
    assert len(got) == len({tuple(r.itemset) for r in got})
    assert {tuple(r.itemset): r.utility for r in got} == {s: u for s, u in want.items() if u >= 45}
    if not width:
        assert sum(n for label, n in written.items() if label.startswith("utility-lists")) == 2
