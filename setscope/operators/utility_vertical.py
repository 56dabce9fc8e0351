"""High-utility itemsets for label domains too wide to be told apart by arrays of all labels.

A transaction is one row with its sorted labels and their utilities, gathered by one shuffle; equal transactions of two and more labels
are merged by adding utilities, found by a fingerprint of 128 bits and their size. Then one aggregate over hashes of label pairs tells
which pairs are *linked*: they occur in more than one transaction, and the transactions that hold them are worth the goal. A shared hash
only links more.

An itemset with neighbours (in the order of labels) that are not linked is in one transaction alone, or out of reach. In a wide domain
those are nearly all; they are told from their row, which keeps only subsets that with all labels behind them reach the goal, so the work
is as large as the result. All other itemsets are grown level by level over utility lists in long form, (itemset, transaction, utility
there, utility of the labels behind), made longer by a join with the links of the same transaction; entries go on while their itemset's
utility plus what lies behind can reach the goal. The pairs of rows too wide to list their subsets are linked whenever their hash is worth
the goal. All bounds are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setscope.functions.columns import join_same
from setscope.functions.tables import materialise
from setscope.operators.utility import ENUMERATION_WIDTH, item_utilities, transaction_arrays

#: Share of the entries that labels out of reach must have before transactions are written again without them.
WEAK_SHARE = 1 / 8


def gathered(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, tid, items, us)``: one shuffle by transaction serves both the sums of its labels and the gathering."""
    near = items.repartition(*keys, "tid")
    return transaction_arrays(near.groupBy(*keys, "tid", "item").agg(F.sum("u").alias("u")), keys)


def merge_equal(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, tid, items, us)``, written, with rows of equal labels under the smallest of their ids, utilities added up.

    Rows of one label are left alone: they add to that label only.
    """
    equal = [*keys, "mark_0", "mark_1", "width"]
    marks = {"mark_0": F.xxhash64("items"), "mark_1": F.xxhash64(F.lit(1), "items"), "width": F.size("items")}
    known = materialise(rows.withColumns(marks), "utility-rows")
    counted = known.filter(F.col("width") > 1).groupBy(*equal).agg(F.min("tid").alias("least"), F.count(F.lit(1)).alias("copies"))
    copies = materialise(counted.filter(F.col("copies") > 1), "utility-copies")
    columns = [*keys, "tid", "items", "us"]
    if copies.isEmpty():
        return known.select(*columns)
    found = join_same(known, copies, equal, "left")
    long = found.filter(F.col("copies").isNotNull()).select(*equal, F.col("least").alias("tid"), F.explode(F.arrays_zip("items", "us")).alias("e"))
    sums = long.groupBy(*equal, "tid", F.col("e.items").alias("item")).agg(F.sum("e.us").alias("u"))
    merged = transaction_arrays(sums, equal).select(*columns)
    return materialise(found.filter(F.col("copies").isNull()).select(*columns).unionByName(merged), "utility-merged")


def _entries(rows: DataFrame, *columns: str) -> DataFrame:
    """``(columns, at, item, u)``: the labels of each row by place."""
    entries = rows.select(*columns, F.posexplode(F.arrays_zip("items", "us")).alias("at", "e"))
    return entries.select(*columns, "at", F.col("e.items").alias("item"), F.col("e.us").alias("u"))


def _with_tu(rows: DataFrame) -> DataFrame:
    """Add ``tu``, the utility of each row."""
    kind = rows.schema["us"].dataType.elementType
    total = F.aggregate("us", F.lit(0).cast(kind), lambda acc, u: (acc + F.coalesce(u, F.lit(0))).cast(kind))
    return rows.withColumn("tu", total)


def _with_goal(rows: DataFrame, goals: DataFrame, keys: Sequence[str]) -> DataFrame:
    return join_same(rows, goals, keys) if keys else rows.join(F.broadcast(goals.limit(1)))


def without_weak(rows: DataFrame, weighed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without the labels whose weighted utility misses the goal, if those have a fair share of the entries; otherwise as they are.

    Weak labels left in cost work only: no linked pair holds them.
    """
    strong = F.coalesce(F.col("twu") >= F.col("goal"), F.lit(False))
    weak, every = weighed.agg(F.sum(F.when(strong, 0).otherwise(F.col("n"))), F.sum("n")).first()
    if not every or weak < WEAK_SHARE * every:
        return rows
    kept = join_same(_entries(rows, *keys, "tid"), weighed.filter(strong).select(*keys, "item"), [*keys, "item"], "left_semi")
    return materialise(transaction_arrays(kept, keys), "utility-strong")


def _pairs(rows: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """``(keys, pair, at, to, columns)``: a hash of the labels at two places of a row, for all two places; at comes before to."""
    first = rows.select(*keys, *columns, "items", F.posexplode("items").alias("at", "a"))
    behind = F.posexplode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("step", "b")
    both = first.select(*keys, *columns, "at", "a", behind)
    return both.select(*keys, F.xxhash64("a", "b").alias("pair"), "at", (F.col("at") + 1 + F.col("step")).alias("to"), *columns)


def linked_pairs(rows: DataFrame, goals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, tid, at, to, wide)``, written: the linked pairs of each transaction by place."""
    rows = rows.withColumn("wide", F.size("items") > ENUMERATION_WIDTH)
    # A pair of a wide row counts twice.
    times = F.sum(F.when(F.col("wide"), 2).otherwise(1)).alias("times")
    weighed = _pairs(rows, keys, "tu", "wide").groupBy(*keys, "pair").agg(F.sum("tu").alias("twu"), times)
    linked = _with_goal(weighed, goals, keys).filter((F.col("times") > 1) & (F.col("twu") >= F.col("goal")))
    linked = materialise(linked.select(*keys, "pair"), "utility-pairs")
    links = join_same(_pairs(rows, keys, "tid", "wide"), linked, [*keys, "pair"], "left_semi")
    return materialise(links.drop("pair"), "utility-links")


def _code(at: Column, to: Column) -> Column:
    """Two places of a row that is not wide as one number."""
    return at * ENUMERATION_WIDTH + to


def private_sets(rows: DataFrame, links: DataFrame, goals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, prefix, utility, total)`` of the itemsets with unlinked neighbours: each is told from its only row."""
    kinds = {c: rows.schema[c].dataType.elementType for c in ("items", "us")}
    zero = F.lit(0).cast(kinds["us"])
    heavy = _with_goal(rows.filter(F.size("items").between(2, ENUMERATION_WIDTH)), goals, keys).filter(F.col("tu") >= F.col("goal"))
    narrow = links.filter(~F.col("wide")).groupBy(*keys, "tid").agg(F.collect_list(_code(F.col("at"), F.col("to"))).alias("codes"))
    heavy = join_same(heavy, narrow, [*keys, "tid"], "left")

    def behind(at: Column) -> Column:
        return F.aggregate(F.slice("us", at + 2, F.size("us")), zero, lambda acc, u: (acc + F.coalesce(u, zero)).cast(kinds["us"]))

    steps = F.transform("us", lambda u, at: F.struct(F.get("items", at).alias("item"), u.alias("u"), at.alias("at"), behind(at).alias("rest")))
    steps = heavy.select(*keys, "total", "goal", F.coalesce("codes", F.array().cast("array<int>")).alias("codes"), steps.alias("steps"))
    none = F.array().cast(rows.schema["items"].dataType)
    start = F.array(F.struct(none.alias("prefix"), zero.alias("u"), F.lit(-1).alias("last"), F.lit(False).alias("private")))

    def widened(found: Column, p: Column) -> Column:
        def with_label(s: Column) -> Column:
            unlinked = (s["last"] >= 0) & ~F.array_contains("codes", _code(s["last"], p["at"]))
            return F.struct(
                F.concat(s["prefix"], F.array(p["item"])).alias("prefix"),
                (s["u"] + p["u"]).cast(kinds["us"]).alias("u"),
                p["at"].alias("last"),
                (s["private"] | unlinked).alias("private"),
            )

        return F.filter(F.concat(found, F.transform(found, with_label)), lambda s: s["u"] + p["rest"] >= F.col("goal"))

    sets = F.filter(F.aggregate("steps", start, widened), lambda s: s["private"] & (s["u"] >= F.col("goal")))
    found = steps.select(*keys, "total", F.explode(sets).alias("s"))
    return found.select(*keys, F.col("s.prefix").alias("prefix"), F.col("s.u").alias("utility"), "total")


def linked_sets(rows: DataFrame, links: DataFrame, goals: DataFrame, keys: Sequence[str]) -> list[DataFrame]:
    """``(keys, prefix, utility, total)`` of the itemsets of two and more labels whose neighbours are all linked, by size."""
    involved = join_same(rows, links.select(*keys, "tid").distinct(), [*keys, "tid"], "left_semi")
    later = Window.partitionBy(*keys, "tid").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    cells = _entries(involved, *keys, "tid").withColumn("rest", F.coalesce(F.sum("u").over(later), F.lit(0)))
    cells = materialise(cells.filter(F.col("u").isNotNull()), "utility-cells")
    ends = cells.withColumnsRenamed({"at": "to"})
    steps = materialise(join_same(links.drop("wide"), ends, [*keys, "tid", "to"]), "utility-steps")
    starts = cells.select(*keys, "tid", F.array("item").alias("prefix"), F.col("at").alias("last"), F.col("u").alias("own"))
    lists = materialise(_extended(starts, steps, keys), "utility-lists-2")
    found: list[DataFrame] = []
    k = 2
    while True:
        sums = lists.groupBy(*keys, "prefix").agg(F.sum("own").alias("utility"), F.sum(F.col("own") + F.col("rest")).alias("reach"))
        sums = materialise(_with_goal(sums, goals, keys), f"utility-sums-{k}")
        found.append(sums.filter(F.col("utility") >= F.col("goal")).select(*keys, "prefix", "utility", "total"))
        going = sums.filter(F.col("reach") >= F.col("goal")).select(*keys, "prefix")
        if going.isEmpty():
            return found
        k += 1
        lists = _extended(join_same(lists, going, [*keys, "prefix"], "left_semi"), steps, keys)
        lists = materialise(lists, f"utility-lists-{k}")


def _extended(lists: DataFrame, steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries one label longer, along the links of the same transaction."""
    joined = join_same(lists.drop("rest").withColumnRenamed("last", "at"), steps, [*keys, "tid", "at"])
    return joined.select(
        *keys,
        F.concat("prefix", F.array("item")).alias("prefix"),
        F.col("to").alias("last"),
        "tid",
        (F.col("own") + F.col("u")).alias("own"),
        "rest",
    )


def high_utility_lists(
    transactions: DataFrame,
    utilities: DataFrame,
    *,
    min_util: float,
    as_share: bool = True,
    group_cols: Sequence[str] = (),
    unique: bool = False,
) -> DataFrame:
    """``(group, itemset, k, utility, value)``, the same as ``utility.high_utility_itemsets`` gives, without arrays of the domain.

    ``unique`` changes nothing here: adding up the labels of a transaction takes no shuffle of its own.
    """
    keys = list(group_cols)
    rows = _with_tu(merge_equal(gathered(item_utilities(transactions, utilities, keys, unique=True), keys), keys))
    single = _entries(rows, *keys, "tu").groupBy(*keys, "item")
    single = materialise(single.agg(F.sum("u").alias("utility"), F.sum("tu").alias("twu"), F.count(F.lit(1)).alias("n")), "utility-labels")
    totals = single.groupBy(*keys).agg(F.sum("utility").alias("total"))
    goal = F.lit(float(min_util)) * F.col("total") if as_share else F.lit(float(min_util))
    goals = materialise(totals.withColumn("goal", goal), "utility-goals")
    weighed = _with_goal(single, goals, keys)
    rows = _with_tu(without_weak(rows.drop("tu"), weighed, keys))
    links = linked_pairs(rows, goals, keys)
    found = weighed.filter(F.col("utility") >= F.col("goal")).select(*keys, F.array("item").alias("prefix"), "utility", "total")
    for part in [private_sets(rows, links, goals, keys), *linked_sets(rows, links, goals, keys)]:
        found = found.unionByName(part)
    value: Column = F.col("utility") / F.col("total") if as_share else F.col("utility")
    return found.select(*keys, F.col("prefix").alias("itemset"), F.size("prefix").alias("k"), "utility", value.alias("value"))
