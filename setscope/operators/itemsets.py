"""Frequent itemsets: FP-Growth, a native level-wise miner, and the two-pass partition miner.

The native miner never joins baskets with themselves. A row carries a frequent prefix and the rest of its basket, so widening a
prefix is an ``explode``. Equal rows are merged with a multiplicity at every level, which is the pre-aggregation that keeps
copies and hot groups cheap: counting is a hash aggregate with map-side combine on ``(group, prefix, item)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setscope.functions.columns import join_same, string_array, subsets
from setscope.functions.tables import materialise, spread_rows

# A level whose remaining subsets number less than this is finished in one aggregate instead of one job per level.
# No row may emit more than ENUMERATION_PER_ROW subsets at that.
ENUMERATION_ROWS = 50_000_000
ENUMERATION_PER_ROW = 1 << 14


def support_floor(n: Column, min_support: float, strict: bool) -> Column:
    """Smallest count that is frequent: at least ``ceil(s * n)``, or strictly more than ``s * n``."""
    exact = F.lit(float(min_support)) * n
    return (F.floor(exact) + 1 if strict else F.ceil(exact)).cast("bigint")


def basket_copies(
    baskets: DataFrame, group_cols: Sequence[str] = (), items_col: str = "items", times_col: str | None = None
) -> DataFrame:
    """``(group, suffix, mult)``: equal baskets of a group merged. Null baskets are ignored, empty ones count.

    A basket is a set: a repeated label counts once, a null label is none. With ``times_col`` a row stands for so many baskets.
    """
    known = baskets.filter(F.col(items_col).isNotNull())
    labels = F.sort_array(F.array_distinct(F.array_compact(items_col)))
    return known.groupBy(*group_cols, labels.alias("suffix")).agg(F.sum(F.col(times_col) if times_col else F.lit(1)).alias("mult"))


def _with_totals(copies: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Add ``n``, the number of baskets of the group."""
    if group_cols:
        totals = copies.groupBy(*group_cols).agg(F.sum("mult").alias("n"))
        return join_same(copies, totals, group_cols)
    total = copies.agg(F.sum("mult")).first()[0] or 0
    return copies.withColumn("n", F.lit(total).cast("bigint"))


def _narrow(level: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Next level: suffixes cut down to the kept items of their prefix, then one row per kept item.

    ``kept`` holds ``(keys, prefix, item)``. Its rows per prefix are the frequent extensions, whose supports sum to at most the
    total suffix length; with a support floor of a share of n that bounds the list by (mean suffix length / share).
    """
    allowed = kept.groupBy(*keys, "prefix").agg(F.collect_list("item").alias("allowed"))
    cut = (
        join_same(level, allowed, [*keys, "prefix"])
        .withColumn("suffix", F.array_intersect("suffix", "allowed"))
        .groupBy(*keys, "n", "floor", "prefix", "suffix")
        .agg(F.sum("mult").alias("mult"))
    )
    return (
        cut.select(*keys, "n", "floor", "prefix", "suffix", "mult", F.posexplode("suffix").alias("at", "item"))
        .withColumn("prefix", F.concat("prefix", F.array("item")))
        .withColumn("suffix", F.slice("suffix", F.col("at") + 2, F.greatest(F.size("suffix"), F.lit(1))))
        .filter(F.size("suffix") > 0)
        .groupBy(*keys, "n", "floor", "prefix", "suffix")
        .agg(F.sum("mult").alias("mult"))
    )


def _singles(level: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of every prefix widened by one item."""
    return (
        level.select(*keys, "n", "floor", "prefix", F.explode("suffix").alias("item"), "mult")
        .groupBy(*keys, "n", "floor", "prefix", "item")
        .agg(F.sum("mult").alias("freq"))
    )


def _enumerated(level: DataFrame, keys: Sequence[str], room: int | None) -> DataFrame:
    """Counts of all itemsets still reachable from a level, in one aggregate."""
    return (
        level.select(*keys, "n", "floor", "prefix", F.explode(subsets(F.col("suffix"), room)).alias("more"), "mult")
        .filter(F.size("more") > 0)
        .groupBy(*keys, "n", "floor", F.concat("prefix", "more").alias("itemset"))
        .agg(F.sum("mult").alias("freq"))
    )


def _reach(level: DataFrame, room: int | None) -> tuple[int, float, float]:
    """Rows of a level, the subset rows it would emit, and the most of one row. One small aggregate."""
    width = F.size("suffix")
    emitted = F.pow(F.lit(2.0), width)
    if room is not None:
        emitted = F.least(emitted, F.pow(width + F.lit(1.0), F.lit(float(room))))
    rows, total, largest = level.agg(F.count(F.lit(1)), F.sum(emitted), F.max(emitted)).first()
    return rows, total or 0.0, largest or 0.0


def _enumerable(emitted: float, largest: float, enumeration_rows: int) -> bool:
    return emitted <= enumeration_rows and largest <= ENUMERATION_PER_ROW


def mine_levels(
    level: DataFrame, *, group_cols: Sequence[str], max_len: int | None, enumeration_rows: int = ENUMERATION_ROWS
) -> DataFrame:
    """Grow frequent itemsets from rows ``(group, n, floor, prefix, suffix, mult)``; returns ``(group, n, itemset, freq)``."""
    keys = list(group_cols)
    found: list[DataFrame] = []
    depth = 0
    while True:
        room = None if max_len is None else max_len - depth
        rows, emitted, largest = _reach(level, room)
        if rows == 0 and found:
            break
        if _enumerable(emitted, largest, enumeration_rows):
            level = spread_rows(level, rows, emitted, *keys, "prefix", "suffix")
            last = _enumerated(level, keys, room).filter(F.col("freq") >= F.col("floor"))
            found.append(last.select(*keys, "n", "itemset", "freq"))
            break
        counted = materialise(_singles(level, keys).filter(F.col("freq") >= F.col("floor")), f"frequent-{depth + 1}")
        found.append(counted.select(*keys, "n", F.concat("prefix", F.array("item")).alias("itemset"), "freq"))
        depth += 1
        if depth == max_len:
            break
        level = materialise(_narrow(level, counted, keys), f"projected-{depth}")
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def _first_level(copies: DataFrame, floor: Column) -> DataFrame:
    return copies.withColumn("floor", floor).withColumn("prefix", string_array([]))


def _shares(found: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    return found.select(
        *group_cols,
        "itemset",
        F.size("itemset").alias("k"),
        "freq",
        (F.col("freq") / F.col("n")).alias("value"),
        "n",
    )


def frequent_itemsets_levelwise(
    baskets: DataFrame,
    *,
    min_support: float,
    group_cols: Sequence[str] = (),
    items_col: str = "items",
    times_col: str | None = None,
    strict: bool = False,
    max_len: int | None = None,
    enumeration_rows: int = ENUMERATION_ROWS,
) -> DataFrame:
    """``(group, itemset, k, freq, value, n)`` of every frequent itemset, for one collection or many groups in one job."""
    copies = materialise(basket_copies(baskets, group_cols, items_col, times_col), "baskets")
    totals = _with_totals(copies, group_cols)
    level = _first_level(totals, support_floor(F.col("n"), min_support, strict))
    found = mine_levels(level, group_cols=group_cols, max_len=max_len, enumeration_rows=enumeration_rows)
    return _shares(found, group_cols)


def frequent_itemsets(
    baskets: DataFrame, *, min_support: float = 0.2, min_confidence: float = 0.5, items_col: str = "items"
) -> DataFrame:
    """``(itemset, k, freq, value, n)`` by MLlib's parallel FP-Growth."""
    model, n = fit_fpgrowth(baskets, min_support=min_support, min_confidence=min_confidence, items_col=items_col)
    found = model.freqItemsets.select(
        F.sort_array("items").alias("itemset"), "freq", F.lit(n).cast("bigint").alias("n")
    )
    return _shares(found, ())


def fit_fpgrowth(
    baskets: DataFrame, *, min_support: float, min_confidence: float = 0.5, items_col: str = "items"
):
    """The fitted FP-Growth model and the number of baskets. The baskets are written once: count and fit both read them."""
    source = materialise(baskets.filter(F.col(items_col).isNotNull()).select(items_col), "fp-baskets")
    growth = FPGrowth(itemsCol=items_col, minSupport=min_support, minConfidence=min_confidence)
    return growth.fit(source), source.count()


def association_rules(
    baskets: DataFrame, *, min_support: float, min_confidence: float, items_col: str = "items"
) -> DataFrame:
    """Rules of the FP-Growth model."""
    model, _ = fit_fpgrowth(baskets, min_support=min_support, min_confidence=min_confidence, items_col=items_col)
    return model.associationRules.select(
        F.sort_array("antecedent").alias("antecedent"), "consequent", "confidence", "lift", "support"
    )


def count_candidates(
    copies: DataFrame, candidates: DataFrame, *, enumeration_rows: int = ENUMERATION_ROWS
) -> DataFrame:
    """``(n, itemset, freq)`` of given itemsets over ``(suffix, mult, n, floor, prefix)`` rows.

    Every prefix of a candidate must be a candidate too, which any union of locally frequent sets fulfils.
    """
    depths = candidates.agg(F.max(F.size("itemset"))).first()[0] or 0
    found: list[DataFrame] = []
    level = copies
    for k in range(1, depths + 1):
        room = depths - k + 1
        rows, emitted, largest = _reach(level, room)
        if _enumerable(emitted, largest, enumeration_rows):
            level = spread_rows(level, rows, emitted, "prefix", "suffix")
            rest = candidates.filter(F.size("itemset") >= k)
            found.append(
                _enumerated(level, [], room).join(rest, "itemset", "left_semi").select("n", "floor", "itemset", "freq")
            )
            break
        wanted = candidates.filter(F.size("itemset") == k).select(
            F.slice("itemset", 1, k - 1).alias("prefix"), F.element_at("itemset", -1).alias("item")
        )
        counted = _singles(level, []).join(wanted, ["prefix", "item"], "left_semi")
        found.append(counted.select("n", "floor", F.concat("prefix", F.array("item")).alias("itemset"), "freq"))
        if k < depths:
            level = materialise(_narrow(level, wanted, []), f"counted-{k}")
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def frequent_itemsets_son(
    baskets: DataFrame,
    *,
    min_support: float = 0.2,
    chunks: int = 8,
    id_col: str = "_id",
    items_col: str = "items",
    max_len: int | None = None,
    enumeration_rows: int = ENUMERATION_ROWS,
) -> DataFrame:
    """Two-pass mining, support strictly above ``min_support * n``.

    Pass one mines hash chunks of the ids with the threshold divided by the number of chunks; the union of their results
    misses nothing, since an itemset above the threshold overall is above the share of it in some chunk. Pass two counts just
    those candidates over all baskets.
    """
    chunked = baskets.withColumn("chunk", F.pmod(F.xxhash64(id_col), F.lit(chunks)))
    copies = materialise(basket_copies(chunked, ["chunk"], items_col), "son-baskets")
    n = copies.agg(F.sum("mult")).first()[0] or 0
    totals = copies.withColumn("n", F.lit(n).cast("bigint"))
    local = _first_level(totals, F.lit(math.floor(min_support * n / chunks) + 1).cast("bigint"))
    mined = mine_levels(local, group_cols=["chunk"], max_len=max_len, enumeration_rows=enumeration_rows)
    candidates = materialise(mined.select("itemset").distinct(), "son-candidates")
    whole = totals.groupBy("suffix", "n").agg(F.sum("mult").alias("mult"))
    level = _first_level(whole, support_floor(F.col("n"), min_support, strict=True))
    if candidates.isEmpty():
        zero, size = F.lit(0).cast("bigint"), F.lit(n).cast("bigint")
        return _shares(candidates.select("itemset", zero.alias("freq"), size.alias("n")), ())
    counted = count_candidates(level, candidates, enumeration_rows=enumeration_rows)
    return _shares(counted.filter(F.col("freq") >= F.col("floor")), ())
