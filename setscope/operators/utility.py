"""Utility mining: totals, weighted utilities, and high-utility itemsets.

Input is ``(group, tid, item, qty)`` in long form and unit utilities ``(item, eutil)``. Before anything is paired or widened,
transactions with the same labels are merged by adding their utilities label by label: the utility of an itemset is a sum over
the transactions that contain it, so merging loses nothing, and a hot set of copies shrinks to one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setscope.functions.columns import in_row_pairs, join_same, string_array
from setscope.functions.tables import materialise, spread_rows

ENUMERATION_ROWS = 50_000_000
ENUMERATION_WIDTH = 14


def item_utilities(
    transactions: DataFrame, utilities: DataFrame, group_cols: Sequence[str] = (), *, unique: bool = False
) -> DataFrame:
    """``(group, tid, item, u)``: quantity times unit utility, one row per label of a transaction.

    ``unique`` says that the input already has one row per label, which saves a shuffle.
    """
    valued = transactions.join(utilities, "item").select(*group_cols, "tid", "item", (F.col("qty") * F.col("eutil")).alias("u"))
    return valued if unique else valued.groupBy(*group_cols, "tid", "item").agg(F.sum("u").alias("u"))


def total_utility(items: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """``(group, total)``."""
    return items.groupBy(*group_cols).agg(F.sum("u").alias("total"))


def transaction_utility(items: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """``(group, tid, tu)``."""
    return items.groupBy(*group_cols, "tid").agg(F.sum("u").alias("tu"))


def transaction_arrays(items: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """``(group, tid, items, us)``: labels of each transaction, sorted, and their utilities. At most one entry per label."""
    entries = F.sort_array(F.collect_list(F.struct("item", "u")))
    per_tid = items.groupBy(*group_cols, "tid").agg(entries.alias("e"))
    return per_tid.select(*group_cols, "tid", F.col("e.item").alias("items"), F.col("e.u").alias("us"))


def map_arrays(rows: DataFrame, quantities: str, utilities: DataFrame) -> DataFrame:
    """``transaction_arrays`` of rows that hold a transaction as a map from label to quantity: the map gives way to ``(items, us)``.

    The unit utilities come along as one map of the label domain, so no transaction is taken apart and gathered again. Labels without
    a unit utility drop out, and so do transactions left without labels.
    """
    units = utilities.agg(F.map_from_entries(F.collect_list(F.struct("item", "eutil")))).scalar()
    known = rows.withColumn("_units", units)
    entries = F.map_entries(F.map_filter(quantities, lambda k, _: F.map_contains_key("_units", k)))
    valued = F.transform(entries, lambda e: F.struct(e["key"].alias("item"), (e["value"] * F.col("_units")[e["key"]]).alias("u")))
    sorted_rows = known.withColumn("_e", F.sort_array(valued)).filter(F.size("_e") > 0)
    return sorted_rows.withColumn("items", F.col("_e.item")).withColumn("us", F.col("_e.u")).drop("_units", "_e", quantities)


def merged_transactions(items: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """``(group, items, us)``: transactions with equal label sets added up, position by position."""
    return add_arrays(transaction_arrays(items, group_cols), [*group_cols, "items"], "us")


def add_arrays(rows: DataFrame, keys: Sequence[str], values: str) -> DataFrame:
    """Add the arrays of equal keys element by element; arrays of one key have one length."""
    sums = rows.select(*keys, F.posexplode(values).alias("at", "x")).groupBy(*keys, "at").agg(F.sum("x").alias("x"))
    gathered = F.sort_array(F.collect_list(F.struct("at", "x")))
    return sums.groupBy(*keys).agg(F.transform(gathered, lambda s: s["x"]).alias(values))


def _array_sum(values: Column, like: Column) -> Column:
    return F.aggregate(values, like - like, lambda acc, x: acc + x)


def _with_tu(merged: DataFrame) -> DataFrame:
    return merged.withColumn("tu", _array_sum(F.col("us"), F.element_at("us", 1)))


def twu_items(items: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """``(group, item, twu, rank)``: utility of the transactions holding a label, ranked upwards, ties by label."""
    keys = list(group_cols)
    arrays = _with_tu(transaction_arrays(items, keys))
    weighted = arrays.select(*keys, F.explode("items").alias("item"), "tu").groupBy(*keys, "item").agg(F.sum("tu").alias("twu"))
    # The window runs over the label domain, one row per label.
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("twu", "item")
    return weighted.withColumn("rank", F.row_number().over(order))


def eucs_pairs(items: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """``(group, a, b, twu)``: utility of the transactions holding both labels, a before b."""
    keys = list(group_cols)
    merged = _with_tu(merged_transactions(items, keys))
    pairs = merged.select(*keys, "tu", F.explode(in_row_pairs(F.col("items"))).alias("p"))
    return pairs.groupBy(*keys, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("tu").alias("twu"))


def utility_lists(items: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """``(group, item, tid, iutil, rutil)``: own utility and that of later labels, in rising order of weighted utility.

    A transaction has at most one row per label here, so the window partition is bounded by the label domain.
    """
    keys = list(group_cols)
    ranks = twu_items(items, keys).select(*keys, "item", "rank")
    rest = (
        Window.partitionBy(*keys, "tid").orderBy("rank").rowsBetween(Window.currentRow + 1, Window.unboundedFollowing)
    )
    ranked = join_same(items, ranks, [*keys, "item"])
    later = F.sum("u").over(rest)
    return ranked.select(
        *keys, "item", "tid", F.col("u").alias("iutil"), F.coalesce(later, F.col("u") - F.col("u")).alias("rutil")
    )


def _suffix_totals(us: Column) -> Column:
    """Utility after each position of an array."""
    return F.transform(
        us, lambda u, i: F.aggregate(F.slice(us, i + F.lit(2), F.size(us)), u - u, lambda acc, x: acc + x)
    )


def _itemset_utilities(items: Column, us: Column, iutil: Column) -> Column:
    """All subsets of the labels with their utility on top of ``iutil``, as structs ``(more, u)``."""
    pairs = F.arrays_zip(items.alias("i"), us.alias("u"))
    start = F.array(F.struct(string_array([]).alias("more"), iutil.alias("u")))
    return F.aggregate(
        pairs,
        start,
        lambda found, p: F.concat(
            found,
            F.transform(
                found,
                lambda s: F.struct(F.concat(s["more"], F.array(p["i"])).alias("more"), (s["u"] + p["u"]).alias("u")),
            ),
        ),
    )


def high_utility_itemsets(
    transactions: DataFrame,
    utilities: DataFrame,
    *,
    min_util: float,
    as_share: bool = True,
    group_cols: Sequence[str] = (),
    unique: bool = False,
    enumeration_rows: int = ENUMERATION_ROWS,
) -> DataFrame:
    """``(group, itemset, k, utility, value)`` of itemsets whose utility reaches the threshold.

    The threshold is a share of the group's total utility or an absolute utility; ``value`` is of the same kind. A level holds
    ``(prefix, utility of the prefix, remaining labels and utilities)``. Three exact bounds prune it: an itemset is emitted when its
    utility reaches the threshold; a prefix is widened when utility plus remaining utility does; a label stays in the rest of a prefix
    while the utility of the rows holding both does. The last is at most the pair bound of the two labels (``eucs_pairs``), so it prunes
    at least as much.
    """
    items = item_utilities(transactions, utilities, group_cols, unique=unique)
    return mine_arrays(
        transaction_arrays(items, group_cols),
        min_util=min_util,
        as_share=as_share,
        group_cols=group_cols,
        enumeration_rows=enumeration_rows,
    )


def mine_arrays(
    arrays: DataFrame,
    *,
    min_util: float,
    as_share: bool = True,
    group_cols: Sequence[str] = (),
    enumeration_rows: int = ENUMERATION_ROWS,
) -> DataFrame:
    """``high_utility_itemsets`` over rows ``(group, items, us)``, one per transaction."""
    # Without groups one written column stands for the whole collection, so every step has a group key.
    keys = list(group_cols) or ["_all"]
    if not group_cols:
        arrays = arrays.withColumn("_all", F.lit(0))
    merged = materialise(_with_tu(add_arrays(arrays, [*keys, "items"], "us")), "utility-baskets")
    if group_cols:
        merged = join_same(merged, merged.groupBy(*keys).agg(F.sum("tu").alias("total")), keys)
    else:
        whole = merged.agg(F.sum("tu").alias("total"))
        merged = merged.withColumn("total", F.lit(whole.first()[0]).cast(whole.schema["total"].dataType))
    goal = F.lit(float(min_util)) * F.col("total") if as_share else F.lit(float(min_util))
    merged = merged.withColumn("goal", goal)

    level = merged.select(
        *keys, "total", "goal", string_array([]).alias("prefix"), "items", F.concat("us", F.array(_zero())).alias("us")
    )
    result = _grow(level, merged, keys, enumeration_rows)
    value = F.col("utility") / F.col("total") if as_share else F.col("utility")
    return result.select(
        *group_cols, F.sort_array("itemset").alias("itemset"), F.size("itemset").alias("k"), "utility", value.alias("value")
    )


def _zero() -> Column:
    """Zero of the utilities' own type."""
    return F.element_at("us", 1) - F.element_at("us", 1)


def _enumerable(level: DataFrame, enumeration_rows: int) -> tuple[int, float, bool]:
    """Rows of a level, subset rows it would emit, and whether those are few enough to be summed in one aggregate."""
    width = F.size("items")
    rows, emitted, widest = level.agg(F.count(F.lit(1)), F.sum(F.pow(F.lit(2.0), width)), F.max(width)).first()
    emitted = float(emitted or 0.0)
    return rows, emitted, emitted <= enumeration_rows and (widest or 0) <= ENUMERATION_WIDTH


def _grow(level: DataFrame, merged: DataFrame, keys: Sequence[str], enumeration_rows: int) -> DataFrame:
    """``(keys, total, itemset, utility)`` of all itemsets that reach the goal, level by level until the rest is small."""
    rows, emitted, small = _enumerable(level, enumeration_rows)
    if small:
        return _finish(spread_rows(level, rows, emitted, *keys, "prefix", "items"), keys)
    level = materialise(_ranked_level(merged, keys), "utility-level-0")
    found: list[DataFrame] = []
    depth = 0
    while True:
        rows, emitted, small = _enumerable(level, enumeration_rows)
        if not rows and found:
            break
        if small:
            found.append(_finish(spread_rows(level, rows, emitted, *keys, "prefix", "items"), keys))
            break
        grown = materialise(_widened(level, keys), f"utility-{depth + 1}")
        hits = grown.filter(F.col("utility") >= F.col("goal"))
        found.append(hits.select(*keys, "total", F.concat("prefix", F.array("item")).alias("itemset"), "utility"))
        depth += 1
        level = materialise(_narrowed(level, grown, keys), f"utility-level-{depth}")
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def _ranked_level(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First level: labels whose weighted utility reaches the goal, in its rising order, equal rows merged again.

    The order is one array per group, bounded by the label domain.
    """
    twu = (
        merged.select(*keys, "goal", F.explode("items").alias("item"), "tu")
        .groupBy(*keys, "goal", "item")
        .agg(F.sum("tu").alias("twu"))
        .filter(F.col("twu") >= F.col("goal"))
        .groupBy(*keys)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("twu", "item"))), lambda s: s["item"]).alias("ranked"))
    )
    # The label array keeps its own name until the lambda below has read it: an alias of the same select would shadow it there.
    tails = join_same(merged, twu, keys).withColumn("tail", F.array_intersect("ranked", "items"))
    tails = tails.filter(F.size("tail") > 0)
    lookup = F.map_from_arrays("items", "us")
    in_order = F.concat(F.transform("tail", lambda i: lookup[i]), F.array(_zero()))
    level = tails.select(*keys, "total", "goal", string_array([]).alias("prefix"), "tail", in_order.alias("ranked_us"))
    level = level.withColumnsRenamed({"tail": "items", "ranked_us": "us"})
    return add_arrays(level, [*keys, "total", "goal", "prefix", "items"], "us")


def _rest(level: DataFrame) -> tuple[Column, Column]:
    """Utilities of the remaining labels, and that of the prefix (the last element of ``us``)."""
    return F.slice("us", 1, F.size("items")), F.element_at("us", -1)


def _finish(level: DataFrame, keys: Sequence[str]) -> DataFrame:
    us, iutil = _rest(level)
    spread = level.select(
        *keys, "total", "goal", "prefix", F.explode(_itemset_utilities(F.col("items"), us, iutil)).alias("s")
    ).filter(F.size("s.more") > 0)
    sums = spread.groupBy(*keys, "total", "goal", F.concat("prefix", "s.more").alias("itemset")).agg(
        F.sum("s.u").alias("utility")
    )
    return sums.filter(F.col("utility") >= F.col("goal")).select(*keys, "total", "itemset", "utility")


def _widened(level: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per prefix and next label: utility, utility plus remaining utility, and utility of all rows holding both."""
    us, iutil = _rest(level)
    steps = F.arrays_zip(F.col("items").alias("item"), us.alias("u"), _suffix_totals(us).alias("later"))
    rows = level.select(
        *keys, "total", "goal", "prefix", iutil.alias("own"), _array_sum(us, iutil).alias("rest"), F.explode(steps).alias("s")
    )
    return rows.groupBy(*keys, "total", "goal", "prefix", F.col("s.item").alias("item")).agg(
        F.sum(F.col("own") + F.col("s.u")).alias("utility"),
        F.sum(F.col("own") + F.col("s.u") + F.col("s.later")).alias("reach"),
        F.sum(F.col("own") + F.col("rest")).alias("both"),
    )


def _narrowed(level: DataFrame, grown: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the widened prefixes with the labels still worth trying, equal rows merged."""
    bounds = grown.filter(F.col("both") >= F.col("goal")).groupBy(*keys, "prefix").agg(
        F.collect_list("item").alias("kept"),
        F.collect_list(F.when(F.col("reach") >= F.col("goal"), F.col("item"))).alias("widen"),
    )
    us, iutil = _rest(level)
    rows = join_same(level, bounds, [*keys, "prefix"])
    tail = F.filter(F.arrays_zip(F.col("items").alias("i"), us.alias("u")), lambda x: F.array_contains(F.col("kept"), x["i"]))
    steps = rows.select(*keys, "total", "goal", "prefix", "widen", iutil.alias("own"), tail.alias("tail")).select(
        "*", F.posexplode("tail").alias("at", "s")
    )
    after = F.slice("tail", F.col("at") + 2, F.greatest(F.size("tail"), F.lit(1)))
    wide = steps.filter(F.array_contains("widen", F.col("s.i"))).select(
        *keys,
        "total",
        "goal",
        F.concat("prefix", F.array("s.i")).alias("prefix"),
        F.transform(after, lambda x: x["i"]).alias("items"),
        F.concat(F.transform(after, lambda x: x["u"]), F.array(F.col("own") + F.col("s.u"))).alias("us"),
    )
    return add_arrays(wide.filter(F.size("items") > 0), [*keys, "total", "goal", "prefix", "items"], "us")
