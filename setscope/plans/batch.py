"""Batch mining: every tag and roll-up of a collection in one job, as rows of the result table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setscope.functions.columns import join_same, string_array
from setscope.functions.tables import local_table
from setscope.operators.baskets import filter_confidence, items_above, items_long, normal_ids, roll_up_expr, tags_of
from setscope.operators.itemsets import frequent_itemsets_levelwise
from setscope.operators.utility import add_arrays, item_utilities, mine_arrays, transaction_arrays

# Thresholds of the batch runs.
MIN_SUPPORT = 0.01
MIN_UTILITY = 0.01
FILTER_RATIO = 0.05
FILTER_CONFIDENCE = 0.6


def run_id(
    tag: Column, tags: Sequence[str], *, minimum: float, ratio: float | None, confidence: float | None, ending: Column
) -> Column:
    """``0003-0.01-0.05-0.6-<ending>``: index of the tag (the whole collection comes last) and the parameters."""
    index = F.when(tag.isNull(), F.lit(len(tags))).otherwise(F.array_position(string_array(tags), tag).cast("int") - 1)
    parts = [F.lit(str(p)) for p in (minimum, ratio, confidence)]
    return F.concat_ws("-", F.lpad(index.cast("string"), 4, "0"), *parts, ending)


def frequent_ending(rollup: Column) -> Column:
    return F.when(rollup, F.lit("Truef")).otherwise(F.lit("Falsef"))


def _name(tag_name: str) -> Column:
    return F.when(F.col("tag").isNotNull(), F.lit(tag_name)).alias("tag_name")


def with_tags(tracks: DataFrame, meta: DataFrame | None, tag_name: str, tags: Sequence[str]) -> DataFrame:
    """One row per track and wanted tag, plus one with tag NULL for the whole collection.

    A left join, so tracks without metadata still count in the whole collection.
    """
    return each_tag(wanted_tags(tracks, meta, tag_name, tags))


def wanted_tags(tracks: DataFrame, meta: DataFrame | None, tag_name: str, tags: Sequence[str]) -> DataFrame:
    """Tracks with ``t``, their wanted tags as a sorted array; empty without metadata.

    ``meta`` is None wherever the rows carry their ``t`` already; they need no id then.
    """
    if meta is None:
        return tracks
    own = F.array_sort(F.array_intersect(F.array_distinct(tags_of(tag_name)), string_array(tags)))
    joined = tracks.join(normal_ids(meta).select("_id", own.alias("t")), "_id", "left")
    return joined.withColumn("t", F.coalesce("t", string_array([])))


def each_tag(rows: DataFrame) -> DataFrame:
    """A row for NULL and for each tag in ``t``."""
    return rows.withColumn("tag", F.explode(F.concat(F.array(F.lit(None).cast("string")), "t"))).drop("t")


def _key(meta: DataFrame | None) -> str:
    return "t" if meta is None else "_id"


def tag_sizes(
    tracks: DataFrame, meta: DataFrame | None, *, tag_name: str, tags: Sequence[str], confidence: float | None = FILTER_CONFIDENCE
) -> DataFrame:
    """``(tag, n)``: the number of confident tracks of each tag, and of all with tag NULL."""
    kept = filter_confidence(tracks, confidence).select(_key(meta))
    return with_tags(kept, meta, tag_name, tags).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def run_headers(
    tracks: DataFrame,
    meta: DataFrame | None,
    *,
    tag_name: str,
    tags: Sequence[str],
    fi_type: str,
    minimum: float,
    ratio: float | None = FILTER_RATIO,
    confidence: float | None = FILTER_CONFIDENCE,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """A header for every run of a batch, also of tags that no track has: parameters and the number of tracks.

    ``sizes`` are the ``tag_sizes`` of the tracks if they are known already.
    """
    spark = tracks.sparkSession
    if sizes is None:
        sizes = tag_sizes(tracks, meta, tag_name=tag_name, tags=tags, confidence=confidence)
    rollups = [False, True] if fi_type == "frequent" else [False]
    wanted = [(t, r) for t in [*tags, None] for r in rollups]
    runs = local_table(spark, {"tag": [t for t, _ in wanted], "rollup": [r for _, r in wanted]})
    ending = frequent_ending(F.col("rollup")) if fi_type == "frequent" else F.lit(fi_type)
    known = join_same(runs, sizes, ["tag"], "left")
    return known.select(
        run_id(F.col("tag"), tags, minimum=minimum, ratio=ratio, confidence=confidence, ending=ending).alias("run_id"),
        _name(tag_name),
        "tag",
        *[F.lit(v).cast("double").alias(c) for c, v in (("minimum", minimum), ("ratio", ratio), ("confidence", confidence))],
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.lit(fi_type).alias("fi_type"),
        "rollup",
    )


def frequent_by_tag(
    tracks: DataFrame,
    meta: DataFrame | None,
    *,
    tag_name: str,
    tags: Sequence[str],
    roll_up: dict[str, str],
    min_support: float = MIN_SUPPORT,
    ratio: float | None = FILTER_RATIO,
    confidence: float | None = FILTER_CONFIDENCE,
    max_len: int | None = None,
) -> DataFrame:
    """Result rows of all tags with and without roll-up, mined together with tag and roll-up as group keys."""
    kept = filter_confidence(tracks, confidence)
    baskets = kept.select(_key(meta), items_above(F.col("items"), ratio).alias("plain"))
    both = F.array(
        F.struct(F.lit(False).alias("rollup"), F.col("plain").alias("items")),
        F.struct(F.lit(True).alias("rollup"), roll_up_expr(F.col("plain"), roll_up).alias("items")),
    )
    # Equal baskets with equal tags are merged before they are multiplied by tags and roll-ups.
    merged = wanted_tags(baskets, meta, tag_name, tags).withColumn("plain", F.array_sort("plain"))
    merged = merged.groupBy("t", "plain").agg(F.count(F.lit(1)).alias("times"))
    grouped = each_tag(merged).select("tag", "times", F.explode(both).alias("b")).select("tag", "times", "b.*")
    found = frequent_itemsets_levelwise(
        grouped, min_support=min_support, group_cols=["tag", "rollup"], times_col="times", max_len=max_len
    )
    key = run_id(
        F.col("tag"), tags, minimum=min_support, ratio=ratio, confidence=confidence, ending=frequent_ending(F.col("rollup"))
    )
    return found.select(
        key.alias("run_id"), _name(tag_name), "tag", "rollup", F.lit("frequent").alias("fi_type"), "itemset", "k", "freq", "value", "n"
    )


def high_utility_by_tag(
    tracks: DataFrame,
    transactions: DataFrame,
    utilities: DataFrame,
    meta: DataFrame,
    *,
    tag_name: str,
    tags: Sequence[str],
    min_util: float = MIN_UTILITY,
    ratio: float | None = FILTER_RATIO,
    confidence: float | None = FILTER_CONFIDENCE,
    known_only: bool = False,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Result rows of all tags. ``tracks`` gives the number of tracks, ``transactions`` their filtered
    ``(tid, item, qty)``, one row per label; with ``known_only``, those of tracks with metadata. ``sizes`` are the ``tag_sizes`` of the
    tracks if they are known already.
    """
    if known_only:
        ids = normal_ids(meta).select("_id").distinct()
        tracks = tracks.join(ids, "_id", "left_semi")
        transactions = transactions.join(ids.withColumnRenamed("_id", "tid"), "tid", "left_semi")
    if sizes is None:
        sizes = tag_sizes(tracks, meta, tag_name=tag_name, tags=tags, confidence=confidence)
    # Tags are attached to one row per transaction, and equal label sets with equal tags are added up before tags multiply them.
    arrays = transaction_arrays(item_utilities(transactions, utilities, unique=True)).withColumnRenamed("tid", "_id")
    tagged = wanted_tags(arrays, meta, tag_name, tags)
    return utility_runs(tagged, sizes, tag_name=tag_name, tags=tags, min_util=min_util, ratio=ratio, confidence=confidence)


def utility_runs(
    arrays: DataFrame,
    sizes: DataFrame,
    *,
    tag_name: str,
    tags: Sequence[str],
    min_util: float = MIN_UTILITY,
    ratio: float | None = FILTER_RATIO,
    confidence: float | None = FILTER_CONFIDENCE,
) -> DataFrame:
    """Result rows of all tags from filtered transactions ``(t, items, us)``, their tags beside their labels and utilities."""
    merged = add_arrays(arrays, ["t", "items"], "us")
    found = mine_arrays(each_tag(merged), min_util=min_util, group_cols=["tag"])
    found = join_same(found, sizes, ["tag"])
    key = run_id(F.col("tag"), tags, minimum=min_util, ratio=ratio, confidence=confidence, ending=F.lit("hui"))
    return found.select(
        key.alias("run_id"),
        _name(tag_name),
        "tag",
        F.lit(False).alias("rollup"),
        F.lit("hui").alias("fi_type"),
        "itemset",
        "k",
        F.lit(None).cast("bigint").alias("freq"),
        "value",
        "n",
    )


def share_transactions(tracks: DataFrame, *, ratio: float | None, confidence: float | None) -> DataFrame:
    """``(tid, item, qty)`` with shares as quantities."""
    long = items_long(filter_confidence(tracks, confidence), ratio)
    return long.select(F.col("_id").alias("tid"), "item", F.col("share").alias("qty"))
