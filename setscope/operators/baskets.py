"""Baskets, sequences and tags: filters, shaping and roll-up.

A track is ``(_id, confidence, items MAP<STRING,DOUBLE>, seq ARRAY<STRUCT<label>>)``; a basket is ``(_id, items ARRAY<STRING>)`` with
sorted distinct labels; the long form is ``(_id, item, share)``. All of it stays in built-in higher-order functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setscope.functions.columns import string_array


def filter_confidence(tracks: DataFrame, above: float | None) -> DataFrame:
    """Keep tracks with confidence strictly above a bound; ``None`` keeps all."""
    return tracks if above is None else tracks.filter(F.col("confidence") > above)


def scan_limit(tracks: DataFrame, n: int | None, *, id_col: str = "_id") -> DataFrame:
    """The first ``n`` tracks by id (a top-n, so no full sort); ``None`` keeps all."""
    return tracks if n is None else tracks.orderBy(id_col).limit(n)


def items_above(items: Column, ratio: float | None) -> Column:
    """Sorted labels of a share map: shares that are not null and, with a ratio, strictly above it."""
    kept = F.map_filter(items, lambda _, v: v.isNotNull() if ratio is None else v > ratio)
    return F.sort_array(F.map_keys(kept))


def basket_items(tracks: DataFrame, ratio: float | None) -> DataFrame:
    """``(_id, items)`` of every track."""
    return tracks.select("_id", items_above(F.col("items"), ratio).alias("items"))


def items_long(tracks: DataFrame, ratio: float | None) -> DataFrame:
    """``(_id, item, share)`` for shares strictly above the ratio."""
    long = tracks.select("_id", F.explode("items").alias("item", "share"))
    return long.filter(F.col("share").isNotNull() if ratio is None else F.col("share") > ratio)


def basket_rollup(tracks: DataFrame, ratio: float | None, roll_up: DataFrame) -> DataFrame:
    """``(_id, items)`` after mapping each label to its parent; ``roll_up`` is ``(item, parent)``. Empty baskets stay."""
    long = tracks.select("_id", F.explode_outer(items_above(F.col("items"), ratio)).alias("item"))
    parents = F.sort_array(F.collect_set("parent")).alias("items")
    return long.join(roll_up, "item", "left").groupBy("_id").agg(parents)


def roll_up_expr(items: Column, mapping: dict[str, str]) -> Column:
    """Roll-up of a label array when the mapping is a short literal: no join, no shuffle."""
    lookup = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.sort_array(F.array_distinct(F.filter(F.transform(items, lambda i: lookup[i]), lambda p: p.isNotNull())))


def sequence_shape(tracks: DataFrame, *, seq_col: str = "seq") -> DataFrame:
    """``(_id, sequence)``: each event becomes a one-label itemset."""
    return tracks.select("_id", F.transform(seq_col, lambda e: F.array(e["label"])).alias("sequence"))


def sequence_rollup(sequences: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Map every label of a shaped sequence to its parent; unmapped labels are left out."""
    lookup = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    mapped = F.transform("sequence", lambda s: F.filter(F.transform(s, lambda i: lookup[i]), lambda p: p.isNotNull()))
    return sequences.withColumn("sequence", F.filter(mapped, lambda s: F.size(s) > 0))


def normal_ids(meta: DataFrame) -> DataFrame:
    """Metadata with whole-number ids; an id that is no number becomes NULL."""
    return meta.withColumn("_id", F.col("_id").try_cast("bigint"))


def tags_of(tag_name: str) -> Column:
    return F.col(f"musicinfo.tags.{tag_name}")


def tag_filter(meta: DataFrame, tag_name: str, tag_val: str) -> DataFrame:
    """Metadata rows whose tag array holds the value."""
    return meta.filter(F.array_contains(tags_of(tag_name), tag_val))


def tags_all_of(meta: DataFrame, tag_name: str, tag_vals: str | Sequence[str]) -> DataFrame:
    """Metadata rows that hold every value of a list (or of a comma list)."""
    wanted = tag_vals.split(",") if isinstance(tag_vals, str) else list(tag_vals)
    return meta.filter(F.size(F.array_except(string_array(wanted), tags_of(tag_name))) == 0)


def meta_scan(meta: DataFrame, tag_name: str, tag_val: str) -> DataFrame:
    """``(_id, <tag_name>)`` of the rows that hold the tag."""
    return tag_filter(meta, tag_name, tag_val).select("_id", tags_of(tag_name).alias(tag_name))


def join_meta(baskets: DataFrame, meta: DataFrame, tag_name: str, tag_val: str) -> DataFrame:
    """Attach the tag array and drop baskets without the tag."""
    return baskets.join(meta_scan(normal_ids(meta), tag_name, tag_val), "_id")


def tracks_with_items(tracks: DataFrame, items: Sequence[str], ratio: float = 0.05) -> DataFrame:
    """Tracks in which each listed label has a share strictly above the ratio."""
    for item in items:
        tracks = tracks.filter(F.col("items")[item] > ratio)
    return tracks


def weighted_transactions(
    tracks: DataFrame, meta: DataFrame, *, ratio: float | None, confidence: float | None
) -> DataFrame:
    """``(tid, item, qty)`` of confident tracks that have metadata, shares above the ratio."""
    known = filter_confidence(tracks, confidence).join(normal_ids(meta).select("_id"), "_id", "left_semi")
    return items_long(known, ratio).select(F.col("_id").alias("tid"), "item", F.col("share").alias("qty"))


def ranked_items(items: Column) -> Column:
    """Entries ``(minus, label)`` of a share map by falling share, ties by label; null shares left out."""
    entries = F.map_entries(F.map_filter(items, lambda _, v: v.isNotNull()))
    return F.sort_array(F.transform(entries, lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("label"))))


def with_ranked_items(tracks: DataFrame) -> DataFrame:
    """``items`` replaced by ``labels`` and ``shares``, parallel arrays by falling share."""
    ranked = tracks.withColumn("ranked", ranked_items(F.col("items"))).drop("items")
    return ranked.withColumn("labels", F.col("ranked.label")).withColumn(
        "shares", F.transform("ranked.minus", lambda m: -m)
    ).drop("ranked")


def tracks_ranked_items(tracks: DataFrame) -> DataFrame:
    """``(_id, labels, shares)``."""
    return with_ranked_items(tracks.select("_id", "items"))
