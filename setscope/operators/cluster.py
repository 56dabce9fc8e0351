"""Edge bundling: features of pairs and axis segments, and their clusters.

Clustering works on the distinct points of a group with their multiplicities. Ward merging is in ``ward``; KMeans follows here.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setscope.functions.columns import join_same
from setscope.operators.kmeans import kmeans_clusters
from setscope.operators.ward import ward_clusters

# Cut heights of the two charts, the least rows of a clustered axis, and the KMeans settings.
PAIR_HEIGHT = 1.0
AXIS_HEIGHT = 30.0
AXIS_MIN_ROWS = 10
KMEANS_K = 40
KMEANS_SEED = 44
#: Sines and cosines become whole numbers of this fineness, so sums of clusters are exact.
UNITS = 1_000_000_000
FEATURES = ["sin1", "cos1", "sin2", "cos2"]


def angle(pos: Column, n: Column) -> Column:
    return pos / n * F.lit(2 * np.pi)


def pair_features(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """``(tag, a, b, pos1, pos2, sin1, cos1, sin2, cos2, value)``: pairs turned so that the lower sine comes first.

    Sines are compared to 12 digits, equal ones by position. ``order`` is ``(node, pos)``; its size is one number.
    """
    n = F.lit(order.count())
    first = order.select(F.col("node").alias("l0"), F.col("pos").alias("p0"))
    second = order.select(F.col("node").alias("l1"), F.col("pos").alias("p1"))
    rows = pairs.select("tag", F.col("labels")[0].alias("l0"), F.col("labels")[1].alias("l1"), "value")
    rows = rows.join(first, "l0").join(second, "l1")

    def key(pos: str, label: str) -> Column:
        return F.struct(F.round(F.sin(angle(F.col(pos), n)), 12).alias("k"), F.col(pos).alias("pos"), F.col(label).alias("label"))

    turned = F.sort_array(F.array(key("p0", "l0"), key("p1", "l1")))
    rows = rows.select("tag", "value", turned.alias("e"))
    ends = {1: F.col("e")[0], 2: F.col("e")[1]}
    return rows.select(
        "tag",
        ends[1]["label"].alias("a"),
        ends[2]["label"].alias("b"),
        ends[1]["pos"].alias("pos1"),
        ends[2]["pos"].alias("pos2"),
        *[f(angle(ends[i]["pos"], n)).alias(f"{name}{i}") for i in (1, 2) for name, f in (("sin", F.sin), ("cos", F.cos))],
        "value",
    )


def _units(features: Sequence[str]) -> list[Column]:
    """Features as whole numbers of 1 / UNITS."""
    return [F.round(F.col(f) * UNITS).cast("bigint").alias(f"unit_{f}") for f in features]


def pair_points(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, pos1, pos2, unit features, w)``: the distinct points with the number of their rows."""
    units = _units(FEATURES)
    names = [f"unit_{f}" for f in FEATURES]
    rows = features.select(*keys, "pos1", "pos2", *units)
    return rows.groupBy(*keys, "pos1", "pos2").agg(*[F.min(c).alias(c) for c in names], F.count(F.lit(1)).alias("w"))


def cluster_pairs(features: DataFrame, *, group_cols: Sequence[str] = (), height: float = PAIR_HEIGHT) -> DataFrame:
    """Pair features with their Ward cluster; one clustering over all rows, or one per group."""
    keys = list(group_cols)
    points = pair_points(features, keys)
    coords = [f"unit_{f}" for f in FEATURES]
    found = ward_clusters(points, keys=keys, names=["pos1", "pos2"], coords=coords, height=height * UNITS)
    return join_same(features, found, [*keys, "pos1", "pos2"])


def cluster_pairs_kmeans(features: DataFrame, *, k: int = KMEANS_K, seed: int = KMEANS_SEED) -> DataFrame:
    """Pair features with their KMeans cluster, fitted to distinct points weighted by their rows."""
    points = pair_points(features, [])
    found = kmeans_clusters(points, names=["pos1", "pos2"], coords=[f"unit_{f}" for f in FEATURES], k=k, seed=seed)
    return join_same(features, found, ["pos1", "pos2"])


def axis_segments(sets: DataFrame) -> DataFrame:
    """``(tag, labels, value, axis, src, tgt)``: each pair of neighbouring positions of an ordered set, with its axis."""
    last = F.size("positions") - 1
    at = F.col("positions")
    steps = F.transform(
        F.sequence(F.lit(0), last - 1),
        lambda i: F.struct(i.alias("axis"), F.get(at, i).alias("src"), F.get(at, i + F.lit(1)).alias("tgt")),
    )
    return sets.filter(last > 0).select("tag", "labels", "value", F.explode(steps).alias("s")).select(
        "tag", "labels", "value", "s.axis", "s.src", "s.tgt"
    )


def cluster_axis(
    segments: DataFrame,
    *,
    group_cols: Sequence[str] = (),
    height: float = AXIS_HEIGHT,
    min_rows: int = AXIS_MIN_ROWS,
) -> DataFrame:
    """Segments with the Ward cluster of their axis; on an axis with ``min_rows`` segments or fewer the cluster is NULL."""
    keys = [*group_cols, "axis"]
    crowded = segments.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > min_rows).drop("rows")
    kept = join_same(segments, crowded, keys, "left_semi")
    points = kept.groupBy(*keys, "src", "tgt").agg(F.count(F.lit(1)).alias("w"))
    found = ward_clusters(points, keys=keys, names=["src", "tgt"], coords=["src", "tgt"], height=height)
    return join_same(segments, found, [*keys, "src", "tgt"], "left")


def set_clusters(segments: DataFrame, set_cols: Sequence[str] = ("tag", "labels", "value")) -> DataFrame:
    """``(set columns, km_label)``: for each set the clusters of its segments by axis, NULL on sparse axes; equal sets stay one row."""
    steps = F.sort_array(F.collect_list(F.struct("axis", "cluster")))
    return segments.select(*set_cols, "axis", "cluster").distinct().groupBy(*set_cols).agg(steps.getField("cluster").alias("km_label"))
