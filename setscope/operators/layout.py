"""Numbers behind the charts: node positions, links, control points and link styles.

Node tables are label domains; per-graph counts and maxima are aggregates joined back on their keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setscope.functions.columns import join_same, string_array
from setscope.functions.tables import materialise

# Pull of hierarchical control points, centroid shift, search range of the shift, chart margins, link width scale,
# hue domain and arc overhang.
HIER_FACTOR = 1.4
SHIFT = 0.2
SHIFT_MAX = 0.5
#: Rounds of the ratio search and sections in each; parts of a curve, and points of each at which its speed is taken.
SECTION_ROUNDS, SECTIONS, CURVE_PARTS, CURVE_NODES = 3, 25, 8, 8
MARGIN_TOP = MARGIN_BOTTOM = 20
MARGIN_LEFT = 60
MARGIN_RIGHT = 10
WIDTH_EXPONENT = 1.5
WIDTH_SCALE = {"frequent": 50, "hui": 150}
HUE_MAX = 0.2
ARC_OVERHANG = 0.03


def _radial(pos: Column, n: Column) -> Column:
    return pos * F.lit(2 * math.pi) / n


def radial_layout(order: DataFrame, radius: float) -> DataFrame:
    """``(node, pos, angle, x, y)`` on a circle, clockwise from the top."""
    angle = _radial(F.col("pos"), F.lit(order.count()))
    return order.select(
        "node",
        "pos",
        angle.alias("angle"),
        (F.lit(float(radius)) * F.sin(angle)).alias("x"),
        (F.lit(float(radius)) * F.cos(angle)).alias("y"),
    )


def _ends(pairs: DataFrame, layout: DataFrame, *columns: str) -> DataFrame:
    """Pairs ``(a, b, ...)`` with the layout columns of both ends as ``<column>1`` and ``<column>2``."""
    for end, suffix in (("a", "1"), ("b", "2")):
        side = layout.select(F.col("node").alias(end), *[F.col(c).alias(c + suffix) for c in columns])
        pairs = pairs.join(side, end)
    return pairs


def radial_links(pairs: DataFrame, layout: DataFrame) -> DataFrame:
    """``(tag, a, b, value, x1, y1, x2, y2)``."""
    return _ends(pairs, layout, "x", "y").select("tag", "a", "b", "value", "x1", "y1", "x2", "y2")


def root_mean_angle(layout: DataFrame, root: Column, radius: float) -> DataFrame:
    """``(root, angle, x, y)``: circular mean of the angles of a root's nodes."""
    mean = layout.groupBy(root.alias("root")).agg(
        F.atan2(F.avg(F.sin("angle")), F.avg(F.cos("angle"))).alias("angle")
    )
    return mean.withColumn("x", F.lit(float(radius)) * F.sin("angle")).withColumn("y", F.lit(float(radius)) * F.cos("angle"))


def hier_links(pairs: DataFrame, layout: DataFrame, root: Column, radius: float) -> DataFrame:
    """Links over the control points of both roots: ``(tag, a, b, value, x1, y1, cx1, cy1, cx2, cy2, x2, y2)``."""
    roots = root_mean_angle(layout, root, radius).select(
        "root", (F.col("x") / HIER_FACTOR).alias("cx"), (F.col("y") / HIER_FACTOR).alias("cy")
    )
    nodes = layout.withColumn("root", root).join(roots, "root")
    return _ends(pairs, nodes, "x", "y", "cx", "cy").select(
        "tag", "a", "b", "value", "x1", "y1", "cx1", "cy1", "cx2", "cy2", "x2", "y2"
    )


def cluster_centroids(clustered: DataFrame, layout: DataFrame, *, group_cols: Sequence[str] = ()) -> DataFrame:
    """``(cluster, lx, ly, rx, ry, links)``: mean position of the left and of the right ends."""
    placed = _ends(clustered, layout, "x", "y")
    return placed.groupBy(*group_cols, "cluster").agg(
        F.avg("x1").alias("lx"),
        F.avg("y1").alias("ly"),
        F.avg("x2").alias("rx"),
        F.avg("y2").alias("ry"),
        F.count(F.lit(1)).alias("links"),
    )


def _toward(a: str, b: str, ratio: Column) -> Column:
    return F.col(a) + ratio * (F.col(b) - F.col(a))


def bundle_control_points(centroids: DataFrame, *, left: Column | None = None, right: Column | None = None) -> DataFrame:
    """Both centroids moved toward each other by a ratio: ``(..., clx, cly, crx, cry)``."""
    left = F.lit(SHIFT) if left is None else left
    right = F.lit(SHIFT) if right is None else right
    return (
        centroids.withColumn("clx", _toward("lx", "rx", left))
        .withColumn("cly", _toward("ly", "ry", left))
        .withColumn("crx", _toward("rx", "lx", right))
        .withColumn("cry", _toward("ry", "ly", right))
    )


def gauss_nodes() -> list[tuple[float, float]]:
    """Places and weights of Gauss-Legendre quadrature on equal parts of [0, 1]."""
    at, weight = np.polynomial.legendre.leggauss(CURVE_NODES)
    return [(float((i + (t + 1) / 2) / CURVE_PARTS), float(w / 2 / CURVE_PARTS)) for i in range(CURVE_PARTS) for t, w in zip(at, weight)]


def _length(x1, y1, x2, y2) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def curve_length(end: tuple, near: tuple, far: tuple) -> Column:
    """Length of the curve from ``end`` to the control point ``near``, which goes on to ``far``: a uniform Catmull-Rom piece, by
    quadrature of the speed of its cubic."""
    nodes = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in gauss_nodes()])

    def speed(t: Column, i: int) -> Column:
        a, b = near[i] - end[i], far[i] - end[i]
        rest = F.lit(1.0) - t
        return rest * rest * a * 0.5 + t * rest * (a * 5.0 - b) + t * t * b * 0.5

    def piece(so_far: Column, node: Column) -> Column:
        x, y = speed(node["t"], 0), speed(node["t"], 1)
        return so_far + node["w"] * F.sqrt(x * x + y * y)

    return F.aggregate(nodes, F.lit(0.0), piece)


def bundle_ratio_search(clustered: DataFrame, layout: DataFrame) -> DataFrame:
    """``(cluster, r_left, r_right)``: ratios in [0, 0.5] with the shortest lines, left side first, then right with left fixed.

    The length of a cluster is that of the curves from every link end to its control point plus the distance of the two points. Links
    with equal ends are merged. Each round measures all clusters at the same number of ratios and keeps the two sections around the
    shortest, so brackets shrink together, and the vertex of the parabola through the last three gives the ratio, to six digits and
    more. As with any bracketing search, length is taken to fall and then rise. Lengths are summed to twelve digits as decimals, so the
    result does not depend on partitions; of equal sums the smallest ratio is taken.
    """
    centroids = cluster_centroids(clustered, layout).drop("links")
    links = clustered.groupBy("cluster", "a", "b").agg(F.count(F.lit(1)).alias("w"))
    placed = materialise(_ends(links, layout, "x", "y").join(centroids, "cluster"), "bundle-links")

    def exact(length: Column) -> Column:
        return F.round(length, 12).cast("decimal(28, 12)")

    def search(rows: DataFrame, out: str) -> DataFrame:
        bracket = rows.select("cluster").distinct().select("cluster", F.lit(0.0).alias("low"), F.lit(SHIFT_MAX).alias("high"))
        for turn in range(SECTION_ROUNDS):
            steps = F.explode(F.sequence(F.lit(0), F.lit(SECTIONS))).alias("i")
            tried = bracket.select("*", steps).withColumn("r", F.col("low") + (F.col("high") - F.col("low")) * F.col("i") / SECTIONS)
            tried = rows.join(tried, "cluster")
            moving = "l" if out == "r_left" else "r"
            still = "r" if out == "r_left" else "m"
            point = tuple(_toward(f"{moving}{c}", f"{'r' if moving == 'l' else 'l'}{c}", F.col("r")) for c in "xy")
            fixed = (F.col(f"{still}x"), F.col(f"{still}y"))
            left, right = (point, fixed) if moving == "l" else (fixed, point)
            curves = exact(curve_length((F.col("x1"), F.col("y1")), left, right)) + exact(curve_length((F.col("x2"), F.col("y2")), right, left))
            sums = tried.groupBy("cluster", "low", "high", "i", "r").agg(
                F.sum(F.col("w").cast("decimal(10, 0)") * curves).alias("spread"), F.first(exact(_length(*left, *right))).alias("middle")
            )
            sums = sums.withColumn("total", F.col("spread") + F.col("middle"))
            shortest = F.min(F.struct("total", "i", "r")).alias("best")
            three = F.sort_array(F.collect_list(F.struct("i", "r", F.col("total").cast("double").alias("total")))).alias("all")
            found = sums.groupBy("cluster", "low", "high").agg(shortest, three)
            at = lambda k: F.get("all", F.col("best.i") + k)
            bracket = found.select(
                "cluster",
                F.coalesce(at(-1)["r"], "low").alias("low"),
                F.coalesce(at(1)["r"], "high").alias("high"),
                F.col("best.r").alias("r"),
                at(-1)["total"].alias("before"),
                at(0)["total"].alias("here"),
                at(1)["total"].alias("behind"),
            )
            bracket = materialise(bracket, f"bundle-{out}-{turn}")
        bend = F.col("before") - F.col("here") * 2.0 + F.col("behind")
        vertex = F.col("r") + (F.col("high") - F.col("low")) * 0.25 * (F.col("before") - F.col("behind")) / bend
        return bracket.select("cluster", F.when(bend > 0, vertex).otherwise(F.col("r")).alias(out))

    left = materialise(search(placed, "r_left"), "bundle-left")
    moved = placed.join(left, "cluster").withColumns({f"m{c}": _toward(f"l{c}", f"r{c}", F.col("r_left")) for c in "xy"})
    return left.join(search(moved, "r_right"), "cluster")


def bundle_links(clustered: DataFrame, layout: DataFrame, control_points: DataFrame) -> DataFrame:
    """``(tag, a, b, value, cluster, x1, y1, clx, cly, crx, cry, x2, y2)``."""
    points = control_points.select("cluster", "clx", "cly", "crx", "cry")
    return _ends(clustered, layout, "x", "y").join(points, "cluster").select(
        "tag", "a", "b", "value", "cluster", "x1", "y1", "clx", "cly", "crx", "cry", "x2", "y2"
    )


def _axis_x(axis: Column, axes: Column, width: float) -> Column:
    return F.lit(float(MARGIN_LEFT)) + axis * F.lit(float(width - MARGIN_LEFT - MARGIN_RIGHT)) / (axes - 1)


def _node_y(pos: Column, nodes: Column, height: float) -> Column:
    return F.lit(float(MARGIN_TOP)) + pos * F.lit(float(height - MARGIN_TOP - MARGIN_BOTTOM)) / (nodes - 1)


def axis_count(sets: DataFrame) -> int:
    """Length of the longest set."""
    return sets.agg(F.max(F.size("labels"))).first()[0] or 0


def parallel_layout(order: DataFrame, axes: int, *, width: float, height: float) -> DataFrame:
    """``(axis, node, pos, x, y)``: every node on every axis."""
    nodes = F.lit(order.count())
    rows = order.select("node", "pos", F.explode(F.sequence(F.lit(0), F.lit(axes - 1))).alias("axis"))
    return rows.select(
        "axis",
        "node",
        "pos",
        _axis_x(F.col("axis"), F.lit(axes), width).alias("x"),
        _node_y(F.col("pos"), nodes, height).alias("y"),
    )


def parallel_control_points(
    clustered: DataFrame, nodes: int, axes: int, *, width: float, height: float, ratio: float = SHIFT
) -> DataFrame:
    """``(axis, cluster, lx, ly, rx, ry)``: mean ends of each bundle, each moved toward the other's old place."""
    means = clustered.groupBy("axis", "cluster").agg(
        F.avg(_node_y(F.col("src"), F.lit(nodes), height)).alias("y0"),
        F.avg(_node_y(F.col("tgt"), F.lit(nodes), height)).alias("y1"),
    )
    x0 = _axis_x(F.col("axis"), F.lit(axes), width)
    x1 = _axis_x(F.col("axis") + 1, F.lit(axes), width)
    r = F.lit(ratio)
    return means.select(
        "axis",
        "cluster",
        (x0 - r * (x0 - x1)).alias("lx"),
        (F.col("y0") - r * (F.col("y0") - F.col("y1"))).alias("ly"),
        (x1 - r * (x1 - x0)).alias("rx"),
        (F.col("y1") - r * (F.col("y1") - F.col("y0"))).alias("ry"),
    )


def link_style(
    sets: DataFrame, order: DataFrame, tags: Sequence[str], *, fi_type: str = "frequent", focus: float = 1.0
) -> DataFrame:
    """``(tag, labels, value, width, opacity, hue, tag_index, path_start)`` of ordered sets.

    Opacity is relative to the largest value of the tag; ``path_start`` is the place of the first label along the order, from 0 to 1.
    """
    top = sets.groupBy("tag").agg(F.max("value").alias("top"))
    nodes = order.count()
    rows = join_same(sets, top, ["tag"])
    return rows.select(
        "tag",
        "labels",
        "value",
        (F.pow("value", F.lit(WIDTH_EXPONENT)) * F.lit(float(WIDTH_SCALE[fi_type]))).alias("width"),
        F.pow(F.col("value") / F.col("top"), F.lit(float(focus))).alias("opacity"),
        (F.col("value") / F.lit(HUE_MAX)).alias("hue"),
        (F.array_position(string_array(tags), F.col("tag")).cast("int") - 1).alias("tag_index"),
        (F.get("positions", F.lit(0)) / F.lit(float(nodes - 1))).alias("path_start"),
    )


def root_runs(order: DataFrame, root: Column) -> DataFrame:
    """``(root, first, last, start_angle, end_angle)``: runs of one root along the order, with the arc they span.

    The windows cover the label domain.
    """
    n = F.lit(order.count())
    along = Window.partitionBy(F.lit(0)).orderBy("pos")
    rows = order.withColumn("root", root)
    changed = (F.col("root") != F.lag("root").over(along)).cast("int")
    rows = rows.withColumn("run", F.sum(F.coalesce(changed, F.lit(0))).over(along))
    runs = rows.groupBy("root", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return runs.select(
        "root",
        "first",
        "last",
        (_radial(F.col("first"), n) - F.lit(ARC_OVERHANG)).alias("start_angle"),
        (_radial(F.col("last"), n) + F.lit(ARC_OVERHANG)).alias("end_angle"),
    )
