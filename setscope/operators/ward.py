"""Ward clusters of weighted points, by merging mutual nearest neighbours in blocks of space.

Two clusters that are each other's nearest neighbours are merged by any order of merging (Ward's distance never falls when others merge),
so all such pairs are merged at once, round after round, until none is nearer than the cut height. Space is cut into cells, each a task of
its own. Inside a cell a pair may merge if no cluster of another cell can be nearer: the distance to the cell's border, at the least
weight a cluster outside may have, bounds that from below, and later merges outside cannot break the bound. A cluster without a
neighbour below the height, inside or by that bound outside, never merges again and leaves the work. What remains goes on in larger
cells, then in cells shifted by half a side, and in the end in one cell that holds all that is left.

Cells are chosen by counting: the largest ones that hold ``CELL_POINTS`` clusters at most, so a small group is one cell from the start.
Where clusters crowd at every size the last cell is larger; the result is the same and memory stays linear.

Coordinates are whole numbers, hence sums of clusters are exact and results do not depend on partitions. Equal distances go to the
cluster with the smaller first point; points are named by their own key columns.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setscope.functions.columns import join_same
from setscope.functions.tables import materialise, spread_groups

# Kernels travel to the workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELL_POINTS = 2_000
#: Halvings of the space at most, and entries of a distance table computed at once.
MOST_HALVINGS, TABLE = 20, 4_000_000


def nearest(centre: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per cluster, its nearest neighbour and the square of Ward's distance; ties to the first."""
    n = len(size)
    near, square = np.zeros(n, dtype=np.int64), np.full(n, np.inf)
    step = max(1, TABLE // max(n, 1))
    for a in range(0, n, step):
        rows = slice(a, min(a + step, n))
        apart = np.zeros((rows.stop - a, n))
        for c in centre.T:
            apart += (c[rows, None] - c[None, :]) ** 2
        apart *= 2.0 * size[rows, None] * size[None, :] / (size[rows, None] + size[None, :])
        apart[np.arange(rows.stop - a), np.arange(a, rows.stop)] = np.inf
        near[rows] = apart.argmin(1)
        square[rows] = apart[np.arange(rows.stop - a), near[rows]]
    return near, square


def merge_in_cell(
    sums: np.ndarray, size: np.ndarray, height: float, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(cluster of each row, sums, sizes, done)``: merges inside the borders ``low`` and ``high``, rows named by the first of theirs.

    ``sums`` and ``size`` hold whole numbers; a cluster is done if nothing below the height can be near it.
    """
    n = len(size)
    of, rows = np.arange(n), np.arange(n)
    while True:
        centre = sums / size[:, None]
        near, square = nearest(centre, size.astype(float))
        border = np.maximum(np.minimum(centre - low, high - centre).min(1), 0.0)
        # The least square of a distance to anything outside, whose weight is one at least.
        outside = np.where(np.isinf(border), np.inf, 2.0 * size / (size + 1.0) * np.where(np.isinf(border), 0.0, border) ** 2)
        least = np.minimum(square, outside)
        kept = np.arange(len(size))
        sure = (square < height**2) & (square < outside) & (near[near] == kept)
        sure &= sure[near]
        into = np.where(sure, np.minimum(kept, near), kept)
        if not sure.any():
            return rows[of], sums[of], size[of], (least >= height**2)[of]
        first = into == kept
        place = np.cumsum(first) - 1
        merged, weight = np.zeros((first.sum(), sums.shape[1]), dtype=sums.dtype), np.zeros(first.sum(), dtype=size.dtype)
        np.add.at(merged, place[into], sums)
        np.add.at(weight, place[into], size)
        of, rows, sums, size = place[into][of], rows[first], merged, weight


def ward_clusters(
    points: DataFrame,
    *,
    keys: Sequence[str],
    names: Sequence[str],
    coords: Sequence[str],
    height: float,
    weight: str = "w",
    cell_points: int = CELL_POINTS,
) -> DataFrame:
    """``(keys, names, cluster)`` of distinct points: merged while Ward's distance is below ``height``, in units of the coordinates.

    ``keys`` are groups that are clustered apart; in each, clusters are numbered by their first point in the order of ``names``.
    Coordinates and weights are whole. No points give no rows.
    """
    keys, names, d = list(keys), list(names), len(coords)
    cells, totals, firsts = [f"cell_{i}" for i in range(d)], [f"sum_{i}" for i in range(d)], [f"first_{c}" for c in names]
    state = points.select(*keys, *names, F.col(weight).cast("bigint").alias("n"), *[(F.col(c) * F.col(weight)).cast("bigint").alias(s) for c, s in zip(coords, totals)])
    state = materialise(state, "ward-points")
    bounds = points.agg(*[f(c).cast("double").alias(f"{m}{i}") for i, c in enumerate(coords) for m, f in (("low", F.min), ("high", F.max))]).first()
    low = [bounds[f"low{i}"] or 0.0 for i in range(d)]
    side = max([bounds[f"high{i}"] - low[i] for i in range(d) if bounds[f"high{i}"] is not None] or [0.0]) + 1.0

    def cell(i: int, halvings: int, shift: float) -> Column:
        if not halvings:
            return F.lit(0).cast("bigint").alias(cells[i])
        wide = side / 2**halvings
        return F.floor((F.col(totals[i]) / F.col("n") - F.lit(low[i]) + F.lit(shift * wide)) / F.lit(wide)).cast("bigint").alias(cells[i])

    def halvings_for(rows: DataFrame, most: int) -> int:
        for halvings in range(most):
            count = rows.groupBy(*keys, *[cell(i, halvings, 0.0) for i in range(d)]).count().agg(F.max("count")).first()[0]
            if (count or 0) <= cell_points:
                return halvings
        return most

    key_types = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    schema = ", ".join(
        [f"{c} {key_types[c]}" for c in keys + names] + [f"{f} {key_types[c]}" for c, f in zip(names, firsts)] + [f"{c} bigint" for c in ["n", *totals]] + ["done boolean"]
    )

    def run(halvings: int, shift: float, level: str) -> DataFrame:
        origin, wide = np.array(low), side / 2**halvings

        def one_cell(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(names).reset_index(drop=True)
            at = pdf[cells].to_numpy()[0]
            open_space = np.full(d, np.inf)
            a, z = (origin + (at + k - shift) * wide if halvings else sign * open_space for k, sign in ((0, -1), (1, 1)))
            of, sums, size, done = merge_in_cell(pdf[totals].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), height, a, z)
            out = pdf[keys + names].copy()
            for c, f in zip(names, firsts):
                out[f] = pdf[c].to_numpy()[of]
            out["n"], out["done"] = size, done
            for i, c in enumerate(totals):
                out[c] = sums[:, i]
            return out

        placed = state.select("*", *[cell(i, halvings, shift) for i in range(d)])
        grouped = spread_groups(placed, *keys, *cells).groupBy(*keys, *cells)
        return materialise(grouped.applyInPandas(one_cell, schema), f"ward-{level}")

    members: DataFrame | None = None
    halvings = halvings_for(state, MOST_HALVINGS)
    while True:
        for shift in (0.0, 0.5) if halvings else (0.0,):
            step = run(halvings, shift, f"{halvings}-{shift}")
            moved = step.select(*keys, *names, *firsts)
            members = moved if members is None else _followed(members, moved, keys, names, firsts)
            own = [F.col(c).eqNullSafe(F.col(f)) for c, f in zip(names, firsts)]
            state = step.filter("not done").drop("done")
            for same_name in own:
                state = state.filter(same_name)
            state = state.drop(*firsts)
        if not halvings or state.isEmpty():
            break
        halvings = halvings_for(state, halvings - 1)
    whole = members.select(*keys, *firsts).distinct()
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*firsts)) - 1
    return join_same(members, whole.withColumn("cluster", number), [*keys, *firsts]).select(*keys, *names, "cluster")


def _followed(members: DataFrame, moved: DataFrame, keys: list[str], names: list[str], firsts: list[str]) -> DataFrame:
    """Members with the clusters that theirs went into; others stay."""
    into = [f"into_{c}" for c in names]
    step = moved.select(*keys, *[F.col(c).alias(f) for c, f in zip(names, firsts)], *[F.col(f).alias(i) for f, i in zip(firsts, into)])
    joined = join_same(members, step, [*keys, *firsts], "left")
    out = joined.select(*keys, *names, *[F.coalesce(i, f).alias(f) for i, f in zip(into, firsts)])
    return materialise(out, "ward-members")
