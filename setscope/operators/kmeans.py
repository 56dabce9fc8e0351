"""KMeans on weighted points whose result does not depend on how rows are partitioned.

Starts come from rounds of oversampling: a point becomes a candidate if a hash of its name and the round, as a number between 0 and 1,
is below its share of the cost so far times ``2 * k``. Candidates, a few hundred at any size of the table, are weighted by the points
nearest to them, and the starts are picked among them one by one, each with the largest weight times distance to those picked before.
Lloyd steps follow until nothing moves. Coordinates, costs and weights are whole numbers and their sums exact, so every step gives the
same numbers in any order; what reaches the driver is candidates and sums of ``k`` centres.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setscope.functions.tables import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OVERSAMPLING, SAMPLE_ROUNDS, STEPS = 2, 3, 20
#: Costs are squares of distances in units of this many square units of the coordinates.
COST_UNIT = 1e9
HASHES = 1 << 32


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squares of all distances; summed dimension by dimension, so they are the same wherever they are computed."""
    out = np.zeros((len(points), len(centres)))
    for i in range(points.shape[1]):
        out += (points[:, i, None] - centres[None, :, i]) ** 2
    return out


def nearest(coords: Sequence[str], centres: np.ndarray) -> Column:
    """``struct(at, cost)``: the nearest centre, ties to the first, and the cost of a point."""

    @F.pandas_udf("at int, cost bigint")
    def find(*columns: pd.Series) -> pd.DataFrame:
        apart = squares(np.stack([c.to_numpy(float) for c in columns], axis=1), centres)
        at = apart.argmin(1)
        return pd.DataFrame({"at": at.astype("int32"), "cost": np.floor(apart[np.arange(len(at)), at] / COST_UNIT).astype("int64")})

    return find(*[F.col(c) for c in coords])


def _hash(names: Sequence[str], seed: int, turn: int) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(turn)), *[F.col(c).cast("string") for c in names]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _array(rows: list, columns: Sequence[str]) -> np.ndarray:
    return np.array([[r[c] for c in columns] for r in rows], dtype=float).reshape(-1, len(columns))


def starts(points: DataFrame, names: Sequence[str], coords: Sequence[str], k: int, seed: int) -> np.ndarray:
    """At most ``k`` points, fewer if no more are distinct."""
    order = [*names]
    picked = points.orderBy(_hash(names, seed, 0), *order).limit(1).select(*names, *coords).collect()
    for turn in range(1, SAMPLE_ROUNDS + 1):
        if not picked:
            break
        costed = points.withColumn("cost", nearest(coords, _array(picked, coords))["cost"])
        total = costed.agg(F.sum(F.col("w").cast("decimal(19, 0)") * F.col("cost"))).first()[0] or 0
        big = lambda c: c.cast("decimal(38, 0)")
        chance = F.lit(OVERSAMPLING * k * HASHES).cast("decimal(16, 0)") * (F.col("w") * F.col("cost")).cast("decimal(19, 0)")
        sampled = costed.filter(big(_hash(names, seed, turn).cast("decimal(10, 0)") * F.lit(int(total)).cast("decimal(27, 0)")) < big(chance))
        picked = sorted(picked + sampled.select(*names, *coords).collect(), key=lambda r: tuple(r[c] for c in names))
    if not picked:
        return np.zeros((0, len(coords)))
    candidates = _array(picked, coords)
    won = points.select(nearest(coords, candidates)["at"].alias("at"), "w").groupBy("at").agg(F.sum("w").alias("w")).collect()
    weight = np.zeros(len(candidates))
    for r in won:
        weight[r["at"]] = r["w"]
    chosen = [int(weight.argmax())]
    while len(chosen) < k:
        gain = weight * np.floor(squares(candidates, candidates[chosen]).min(1) / COST_UNIT)
        if not gain.max() > 0:
            break
        chosen.append(int(gain.argmax()))
    return candidates[chosen]


def kmeans_clusters(points: DataFrame, *, names: Sequence[str], coords: Sequence[str], k: int, seed: int, steps: int = STEPS) -> DataFrame:
    """``(names, cluster)`` of distinct points with whole coordinates and weight ``w``; no points give no rows."""
    points = materialise(points.select(*names, *coords, "w"), "kmeans-points")
    centres = starts(points, names, coords, k, seed)
    for _ in range(steps):
        if not len(centres):
            break
        at = nearest(coords, centres)["at"].alias("at")
        totals = [F.sum(F.col("w") * F.col(c)).alias(c) for c in coords]
        moved = centres.copy()
        for r in points.select(at, *coords, "w").groupBy("at").agg(F.sum("w").alias("w"), *totals).collect():
            moved[r["at"]] = [r[c] / r["w"] for c in coords]
        if (moved == centres).all():
            break
        centres = moved
    if not len(centres):
        return points.select(*names, F.lit(0).alias("cluster")).limit(0)
    return points.select(*names, nearest(coords, centres)["at"].alias("cluster"))
