"""Exact counts of points in prefix ranges, without comparing pairs.

To know how much weight lies at coordinates below ``(x, y)`` each point is added to the binary blocks that contain it,
one block per bit, and each query reads the blocks that tile its prefix, one per set bit of the bound. With coordinates below
``2**bits`` a point or a query becomes at most ``bits**dims`` rows; everything else is a hash aggregate and an equi-join, so no
group of points ever meets in one task. Blocks are summed before the shuffle, hence a hot block is one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setscope.functions.columns import join_same


def _block_ids(blocks: list[Column], bits: int) -> Column:
    """Even-numbered blocks, one per level, as numbers unique over all levels; NULL elsewhere."""
    ids = [F.when(b % 2 == 0, b.cast("bigint") + F.lit(1 << (bits - level))) for level, b in enumerate(blocks)]
    return F.array(*ids)


def _point_blocks(coordinate: str, bits: int) -> Column:
    # A prefix is tiled by even-numbered blocks only, so a point needs no odd-numbered block.
    return _block_ids([F.shiftright(F.col(coordinate), level) for level in range(bits)], bits)


def _query_blocks(bound: str, bits: int) -> Column:
    # Where a bit of the bound is set, the block left of the bound at that level; it is odd, hence NULL, where the bit is not set.
    return _block_ids([F.shiftright(F.col(bound), level) - 1 for level in range(bits)], bits)


def _spread(rows: DataFrame, blocks: Column, name: str) -> DataFrame:
    return rows.withColumn(name, F.explode(blocks)).filter(F.col(name).isNotNull())


def covered_weight(
    points: DataFrame,
    probes: DataFrame,
    *,
    group_cols: Sequence[str],
    coords: Sequence[str],
    bounds: Sequence[str],
    weight: str,
    bits: int,
) -> DataFrame:
    """The probe rows, each repeated once per block it reads, with that block's weight in ``covered``.

    Summing ``covered`` over the rows of a probe gives the weight of the points of its group with ``coord < bound`` in every
    dimension; signs and sums over several probes can be applied in the caller's own aggregate. A probe that covers nothing has no
    rows. Coordinates and bounds are whole numbers in ``[0, 2**bits)``.
    """
    group_cols = list(group_cols)
    cells = points.select(*group_cols, *coords, weight)
    for d, (coord, bound) in enumerate(zip(coords, bounds)):
        cells = _spread(cells, _point_blocks(coord, bits), f"_b{d}")
        probes = _spread(probes, _query_blocks(bound, bits), f"_b{d}")
    blocks = [f"_b{d}" for d in range(len(coords))]
    cells = cells.groupBy(*group_cols, *blocks).agg(F.sum(weight).alias("covered"))
    return join_same(probes, cells, group_cols + blocks).drop(*blocks)


def weight_below(
    points: DataFrame, probes: DataFrame, *, group_cols: Sequence[str], out: str, **how
) -> DataFrame:
    """``probes`` with the covered weight in ``out``, zero where nothing is covered. The probe rows must be distinct."""
    keys = probes.columns
    sums = covered_weight(points, probes, group_cols=group_cols, **how).groupBy(*keys).agg(F.sum("covered").alias(out))
    return join_same(probes, sums, keys, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0).cast("bigint")))
