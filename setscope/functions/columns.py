"""Column expressions and join helpers used across operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL equals NULL (a NULL tag stands for the whole collection)."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def item_text(items: Column) -> Column:
    """An itemset as text, e.g. ``a,b,c``."""
    return F.array_join(items, ",")


def string_array(values: Sequence[str]) -> Column:
    """A literal ``array<string>``; also for no values."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def in_row_pairs(items: Column) -> Column:
    """All pairs ``(a, b)``, a before b, of one array as an array of structs."""
    return F.flatten(
        F.transform(
            items,
            lambda a, i: F.transform(
                F.slice(items, i + F.lit(2), F.size(items)),
                lambda b: F.struct(a.alias("a"), b.alias("b")),
            ),
        )
    )


def subsets(items: Column, max_len: int | None = None) -> Column:
    """All subsets of an array, the empty one included, up to ``max_len`` elements."""
    def widen(found: Column, item: Column) -> Column:
        short = found if max_len is None else F.filter(found, lambda s: F.size(s) < max_len)
        return F.concat(found, F.transform(short, lambda s: F.concat(s, F.array(item))))

    return F.aggregate(items, F.array(F.array().cast("array<string>")), widen)
