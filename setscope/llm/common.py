"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts, as Java regular expressions: what separates them.
SPACE_SEPARATORS = r"[\x20\x09-\x0D]+"
MARK_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: For bytes.translate: lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
MARKS_TO_SPACES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def native_words(text: Column, separators: str) -> Column:
    """The words of a text as an array; a null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), separators)
    return F.filter(parts, lambda w: w != "")


def fields(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns only, cast; columns beside them, whatever their names, cannot clash with those of an operator."""
    return df.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])


def worker_object(key: object, build: Callable[[], object]) -> object:
    """An object that a Python worker keeps from task to task, the last one it asked for. ``key`` must name all that ``build`` depends
    on. Workers serve one operator after the other, so what an earlier one kept is given up."""
    kept = sys.modules.setdefault("setscope_worker_objects", types.ModuleType("setscope_worker_objects"))
    if getattr(kept, "key", None) != key:
        kept.key = kept.value = None
        kept.value = build()
        kept.key = key
    return kept.value


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of keys where null equals null."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out
