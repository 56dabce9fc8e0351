"""Intermediate tables in the cluster's shared folder.

Iterative miners cut their lineage by writing each level as parquet. The folder is the one the session names in
``spark.checkpoint.dir``; a local session without that setting gets a temporary folder, any other session is refused,
because a machine-local folder would be lost together with the machine.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setscope.functions.columns import join_same

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="setscope-")
    context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/setscope/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table and return a scan of it: short lineage, safe when executors are lost, known size."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_groups(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the groups over all shuffle partitions, for grouped Python functions.

    Groups are small in bytes and heavy in time. Adaptive execution would join such partitions by size and so put many groups in one
    task; a fixed number of partitions is left alone, and the grouped function needs no second shuffle.
    """
    return df.repartition(task_slots(df.sparkSession), *keys)


def bounded_groups(df: DataFrame, keys: Sequence[str], most: int, what: str) -> DataFrame:
    """``df`` unchanged, but failing before any group of more than ``most`` rows is gathered. Counting is a partial aggregate."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    checked = join_same(df, counts, keys)
    message = F.concat(F.lit(f"{what}: more than {most} rows in one group: "), F.col("_rows").cast("string"))
    return checked.filter(F.assert_true(F.col("_rows") <= most, message).isNull()).drop("_rows")


def task_slots(spark: SparkSession) -> int:
    """How many partitions spread work over the whole cluster."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


ROWS_PER_TASK = 250_000
SMALL_TABLE = 20_000_000


def spread_rows(df: DataFrame, rows: int, emitted: float, *keys: str) -> DataFrame:
    """Spread a small table before each of its ``rows`` explodes, ``emitted`` rows in all.

    A scan is split by bytes, so a small table with a large explosion would run in one task. A large table has splits enough.
    """
    parts = min(math.ceil(emitted / ROWS_PER_TASK), task_slots(df.sparkSession))
    return df.repartition(parts, *keys) if parts > 1 and rows <= SMALL_TABLE else df


def local_table(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """A literal table that carries its size, so the optimizer broadcasts it because it is known to be small.

    A table made from a list of rows has no size; next to it the large side of a join would be shuffled on its few keys.
    """
    return spark.createDataFrame(pa.table(columns))
