"""Readers for tracks and metadata, and the ingest of response pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from setscope.functions.range_counts import weight_below

TRACKS = (
    "_id bigint, confidence double, items map<string,double>, seq array<struct<label:string>>"
)
METADATA = (
    "_id string, name string, artist_name string, image string, audio string, "
    "musicinfo struct<tags:struct<genres:array<string>,vartags:array<string>>>"
)
PAGES = (
    "results array<struct<id:string,name:string,artist_name:string,image:string,audio:string,"
    "musicinfo:struct<tags:struct<genres:array<string>,vartags:array<string>>>>>"
)


def load_tracks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Tracks from any Spark source; a schema is always given, so nothing is inferred."""
    return spark.read.schema(TRACKS).format(fmt).load(path)


def load_metadata(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(METADATA).format(fmt).load(path)


def load_pages(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Response pages stored as JSON documents, one in a file or, without ``multi_line``, one in a line. ``page`` is the document's own
    field, or the name of its file."""
    pages = spark.read.schema(f"page string, {PAGES}").option("multiLine", multi_line).json(path)
    return pages.withColumn("page", F.coalesce("page", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)))


def ingest_meta(pages: DataFrame) -> DataFrame:
    """One metadata row per result of a page, ``id`` renamed to ``_id``; columns beside ``results`` stay."""
    beside = [c for c in pages.columns if c != "results"]
    return pages.select(*beside, F.explode("results").alias("r")).select(*beside, "r.*").withColumnRenamed("id", "_id")


def ingest_pages(pages: DataFrame, path: str) -> DataFrame:
    """Append the results of pages that the table at ``path`` does not hold yet, and read the table.

    Every row carries its page, so the table itself says which pages are in; that column alone is read for it. One task writes all rows
    of a page into one file, so a page is in as a whole or not at all, even if a run broke off; sent again, it adds nothing. A page that
    is twice among ``pages`` goes in once; pages without a name are refused.
    """
    spark = pages.sparkSession
    named = F.assert_true(F.col("page").isNotNull(), F.lit("a page without a name cannot be ingested twice safely")).isNull()
    rows = pages.filter(named).dropDuplicates(["page"])
    if _exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select("page").distinct(), "page", "left_anti")
    ingest_meta(rows).select(*[F.col(c) for c in _names(METADATA)], "page").write.mode("append").parquet(path)
    return load_ingested(spark, path)


def _names(schema: str) -> list[str]:
    return [f.name for f in StructType.fromDDL(schema)]


def load_ingested(spark: SparkSession, path: str) -> DataFrame:
    """All ingested metadata rows with their ``page``."""
    return spark.read.schema(f"{METADATA}, page string").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def id_batches(ids: DataFrame, *, id_col: str = "_id", size: int = 50, span: int = 1 << 16) -> DataFrame:
    """``(batch, n_ids, ids)``: ids in rising order, ``size`` per batch, space-joined, the rest in a last batch.

    The global index of an id is its rank inside a range of ``span`` consecutive numbers, which therefore holds at most ``span``
    ids, plus the number of ids in earlier ranges. No window covers the whole table.
    """
    ids = ids.select(F.col(id_col).alias("_id")).distinct()
    low, high = ids.agg(F.min("_id"), F.max("_id")).first()
    if low is None:
        low = high = 0
    ids = ids.withColumn("part", F.expr(f"(_id - {low}) div {span}"))
    parts = ids.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = weight_below(
        parts,
        parts.select("part"),
        group_cols=[],
        coords=["part"],
        bounds=["part"],
        weight="n",
        bits=((high - low) // span + 1).bit_length(),
        out="before",
    )
    rank = F.row_number().over(Window.partitionBy("part").orderBy("_id"))
    indexed = ids.withColumn("rank", rank).join(before, "part").withColumn("ix", F.col("before") + F.col("rank") - 1)
    return (
        indexed.groupBy(F.expr(f"ix div {size}").alias("batch"))
        .agg(F.count(F.lit(1)).alias("n_ids"), F.sort_array(F.collect_list("_id")).alias("ids"))
        .withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), " "))
    )
