"""The result store: a header per run and a row per mined itemset, both partitioned by pattern type and roll-up.

A write appends a version: first the itemsets, then the headers that make it visible. A header holds the run's parameters and the size
of its collection, and is there even if nothing was found. A reader takes the newest header of each run and the itemsets of that
version, so a run that finds nothing replaces an older one. Headers are few; a request's filter on pattern type and roll-up prunes the
folders of both tables. Appending is safe against lost tasks and concurrent readers. ``compact`` rewrites the newest versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setscope.functions.columns import join_same

PARTITIONS = ["fi_type", "rollup"]
RUN = ["run_id", *PARTITIONS]
RESULTS = (
    "run_id string, tag_name string, tag string, itemset array<string>, k int, freq bigint, value double, n bigint, "
    "version bigint, fi_type string, rollup boolean"
)
HEADERS = (
    "run_id string, tag_name string, tag string, minimum double, ratio double, confidence double, n bigint, version bigint, "
    "fi_type string, rollup boolean"
)
# Field names of the stored documents.
COLUMN_DOCUMENT = (
    "struct<items:map<string,array<string>>,freq:map<string,bigint>,supportPc:map<string,double>>"
)
ROW_DOCUMENT = "array<struct<itemset:array<string>,minUtil:double>>"


def latest(rows: DataFrame, *, key: str = "run_id", version: str = "version") -> DataFrame:
    """Rows of the highest version of each key."""
    newest = rows.groupBy(key).agg(F.max(version).alias(version))
    return join_same(rows, newest, [key, version], "left_semi")


def upsert(old: DataFrame, new: DataFrame, *, key: str = "run_id") -> DataFrame:
    """``old`` with the keys of ``new`` replaced and its other keys added."""
    versions = old.withColumn("version", F.lit(0)).unionByName(new.withColumn("version", F.lit(1)))
    return latest(versions, key=key).drop("version")


def write_results(headers: DataFrame, rows: DataFrame, path: str, version: int) -> None:
    """Append a version of the runs in ``headers``; their itemsets are ``rows``."""
    for name, part in (("sets", rows), ("headers", headers)):
        out = part.withColumn("version", F.lit(version).cast("bigint"))
        out.write.mode("append").partitionBy(*PARTITIONS).parquet(f"{path}/{name}")


def _newest(spark: SparkSession, path: str) -> DataFrame:
    headers = spark.read.schema(HEADERS).parquet(f"{path}/headers")
    newest = headers.groupBy(*RUN).agg(F.max("version").alias("version"))
    return headers.join(newest, [*RUN, "version"], "left_semi")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The newest header of each run."""
    return _newest(spark, path).drop("version")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The itemsets of the newest version of each run."""
    sets = spark.read.schema(RESULTS).parquet(f"{path}/sets")
    return sets.join(_newest(spark, path).select(*RUN, "version"), [*RUN, "version"], "left_semi").drop("version")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the newest versions to another folder."""
    write_results(read_headers(spark, path), read_results(spark, path), target, 0)


def write_json(rows: DataFrame, path: str) -> None:
    """Result rows as JSON lines, partitioned."""
    rows.write.partitionBy(*PARTITIONS).json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    schema = RESULTS.replace("version bigint, ", "")
    return spark.read.schema(schema).json(path)


def decode_columnar(docs: DataFrame, column: str, *keep: str) -> DataFrame:
    """``(keep, labels, freq, value)`` of column-oriented JSON documents: maps from a position to each field."""
    doc = F.from_json(F.col(column), COLUMN_DOCUMENT)
    rows = docs.select(*keep, doc.alias("doc")).select(*keep, "doc", F.explode("doc.items").alias("ix", "labels"))
    return rows.select(
        *keep, "labels", F.col("doc.freq")[F.col("ix")].alias("freq"), F.col("doc.supportPc")[F.col("ix")].alias("value")
    )


def decode_rows(docs: DataFrame, column: str, *keep: str) -> DataFrame:
    """``(keep, labels, value)`` of row-oriented JSON documents."""
    rows = docs.select(*keep, F.explode(F.from_json(F.col(column), ROW_DOCUMENT)).alias("s"))
    return rows.select(*keep, F.col("s.itemset").alias("labels"), F.col("s.minUtil").alias("value"))


def as_json(*columns: Column | str) -> Column:
    """The given columns as one JSON text."""
    return F.to_json(F.struct(*columns))
