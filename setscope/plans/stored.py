"""The stored result table of the test collection: mined once per application, then read by the served queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setscope.functions.labels import order_frame
from setscope.functions.tables import materialise, new_path
from setscope.plans import batch
from setscope.plans.queries_utility import mined_frequent, mined_high_utility
from setscope.sources import bindings as D
from setscope.sources.results import read_headers, read_results, write_results

_PATHS: dict[tuple[str, str], str] = {}


def headers(spark: SparkSession, sf: str, fi_type: str, orders: DataFrame, sizes: DataFrame) -> DataFrame:
    """Headers of a batch over the test collection."""
    minimum = batch.MIN_SUPPORT if fi_type == "frequent" else batch.MIN_UTILITY
    return batch.run_headers(orders, None, tag_name="genres", tags=D.TAGS, fi_type=fi_type, minimum=minimum, sizes=sizes)


def tagged_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The confident orders with their wanted tags ``t``, written: all that the runs of the batch read."""
    orders = D.order_labels(spark, sf, batch.FILTER_CONFIDENCE)
    tagged = batch.wanted_tags(orders, D.metadata(spark, sf), "genres", D.TAGS)
    return materialise(tagged.drop("_id"), "tagged-orders")


def stored_path(spark: SparkSession, sf: str) -> str:
    """Folder with the runs of all tags, roll-ups and pattern types."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PATHS:
        path = new_path(spark, "results")
        orders = tagged_orders(spark, sf)
        plain = orders.select("t", F.col("plain_confidence").alias("confidence"))
        sizes = materialise(batch.tag_sizes(plain, None, tag_name="genres", tags=D.TAGS), "tag-sizes")
        write_results(headers(spark, sf, "frequent", orders, sizes), mined_frequent(spark, sf, orders), path, 0)
        write_results(headers(spark, sf, "hui", orders, sizes), mined_high_utility(spark, sf, orders, sizes), path, 0)
        _PATHS[key] = path
    return _PATHS[key]


def stored_results(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows of all tags, roll-ups and pattern types, read from the partitioned table."""
    return read_results(spark, stored_path(spark, sf))


def stored_headers(spark: SparkSession, sf: str) -> DataFrame:
    return read_headers(spark, stored_path(spark, sf))


def brand_order(spark: SparkSession) -> DataFrame:
    return order_frame(spark, D.BRANDS)


def parent_order(spark: SparkSession) -> DataFrame:
    return order_frame(spark, D.PARENTS)


def brand_number(label: Column) -> Column:
    return F.substring(label, 7, 4).cast("bigint")


def brand_root(label: Column) -> Column:
    """Brands 1 to 5 are root R0, 6 to 10 R1 and so on."""
    return F.concat(F.lit("R"), F.floor((brand_number(label) - 1) / 5).cast("string"))


def pair_graphs(spark: SparkSession, sf: str) -> DataFrame:
    """``(graph_id, edge_id, u, v, value)``: frequent brand pairs, one graph per tag and one for the whole collection."""
    sets = stored_results(spark, sf).filter((F.col("fi_type") == "frequent") & ~F.col("rollup") & (F.col("k") == 2))
    u, v = F.col("itemset")[0], F.col("itemset")[1]
    return sets.select(
        F.coalesce("tag", F.lit("all")).alias("graph_id"),
        (brand_number(u) * 100 + brand_number(v)).alias("edge_id"),
        u.alias("u"),
        v.alias("v"),
        "value",
    )
