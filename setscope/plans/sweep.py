"""The ordering sweep: bootstrap samples of every graph, ordered by each method, and their crossings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setscope.functions.tables import materialise
from setscope.operators.graph import bootstrap_edges, crossings_total, edge_positions
from setscope.operators.ordering import METHODS, order_graphs_by

# Sample sizes of the sweep over all tags, and of the single-tag run.
SIZES = [25, 50, 75, 100, 125, 150, 175, 200, 225, 250, 275, 300, 325, 350]
SINGLE_SIZES = [10, 50, 100, 150, 200, 250, 300, 350]


def sample_graphs(edges: DataFrame, sizes: list[int], *, seed: str, skip_larger: bool = True) -> DataFrame:
    """Samples as graphs of their own: ``graph_id`` is ``<graph>|<n>``, ``edge_id`` the draw."""
    drawn = bootstrap_edges(edges, sizes, seed=seed, skip_larger=skip_larger)
    return drawn.select(
        F.concat_ws("|", "graph_id", "n").alias("graph_id"), "n", F.col("draw").cast("bigint").alias("edge_id"), "u", "v",
        F.col("graph_id").alias("source"),
    )


def order_sweep(edges: DataFrame, default: DataFrame, *, sizes: list[int], seed: str) -> DataFrame:
    """``(source, n, cross_default, cross_<method>...)`` of every graph and sample size.

    All samples are ordered in one grouped job, and the crossings of all samples and orders are counted in one more.
    """
    samples = materialise(sample_graphs(edges, sizes, seed=seed), "samples")
    orders = materialise(order_graphs_by(samples), "orders")
    ways = ["default", *METHODS]
    laid = samples.withColumn("method", F.explode(F.array(*[F.lit(w) for w in ways])))

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("graph_id", F.concat_ws("|", "graph_id", "method"))

    by_method = edge_positions(keyed(laid.filter(F.col("method") != "default")), keyed(orders).drop("method"))
    by_default = edge_positions(keyed(laid.filter(F.col("method") == "default")), default)
    placed = materialise(by_method.unionByName(by_default), "placed")
    labels = placed.select("graph_id", "source", "n", "method").distinct()
    counted = crossings_total(placed).join(labels, "graph_id")
    wide = counted.groupBy("source", "n").pivot("method", ways).agg(F.first("crossings"))
    return wide.withColumnsRenamed({w: f"cross_{w}" for w in ways})


RECORDS = "source string, n int, " + ", ".join(f"cross_{w} bigint" for w in ["default", *METHODS])


def write_records(records: DataFrame, path: str, fmt: str = "json") -> None:
    """Sweep records as JSON lines, CSV with a header, or parquet."""
    columns = [F.col(name).cast(kind).alias(name) for name, kind in (field.split() for field in RECORDS.split(", "))]
    records.select(*columns).write.format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)


def read_records(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(RECORDS).format(fmt).options(**({"header": True} if fmt == "csv" else {})).load(path)
