"""Connected components of a graph given as links between numbers.

Each round maps a node to the smallest of itself and its neighbours, follows that map once more, and renames the links' ends; links
inside one node vanish. Counting the smallest neighbour is a partial aggregate, so a node with a third of all links is no burden; the
joins are plain equi-joins whose large keys adaptive execution splits. A link's ends stay connected because the link itself is renamed
with them. Rounds are few: every component loses half of its nodes or more in each. Tables are written, so lost executors cost a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setscope.functions.tables import materialise


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in ``links(a, b)``; the root is one node of the component. No links give no rows."""
    edges = materialise(links.filter("a <> b").distinct(), "component-links")
    names: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        near = materialise(near.select("node", F.least("node", "least").alias("root")), "component-near")
        far = near.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = materialise(near.join(far, "root").select("node", F.col("next").alias("root")), "component-step")
        names = step if names is None else materialise(_then(names, step), "component-names")
        for end in ("a", "b"):
            edges = edges.join(step.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("root", end)
        edges = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "component-links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if names is None else names


def _then(names: DataFrame, step: DataFrame) -> DataFrame:
    """``names`` with its roots mapped on; a root without links left stays."""
    on = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return names.join(on, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
