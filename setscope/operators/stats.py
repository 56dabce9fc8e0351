"""Tag statistics, value histograms and summaries."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setscope.functions.columns import in_row_pairs, string_array
from setscope.functions.tables import materialise

# Kernels travel to the workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Popularity cut of a tag and edge count of the histogram.
POPULAR_ABOVE = 200
BINS = 39
WIDTH_POWER = 0.8
#: Heavy tags at most, and records whose incidence matrix is multiplied at once.
HEAVY_TAGS, MATRIX_ROWS = 1_000, 2_000


def tag_counts(meta: DataFrame, tags: Column) -> DataFrame:
    """``(tag, count)``."""
    return meta.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("count"))


def popular_tags(meta: DataFrame, tags: Column, *, above: int = POPULAR_ABOVE) -> DataFrame:
    """``(_id, tag)``: tags of each record that occur more often than the cut."""
    popular = tag_counts(meta, tags).filter(F.col("count") > above).select("tag")
    return meta.select("_id", F.explode(tags).alias("tag")).join(popular, "tag", "left_semi").select("_id", "tag")


def tag_cooccurrence(meta: DataFrame, tags: Column, *, above: int | None = None, heavy_tags: int = HEAVY_TAGS) -> DataFrame:
    """``(a, b, weight)``: records that hold both tags, a before b; with a cut, only popular tags.

    Equal tag arrays are merged, and rare tags left out, before anything is paired. A tag is heavy if it has more than one in
    ``heavy_tags`` of all entries, so heavy tags are ``heavy_tags`` at most. Their pairs are counted in each task as a product of
    incidence matrices and handed over once a task; no record gives them. Records pair only light tags, with each other and with their
    heavy ones: each of these pairs is rare, so the rows are of the order of the result.
    """
    arrays = meta.select(F.sort_array(F.array_distinct(F.array_compact(tags))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    if above is not None:
        popular = tag_counts(meta, tags).filter(F.col("count") > above).select("tag")
        rest = arrays.select("t", "n", F.explode("t").alias("tag")).join(popular, "tag", "left_semi")
        rest = rest.groupBy("t", "n").agg(F.sort_array(F.collect_list("tag")).alias("left"))
        arrays = rest.groupBy(F.col("left").alias("t")).agg(F.sum("n").alias("n"))
    arrays = materialise(arrays.filter(F.size("t") > 1), "tag-arrays")
    counts = arrays.select("n", F.explode("t").alias("tag")).groupBy("tag").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = sorted(r["tag"] for r in counts.filter(F.col("n") * heavy_tags > total).select("tag").collect())
    known = string_array(heavy)
    split = arrays.select("n", F.array_except("t", known).alias("light"), F.array_intersect("t", known).alias("heavy"))
    among = F.transform(in_row_pairs(F.col("light")), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))
    across = F.flatten(
        F.transform("light", lambda x: F.transform("heavy", lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))))
    )
    light = split.select("n", F.explode(F.concat(among, across)).alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("weight"))
    return light.unionByName(_heavy_pairs(split, heavy))


def _heavy_pairs(split: DataFrame, heavy: list[str]) -> DataFrame:
    """Pairs of heavy tags with the records that hold both."""
    place = {tag: i for i, tag in enumerate(heavy)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((len(heavy), len(heavy)), dtype=np.int64)
        for b in batches:
            for start in range(0, b.num_rows, MATRIX_ROWS):
                part = b.slice(start, MATRIX_ROWS)
                held = np.zeros((part.num_rows, len(heavy)))
                for i, tags in enumerate(part["heavy"].to_pylist()):
                    held[i, [place[t] for t in tags]] = 1
                # Products of ones and counts: exact below 2^53.
                both += np.rint(held.T @ (held * part["n"].to_numpy()[:, None])).astype(np.int64)
        a, b = np.nonzero(np.triu(both, 1))
        names = [pa.array([heavy[i] for i in x], pa.string()) for x in (a, b)]
        yield pa.RecordBatch.from_arrays([*names, pa.array(both[a, b], pa.int64())], names=["a", "b", "weight"])

    rows = split.filter(F.size("heavy") > 1).select("heavy", "n").mapInArrow(run, "a string, b string, weight bigint")
    return rows.groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def tag_graph_style(counts: DataFrame, cooccurrence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node sizes ``(tag, size)`` and edge widths ``(a, b, width)``: root of the count, weight over the largest to the 0.8."""
    nodes = counts.select("tag", F.sqrt("count").alias("size"))
    largest = cooccurrence.agg(F.max("weight")).first()[0]
    edges = cooccurrence.select("a", "b", (F.col("weight") / F.pow(F.lit(float(largest or 1)), F.lit(WIDTH_POWER))).alias("width"))
    return nodes, edges


def value_histogram(values: DataFrame, *, bins: int = BINS) -> DataFrame:
    """``(fi_type, bin, count)``: equal bins from 0 to mean plus three population deviations of all values together.

    The last bin holds its right edge; values beyond are left out.
    """
    values = materialise(values.select("fi_type", "value"), "values")
    mean, spread = values.agg(F.avg("value"), F.stddev_pop("value")).first()
    top = (mean or 0.0) + 3 * (spread or 0.0)
    place = F.floor(F.col("value") / F.lit(top) * bins).cast("int") + 1
    return (
        values.filter((F.col("value") >= 0) & (F.col("value") <= top))
        .groupBy("fi_type", F.least(place, F.lit(bins)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def itemsets_per_run(results: DataFrame) -> DataFrame:
    """``(run_id, fi_type, itemsets)``."""
    return results.groupBy("run_id", "fi_type").agg(F.count(F.lit(1)).alias("itemsets"))


def sweep_summary(records: DataFrame, measures: list[str]) -> DataFrame:
    """``(n, <measure>_mean, <measure>_sem)``: mean and standard error per sample size."""
    columns = []
    for m in measures:
        columns += [F.avg(m).alias(f"{m}_mean"), (F.stddev_samp(m) / F.sqrt(F.count(m))).alias(f"{m}_sem")]
    return records.groupBy("n").agg(*columns)
