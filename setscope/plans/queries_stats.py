"""Queries of tag statistics, histograms and run sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setscope.operators import stats as T
from setscope.operators.baskets import tags_of
from setscope.plans import fragments as Q
from setscope.plans.catalogue import query
from setscope.plans.queries_utility import FREQUENT_BY_TAG, HIGH_BY_TAG
from setscope.plans.stored import stored_results
from setscope.sources import bindings as D


def _all_tags(meta: DataFrame) -> DataFrame:
    """Metadata with both tag families in one array."""
    return meta.select("_id", F.concat(tags_of("genres"), tags_of("vartags")).alias("tags"))


BOTH = f"WITH {Q.META}, both_tags AS (SELECT * FROM tags UNION ALL SELECT * FROM vartags)"


@query(
    "tag_counts",
    f"""{BOTH}, g AS (SELECT tag, COUNT(*) AS count FROM tags GROUP BY 1), v AS (SELECT tag, COUNT(*) AS count FROM vartags GROUP BY 1)
    SELECT 'genres' AS family, tag, count FROM g UNION ALL SELECT 'vartags', tag, count FROM v""",
)
def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    meta = D.metadata(spark, sf)
    families = [T.tag_counts(meta, tags_of(f)).withColumn("family", F.lit(f)) for f in ("genres", "vartags")]
    return families[0].unionByName(families[1])


@query(
    "popular_tags",
    f"""{BOTH} SELECT CAST(id AS VARCHAR) AS _id, tag FROM both_tags
    WHERE tag IN (SELECT tag FROM both_tags GROUP BY tag HAVING COUNT(*) > 600)""",
)
def popular_tags(spark: SparkSession, sf: str) -> DataFrame:
    return T.popular_tags(_all_tags(D.metadata(spark, sf)), F.col("tags"), above=600)


PAIRS = "pairs AS (SELECT a.tag AS a, b.tag AS b, COUNT(*) AS weight FROM both_tags a JOIN both_tags b ON a.id = b.id AND a.tag < b.tag GROUP BY 1, 2)"


@query(
    "tag_cooccurrence",
    f"""{BOTH}, popular AS (SELECT tag FROM both_tags GROUP BY tag HAVING COUNT(*) > 200), {PAIRS}
    SELECT * FROM pairs WHERE a IN (SELECT tag FROM popular) AND b IN (SELECT tag FROM popular)""",
)
def tag_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return T.tag_cooccurrence(_all_tags(D.metadata(spark, sf)), F.col("tags"), above=T.POPULAR_ABOVE)


@query(
    "tag_graph_style",
    f"""{BOTH}, counts AS (SELECT tag, COUNT(*) AS n FROM both_tags GROUP BY 1), {PAIRS}, top AS (SELECT MAX(weight) AS m FROM pairs)
    SELECT tag AS a, CAST(NULL AS VARCHAR) AS b, ROUND(SQRT(n), 9) AS measure FROM counts
    UNION ALL SELECT a, b, ROUND(weight / POW(m, CAST(0.8 AS DOUBLE)), 9) FROM pairs, top""",
)
def tag_graph_style(spark: SparkSession, sf: str) -> DataFrame:
    meta = _all_tags(D.metadata(spark, sf))
    nodes, edges = T.tag_graph_style(T.tag_counts(meta, F.col("tags")), T.tag_cooccurrence(meta, F.col("tags")))
    sizes = nodes.select(F.col("tag").alias("a"), F.lit(None).cast("string").alias("b"), F.round("size", 9).alias("measure"))
    return sizes.unionByName(edges.select("a", "b", F.round("width", 9).alias("measure")))


# Values of both kinds of runs. Each kind has its own common table expressions, so they stay in subqueries.
VALUES = f"""vals AS (
  SELECT * FROM (WITH {FREQUENT_BY_TAG} SELECT run_id, fi_type, value FROM frequent)
  UNION ALL SELECT * FROM (WITH {HIGH_BY_TAG} SELECT run_id, fi_type, value FROM hui))"""


@query(
    "value_histogram",
    f"""WITH {VALUES}, edge AS (SELECT AVG(value) + 3 * STDDEV_POP(value) AS top FROM vals)
    SELECT fi_type, CAST(LEAST(FLOOR(value / top * 39) + 1, 39) AS INTEGER) AS bin, COUNT(*) AS count
    FROM vals, edge WHERE value >= 0 AND value <= top GROUP BY 1, 2""",
)
def value_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return T.value_histogram(stored_results(spark, sf))


@query("itemsets_per_run", f"""WITH {VALUES} SELECT run_id, fi_type, COUNT(*) AS itemsets FROM vals GROUP BY 1, 2""")
def itemsets_per_run(spark: SparkSession, sf: str) -> DataFrame:
    return T.itemsets_per_run(stored_results(spark, sf))
