"""Queries of utility mining and of the batch by tag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setscope.functions.columns import item_text
from setscope.operators import baskets as B
from setscope.operators import utility as U
from setscope.operators import utility_vertical as L
from setscope.plans import batch
from setscope.plans import fragments as Q
from setscope.plans.catalogue import query
from setscope.sources import bindings as D

UTIL = f"""{Q.maps("p_type")}, {Q.UTILITY},
x AS (SELECT b.id AS tid, b.item, b.weight * u.eutil AS u FROM baskets b JOIN util u ON b.item = u.item),
tu AS (SELECT tid, SUM(u) AS tu FROM x GROUP BY tid)"""


def utilities(spark: SparkSession, sf: str) -> DataFrame:
    return U.item_utilities(D.type_transactions(spark, sf), D.type_utilities(spark), unique=True)


@query("total_utility", f"WITH {UTIL} SELECT CAST(SUM(u) AS BIGINT) AS total FROM x")
def total_utility(spark: SparkSession, sf: str) -> DataFrame:
    return U.total_utility(utilities(spark, sf))


@query("transaction_utility", f"WITH {UTIL} SELECT tid, CAST(tu AS BIGINT) AS tu FROM tu")
def transaction_utility(spark: SparkSession, sf: str) -> DataFrame:
    return U.transaction_utility(utilities(spark, sf))


TWU = f"""{UTIL},
twu AS (SELECT x.item, SUM(tu.tu) AS twu FROM x JOIN tu ON x.tid = tu.tid GROUP BY x.item),
ranks AS (SELECT item, CAST(twu AS BIGINT) AS twu, CAST(ROW_NUMBER() OVER (ORDER BY twu, item) AS INTEGER) AS rank FROM twu)"""


@query("twu_items", f"WITH {TWU} SELECT item, twu, rank FROM ranks")
def twu_items(spark: SparkSession, sf: str) -> DataFrame:
    return U.twu_items(utilities(spark, sf))


@query(
    "eucs_pairs",
    f"""WITH {UTIL} SELECT a.item AS a, b.item AS b, CAST(SUM(tu.tu) AS BIGINT) AS twu
    FROM x a JOIN x b ON a.tid = b.tid AND a.item < b.item JOIN tu ON a.tid = tu.tid GROUP BY 1, 2""",
)
def eucs_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return U.eucs_pairs(utilities(spark, sf))


@query(
    "utility_lists",
    f"""WITH {TWU} SELECT x.item, x.tid, CAST(x.u AS BIGINT) AS iutil,
      CAST(COALESCE(SUM(x.u) OVER (PARTITION BY x.tid ORDER BY r.rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)
        AS BIGINT) AS rutil
    FROM x JOIN ranks r ON x.item = r.item""",
)
def utility_lists(spark: SparkSession, sf: str) -> DataFrame:
    return U.utility_lists(utilities(spark, sf))


def _columns() -> str:
    sums = [f"SUM(CASE WHEN x.item = '{t}' THEN x.u ELSE 0 END) AS u{i}" for i, t in enumerate(Q.TYPES)]
    return ", ".join(sums)


def _utility_of() -> str:
    return " + ".join(f"CASE WHEN (s.mask & {1 << i}) <> 0 THEN w.u{i} ELSE 0 END" for i in range(len(Q.TYPES)))


def high_utility_sql(min_util: str) -> str:
    return f"""WITH {UTIL}, {Q.TYPE_SETS},
    w AS (SELECT x.tid, CAST(SUM(b.bit) AS BIGINT) AS mask, {_columns()} FROM x JOIN bits b ON x.item = b.item GROUP BY x.tid),
    total AS (SELECT SUM(u) AS total FROM x),
    hits AS (SELECT s.itemset, s.k, SUM({_utility_of()}) AS utility FROM sets s JOIN w ON (w.mask & s.mask) = s.mask GROUP BY 1, 2)
    SELECT itemset, k, CAST(utility AS BIGINT) AS utility, CAST(utility AS DOUBLE) / CAST(total AS DOUBLE) AS value
    FROM hits, total WHERE CAST(utility AS DOUBLE) >= CAST({min_util} AS DOUBLE) * CAST(total AS DOUBLE)"""


@query("high_utility_itemsets", high_utility_sql("0.01"))
def high_utility_itemsets(spark: SparkSession, sf: str) -> DataFrame:
    found = U.high_utility_itemsets(D.type_transactions(spark, sf), D.type_utilities(spark), min_util=0.01, unique=True)
    return found.withColumn("itemset", item_text(F.col("itemset")))


FREQUENT_BY_TAG = f"""{Q.maps("p_brand")}, {Q.CONFIDENCE}, {Q.META}, {Q.ROLLUP}, {Q.TAG_LIST},
sure AS (SELECT id FROM conf WHERE confidence > CAST(0.6 AS DOUBLE)),
plain AS (SELECT b.id, b.item FROM baskets b JOIN sure s ON b.id = s.id WHERE b.share > CAST(0.05 AS DOUBLE)),
both_levels AS (
  SELECT FALSE AS rollup, id, item FROM plain
  UNION ALL SELECT DISTINCT TRUE, p.id, r.parent FROM plain p JOIN rollup r ON p.item = r.item),
tagged AS (SELECT s.id, '' AS tag FROM sure s UNION ALL SELECT s.id, t.tag FROM sure s JOIN tags t ON s.id = t.id),
grouped AS (SELECT t.tag, b.rollup, b.id, b.item FROM tagged t JOIN both_levels b ON t.id = b.id),
sizes AS (SELECT tag, COUNT(*) AS n FROM tagged GROUP BY tag),
{Q.item_sets("grouped", "tag, rollup")},
frequent AS (
  SELECT LPAD(CAST(l.ix AS VARCHAR), 4, '0') || '-0.01-0.05-0.6-' || CASE WHEN s.rollup THEN 'Truef' ELSE 'Falsef' END AS run_id,
    CASE WHEN s.tag <> '' THEN 'genres' END AS tag_name, NULLIF(s.tag, '') AS tag, s.rollup, 'frequent' AS fi_type, s.itemset, s.k, s.freq,
    CAST(s.freq AS DOUBLE) / CAST(z.n AS DOUBLE) AS value, z.n
  FROM allsets s JOIN sizes z ON s.tag = z.tag JOIN taglist l ON COALESCE(l.tag, '') = s.tag
  WHERE s.freq >= CEIL(CAST(0.01 AS DOUBLE) * z.n))"""


def mined_frequent(spark: SparkSession, sf: str, orders: DataFrame | None = None) -> DataFrame:
    """Frequent brands of all tags; ``orders`` are the confident orders with labels and tags if they are known already."""
    if orders is None:
        tracks, meta = D.tracks(spark, sf, "p_brand"), D.metadata(spark, sf)
    else:
        tracks, meta = orders.select("t", "confidence", D.shares("brands").alias("items")), None
    return batch.frequent_by_tag(tracks, meta, tag_name="genres", tags=D.TAGS, roll_up=D.BRAND_PARENT)


@query("frequent_itemsets_by_tag", f"WITH {FREQUENT_BY_TAG} SELECT * FROM frequent")
def frequent_itemsets_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    return mined_frequent(spark, sf).withColumn("itemset", item_text(F.col("itemset")))


HIGH_BY_TAG = f"""{Q.maps("p_type", "t_")}, {Q.CONFIDENCE}, {Q.META}, {Q.TAG_LIST}, {Q.UTILITY}, {Q.TYPE_SETS},
sure AS (SELECT id FROM conf WHERE confidence > CAST(0.6 AS DOUBLE)),
x AS (
  SELECT b.id AS tid, b.item, b.weight * u.eutil AS u FROM t_baskets b JOIN sure s ON b.id = s.id JOIN util u ON b.item = u.item
  WHERE b.share > CAST(0.05 AS DOUBLE)),
w AS (SELECT x.tid, CAST(SUM(b.bit) AS BIGINT) AS mask, {_columns()} FROM x JOIN bits b ON x.item = b.item GROUP BY x.tid),
tagged AS (SELECT s.id, '' AS tag FROM sure s UNION ALL SELECT s.id, t.tag FROM sure s JOIN tags t ON s.id = t.id),
sizes AS (SELECT tag, COUNT(*) AS n FROM tagged GROUP BY tag),
totals AS (SELECT t.tag, SUM(x.u) AS total FROM tagged t JOIN x ON t.id = x.tid GROUP BY t.tag),
hits AS (
  SELECT t.tag, s.itemset, s.k, SUM({_utility_of()}) AS utility
  FROM w JOIN sets s ON (w.mask & s.mask) = s.mask JOIN tagged t ON t.id = w.tid GROUP BY 1, 2, 3),
hui AS (
  SELECT LPAD(CAST(l.ix AS VARCHAR), 4, '0') || '-0.01-0.05-0.6-hui' AS run_id, CASE WHEN h.tag <> '' THEN 'genres' END AS tag_name,
    NULLIF(h.tag, '') AS tag, FALSE AS rollup,
    'hui' AS fi_type, h.itemset, h.k, CAST(NULL AS BIGINT) AS freq,
    CAST(h.utility AS DOUBLE) / CAST(o.total AS DOUBLE) AS value, z.n
  FROM hits h JOIN totals o ON h.tag = o.tag JOIN sizes z ON h.tag = z.tag JOIN taglist l ON COALESCE(l.tag, '') = h.tag
  WHERE CAST(h.utility AS DOUBLE) >= CAST(0.01 AS DOUBLE) * CAST(o.total AS DOUBLE))"""


def mined_high_utility(spark: SparkSession, sf: str, orders: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """High-utility types of all tags; ``orders`` and their ``sizes`` are the confident orders and tag sizes if known already."""
    if orders is not None:
        kept = F.map_filter("types", lambda _, w: w / F.col("total") > batch.FILTER_RATIO)
        weights = B.filter_confidence(orders, batch.FILTER_CONFIDENCE).select("t", "total", kept.alias("weights"))
        arrays = U.map_arrays(weights, "weights", D.type_utilities(spark))
        return batch.utility_runs(arrays, sizes, tag_name="genres", tags=D.TAGS)
    return batch.high_utility_by_tag(
        D.plain_tracks(spark, sf),
        D.filtered_type_transactions(spark, sf, batch.FILTER_RATIO, batch.FILTER_CONFIDENCE),
        D.type_utilities(spark),
        D.metadata(spark, sf),
        tag_name="genres",
        tags=D.TAGS,
    )


@query("high_utility_by_tag", f"WITH {HIGH_BY_TAG} SELECT * FROM hui")
def high_utility_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    return mined_high_utility(spark, sf).withColumn("itemset", item_text(F.col("itemset")))


# The batch with shares as quantities, over the finished orders: the others have no metadata here.
SHARES_BY_TAG = (
    HIGH_BY_TAG.replace("b.weight * u.eutil AS u", "b.share * u.eutil AS u")
    .replace("WHERE confidence > CAST(0.6 AS DOUBLE))", "WHERE confidence > CAST(0.6 AS DOUBLE) AND id IN (SELECT id FROM meta WHERE name LIKE '% F'))")
)


@query("high_utility_shares", f"WITH {SHARES_BY_TAG} SELECT run_id, tag_name, tag, rollup, fi_type, itemset, k, freq, ROUND(value, 9) AS value, n FROM hui")
def high_utility_shares(spark: SparkSession, sf: str) -> DataFrame:
    tracks = D.tracks(spark, sf, "p_type")
    found = batch.high_utility_by_tag(
        tracks.select("_id", "confidence"),
        batch.share_transactions(tracks, ratio=batch.FILTER_RATIO, confidence=batch.FILTER_CONFIDENCE),
        D.type_utilities(spark),
        D.metadata(spark, sf).filter(F.col("name").endswith(" F")),
        tag_name="genres",
        tags=D.TAGS,
        known_only=True,
    )
    return found.withColumns({"itemset": item_text(F.col("itemset")), "value": F.round("value", 9)})


# Every part is a label of its own. All label sets of an order are enumerated by the bits of the numbers from 1.
WIDE = f"""WITH {Q.UTILITY},
x AS (
  SELECT l_orderkey AS tid, l_partkey AS item, SUM(CAST(l_quantity AS BIGINT) * u.eutil) AS u
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN util u ON p_type = u.item GROUP BY 1, 2),
baskets AS (SELECT tid, LIST(item ORDER BY item) AS l, LIST(u ORDER BY item) AS us FROM x GROUP BY tid),
chosen AS (SELECT l, us, UNNEST(RANGE(1, CAST(1 AS BIGINT) << LEN(l))) AS m FROM baskets),
found AS (
  SELECT LIST_FILTER(l, LAMBDA v, i: (m >> (i - 1)) & 1 = 1) AS itemset, SUM(LIST_SUM(LIST_FILTER(us, LAMBDA v, i: (m >> (i - 1)) & 1 = 1))) AS utility
  FROM chosen GROUP BY 1)
SELECT ARRAY_TO_STRING(LIST_TRANSFORM(itemset, LAMBDA v: CAST(v AS VARCHAR)), ',') AS itemset, CAST(LEN(itemset) AS INTEGER) AS k,
  CAST(utility AS BIGINT) AS utility, CAST(utility AS BIGINT) AS value FROM found WHERE utility >= 700"""


@query("high_utility_wide", WIDE)
def high_utility_wide(spark: SparkSession, sf: str) -> DataFrame:
    lines = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tid"), "l_partkey", F.col("l_quantity").cast("bigint").alias("qty"))
    parts = D.table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("kind"))
    kinds = D.type_utilities(spark).withColumnRenamed("item", "kind")
    utilities = parts.join(kinds, "kind").select(F.col("p_partkey").alias("item"), "eutil")
    found = L.high_utility_lists(lines.withColumnRenamed("l_partkey", "item"), utilities, min_util=700, as_share=False)
    return found.withColumn("itemset", F.array_join(F.transform("itemset", lambda x: x.cast("string")), ","))
