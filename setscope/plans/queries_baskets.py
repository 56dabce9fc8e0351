"""Queries of scans, filters, baskets and mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setscope.functions.columns import item_text
from setscope.functions.tables import new_path
from setscope.operators import baskets as B
from setscope.operators import itemsets as I
from setscope.operators import sequences as S
from setscope.plans import fragments as Q
from setscope.plans.catalogue import query
from setscope.sources import bindings as D
from setscope.sources import readers as R

BRAND = Q.maps("p_brand")
TYPE = Q.maps("p_type")


def _text(df: DataFrame, col: str = "itemset") -> DataFrame:
    return df.withColumn(col, item_text(F.col(col)))


@query(
    "load_tracks",
    f"""WITH {BRAND}, {Q.CONFIDENCE}
    SELECT b.id AS _id, c.confidence, b.item, b.share FROM baskets b JOIN conf c ON b.id = c.id""",
)
def load_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return D.tracks(spark, sf, "p_brand").select("_id", "confidence", F.explode("items").alias("item", "share"))


@query(
    "scan_limit",
    f"""WITH {Q.CONFIDENCE} SELECT id AS _id, confidence FROM conf ORDER BY id LIMIT 1000""",
)
def scan_limit(spark: SparkSession, sf: str) -> DataFrame:
    return B.scan_limit(D.plain_tracks(spark, sf), 1000).select("_id", "confidence")


@query(
    "meta_scan",
    f"""WITH {Q.META} SELECT _id, g1 || ',' || g2 AS genres FROM meta WHERE g1 = '2-HIGH' OR g2 = '2-HIGH'""",
)
def meta_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _text(B.meta_scan(D.metadata(spark, sf), "genres", "2-HIGH"), "genres")


@query(
    "weighted_transactions",
    f"""WITH {BRAND}, {Q.CONFIDENCE}, {Q.META}
    SELECT b.id AS tid, b.item, b.share AS qty FROM baskets b JOIN conf c ON b.id = c.id
    WHERE c.confidence > CAST(0.6 AS DOUBLE) AND b.share > CAST(0.05 AS DOUBLE)
      AND EXISTS (SELECT 1 FROM tags t WHERE t.id = b.id AND t.tag = 'building')""",
)
def weighted_transactions(spark: SparkSession, sf: str) -> DataFrame:
    meta = B.tag_filter(D.metadata(spark, sf), "genres", "building")
    return B.weighted_transactions(D.tracks(spark, sf, "p_brand"), meta, ratio=0.05, confidence=0.6)


@query(
    "filter_confidence",
    f"""WITH {Q.CONFIDENCE} SELECT id AS _id, confidence FROM conf WHERE confidence > CAST(0.6 AS DOUBLE)""",
)
def filter_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return B.filter_confidence(D.plain_tracks(spark, sf), 0.6).select("_id", "confidence")


@query(
    "basket_items",
    f"""WITH {BRAND}
    SELECT id AS _id, COALESCE(STRING_AGG(item, ',' ORDER BY item) FILTER (WHERE share > CAST(0.25 AS DOUBLE)), '') AS items,
      CAST(COUNT(*) FILTER (WHERE share > CAST(0.25 AS DOUBLE)) AS INTEGER) AS k
    FROM baskets GROUP BY id""",
)
def basket_items(spark: SparkSession, sf: str) -> DataFrame:
    baskets = B.basket_items(D.tracks(spark, sf, "p_brand"), 0.25)
    return _text(baskets.withColumn("k", F.size("items")), "items")


@query(
    "basket_rollup",
    f"""WITH {BRAND}, {Q.ROLLUP},
    up AS (SELECT DISTINCT b.id, r.parent FROM baskets b JOIN rollup r ON b.item = r.item WHERE b.share > CAST(0.25 AS DOUBLE)),
    ids AS (SELECT DISTINCT id FROM baskets)
    SELECT ids.id AS _id, COALESCE(STRING_AGG(up.parent, ',' ORDER BY up.parent), '') AS items
    FROM ids LEFT JOIN up ON ids.id = up.id GROUP BY ids.id""",
)
def basket_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rolled = B.basket_rollup(D.tracks(spark, sf, "p_brand"), 0.25, D.brand_roll_up(spark))
    return _text(rolled, "items")


LINES_OF = """lines_of AS (
  SELECT l_orderkey AS id, p_type AS label, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(
    "sequence_shape",
    f"""WITH {LINES_OF} SELECT CAST(id AS VARCHAR) AS _id, STRING_AGG(label, '>' ORDER BY pos) AS sequence, CAST(COUNT(*) AS INTEGER) AS k
    FROM lines_of GROUP BY id""",
)
def sequence_shape(spark: SparkSession, sf: str) -> DataFrame:
    shaped = B.sequence_shape(D.order_sequences(spark, sf))
    return shaped.withColumn("k", F.size("sequence")).withColumn("sequence", F.array_join(F.flatten("sequence"), ">"))


TYPE_KIND = {"ECONOMY": "plain", "LARGE": "sized", "MEDIUM": "sized", "SMALL": "sized", "STANDARD": "plain"}


@query(
    "sequence_rollup",
    f"""WITH {LINES_OF} SELECT CAST(id AS VARCHAR) AS _id,
      COALESCE(STRING_AGG(CASE WHEN label IN ('ECONOMY', 'STANDARD') THEN 'plain' WHEN label = 'PROMO' THEN NULL ELSE 'sized' END,
        '>' ORDER BY pos), '') AS sequence
    FROM lines_of GROUP BY id""",
)
def sequence_rollup(spark: SparkSession, sf: str) -> DataFrame:
    # Promotions have no parent, so they leave the sequence.
    rolled = B.sequence_rollup(B.sequence_shape(D.order_sequences(spark, sf)), TYPE_KIND)
    return rolled.withColumn("sequence", F.array_join(F.flatten("sequence"), ">"))


@query(
    "tag_filter",
    f"""WITH {Q.META} SELECT _id, name FROM meta WHERE g1 = 'household' OR g2 = 'household'""",
)
def tag_filter(spark: SparkSession, sf: str) -> DataFrame:
    return B.tag_filter(D.metadata(spark, sf), "genres", "household").select("_id", "name")


@query(
    "tags_all_of",
    f"""WITH {Q.META} SELECT _id, name FROM meta WHERE '1-URGENT' IN (g1, g2) AND 'machinery' IN (g1, g2)""",
)
def tags_all_of(spark: SparkSession, sf: str) -> DataFrame:
    return B.tags_all_of(D.metadata(spark, sf), "genres", "1-URGENT,machinery").select("_id", "name")


@query(
    "tracks_with_items",
    f"""WITH {TYPE} SELECT id AS _id FROM baskets
    WHERE item IN ('PROMO', 'SMALL', 'LARGE') AND share > CAST(0.05 AS DOUBLE) GROUP BY id HAVING COUNT(*) = 3""",
)
def tracks_with_items(spark: SparkSession, sf: str) -> DataFrame:
    return B.tracks_with_items(D.tracks(spark, sf, "p_type"), ["PROMO", "SMALL", "LARGE"], 0.05).select("_id")


@query(
    "join_meta",
    f"""WITH {BRAND}, {Q.META}
    SELECT b.id AS _id, STRING_AGG(b.item, ',' ORDER BY b.item) AS items, m.g1 || ',' || m.g2 AS genres
    FROM baskets b JOIN meta m ON b.id = m.id
    WHERE b.share > CAST(0.05 AS DOUBLE) AND 'furniture' IN (m.g1, m.g2) GROUP BY b.id, m.g1, m.g2""",
)
def join_meta(spark: SparkSession, sf: str) -> DataFrame:
    baskets = B.basket_items(D.tracks(spark, sf, "p_brand"), 0.05)
    return _text(_text(B.join_meta(baskets, D.metadata(spark, sf), "genres", "furniture"), "items"), "genres")


@query(
    "basket_count",
    f"""WITH {Q.CONFIDENCE} SELECT COUNT(*) AS n FROM conf WHERE confidence > CAST(0.6 AS DOUBLE)""",
)
def basket_count(spark: SparkSession, sf: str) -> DataFrame:
    return B.filter_confidence(D.plain_tracks(spark, sf), 0.6).agg(F.count(F.lit(1)).alias("n"))


@query(
    "tracks_ranked_items",
    f"""WITH {BRAND}
    SELECT id AS _id, STRING_AGG(item, ',' ORDER BY share DESC, item) AS labels, MAX(share) AS top_share, MIN(share) AS low_share
    FROM baskets GROUP BY id""",
)
def tracks_ranked_items(spark: SparkSession, sf: str) -> DataFrame:
    ranked = B.tracks_ranked_items(D.tracks(spark, sf, "p_brand"))
    return ranked.select(
        "_id",
        item_text(F.col("labels")).alias("labels"),
        F.element_at("shares", 1).alias("top_share"),
        F.element_at("shares", -1).alias("low_share"),
    )


@query(
    "id_batches",
    """WITH ids AS (SELECT DISTINCT l_orderkey AS id FROM lineitem),
    ix AS (SELECT id, (ROW_NUMBER() OVER (ORDER BY id) - 1) // 50 AS batch FROM ids)
    SELECT CAST(batch AS BIGINT) AS batch, COUNT(*) AS n_ids, STRING_AGG(CAST(id AS VARCHAR), ' ' ORDER BY id) AS ids
    FROM ix GROUP BY batch""",
)
def id_batches(spark: SparkSession, sf: str) -> DataFrame:
    return R.id_batches(D.table(spark, sf, "lineitem"), id_col="l_orderkey", size=50)


@query(
    "ingest_meta",
    f"""WITH {Q.META} SELECT _id, name, artist_name, g1 || ',' || g2 AS genres FROM meta""",
)
def ingest_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of 50 consecutive ids at most, stored as JSON and read back; a second run sends a third of them again with the others."""
    meta = D.metadata(spark, sf).withColumnRenamed("_id", "id")
    number = F.expr("cast(id as bigint) div 50")
    pages = meta.groupBy(number.cast("string").alias("page")).agg(F.collect_list(F.struct(*meta.columns)).alias("results"))
    folder, table = new_path(spark, "pages"), new_path(spark, "ingested")
    pages.write.json(folder)
    stored = R.load_pages(spark, folder, multi_line=False)
    R.ingest_pages(stored.filter(F.crc32("page") % 3 == 0), table)
    rows = R.ingest_pages(stored, table)
    return rows.select("_id", "name", "artist_name", item_text(F.col("musicinfo.tags.genres")).alias("genres"))


FREQUENT_TYPES = f"""WITH {TYPE}, {Q.TYPE_SETS},
masks AS (
  SELECT i.id, COALESCE(CAST(SUM(b.bit) AS BIGINT), 0) AS mask FROM (SELECT DISTINCT id FROM baskets) i
  LEFT JOIN (SELECT id, item FROM baskets WHERE share > CAST(0.05 AS DOUBLE)) x ON i.id = x.id
  LEFT JOIN bits b ON x.item = b.item GROUP BY i.id),
n AS (SELECT COUNT(*) AS n FROM masks),
hits AS (SELECT s.itemset, s.k, COUNT(*) AS freq FROM sets s JOIN masks m ON (m.mask & s.mask) = s.mask GROUP BY s.itemset, s.k)
SELECT itemset, k, freq, CAST(freq AS DOUBLE) / CAST(n AS DOUBLE) AS value, n FROM hits, n WHERE """


def type_baskets(spark: SparkSession, sf: str) -> DataFrame:
    return B.basket_items(D.basket_maps(spark, sf, "p_type"), 0.05)


@query("frequent_itemsets", FREQUENT_TYPES + "freq >= CEIL(CAST(0.01 AS DOUBLE) * n)")
def frequent_itemsets(spark: SparkSession, sf: str) -> DataFrame:
    return _text(I.frequent_itemsets(type_baskets(spark, sf), min_support=0.01))


@query("frequent_itemsets_levelwise", FREQUENT_TYPES + "freq >= CEIL(CAST(0.01 AS DOUBLE) * n)")
def frequent_itemsets_levelwise(spark: SparkSession, sf: str) -> DataFrame:
    return _text(I.frequent_itemsets_levelwise(type_baskets(spark, sf), min_support=0.01))


@query("frequent_itemsets_son", FREQUENT_TYPES + "freq > CAST(0.05 AS DOUBLE) * n")
def frequent_itemsets_son(spark: SparkSession, sf: str) -> DataFrame:
    return _text(I.frequent_itemsets_son(type_baskets(spark, sf), min_support=0.05, chunks=4))


def sequences_sql(source: str, support: str, longest: int) -> str:
    """Patterns of up to ``longest`` labels in ``e(id, label, pos)``, found by joining each with the labels behind it."""
    found = []
    for k in range(1, longest + 1):
        names = " || '>' || ".join(f"x{i}.label" for i in range(k))
        joins = "".join(f" JOIN e x{i} ON x{i}.id = x{i - 1}.id AND x{i}.pos > x{i - 1}.pos" for i in range(1, k))
        found.append(f"SELECT {names} AS sequence, CAST({k} AS INTEGER) AS k, COUNT(DISTINCT x0.id) AS freq FROM e x0{joins} GROUP BY 1")
    return f"""WITH {source}, n AS (SELECT COUNT(DISTINCT id) AS n FROM e), found AS ({" UNION ALL ".join(found)})
    SELECT sequence, k, freq, CAST(freq AS DOUBLE) / CAST(n AS DOUBLE) AS value, n FROM found, n
    WHERE freq >= CEIL(CAST({support} AS DOUBLE) * n)"""


@query("frequent_sequences", sequences_sql(f"{LINES_OF}, e AS (SELECT * FROM lines_of)", "0.005", 5))
def frequent_sequences(spark: SparkSession, sf: str) -> DataFrame:
    shaped = B.sequence_shape(D.order_sequences(spark, sf))
    found = S.frequent_sequences(shaped, min_support=0.005)
    return found.withColumn("sequence", F.array_join(F.flatten("sequence"), ">"))


DAYS = """e AS (
  SELECT CONCAT_WS('/', user_id, STRFTIME(ts, '%Y-%m-%d')) AS id, event_type AS label,
    ROW_NUMBER() OVER (PARTITION BY user_id, STRFTIME(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS pos FROM events)"""


@query("frequent_sequences_long", sequences_sql(DAYS, "0.001", 5))
def frequent_sequences_long(spark: SparkSession, sf: str) -> DataFrame:
    found = S.frequent_sequences_long(
        D.sequence_events(spark, sf), id_cols=["user_id", "day"], order_cols=["ts", "event_id"], min_support=0.001
    )
    return found.withColumn("sequence", F.array_join("sequence", ">"))


@query(
    "association_rules",
    f"""WITH {TYPE}, {Q.TYPE_SETS},
masks AS (
  SELECT i.id, COALESCE(CAST(SUM(b.bit) AS BIGINT), 0) AS mask FROM (SELECT DISTINCT id FROM baskets) i
  LEFT JOIN (SELECT id, item FROM baskets WHERE share > CAST(0.05 AS DOUBLE)) x ON i.id = x.id
  LEFT JOIN bits b ON x.item = b.item GROUP BY i.id),
n AS (SELECT COUNT(*) AS n FROM masks),
hits AS (
  SELECT s.mask, s.itemset, COUNT(*) AS freq FROM sets s JOIN masks m ON (m.mask & s.mask) = s.mask GROUP BY s.mask, s.itemset
  HAVING COUNT(*) >= CEIL(CAST(0.01 AS DOUBLE) * (SELECT n FROM n))),
rules AS (
  SELECT a.itemset AS antecedent, b.item AS consequent, CAST(x.freq AS DOUBLE) / CAST(a.freq AS DOUBLE) AS confidence,
    CAST(c.freq AS DOUBLE) / CAST(n AS DOUBLE) AS share, CAST(x.freq AS DOUBLE) / CAST(n AS DOUBLE) AS support
  FROM hits x JOIN bits b ON (x.mask & b.bit) <> 0 AND x.mask <> b.bit JOIN hits a ON a.mask = x.mask - b.bit
    JOIN hits c ON c.mask = b.bit, n)
SELECT antecedent, consequent, ROUND(confidence, 9) AS confidence, ROUND(confidence / share, 9) AS lift, ROUND(support, 9) AS support
FROM rules WHERE confidence >= CAST(0.1 AS DOUBLE)""",
)
def association_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = I.association_rules(type_baskets(spark, sf), min_support=0.01, min_confidence=0.1)
    rules = _text(_text(rules, "antecedent"), "consequent")
    return rules.withColumns({c: F.round(c, 9) for c in ("confidence", "lift", "support")})
