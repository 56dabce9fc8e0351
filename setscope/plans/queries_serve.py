"""Queries of the result table, served sets and the track search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setscope.functions.columns import item_text
from setscope.functions.tables import new_path
from setscope.operators import baskets as B
from setscope.operators import cluster as C
from setscope.plans import batch, serve
from setscope.plans import fragments as Q
from setscope.plans.catalogue import query
from setscope.plans.queries_graph import AVSDF, AXIS_CLUSTERS, ROUNDED, UNIT_FEATURES, adjusted, pair_points_sql, rounded, rounded_sql
from setscope.plans.queries_utility import FREQUENT_BY_TAG, HIGH_BY_TAG
from setscope.plans.stored import brand_order, parent_order, stored_headers, stored_results
from setscope.sources import bindings as D
from setscope.sources import results as R

FREQUENT = f"WITH {FREQUENT_BY_TAG}"


def _labels(sets: DataFrame) -> DataFrame:
    return sets.withColumn("labels", item_text(F.col("labels")))


@query(
    "run_id",
    f"""WITH {Q.META}, {Q.TAG_LIST}
    SELECT t.tag, r.rollup, COUNT(*) AS tracks,
      LPAD(CAST(l.ix AS VARCHAR), 4, '0') || '-0.01-0.05-0.6-' || CASE WHEN r.rollup THEN 'Truef' ELSE 'Falsef' END AS run_id
    FROM tags t JOIN taglist l ON t.tag = l.tag JOIN (VALUES (TRUE), (FALSE)) r(rollup) ON TRUE GROUP BY t.tag, r.rollup, l.ix""",
)
def run_id(spark: SparkSession, sf: str) -> DataFrame:
    tags = D.metadata(spark, sf).select(F.explode(B.tags_of("genres")).alias("tag"))
    rows = tags.select("tag", F.explode(F.array(F.lit(False), F.lit(True))).alias("rollup"))
    key = batch.run_id(
        F.col("tag"),
        D.TAGS,
        minimum=batch.MIN_SUPPORT,
        ratio=batch.FILTER_RATIO,
        confidence=batch.FILTER_CONFIDENCE,
        ending=batch.frequent_ending(F.col("rollup")),
    )
    return rows.groupBy("tag", "rollup").agg(F.count(F.lit(1)).alias("tracks")).withColumn("run_id", key)


@query(
    "upsert_results",
    f"""WITH {Q.META}, {Q.CONFIDENCE},
    old AS (SELECT tag AS run_id, COUNT(*) AS n FROM tags GROUP BY tag),
    new AS (SELECT g2 AS run_id, COUNT(*) AS n FROM meta m JOIN conf c ON m.id = c.id WHERE c.confidence > CAST(0.6 AS DOUBLE) GROUP BY g2
      UNION ALL SELECT 'all', COUNT(*) FROM conf)
    SELECT run_id, n FROM new UNION ALL SELECT run_id, n FROM old WHERE run_id NOT IN (SELECT run_id FROM new)""",
)
def upsert_results(spark: SparkSession, sf: str) -> DataFrame:
    meta = D.metadata(spark, sf)
    tracks = D.plain_tracks(spark, sf)
    sizes = F.count(F.lit(1)).alias("n")
    old = meta.select(F.explode(B.tags_of("genres")).alias("run_id")).groupBy("run_id").agg(sizes)
    sure = B.filter_confidence(tracks, batch.FILTER_CONFIDENCE).select("_id")
    segments = B.normal_ids(meta).join(sure, "_id").select(F.get(B.tags_of("genres"), F.lit(1)).alias("run_id"))
    new = segments.groupBy("run_id").agg(sizes).unionByName(tracks.agg(sizes).withColumn("run_id", F.lit("all")))
    return R.upsert(old, new)


@query(
    "sink_results",
    f"""SELECT * FROM (WITH {FREQUENT_BY_TAG} SELECT run_id, tag_name, tag, rollup, fi_type, itemset AS labels, k, freq, value, n FROM frequent)
    UNION ALL SELECT * FROM (WITH {HIGH_BY_TAG} SELECT run_id, tag_name, tag, rollup, fi_type, itemset, k, freq, value, n FROM hui)""",
)
def sink_results(spark: SparkSession, sf: str) -> DataFrame:
    """Written as JSON and read back, then written twice as versioned runs and read at their newest version."""
    json_path, table_path = new_path(spark, "json"), new_path(spark, "table")
    R.write_json(stored_results(spark, sf), json_path)
    rows = R.read_json(spark, json_path)
    headers = stored_headers(spark, sf)
    R.write_results(headers, rows, table_path, 0)
    R.write_results(headers.filter(F.col("tag").isNotNull()), rows.filter(F.col("tag").isNotNull()), table_path, 1)
    return _labels(R.read_results(spark, table_path).withColumnRenamed("itemset", "labels"))


RUN_HEADERS = f"""WITH {Q.CONFIDENCE}, {Q.META}, {Q.TAG_LIST},
sure AS (SELECT id FROM conf WHERE confidence > CAST(0.6 AS DOUBLE)),
sizes AS (SELECT '' AS tag, COUNT(*) AS n FROM sure UNION ALL SELECT t.tag, COUNT(*) FROM sure s JOIN tags t ON s.id = t.id GROUP BY t.tag),
kinds(fi_type, rollup, ending) AS (VALUES ('frequent', FALSE, 'Falsef'), ('frequent', TRUE, 'Truef'), ('hui', FALSE, 'hui')),
headers AS (
  SELECT LPAD(CAST(l.ix AS VARCHAR), 4, '0') || '-0.01-0.05-0.6-' || k.ending AS run_id, CASE WHEN l.tag IS NOT NULL THEN 'genres' END AS tag_name,
    l.tag, CAST(0.01 AS DOUBLE) AS minimum, CAST(0.05 AS DOUBLE) AS ratio, CAST(0.6 AS DOUBLE) AS confidence,
    CAST(COALESCE(z.n, 0) AS BIGINT) AS n, k.fi_type, k.rollup
  FROM taglist l CROSS JOIN kinds k LEFT JOIN sizes z ON z.tag = COALESCE(l.tag, ''))"""


@query("run_headers", f"{RUN_HEADERS} SELECT * FROM headers")
def run_headers(spark: SparkSession, sf: str) -> DataFrame:
    return stored_headers(spark, sf)


@query(
    "emptied_runs",
    f"""SELECT * FROM (WITH {FREQUENT_BY_TAG} SELECT run_id, tag, rollup, fi_type, itemset AS labels, k, freq, value, n FROM frequent
      WHERE tag IS NULL OR tag NOT LIKE '%e%')
    UNION ALL SELECT * FROM (WITH {HIGH_BY_TAG} SELECT run_id, tag, rollup, fi_type, itemset, k, freq, value, n FROM hui
      WHERE tag IS NULL OR tag NOT LIKE '%e%')""",
)
def emptied_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A second version of some runs finds nothing, and nothing of the first one is left."""
    path = new_path(spark, "emptied")
    headers, rows = stored_headers(spark, sf), stored_results(spark, sf)
    R.write_results(headers, rows, path, 0)
    R.write_results(headers.filter(F.col("tag").contains("e")), rows.limit(0), path, 1)
    return _labels(R.read_results(spark, path).withColumnRenamed("itemset", "labels")).drop("tag_name")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return D.basket_maps(spark, sf, "p_brand").select("_id", "items", "weights", F.sort_array(F.map_keys("items")).alias("names"))


@query(
    "decode_columnar",
    f"""WITH {Q.maps("p_brand")} SELECT id AS _id, item AS labels, weight AS freq, share AS value FROM baskets""",
)
def decode_columnar(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)

    def by_position(value) -> Column:
        return F.map_from_entries(F.transform("names", lambda n, i: F.struct(i.cast("string"), value(n))))

    text = R.as_json(
        by_position(lambda n: F.array(n)).alias("items"),
        by_position(lambda n: F.col("weights")[n]).alias("freq"),
        by_position(lambda n: F.col("items")[n]).alias("supportPc"),
    )
    return _labels(R.decode_columnar(docs.select("_id", text.alias("doc")), "doc", "_id"))


@query(
    "decode_rows",
    f"""WITH {Q.maps("p_brand")} SELECT id AS _id, item AS labels, share AS value FROM baskets""",
)
def decode_rows(spark: SparkSession, sf: str) -> DataFrame:
    entry = F.transform(
        "names", lambda n: F.struct(F.array(n).alias("itemset"), F.col("items")[n].alias("minUtil"))
    )
    return _labels(R.decode_rows(_documents(spark, sf).select("_id", F.to_json(entry).alias("doc")), "doc", "_id"))


def _sets(spark: SparkSession, sf: str, **request) -> DataFrame:
    return serve.served_sets(stored_results(spark, sf), **request)


@query(
    "served_sets_tagged",
    f"""{FREQUENT} SELECT tag, itemset AS labels, value FROM frequent WHERE rollup AND tag IN ('household', '1-URGENT')""",
)
def served_sets_tagged(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(_sets(spark, sf, tag_vals="household,1-URGENT", rollup=True))


@query(
    "served_sets_all",
    f"""WITH {HIGH_BY_TAG} SELECT tag, itemset AS labels, value FROM hui WHERE tag IS NULL""",
)
def served_sets_all(spark: SparkSession, sf: str) -> DataFrame:
    # Roll-up is asked for and must be ignored: high-utility sets exist without it only.
    return _labels(_sets(spark, sf, fi_type="hui", rollup=True))


@query("pairs_only", f"{FREQUENT} SELECT tag, itemset AS labels, value FROM frequent WHERE tag IS NULL AND NOT rollup AND k = 2")
def pairs_only(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(serve.pairs_only(_sets(spark, sf)))


@query("singletons", f"{FREQUENT} SELECT tag, itemset AS labels, value FROM frequent WHERE tag = 'building' AND NOT rollup AND k = 1")
def singletons(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(serve.singletons(_sets(spark, sf, tag_vals=["building"])))


@query("multiples", f"{FREQUENT} SELECT tag, itemset AS labels, value FROM frequent WHERE tag = 'building' AND rollup AND k > 1")
def multiples(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(serve.multiples(_sets(spark, sf, tag_vals=["building"], rollup=True)))


@query(
    "sets_above",
    f"""{FREQUENT} SELECT tag, itemset AS labels, value FROM frequent
    WHERE tag IN ('2-HIGH', '5-LOW') AND NOT rollup AND value > CAST(2 AS DOUBLE) / 100""",
)
def sets_above(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(serve.sets_above(_sets(spark, sf, tag_vals=["2-HIGH", "5-LOW"]), 2))


@query(
    "sets_touching",
    f"""{FREQUENT} SELECT tag, itemset AS labels, value FROM frequent
    WHERE tag IS NULL AND NOT rollup AND (',' || itemset || ',' LIKE '%,Brand#7,%' OR ',' || itemset || ',' LIKE '%,Brand#12,%')""",
)
def sets_touching(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(serve.sets_touching(_sets(spark, sf), ["Brand#7", "Brand#12"]))


SINGLES = f"""{FREQUENT}, {Q.BRAND_ORDER},
top AS (SELECT itemset AS label, MAX(value) AS value FROM frequent WHERE k = 1 AND NOT rollup AND tag IS NOT NULL GROUP BY 1)"""


@query("max_singleton", f"{SINGLES} SELECT label, value FROM top")
def max_singleton(spark: SparkSession, sf: str) -> DataFrame:
    return serve.max_singleton(_sets(spark, sf, tag_vals=D.TAGS))


# High-utility sets are over part types here, so of a domain of types and brands the brands are missing.
@query(
    "missing_singletons",
    f"""WITH {HIGH_BY_TAG},
    domain AS (SELECT DISTINCT p_type AS label FROM part UNION SELECT DISTINCT p_brand FROM part)
    SELECT label, CAST(0 AS DOUBLE) AS value FROM domain
    WHERE label NOT IN (SELECT itemset FROM hui WHERE k = 1 AND tag IS NULL)""",
)
def missing_singletons(spark: SparkSession, sf: str) -> DataFrame:
    parts = D.table(spark, sf, "part")
    domain = parts.select(F.explode(F.array("p_type", "p_brand")).alias("node")).distinct()
    return serve.missing_singletons(_sets(spark, sf, fi_type="hui"), domain)


@query(
    "order_support",
    f"""{SINGLES}, dom AS (SELECT o.node, COALESCE(t.value, 0) AS value FROM ord o LEFT JOIN top t ON o.node = t.label)
    SELECT node, CAST(ROW_NUMBER() OVER (ORDER BY value DESC, node) - 1 AS INTEGER) AS pos FROM dom""",
)
def order_support(spark: SparkSession, sf: str) -> DataFrame:
    return serve.order_support(_sets(spark, sf, tag_vals=D.TAGS), brand_order(spark))


@query(
    "order_root",
    """WITH nodes AS (SELECT DISTINCT p_brand AS node, CAST(SUBSTR(p_brand, 7) AS INTEGER) - 1 AS num FROM part)
    SELECT node, CAST(ROW_NUMBER() OVER (ORDER BY num // 5, num % 5) - 1 AS INTEGER) AS pos FROM nodes""",
)
def order_root(spark: SparkSession, sf: str) -> DataFrame:
    nodes = D.table(spark, sf, "part").select(F.col("p_brand").alias("node")).distinct()
    number = F.substring("node", 7, 4).cast("int") - 1
    return serve.order_by_rank(nodes, F.floor(number / 5), number % 5)


SORTED = """
long AS (SELECT f.tag, f.itemset, f.value, UNNEST(STRING_SPLIT(f.itemset, ',')) AS node FROM chosen f),
sorted AS (
  SELECT l.tag, STRING_AGG(l.node, ',' ORDER BY o.pos) AS labels, STRING_AGG(CAST(o.pos AS VARCHAR), ',' ORDER BY o.pos) AS positions,
    l.value FROM long l JOIN ord o ON l.node = o.node GROUP BY l.tag, l.itemset, l.value)"""


def _positions(sets: DataFrame) -> DataFrame:
    return _labels(sets).withColumn("positions", F.array_join(F.transform("positions", lambda p: p.cast("string")), ","))


@query(
    "sets_ordered",
    f"""{FREQUENT}, {Q.BRAND_ORDER}, chosen AS (SELECT * FROM frequent WHERE tag IS NULL AND NOT rollup), {SORTED}
    SELECT * FROM sorted""",
)
def sets_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return _positions(serve.sets_ordered(_sets(spark, sf), brand_order(spark)))


@query(
    "sets_json",
    f"""{FREQUENT} SELECT '{{"labels":["' || REPLACE(itemset, ',', '","') || '"],"values":' AS head,
      CASE WHEN tag IS NULL THEN ',"tag":null}}' ELSE ',"tag":"' || tag || '"}}' END AS tail, value
    FROM frequent WHERE NOT rollup AND tag = 'furniture'""",
)
def sets_json(spark: SparkSession, sf: str) -> DataFrame:
    # Numbers print differently in the two engines, so the text is compared around the number and the number by value.
    texts = serve.sets_json(_sets(spark, sf, tag_vals="furniture"))
    number = F.regexp_extract("json", r'"values":([^,]+),', 1)
    return texts.select(
        F.regexp_extract("json", r'^(.*"values":)', 1).alias("head"),
        F.regexp_extract("json", r'(,"tag":[^,]*\})$', 1).alias("tail"),
        number.cast("double").alias("value"),
    )


@query(
    "serve_circular",
    f"""{FREQUENT}, {Q.BRAND_ORDER}
    SELECT f.tag, f.itemset AS labels, f.value, a.pos AS pos_a, b.pos AS pos_b FROM frequent f
      JOIN ord a ON a.node = SPLIT_PART(f.itemset, ',', 1) JOIN ord b ON b.node = SPLIT_PART(f.itemset, ',', 2)
    WHERE f.k = 2 AND NOT f.rollup AND f.tag IN ('machinery', '3-MEDIUM')""",
)
def serve_circular(spark: SparkSession, sf: str) -> DataFrame:
    return _with_ends(*serve.serve_circular(stored_results(spark, sf), brand_order(spark), tag_vals="machinery,3-MEDIUM"))


@query(
    "serve_circular_default",
    f"""{FREQUENT}, {Q.BRAND_ORDER}
    SELECT f.tag, f.itemset AS labels, f.value, a.pos AS pos_a, b.pos AS pos_b FROM frequent f
      JOIN ord a ON a.node = SPLIT_PART(f.itemset, ',', 1) JOIN ord b ON b.node = SPLIT_PART(f.itemset, ',', 2)
    WHERE f.k = 2 AND NOT f.rollup AND f.tag IS NULL""",
)
def serve_circular_default(spark: SparkSession, sf: str) -> DataFrame:
    return _with_ends(*serve.serve_circular(stored_results(spark, sf), brand_order(spark)))


def _with_ends(sets: DataFrame, order: DataFrame) -> DataFrame:
    first = order.select(F.col("node").alias("_a"), F.col("pos").alias("pos_a"))
    second = order.select(F.col("node").alias("_b"), F.col("pos").alias("pos_b"))
    rows = sets.withColumn("_a", F.col("labels")[0]).withColumn("_b", F.col("labels")[1])
    return _labels(rows.join(first, "_a").join(second, "_b").drop("_a", "_b"))


@query(
    "serve_hier",
    f"""{FREQUENT}, ord(node, pos) AS (VALUES {", ".join(f"('{p}', {i})" for i, p in enumerate(D.PARENTS))})
    SELECT f.tag, f.itemset AS labels, f.value, a.pos AS pos_a, b.pos AS pos_b FROM frequent f
      JOIN ord a ON a.node = SPLIT_PART(f.itemset, ',', 1) JOIN ord b ON b.node = SPLIT_PART(f.itemset, ',', 2)
    WHERE f.k = 2 AND f.rollup AND f.tag IS NULL""",
)
def serve_hier(spark: SparkSession, sf: str) -> DataFrame:
    return _with_ends(*serve.serve_hier(stored_results(spark, sf), parent_order(spark), rollup=True))


@query(
    "serve_parallel",
    f"""{FREQUENT},
    top AS (SELECT itemset AS label, MAX(value) AS value FROM frequent WHERE k = 1 AND NOT rollup AND tag IN ('household', '4-NOT SPECIFIED') GROUP BY 1),
    dom(node, i) AS (VALUES {", ".join(f"('{b}', {i})" for i, b in enumerate(D.BRANDS))}),
    ord AS (SELECT d.node, ROW_NUMBER() OVER (ORDER BY COALESCE(t.value, 0) DESC, d.node) - 1 AS pos FROM dom d LEFT JOIN top t ON d.node = t.label),
    chosen AS (SELECT * FROM frequent WHERE k > 1 AND NOT rollup AND tag IN ('household', '4-NOT SPECIFIED')), {SORTED}
    SELECT * FROM sorted""",
)
def serve_parallel(spark: SparkSession, sf: str) -> DataFrame:
    sets, _ = serve.serve_parallel(
        stored_results(spark, sf), brand_order(spark), by_support=True, tag_vals=["household", "4-NOT SPECIFIED"]
    )
    return _positions(sets)


# One graph of all requested tags, its order by degrees and local adjusting, and angles by the number of its nodes.
ADJUSTED_ANGLE = "CAST({} AS DOUBLE) / (SELECT COUNT(*) FROM adjusted) * (2 * PI())"
REQUESTED = f"""WITH RECURSIVE {FREQUENT_BY_TAG},
pairs AS (
  SELECT 'all' AS graph_id, tag, value, SPLIT_PART(itemset, ',', 1) AS u, SPLIT_PART(itemset, ',', 2) AS v
  FROM frequent WHERE k = 2 AND NOT rollup AND tag IN ('household', '1-URGENT')),
ends AS (SELECT graph_id, u AS node FROM pairs UNION ALL SELECT graph_id, v FROM pairs){adjusted(AVSDF)},
turned AS (
  SELECT p.graph_id AS g, p.tag, p.value, p.u, p.v, a.pos AS pu, b.pos AS pv,
    ROUND(SIN({ADJUSTED_ANGLE.format("a.pos")}), 12) AS ku, ROUND(SIN({ADJUSTED_ANGLE.format("b.pos")}), 12) AS kv
  FROM pairs p JOIN adjusted a ON p.u = a.node JOIN adjusted b ON p.v = b.node),
features AS (
  SELECT g, tag, value, CASE WHEN straight THEN u ELSE v END AS a, CASE WHEN straight THEN v ELSE u END AS b,
    CASE WHEN straight THEN pu ELSE pv END AS pos1, CASE WHEN straight THEN pv ELSE pu END AS pos2
  FROM (SELECT *, ku < kv OR (ku = kv AND pu < pv) AS straight FROM turned))"""


@query(
    "serve_circ_clust",
    f"""{REQUESTED}, {pair_points_sql("g, ", ADJUSTED_ANGLE)}, {Q.ward("points", "g", ["pos1", "pos2"], UNIT_FEATURES, C.PAIR_HEIGHT * C.UNITS)}
    SELECT f.tag, f.a, f.b, f.value, f.pos1, f.pos2, {rounded_sql(ADJUSTED_ANGLE)}, w.cluster
    FROM features f JOIN ward w ON f.pos1 = w.pos1 AND f.pos2 = w.pos2""",
)
def serve_circ_clust(spark: SparkSession, sf: str) -> DataFrame:
    sets, _ = serve.serve_circ_clust(stored_results(spark, sf), brand_order(spark), order_opt="avsdf_la", tag_vals="household,1-URGENT")
    return rounded(sets)


# Without arguments a request asks for the sets of the whole collection, in the default order.
WHOLE = f"""WITH RECURSIVE {FREQUENT_BY_TAG}, {Q.BRAND_ORDER},
pairs AS (
  SELECT 'all' AS g, a.pos AS pu, b.pos AS pv, a.node AS u, b.node AS v, f.value,
    ROUND(SIN(CAST(a.pos AS DOUBLE) / 25 * (2 * PI())), 12) AS ku, ROUND(SIN(CAST(b.pos AS DOUBLE) / 25 * (2 * PI())), 12) AS kv
  FROM frequent f JOIN ord a ON a.node = SPLIT_PART(f.itemset, ',', 1) JOIN ord b ON b.node = SPLIT_PART(f.itemset, ',', 2)
  WHERE f.k = 2 AND NOT f.rollup AND f.tag IS NULL),
features AS (
  SELECT g, value, CASE WHEN straight THEN u ELSE v END AS a, CASE WHEN straight THEN v ELSE u END AS b,
    CASE WHEN straight THEN pu ELSE pv END AS pos1, CASE WHEN straight THEN pv ELSE pu END AS pos2
  FROM (SELECT *, ku < kv OR (ku = kv AND pu < pv) AS straight FROM pairs))"""


@query(
    "serve_circ_clust_default",
    f"""{WHOLE}, {pair_points_sql("g, ")}, {Q.ward("points", "g", ["pos1", "pos2"], UNIT_FEATURES, C.PAIR_HEIGHT * C.UNITS)}
    SELECT CAST(NULL AS VARCHAR) AS tag, f.a, f.b, f.value, f.pos1, f.pos2, {ROUNDED}, w.cluster
    FROM features f JOIN ward w ON f.pos1 = w.pos1 AND f.pos2 = w.pos2""",
)
def serve_circ_clust_default(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(serve.serve_circ_clust(stored_results(spark, sf), brand_order(spark))[0])


@query(
    "serve_circular_ordered",
    f"""{REQUESTED}
    SELECT p.tag, p.u || ',' || p.v AS labels, p.value, CAST(a.pos AS INTEGER) AS pos_a, CAST(b.pos AS INTEGER) AS pos_b
    FROM pairs p JOIN adjusted a ON p.u = a.node JOIN adjusted b ON p.v = b.node""",
)
def serve_circular_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """The circular chart in an order computed from the requested pairs."""
    return _with_ends(*serve.serve_circular(stored_results(spark, sf), brand_order(spark), order_opt="avsdf_la", tag_vals="household,1-URGENT"))


@query(
    "serve_parallel_clust",
    f"""WITH RECURSIVE {FREQUENT_BY_TAG},
    top AS (SELECT itemset AS label, MAX(value) AS value FROM frequent WHERE k = 1 AND NOT rollup AND tag IS NULL GROUP BY 1),
    dom(node, i) AS (VALUES {", ".join(f"('{b}', {i})" for i, b in enumerate(D.BRANDS))}),
    ord AS (SELECT d.node, ROW_NUMBER() OVER (ORDER BY COALESCE(t.value, 0) DESC, d.node) - 1 AS pos FROM dom d LEFT JOIN top t ON d.node = t.label),
    long AS (SELECT f.itemset, f.value, UNNEST(STRING_SPLIT(f.itemset, ',')) AS node FROM frequent f WHERE k > 1 AND NOT rollup AND tag IS NULL),
    places AS (
      SELECT l.itemset, l.value, o.pos, o.node, ROW_NUMBER() OVER (PARTITION BY l.itemset ORDER BY o.pos) - 1 AS axis
      FROM long l JOIN ord o ON l.node = o.node),
    steps AS (SELECT *, LEAD(pos) OVER (PARTITION BY itemset ORDER BY axis) AS tgt FROM places),
    segments AS (SELECT itemset, value, axis, pos AS src, tgt FROM steps WHERE tgt IS NOT NULL), {AXIS_CLUSTERS},
    named AS (SELECT itemset, STRING_AGG(node, ',' ORDER BY pos) AS labels FROM places GROUP BY 1)
    SELECT CAST(NULL AS VARCHAR) AS tag, n.labels, ANY_VALUE(c.value) AS value,
      STRING_AGG(COALESCE(CAST(c.cluster AS VARCHAR), 'NULL'), ',' ORDER BY c.axis) AS km_label
    FROM clustered c JOIN named n ON c.itemset = n.itemset GROUP BY n.labels""",
)
def serve_parallel_clust(spark: SparkSession, sf: str) -> DataFrame:
    sets, _ = serve.serve_parallel_clust(stored_results(spark, sf), brand_order(spark), by_support=True)
    return _labels(sets).withColumn("km_label", F.array_join(F.transform("km_label", lambda x: x.cast("string")), ",", "NULL"))


FOUND = f"""WITH {Q.maps("p_type")}, {Q.META},
hits AS (
  SELECT m.* FROM meta m WHERE 'household' IN (m.g1, m.g2) AND m.id IN (
    SELECT id FROM baskets WHERE item IN ('PROMO', 'LARGE') AND share > CAST(0.05 AS DOUBLE) GROUP BY id HAVING COUNT(*) = 2)),
sample AS (SELECT * FROM hits ORDER BY MD5('s1' || CAST(id AS VARCHAR)) LIMIT 5)"""


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return serve.search_tracks(
        D.metadata(spark, sf), D.tracks(spark, sf, "p_type"), seed="s1", tag_vals="household", items=["PROMO", "LARGE"]
    )


@query(
    "search_tracks",
    f"""{FOUND} SELECT s.id AS _id, s.name, STRING_AGG(b.item, ',' ORDER BY b.share DESC, b.item) AS labels, MAX(b.share) AS top_share
    FROM sample s JOIN baskets b ON s.id = b.id GROUP BY s.id, s.name""",
)
def search_tracks(spark: SparkSession, sf: str) -> DataFrame:
    found = _found(spark, sf)
    return found.select("_id", "name", item_text(F.col("labels")).alias("labels"), F.array_max("shares").alias("top_share"))


@query(
    "matching_tracks",
    f"""{FOUND} SELECT id AS _id, name, artist_name FROM hits""",
)
def matching_tracks(spark: SparkSession, sf: str) -> DataFrame:
    found = serve.matching_tracks(
        D.metadata(spark, sf), D.tracks(spark, sf, "p_type"), tag_vals="household", items=["PROMO", "LARGE"]
    )
    return found.select("_id", "name", "artist_name")


@query("sample_tracks", f"WITH {Q.META} SELECT _id, name FROM meta ORDER BY MD5('s2' || _id) LIMIT 5")
def sample_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return serve.sample_tracks(D.metadata(spark, sf), seed="s2").select("_id", "name")


@query(
    "track_table",
    f"""{FOUND}, top AS (SELECT id, MAX(share) AS top FROM baskets GROUP BY id)
    SELECT s.id AS _id, REGEXP_REPLACE(s.name, '&amp;', '&') AS name, REGEXP_REPLACE(s.artist_name, '&amp;', '&') AS artist_name,
      UPPER(SUBSTR(s.g1, 1, 1)) || SUBSTR(s.g1, 2) || ', ' || UPPER(SUBSTR(s.g2, 1, 1)) || SUBSTR(s.g2, 2) AS tags,
      b.item AS label, b.share / t.top AS relative
    FROM sample s JOIN baskets b ON s.id = b.id JOIN top t ON s.id = t.id""",
)
def track_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = serve.track_table(_found(spark, sf)).withColumn("z", F.explode(F.arrays_zip("labels", "relative")))
    return rows.select("_id", "name", "artist_name", "tags", F.col("z.labels").alias("label"), F.col("z.relative").alias("relative"))


@query(
    "search_tracks_any",
    f"""WITH {Q.maps("p_type")}, {Q.META}, sample AS (SELECT * FROM meta ORDER BY MD5('s2' || CAST(id AS VARCHAR)) LIMIT 5)
    SELECT CAST(s.id AS BIGINT) AS _id, s.name,
      (SELECT STRING_AGG(b.item, ',' ORDER BY b.share DESC, b.item) FROM baskets b WHERE b.id = s.id) AS labels FROM sample s""",
)
def search_tracks_any(spark: SparkSession, sf: str) -> DataFrame:
    """A request without tags and items samples the whole collection."""
    found = serve.search_tracks(D.metadata(spark, sf), D.tracks(spark, sf, "p_type"), seed="s2")
    return found.select(F.col("_id").cast("bigint").alias("_id"), "name", item_text(F.col("labels")).alias("labels"))
