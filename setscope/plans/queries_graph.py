"""Queries of pair graphs, orders, clusters and the sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setscope.functions.tables import materialise
from setscope.operators import cluster as C
from setscope.operators import graph as G
from setscope.operators import ordering as O
from setscope.operators import stats as T
from setscope.plans import fragments as Q
from setscope.plans import serve
from setscope.plans import sweep as W
from setscope.plans.catalogue import query
from setscope.plans.queries_utility import FREQUENT_BY_TAG
from setscope.plans.stored import brand_order, pair_graphs, stored_results

PAIRS = f"""WITH {FREQUENT_BY_TAG}, {Q.BRAND_ORDER},
pairs AS (
  SELECT COALESCE(tag, 'all') AS graph_id, SPLIT_PART(itemset, ',', 1) AS u, SPLIT_PART(itemset, ',', 2) AS v, value,
    CAST(SUBSTR(SPLIT_PART(itemset, ',', 1), 7) AS BIGINT) * 100 + CAST(SUBSTR(SPLIT_PART(itemset, ',', 2), 7) AS BIGINT) AS edge_id
  FROM frequent WHERE k = 2 AND NOT rollup),
ends AS (SELECT graph_id, edge_id, u AS node FROM pairs UNION ALL SELECT graph_id, edge_id, v FROM pairs)"""
PLACED = f"""{PAIRS},
placed AS (
  SELECT p.*, LEAST(a.pos, b.pos) AS s, GREATEST(a.pos, b.pos) AS t, a.pos AS pos_u, b.pos AS pos_v
  FROM pairs p JOIN ord a ON p.u = a.node JOIN ord b ON p.v = b.node)"""
CROSS = "a.graph_id = b.graph_id AND a.s < b.s AND b.s < a.t AND a.t < b.t"
PER_EDGE = f"""{PLACED},
crossed AS (
  SELECT graph_id, edge_id, COUNT(*) AS crossings FROM (
    SELECT a.graph_id, UNNEST([a.edge_id, b.edge_id]) AS edge_id FROM placed a JOIN placed b ON {CROSS}) GROUP BY 1, 2),
per_edge AS (
  SELECT p.graph_id, p.edge_id, p.u, p.v, COALESCE(c.crossings, 0) AS crossings
  FROM placed p LEFT JOIN crossed c ON p.graph_id = c.graph_id AND p.edge_id = c.edge_id)"""


def placed(spark: SparkSession, sf: str) -> DataFrame:
    return G.edge_positions(pair_graphs(spark, sf), brand_order(spark))


@query("edge_positions", f"{PLACED} SELECT graph_id, edge_id, u, v, value, pos_u, pos_v, s, t FROM placed")
def edge_positions(spark: SparkSession, sf: str) -> DataFrame:
    return placed(spark, sf)


@query(
    "unknown_nodes",
    f"""{PAIRS} SELECT node, COUNT(*) AS edges FROM ends WHERE node NOT IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY node""",
)
def unknown_nodes(spark: SparkSession, sf: str) -> DataFrame:
    order = brand_order(spark).filter(F.col("node").isin("Brand#1", "Brand#2", "Brand#3"))
    return G.unknown_nodes(pair_graphs(spark, sf), order)


@query(
    "node_degree",
    f"""{PAIRS}, d AS (SELECT graph_id, node, COUNT(*) AS degree FROM ends GROUP BY 1, 2)
    SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY graph_id ORDER BY degree, node) AS INTEGER) AS rank FROM d""",
)
def node_degree(spark: SparkSession, sf: str) -> DataFrame:
    return G.node_degree(pair_graphs(spark, sf))


@query(
    "adjacency",
    f"""{PAIRS} SELECT graph_id, u AS node, v AS neighbour FROM pairs UNION SELECT graph_id, v, u FROM pairs
    UNION SELECT graph_id, node, node FROM ends""",
)
def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return G.adjacency(pair_graphs(spark, sf))


@query("incident_edges", f"{PAIRS} SELECT graph_id, node, edge_id FROM ends")
def incident_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.incident_edges(pair_graphs(spark, sf))


@query(
    "graph_density",
    f"""{PAIRS} SELECT graph_id, COUNT(*) AS edges, CAST(COUNT(*) AS DOUBLE) / CAST(25 * 24 / 2 AS DOUBLE) AS density
    FROM pairs GROUP BY 1""",
)
def graph_density(spark: SparkSession, sf: str) -> DataFrame:
    return G.graph_density(pair_graphs(spark, sf), brand_order(spark).count())


@query(
    "crossings_total",
    f"""{PLACED}, c AS (SELECT a.graph_id, COUNT(*) AS crossings FROM placed a JOIN placed b ON {CROSS} GROUP BY 1)
    SELECT g.graph_id, COALESCE(c.crossings, 0) AS crossings FROM (SELECT DISTINCT graph_id FROM pairs) g
      LEFT JOIN c ON g.graph_id = c.graph_id""",
)
def crossings_total(spark: SparkSession, sf: str) -> DataFrame:
    return G.crossings_total(placed(spark, sf))


@query("crossings_per_edge", f"{PER_EDGE} SELECT * FROM per_edge")
def crossings_per_edge(spark: SparkSession, sf: str) -> DataFrame:
    return G.crossings_per_edge(placed(spark, sf))


@query(
    "crossings_per_node",
    f"""{PER_EDGE},
    per_node AS (
      SELECT graph_id, node, CAST(SUM(crossings) AS BIGINT) AS crossings FROM (
        SELECT graph_id, u AS node, crossings FROM per_edge UNION ALL SELECT graph_id, v, crossings FROM per_edge) GROUP BY 1, 2)
    SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY graph_id ORDER BY crossings DESC, node) AS INTEGER) AS rank FROM per_node""",
)
def crossings_per_node(spark: SparkSession, sf: str) -> DataFrame:
    return G.crossings_per_node(placed(spark, sf))


SWAP = f"""{PLACED},
swaps AS (SELECT graph_id, u AS node, v AS neighbour FROM pairs UNION SELECT graph_id, v, u FROM pairs),
old_node AS (
  SELECT graph_id, node, SUM(n) AS crossings FROM (
    SELECT a.graph_id, UNNEST([a.u, a.v, b.u, b.v]) AS node, 1 AS n FROM placed a JOIN placed b ON {CROSS}) GROUP BY 1, 2),
moved AS (
  SELECT w.graph_id, w.node, w.neighbour, p.edge_id, p.u = w.node OR p.v = w.node AS mine,
    CASE p.u WHEN w.node THEN y.pos WHEN w.neighbour THEN x.pos ELSE p.pos_u END AS pu,
    CASE p.v WHEN w.node THEN y.pos WHEN w.neighbour THEN x.pos ELSE p.pos_v END AS pv
  FROM swaps w JOIN placed p ON w.graph_id = p.graph_id JOIN ord x ON w.node = x.node JOIN ord y ON w.neighbour = y.node),
m AS (SELECT graph_id, node, neighbour, edge_id, mine, LEAST(pu, pv) AS s, GREATEST(pu, pv) AS t FROM moved),
new_node AS (
  SELECT a.graph_id, a.node, a.neighbour, COUNT(*) AS crossings FROM m a JOIN m b
    ON a.graph_id = b.graph_id AND a.node = b.node AND a.neighbour = b.neighbour AND a.mine
      AND ((a.s < b.s AND b.s < a.t AND a.t < b.t) OR (b.s < a.s AND a.s < b.t AND b.t < a.t))
  GROUP BY 1, 2, 3)
SELECT w.graph_id, w.node, w.neighbour, CAST(COALESCE(o.crossings, 0) AS BIGINT) AS old_crossings,
  CAST(COALESCE(c.crossings, 0) AS BIGINT) AS new_crossings
FROM swaps w LEFT JOIN old_node o ON w.graph_id = o.graph_id AND w.node = o.node
  LEFT JOIN new_node c ON w.graph_id = c.graph_id AND w.node = c.node AND w.neighbour = c.neighbour"""


@query("swap_gain", SWAP)
def swap_gain(spark: SparkSession, sf: str) -> DataFrame:
    return G.swap_gain(pair_graphs(spark, sf), brand_order(spark))


def _ordered(spark: SparkSession, sf: str, method: str) -> DataFrame:
    return serve.choose_order(pair_graphs(spark, sf), brand_order(spark), method)


# Depth-first placement with an explicit stack. All nodes start on it, smallest degree on top, which also restarts components.
RECURSIVE_PAIRS = PAIRS.replace("WITH ", "WITH RECURSIVE ", 1)
AVSDF = """,
degrees AS (SELECT graph_id, node, COUNT(*) AS degree FROM ends GROUP BY 1, 2),
near AS (SELECT graph_id, u AS node, v AS neighbour FROM pairs UNION SELECT graph_id, v, u FROM pairs),
next_nodes AS (
  SELECT n.graph_id, n.node, LIST(n.neighbour ORDER BY d.degree DESC, n.neighbour DESC) AS pushed
  FROM near n JOIN degrees d ON n.graph_id = d.graph_id AND n.neighbour = d.node GROUP BY 1, 2),
walk AS (
  SELECT graph_id, LIST(node ORDER BY degree DESC, node DESC) AS stack, CAST([] AS VARCHAR[]) AS placed FROM degrees GROUP BY 1
  UNION ALL
  SELECT w.graph_id,
    CASE WHEN LIST_CONTAINS(w.placed, w.stack[-1]) THEN w.stack[:-2] ELSE LIST_CONCAT(w.stack[:-2], x.pushed) END,
    CASE WHEN LIST_CONTAINS(w.placed, w.stack[-1]) THEN w.placed ELSE LIST_APPEND(w.placed, w.stack[-1]) END
  FROM walk w JOIN next_nodes x ON w.graph_id = x.graph_id AND x.node = w.stack[-1]),
done AS (SELECT graph_id, placed FROM walk WHERE LEN(stack) = 0)
SELECT graph_id, UNNEST(placed) AS node, CAST(UNNEST(RANGE(0, LEN(placed))) AS INTEGER) AS pos FROM done"""


@query("order_avsdf", RECURSIVE_PAIRS + AVSDF)
def order_avsdf(spark: SparkSession, sf: str) -> DataFrame:
    return _ordered(spark, sf, "avsdf")


def adjusted(base: str) -> str:
    """``adjusted(graph_id, node, pos)`` of ``placed_by(graph_id, node, pos)``: one node after another by falling crossings, each traded
    with the neighbour that leaves fewest crossings in all, if these are fewer; every trial counts all pairs of edges. ``base`` ends with
    the rows of ``placed_by``; goes behind WITH RECURSIVE."""
    with_steps, _, rows = base.rpartition("SELECT ")
    places = "LEAST(a.pos, b.pos) AS s, GREATEST(a.pos, b.pos) AS t"
    return f"""{with_steps.rstrip().rstrip(",")},
placed_by AS (SELECT {rows}),
chords AS (
  SELECT p.graph_id, p.u, p.v, {places} FROM pairs p JOIN placed_by a ON p.graph_id = a.graph_id AND p.u = a.node
    JOIN placed_by b ON p.graph_id = b.graph_id AND p.v = b.node),
loads AS (
  SELECT graph_id, node, COUNT(*) AS n FROM (
    SELECT a.graph_id, UNNEST([a.u, a.v, b.u, b.v]) AS node FROM chords a JOIN chords b ON {CROSS}) GROUP BY 1, 2),
queue AS (
  SELECT p.graph_id, p.node, ROW_NUMBER() OVER (PARTITION BY p.graph_id ORDER BY COALESCE(l.n, 0) DESC, p.node) AS turn
  FROM placed_by p LEFT JOIN loads l ON p.graph_id = l.graph_id AND p.node = l.node),
la AS (
  SELECT 1 AS turn, graph_id, node, CAST(pos AS BIGINT) AS pos FROM placed_by
  UNION ALL
  (WITH mine AS (SELECT l.graph_id, l.node, l.pos FROM la l JOIN queue q ON l.graph_id = q.graph_id AND l.node = q.node AND l.turn = q.turn),
  trials AS (
    SELECT DISTINCT m.graph_id, m.pos AS here, l.pos AS there FROM mine m JOIN la l ON m.graph_id = l.graph_id
      JOIN pairs p ON p.graph_id = m.graph_id AND ((p.u = m.node AND p.v = l.node) OR (p.v = m.node AND p.u = l.node))
    UNION ALL SELECT graph_id, pos, -1 FROM mine),
  ends AS (
    SELECT t.graph_id, t.there, CASE a.pos WHEN t.here THEN CASE t.there WHEN -1 THEN t.here ELSE t.there END WHEN t.there THEN t.here ELSE a.pos END AS x,
      CASE b.pos WHEN t.here THEN CASE t.there WHEN -1 THEN t.here ELSE t.there END WHEN t.there THEN t.here ELSE b.pos END AS y
    FROM trials t JOIN pairs p ON t.graph_id = p.graph_id JOIN la a ON a.graph_id = p.graph_id AND a.node = p.u
      JOIN la b ON b.graph_id = p.graph_id AND b.node = p.v),
  laid AS (SELECT graph_id, there, LEAST(x, y) AS s, GREATEST(x, y) AS t FROM ends),
  counts AS (
    SELECT z.graph_id, z.there, z.here, COALESCE(c.n, 0) AS n FROM trials z LEFT JOIN (
      SELECT a.graph_id, a.there, COUNT(*) AS n FROM laid a JOIN laid b
        ON a.graph_id = b.graph_id AND a.there = b.there AND a.s < b.s AND b.s < a.t AND a.t < b.t GROUP BY 1, 2) c
      ON z.graph_id = c.graph_id AND z.there = c.there),
  best AS (SELECT graph_id, here, there FROM counts QUALIFY ROW_NUMBER() OVER (PARTITION BY graph_id ORDER BY n, there) = 1)
  SELECT l.turn + 1, l.graph_id, l.node,
    CASE WHEN b.there = -1 THEN l.pos WHEN l.pos = b.here THEN b.there WHEN l.pos = b.there THEN b.here ELSE l.pos END
  FROM la l JOIN best b ON l.graph_id = b.graph_id)),
adjusted AS (
  SELECT graph_id, node, CAST(pos AS INTEGER) AS pos FROM la QUALIFY turn = MAX(turn) OVER (PARTITION BY graph_id))"""


@query("order_avsdf_la", f"{RECURSIVE_PAIRS}{adjusted(AVSDF)} SELECT * FROM adjusted")
def order_avsdf_la(spark: SparkSession, sf: str) -> DataFrame:
    return _ordered(spark, sf, "avsdf_la")


# One placement per step. Nodes are numbered by (degree, label); near[i + 1] lists the neighbours of node i, once for each edge.
BAUR_BRANDES = """,
degrees AS (SELECT graph_id, node, COUNT(*) AS degree FROM ends GROUP BY 1, 2),
ranks AS (SELECT graph_id, node, ROW_NUMBER() OVER (PARTITION BY graph_id ORDER BY degree, node) - 1 AS i FROM degrees),
links AS (SELECT graph_id, u, v FROM pairs UNION ALL SELECT graph_id, v, u FROM pairs),
lists AS (
  SELECT a.graph_id, a.i, LIST(b.i) AS near FROM links l JOIN ranks a ON l.graph_id = a.graph_id AND l.u = a.node
    JOIN ranks b ON l.graph_id = b.graph_id AND l.v = b.node GROUP BY 1, 2),
graphs AS (SELECT graph_id, LIST(near ORDER BY i) AS near, COUNT(*) AS n FROM lists GROUP BY 1),
walk AS (
  SELECT graph_id, near, n, [n - 1] AS placed, RANGE(0, n - 1) AS free FROM graphs
  UNION ALL
  SELECT graph_id, near, n, CASE WHEN r < l THEN LIST_APPEND(placed, node) ELSE LIST_PREPEND(node, placed) END,
    LIST_FILTER(free, LAMBDA y: y <> node)
  FROM (
    SELECT *,
      LIST_SUM(LIST_TRANSFORM(RANGE(1, LEN(placed) + 1), LAMBDA k: closing[k] * COALESCE(LIST_SUM(still[:k - 1]), 0))) AS l,
      LIST_SUM(LIST_TRANSFORM(RANGE(1, LEN(placed) + 1), LAMBDA k: closing[k] * COALESCE(LIST_SUM(still[k + 1:]), 0))) AS r
    FROM (
      SELECT *, LIST_TRANSFORM(placed, LAMBDA v: LEN(LIST_FILTER(near[v + 1], LAMBDA y: y = node))) AS closing,
        LIST_TRANSFORM(placed, LAMBDA v: LEN(LIST_FILTER(near[v + 1], LAMBDA y: y <> node AND LIST_CONTAINS(free, y)))) AS still
      FROM (
        SELECT *, LIST_MIN(LIST_TRANSFORM(free, LAMBDA x:
          LEN(LIST_FILTER(LIST_DISTINCT(near[x + 1]), LAMBDA y: LIST_CONTAINS(free, y))) * 1000 + x)) % 1000 AS node
        FROM walk WHERE LEN(free) > 0)))),
done AS (
  SELECT graph_id, UNNEST(placed) AS i, CAST(UNNEST(RANGE(0, LEN(placed))) AS INTEGER) AS pos FROM walk WHERE LEN(free) = 0)
SELECT d.graph_id, k.node, d.pos FROM done d JOIN ranks k ON d.graph_id = k.graph_id AND d.i = k.i"""


@query("order_bb", RECURSIVE_PAIRS + BAUR_BRANDES)
def order_bb(spark: SparkSession, sf: str) -> DataFrame:
    return _ordered(spark, sf, "bb")


@query("order_bb_la", f"{RECURSIVE_PAIRS}{adjusted(BAUR_BRANDES)} SELECT * FROM adjusted")
def order_bb_la(spark: SparkSession, sf: str) -> DataFrame:
    return _ordered(spark, sf, "bb_la")


@query(
    "order_default",
    f"""{PAIRS} SELECT g.graph_id, o.node, o.pos FROM (SELECT DISTINCT graph_id FROM pairs) g JOIN ord o ON TRUE""",
)
def order_default(spark: SparkSession, sf: str) -> DataFrame:
    return serve.choose_order(pair_graphs(spark, sf), brand_order(spark))


ANGLE = "CAST({} AS DOUBLE) / 25 * (2 * PI())"
FEATURES = f"""{PAIRS},
f AS (
  SELECT p.graph_id, p.value, p.u, p.v, a.pos AS pu, b.pos AS pv,
    ROUND(SIN({ANGLE.format("a.pos")}), 12) AS ku, ROUND(SIN({ANGLE.format("b.pos")}), 12) AS kv
  FROM pairs p JOIN ord a ON p.u = a.node JOIN ord b ON p.v = b.node WHERE p.graph_id <> 'all'),
g AS (
  SELECT graph_id AS tag, value, ku < kv OR (ku = kv AND pu < pv) AS straight, u, v, pu, pv FROM f),
features AS (
  SELECT tag, value, CASE WHEN straight THEN u ELSE v END AS a, CASE WHEN straight THEN v ELSE u END AS b,
    CASE WHEN straight THEN pu ELSE pv END AS pos1, CASE WHEN straight THEN pv ELSE pu END AS pos2 FROM g)"""


def tagged_pairs(spark: SparkSession, sf: str) -> DataFrame:
    sets = stored_results(spark, sf).filter((F.col("fi_type") == "frequent") & ~F.col("rollup") & F.col("tag").isNotNull())
    return serve.pairs_only(sets.select("tag", F.col("itemset").alias("labels"), "value"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return C.pair_features(tagged_pairs(spark, sf), brand_order(spark))


def rounded(rows: DataFrame) -> DataFrame:
    for name in C.FEATURES:
        # Adding zero turns a negative zero into zero.
        rows = rows.withColumn(name, F.round(name, 9) + F.lit(0.0))
    return rows


@query(
    "pair_features",
    f"""{FEATURES} SELECT *, ROUND(SIN({ANGLE.format("pos1")}), 9) + 0.0 AS sin1, ROUND(COS({ANGLE.format("pos1")}), 9) + 0.0 AS cos1,
      ROUND(SIN({ANGLE.format("pos2")}), 9) + 0.0 AS sin2, ROUND(COS({ANGLE.format("pos2")}), 9) + 0.0 AS cos2 FROM features""",
)
def pair_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features(spark, sf))


UNIT_FEATURES = [f"unit_{f}" for f in C.FEATURES]


def pair_points_sql(keys: str, angle: str = ANGLE) -> str:
    """``points(keys, pos1, pos2, unit features, w)``: the distinct pairs of places in ``features``."""
    units = [f"CAST(ROUND({f[:3].upper()}({angle.format('pos' + f[3])}) * {C.UNITS}.0::DOUBLE) AS BIGINT) AS unit_{f}" for f in C.FEATURES]
    return f"points AS (SELECT {keys}pos1, pos2, {', '.join(units)}, COUNT(*) AS w FROM features GROUP BY ALL)"


def rounded_sql(angle: str = ANGLE) -> str:
    return ", ".join(f"ROUND({f[:3].upper()}({angle.format('f.pos' + f[3])}), 9) + 0.0 AS {f}" for f in C.FEATURES)


ROUNDED = rounded_sql()
RECURSIVE_FEATURES = FEATURES.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "cluster_pairs",
    f"""{RECURSIVE_FEATURES}, {pair_points_sql("tag, ")}, {Q.ward("points", "tag", ["pos1", "pos2"], UNIT_FEATURES, C.PAIR_HEIGHT * C.UNITS)}
    SELECT f.*, {ROUNDED}, w.cluster FROM features f JOIN ward w ON f.tag = w.tag AND f.pos1 = w.pos1 AND f.pos2 = w.pos2""",
)
def cluster_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.cluster_pairs(features(spark, sf), group_cols=["tag"]))


@query(
    "cluster_pairs_kmeans",
    f"""{RECURSIVE_FEATURES}, {pair_points_sql("")}, {Q.kmeans("points", ["pos1", "pos2"], UNIT_FEATURES, C.KMEANS_K, C.KMEANS_SEED)}
    SELECT f.*, {ROUNDED}, k.cluster FROM features f JOIN kmeans k ON f.pos1 = k.pos1 AND f.pos2 = k.pos2""",
)
def cluster_pairs_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.cluster_pairs_kmeans(features(spark, sf)))


SEGMENTS = f"""WITH {FREQUENT_BY_TAG}, {Q.BRAND_ORDER},
long AS (
  SELECT f.tag, f.itemset, f.value, UNNEST(STRING_SPLIT(f.itemset, ',')) AS node FROM frequent f WHERE f.k > 1 AND NOT f.rollup),
places AS (
  SELECT l.tag, l.itemset, l.value, o.pos, o.node, ROW_NUMBER() OVER (PARTITION BY l.tag, l.itemset ORDER BY o.pos) - 1 AS axis
  FROM long l JOIN ord o ON l.node = o.node),
steps AS (
  SELECT tag, itemset, value, CAST(axis AS INTEGER) AS axis, pos AS src, LEAD(pos) OVER (PARTITION BY tag, itemset ORDER BY axis) AS tgt FROM places),
names AS (SELECT tag, itemset, STRING_AGG(node, ',' ORDER BY pos) AS labels FROM places GROUP BY 1, 2),
segments AS (
  SELECT s.tag, n.labels, s.value, s.axis, s.src, s.tgt FROM steps s
    JOIN names n ON s.itemset = n.itemset AND s.tag IS NOT DISTINCT FROM n.tag WHERE s.tgt IS NOT NULL)"""


def segments(spark: SparkSession, sf: str) -> DataFrame:
    results = stored_results(spark, sf).filter((F.col("fi_type") == "frequent") & ~F.col("rollup"))
    sets = serve.multiples(results.select("tag", F.col("itemset").alias("labels"), "value"))
    return C.axis_segments(serve.sets_ordered(sets, brand_order(spark)))


@query("axis_segments", f"{SEGMENTS} SELECT * FROM segments")
def axis_segments(spark: SparkSession, sf: str) -> DataFrame:
    return segments(spark, sf).withColumn("labels", F.array_join("labels", ","))


AXIS_CLUSTERS = f"""
crowded AS (SELECT axis FROM segments GROUP BY axis HAVING COUNT(*) > {C.AXIS_MIN_ROWS}),
points AS (SELECT s.axis, src, tgt, COUNT(*) AS w FROM segments s JOIN crowded c ON s.axis = c.axis GROUP BY ALL),
{Q.ward("points", "axis", ["src", "tgt"], ["src", "tgt"], C.AXIS_HEIGHT)},
clustered AS (
  SELECT s.*, w.cluster FROM segments s LEFT JOIN ward w ON s.axis = w.axis AND s.src = w.src AND s.tgt = w.tgt)"""


@query("cluster_axis", f"{SEGMENTS.replace('WITH ', 'WITH RECURSIVE ', 1)}, {AXIS_CLUSTERS} SELECT * FROM clustered")
def cluster_axis(spark: SparkSession, sf: str) -> DataFrame:
    return C.cluster_axis(segments(spark, sf)).withColumn("labels", F.array_join("labels", ","))


BOOT = f"""{PLACED},
ixs AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY graph_id ORDER BY edge_id) - 1 AS ix FROM placed),
counts AS (SELECT graph_id, COUNT(*) AS m FROM pairs GROUP BY 1),
sample_sizes(n) AS (VALUES {", ".join(f"({n})" for n in W.SIZES)}),
draws AS (
  SELECT c.graph_id, c.m, z.n, UNNEST(RANGE(1, z.n + 1)) AS draw FROM counts c JOIN sample_sizes z ON z.n - 1 <= c.m),
picked AS (
  SELECT graph_id, n, draw, CAST('0x' || SUBSTR(MD5('b1|' || graph_id || '|' || n || '|' || draw), 1, {G.DRAW_DIGITS}) AS BIGINT) % m AS ix FROM draws),
boot AS (
  SELECT p.graph_id, CAST(p.n AS INTEGER) AS n, CAST(p.draw AS INTEGER) AS draw, i.edge_id, i.u, i.v, i.s, i.t
  FROM picked p JOIN ixs i ON p.graph_id = i.graph_id AND p.ix = i.ix)"""


@query("bootstrap_edges", f"{BOOT} SELECT graph_id, n, draw, edge_id, u, v FROM boot")
def bootstrap_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.bootstrap_edges(pair_graphs(spark, sf), W.SIZES, seed="b1")


@query(
    "sweep_summary",
    f"""{BOOT},
    crossed AS (
      SELECT a.graph_id, a.n, COUNT(*) AS crossings FROM boot a JOIN boot b
        ON a.graph_id = b.graph_id AND a.n = b.n AND a.s < b.s AND b.s < a.t AND a.t < b.t GROUP BY 1, 2),
    records AS (
      SELECT g.graph_id, g.n, COALESCE(c.crossings, 0) AS crossings FROM (SELECT DISTINCT graph_id, n FROM boot) g
        LEFT JOIN crossed c ON g.graph_id = c.graph_id AND g.n = c.n)
    SELECT n, ROUND(AVG(crossings), 6) AS crossings_mean, ROUND(STDDEV_SAMP(crossings) / SQRT(COUNT(*)), 6) AS crossings_sem
    FROM records GROUP BY n""",
)
def sweep_summary(spark: SparkSession, sf: str) -> DataFrame:
    samples = materialise(W.sample_graphs(pair_graphs(spark, sf), W.SIZES, seed="b1"), "samples")
    totals = G.crossings_total(G.edge_positions(samples, brand_order(spark)))
    records = totals.join(samples.select("graph_id", "n").distinct(), "graph_id")
    summary = T.sweep_summary(records, ["crossings"])
    return summary.select("n", *[F.round(c, 6).alias(c) for c in summary.columns if c != "n"])


DRAWN = f"""{BOOT},
sources AS (SELECT DISTINCT graph_id || '|' || n AS graph_id, graph_id AS source, n FROM boot)"""
# The samples as graphs of their own.
SAMPLED = f"""WITH RECURSIVE drawn AS ({DRAWN} SELECT graph_id || '|' || n AS graph_id, u, v FROM boot), {Q.BRAND_ORDER},
pairs AS (SELECT * FROM drawn),
ends AS (SELECT graph_id, u AS node FROM pairs UNION ALL SELECT graph_id, v FROM pairs)"""


def sweep_crossings(way: str, orders: str) -> str:
    """``way(graph_id, crossings)`` of all samples under ``orders``, SQL behind SAMPLED that ends with (graph_id, node, pos)."""
    with_steps, _, rows = orders.rpartition("SELECT ")
    return f"""by_{way} AS (
  {SAMPLED}{with_steps.rstrip().rstrip(",")}, ways AS (SELECT {rows}),
  laid_out AS (
    SELECT p.graph_id, LEAST(a.pos, b.pos) AS s, GREATEST(a.pos, b.pos) AS t FROM pairs p
      JOIN ways a ON p.graph_id = a.graph_id AND p.u = a.node JOIN ways b ON p.graph_id = b.graph_id AND p.v = b.node)
  SELECT a.graph_id, COUNT(*) AS crossings FROM laid_out a JOIN laid_out b ON {CROSS} GROUP BY 1)"""


SWEPT = {
    "default": ", graphs AS (SELECT DISTINCT graph_id FROM pairs) SELECT g.graph_id, o.node, o.pos FROM graphs g JOIN ord o ON TRUE",
    "avsdf": AVSDF,
    "avsdf_la": f"{adjusted(AVSDF)} SELECT * FROM adjusted",
    "bb": BAUR_BRANDES,
    "bb_la": f"{adjusted(BAUR_BRANDES)} SELECT * FROM adjusted",
}


@query(
    "order_sweep",
    f"""WITH sources AS ({DRAWN} SELECT * FROM sources), {", ".join(sweep_crossings(way, sql) for way, sql in SWEPT.items())}
    SELECT g.source, g.n, {", ".join(f"COALESCE(by_{w}.crossings, 0) AS cross_{w}" for w in SWEPT)} FROM sources g
      {" ".join(f"LEFT JOIN by_{w} ON g.graph_id = by_{w}.graph_id" for w in SWEPT)}""",
)
def order_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return W.order_sweep(pair_graphs(spark, sf), brand_order(spark), sizes=W.SIZES, seed="b1")
