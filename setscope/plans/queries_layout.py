"""Queries of chart preparation. Coordinates are rounded to 6 digits on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setscope.operators import layout as L
from setscope.plans import fragments as Q
from setscope.plans import serve
from setscope.plans.catalogue import query
from setscope.plans.queries_graph import FEATURES, PAIRS, SEGMENTS, features, segments, tagged_pairs
from setscope.plans.stored import brand_order, brand_root, stored_results
from setscope.sources import bindings as D

RADIUS = 100.0
WIDTH, HEIGHT = 800.0, 600.0
ROUND = 6


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Columns to 6 digits; adding zero turns a negative zero into zero."""
    return df.withColumns({c: F.round(c, ROUND) + F.lit(0.0) for c in columns})


def r(expr: str, name: str) -> str:
    return f"ROUND({expr}, {ROUND}) + 0.0 AS {name}"


def layout(spark: SparkSession) -> DataFrame:
    return L.radial_layout(brand_order(spark), RADIUS)


LAYOUT = """lay AS (
  SELECT node, pos, pos * (2 * PI()) / 25 AS angle, 100 * SIN(pos * (2 * PI()) / 25) AS x, 100 * COS(pos * (2 * PI()) / 25) AS y,
    'R' || CAST((CAST(SUBSTR(node, 7) AS BIGINT) - 1) // 5 AS VARCHAR) AS root FROM ord)"""


@query(
    "radial_layout",
    f"""WITH {Q.BRAND_ORDER}, {LAYOUT}, used AS (SELECT p_brand AS node, COUNT(*) AS parts FROM part GROUP BY 1)
    SELECT l.node, l.pos, u.parts, {r("angle", "angle")}, {r("x", "x")}, {r("y", "y")} FROM lay l JOIN used u ON l.node = u.node""",
)
def radial_layout(spark: SparkSession, sf: str) -> DataFrame:
    parts = D.table(spark, sf, "part").groupBy(F.col("p_brand").alias("node")).agg(F.count(F.lit(1)).alias("parts"))
    return rounded(layout(spark).join(parts, "node"), "angle", "x", "y")


def _ends(sets: DataFrame) -> DataFrame:
    return sets.select("tag", F.col("labels")[0].alias("a"), F.col("labels")[1].alias("b"), "value")


ENDS = """ends_at AS (
  SELECT p.graph_id AS tag, p.u AS a, p.v AS b, p.value, l.x AS x1, l.y AS y1, m.x AS x2, m.y AS y2, l.root AS ra, m.root AS rb
  FROM pairs p JOIN lay l ON p.u = l.node JOIN lay m ON p.v = m.node WHERE p.graph_id <> 'all')"""


@query(
    "radial_links",
    f"""{PAIRS}, {LAYOUT}, {ENDS}
    SELECT tag, a, b, value, {r("x1", "x1")}, {r("y1", "y1")}, {r("x2", "x2")}, {r("y2", "y2")} FROM ends_at""",
)
def radial_links(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.radial_links(_ends(tagged_pairs(spark, sf)), layout(spark)), "x1", "y1", "x2", "y2")


ROOTS = """roots AS (
  SELECT root, 100 * SIN(m) AS x, 100 * COS(m) AS y, m AS angle
  FROM (SELECT root, ATAN2(AVG(SIN(angle)), AVG(COS(angle))) AS m FROM lay GROUP BY root))"""


@query(
    "root_mean_angle",
    f"""WITH {Q.BRAND_ORDER}, lay AS (
      SELECT DISTINCT o.node, o.pos * (2 * PI()) / 25 AS angle, 'R' || CAST((CAST(SUBSTR(o.node, 7) AS BIGINT) - 1) // 5 AS VARCHAR) AS root
      FROM ord o JOIN part p ON p.p_brand = o.node), {ROOTS}
    SELECT root, {r("angle", "angle")}, {r("x", "x")}, {r("y", "y")} FROM roots""",
)
def root_mean_angle(spark: SparkSession, sf: str) -> DataFrame:
    used = D.table(spark, sf, "part").select(F.col("p_brand").alias("node")).distinct()
    placed = layout(spark).join(used, "node", "left_semi")
    return rounded(L.root_mean_angle(placed, brand_root(F.col("node")), RADIUS), "angle", "x", "y")


@query(
    "hier_links",
    f"""{PAIRS}, {LAYOUT}, {ENDS}, {ROOTS}
    SELECT e.tag, e.a, e.b, e.value, {r("x1", "x1")}, {r("y1", "y1")}, {r("p.x / 1.4", "cx1")}, {r("p.y / 1.4", "cy1")},
      {r("q.x / 1.4", "cx2")}, {r("q.y / 1.4", "cy2")}, {r("x2", "x2")}, {r("y2", "y2")}
    FROM ends_at e JOIN roots p ON e.ra = p.root JOIN roots q ON e.rb = q.root""",
)
def hier_links(spark: SparkSession, sf: str) -> DataFrame:
    links = L.hier_links(_ends(tagged_pairs(spark, sf)), layout(spark), brand_root(F.col("node")), RADIUS)
    return rounded(links, "x1", "y1", "cx1", "cy1", "cx2", "cy2", "x2", "y2")


# A cluster SQL can compute too: quarter of the circle of both ends.
CLUSTERED = f"""{FEATURES}, {LAYOUT},
clustered AS (
  SELECT tag, a, b, value, CAST(pos1 // 7 * 4 + pos2 // 7 AS INTEGER) AS cluster, l.x AS x1, l.y AS y1, m.x AS x2, m.y AS y2
  FROM features f JOIN lay l ON f.a = l.node JOIN lay m ON f.b = m.node),
cent AS (
  SELECT cluster, AVG(x1) AS lx, AVG(y1) AS ly, AVG(x2) AS rx, AVG(y2) AS ry, COUNT(*) AS links FROM clustered GROUP BY 1),
ctl AS (
  SELECT *, lx + 0.2 * (rx - lx) AS clx, ly + 0.2 * (ry - ly) AS cly, rx + 0.2 * (lx - rx) AS crx, ry + 0.2 * (ly - ry) AS cry FROM cent)"""
CENTROID = f"""cluster, links, {r("lx", "lx")}, {r("ly", "ly")}, {r("rx", "rx")}, {r("ry", "ry")}"""


def clustered(spark: SparkSession, sf: str) -> DataFrame:
    quarter = F.floor(F.col("pos1") / 7) * 4 + F.floor(F.col("pos2") / 7)
    return features(spark, sf).withColumn("cluster", quarter.cast("int"))


@query("cluster_centroids", f"{CLUSTERED} SELECT {CENTROID} FROM cent")
def cluster_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.cluster_centroids(clustered(spark, sf), layout(spark)), "lx", "ly", "rx", "ry")


@query(
    "bundle_control_points",
    f"""{CLUSTERED} SELECT {CENTROID}, {r("clx", "clx")}, {r("cly", "cly")}, {r("crx", "crx")}, {r("cry", "cry")} FROM ctl""",
)
def bundle_control_points(spark: SparkSession, sf: str) -> DataFrame:
    points = L.bundle_control_points(L.cluster_centroids(clustered(spark, sf), layout(spark)))
    return rounded(points, "lx", "ly", "rx", "ry", "clx", "cly", "crx", "cry")


@query(
    "bundle_links",
    f"""{CLUSTERED} SELECT k.tag, k.a, k.b, k.value, k.cluster, {r("k.x1", "x1")}, {r("k.y1", "y1")}, {r("clx", "clx")}, {r("cly", "cly")},
      {r("crx", "crx")}, {r("cry", "cry")}, {r("k.x2", "x2")}, {r("k.y2", "y2")} FROM clustered k JOIN ctl c ON k.cluster = c.cluster""",
)
def bundle_links(spark: SparkSession, sf: str) -> DataFrame:
    rows, nodes = clustered(spark, sf), layout(spark)
    links = L.bundle_links(rows, nodes, L.bundle_control_points(L.cluster_centroids(rows, nodes)))
    return rounded(links, "x1", "y1", "clx", "cly", "crx", "cry", "x2", "y2")


def curve_sql(end: str, near: str, far: str) -> str:
    """Length of a curve piece in SQL; points are prefixes of x and y columns."""

    def speed(c: str) -> str:
        x, y = f"({near}{c} - {end.format(c=c)})", f"({far}{c} - {end.format(c=c)})"
        return f"((1.0::DOUBLE - g.t) * (1.0::DOUBLE - g.t) * {x} * 0.5 + g.t * (1.0::DOUBLE - g.t) * ({x} * 5.0 - {y}) + g.t * g.t * {y} * 0.5)"

    nodes = ", ".join(f"{{'t': {t!r}::DOUBLE, 'w': {w!r}::DOUBLE}}" for t, w in L.gauss_nodes())
    return f"LIST_SUM(LIST_TRANSFORM([{nodes}], LAMBDA g: g.w * SQRT({speed('x')} * {speed('x')} + {speed('y')} * {speed('y')})))"


def sections_sql(side: str, source: str) -> str:
    """``<side>(cluster, r)``: rounds of sections over ``source``, and the vertex of the last parabola. The right side moves from r
    towards l with the left point fixed at m."""
    start, goal, still = ("l", "r", "r") if side == "r_left" else ("r", "l", "m")
    left, right = ("p", still) if side == "r_left" else (still, "p")
    text = [f"{side}_0 AS (SELECT DISTINCT cluster, CAST(0 AS DOUBLE) AS low, CAST({L.SHIFT_MAX} AS DOUBLE) AS high FROM {source})"]
    for turn in range(L.SECTION_ROUNDS):
        text.append(f"""
{side}_tried{turn} AS (
  SELECT k.*, b.low, b.high, b.i, b.r, {start}x + b.r * ({goal}x - {start}x) AS px, {start}y + b.r * ({goal}y - {start}y) AS py
  FROM {source} k JOIN (SELECT cluster, low, high, i, low + (high - low) * i / {L.SECTIONS} AS r FROM {side}_{turn}, (SELECT UNNEST(RANGE(0, {L.SECTIONS + 1})) AS i)) b
    ON k.cluster = b.cluster),
{side}_sums{turn} AS (
  SELECT cluster, low, high, i, r, SUM(w * (CAST(ROUND({curve_sql("{c}1", left, right)}, 12) AS DECIMAL(28, 12)) + CAST(ROUND({curve_sql("{c}2", right, left)}, 12) AS DECIMAL(28, 12))))
    + ANY_VALUE(CAST(ROUND(SQRT(({left}x - {right}x) * ({left}x - {right}x) + ({left}y - {right}y) * ({left}y - {right}y)), 12) AS DECIMAL(28, 12))) AS total
  FROM {side}_tried{turn} GROUP BY cluster, low, high, i, r),
{side}_{turn + 1} AS (
  SELECT cluster, COALESCE(r_before, low) AS low, COALESCE(r_behind, high) AS high, r, before, CAST(total AS DOUBLE) AS here, behind FROM (
    SELECT *, LAG(r) OVER w AS r_before, LEAD(r) OVER w AS r_behind, CAST(LAG(total) OVER w AS DOUBLE) AS before, CAST(LEAD(total) OVER w AS DOUBLE) AS behind,
      ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY total, i) AS place
    FROM {side}_sums{turn} WINDOW w AS (PARTITION BY cluster ORDER BY i)) WHERE place = 1)""")
    text.append(f"""
{side} AS (
  SELECT cluster, CASE WHEN before - here * 2.0::DOUBLE + behind > 0
    THEN r + (high - low) * 0.25::DOUBLE * (before - behind) / (before - here * 2.0::DOUBLE + behind) ELSE r END AS {side}
  FROM {side}_{L.SECTION_ROUNDS})""")
    return ",".join(text)


@query(
    "bundle_ratio_search",
    f"""{CLUSTERED},
    links AS (SELECT cluster, x1, y1, x2, y2, COUNT(*) AS w FROM clustered GROUP BY ALL),
    placed AS (SELECT k.*, lx, ly, rx, ry FROM links k JOIN cent c ON k.cluster = c.cluster),
    {sections_sql("r_left", "placed")},
    moved AS (SELECT p.*, lx + r_left * (rx - lx) AS mx, ly + r_left * (ry - ly) AS my FROM placed p JOIN r_left l ON p.cluster = l.cluster),
    {sections_sql("r_right", "moved")}
    SELECT l.cluster, ROUND(r_left, 6) AS r_left, ROUND(r_right, 6) AS r_right FROM r_left l JOIN r_right r ON l.cluster = r.cluster""",
)
def bundle_ratio_search(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.bundle_ratio_search(clustered(spark, sf), layout(spark)), "r_left", "r_right")


def _axes(spark: SparkSession, sf: str) -> int:
    """As many axes as the longest stored set has labels."""
    results = stored_results(spark, sf).filter((F.col("fi_type") == "frequent") & ~F.col("rollup"))
    return L.axis_count(results.select(F.col("itemset").alias("labels")))


@query(
    "parallel_layout",
    f"""{SEGMENTS}, n AS (SELECT MAX(LENGTH(itemset) - LENGTH(REPLACE(itemset, ',', '')) + 1) AS axes FROM names)
    SELECT CAST(a.axis AS INTEGER) AS axis, o.node, o.pos, {r("60 + a.axis * (800 - 70.0) / (n.axes - 1)", "x")}, {r("20 + o.pos * (600 - 40.0) / 24", "y")}
    FROM n, UNNEST(RANGE(0, CAST(n.axes AS BIGINT))) AS a(axis), ord o""",
)
def parallel_layout(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.parallel_layout(brand_order(spark), _axes(spark, sf), width=WIDTH, height=HEIGHT), "x", "y")


@query(
    "parallel_control_points",
    f"""{SEGMENTS}, n AS (SELECT MAX(LENGTH(itemset) - LENGTH(REPLACE(itemset, ',', '')) + 1) AS axes FROM names),
    c AS (SELECT axis, CAST(src // 5 AS INTEGER) AS cluster, AVG(20 + src * (600 - 40.0) / 24) AS y0,
      AVG(20 + tgt * (600 - 40.0) / 24) AS y1, 60 + axis * 730.0 / (ANY_VALUE(n.axes) - 1) AS x0,
      60 + (axis + 1) * 730.0 / (ANY_VALUE(n.axes) - 1) AS x1 FROM segments, n GROUP BY 1, 2)
    SELECT axis, cluster, {r("x0 - 0.2 * (x0 - x1)", "lx")}, {r("y0 - 0.2 * (y0 - y1)", "ly")}, {r("x1 - 0.2 * (x1 - x0)", "rx")},
      {r("y1 - 0.2 * (y1 - y0)", "ry")} FROM c""",
)
def parallel_control_points(spark: SparkSession, sf: str) -> DataFrame:
    bundles = segments(spark, sf).withColumn("cluster", F.floor(F.col("src") / 5).cast("int"))
    points = L.parallel_control_points(bundles, brand_order(spark).count(), _axes(spark, sf), width=WIDTH, height=HEIGHT)
    return rounded(points, "lx", "ly", "rx", "ry")


@query(
    "link_style",
    f"""{SEGMENTS},
    one AS (SELECT DISTINCT tag, labels, value, MIN(src) AS start FROM segments GROUP BY ALL),
    top AS (SELECT tag, MAX(value) AS top FROM one GROUP BY tag)
    SELECT o.tag, o.labels, o.value, {r("POW(o.value, 1.5) * 50", "width")}, {r("POW(o.value / t.top, 2)", "opacity")},
      {r("o.value / CAST(0.2 AS DOUBLE)", "hue")}, CASE WHEN o.tag IS NOT NULL THEN CAST(l.ix AS INTEGER) END AS tag_index,
      {r("CAST(o.start AS DOUBLE) / 24", "path_start")}
    FROM one o JOIN top t ON o.tag IS NOT DISTINCT FROM t.tag LEFT JOIN taglist l ON o.tag = l.tag""",
)
def link_style(spark: SparkSession, sf: str) -> DataFrame:
    results = stored_results(spark, sf).filter((F.col("fi_type") == "frequent") & ~F.col("rollup"))
    sets = serve.multiples(results.select("tag", F.col("itemset").alias("labels"), "value"))
    order = brand_order(spark)
    styled = L.link_style(serve.sets_ordered(sets, order), order, D.TAGS, focus=2.0)
    return rounded(styled, "width", "opacity", "hue", "path_start").withColumn("labels", F.array_join("labels", ","))


@query(
    "root_runs",
    f"""WITH nodes AS (SELECT DISTINCT p_brand AS node, CAST(SUBSTR(p_brand, 7) AS INTEGER) - 1 AS pos FROM part),
    o AS (SELECT *, 'R' || CAST(pos // 5 AS VARCHAR) AS root FROM nodes),
    c AS (SELECT *, CASE WHEN root <> LAG(root) OVER (ORDER BY pos) THEN 1 ELSE 0 END AS step FROM o),
    g AS (SELECT *, SUM(step) OVER (ORDER BY pos) AS run FROM c)
    SELECT root, MIN(pos) AS first, MAX(pos) AS last, {r("MIN(pos) * (2 * PI()) / 25 - 0.03", "start_angle")},
      {r("MAX(pos) * (2 * PI()) / 25 + 0.03", "end_angle")} FROM g GROUP BY root, run""",
)
def root_runs(spark: SparkSession, sf: str) -> DataFrame:
    used = D.table(spark, sf, "part").select(F.col("p_brand").alias("node")).distinct()
    order = brand_order(spark).join(used, "node", "left_semi")
    return rounded(L.root_runs(order, brand_root(F.col("node"))), "start_angle", "end_angle")
