"""SQL fragments the oracle queries share. Each is one or more common table expressions without the leading WITH."""

from __future__ import annotations

from setscope.operators.kmeans import COST_UNIT, OVERSAMPLING, SAMPLE_ROUNDS, STEPS
from setscope.sources.bindings import BRAND_PARENT, BRANDS, TAGS, TYPE_UTILITY


def maps(label: str, prefix: str = "") -> str:
    """``base(id, item, w)``, ``tot(id, tw)`` and ``baskets(id, item, weight, share)``."""
    return f"""
{prefix}base AS (
  SELECT l_orderkey AS id, {label} AS item, SUM(CAST(l_quantity AS BIGINT)) AS w
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
{prefix}tot AS (SELECT id, SUM(w) AS tw FROM {prefix}base GROUP BY id),
{prefix}baskets AS (
  SELECT b.id, b.item, CAST(b.w AS BIGINT) AS weight, CAST(b.w AS DOUBLE) / CAST(t.tw AS DOUBLE) AS share
  FROM {prefix}base b JOIN {prefix}tot t ON b.id = t.id)"""


CONFIDENCE = """
conf AS (
  SELECT l_orderkey AS id,
    CAST(1 AS DOUBLE) - CAST(SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) AS DOUBLE)
      / (CAST(10 AS DOUBLE) * CAST(COUNT(*) AS DOUBLE)) AS confidence
  FROM lineitem GROUP BY 1)"""

META = """
meta AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_orderkey AS id,
    'Order &amp; ' || CAST(o_orderkey AS VARCHAR) || ' &amp; ' || o_orderstatus AS name,
    c_name || ' &amp; Co' AS artist_name, o_orderpriority AS g1, LOWER(c_mktsegment) AS g2, n_name AS v1, r_name AS v2
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey),
tags AS (SELECT id, g1 AS tag FROM meta UNION ALL SELECT id, g2 FROM meta),
vartags AS (SELECT id, v1 AS tag FROM meta UNION ALL SELECT id, v2 FROM meta)"""

ROLLUP = "rollup(item, parent) AS (VALUES " + ", ".join(f"('{i}', '{p}')" for i, p in BRAND_PARENT.items()) + ")"
UTILITY = "util(item, eutil) AS (VALUES " + ", ".join(f"('{i}', {u})" for i, u in TYPE_UTILITY.items()) + ")"
TAG_LIST = "taglist(tag, ix) AS (VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(TAGS)) + f", (NULL, {len(TAGS)}))"
BRAND_ORDER = "ord(node, pos) AS (VALUES " + ", ".join(f"('{b}', {i})" for i, b in enumerate(BRANDS)) + ")"
TYPES = sorted(TYPE_UTILITY)
TYPE_BITS = "bits(item, bit) AS (VALUES " + ", ".join(f"('{t}', {1 << i})" for i, t in enumerate(TYPES)) + ")"
# All 63 label sets of the six part types, as bit masks with their text.
TYPE_SETS = f"""{TYPE_BITS},
sets AS (
  SELECT s.mask, STRING_AGG(b.item, ',' ORDER BY b.item) AS itemset, CAST(COUNT(*) AS INTEGER) AS k
  FROM (SELECT UNNEST(RANGE(1, 64)) AS mask) s JOIN bits b ON (s.mask & b.bit) <> 0 GROUP BY s.mask)"""


def item_sets(source: str, groups: str) -> str:
    """``allsets(groups, itemset, k, freq)``: all label sets of ``source(groups, id, item)``, of any length; groups is a column list
    without NULLs. A basket's sets are counted by the bits of the numbers from 1."""
    return f"""
baskets_of AS (SELECT {groups}, id, LIST(item ORDER BY item) AS l FROM {source} GROUP BY ALL),
sets_of AS (SELECT {groups}, l, UNNEST(RANGE(1, CAST(1 AS BIGINT) << LEN(l))) AS m FROM baskets_of),
allsets AS (
  SELECT {groups}, ARRAY_TO_STRING(LIST_FILTER(l, LAMBDA x, i: (m >> (i - 1)) & 1 = 1), ',') AS itemset,
    CAST(BIT_COUNT(m) AS INTEGER) AS k, COUNT(*) AS freq FROM sets_of GROUP BY ALL)"""


def _square(x: str) -> str:
    return f"({x}) * ({x})"


def ward(source: str, group: str, names: list[str], coords: list[str], height: float) -> str:
    """``ward(group, names, cluster)`` of ``source(group, names, coords, w)`` with whole coordinates: in each step, all pairs of mutual
    nearest neighbours below the height become one; a group without any is left as it is. Goes behind WITH RECURSIVE."""

    def each(text: str, between: str = ", ") -> str:
        return between.join(text.format(c=c) for c in names)

    apart = " + ".join(_square(f"a.c_{c} - b.c_{c}") for c in coords)
    return f"""
ward_steps AS (
  SELECT 0 AS step, {group}, {each("{c}")}, {each("{c} AS r_{c}")}, {", ".join(f"{c} AS x_{c}" for c in coords)}, w FROM {source}
  UNION ALL
  (WITH clusters AS (
    SELECT {group}, {each("r_{c}")}, CAST(SUM(w) AS DOUBLE) AS n,
      {", ".join(f"CAST(SUM(CAST(x_{c} AS HUGEINT) * w) AS DOUBLE) / CAST(SUM(w) AS DOUBLE) AS c_{c}" for c in coords)}
    FROM ward_steps GROUP BY {group}, {each("r_{c}")}),
  near AS (
    SELECT a.{group} AS g, {each("a.r_{c} AS a_{c}, b.r_{c} AS b_{c}")}, ({apart}) * (CAST(2 AS DOUBLE) * a.n * b.n / (a.n + b.n)) AS d
    FROM clusters a JOIN clusters b ON a.{group} IS NOT DISTINCT FROM b.{group} AND ({each("a.r_{c}")}) <> ({each("b.r_{c}")})
    QUALIFY ROW_NUMBER() OVER (PARTITION BY a.{group}, {each("a.r_{c}")} ORDER BY d, {each("b.r_{c}")}) = 1),
  merged AS (
    SELECT x.g, {each("x.a_{c}, x.b_{c}")} FROM near x JOIN near y ON x.g IS NOT DISTINCT FROM y.g
      AND {each("x.a_{c} = y.b_{c} AND x.b_{c} = y.a_{c}", " AND ")}
    WHERE x.d < CAST({height} AS DOUBLE) * CAST({height} AS DOUBLE) AND ({each("x.b_{c}")}) < ({each("x.a_{c}")}))
  SELECT k.step + 1, k.{group}, {each("k.{c}")}, {each("COALESCE(m.b_{c}, k.r_{c})")}, {", ".join(f"k.x_{c}" for c in coords)}, k.w
  FROM ward_steps k LEFT JOIN merged m ON k.{group} IS NOT DISTINCT FROM m.g AND {each("k.r_{c} = m.a_{c}", " AND ")}
  WHERE EXISTS (SELECT 1 FROM merged e WHERE e.g IS NOT DISTINCT FROM k.{group}))),
ward AS (
  SELECT {group}, {each("{c}")}, CAST(DENSE_RANK() OVER (PARTITION BY {group} ORDER BY {each("r_{c}")}) - 1 AS INTEGER) AS cluster
  FROM (SELECT * FROM ward_steps QUALIFY step = MAX(step) OVER (PARTITION BY {group})))"""


def kmeans(source: str, names: list[str], coords: list[str], k: int, seed: int) -> str:
    """``kmeans(names, cluster)`` of ``source(names, coords, w)``: oversampled starts, then Lloyd steps. Goes behind WITH RECURSIVE."""
    order, all_coords = ", ".join(names), ", ".join(coords)
    of_point = ", ".join(f"p.{c}" for c in names)

    def apart(a: str, b: str) -> str:
        return " + ".join(_square(f"CAST({a}.{c} AS DOUBLE) - {b}.{c}") for c in coords)

    def hashed(turn: int) -> str:
        text = " || '|' || ".join([f"'{seed}|{turn}'", *[f"CAST({c} AS VARCHAR)" for c in names]])
        return f"CAST('0x' || SUBSTR(MD5({text}), 1, 8) AS BIGINT)"

    parts = [f"picked0 AS (SELECT {order}, {all_coords} FROM {source} ORDER BY {hashed(0)}, {order} LIMIT 1)"]
    for turn in range(1, SAMPLE_ROUNDS + 1):
        before = f"picked{turn - 1}"
        parts.append(f"""
costed{turn} AS (
  SELECT {", ".join(f"p.{c}" for c in names + coords)}, p.w,
    CAST(FLOOR(MIN({apart("p", "c")}) / CAST({COST_UNIT:.0f} AS DOUBLE)) AS BIGINT) AS cost FROM {source} p JOIN {before} c ON TRUE GROUP BY ALL),
picked{turn} AS (
  SELECT * FROM {before} UNION ALL
  SELECT {order}, {all_coords} FROM costed{turn}, (SELECT SUM(CAST(w AS HUGEINT) * cost) AS total FROM costed{turn})
  WHERE CAST({hashed(turn)} AS HUGEINT) * total < CAST({OVERSAMPLING * k} AS HUGEINT) * 4294967296 * w * cost)""")
    shown = ", ".join(f"CAST(c.{c} AS DOUBLE) AS {c}" for c in coords)
    moved = ", ".join(f"COALESCE(CAST(s.{c} AS DOUBLE) / CAST(s.n AS DOUBLE), l.{c})" for c in coords)
    parts.append(f"""
tried AS (SELECT ROW_NUMBER() OVER (ORDER BY {order}) - 1 AS i, {all_coords} FROM picked{SAMPLE_ROUNDS}),
won AS (
  SELECT i, SUM(w) AS w FROM (
    SELECT p.w, c.i FROM {source} p JOIN tried c ON TRUE
    QUALIFY ROW_NUMBER() OVER (PARTITION BY {of_point} ORDER BY {apart("p", "c")}, c.i) = 1) GROUP BY i),
weighed AS (SELECT c.*, CAST(COALESCE(w.w, 0) AS DOUBLE) AS w FROM tried c LEFT JOIN won w ON c.i = w.i),
between_tried AS (SELECT a.i, b.i AS j, a.w, {apart("a", "b")} AS d FROM weighed a JOIN weighed b ON TRUE),
chosen AS (
  SELECT 1 AS n, [i] AS l FROM (SELECT i FROM weighed ORDER BY w DESC, i LIMIT 1)
  UNION ALL
  SELECT n + 1, LIST_APPEND(l, i) FROM (
    SELECT h.n, h.l, b.i, ANY_VALUE(b.w) * FLOOR(MIN(b.d) / CAST({COST_UNIT:.0f} AS DOUBLE)) AS gain
    FROM chosen h JOIN between_tried b ON LIST_CONTAINS(h.l, b.j) WHERE h.n < {k} GROUP BY h.n, h.l, b.i
    QUALIFY ROW_NUMBER() OVER (ORDER BY gain DESC, i) = 1) WHERE gain > 0),
lloyd AS (
  SELECT 0 AS step, CAST(LIST_POSITION(l, c.i) - 1 AS INTEGER) AS centre, {shown} FROM tried c, (SELECT * FROM chosen ORDER BY n DESC LIMIT 1)
  WHERE LIST_CONTAINS(l, c.i)
  UNION ALL
  (WITH near AS (
    SELECT p.*, c.centre FROM {source} p JOIN lloyd c ON TRUE
    QUALIFY ROW_NUMBER() OVER (PARTITION BY {of_point} ORDER BY {apart("p", "c")}, c.centre) = 1),
  s AS (SELECT centre, SUM(w) AS n, {", ".join(f"SUM(CAST({c} AS HUGEINT) * w) AS {c}" for c in coords)} FROM near GROUP BY centre)
  SELECT l.step + 1, l.centre, {moved} FROM lloyd l LEFT JOIN s ON l.centre = s.centre WHERE l.step < {STEPS})),
kmeans AS (
  SELECT {of_point}, c.centre AS cluster FROM {source} p JOIN lloyd c ON c.step = {STEPS}
  QUALIFY ROW_NUMBER() OVER (PARTITION BY {of_point} ORDER BY {apart("p", "c")}, c.centre) = 1)""")
    return ",".join(parts)
