"""Pair graphs: positions, degrees, adjacency, density and edge crossings.

``edges`` is ``(graph_id, edge_id, u, v, ...)``, undirected, parallel edges allowed; ``order`` is ``(node, pos)`` or
``(graph_id, node, pos)`` with positions 0, 1, 2 and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setscope.functions.columns import join_same
from setscope.functions.range_counts import covered_weight
from setscope.functions.tables import materialise, spread_rows, task_slots

#: Hexadecimal digits of a draw.
DRAW_DIGITS = 15


def edge_positions(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Edges with ``pos_u``, ``pos_v`` and the lower and upper position ``s``, ``t``. Edges with an unknown node drop out."""
    keys = ["graph_id"] if "graph_id" in order.columns else []
    left = order.select(*keys, F.col("node").alias("u"), F.col("pos").alias("pos_u"))
    right = order.select(*keys, F.col("node").alias("v"), F.col("pos").alias("pos_v"))
    placed = edges.join(left, [*keys, "u"]).join(right, [*keys, "v"])
    return placed.withColumn("s", F.least("pos_u", "pos_v")).withColumn("t", F.greatest("pos_u", "pos_v"))


def unknown_nodes(edges: DataFrame, order: DataFrame) -> DataFrame:
    """``(node, edges)``: nodes missing from the order and how many edges they cost."""
    keys = ["graph_id"] if "graph_id" in order.columns else []
    ends = edges.select(*keys, F.explode(_ends()).alias("node"))
    return ends.join(order, [*keys, "node"], "left_anti").groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("edges"))


def _ends() -> Column:
    # A loop touches its node once.
    return F.array_distinct(F.array("u", "v"))


def node_degree(edges: DataFrame) -> DataFrame:
    """``(graph_id, node, degree, rank)``: incident edges of each node, ranked upwards, ties by label.

    The window runs over the nodes of a graph, not its edges.
    """
    degrees = edges.select("graph_id", F.explode(_ends()).alias("node")).groupBy("graph_id", "node")
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy("degree", "node"))
    return degrees.agg(F.count(F.lit(1)).alias("degree")).withColumn("rank", rank)


def incident_edges(edges: DataFrame) -> DataFrame:
    """``(graph_id, node, edge_id)``."""
    return edges.select("graph_id", F.explode(_ends()).alias("node"), "edge_id")


def adjacency(edges: DataFrame) -> DataFrame:
    """``(graph_id, node, neighbour)`` of adjacent nodes; a node with an edge is its own neighbour too."""
    both = F.array(
        F.struct(F.col("u").alias("node"), F.col("v").alias("neighbour")),
        F.struct(F.col("v").alias("node"), F.col("u").alias("neighbour")),
        F.struct(F.col("u").alias("node"), F.col("u").alias("neighbour")),
        F.struct(F.col("v").alias("node"), F.col("v").alias("neighbour")),
    )
    return edges.select("graph_id", F.explode(both).alias("a")).select("graph_id", "a.*").distinct()


def graph_density(edges: DataFrame, n_nodes: int) -> DataFrame:
    """``(graph_id, edges, density)``: edges over possible pairs of ``n_nodes``."""
    return edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges")).withColumn(
        "density", F.col("edges") / F.lit(n_nodes * (n_nodes - 1) / 2)
    )


def _crossed(placed: DataFrame, chords: DataFrame | None = None) -> DataFrame:
    """``(graph_id, s, t, w, later, earlier)`` per distinct position pair; ``w`` is its number of edges. With ``chords(graph_id, s, t)``
    the same for these distinct pairs, which need not be edges, and without ``w``.

    ``later`` counts the edges that start inside (s, t) and end behind it, ``earlier`` those that start before s and end inside.
    Both are sums of prefix counts over (start, end), so no edge is compared with another:

      later   = start < t  -  start <= s  -  end <= t  +  (start <= s and end <= t)
      earlier = (start < s and end < t)  -  end <= s
    """
    edges = placed.filter(F.col("s") < F.col("t")).groupBy("graph_id", "s", "t").agg(F.count(F.lit(1)).alias("w"))
    edges = materialise(edges, "position-pairs")
    asked_for = edges if chords is None else materialise(chords.select("graph_id", "s", "t"), "chords")
    last = edges.agg(F.max("t")).first()[0]
    last, pairs = asked_for.agg(F.greatest(F.max("t"), F.lit(last)), F.count(F.lit(1))).first()
    n = (last or 0) + 1
    bits = n.bit_length()
    every = F.lit(n)

    def probe(x, y, later: int, earlier: int) -> Column:
        return F.struct(
            x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(later).alias("later"), F.lit(earlier).alias("earlier")
        )

    s, t = F.col("s"), F.col("t")
    probes = F.array(
        probe(t, every, 1, 0),
        probe(s + 1, every, -1, 0),
        probe(every, t + 1, -1, 0),
        probe(s + 1, t + 1, 1, 0),
        probe(s, t, 0, 1),
        probe(every, s + 1, 0, -1),
    )
    asking = spread_rows(asked_for, pairs, pairs * 6 * bits**2 / 4, "graph_id", "s", "t")
    asked = asking.select("graph_id", "s", "t", F.explode(probes).alias("p")).select("graph_id", "s", "t", "p.*")
    counted = covered_weight(
        edges.withColumnsRenamed({"s": "start", "t": "end"}),
        asked,
        group_cols=["graph_id"],
        coords=["start", "end"],
        bounds=["x", "y"],
        weight="w",
        bits=bits,
    )
    sums = counted.groupBy("graph_id", "s", "t").agg(
        F.sum(F.col("covered") * F.col("later")).alias("later"), F.sum(F.col("covered") * F.col("earlier")).alias("earlier")
    )
    return asked_for.join(sums, ["graph_id", "s", "t"], "left").fillna(0, ["later", "earlier"])


def crossings_total(placed: DataFrame) -> DataFrame:
    """``(graph_id, crossings)``: pairs of edges that cross, each pair once; edges that share a node do not cross."""
    totals = _crossed(placed).groupBy("graph_id").agg(F.sum(F.col("w") * F.col("later")).alias("crossings"))
    return placed.select("graph_id").distinct().join(totals, "graph_id", "left").fillna(0, ["crossings"])


def crossings_per_edge(placed: DataFrame) -> DataFrame:
    """``(graph_id, edge_id, u, v, crossings)``."""
    counts = _crossed(placed).select("graph_id", "s", "t", (F.col("later") + F.col("earlier")).alias("crossings"))
    edges = placed.select("graph_id", "edge_id", "u", "v", "s", "t")
    return edges.join(counts, ["graph_id", "s", "t"], "left").fillna(0, ["crossings"]).drop("s", "t")


def crossings_per_node(placed: DataFrame) -> DataFrame:
    """``(graph_id, node, crossings, rank)``: crossings on incident edges, ranked downwards, ties by label."""
    sums = (
        crossings_per_edge(placed)
        .select("graph_id", F.explode(_ends()).alias("node"), "crossings")
        .groupBy("graph_id", "node")
        .agg(F.sum("crossings").alias("crossings"))
    )
    rank = Window.partitionBy("graph_id").orderBy(F.desc("crossings"), "node")
    return sums.withColumn("rank", F.row_number().over(rank))


def swap_gain(edges: DataFrame, order: DataFrame) -> DataFrame:
    """``(graph_id, node, neighbour, old_crossings, new_crossings)`` on the edges of ``node`` when the two trade places; ``order`` is
    ``(node, pos)``.

    At its new place q, an edge of the node to z crosses what a chord from q to z crosses in the old layout, less the node's own edges at
    the old place p, plus the neighbour's, which is there now. The first number comes from prefix counts over all edges, once for each
    pair of places; the other two are neighbours between two places, so differences of running sums. A swap is never laid out anew: its
    row meets only the other edges of its node, by their common place.
    """
    placed = edge_positions(edges.select("graph_id", "u", "v"), order).filter("s < t")
    ways = F.array(F.struct(F.col("pos_u").alias("p"), F.col("pos_v").alias("q")), F.struct(F.col("pos_v").alias("p"), F.col("pos_u").alias("q")))
    near = placed.select("graph_id", F.explode(ways).alias("e")).groupBy("graph_id", "e.p", "e.q").agg(F.count(F.lit(1)).alias("w"))
    near = materialise(near, "swap-neighbours")
    degree = near.groupBy("graph_id", "p").agg(F.sum("w").alias("n"))
    ends = near.select("graph_id", "p", F.col("q").alias("z"), F.col("w").alias("w_z"))
    fans = materialise(near.join(ends, ["graph_id", "p"]).filter("q <> z"), "swap-fans")
    chords = fans.select("graph_id", F.least("q", "z").alias("s"), F.greatest("q", "z").alias("t"))
    chords = chords.unionByName(near.filter("p < q").select("graph_id", F.col("p").alias("s"), F.col("q").alias("t"))).distinct()
    crossed = _crossed(placed, chords).select("graph_id", "s", "t", (F.col("later") + F.col("earlier")).alias("crossed"))
    crossed = materialise(crossed, "swap-crossed")
    # Edges of a node up to a place, for its own place and those that its swaps ask for; places without an edge count none.
    asked = fans.select("graph_id", F.col("q").alias("u"), F.col("z").alias("at")).unionByName(near.select("graph_id", F.col("p").alias("u"), F.col("p").alias("at")))
    given = near.select("graph_id", F.col("p").alias("u"), F.col("q").alias("at"), "w")
    places = given.unionByName(asked.distinct().withColumn("w", F.lit(0).cast("bigint"))).groupBy("graph_id", "u", "at").agg(F.sum("w").alias("w_at"))
    along = Window.partitionBy("graph_id", "u").orderBy("at")
    sums = materialise(places.withColumn("upto", F.sum("w_at").over(along)), "swap-sums")

    def looked_up(rows: DataFrame, u: str, at: str, name: str) -> DataFrame:
        found = sums.select("graph_id", F.col("u").alias(u), F.col("at").alias(at), F.col("w_at").alias(f"w_{name}"), F.col("upto").alias(f"upto_{name}"))
        return rows.join(found, ["graph_id", u, at])

    rows = fans.withColumns({"s": F.least("q", "z"), "t": F.greatest("q", "z"), "own": F.col("q")}).join(crossed, ["graph_id", "s", "t"])
    rows = looked_up(looked_up(rows, "p", "q", "pq"), "p", "z", "pz")
    rows = looked_up(looked_up(rows, "q", "z", "qz"), "q", "own", "qq")
    rows = rows.join(degree.select("graph_id", "p", F.col("n").alias("n_p")), ["graph_id", "p"])
    rows = rows.join(degree.select("graph_id", F.col("p").alias("q"), F.col("n").alias("n_q")), ["graph_id", "q"])

    def fan(u: str) -> Column:
        """Edges of p or q, fastened at p, that cross the chord from q to z."""
        near_q, near_z = f"{u}q", f"{u}z"
        low = F.when(F.col("q") < F.col("z"), F.col(f"upto_{near_q}")).otherwise(F.col(f"upto_{near_z}"))
        high = F.when(F.col("q") < F.col("z"), F.col(f"upto_{near_z}") - F.col(f"w_{near_z}")).otherwise(F.col(f"upto_{near_q}") - F.col(f"w_{near_q}"))
        inside = (F.col("s") < F.col("p")) & (F.col("p") < F.col("t"))
        return F.when(inside, F.col(f"n_{u}") - (high - low) - F.col(f"w_{near_q}") - F.col(f"w_{near_z}")).otherwise(high - low)

    moved = rows.groupBy("graph_id", "p", "q").agg(F.sum(F.col("w_z") * (F.col("crossed") - fan("p") + fan("q"))).alias("moved"))
    here = near.withColumns({"s": F.least("p", "q"), "t": F.greatest("p", "q")}).join(crossed, ["graph_id", "s", "t"])
    old = here.groupBy("graph_id", "p").agg(F.sum(F.col("w") * F.col("crossed")).alias("old_crossings"))
    swaps = here.join(moved, ["graph_id", "p", "q"], "left").join(old, ["graph_id", "p"])
    new = F.coalesce("moved", F.lit(0)) + F.col("w") * F.col("crossed")
    named = swaps.join(order.select(F.col("pos").alias("p"), "node"), "p").join(order.select(F.col("pos").alias("q"), F.col("node").alias("neighbour")), "q")
    return named.select("graph_id", "node", "neighbour", "old_crossings", new.cast("bigint").alias("new_crossings"))


def bootstrap_edges(edges: DataFrame, sizes: list[int], *, seed: str, skip_larger: bool = True) -> DataFrame:
    """``(graph_id, n, draw, edge_id, u, v)``: ``n`` edges drawn with replacement from each graph, for each size.

    With ``skip_larger`` a size is drawn only when the graph has at least ``size - 1`` edges. The drawn index is a hash of seed, graph,
    size and draw modulo the number of edges, so a rerun draws the same; the hash has 60 bits, so every edge can be drawn. Edges are
    sorted in ranges, and the index of an edge is its rank in a range after the edges of the graph in earlier ranges: a draw looks up its
    range among the few of its graph, and meets the edge by place. No window covers a graph.
    """
    known = edges.select("graph_id", "edge_id", "u", "v").distinct()
    sorted_edges = known.repartitionByRange(task_slots(known.sparkSession), "graph_id", "edge_id", "u", "v")
    sorted_edges = sorted_edges.sortWithinPartitions("graph_id", "edge_id", "u", "v")
    placed = materialise(sorted_edges.withColumn("place", F.monotonically_increasing_id()), "edge-places")
    ranges = placed.groupBy("graph_id", F.shiftright("place", 33).alias("range")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("m"))
    # One row for each graph and range: the places of a graph, with how many edges lie before them.
    along = Window.partitionBy("graph_id").orderBy("range")
    ranges = ranges.withColumn("before", F.sum("m").over(along) - F.col("m"))
    graphs = ranges.groupBy("graph_id").agg(F.sum("m").alias("m"), F.sort_array(F.collect_list(F.struct("before", "first"))).alias("ranges"))
    draws = graphs.select("graph_id", "m", "ranges", F.explode(F.array(*[F.lit(x) for x in sizes])).alias("n"))
    if skip_larger:
        draws = draws.filter(F.col("n") - 1 <= F.col("m"))
    draws = draws.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("draw"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), "graph_id", "n", "draw"))
    draws = draws.withColumn("ix", F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("bigint") % F.col("m"))
    found = F.element_at(F.filter("ranges", lambda r: r["before"] <= F.col("ix")), -1)
    picked = draws.select("graph_id", "n", "draw", (found["first"] + F.col("ix") - found["before"]).alias("place"))
    return picked.join(placed.drop("graph_id"), "place").select("graph_id", "n", "draw", "edge_id", "u", "v")
