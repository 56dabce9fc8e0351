"""Graph metrics, orders and clusters on literal graphs and against direct counting."""

import random
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from setscope.functions.labels import order_frame
from setscope.functions.range_counts import weight_below
from setscope.functions.tables import bounded_groups, new_path
from setscope.operators import cluster as C
from setscope.operators import graph as G
from setscope.operators import kmeans as KM
from setscope.operators import ordering as O
from setscope.operators import ward as V
from setscope.plans import serve, sweep

GRAPHS = {
    "g1": ("AB", ["AB"]),
    "g2": ("ABCDEFGH", ["BH", "HD", "CF", "DG"]),
    "g3": ("ABCDEFGH", ["AB", "AC", "AD", "AE", "AF", "AG", "AH", "HB"]),
}


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(g, i, e[0], e[1]) for g, (_, es) in GRAPHS.items() for i, e in enumerate(es)]
    return spark.createDataFrame(rows, "graph_id string, edge_id long, u string, v string").persist()


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(g, n, i) for g, (o, _) in GRAPHS.items() for i, n in enumerate(o)]
    return spark.createDataFrame(rows, "graph_id string, node string, pos int").persist()


def test_crossings_of_literal_graphs(edges, orders):
    placed = G.edge_positions(edges, orders)
    assert {r.graph_id: r.crossings for r in G.crossings_total(placed).collect()} == {"g1": 0, "g2": 2, "g3": 5}
    per_edge = {(r.graph_id, r.u + r.v): r.crossings for r in G.crossings_per_edge(placed).collect()}
    assert (per_edge["g2", "HD"], per_edge["g2", "BH"], per_edge["g3", "AC"], per_edge["g2", "CF"]) == (1, 0, 1, 2)
    per_node = {(r.graph_id, r.node): r.crossings for r in G.crossings_per_node(placed).collect()}
    assert per_node["g2", "D"] == per_edge["g2", "HD"] + per_edge["g2", "DG"]


def test_degrees_and_neighbours(edges):
    degree = {(r.graph_id, r.node): r.degree for r in G.node_degree(edges).collect()}
    assert (degree["g1", "B"], degree["g2", "D"], degree["g3", "A"]) == (1, 2, 7)
    assert ("g2", "Z") not in degree
    near = {}
    for r in G.adjacency(edges).collect():
        near.setdefault((r.graph_id, r.node), set()).add(r.neighbour)
    assert near["g2", "D"] == {"G", "H", "D"} and near["g3", "B"] == {"B", "H", "A"}
    incident = {(r.graph_id, r.node) for r in G.incident_edges(edges).collect()}
    assert ("g1", "C") not in incident


def direct_crossings(pairs):
    def cross(a, b):
        (s, t), (x, y) = sorted(a), sorted(b)
        return s < x < t < y or x < s < y < t

    return sum(cross(a, b) for a, b in combinations(pairs, 2))


def test_crossings_of_random_multigraphs(spark):
    rng = random.Random(5)
    graphs = {f"r{n}": [(rng.randrange(n), rng.randrange(n)) for _ in range(60)] for n in (2, 5, 16, 33)}
    rows = [(g, i, f"n{u:02d}", f"n{v:02d}") for g, es in graphs.items() for i, (u, v) in enumerate(es)]
    data = spark.createDataFrame(rows, "graph_id string, edge_id long, u string, v string")
    placed = G.edge_positions(data, order_frame(spark, [f"n{i:02d}" for i in range(33)]))
    want = {g: direct_crossings([e for e in es if e[0] != e[1]]) for g, es in graphs.items()}
    assert {r.graph_id: r.crossings for r in G.crossings_total(placed).collect()} == want


@pytest.mark.parametrize("bits", [4, 7])
def test_weight_below_equals_direct_sum(spark, bits):
    rng = random.Random(bits)
    points = [("g", rng.randrange(1 << bits), rng.randrange(1 << bits), rng.randrange(1, 9)) for _ in range(80)]
    probes = list({("g", rng.randrange(1 << bits), rng.randrange(1 << bits)) for _ in range(40)})
    got = weight_below(
        spark.createDataFrame(points, "g string, a int, b int, w long"),
        spark.createDataFrame(probes, "g string, x int, y int"),
        group_cols=["g"], coords=["a", "b"], bounds=["x", "y"], weight="w", bits=bits, out="s",
    ).collect()
    assert {(r.x, r.y): r.s for r in got} == {(x, y): sum(w for _, a, b, w in points if a < x and b < y) for _, x, y in probes}


def random_matrix(n, edges, seed):
    rng = np.random.default_rng(seed)
    m = np.zeros((n, n), dtype=np.int64)
    for _ in range(edges):
        a, b = rng.integers(0, n, 2)
        if a != b:
            m[a, b] += 1
            m[b, a] += 1
    return m


@pytest.mark.parametrize("seed", range(6))
def test_orders_are_permutations_and_adjusting_never_raises(seed):
    matrix = random_matrix(12, 30, seed)
    orders = O.compute_orders(matrix, O.METHODS)
    for order in orders.values():
        assert sorted(order) == list(range(12))
    for kind in ("avsdf", "bb"):
        assert O.total_crossings(matrix, orders[kind + "_la"]) <= O.total_crossings(matrix, orders[kind])


@pytest.mark.parametrize(("n", "edges"), [(3, 5), (8, 20), (14, 90)])
def test_swaps_counted_by_difference_equal_new_layouts(n, edges):
    matrix = random_matrix(n, edges, n)
    order = list(np.random.default_rng(n).permutation(n))
    placed = matrix[np.ix_(order, order)]
    total = O.total_crossings(matrix, order)
    for here in range(n):
        others = np.flatnonzero(placed[here])
        got = O.swap_totals(placed, O.crossings(placed)[1], total, here, others) if len(others) else []
        for there, count in zip(others, got):
            trial = list(order)
            trial[here], trial[there] = trial[there], trial[here]
            assert O.total_crossings(matrix, trial) == count


def test_adjusting_equals_trying_all_swaps():
    for seed in range(4):
        matrix = random_matrix(11, 40, seed)
        order = list(range(11))
        load, best = O.incident_crossings(matrix, order), O.total_crossings(matrix, order)
        want = list(order)
        for node in sorted(order, key=lambda i: (-load[i], i)):
            here, choice = want.index(node), None
            for there in sorted(want.index(i) for i in np.flatnonzero(matrix[node])):
                trial = list(want)
                trial[here], trial[there] = trial[there], trial[here]
                if O.total_crossings(matrix, trial) < best:
                    best, choice = O.total_crossings(matrix, trial), trial
            want = choice or want
        assert O.local_adjusting(matrix, order) == want


def test_adjusting_large_graphs_is_quick():
    matrix = random_matrix(150, 2000, 1)
    start = time.process_time()
    order = O.local_adjusting(matrix, list(range(150)))
    assert time.process_time() - start < 5 and O.total_crossings(matrix, order) < O.total_crossings(matrix, list(range(150)))


def test_swap_gains_of_multigraphs(spark):
    """Parallel edges, loops, unknown nodes; beside layouts made anew for every swap."""
    rng = random.Random(8)
    graphs = {f"r{n}": [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] for n, m in ((2, 3), (5, 12), (9, 40))}
    rows = [(g, i, f"n{u}", f"n{v}") for g, es in graphs.items() for i, (u, v) in enumerate(es)] + [("r5", 99, "n0", "other")]
    places = [3, 7, 0, 8, 1, 5, 2, 6, 4]
    order = spark.createDataFrame([(f"n{i}", p) for i, p in enumerate(places)], "node string, pos int")
    got = {(r.graph_id, r.node, r.neighbour): (r.old_crossings, r.new_crossings) for r in G.swap_gain(spark.createDataFrame(rows, "graph_id string, edge_id long, u string, v string"), order).collect()}
    want = {}
    for g, es in graphs.items():
        es = [e for e in es if e[0] != e[1]]

        def of(node, place):
            chords = [(place[u], place[v]) for u, v in es]
            return sum(direct_crossings([a, b]) for (e, a) in zip(es, chords) if node in e for b in chords)

        for x, y in {(u, v) for e in es for u, v in (e, e[::-1])}:
            swapped = list(places)
            swapped[x], swapped[y] = places[y], places[x]
            want[g, f"n{x}", f"n{y}"] = (of(x, places), of(x, swapped))
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_kernel_crossings_equal_direct_counting(seed):
    matrix = random_matrix(9, 25, seed)
    order = list(np.random.default_rng(seed).permutation(9))
    place = {node: i for i, node in enumerate(order)}
    pairs = [(place[i], place[j]) for i in range(9) for j in range(i + 1, 9) for _ in range(matrix[i, j])]
    assert O.total_crossings(matrix, order) == direct_crossings(pairs)


def test_avsdf_starts_at_smallest_degree_and_reaches_every_component():
    path = np.zeros((5, 5), dtype=np.int64)
    for a, b in ((1, 2), (2, 0), (3, 4)):
        path[a, b] = path[b, a] = 1
    assert O.avsdf(path) == [0, 2, 1, 3, 4]


def test_orders_in_spark_match_the_kernel(spark, edges):
    got = O.order_graphs_by(edges).collect()
    for graph, (nodes, es) in GRAPHS.items():
        used = sorted({c for e in es for c in e})
        for method in O.METHODS:
            order = [r.node for r in sorted((r for r in got if r.graph_id == graph and r.method == method), key=lambda r: r.pos)]
            assert sorted(order) == used
    with pytest.raises(ValueError):
        O.order_graphs(edges, method="other")
    with pytest.raises(ValueError):
        serve.choose_order(edges, edges, "other")


def ward_by_pairs(points, weights, height):
    """Plain agglomeration: always merge the closest pair."""
    groups = [([i], np.array(p, float), float(w)) for i, (p, w) in enumerate(zip(points, weights))]
    while len(groups) > 1:
        best = min(
            ((np.sqrt(2 * a[2] * b[2] / (a[2] + b[2])) * np.linalg.norm(a[1] - b[1]), i, j)
             for (i, a), (j, b) in combinations(enumerate(groups), 2)),
        )
        if best[0] >= height:
            break
        _, i, j = best
        a, b = groups[i], groups[j]
        merged = (a[0] + b[0], (a[1] * a[2] + b[1] * b[2]) / (a[2] + b[2]), a[2] + b[2])
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [merged]
    return {frozenset(g[0]) for g in groups}


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("height", [5, 15, 40])
def test_ward_in_one_cell_equals_plain_agglomeration(seed, height):
    rng = np.random.default_rng(seed)
    points, weights = rng.integers(0, 10**9, (25, 3)), rng.integers(1, 4, 25)
    open_space = np.full(3, np.inf)
    of, _, _, done = V.merge_in_cell(points * weights[:, None], weights, height * 4e7, -open_space, open_space)
    assert {frozenset(np.flatnonzero(of == k).tolist()) for k in set(of.tolist())} == ward_by_pairs(points, weights, height * 4e7)
    assert done.all() and all(of[k] == k for k in set(of.tolist()))


@pytest.mark.parametrize(("cell_points", "height"), [(4, 3e7), (12, 3e7), (4, 1e8), (10_000, 3e7), (3, 1e10), (5, 1.0)])
def test_ward_by_cells_equals_plain_agglomeration(spark, cell_points, height):
    rng = np.random.default_rng(int(height) % 97)
    points, weights = rng.integers(0, 10**9, (160, 2)), rng.integers(1, 30, 160)
    points[:60] //= 20  # a crowded corner
    rows = [("g" if i % 2 else None, i, int(x), int(y), int(w)) for i, ((x, y), w) in enumerate(zip(points, weights))]
    table = spark.createDataFrame(rows, "tag string, i int, x long, y long, w long")
    got = V.ward_clusters(table, keys=["tag"], names=["i"], coords=["x", "y"], height=height, cell_points=cell_points).collect()
    assert len(got) == len(rows)
    for tag in ("g", None):
        mine = [r for r in rows if r[0] == tag]
        labels = {r.i: r.cluster for r in got if r.tag == tag}
        found = {frozenset(j for j, r in enumerate(mine) if labels[r[1]] == k) for k in set(labels.values())}
        assert found == ward_by_pairs([r[2:4] for r in mine], [r[4] for r in mine], height)
        firsts = sorted(set(labels.values()), key=lambda k: min(i for i, c in labels.items() if c == k))
        assert firsts == list(range(len(firsts)))


def test_ward_of_nothing_and_of_one_point(spark):
    table = spark.createDataFrame([(1, 5, 7)], "i int, x long, w long")
    assert [tuple(r) for r in V.ward_clusters(table, keys=[], names=["i"], coords=["x"], height=1.0).collect()] == [(1, 0)]
    assert V.ward_clusters(table.limit(0), keys=[], names=["i"], coords=["x"], height=1.0).count() == 0


def test_ward_counts_copies(spark):
    base = [(0, 0), (0, 1), (5, 5)]
    rows = [(f"t{i % 2}", *p) for i, p in enumerate(base * 4)]
    data = spark.createDataFrame(rows, "tag string, pos1 int, pos2 int")
    for c in C.FEATURES:
        data = data.withColumn(c, F.col("pos1" if c.endswith("1") else "pos2").cast("double"))
    # Four copies each: the squares of the distances are 4 * 2 for the near pair, and far more for the other.
    for height, clusters in ((2.9, [0, 0, 1]), (2.8, [0, 1, 2])):
        got = C.cluster_pairs(data, height=height).select("pos1", "pos2", "cluster").distinct().collect()
        assert {(r.pos1, r.pos2): r.cluster for r in got} == dict(zip(base, clusters))


@pytest.mark.parametrize("k", [1, 5, 40])
def test_kmeans_does_not_depend_on_partitions(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, *map(int, rng.integers(-(10**9), 10**9, 2)), int(rng.integers(1, 5))) for i in range(150)]
    table = spark.createDataFrame(rows, "i int, x long, y long, w long")
    found = [
        {r.i: r.cluster for r in KM.kmeans_clusters(t, names=["i"], coords=["x", "y"], k=k, seed=1).collect()}
        for t in (table.repartition(3), table.repartition(8), table.orderBy(F.desc("x")).coalesce(1))
    ]
    assert found[0] == found[1] == found[2] and set(found[0].values()) == set(range(k))
    # Every point is with the centre nearest to it, and centres are means: a fixed point of plain Lloyd steps.
    points, weights = np.array([r[1:3] for r in rows], float), np.array([r[3] for r in rows], float)
    labels = np.array([found[0][r[0]] for r in rows])
    for _ in range(30):
        centres = np.array([(points[labels == c] * weights[labels == c, None]).sum(0) / weights[labels == c].sum() for c in range(k)])
        labels = KM.squares(points, centres).argmin(1)
    first = np.array([found[0][r[0]] for r in rows])
    cost = lambda of: sum(((points[of == c] - np.average(points[of == c], axis=0, weights=weights[of == c])) ** 2 * weights[of == c, None]).sum() for c in set(of))
    assert cost(first) <= 1.05 * cost(labels)


def test_kmeans_of_few_points(spark):
    table = spark.createDataFrame([(1, 0, 1), (2, 0, 3), (3, 9 * 10**8, 1)], "i int, x long, w long")
    got = {r.i: r.cluster for r in KM.kmeans_clusters(table, names=["i"], coords=["x"], k=40, seed=1).collect()}
    assert got[1] == got[2] != got[3] and set(got.values()) == {0, 1}
    assert KM.kmeans_clusters(table.limit(0), names=["i"], coords=["x"], k=4, seed=1).count() == 0


def test_sets_list_their_clusters(spark):
    rows = [("t", ["a", "b"], [0, 1], 1.0), (None, ["a", "b"], [0, 1], 1.0)] + [("t", ["a", "b", f"c{i}"], [0, 1, 2 + i], 1.0) for i in range(9)]
    sets = spark.createDataFrame(rows, "tag string, labels array<string>, positions array<int>, value double")
    got = C.set_clusters(C.cluster_axis(C.axis_segments(sets))).collect()
    assert sorted((r.tag or "", len(r.labels), r.km_label) for r in got) == sorted(
        (tag or "", len(labels), [0] if len(labels) == 2 else [0, None]) for tag, labels, _, _ in rows
    )


def test_axis_needs_more_than_ten_rows(spark):
    rows = [("t", ["a", "b"], [0, 1], 1.0)] * 11 + [("t", ["a", "b", "c"], [0, 1, 2], 1.0)] * 9
    sets = spark.createDataFrame(rows, "tag string, labels array<string>, positions array<int>, value double")
    segments = C.axis_segments(sets)
    assert segments.filter("axis = 1").count() == 9
    got = C.cluster_axis(segments).collect()
    assert len(got) == segments.count()
    assert {(r.axis, r.cluster is None) for r in got} == {(0, False), (1, True)}


def test_sweep_keeps_every_sample(spark):
    nodes = [f"n{i}" for i in range(7)]
    rows = [("g", i, a, b) for i, (a, b) in enumerate(combinations(nodes, 2))]
    data = spark.createDataFrame(rows, "graph_id string, edge_id long, u string, v string")
    got = sweep.order_sweep(data, order_frame(spark, nodes), sizes=[5, 21, 50], seed="x").collect()
    assert {r.n for r in got} == {5, 21}
    for r in got:
        assert r.cross_avsdf_la <= r.cross_avsdf and r.cross_bb_la <= r.cross_bb
    for fmt in ("json", "csv", "parquet"):
        path = new_path(spark, "sweep")
        sweep.write_records(spark.createDataFrame(got), path, fmt)
        back = sweep.read_records(spark, path, fmt).select(*got[0].asDict()).collect()
        assert sorted(map(tuple, back)) == sorted(map(tuple, got))
    # A rerun draws the same samples.
    again = sweep.order_sweep(data.repartition(5), order_frame(spark, nodes), sizes=[5, 21, 50], seed="x").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_oversized_groups_fail_before_they_are_gathered(spark):
    data = spark.range(20).select(F.when(F.col("id") < 15, "big").otherwise("small").alias("g"), "id")
    assert bounded_groups(data, ["g"], 15, "too large").count() == 20
    with pytest.raises(Exception, match="too large"):
        bounded_groups(data, ["g"], 14, "too large").collect()
