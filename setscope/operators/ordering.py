"""Node orders of circular layouts: AVSDF, Baur-Brandes, and local adjusting.

The heuristics place one node after another, so a graph is ordered inside one task and Spark spreads the graphs. Parallel edges
are summed before the graph is gathered: the task receives at most one row per node pair, however many edges the graph has. A graph
with more nodes than ``MAX_NODES`` is refused with an error rather than cut, before its rows are gathered when they are that many.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setscope.functions.tables import bounded_groups, spread_groups

# Kernels travel to the workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

METHODS = ("avsdf", "avsdf_la", "bb", "bb_la")
MAX_NODES = 4_000


def weighted_pairs(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, a, b, w)``: distinct node pairs, a before b, with their number of edges."""
    pairs = edges.select(*keys, F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    return pairs.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("w"))


def _graphs(edges: DataFrame) -> DataFrame:
    """Distinct pairs, each graph in one partition, all graphs small enough to be gathered."""
    pairs = bounded_groups(weighted_pairs(edges, ["graph_id"]), ["graph_id"], MAX_NODES * (MAX_NODES + 1) // 2, "graph too large")
    return spread_groups(pairs, "graph_id")


def weight_matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted node labels and the symmetric matrix of edge counts."""
    nodes = np.unique(np.concatenate([pdf["a"].to_numpy(object), pdf["b"].to_numpy(object)]))
    if len(nodes) > MAX_NODES:
        raise ValueError(f"graph with {len(nodes)} nodes; orders are computed for at most {MAX_NODES}")
    at = {n: i for i, n in enumerate(nodes)}
    matrix = np.zeros((len(nodes), len(nodes)), dtype=np.int64)
    for a, b, w in zip(pdf["a"], pdf["b"], pdf["w"]):
        matrix[at[a], at[b]] += w
        if a != b:
            matrix[at[b], at[a]] += w
    return nodes, matrix


def crossings(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a matrix in layout order: crossings with later-starting edges and with all edges, for every position pair s < t."""
    n = len(matrix)
    upper = np.triu(matrix, 1)
    below = np.zeros((n + 1, n + 1), dtype=np.int64)
    below[1:, 1:] = upper.cumsum(0).cumsum(1)
    s, t = np.triu_indices(n, 1)
    starts, ends = below[:, n], below[n, :]
    later = np.zeros((n, n), dtype=np.int64)
    earlier = np.zeros((n, n), dtype=np.int64)
    later[s, t] = starts[t] - starts[s + 1] - ends[t + 1] + below[s + 1, t + 1]
    earlier[s, t] = below[s, t] - ends[s + 1]
    both = later + earlier
    return later, both + both.T


def total_crossings(matrix: np.ndarray, order: list[int]) -> int:
    placed = matrix[np.ix_(order, order)]
    return int((np.triu(placed, 1) * crossings(placed)[0]).sum())


def incident_crossings(matrix: np.ndarray, order: list[int]) -> np.ndarray:
    """Crossings on the edges of each position."""
    placed = matrix[np.ix_(order, order)]
    return (placed * crossings(placed)[1]).sum(1)


def avsdf(matrix: np.ndarray) -> list[int]:
    """Depth-first from the smallest degree, neighbours of smallest degree first; a new start for each component."""
    degree = matrix.sum(1)
    by_degree = sorted(range(len(matrix)), key=lambda i: (degree[i], i))
    placed: dict[int, None] = {}
    for start in by_degree:
        stack = [start]
        while stack:
            node = stack.pop()
            if node in placed:
                continue
            placed[node] = None
            fresh = [i for i in np.flatnonzero(matrix[node]).tolist() if i not in placed]
            stack.extend(sorted(fresh, key=lambda i: (-degree[i], -i)))
    return list(placed)


def baur_brandes(matrix: np.ndarray) -> list[int]:
    """Append the node with the fewest unplaced neighbours to the end where its edges cross fewer open edges."""
    n = len(matrix)
    degree = matrix.sum(1)
    linked = matrix > 0
    np.fill_diagonal(linked, False)
    rank = np.empty(n, dtype=np.int64)
    rank[sorted(range(n), key=lambda i: (degree[i], i))] = np.arange(n)
    order = [int(rank.argmax())]
    free = np.ones(n, dtype=bool)
    free[order[0]] = False
    while free.any():
        candidates = np.flatnonzero(free)
        missing = (linked[candidates] & free).sum(1)
        node = int(candidates[np.lexsort((rank[candidates], missing))[0]])
        free[node] = False
        ends = np.array(order)
        closing = matrix[ends, node]
        still_open = matrix[np.ix_(ends, np.flatnonzero(free))].sum(1)
        left = int((closing * (still_open.cumsum() - still_open)).sum())
        right = int((closing * (still_open.sum() - still_open.cumsum())).sum())
        order = [*order, node] if right < left else [node, *order]
    return order


def swap_totals(placed: np.ndarray, crossed: np.ndarray, total: int, here: int, others: np.ndarray) -> np.ndarray:
    """Crossings of the whole layout after the node at ``here`` trades places with each of ``others``.

    Only the edges of the two nodes change. At its new place an edge crosses what the chord there crosses in the old layout, less the
    edges of the same node at the old place, plus those of the other node, which is there now; both are counts of neighbours between two
    places, so they come from running sums. ``placed`` is the matrix in layout order without loops, ``crossed`` its chords' crossings.
    """
    z, q = np.arange(len(placed))[None, :], others[:, None]
    mine, theirs = placed[here][None, :], placed[others]
    n_mine, n_theirs = mine.sum(), theirs.sum(1, keepdims=True)
    so_far, their_so_far = mine.cumsum(1), theirs.cumsum(1)
    other_end = (z != here) & (z != q)

    def between(sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        low, high = (np.broadcast_to(x, (len(others), z.shape[1])) for x in (low, np.maximum(high - 1, 0)))
        sums = np.broadcast_to(sums, low.shape)
        return np.take_along_axis(sums, high, 1) - np.take_along_axis(sums, low, 1)

    def fan(row: np.ndarray, n: np.ndarray, sums: np.ndarray, anchor: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many of a node's edges, fastened at ``anchor``, cross the chord from ``end`` to each z."""
        low, high = np.minimum(end, z), np.maximum(end, z)
        inner = between(sums, low, high)
        at_end = np.take_along_axis(np.broadcast_to(row, inner.shape), np.broadcast_to(end, (len(others), 1)), 1)
        return np.where((low < anchor) & (anchor < high), n - inner - at_end - row, inner)

    p = np.array([[here]])
    mine_here, theirs_here = fan(mine, n_mine, so_far, p, q), fan(theirs, n_theirs, their_so_far, p, q)
    mine_there, theirs_there = fan(mine, n_mine, so_far, q, p), fan(theirs, n_theirs, their_so_far, q, p)
    shared = crossed[here, others] * placed[here, others]
    old = (mine * crossed[here][None, :]).sum() + (theirs * crossed[others]).sum(1) - (mine * theirs_there * other_end).sum(1)
    new = (mine * (crossed[others] - mine_here) * other_end).sum(1) + shared
    new = new + (theirs * (crossed[here][None, :] - theirs_there + mine_there) * other_end).sum(1) + shared
    return total - old + new


def local_adjusting(matrix: np.ndarray, order: list[int]) -> list[int]:
    """Swap each node with the neighbour that lowers the crossings most; nodes by falling incident crossings."""
    order = list(order)
    placed = matrix[np.ix_(order, order)].copy()
    np.fill_diagonal(placed, 0)
    later, crossed = crossings(placed)
    load = (placed * crossed).sum(1)
    total = int((np.triu(placed, 1) * later).sum())
    for node in [order[p] for p in sorted(range(len(order)), key=lambda p: (-load[p], order[p]))]:
        here = order.index(node)
        others = np.flatnonzero(placed[here])
        if not len(others):
            continue
        trials = swap_totals(placed, crossed, total, here, others)
        best = int(trials.argmin())
        if trials[best] < total:
            total, there = int(trials[best]), int(others[best])
            order[here], order[there] = order[there], order[here]
            swap = np.arange(len(order))
            swap[[here, there]] = there, here
            placed = placed[np.ix_(swap, swap)]
            crossed = crossings(placed)[1]
    return order


def compute_orders(matrix: np.ndarray, methods: Sequence[str]) -> dict[str, list[int]]:
    """Orders by method; a method and its adjusted variant share the first placement."""
    base: dict[str, list[int]] = {}
    orders = {}
    for method in methods:
        kind = method.removesuffix("_la")
        if kind not in base:
            base[kind] = avsdf(matrix) if kind == "avsdf" else baur_brandes(matrix)
        orders[method] = local_adjusting(matrix, base[kind]) if method.endswith("_la") else base[kind]
    return orders


def order_graphs_by(edges: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """``(graph_id, method, node, pos)`` of every graph and method, each graph gathered once."""
    unknown = [m for m in methods if m not in METHODS]
    if unknown:
        raise ValueError(f"unknown order {unknown[0]!r}; known: {', '.join(METHODS)}")
    methods = list(methods)

    def one_graph(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, matrix = weight_matrix(pdf)
        parts = [
            pd.DataFrame({"method": method, "node": nodes[order], "pos": np.arange(len(order), dtype="int32")})
            for method, order in compute_orders(matrix, methods).items()
        ]
        out = pd.concat(parts)
        out.insert(0, "graph_id", pdf["graph_id"].iloc[0])
        return out

    return _graphs(edges).groupBy("graph_id").applyInPandas(one_graph, "graph_id string, method string, node string, pos int")


def order_graphs(edges: DataFrame, *, method: str) -> DataFrame:
    """``(graph_id, node, pos)`` of every graph."""
    return order_graphs_by(edges, [method]).drop("method")
