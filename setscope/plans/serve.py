"""Served compositions: stored itemsets filtered, ordered and clustered for a chart, and the track search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setscope.functions.columns import string_array
from setscope.functions.tables import materialise
from setscope.operators.baskets import normal_ids, tags_all_of, tracks_with_items, with_ranked_items

# Size of a track sample and share bound of the item search.
SAMPLE_SIZE = 5
ITEM_SHARE = 0.05
ORDER_METHODS = ("avsdf", "avsdf_la", "bb", "bb_la")


def _wanted(tag_vals: str | Sequence[str]) -> list[str]:
    return tag_vals.split(",") if isinstance(tag_vals, str) else list(tag_vals)


def served_sets(
    results: DataFrame,
    *,
    tag_name: str = "genres",
    tag_vals: str | Sequence[str] | None = None,
    fi_type: str = "frequent",
    rollup: bool = False,
) -> DataFrame:
    """``(tag, labels, value)`` of the stored runs of some tags, or of the whole collection.

    Pattern types other than high-utility mean frequent; high-utility sets exist without roll-up only.
    """
    fi_type = "hui" if fi_type == "hui" else "frequent"
    rollup = rollup and fi_type == "frequent"
    rows = results.filter((F.col("fi_type") == fi_type) & (F.col("rollup") == rollup))
    if tag_vals is None:
        rows = rows.filter(F.col("tag").isNull())
    else:
        rows = rows.filter((F.col("tag_name") == tag_name) & F.col("tag").isin(_wanted(tag_vals)))
    return rows.select("tag", F.col("itemset").alias("labels"), "value")


def of_size(sets: DataFrame, k: int) -> DataFrame:
    return sets.filter(F.size("labels") == k)


def pairs_only(sets: DataFrame) -> DataFrame:
    return of_size(sets, 2)


def singletons(sets: DataFrame) -> DataFrame:
    return of_size(sets, 1)


def multiples(sets: DataFrame) -> DataFrame:
    return sets.filter(F.size("labels") > 1)


def sets_above(sets: DataFrame, percent: float) -> DataFrame:
    """Sets with a value strictly above a percentage."""
    return sets.filter(F.col("value") > F.lit(float(percent)) / 100)


def sets_touching(sets: DataFrame, selected: Sequence[str]) -> DataFrame:
    """Sets that hold any selected label; nothing selected keeps all."""
    return sets if not selected else sets.filter(F.arrays_overlap("labels", string_array(list(selected))))


def max_singleton(sets: DataFrame) -> DataFrame:
    """``(label, value)``: highest value of each single label over the tags."""
    return singletons(sets).groupBy(F.col("labels")[0].alias("label")).agg(F.max("value").alias("value"))


def missing_singletons(sets: DataFrame, order: DataFrame) -> DataFrame:
    """``(label, value 0)``: labels of the order that are no singleton."""
    found = max_singleton(sets).select("label")
    return (
        order.select(F.col("node").alias("label"))
        .join(found, "label", "left_anti")
        .withColumn("value", F.lit(0.0))
    )


def order_support(sets: DataFrame, order: DataFrame) -> DataFrame:
    """``(node, pos)`` by falling singleton value, ties by label; labels without one come last.

    The window covers the label domain, one row per label.
    """
    values = max_singleton(sets).unionByName(missing_singletons(sets, order))
    rank = Window.partitionBy(F.lit(0)).orderBy(F.desc("value"), "label")
    return values.select(F.col("label").alias("node"), (F.row_number().over(rank) - 1).alias("pos"))


def order_by_rank(nodes: DataFrame, *ranks: Column) -> DataFrame:
    """``(node, pos)`` along rank columns, e.g. root and quality; the window covers the label domain."""
    along = Window.partitionBy(F.lit(0)).orderBy(*ranks, "node")
    return nodes.select("node", (F.row_number().over(along) - 1).alias("pos"))


def sets_ordered(sets: DataFrame, order: DataFrame) -> DataFrame:
    """Sets with ``labels`` sorted by position and the positions beside them. Labels outside the order drop out."""
    keyed = sets.withColumn("set_key", F.col("labels"))
    long = keyed.select("tag", "set_key", "value", F.explode("labels").alias("node")).join(order, "node")
    sorted_labels = F.sort_array(F.collect_list(F.struct("pos", "node")))
    rows = long.groupBy("tag", "set_key", "value").agg(sorted_labels.alias("by_pos"))
    return rows.select(
        "tag",
        F.transform("by_pos", lambda s: s["node"]).alias("labels"),
        F.transform("by_pos", lambda s: s["pos"]).alias("positions"),
        "value",
    )


def sets_json(sets: DataFrame) -> DataFrame:
    """One JSON text per set."""
    body = F.to_json(F.struct("labels", F.col("value").alias("values"), "tag"), {"ignoreNullFields": "false"})
    return sets.select(body.alias("json"))


def pair_edges(sets: DataFrame, graph: Column) -> DataFrame:
    """``(graph_id, u, v, value)`` of the pairs among the sets."""
    return pairs_only(sets).select(
        graph.alias("graph_id"), F.col("labels")[0].alias("u"), F.col("labels")[1].alias("v"), "value"
    )


def choose_order(edges: DataFrame, default: DataFrame, method: str | None = None) -> DataFrame:
    """``(graph_id, node, pos)`` by one of the ordering methods, or the default order for every graph."""
    if method is None:
        graphs = edges.select("graph_id").distinct()
        # One array per graph; the default order is a label domain.
        whole = default.agg(F.collect_list(F.struct("node", "pos")).alias("o"))
        return graphs.select("graph_id", F.explode(whole.scalar()).alias("o")).select("graph_id", "o.node", "o.pos")
    if method not in ORDER_METHODS:
        raise ValueError(f"unknown order {method!r}; known: {', '.join(ORDER_METHODS)}")
    from setscope.operators.ordering import order_graphs

    return order_graphs(edges, method=method)


def serve_circular(
    results: DataFrame, default: DataFrame, *, order_opt: str | None = None, **request
) -> tuple[DataFrame, DataFrame]:
    """Pairs and node order of the circular chart. All requested tags form one graph."""
    sets = pairs_only(served_sets(results, **request))
    order = choose_order(pair_edges(sets, F.lit("all")), default, order_opt).drop("graph_id") if order_opt else default
    return sets, order


def serve_hier(results: DataFrame, default: DataFrame, **request) -> tuple[DataFrame, DataFrame]:
    """Pairs of the hierarchical chart, always in the default order."""
    return pairs_only(served_sets(results, **request)), default


def serve_parallel(
    results: DataFrame, default: DataFrame, *, by_support: bool = False, **request
) -> tuple[DataFrame, DataFrame]:
    """Sets of two and more labels sorted along the node order, and that order."""
    sets = served_sets(results, **request)
    order = order_support(sets, default) if by_support else default
    return sets_ordered(multiples(sets), order), order


def serve_circ_clust(
    results: DataFrame, default: DataFrame, *, order_opt: str | None = None, **request
) -> tuple[DataFrame, DataFrame]:
    """Oriented pairs with their cluster, and the node order."""
    from setscope.operators.cluster import cluster_pairs, pair_features

    sets, order = serve_circular(results, default, order_opt=order_opt, **request)
    return cluster_pairs(pair_features(sets, order)), order


def serve_parallel_clust(
    results: DataFrame, default: DataFrame, *, by_support: bool = False, **request
) -> tuple[DataFrame, DataFrame]:
    """The ordered sets, each with the list of its clusters by axis, and the node order."""
    from setscope.operators.cluster import axis_segments, cluster_axis, set_clusters

    sets, order = serve_parallel(results, default, by_support=by_support, **request)
    return set_clusters(cluster_axis(axis_segments(sets))), order


def sample_tracks(meta: DataFrame, *, seed: str, n: int = SAMPLE_SIZE) -> DataFrame:
    """``n`` distinct rows in an order fixed by the seed; all rows when there are fewer."""
    return meta.orderBy(F.md5(F.concat(F.lit(seed), F.col("_id").cast("string")))).limit(n)


def matching_tracks(
    meta: DataFrame,
    tracks: DataFrame,
    *,
    tag_name: str = "genres",
    tag_vals: str | Sequence[str] | None = None,
    items: Sequence[str] = (),
) -> DataFrame:
    """Metadata of the tracks that have all tags and, above the share bound, all items; with items, their share map too."""
    found = normal_ids(meta if tag_vals is None else tags_all_of(meta, tag_name, tag_vals))
    if items:
        found = found.join(tracks_with_items(tracks, items, ITEM_SHARE).select("_id", "items"), "_id")
    return found


def search_tracks(
    meta: DataFrame, tracks: DataFrame, *, seed: str, n: int = SAMPLE_SIZE, items: Sequence[str] = (), **request
) -> DataFrame:
    """A sample of the matching tracks with their labels by falling share.

    With an item search the shares come along with the match. Without one they are fetched for the sample, which is written first: it
    is computed once, and its known size decides how it is joined.
    """
    sample = sample_tracks(matching_tracks(meta, tracks, items=items, **request), seed=seed, n=n)
    if not items:
        sample = materialise(sample, "search")
        wanted = tracks.join(sample.select("_id"), "_id", "left_semi").select("_id", "items")
        sample = sample.join(wanted, "_id", "left")
    return with_ranked_items(sample)


def _first_ampersand(name: str) -> Column:
    """A name with its first ``&amp;`` decoded."""
    col, at = F.col(name), F.instr(F.col(name), "&amp;")
    return F.when(at > 0, F.concat(F.substring(col, F.lit(1), at - 1), F.lit("&"), F.substring(col, at + 5, F.length(col)))).otherwise(col)


def track_table(found: DataFrame) -> DataFrame:
    """Display columns of searched tracks: decoded names, tag text, labels with their share of the track's largest."""
    tags = F.transform(
        "musicinfo.tags.genres", lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))
    )
    return found.select(
        "_id",
        "image",
        "audio",
        _first_ampersand("name").alias("name"),
        _first_ampersand("artist_name").alias("artist_name"),
        F.array_join(tags, ", ").alias("tags"),
        "labels",
        F.transform("shares", lambda s: s / F.array_max("shares")).alias("relative"),
    )
