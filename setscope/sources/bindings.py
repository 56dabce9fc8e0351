"""Star-schema tables as baskets, tracks, metadata, sequences and pair graphs.

An order is a track, the brands or types of its parts are its labels, quantities are the weights. Each aggregate is keyed so that
partial sums meet before the shuffle; an order's map holds at most one entry per label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setscope.functions.columns import join_same
from setscope.functions.tables import local_table, materialise

# Unit utilities per part type.
TYPE_UTILITY = {"ECONOMY": 1, "LARGE": 5, "MEDIUM": 3, "PROMO": 2, "SMALL": 1, "STANDARD": 4}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["automobile", "building", "furniture", "household", "machinery"]
TAGS = PRIORITIES + SEGMENTS
BRANDS = [f"Brand#{i}" for i in range(1, 26)]
BRAND_PARENT = {f"Brand#{i}": f"Group#{i % 5}" for i in range(1, 26)}
PARENTS = [f"Group#{i}" for i in range(5)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _percent() -> Column:
    """Discount of a line in whole percent."""
    return F.round(F.col("l_discount") * 100).cast("bigint")


def weights(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """``(id, item, weight, percent, lines)``: whole quantity, discount and line count per order and label.

    Lines are dealt by order once; the sums of labels, and whatever is gathered per order behind them, need no other shuffle.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col(label).alias("item"))
    quantity = F.col("l_quantity").cast("bigint").alias("quantity")
    labelled = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    labelled = labelled.select(F.col("l_orderkey").alias("id"), "item", quantity, _percent().alias("percent"))
    return (
        labelled.repartition("id")
        .groupBy("id", "item")
        .agg(F.sum("quantity").alias("weight"), F.sum("percent").alias("percent"), F.count(F.lit(1)).alias("lines"))
    )


def _confidence(percent: Column, lines: Column) -> Column:
    return F.lit(1.0) - percent.cast("double") / (F.lit(10.0) * lines)


def shares(weights: str) -> Column:
    """Shares of a map of weights in the order's total."""
    return F.transform_values(weights, lambda _, w: w / F.col("total"))


def basket_maps(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """``(_id, confidence, weights map, items map)``: whole weights and shares of an order, from one scan of the lines."""
    per_id = weights(spark, sf_dir, label).groupBy(F.col("id").alias("_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("item", "weight"))).alias("weights"),
        F.sum("weight").alias("total"),
        _confidence(F.sum("percent"), F.sum("lines")).alias("confidence"),
    )
    return per_id.select("_id", "confidence", "weights", shares("weights").alias("items"))


def baskets_long(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """``(id, item, weight, share)``."""
    rows = basket_maps(spark, sf_dir, label).select("_id", "items", F.explode("weights").alias("item", "weight"))
    return rows.select(F.col("_id").alias("id"), "item", "weight", F.col("items")[F.col("item")].alias("share"))


def tracks(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """``(_id, confidence, items map)``."""
    return basket_maps(spark, sf_dir, label).select("_id", "confidence", "items")


def part_kinds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(p_partkey, kind)`` and ``(kind, brand, type, copies, lead)``: the labels of every part, by the number of their kind.

    A line carries that number through shuffles instead of its labels. Both tables are written, so their known sizes decide how they are
    joined. Rows of a part with equal labels are one row with their number. One row of each part leads, so a line can still be counted once.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    known = parts.filter(F.col("p_partkey").isNotNull()).repartition("p_partkey")
    merged = known.groupBy("p_partkey", "brand", "type").agg(F.count(F.lit(1)).alias("copies"))
    # The labels of one part are at most the label domain.
    turn = F.row_number().over(Window.partitionBy("p_partkey").orderBy("brand", "type"))
    labels = materialise(merged.withColumn("lead", turn == 1), "part-labels")
    told = ["brand", "type", "copies", "lead"]
    kinds = materialise(labels.select(told).distinct().select(F.monotonically_increasing_id().alias("kind"), *told), "kinds")
    return materialise(join_same(labels, kinds, told).select("p_partkey", "kind"), "part-kinds"), kinds


def _sums_by(entries: str, label: str) -> Column:
    """Map from each label of an order's entries to its weight; like a sum, null weights do not count."""
    def weight(key: Column) -> Column:
        own = F.filter(entries, lambda e: (e[label] == key) & e["weight"].isNotNull())
        return F.aggregate(own, F.lit(None).cast("bigint"), lambda acc, e: F.coalesce(acc, F.lit(0)) + e["weight"])

    labels = F.array_distinct(F.transform(entries, lambda e: e[label]))
    return F.map_from_entries(F.transform(labels, lambda key: F.struct(key.alias("key"), weight(key).alias("value"))))


def order_labels(spark: SparkSession, sf_dir: str, above: float) -> DataFrame:
    """``(_id, confidence, plain_confidence, total, brands map, types map)`` of orders with one of the two confidences above a bound.

    What ``basket_maps`` of both labels and ``plain_tracks`` tell, from one scan of the lines dealt by order once: ``confidence`` is of
    the lines with a part, ``plain_confidence`` of all lines, and the maps hold whole weights. Lines are dealt as they are read, with the
    kind of their part; numbers and labels are made behind the shuffle.
    """
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey", "l_quantity", "l_discount")
    parts, kinds = part_kinds(spark, sf_dir)
    labelled = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    dealt = labelled.select("id", "kind", "l_quantity", "l_discount").repartition("id")
    per_kind = dealt.groupBy("id", "kind").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"), F.sum(_percent()).alias("own"), F.count(F.lit(1)).alias("n")
    )
    lead = F.coalesce("lead", F.lit(True))
    per_pair = per_kind.join(kinds, "kind", "left").select(
        "id",
        "brand",
        "type",
        (F.col("quantity") * F.col("copies")).alias("weight"),
        (F.col("own") * F.col("copies")).alias("percent"),
        (F.col("n") * F.col("copies")).alias("lines"),
        F.when(lead, F.col("own")).alias("all_percent"),
        F.when(lead, F.col("n")).otherwise(0).alias("all_lines"),
    )
    # Lines without a part have no copies, so they are no entry.
    entry = F.when(F.col("lines").isNotNull(), F.struct("brand", "type", "weight"))
    per_id = per_pair.groupBy(F.col("id").alias("_id")).agg(
        F.collect_list(entry).alias("entries"),
        F.sum("weight").alias("total"),
        _confidence(F.sum("percent"), F.sum("lines")).alias("confidence"),
        _confidence(F.sum("all_percent"), F.sum("all_lines")).alias("plain_confidence"),
    )
    sure = per_id.filter((F.col("confidence") > above) | (F.col("plain_confidence") > above))
    return sure.select(
        "_id", "confidence", "plain_confidence", "total", _sums_by("entries", "brand").alias("brands"), _sums_by("entries", "type").alias("types")
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata documents of the orders, ids as digit strings, two tag families."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    places = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "n_name", "r_name")
    )
    # Customers meet their places first, so orders are dealt by customer only.
    placed = customers.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = orders.join(placed, F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey").cast("string")
    tags = F.struct(
        F.array("o_orderpriority", F.lower("c_mktsegment")).alias("genres"), F.array("n_name", "r_name").alias("vartags")
    )
    return joined.select(
        key.alias("_id"),
        F.concat(F.lit("Order &amp; "), key, F.lit(" &amp; "), "o_orderstatus").alias("name"),
        F.concat("c_name", F.lit(" &amp; Co")).alias("artist_name"),
        F.concat(F.lit("img/"), key).alias("image"),
        F.concat(F.lit("audio/"), key).alias("audio"),
        F.struct(tags.alias("tags")).alias("musicinfo"),
    )


def sequence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user_id, day, ts, event_id, label)``: events with the key of their sequence, a user's whole day."""
    return table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", F.col("event_type").alias("label"))


def order_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(_id, seq array<struct<label>>)``: the part types of an order's lines by line and part number.

    The lines of one order are few by nature, so they are gathered; events of a user have no such bound and stay in long form.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("label"))
    ordered = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "label"))).alias("e")
    per_order = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(ordered)
    return per_order.select(
        F.col("l_orderkey").cast("string").alias("_id"), F.transform("e", lambda x: F.struct(x["label"].alias("label"))).alias("seq")
    )


def brand_roll_up(spark: SparkSession) -> DataFrame:
    return local_table(spark, {"item": list(BRAND_PARENT), "parent": list(BRAND_PARENT.values())})


def type_utilities(spark: SparkSession) -> DataFrame:
    return local_table(spark, {"item": list(TYPE_UTILITY), "eutil": list(TYPE_UTILITY.values())})


def type_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(tid, item, qty)`` with whole quantities."""
    return weights(spark, sf_dir, "p_type").select(F.col("id").alias("tid"), "item", F.col("weight").alias("qty"))


def filtered_type_transactions(spark: SparkSession, sf_dir: str, ratio: float, confidence: float) -> DataFrame:
    """``(tid, item, qty)`` with whole quantities, for shares above the ratio in confident orders."""
    rows = basket_maps(spark, sf_dir, "p_type").filter(F.col("confidence") > confidence).select(
        F.col("_id").alias("tid"), "items", F.explode("weights").alias("item", "qty")
    )
    return rows.filter(F.col("items")[F.col("item")] > ratio).select("tid", "item", "qty")


def plain_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(_id, confidence)`` without label maps."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("_id"))
    return lines.agg(_confidence(F.sum(_percent()), F.count(F.lit(1))).alias("confidence"))
