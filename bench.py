"""Headline timings: one JSON line.

Mining by three algorithms over rising supports, utility mining over rising thresholds, the batch by tag, and the node orders of
sampled pair graphs (all sizes of a method in one grouped job). Inputs are written once before the clock starts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SUPPORTS = (0.05, 0.15, 0.25, 0.35)
UTILITIES = (0.01, 0.05, 0.2)


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from setscope.functions.tables import materialise
    from setscope.operators import graph as G
    from setscope.operators import itemsets as I
    from setscope.operators import ordering as O
    from setscope.operators import sequences as S
    from setscope.operators import utility as U
    from setscope.operators.baskets import basket_items, sequence_shape
    from setscope.plans import queries_utility, sweep
    from setscope.plans.stored import brand_order, pair_graphs
    from setscope.sources import bindings as D

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("setscope-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="setscope-bench-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    rows: dict[str, int] = {}

    def timed(name, build):
        start = time.time()
        rows[name] = len(build().collect())
        times[name] = round(time.time() - start, 3)

    baskets = materialise(basket_items(D.basket_maps(spark, SF_DIR, "p_type"), 0.05), "bench-baskets")
    transactions = materialise(D.type_transactions(spark, SF_DIR), "bench-transactions")
    utilities = D.type_utilities(spark)
    sequences = materialise(sequence_shape(D.order_sequences(spark, SF_DIR)), "bench-sequences")
    baskets.groupBy(F.size("items")).count().collect()
    # Python workers are started before the clock, too.
    spark.range(int(CPUS), numPartitions=int(CPUS)).mapInPandas(lambda frames: frames, "id bigint").collect()

    for support in SUPPORTS:
        timed(f"fpgrowth_{support}", lambda: I.frequent_itemsets(baskets, min_support=support))
        timed(f"levelwise_{support}", lambda: I.frequent_itemsets_levelwise(baskets, min_support=support))
        timed(f"son_{support}", lambda: I.frequent_itemsets_son(baskets, min_support=support))
    for share in UTILITIES:
        timed(f"high_utility_{share}", lambda: U.high_utility_itemsets(transactions, utilities, min_util=share, unique=True))
    timed("sequences_0.01", lambda: S.frequent_sequences(sequences, min_support=0.01))
    timed("frequent_by_tag", lambda: queries_utility.mined_frequent(spark, SF_DIR))
    timed("high_utility_by_tag", lambda: queries_utility.mined_high_utility(spark, SF_DIR))

    pairs = materialise(pair_graphs(spark, SF_DIR), "bench-pairs")
    whole = pairs.filter(F.col("graph_id") == "all")
    samples = materialise(sweep.sample_graphs(whole, sweep.SINGLE_SIZES, seed="bench", skip_larger=False), "bench-samples")
    crossings: dict[str, dict[int, int]] = {}
    sizes = samples.select("graph_id", "n").distinct()

    def count(order) -> dict[int, int]:
        totals = G.crossings_total(G.edge_positions(samples, order)).join(sizes, "graph_id")
        return {r.n: r.crossings for r in totals.orderBy("n").collect()}

    crossings["default"] = count(brand_order(spark))
    for method in O.METHODS:
        timed(f"order_{method}", lambda: O.order_graphs(samples, method=method))
        crossings[method] = count(O.order_graphs(samples, method=method))
    start = time.time()
    placed = G.edge_positions(pairs, brand_order(spark))
    G.crossings_per_edge(placed).collect()
    times["crossings_per_edge"] = round(time.time() - start, 3)

    print(
        json.dumps(
            {
                "metric": "pattern_analytics_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(CPUS),
                "rows": rows,
                "crossings": crossings,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
