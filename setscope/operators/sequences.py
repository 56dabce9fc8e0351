"""Frequent sequences: MLlib's PrefixSpan over array columns, and a native miner over events in long form.

PrefixSpan reads a sequence as one array, which suits sources that store it so. The native miner never gathers the events of a
sequence. It sorts all events by sequence and order and cuts them into ranges of equal size, so a sequence that holds much of the table
lies in many ranges. From them it builds a next-event table: for an event and each label that may follow it in a frequent pattern, the
place of the next event with that label. Inside a range that is one window; from range to range, the first places of a label in the
ranges behind are enough. A pattern's earliest match in a sequence ends at one place, and the earliest match of the pattern with one
more label ends at the next event of that label, so widening a pattern is an equality join on the place: no event meets a pattern that
does not end there, and no match has to be found twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import PrefixSpan
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setscope.functions.columns import join_same
from setscope.functions.tables import materialise, task_slots
from setscope.operators.itemsets import support_floor

# Pattern length and local projection size of the sequence run.
MAX_PATTERN_LENGTH = 5
MAX_LOCAL_PROJECTION = 32_000_000
#: Rows of a counted table that is broadcast at most.
BROADCAST_KEYS = 200_000


def frequent_sequences(
    sequences: DataFrame,
    *,
    min_support: float = 0.2,
    max_pattern_length: int = MAX_PATTERN_LENGTH,
    max_local_projection: int = MAX_LOCAL_PROJECTION,
    sequence_col: str = "sequence",
) -> DataFrame:
    """``(sequence, k, freq, value, n)`` of patterns that at least ``ceil(s * n)`` sequences contain."""
    source = materialise(sequences.filter(F.col(sequence_col).isNotNull()).select(sequence_col), "sequences")
    n = source.count()
    found = PrefixSpan(
        minSupport=min_support,
        maxPatternLength=max_pattern_length,
        maxLocalProjDBSize=max_local_projection,
        sequenceCol=sequence_col,
    ).findFrequentSequentialPatterns(source)
    return found.select(
        "sequence",
        F.aggregate("sequence", F.lit(0), lambda acc, s: acc + F.size(s)).alias("k"),
        "freq",
        (F.col("freq") / F.lit(n)).alias("value"),
        F.lit(n).cast("bigint").alias("n"),
    )


def placed_events(events: DataFrame, id_cols: Sequence[str], order_cols: Sequence[str], label_col: str) -> DataFrame:
    """``(of_0, of_1..., label, range, pos)``: events of all sequences in one order, the ids by number; ``pos`` grows along a sequence,
    ``range`` is its block."""
    ids, along = [f"of_{i}" for i in range(len(id_cols))], [f"at_{i}" for i in range(len(order_cols))]
    rows = events.select(*[F.col(c).alias(a) for c, a in zip([*id_cols, *order_cols, label_col], [*ids, *along, "label"])])
    rows = rows.filter("label is not null").repartitionByRange(task_slots(events.sparkSession), *ids, *along).sortWithinPartitions(*ids, *along)
    rows = rows.select(*ids, "label", F.monotonically_increasing_id().alias("pos"))
    # The number's upper bits are those of the partition, which is a range of the order.
    return materialise(rows, "sequence-events").withColumn("range", F.shiftright("pos", 33))


def next_events(events: DataFrame, pairs: DataFrame, ids: Sequence[str]) -> DataFrame:
    """``(pos, label, next)``: for each placed event and each label that ``pairs(label, follower)`` lets follow its own, the place of the
    next event with that label in the same sequence, if there is one."""
    asked = events.join(pairs, "label").select(*ids, "range", F.col("follower").alias("label"), "pos", F.lit(0).alias("is_event"))
    given = events.join(pairs.select(F.col("follower").alias("label")).distinct(), "label", "left_semi")
    given = given.select(*ids, "range", "label", "pos", F.lit(1).alias("is_event"))
    # Backwards through a range, an event comes after what is asked at its own place, so it never follows itself.
    behind = Window.partitionBy(*ids, "range", "label").orderBy(F.desc("pos"), "is_event")
    seen = F.last(F.when(F.col("is_event") == 1, F.col("pos")), ignorenulls=True).over(behind.rowsBetween(Window.unboundedPreceding, 0))
    found = asked.unionByName(given).withColumn("next", seen).filter("is_event = 0")
    # Only sequences cut by the bound of a range go on elsewhere, one for each bound at most; their first places are few.
    cut = events.groupBy(*ids).agg(F.min("range").alias("low"), F.max("range").alias("high")).filter("low < high").drop("low", "high")
    firsts = join_same(given, cut, ids, "left_semi").groupBy(*ids, "label", "range").agg(F.min("pos").alias("first"))
    later = firsts.groupBy(*ids, "label").agg(F.sort_array(F.collect_list(F.struct("range", "first"))).alias("firsts"))
    later = materialise(later, "sequence-later-ranges")
    later = F.broadcast(later) if later.count() <= BROADCAST_KEYS else later
    found = join_same(found, later, [*ids, "label"], "left")
    elsewhere = F.get(F.filter("firsts", lambda x: x["range"] > F.col("range")), F.lit(0))["first"]
    return found.select("pos", "label", F.coalesce("next", elsewhere).alias("next")).filter("next is not null")


def frequent_sequences_long(
    events: DataFrame,
    *,
    id_cols: Sequence[str],
    order_cols: Sequence[str],
    label_col: str = "label",
    min_support: float = 0.2,
    max_pattern_length: int = MAX_PATTERN_LENGTH,
) -> DataFrame:
    """``(sequence, k, freq, value, n)``, ``sequence`` an array of labels; one event per row, ``order_cols`` unique per sequence.

    Events without a label match nothing; their sequences count in ``n``.
    """
    n = events.select(*id_cols).distinct().count()
    ids = [f"of_{i}" for i in range(len(id_cols))]
    floor = support_floor(F.lit(n), min_support, strict=False)
    placed = placed_events(events, id_cols, order_cols, label_col)
    # First and last place of each label in a sequence: enough for patterns of one and two labels.
    ends = materialise(placed.groupBy(*ids, "label").agg(F.min("pos").alias("end"), F.max("pos").alias("last")), "sequence-ends")
    found = [_counted(ends.select(F.array("label").alias("sequence")), floor, 1)]
    if max_pattern_length > 1 and not found[0].isEmpty():
        frequent = found[0].select(F.get("sequence", F.lit(0)).alias("label"))
        kept = ends.join(frequent, "label", "left_semi")
        second = kept.select(*ids, F.col("label").alias("follower"), F.col("last").alias("until"))
        both = join_same(kept, second, ids).filter("until > end")
        found.append(_counted(both.select(F.array("label", "follower").alias("sequence")), floor, 2))
        states = kept.select(*ids, F.array("label").alias("sequence"), "end")
    if max_pattern_length > 2 and len(found) == 2 and not found[1].isEmpty():
        pairs = found[1].select(F.get("sequence", F.lit(0)).alias("label"), F.get("sequence", F.lit(1)).alias("follower"))
        following = materialise(next_events(placed, pairs, ids), "sequence-next-events").withColumnRenamed("pos", "end")
        for k in range(2, max_pattern_length + 1):
            longer = states.join(following, "end").select(*ids, F.concat("sequence", F.array("label")).alias("sequence"), F.col("next").alias("end"))
            longer = longer if k == max_pattern_length else materialise(longer, f"sequence-matches-{k}")
            if k > 2:
                found.append(_counted(longer.select("sequence"), floor, k))
                if found[-1].isEmpty():
                    break
            states = longer.join(found[k - 1].select("sequence"), "sequence", "left_semi")
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result.select(
        "sequence",
        F.size("sequence").alias("k"),
        "freq",
        (F.col("freq") / F.lit(n)).alias("value"),
        F.lit(n).cast("bigint").alias("n"),
    )


def _counted(matches: DataFrame, floor: Column, k: int) -> DataFrame:
    """``(sequence, freq)`` of the patterns that enough sequences hold; a sequence gives a pattern one row."""
    counts = matches.groupBy("sequence").agg(F.count(F.lit(1)).alias("freq"))
    return materialise(counts.filter(F.col("freq") >= floor), f"sequences-{k}")
