"""Benchmark decontamination: a prefix-filtered set join of item windows with documents. DataFrame functions only.

An item's windows are its runs of ``size`` words; a shorter item is one window. A document contains a window if the words stand in it
one after the other. Windows are sets of shingles; as all of them must occur, one necessary token of each window is enough to find
every candidate, and the rarest in the corpus finds the fewest. So

1. the documents' shingles are joined with those of the items: the occurrences, a small table;
2. counting them gives each window its prefix token, the rarest of its shingles;
3. occurrences of prefix tokens give candidates, a window start each; those that would begin before the document's first word or end
   after its last one are left out;
4. a candidate holds if all shingles of the window occur at their places. Shingles are compared as text, so that is exact.

Only step 1 reads the texts, and its other side, the items' shingles, is broadcast only below a checked number; above it the join is
shuffled. Words are runs of letters, digits and everything beyond ASCII, with A-Z lower-cased. Null texts have no words; items without
words have no windows; an item without an id is called by the empty string. A document is known by its id and a hash of its text, null
equal to null: rows repeated in full give repeated results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setscope.functions.tables import materialise
from setscope.llm.common import MARK_SEPARATORS, fields, lower_ascii, native_words, same

SIZE, SHINGLE = 10, 3
#: Shingles of all items that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
KEY = ["doc_id", "text_hash"]


def _words(df: DataFrame, **kinds: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    out = fields(df, text="string", **kinds)
    return out.select(*kinds, F.xxhash64(text).alias("text_hash"), native_words(lower_ascii(text), MARK_SEPARATORS).alias("words"))


def shingle_at(words: Column, i: Column, width: int) -> Column:
    """The shingle that starts at word ``i``."""
    return F.concat_ws(" ", *[F.get(words, i + j) for j in range(width)])


def shingles(words: Column, width: int) -> Column:
    """All shingles in order; empty for fewer words."""
    if width == 1:
        return words
    last = F.size(words) - F.lit(width)
    some = F.transform(F.sequence(F.lit(0), last), lambda i: shingle_at(words, i, width))
    return F.when(last >= 0, some).otherwise(F.array().cast("array<string>"))


def windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """``(item, window, length, words)``: the distinct windows of each item; ``window`` is their text."""
    words = _words(items, item_id="string").filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - F.lit(size), F.lit(0))
    cut = F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("words", i + F.lit(1), F.lit(size)))).alias("words")
    out = words.select(F.coalesce("item_id", F.lit("")).alias("item"), cut)
    return out.select("item", F.array_join("words", " ").alias("window"), F.size("words").alias("length"), "words").distinct()


def occurrences(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """Window starts ``(doc_id, text_hash, window, start, length)``, every one that is there, once."""
    spark = docs.sparkSession
    # A window of fewer words than a shingle is one shingle of its own.
    width = F.least(F.col("length"), F.lit(SHINGLE))
    steps = F.transform(
        F.sequence(F.lit(0), F.col("length") - width),
        lambda i: F.struct(i.alias("offset"), F.array_join(F.slice("words", i + F.lit(1), width), " ").alias("shingle")),
    )
    distinct = cut.select("window", "length", "words").distinct()
    needed = materialise(
        distinct.select("window", "length", (F.col("length") - width + 1).alias("n"), width.alias("width"), F.inline(steps)),
        "decontamination-windows",
    )
    tokens = needed.select("width", "shingle").distinct()
    sizes = {r["width"]: r["n"] for r in tokens.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = _words(docs, doc_id="bigint").select(*KEY, F.size("words").cast("bigint").alias("n_words"), "words")
    found = None
    for w in sorted(sizes) or [SHINGLE]:
        due = tokens.filter(F.col("width") == w)
        due = F.broadcast(due) if sum(sizes.values()) <= BROADCAST_ROWS else due
        each = rows.select(*KEY, "n_words", F.posexplode(shingles(F.col("words"), w)).alias("at", "shingle"))
        each = each.join(due, "shingle", "left_semi").withColumn("width", F.lit(w))
        found = each if found is None else found.unionByName(each)
    # Documents repeated in full count once.
    found = materialise(found, "decontamination-occurrences")
    counts = found.groupBy("width", "shingle").agg(F.count(F.lit(1)).alias("seen"))
    # A window with a shingle that is nowhere is nowhere.
    rated = needed.join(counts, ["width", "shingle"])
    prefix = rated.groupBy("window", "length", "n", "width").agg(
        F.min(F.struct("seen", "offset", "shingle")).alias("rarest"), F.count(F.lit(1)).alias("there")
    )
    prefix = prefix.filter("there = n").select("window", "length", "n", "width", "rarest.offset", "rarest.shingle")
    start = F.col("at") - F.col("offset")
    candidates = found.join(prefix, ["width", "shingle"]).withColumn("start", start)
    candidates = candidates.filter("start >= 0 and start + length <= n_words").select(*KEY, "window", "start", "length", "n").distinct()
    # Verify: every shingle of the window at its place.
    places = candidates.join(needed.select("window", "offset", "shingle"), "window")
    places = places.select(*KEY, "window", "start", "length", "n", (F.col("start") + F.col("offset")).alias("at"), "shingle")
    there = found.select(*KEY, "at", "shingle").distinct()
    on = same(places, there, [*KEY, "at", "shingle"])
    held = places.join(there, on, "left_semi").groupBy(*KEY, "window", "start", "length", "n").agg(F.count(F.lit(1)).alias("held"))
    return held.filter("held = n").select(*KEY, "window", "start", "length")


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, spans)`` of every document; spans of hit words ``array<struct<start,end>>``, items sorted."""
    cut = materialise(windows(items, size), "decontamination-items")
    held = materialise(occurrences(docs, cut), "decontamination-found")
    # The union of a document's hits: a start beyond all earlier ends opens a span.
    by_doc = Window.partitionBy(*KEY).orderBy("start", "end")
    ends = held.select(*KEY, "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    reach = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    opened = ends.withColumn("opens", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    span = F.sum("opens").over(by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = opened.withColumn("span", span).groupBy(*KEY, "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy(*KEY).agg(
        F.sum(F.col("end") - F.col("start")).cast("bigint").alias("n_hit"),
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"),
    )
    # Windows are counted before their items come in: an item is named once per document however often it occurs.
    named = held.select(*KEY, "window").distinct().join(cut.select("item", "window"), "window")
    named = named.groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = spans.join(named, same(spans, named, KEY)).select(spans["doc_id"], spans["text_hash"], "n_hit", "spans", "items")
    rows = _words(docs, doc_id="bigint").select(*KEY, F.size("words").cast("bigint").alias("n_words"))
    return rows.join(hits, same(rows, hits, KEY), "left").select(
        rows["doc_id"],
        rows["text_hash"],
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


def contamination_summary(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark),
w AS (
  SELECT DISTINCT item, array_to_string(words[k + 1:k + 10], ' ') AS win, least(10, len(words)) AS size
  FROM i, unnest(range(greatest(len(words) - 10, 0) + 1)) AS t(k) WHERE len(words) > 0),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents),
s AS (
  SELECT r, size, k, array_to_string(words[k + 1:k + size], ' ') AS win
  FROM d, (SELECT DISTINCT size FROM w), unnest(range(len(words) - size + 1)) AS t(k)),
h AS (SELECT DISTINCT r, k, s.size, item FROM s JOIN w ON s.win = w.win AND s.size = w.size),
p AS (SELECT r, count(DISTINCT k + o) AS n_hit FROM h, unnest(range(size)) AS t(o) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.r = p.r LEFT JOIN n ON d.r = n.r
"""
