"""Repeated passages by a sparse suffix array.

Of every run of words as long as a passage must be, the start of its least k-word piece is retained, so equal passages retain equal
suffixes. A passage reaches half its length to the right of such a place, or half to the left; places where neither half occurs in
another document are left out, which leaves little but repeated text. The suffixes are sorted as far as a passage can reach to the
right, and, for a second order, as far as it can reach to the left; each is compared with its neighbours of other documents, and a
match is extended word by word to the right and to the left. If it is long enough in all, the words are a repeated passage of both.
Every suffix's longest match to the right is a neighbour in the first order and to the left in the second, so a passage is found whole
unless each of its two longest partial matches lies elsewhere and both together are still too short.

Suffixes with equal surroundings are one row, with the smallest and the largest of their documents: copies and passages that many
documents share cost one row however many they are. Sorting is by ranges of the surroundings themselves, so a frequent opening is
split between tasks; what stands at the edges of the ranges is compared once more in a small last step. Suffixes that open alike stand
together in the first order, so the second is made on the spot; where they are too many for that, or at an edge, they are sorted again.

Words are split at ASCII white space and compared exactly. Passages repeat across documents: those within one document, and rows that
share an id, do not count. Rows without an id and null texts take no part, nor do texts shorter than a passage. Other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setscope.functions.tables import materialise, new_path
from setscope.llm.common import fields, partitions

PASSAGE, PIECE = 50, 8
#: Rows that are broadcast at most, where they are counted before; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Bytes of surroundings that a task holds before it hands them over.
WRITTEN = 1 << 22
#: Suffixes that open alike and are put into the second order within a task.
OPENING = 2048
KEY = ["doc_id", "text_hash"]


def retained(words: list[bytes], passage: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places retained in a text, where the leftmost least piece of every run of ``passage`` words starts, with hashes of the half
    passages to the right of it and to the left, the piece included in both; zero where the text is too short for the half."""
    none = np.empty(0, np.int64)
    if len(words) < passage:
        return none, none, none
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - piece + 1
    hashed = np.zeros(n, dtype=np.uint64)
    for j in range(piece):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + word[j : j + n]
    runs = np.lib.stride_tricks.sliding_window_view(_mixed(hashed), passage - piece + 1)
    at = np.unique(np.arange(len(runs)) + runs.argmin(axis=1))
    return at, *[_half(word, at + shift, passage // 2).view(np.int64) for shift in (0, piece - passage // 2)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _half(word: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    there = (first >= 0) & (first + size <= len(word))
    out = np.zeros(len(first), dtype=np.uint64)
    for j in range(size):
        out[there] = out[there] * np.uint64(0x9E3779B97F4A7C15) + word[first[there] + j]
    out[there] = _mixed(out[there]) | np.uint64(1)
    return out


def suffix_starts(docs: DataFrame, passage: int, piece: int) -> DataFrame:
    """``(doc_id, text_hash, at, right_half, left_half)`` of the retained places."""
    names = [*KEY, "at", "right_half", "left_half"]
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [retained(t.as_py().encode().split(), passage, piece) for t in b["text"]]
            sizes = np.array([len(x[0]) for x in found], dtype=np.int64)
            keys = [np.repeat(b[c].to_numpy(zero_copy_only=False), sizes) for c in KEY]
            more = [np.concatenate([x[i] for x in found] or [np.empty(0, np.int64)]) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*keys, *more)], schema=schema)

    return docs.select(*KEY, "text").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def counted_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def shared_starts(starts: DataFrame) -> DataFrame:
    """The places with a half that stands in another document, too."""
    kept = starts
    for half in ("right_half", "left_half"):
        found = starts.filter(F.col(half) != 0).groupBy(half).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        found = materialise(found.filter("low <> high").select(half, F.lit(True).alias(f"{half}_shared")), f"suffix-{half}")
        kept = kept.join(counted_broadcast(found, found.count(), BROADCAST_KEYS), half, "left")
    return kept.filter("right_half_shared or left_half_shared").select(*KEY, "at").distinct()


def surroundings(docs: DataFrame, starts: DataFrame, passage: int, piece: int) -> DataFrame:
    """``(doc_id, text_hash, at, right, left, ctx)``: words from a place on, and words before it from the nearest to the farthest."""
    reach = passage - piece
    schema = pa.schema([*[(c, pa.int64()) for c in (*KEY, "at")], ("right", pa.string()), ("left", pa.string())])
    # Places grow with the corpus, so the texts that have some are shuffled to them at every size.
    rows = docs.join(starts.groupBy(*KEY).agg(F.sort_array(F.collect_list("at")).alias("places")), KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]
        written = 0

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
            for column in out:
                column.clear()
            return batch

        for b in batches:
            for doc, text_hash, text, places in zip(*[b[c] for c in (*KEY, "text", "places")], strict=True):
                words = text.as_py().encode().split()
                for at in places:
                    at = at.as_py()
                    right, left = b" ".join(words[at : at + passage]), b" ".join(words[max(0, at - reach) : at][::-1])
                    for column, v in zip(out, (doc.as_py(), text_hash.as_py(), at, right.decode(), left.decode()), strict=True):
                        column.append(v)
                    written += len(right) + len(left)
                    if written > WRITTEN:
                        written = 0
                        yield flushed()
        yield flushed()

    around = rows.select(*KEY, "text", "places").mapInArrow(run, "doc_id bigint, text_hash bigint, at bigint, right string, left string")
    # Two hashes name the surroundings.
    return around.withColumn("ctx", F.struct(F.xxhash64("right", "left").alias("a"), F.xxhash64(F.lit(1), "left", "right").alias("b")))


def common(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class _Row:
    __slots__ = ("a", "b", "right", "left", "low", "high", "values")

    def __init__(self, values: tuple):
        self.values = values
        self.a, self.b, right, left, self.low, self.high = values[:6]
        self.right, self.left = right.split(" "), left.split(" ") if left else []

    def apart(self, other: _Row) -> bool:
        """Whether the two stand in two documents together."""
        return not self.low == self.high == other.low == other.high


NEIGHBOURS = pa.schema(
    [(c, pa.int64()) for c in ("a", "b")]
    + [(c, pa.string()) for c in ("right", "left")]
    + [(c, pa.int64()) for c in ("low", "high")]
    + [(c, pa.int32()) for c in ("l", "r", "part", "seq")]
)
COLUMNS = ["a", "b", "right", "left", "low", "high"]
NEIGHBOURS_SQL = "a bigint, b bigint, right string, left string, low bigint, high bigint, l int, r int, part int, seq int"


class Neighbours:
    """Walks over sorted rows and compares each with the nearest one before and after it that adds a document."""

    def __init__(self, passage: int):
        self.passage, self.out = passage, []
        self.last: _Row | None = None
        self.other: _Row | None = None
        self.waiting: list[_Row] = []
        self.head: list[_Row] | None = []

    def _compare(self, x: _Row, y: _Row) -> None:
        r = common(x.right, y.right)
        if not r:
            return
        l = common(x.left, y.left)  # noqa: E741
        if l + r >= self.passage:
            # Each is proven by the documents of the other.
            self.out.append((x.a, x.b, None, None, y.low, y.high, l, r, None, None))
            self.out.append((y.a, y.b, None, None, x.low, x.high, l, r, None, None))

    def add(self, row: _Row) -> None:
        before = self.last if self.last is None or self.last.apart(row) else self.other
        waiting = [w for w in self.waiting if w.apart(row)]
        for w in waiting:
            self._compare(w, row)
        if before is not None and before not in waiting:
            self._compare(before, row)
        self.waiting = [w for w in self.waiting if not w.apart(row)] + [row]
        if self.last is None or self.last.apart(row):
            self.other = self.last
        if self.head is not None:
            self.head.append(row)
            if self.head[0].apart(row):
                self.edge_head, self.head = self.head, None
        self.last = row

    def edges(self) -> list[_Row]:
        """The rows that rows of other ranges can be nearest to: those up to the first that differs, and those after the last."""
        first = self.head if self.head is not None else self.edge_head
        tail = [*([self.other] if self.other is not None else []), *self.waiting]
        return [*first, *[t for t in tail if t not in first]]


class Openings:
    """Gathers suffixes that open alike and compares them in the second order; too many of them, and the first and the last of a
    range, which may go on in another, are handed over."""

    def __init__(self, passage: int, piece: int):
        self.passage, self.piece, self.out, self.first = passage, piece, [], True
        self.rows: list[_Row] = []
        self.opening: list[str] | None = None
        self.many = False

    def add(self, row: _Row) -> None:
        opening = row.right[: self.piece]
        if self.opening is not None and self.opening != opening:
            self.close(self.first)
            self.first = False
        self.opening = opening
        self.rows.append(row)
        if len(self.rows) > OPENING or self.many:
            self.many = True
            self._hand_over()

    def close(self, hand_over: bool) -> None:
        if hand_over or self.many:
            self._hand_over()
        elif len(self.rows) > 2:
            walker = Neighbours(self.passage)
            for r in sorted(self.rows, key=lambda r: (r.left, r.right)):
                walker.add(r)
            self.out.extend(walker.out)
        self.rows, self.many = [], False

    def _hand_over(self) -> None:
        self.out.extend((*r.values, None, None, None, None) for r in self.rows)
        self.rows = []


def neighbour_matches(rows: DataFrame, passage: int, piece: int) -> DataFrame:
    """``(a, b, low, high, l, r)``: for surroundings ``a, b``, documents that share at least a passage, and how far it goes."""
    found = _in_order(rows, passage, piece, ["right", "left"])
    rest = found.filter("seq is null and right is not null").select(*COLUMNS)
    again = _in_order(rest, passage, 0, ["left", "right"])
    return _matches(found, passage).unionByName(_matches(again, passage))


def _in_order(rows: DataFrame, passage: int, piece: int, order: list[str]) -> DataFrame:
    """NEIGHBOURS of the sorted rows: matches, edges of the ranges and, with a piece, rows for the second order."""
    spread = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, openings = Neighbours(passage), Openings(passage, piece)
        for b in batches:
            for values in zip(*[b[c].to_pylist() for c in COLUMNS], strict=True):
                row = _Row(values)
                walker.add(row)
                if piece:
                    openings.add(row)
            if walker.out or openings.out:
                yield _neighbours(walker.out + openings.out)
                walker.out, openings.out = [], []
        if walker.last is not None:
            openings.close(True)
            part = TaskContext.get().partitionId()
            yield _neighbours([*openings.out, *[(*x.values, None, None, part, i) for i, x in enumerate(walker.edges())]])

    return materialise(spread.select(*COLUMNS).mapInArrow(run, NEIGHBOURS_SQL), "suffix-neighbours")


def _matches(found: DataFrame, passage: int) -> DataFrame:
    """The matches, and those across the edges: a few rows for each range, in the order of the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Neighbours(passage)
        for b in batches:
            for values in zip(*[b[c].to_pylist() for c in COLUMNS], strict=True):
                walker.add(_Row(values))
        if walker.out:
            yield _neighbours(walker.out)

    edges = found.filter("seq is not null").coalesce(1).sortWithinPartitions("part", "seq").select(*COLUMNS)
    kept = ["a", "b", "low", "high", "l", "r"]
    return found.filter("right is null").select(*kept).unionByName(edges.mapInArrow(run, NEIGHBOURS_SQL).select(*kept))


def _neighbours(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), NEIGHBOURS, strict=True)], schema=NEIGHBOURS)


def _packed(df: DataFrame, label: str) -> DataFrame:
    """Written with strong compression: surroundings of one text overlap."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, piece: int = PIECE) -> DataFrame:
    """``(doc_id, text_hash, start_word, end_word, other_doc_id)``: the words of each document that stand in passages of others too,
    as disjoint spans, with a document that has one of them."""
    rows = fields(docs, doc_id="bigint", text="string").filter("doc_id is not null and text is not null")
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    starts = shared_starts(materialise(suffix_starts(rows, passage, piece), "suffix-starts"))
    around = _packed(surroundings(rows, starts, passage, piece), "suffix-surroundings")
    places = around.select(*KEY, "at", "ctx.a", "ctx.b").distinct()
    classes = around.groupBy("ctx.a", "ctx.b", "right", "left").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    classes = _packed(classes, "suffix-classes")
    words = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, " ")))
    same = classes.filter("low <> high").select("a", "b", "low", "high", words("left").alias("l"), words("right").alias("r"))
    same = same.filter(F.col("l") + F.col("r") >= passage)
    found = same.unionByName(neighbour_matches(classes, passage, piece))
    # Written, so that the join deals both sides anew and can split surroundings that very many documents share.
    reach = found.groupBy("a", "b").agg(*[F.max(c).alias(c) for c in ("l", "r", "high")], F.min("low").alias("low"))
    reach = materialise(reach, "suffix-reach")
    other = F.when(F.col("low") != F.col("doc_id"), F.col("low")).otherwise(F.col("high"))
    spans = places.join(reach, ["a", "b"]).select(*KEY, (F.col("at") - F.col("l")).alias("start"), (F.col("at") + F.col("r")).alias("end"), other.alias("other"))
    spans = spans.groupBy(*KEY, "start", "end").agg(F.min("other").alias("other"))
    by_doc = Window.partitionBy(*KEY).orderBy("start", "end")
    before = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", (before.isNull() | (F.col("start") > before)).cast("int"))
    span = F.sum("opens").over(by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = opened.withColumn("span", span).groupBy(*KEY, "span").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("other").alias("other_doc_id"))
    return merged.drop("span")
