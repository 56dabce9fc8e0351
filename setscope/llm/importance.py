"""Resampling of documents towards a target distribution, by hashed n-grams whose checksums are put together from those of words.

A dictionary holds distinct words, bounded by blanks, in an Aho-Corasick automaton; each word carries its crc32 and its length as
payload. A scan over a text emits the payloads in order, without looking at a word's letters again. The checksum of a run of words
follows from the payloads of neighbours alone: appending n bytes to a text is a linear map of its crc32, kept as lookup tables by n.
Checksums modulo ``buckets`` are counted for the documents and for the target, the two counts give each bucket a gain in thousandths of
a nat, and a document's weight is the sum of the gains of its n-grams. Adding Gumbel noise, a fixed function of seed and id, and taking
the highest scores draws documents without replacement in proportion to the exponential of their weights.

The dictionary holds the most frequent words of documents and target, ``DICTIONARY`` at most, counted over all of them. What the automaton leaves
out between two matches are words outside the dictionary; their checksums are computed on the spot, so results do not depend on its
size. Counts of words and buckets are summed in every task before they are shuffled; the driver sees the dictionary and one number for
each bucket. Ranks come from a sort by ranges and the number of rows of each range, so no task sees all documents.

Words: A-Z lower-cased, split at ASCII bytes that are no letter or digit. Null and empty texts have no features, weight 0 and no rank.
A null id is an empty one in the noise and sorts first. Ties in score go to the smaller id; repeated rows count, score and rank as often
as they occur. Long texts are scanned in blocks, so memory grows with a text's words, 50 bytes each. Empty documents give no rows, an
empty target gives every bucket the gain of an unseen one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setscope.functions.tables import local_table, materialise
from setscope.llm.common import MARKS_TO_SPACES, fields, partitions, worker_object

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Words of the automaton at most, and classes of frequency to a doubling; other words are hashed where they stand.
DICTIONARY, CLASSES = 1 << 17, 64
#: Words a task counts before it hands them over, bytes of a block of text, bytes of texts taken at once.
COUNTED_WORDS, BLOCK, GROUP = 400_000, 1 << 22, 1 << 21
#: Lengths in bytes with a table of their own.
SHORT = 64


def _one_zero_byte() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


class Checksums:
    """What appending n bytes does to a crc32, as four tables of 256 numbers for each n."""

    def __init__(self) -> None:
        step = _one_zero_byte()
        plain = np.arange(256, dtype=np.uint32)
        tables = [np.stack([plain << np.uint32(8 * j) for j in range(4)])]
        for _ in range(SHORT):
            tables.append((tables[-1] >> np.uint32(8)) ^ step[tables[-1] & np.uint32(255)])
        self.short = np.stack(tables)
        self.doubled = [self.short[SHORT]]

    def _apply(self, table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        out = table[0][crc & 255]
        for j in range(1, 4):
            out = out ^ table[j][(crc >> np.uint32(8 * j)) & 255]
        return out

    def moved(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The part of ``crc(a + b)`` that comes from ``crc(a)``, for ``n`` bytes of b."""
        rest = n % SHORT
        out = self.short[rest, 0, crc & 255]
        for j in range(1, 4):
            out = out ^ self.short[rest, j, (crc >> np.uint32(8 * j)) & 255]
        steps = n // SHORT
        if steps.any():
            for bit in range(int(steps.max()).bit_length()):
                if bit == len(self.doubled):
                    self.doubled.append(self._apply(self.doubled[-1], self.doubled[-1]))
                at = np.flatnonzero(steps >> bit & 1)
                out[at] = self._apply(self.doubled[bit], out[at])
        return out

    def runs(self, crc: np.ndarray, size: np.ndarray, longest: int) -> Iterator[np.ndarray]:
        """Checksums of all runs of 1, 2, ... neighbouring words joined by a blank."""
        yield crc
        blank = np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32)
        led = self.moved(blank, size) ^ crc
        run = crc
        for k in range(2, longest + 1):
            run = self.moved(run[:-1], size[k - 1 :] + 1) ^ led[k - 1 :] if len(crc) >= k else crc[:0]
            yield run


class Scanner:
    """The automaton over the dictionary, and what a scan emits."""

    def __init__(self, words: list[bytes]) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for w in words:
            # Bytes as characters of one byte each, so places are places in bytes.
            self.automaton.add_word(f" {w.decode('latin-1')} ", zlib.crc32(w) << 32 | len(w))
        if words:
            self.automaton.make_automaton()
        self.checksums = Checksums()

    def _block(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Payloads of a text that starts and ends with a blank, and where its words start."""
        found = np.zeros(0, dtype=[("end", np.int64), ("payload", np.uint64)])
        if len(self.automaton):
            found = np.fromiter(self.automaton.iter(text.decode("latin-1")), dtype=found.dtype)
        payload, end = found["payload"], found["end"]
        start = end - (payload & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # Between matches, three bytes or more may hold words that are not in the dictionary.
        left, right = np.concatenate([[0], end]), np.concatenate([start - 1, [len(text) - 1]])
        at, more = [], []
        for a, z in zip(*(x[right - left >= 2].tolist() for x in (left, right))):
            for w in text[a : z + 1].split():
                a = text.index(w, a)
                at.append(a)
                more.append(zlib.crc32(w) << 32 | len(w))
                a += len(w)
        if at:
            start, payload = np.concatenate([start, np.array(at, np.int64)]), np.concatenate([payload, np.array(more, np.uint64)])
            order = np.argsort(start, kind="stable")
            start, payload = start[order], payload[order]
        return payload, start

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Checksum and length of every word of the texts one after the other, and the number of words of each text."""
        whole = b" " + b" ".join(texts) + b" "
        payloads, starts, a = [], [], 0
        while a < len(whole) - 1:
            z = len(whole) - 1
            if z - a > BLOCK:
                z = whole.rfind(b" ", a + 1, a + BLOCK)
                z = z if z > 0 else whole.index(b" ", a + BLOCK)
            payload, start = self._block(whole[a : z + 1])
            payloads.append(payload)
            starts.append(start + a)
            a = z
        payload, start = np.concatenate(payloads), np.concatenate(starts)
        ends = np.cumsum([len(t) + 1 for t in texts]) + 1
        n_words = np.diff(np.searchsorted(start, ends), prepend=0)
        return (payload >> np.uint64(32)).astype(np.uint32), (payload & np.uint64(0xFFFFFFFF)).astype(np.int64), n_words

    def features(self, texts: list[bytes], longest: int, buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For runs of each length, their buckets and the number of the text each lies in; and the words of each text."""
        crc, size, n_words = self.scan(texts)
        of = np.repeat(np.arange(len(texts)), n_words)
        out = []
        for k, run in enumerate(self.checksums.runs(crc, size, longest)):
            inside = of[: len(run)] == of[k : k + len(run)]
            out.append(((run[inside] % np.uint32(buckets)).astype(np.int64), of[: len(run)][inside]))
        return out, n_words


def plain(text: str | None) -> bytes:
    """A text's bytes, lower-cased, with blanks between words."""
    return (text or "").encode().translate(MARKS_TO_SPACES)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch in groups of bounded size, each with the row it starts at."""
    at, group, held = 0, [], 0
    for i, text in enumerate(batch["text"]):
        group.append(plain(text.as_py()))
        held += len(group[-1])
        if held > GROUP:
            yield at, group
            at, group, held = i + 1, [], 0
    if group:
        yield at, group


def count_words(texts: DataFrame) -> DataFrame:
    """``(word binary, n)``, words counted in every task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.binary()), "n": pa.array(counts.values(), pa.int64())})

        for b in batches:
            for text in b["text"]:
                for w in plain(text.as_py()).split():
                    counts[w] = counts.get(w, 0) + 1
                if len(counts) > COUNTED_WORDS:
                    yield counted()
                    counts.clear()
        yield counted()

    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(texts: list[DataFrame], size: int = DICTIONARY) -> list[bytes]:
    """The most frequent words of all texts, ``size`` of them at most: all those of the classes of frequency that fit."""
    whole = texts[0].select("text")
    for other in texts[1:]:
        whole = whole.unionByName(other.select("text"))
    # Classes are so many to a doubling of the count; their sizes are a few thousand numbers at any size of the corpus.
    words = materialise(count_words(whole).withColumn("class", F.floor(F.log2("n") * CLASSES)), "importance-words")
    least, held = None, 0
    for row in sorted(words.groupBy("class").count().collect(), reverse=True):
        held += row["count"]
        if held > size:
            break
        least = row["class"]
    if least is None:
        return []
    return sorted(bytes(w) for w in words.filter(F.col("class") >= least).select("word").toArrow()["word"].to_pylist())


def _scanner(words: list[bytes]) -> Scanner:
    key = ("importance", len(words), hashlib.sha256(b" ".join(words)).digest())
    return worker_object(key, lambda: Scanner(words))


def bucket_counts(texts: DataFrame, words: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket."""
    shipped = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, scanner = np.zeros(buckets, dtype=np.int64), _scanner(shipped.value)
        for b in batches:
            for _, group in _groups(b):
                for found, _ in scanner.features(group, longest, buckets)[0]:
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": total[at]})

    counted = texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in counted.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of a nat by which a bucket speaks for the target, rounded down, from counts smoothed by one."""
    s_all, t_all, buckets = float(source.sum()), float(target.sum()), len(source)
    parts = zip(source.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in parts], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, words: list[bytes], gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` per document."""
    shipped, names = docs.sparkSession.sparkContext.broadcast(words), ("doc_id", "n_words", "n_features", "weight", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shipped.value)
        for b in batches:
            for at, group in _groups(b):
                found, n_words = scanner.features(group, longest, len(gain))
                weight, n_features = np.zeros((2, len(group)), dtype=np.int64)
                for buckets, of in found:
                    ends = np.searchsorted(of, np.arange(len(group) + 1))
                    n_features += np.diff(ends)
                    weight += np.diff(np.concatenate([[0], np.cumsum(gain[buckets])])[ends])
                ids = b["doc_id"].slice(at, len(group))
                score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int64)) for x in (n_words, n_features, weight, score))], names=names)

    return docs.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def ranked(rows: DataFrame, order: list, label: str) -> DataFrame:
    """``rows`` with their place in ``order``, from 1, in ``rank``: sorted by ranges, places counted within each."""
    spark = rows.sparkSession
    sorted_rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = materialise(sorted_rows.withColumn("place", F.monotonically_increasing_id()), label)
    placed = placed.withColumns({"range": F.shiftright("place", 33), "place": F.col("place").bitwiseAND((1 << 33) - 1)})
    before, so_far = {"range": [], "before": []}, 0
    for row in sorted(placed.groupBy("range").count().collect()):
        before["range"].append(row["range"])
        before["before"].append(so_far)
        so_far += row["count"]
    if not so_far:
        return placed.select(*rows.columns, F.lit(None).cast("bigint").alias("rank"))
    return placed.join(local_table(spark, before), "range").select(*rows.columns, (F.col("before") + F.col("place") + 1).alias("rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    size: int = DICTIONARY,
) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)``; ``rank`` numbers the drawn documents, ``percent`` of those with
    ``least_words`` words, from the highest score on; all others have none."""
    docs, target = fields(docs, doc_id="bigint", text="string"), fields(target, text="string")
    words = dictionary([docs, target], size)
    gain = gains(bucket_counts(docs, words, longest, buckets), bucket_counts(target, words, longest, buckets))
    rows = materialise(scored(docs, words, gain, longest, seed), "importance-scores")
    long_enough = rows.filter(F.col("n_words") >= least_words)
    drawn = percent * long_enough.count() // 100
    places = ranked(long_enough, [F.desc("score"), F.asc("doc_id"), "n_words", "n_features"], "importance-ranks")
    places = places.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return places.unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint")))
