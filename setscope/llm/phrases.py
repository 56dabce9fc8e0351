"""Collocations by prefix-free parsing: n-grams are counted once in each distinct chunk, weighted by how often the chunk occurs.

Texts fall into pieces at punctuation and line ends. A piece is parsed into chunks: wherever the hash of ``longest - 1`` neighbouring
words is divisible by ``spacing``, a chunk starts, and the one before it goes on to the end of those words. Neighbouring chunks thus
share ``longest - 1`` words, no n-gram is cut, and places depend on content alone, so passages that repeat give the same chunks again.
The dictionary holds each distinct chunk of a language with its frequency. An n-gram belongs to the chunk in which it starts before the
shared words do; the last chunk of a piece owns all its words. So each occurrence is counted once.

Frequent phrases are found by length. A word or phrase that is frequent gets a number; a chunk becomes the list of numbers of the
phrases that start at each of its words. Two neighbouring numbers name a phrase one word longer, which can be frequent only if both
are, so rare ones are never counted, and a pair of numbers names it exactly. Numbers are put into chunks by a lookup in the workers
where the frequent phrases of a length were counted and are ``KNOWN`` at most, else by a join of the chunks' places; both give the same.

A phrase is dropped if its words lie inside a longer frequent one that occurs as often. If so, it lies inside one that is a word longer
and occurs as often, so comparing with those is enough. Scores are divisions of decimals of 38 digits: exact up to 10^13 words.

Words: A-Z lower-cased, split at blanks and tabs. A null language is ``und``; null and empty texts have no words, repeated rows count as
often as they occur, and very long texts are parsed in blocks. An empty table and
languages without candidates give no rows. Ties are broken by frequency, then by the phrase's bytes. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setscope.functions.tables import materialise
from setscope.llm.common import fields, worker_object

LEAST_COUNT, LONGEST, TOP, SPACING, UNKNOWN_LANGUAGE = 100, 5, 2000, 16, "und"
#: Frequent phrases of one length that workers look up at most; more are joined.
KNOWN = 1_000_000
#: Bytes of text parsed at once, words and pairs a task counts before it hands them over.
GROUP, COUNTED = 1 << 21, 300_000
#: Lower-cases A-Z, turns what ends a piece into a line end and tabs into blanks.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else 10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
#: Odd, so powers have inverses modulo 2^64.
BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def cut(text: bytes, longest: int = LONGEST, spacing: int = SPACING) -> tuple[list[bytes], np.ndarray]:
    """The chunks of a text's pieces, and which of them end a piece. Bytes are plain ones, blanks single."""
    letters = np.frombuffer(b"\n" + text + b"\n", dtype=np.uint8)
    inside = (letters != 32) & (letters != 10)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2] + 1, edge[1::2] + 1
    if not len(start):
        return [], np.zeros(0, dtype=bool)
    piece = np.cumsum(letters == 10)[start]
    # A word's hash is a difference of sums over the text before its ends, moved to the origin.
    sums = np.concatenate([[np.uint64(0)], np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(letters)), dtype=np.uint64)])
    word = _mixed((sums[end] - sums[start]) * _powers(pow(BASE, -1, 2**64), len(letters))[start])
    n, wide = len(word), longest - 1
    first = np.concatenate([[True], piece[1:] != piece[:-1]])
    opens = first.copy()
    if wide and n >= wide:
        window = np.zeros(n - wide + 1, dtype=np.uint64)
        for k in range(wide):
            window = _mixed(window + word[k : n - wide + 1 + k])
        opens[: n - wide + 1] |= (window % np.uint64(spacing) == 0) & (piece[: n - wide + 1] == piece[wide - 1 :])
    at = np.flatnonzero(opens)
    following = np.concatenate([at[1:], [n]])
    last = np.concatenate([first[at[1:]], [True]])
    until = np.where(last, following - 1, following + wide - 1)
    whole = letters.tobytes()
    return [whole[a:z] for a, z in zip(start[at].tolist(), end[until].tolist())], last


def _blocks(rows: Iterator[tuple[str, str | None]], longest: int) -> Iterator[tuple[str, bytes, bool]]:
    """Plain texts of one language put together up to a bound, and parts of longer ones; True if the last piece goes on in the next
    part, which then repeats its last ``longest - 1`` words."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    shared = re.compile(rb"(?: [^ \n]+){%d}" % (longest - 1))
    for lang, text in rows:
        plain = re.sub(rb"  +", b" ", (text or "").encode().translate(PLAIN))
        at = 0
        while len(plain) - at > GROUP:
            line = plain.rfind(b"\n", at, at + GROUP)
            if line < 0:
                blank = plain.rfind(b" ", at + 1, at + GROUP)
                blank = blank if blank >= 0 else plain.find(b" ", at + GROUP)
                if blank >= 0 and (more := shared.match(plain, blank)):
                    yield lang, plain[at : more.end()], True
                    at = blank + 1
                    continue
                line = plain.find(b"\n", max(blank, at + GROUP))
                if line < 0:
                    break
            yield lang, plain[at:line], False
            at = line + 1
        held.setdefault(lang, []).append(plain[at:])
        sizes[lang] = sizes.get(lang, 0) + len(plain) - at
        if sizes[lang] > GROUP:
            yield lang, b"\n".join(held.pop(lang)), False
            del sizes[lang]
    for lang, parts in held.items():
        yield lang, b"\n".join(parts), False


def chunk_dictionary(docs: DataFrame, longest: int = LONGEST, spacing: int = SPACING) -> DataFrame:
    """``(lang, chunk, last, freq)``: the distinct chunks of each language; ``last`` ones end a piece and own all their words."""
    schema = pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("last", pa.bool_()), ("freq", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, block, goes_on in _blocks(zip((x.as_py() for x in b["lang"]), (x.as_py() for x in b["text"])), longest):
                chunks, last = cut(block, longest, spacing)
                last[len(last) - goes_on :] = False
                found = pa.table({"chunk": pa.array(chunks, pa.binary()), "last": pa.array(last, pa.bool_())})
                found = found.group_by(["chunk", "last"]).aggregate([([], "count_all")])
                names = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(found), dtype=np.int32)))
                for part in found.to_batches():
                    columns = [names.slice(0, len(part)), part["chunk"].cast(pa.string()), part["last"], part["count_all"]]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = fields(docs, lang="string", text="string").fillna(UNKNOWN_LANGUAGE, ["lang"])
    parsed = rows.mapInArrow(run, "lang string, chunk string, last boolean, freq bigint")
    return parsed.groupBy("lang", "chunk", "last").agg(F.sum("freq").alias("freq"))


def owned_words(dictionary: DataFrame, longest: int) -> DataFrame:
    """``(lang, word, f)``: words of distinct chunks, weighted; those a chunk shares with the next are left to that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], int] = {}

        def counted() -> pa.RecordBatch:
            lang, word = zip(*counts) if counts else ((), ())
            return pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "word": pa.array(word, pa.string()), "f": pa.array(counts.values(), pa.int64())})

        for b in batches:
            for lang, chunk, last, freq in zip(*(b[c].to_pylist() for c in ("lang", "chunk", "last", "freq"))):
                words = chunk.split(" ")
                for w in words if last else words[: len(words) - longest + 1]:
                    counts[lang, w] = counts.get((lang, w), 0) + freq
                if len(counts) > COUNTED:
                    yield counted()
                    counts.clear()
        yield counted()

    counted = dictionary.mapInArrow(run, "lang string, word string, f bigint")
    return counted.groupBy("lang", "word").agg(F.sum("f").alias("f"))


CODED = "last boolean, freq bigint, ids array<bigint>"


def _long_enough(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which lists hold two neighbouring numbers that both name something."""
    starts = np.concatenate([[0], ends[:-1]])
    both = np.concatenate([(ids[:-1] >= 0) & (ids[1:] >= 0), [False]]) if len(ids) else np.zeros(0, dtype=bool)
    sums = np.concatenate([[0], np.cumsum(both)])
    return (sums[np.maximum(ends - 1, starts)] - sums[starts]) > 0


def _lists(b: pa.RecordBatch, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """The rows of a batch with new lists, but for those that no longer phrase can come from."""
    starts = np.concatenate([[0], ends[:-1]])
    keep = np.flatnonzero(_long_enough(ids, ends))
    sizes = (ends - starts)[keep]
    at = np.repeat(starts[keep] - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(keep) else [], sizes).astype(np.int64) + np.arange(sizes.sum())
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids[at], pa.int64()))
    return pa.RecordBatch.from_arrays([b["last"].take(pa.array(keep)), b["freq"].take(pa.array(keep)), lists], names=["last", "freq", "ids"])


def _numbers(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    offsets = b["ids"].offsets.to_numpy().astype(np.int64)
    return b["ids"].values.to_numpy()[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _code_words(dictionary: DataFrame, frequent: DataFrame, known: int) -> DataFrame:
    """Chunks as lists of the numbers of their frequent words; -1 for others."""
    if frequent.count() > known:
        return _joined(dictionary.withColumn("keys", F.transform(F.split("chunk", " "), lambda w: F.struct("lang", w.alias("word")))), frequent)
    table = frequent.select("lang", "word", "id").toArrow()
    shipped = dictionary.sparkSession.sparkContext.broadcast(table)
    key = ("phrases", frequent.inputFiles()[:1])

    def lookup() -> dict[str, dict[str, int]]:
        out: dict[str, dict[str, int]] = {}
        for lang, word, i in zip(*(c.to_pylist() for c in shipped.value.columns)):
            out.setdefault(lang, {})[word] = i
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = worker_object(key, lookup)
        for b in batches:
            ids, ends = [], []
            for lang, chunk in zip(b["lang"].to_pylist(), b["chunk"].to_pylist()):
                known_here = numbers.get(lang, {})
                ids.extend([known_here.get(w, -1) for w in chunk.split(" ")])
                ends.append(len(ids))
            yield _lists(b, np.array(ids, dtype=np.int64), np.array(ends, dtype=np.int64))

    return dictionary.mapInArrow(run, CODED)


def _code_pairs(coded: DataFrame, frequent: DataFrame, known: int) -> DataFrame:
    """Lists of numbers of phrases one word longer than those in ``coded``."""
    if frequent.count() > known:
        pairs = F.transform("ids", lambda x, i: F.struct(x.alias("left"), F.get("ids", i + 1).alias("right")))
        return _joined(coded.withColumn("keys", pairs), frequent)
    table = frequent.select("left", "right", "id").orderBy("left", "right").toArrow()
    left, right, number = (c.to_numpy() for c in table.columns)
    # Numbers of one length are dense in their sorted table: a pair becomes one number of 64 bits.
    ranks = np.unique(np.concatenate([left, right]))
    packed = (np.searchsorted(ranks, left) << 32) | np.searchsorted(ranks, right)
    shipped = coded.sparkSession.sparkContext.broadcast((ranks, packed, number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, packed, number = shipped.value
        for b in batches:
            ids, ends = _numbers(b)
            out = np.full(len(ids), -1, dtype=np.int64)
            if len(packed) and len(ids):
                at = np.minimum(np.searchsorted(ranks, ids), len(ranks) - 1)
                at = np.where(ranks[at] == ids, at, -1)
                pair = (at[:-1] << 32) | at[1:]
                found = np.minimum(np.searchsorted(packed, pair), len(packed) - 1)
                hit = (at[:-1] >= 0) & (at[1:] >= 0) & (packed[found] == pair)
                out[:-1][hit] = number[found[hit]]
            # A list of n phrases holds n - 1 of the next length; its last place starts none.
            out[ends - 1] = -1
            yield _lists(b, out, ends)

    return coded.mapInArrow(run, CODED)


def _joined(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """The same by a join of all places, for tables of frequent phrases of any size."""
    rows = materialise(rows.select("last", "freq", "keys").withColumn("row", F.monotonically_increasing_id()), "phrase-rows")
    places = rows.select("row", F.posexplode("keys").alias("at", "key")).select("row", "at", "key.*")
    keys = [c for c in places.columns if c not in ("row", "at")]
    found = places.join(frequent.select(*keys, "id"), keys, "left").select("row", F.struct("at", F.coalesce("id", F.lit(-1)).alias("id")).alias("x"))
    lists = found.groupBy("row").agg(F.sort_array(F.collect_list("x")).getField("id").alias("ids"))
    coded = rows.join(lists, "row").select("last", "freq", "ids")
    neighbours = F.exists(F.sequence(F.lit(0), F.size("ids") - 2), lambda i: (F.get("ids", i) >= 0) & (F.get("ids", i + 1) >= 0))
    return coded.filter(F.size("ids") > 1).filter(neighbours)


def _count_pairs(coded: DataFrame, k: int, longest: int) -> DataFrame:
    """``(left, right, f)``: phrases of ``k`` words as the numbers of their first and last ``k - 1``, counted where a chunk owns them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by(["left", "right"]).aggregate([("f", "sum")]).rename_columns(["left", "right", "f"])

        for b in batches:
            ids, ends = _numbers(b)
            if not len(ids):
                continue
            sizes = np.diff(ends, prepend=0)
            row = np.repeat(np.arange(len(b)), sizes)
            left_over = np.repeat(ends, sizes) - np.arange(len(ids)) - 1
            # All lists keep one place for each word of their chunk, so the shared words are its last ones.
            shared = np.where(b["last"].to_numpy(zero_copy_only=False), 0, longest - 1)[row]
            at = np.flatnonzero((left_over[:-1] >= np.maximum(shared[:-1], 1)) & (ids[:-1] >= 0) & (ids[1:] >= 0))
            held.append(pa.table({"left": ids[at], "right": ids[at + 1], "f": b["freq"].to_numpy()[row[at]]}))
            if sum(map(len, held)) > COUNTED * 4:
                held = [summed()]
                if len(held[0]) > COUNTED:
                    yield from held.pop().to_batches()
        if held:
            yield from summed().to_batches()

    return coded.mapInArrow(run, "left bigint, right bigint, f bigint").groupBy("left", "right").agg(F.sum("f").alias("f"))


def frequent_phrases(dictionary: DataFrame, least: int, longest: int, known: int = KNOWN) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, k, f)`` of all phrases that occur ``least`` times, and ``(lang, n)``, the words of each language."""
    words = materialise(owned_words(dictionary, longest), "phrase-words")
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    number = F.monotonically_increasing_id()
    frequent = materialise(words.filter(F.col("f") >= least).withColumn("id", number), "phrases-1")
    named = frequent.select("id", "lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), "f")
    coded = materialise(_code_words(dictionary, frequent, known), "phrase-chunks-1")
    found = [named]
    for k in range(2, longest + 1):
        counted = _count_pairs(coded, k, longest).filter(F.col("f") >= least)
        frequent = materialise(counted.withColumn("id", number), f"phrases-{k}")
        head = named.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"))
        tail = named.select(F.col("id").alias("right"), F.substring_index("phrase", " ", -1).alias("tail"))
        texts = frequent.join(head, "left").join(tail, "right")
        named = materialise(texts.select("id", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), F.lit(k).alias("k"), "f"), f"phrase-texts-{k}")
        found.append(named)
        if k == longest or named.isEmpty():
            break
        coded = materialise(_code_pairs(coded, frequent, known), f"phrase-chunks-{k}")
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole.drop("id"), sizes


def _decimal(name: str) -> str:
    return f"cast({name} as decimal(19, 0))"


def collocations(
    docs: DataFrame, *, least: int = LEAST_COUNT, longest: int = LONGEST, top: int = TOP, spacing: int = SPACING, known: int = KNOWN
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language by their weakest cut."""
    dictionary = materialise(chunk_dictionary(docs, longest, spacing), "phrase-dictionary")
    phrases, sizes = frequent_phrases(dictionary, least, longest, known)
    candidates = phrases.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    part = F.transform(
        F.sequence(F.lit(1), F.col("k") - 1),
        lambda i: F.struct(
            i.alias("i"),
            F.array_join(F.slice("words", F.lit(1), i), " ").alias("first"),
            F.array_join(F.slice("words", i + 1, F.size("words")), " ").alias("rest"),
        ),
    )
    cuts = candidates.select("lang", "phrase", "a", F.explode(part).alias("c")).select("lang", "phrase", "a", "c.*")
    for name, f in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f)), ["lang", name])
    cuts = cuts.join(sizes, "lang")
    score = F.expr(f"cast(({_decimal('1000')} * {_decimal('a')} * {_decimal('n')}) div ({_decimal('l')} * {_decimal('r')}) as bigint)")
    weakest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "i", "l", "r")).alias("c"))
    # Inside phrases one word longer: without their first or their last word.
    ends = F.array(F.slice("words", F.lit(2), F.size("words")), F.slice("words", F.lit(1), F.size("words") - 1))
    longer = candidates.filter("k > 2").select("lang", F.explode(ends).alias("w"), "a").select("lang", F.array_join("w", " ").alias("phrase"), "a").distinct()
    kept = weakest.join(longer, ["lang", "phrase", "a"], "left_anti")
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = kept.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score").withColumn("rank", F.row_number().over(place).cast("bigint"))
    return rows.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, UNNEST(REGEXP_SPLIT_TO_ARRAY(
    TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(piece, '[\\x20\\x09]+'), LAMBDA w: w <> '') AS words FROM pieces),
sizes AS (SELECT lang, CAST(SUM(LEN(words)) AS BIGINT) AS n FROM lists GROUP BY 1),
grams AS (
  SELECT lang, k, UNNEST(LIST_TRANSFORM(RANGE(1, LEN(words) - k + 2), LAMBDA i: ARRAY_TO_STRING(words[i : i + k - 1], ' '))) AS phrase
  FROM lists, (SELECT UNNEST(RANGE(1, 6)) AS k) WHERE LEN(words) >= k),
frequent AS (SELECT lang, k, phrase, COUNT(*) AS f FROM grams GROUP BY ALL HAVING COUNT(*) >= 100),
candidates AS (SELECT lang, k, phrase, STRING_SPLIT(phrase, ' ') AS words, f AS a FROM frequent WHERE k > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, s.n, i, x.f AS l, y.f AS r,
    (CAST(1000 AS HUGEINT) * c.a * s.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM (SELECT *, UNNEST(RANGE(1, k)) AS i FROM candidates) c JOIN sizes s ON s.lang = c.lang
    JOIN frequent x ON x.lang = c.lang AND x.k = i AND x.phrase = ARRAY_TO_STRING(c.words[: i], ' ')
    JOIN frequent y ON y.lang = c.lang AND y.k = c.k - i AND y.phrase = ARRAY_TO_STRING(c.words[i + 1 :], ' ')),
weakest AS (SELECT * FROM cuts QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inside AS (
  SELECT lang, a, UNNEST(LIST_TRANSFORM(FLATTEN(LIST_TRANSFORM(RANGE(1, k), LAMBDA m: LIST_TRANSFORM(RANGE(1, k - m + 2),
    LAMBDA i: CASE WHEN m = k THEN NULL ELSE words[i : i + m - 1] END))), LAMBDA w: ARRAY_TO_STRING(w, ' '))) AS phrase FROM candidates),
kept AS (
  SELECT * FROM weakest w
  WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = w.lang AND i.phrase = w.phrase AND 100 * i.a >= 100 * w.a)),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, ENCODE(phrase)) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n,
  CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""
