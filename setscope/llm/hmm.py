"""Language model scoring with a hidden Markov model trained by Baum-Welch.

Words are counted over all training documents. The most frequent ones, a fixed number, are symbols of the model; all others share the
symbol TAIL and are told apart by their own smoothed share among the rest. Latent states emit symbols. A bounded sample gives the first
parameters; each round then computes expected counts in every partition, over all training documents, sums them by symbol and
re-estimates. A text's probability is that of its symbols by the scaled forward recursion, which is exact, times the shares of its rare
words; these and the counts for the plain score come from a join with the word counts, so no table that grows with the corpus is ever
sent to one place.

Tokens are words split at ASCII white space with A-Z lower-cased, then one end of text. Null texts have just that end. Documents whose
crc32 of the id as text (null: empty) is 0 modulo 10 are held out. Training pieces have at most PIECE tokens: longer texts start anew,
so that a task's memory is bounded; scores never cut a text. Repeated rows count and score as often as they occur. Other columns are
not read. Without training documents every token is unknown.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setscope.functions.tables import materialise
from setscope.llm.common import fields

STATES, HEAD, ROUNDS = 6, 1 << 17, 2
#: Words seen less often are no symbols of their own; weight of the plain shares in each state.
LEAST_COUNT, PRIOR = 8, 50
#: The sample for the first parameters: documents, their tokens, rounds.
SAMPLE_DOCS, SAMPLE_TOKENS, SAMPLE_ROUNDS = 400, 4096, 25
SMOOTHING, HELD_OUT = 0.1, 10
END, TAIL, FIRST_WORD = 0, 1, 2
PIECE, BATCH_TOKENS, COUNTED_WORDS = 1 << 16, 3_000_000, 400_000
#: Counts of words are put into classes this fine, per doubling, to find the most frequent ones.
CLASSES = 64


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states


def rows_of(docs: DataFrame) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % HELD_OUT == 0
    return fields(docs, doc_id="bigint", text="string").withColumn("held_out", held_out)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def count_words(rows: DataFrame) -> DataFrame:
    """``(token, c)`` over the training documents: counted in tasks, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "c"])
            counts.clear()
            return b

        for b in batches:
            for text in b["text"]:
                counts.update(words_of(text.as_py()))
                if len(counts) > COUNTED_WORDS:
                    yield out()
        yield out()

    counted = rows.filter(~F.col("held_out")).select("text").mapInArrow(run, "token binary, c bigint")
    return counted.groupBy("token").agg(F.sum("c").alias("c"))


def head_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``most``: whole classes of counts from the top."""
    classed = counts.withColumn("class", F.floor(F.log2("c") * CLASSES).cast("int"))
    least, held = None, 0
    classed = classed.filter(F.col("c") >= LEAST_COUNT)
    for row in sorted(classed.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if held + row["n"] > most:
            break
        least, held = row["class"], held + row["n"]
    if least is None:
        return []
    found = classed.filter(F.col("class") >= least).select("token", "c").toArrow()
    pairs = zip(found["token"].to_pylist(), found["c"].to_pylist(), strict=True)
    return sorted(pairs, key=lambda x: (-x[1], x[0]))


def encode(rows: DataFrame, head: list[bytes]) -> DataFrame:
    """``(row_id, doc_id, held_out, ids, tail)``: symbols of each text and its rare words. The ids are unique once this is written."""
    schema = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.list_(pa.int32())), ("tail", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: i + FIRST_WORD for i, w in enumerate(head)}
        row, get = TaskContext.get().partitionId() << 33, known.get
        for b in batches:
            ids, tails, sizes = [], [], []
            for text in b["text"]:
                words = words_of(text.as_py())
                ids.append(np.fromiter((get(w, TAIL) for w in words), dtype=np.int32, count=len(words)))
                ids.append(np.array([END], dtype=np.int32))
                tails.append([w for w in words if w not in known])
                sizes.append(len(words) + 1)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            numbers = np.arange(row, row + b.num_rows)
            row += b.num_rows
            columns = [pa.array(numbers), b["doc_id"], b["held_out"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(tails, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.mapInArrow(run, "row_id bigint, doc_id bigint, held_out boolean, ids array<int>, tail array<binary>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and starts, one more than lists."""
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def forward(model: Model, ids: np.ndarray, starts: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithm of each sequence's probability. All sequences advance together, the longest first in order, so those still
    running are a prefix. ``keep`` gets the scaled forward values of every token."""
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = starts[:-1][order], sizes[order]
    running = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="left")
    total, alpha = np.zeros(len(sizes)), np.empty((len(sizes), len(model.start)))
    for t, n in enumerate(running):
        at = first[:n] + t
        now = (alpha[:n] @ model.move if t else model.start) * model.emit[ids[at]]
        scale = now.sum(axis=1)
        alpha = now / scale[:, None]
        total[:n] += np.log(scale)
        if keep is not None:
            keep[at] = alpha
    out = np.empty(len(sizes))
    out[order] = total
    return out


def expected_counts(model: Model, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the sequences: expected first states, moves, and emissions (symbols x states)."""
    symbols, states = model.emit.shape
    share = np.empty((len(ids), states), dtype=np.float32)
    forward(model, ids, starts, share)
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = starts[:-1][order], sizes[order]
    running = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="left")
    moves, beta = np.zeros((states, states)), np.ones((len(sizes), states))
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        at = first[:n] + t
        ahead = running[t + 1] if t + 1 < len(running) else 0
        alpha = share[at].astype(np.float64)
        here = np.ones((n, states))
        if ahead:
            weighted = model.emit[ids[at[:ahead] + 1]] * beta[:ahead]
            back = weighted @ model.move.T
            norm = (alpha[:ahead] * back).sum(axis=1, keepdims=True)
            moves += model.move * (alpha[:ahead].T @ (weighted / norm))
            here[:ahead] = back / norm
        beta[:n] = here
        gamma = alpha * here
        share[at] = gamma / gamma.sum(axis=1, keepdims=True)
    emissions = np.stack([np.bincount(ids, weights=share[:, k], minlength=symbols) for k in range(states)], axis=1)
    nonempty = starts[:-1][np.diff(starts) > 0]
    return share[nonempty].sum(axis=0, dtype=np.float64), moves, emissions


def reestimate(start: np.ndarray, moves: np.ndarray, emissions: np.ndarray, plain: np.ndarray) -> Model:
    """Parameters from expected counts; a little of the plain shares keeps every symbol possible in every state."""
    states = len(start)
    start = (start + 1 / states) / (start.sum() + 1)
    moves = (moves + 1 / states) / (moves.sum(axis=1, keepdims=True) + 1)
    emit = (emissions + PRIOR * plain[:, None]) / (emissions.sum(axis=0, keepdims=True) + PRIOR)
    return Model(start, moves, emit)


def first_model(sample: list[np.ndarray], plain: np.ndarray, states: int, rounds: int) -> Model:
    """Baum-Welch on a few sequences, from states that tend to last and slightly different emissions."""
    noise = np.random.default_rng(7).gamma(2.0, 0.5, size=(len(plain), states))
    emit = plain[:, None] * noise
    model = Model(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(axis=0))
    if sample:
        ids, starts = np.concatenate(sample), np.concatenate([[0], np.cumsum([len(s) for s in sample])]).astype(np.int64)
        for _ in range(rounds):
            model = reestimate(*expected_counts(model, ids, starts), plain)
    return model


def _pieces(starts: np.ndarray) -> np.ndarray:
    """Starts with those of pieces put between."""
    cuts = [np.arange(a, z, PIECE) for a, z in zip(starts[:-1], starts[1:], strict=True)]
    return np.concatenate([*cuts, starts[-1:]]).astype(np.int64)


def _portions(starts: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of sequences of about BATCH_TOKENS tokens, as their starts."""
    at = 0
    while at < len(starts) - 1:
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + BATCH_TOKENS, side="right")) - 1)
        yield starts[at : to + 1]
        at = to


def corpus_counts(encoded: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over all training documents: summed in each task, then by symbol; the driver gets one row for each symbol."""
    symbols, states = model.emit.shape
    names = [f"c{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of symbols, then those of moves, then that of first states.
        total = np.zeros((symbols + states + 1, states))
        for b in batches:
            ids, starts = _lists(b["ids"])
            for portion in _portions(_pieces(starts)):
                start, moves, emissions = expected_counts(model, ids[portion[0] : portion[-1]], portion - portion[0])
                total[:symbols] += emissions
                total[symbols:-1] += moves
                total[-1] += start
        rows = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows), *[pa.array(np.ascontiguousarray(total[rows, k])) for k in range(states)]], ["row", *names])

    counted = encoded.filter(~F.col("held_out")).select("ids").mapInArrow(run, "row bigint, " + ", ".join(f"{n} double" for n in names))
    table = counted.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    total = np.zeros((symbols + states + 1, states))
    total[table["row"].to_numpy()] = np.stack([table[n].to_numpy() for n in names], axis=1)
    return total[-1], total[symbols:-1], total[:symbols]


@dataclass
class Corpus:
    """What is known of the training documents."""

    rows: DataFrame
    counts: DataFrame
    head: list[tuple[bytes, int]]
    encoded: DataFrame
    tokens: int
    distinct: int
    documents: int

    @property
    def shares(self) -> np.ndarray:
        """Plain shares of the symbols, all above zero."""
        known = [self.documents, self.tokens - self.documents - sum(c for _, c in self.head), *[c for _, c in self.head]]
        share = np.array(known, dtype=np.float64) + SMOOTHING
        return share / share.sum()


def read_corpus(docs: DataFrame, head: int = HEAD) -> Corpus:
    rows = rows_of(docs)
    counts = materialise(count_words(rows), "lm-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    words = head_words(counts, head)
    encoded = materialise(encode(rows, [w for w, _ in words]), "lm-encoded")
    documents = encoded.filter(~F.col("held_out")).count()
    return Corpus(rows, counts, words, encoded, (total["n"] or 0) + documents, total["v"] + (documents > 0), documents)


def train(corpus: Corpus, states: int = STATES, rounds: int = ROUNDS) -> Model:
    plain = corpus.shares
    training = corpus.encoded.filter(~F.col("held_out") & (F.size("ids") <= SAMPLE_TOKENS))
    sample = training.select(F.xxhash64("doc_id", "row_id").alias("at"), "ids").orderBy("at").limit(SAMPLE_DOCS).toArrow()["ids"].to_pylist()
    model = first_model([np.array(s, dtype=np.int32) for s in sample], plain, states, SAMPLE_ROUNDS)
    for _ in range(rounds):
        model = reestimate(*corpus_counts(corpus.encoded, model), plain)
    return model


def score(corpus: Corpus, model: Model) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every document, training or not."""
    counts = np.array([corpus.documents, 0, *[c for _, c in corpus.head]], dtype=np.float64)
    base = np.log10((counts + SMOOTHING) / (corpus.tokens + SMOOTHING * (corpus.distinct + 1)))
    base[TAIL] = 0.0
    known = (counts > 0).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts = _lists(b["ids"])
            values = np.concatenate([forward(model, ids[p[0] : p[-1]], p - p[0]) for p in _portions(starts)] or [np.empty(0)])
            sums = [np.add.reduceat(x[ids], starts[:-1]) if len(ids) else x[:0] for x in (known, base)]
            columns = [np.diff(starts), *sums, values / math.log(10)]
            yield pa.RecordBatch.from_arrays([b["row_id"], b["doc_id"], b["held_out"], *[pa.array(c) for c in columns]], names)

    names = ["row_id", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "symbols"]
    schema = "row_id bigint, doc_id bigint, held_out boolean, n_tokens bigint, head_known bigint, head_base double, symbols double"
    scored = corpus.encoded.select("row_id", "doc_id", "held_out", "ids").mapInArrow(run, schema)
    rare = corpus.encoded.select("row_id", F.explode("tail").alias("token"))
    rare = rare.join(corpus.counts, "token", "left")
    rare = rare.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("n_rare"), F.count("c").alias("rare_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + SMOOTHING)).alias("rare_log")
    )
    n_head = sum(c for _, c in corpus.head) + corpus.documents
    distinct_head = len(corpus.head) + (corpus.documents > 0)
    all_log = math.log10(corpus.tokens + SMOOTHING * (corpus.distinct + 1))
    tail_log = math.log10(corpus.tokens - n_head + SMOOTHING * (corpus.distinct - distinct_head + 1))
    n, log = F.coalesce("n_rare", F.lit(0)), F.coalesce("rare_log", F.lit(0.0))
    return scored.join(rare, "row_id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(corpus.tokens).cast("bigint").alias("train_tokens"),
        (F.col("head_base") + log - n * all_log).alias("base_score"),
        (F.col("symbols") + log - n * tail_log).alias("score"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    corpus = read_corpus(docs)
    return score(corpus, train(corpus))
