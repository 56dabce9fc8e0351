"""Quality classifier by co-training.

Two views of a document are classified apart: its text (character and repetition statistics, and how typical its words and word
beginnings are of a class) and its metadata (language, source, length). There are two heads: good or poor, toxic or not. In every round
each view scores all unlabelled documents and hands those it is surest of to the other view as examples, a growing share of all with
the two classes in their known proportion. It does so only if, on labelled documents kept aside, the same scores halve the error that
naming either class everywhere would make; else the view has nothing to teach in that round. The views are then calibrated on
the documents kept aside and combined. A document is accepted if it is more likely good and not toxic than otherwise.

Only the labelled sample, at most LABELLED rows by a hash of their ids, is gathered for fitting. Unlabelled documents, all of them, stay
in a table of features written once: what comes back are histograms of scores and the sums of Newton's method over the documents handed
over, in decimals, so that they do not depend on partitions.

Null texts are empty, null metadata is a value of its own. Labels that are null are left out; of several labels of one document the
worst counts, and an id with several texts is an example with each. A head without examples of both kinds gives the share it has seen,
and without any label accepts. Probabilities of exactly a half accept. Texts are read whole; memory grows with a text's words. Other
columns are not read by the models; repeated rows are scored alike, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import operator
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructType

from setscope.functions.tables import materialise
from setscope.llm.common import fields, worker_object

LABELLED, ROUNDS, STEPS = 4500, 3, 12
#: Share of the unlabelled documents that a view hands over in the first round, twice that in the second and so on; their weight.
HANDED, PSEUDO_WEIGHT = 0.1, 0.5
#: Scores are counted in bins of log odds this wide, up to 30 either way.
BIN, BINS = 0.05, 1201
#: A word or beginning counts if so many documents of the sample have it; how many are kept per head at most.
LEAST_DOCS, MOST_MARKS, KEPT_WORDS = 4, 40_000, 150_000
HEADS, VIEWS = ("good", "toxic"), ("text", "meta")
UPPER_BYTES = bytes(range(65, 91))
SYMBOL_BYTES = b"!#$%&*+/<=>@[\\]^_`{|}~"
DIGIT_BYTES = bytes(range(48, 58))
META = ("lang", "source", "n_chars")


def marks(word: str) -> tuple[str, ...]:
    """A word without its punctuation, and its beginnings."""
    plain = word.strip(".,;:!?\"'()[]#$%&*|")
    return plain, f"{plain[:4]}-", f"{plain[:5]}-"


def statistics(text: str, words: list[str]) -> list[float]:
    """Of a whole text: kinds of characters, lengths, repetitions."""
    raw, n = text.encode(), max(1, len(words))
    size = max(1, len(raw))
    share = lambda kind: (len(raw) - len(raw.translate(None, kind))) / size
    threes = max(1, len(words) - 2)
    lines = text.split("\n")
    return [
        share(UPPER_BYTES),
        share(SYMBOL_BYTES),
        share(DIGIT_BYTES),
        math.log1p(len(words)),
        len(text) / n,
        len(set(words)) / n,
        len(set(words)) / n**0.8,
        len(set(zip(words, words[1:], words[2:]))) / threes,
        sum(map(operator.eq, words, words[1:])) / n,
        len(set(lines)) / len(lines),
        len(lines) / n,
    ]


def distinct_words(text: str) -> tuple[list[str], set[str]]:
    words = text.lower().split()
    return words, set(words)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logit(p: np.ndarray) -> np.ndarray:
    return np.log(p) - np.log1p(-p)


@dataclass
class Logistic:
    """Logistic regression on standardised features, fitted by Newton's method with a ridge."""

    ridge: float = 1.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def fit(self, x: np.ndarray, y: np.ndarray, importance: np.ndarray | None = None) -> Logistic:
        importance = np.ones(len(y)) if importance is None else importance
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        z = self._rows(x)
        self.weight = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], self.ridge)
        ridge[-1] = 1e-3
        for _ in range(30):
            p = sigmoid(z @ self.weight)
            slope = z.T @ (importance * (y - p)) - ridge * self.weight
            bend = (z * (importance * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(bend, slope)
            self.weight = self.weight + step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def sums(self, x: np.ndarray, y: np.ndarray, importance: np.ndarray) -> np.ndarray:
        """Slope and bend of the likelihood at the present weights, in one row; they add up over documents."""
        z = self._rows(x)
        p = sigmoid(z @ self.weight)
        return np.concatenate([z.T @ (importance * (y - p)), ((z * (importance * p * (1 - p))[:, None]).T @ z).ravel()])

    def stepped(self, sums: np.ndarray) -> Logistic:
        """One step of Newton's method with the ridge."""
        d = len(self.weight)
        ridge = np.full(d, self.ridge)
        ridge[-1] = 1e-3
        step = np.linalg.solve(sums[d:].reshape(d, d) + np.diag(ridge), sums[:d] - ridge * self.weight)
        return Logistic(self.ridge, self.mean, self.scale, self.weight + step)

    def _rows(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._rows(x) @ self.weight, -30, 30)


@dataclass
class Head:
    """One of the two questions: marks with their log ratios, a classifier for each view, calibration, combination."""

    ratios: dict[str, float]
    text: Logistic
    meta: Logistic
    combined: Logistic
    share: float | None = None

    def probability(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(text), self.share)
        return sigmoid(self.combined.logits(np.stack([self.text.logits(text), self.meta.logits(meta)], axis=1)))


@dataclass
class Model:
    heads: dict[str, Head]
    langs: list[str]
    sources: list[str]
    name: str = ""

    def meta_features(self, rows: list[tuple]) -> np.ndarray:
        out = np.zeros((len(rows), len(self.langs) + len(self.sources) + 2))
        langs, sources = {v: i for i, v in enumerate(self.langs)}, {v: i + len(self.langs) for i, v in enumerate(self.sources)}
        for i, (lang, source, size) in enumerate(rows):
            for at in (langs.get(str(lang)), sources.get(str(source))):
                if at is not None:
                    out[i, at] = 1
            out[i, -2:] = (math.log1p(max(0, size)), 0) if size is not None else (0, 1)
        return out


class Marked:
    """Looks up what words say of a head; keeps a bounded number of words."""

    def __init__(self, ratios: dict[str, float]):
        self.ratios, self.kept = ratios, {}

    def word(self, word: str) -> float:
        got = self.kept.get(word)
        if got is None:
            found = [r for m in marks(word) if (r := self.ratios.get(m)) is not None]
            got = max(found, key=abs) if found else 0.0
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            self.kept[word] = got
        return got

    def features(self, words: set[str]) -> list[float]:
        """The strongest two words for the class, the strongest against, and their mean."""
        values = [self.kept[w] if w in self.kept else self.word(w) for w in words] or [0.0]
        top = sorted(values)[-2:]
        return [top[-1], top[0], min(values), sum(values) / len(values)]


def _ratios(words: list[set[str]], y: np.ndarray) -> dict[str, float]:
    """Log ratios of marks between the two classes, for the most telling ones."""
    yes, no = Counter(), Counter()
    for own, label in zip(words, y, strict=True):
        (yes if label else no).update({m for w in own for m in marks(w)})
    n_yes, n_no = y.sum() + 1, len(y) - y.sum() + 1
    found = {m: math.log((yes[m] + 0.5) / n_yes) - math.log((no[m] + 0.5) / n_no) for m in {*yes, *no} if yes[m] + no[m] >= LEAST_DOCS}
    strongest = sorted(found.items(), key=lambda x: (-abs(x[1]), x[0]))[:MOST_MARKS]
    return {m: r for m, r in strongest if abs(r) > 0.5}


@dataclass
class Lesson:
    """What one head learns from the labelled sample: rows of both views to fit and to keep aside."""

    fit: dict[str, np.ndarray]
    aside: dict[str, np.ndarray]
    y_fit: np.ndarray
    y_aside: np.ndarray

    def prior(self) -> float:
        return float(np.concatenate([self.y_fit, self.y_aside]).mean())


def _lesson(own: list[set[str]], stats: np.ndarray, meta: np.ndarray, y: np.ndarray, unknown: float) -> tuple[Head, Lesson | None]:
    """A head fitted to labelled rows only: a third gives the ratios, a third fits, a third is kept aside."""
    if not len(y) or y.min() == y.max() or min((y == v)[i::3].sum() for v in (0, 1) for i in range(3)) == 0:
        return Head({}, Logistic(), Logistic(), Logistic(), float(y.mean()) if len(y) else unknown), None
    third = np.arange(len(y)) % 3
    ratios = _ratios([w for w, t in zip(own, third, strict=True) if t != 2], y[third != 2])
    # Ratios for fitting come from rows that are not fitted; those for use come from both thirds.
    apart = Marked(_ratios([w for w, t in zip(own, third, strict=True) if t == 0], y[third == 0]))
    whole = Marked(ratios)
    rows = lambda which, m: np.hstack([stats[which], np.array([m.features(own[i]) for i in np.flatnonzero(which)])])
    fit, aside = third == 1, third == 2
    lesson = Lesson({"text": rows(fit, apart), "meta": meta[fit]}, {"text": rows(aside, whole), "meta": meta[aside]}, y[fit], y[aside])
    return Head(ratios, *(Logistic().fit(lesson.fit[v], lesson.y_fit) for v in VIEWS), Logistic()), lesson


def fit(labelled: list[dict]) -> tuple[Model, dict[str, Lesson]]:
    """A model from a bounded list of rows ``text, lang, source, n_chars, good, toxic``, and what its heads go on to learn from."""
    common = lambda c: [v for v, n in Counter(str(r[c]) for r in labelled).most_common(64) if n >= 5]
    model = Model({}, common("lang"), common("source"))
    words, stats = [], np.zeros((len(labelled), len(statistics("", []))))
    for i, r in enumerate(labelled):
        text = r["text"] or ""
        all_words, distinct = distinct_words(text)
        words.append(distinct)
        stats[i] = statistics(text, all_words)
    meta = model.meta_features([tuple(r[c] for c in META) for r in labelled])
    lessons = {}
    for head, unknown in zip(HEADS, (1.0, 0.0), strict=True):
        model.heads[head], lesson = _lesson(words, stats, meta, np.array([r[head] for r in labelled], dtype=float), unknown)
        if lesson is not None:
            lessons[head] = lesson
    model.name = hashlib.sha256(repr([sorted(x.ratios.items()) for x in model.heads.values()]).encode()).hexdigest()
    return model, lessons


def _features(model: Model) -> Callable[[pa.Array], tuple[np.ndarray, dict[str, np.ndarray]]]:
    """Statistics and, for each head, word features of texts."""

    def read_texts(texts: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        looked_up = worker_object(("quality", model.name), lambda: {h: Marked(x.ratios) for h, x in model.heads.items()})
        stats, words = np.zeros((len(texts), len(statistics("", [])))), {h: np.zeros((len(texts), 4)) for h in HEADS}
        for i, text in enumerate(texts):
            text = text.as_py() or ""
            all_words, distinct = distinct_words(text)
            stats[i] = statistics(text, all_words)
            for h in HEADS:
                words[h][i] = looked_up[h].features(distinct)
        return stats, words

    return read_texts


FEATURES = "doc_id bigint, x array<double>, lang string, source string, n_chars bigint"


def feature_table(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, x, lang, source, n_chars)``: the numbers of every text, those of the heads one behind the other."""
    read_texts = _features(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats, words = read_texts(b["text"])
            x = np.hstack([stats, *[words[h] for h in HEADS]])
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], lists, *[b[c] for c in META]], names=["doc_id", "x", *META])

    rows = fields(docs, doc_id="bigint", text="string", lang="string", source="string", n_chars="bigint")
    return rows.mapInArrow(run, FEATURES)


def view_rows(b: pa.RecordBatch, model: Model) -> dict[str, dict[str, np.ndarray]]:
    """A batch of the feature table as the rows of both views, for each head."""
    n_stats = len(statistics("", []))
    x = np.array(b["x"].flatten()).reshape(b.num_rows, -1)
    meta = model.meta_features(list(zip(*[b[c].to_pylist() for c in META], strict=True)))
    return {
        h: {"text": np.hstack([x[:, :n_stats], x[:, n_stats + 4 * i : n_stats + 4 * i + 4]]), "meta": meta} for i, h in enumerate(HEADS)
    }


def _summed(rows: DataFrame, work: Callable[[pa.RecordBatch], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Arrays that ``work`` makes of each batch, added up: within a task, then place by place, as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for name, x in work(b).items():
                total[name] = total[name] + x if name in total else x
        for name, x in total.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_pydict({"name": pa.array([name] * len(at), pa.string()), "at": pa.array(at, pa.int64()), "value": pa.array(x[at], pa.float64())})

    parts = rows.mapInArrow(run, "name string, at bigint, value double")
    sums = parts.groupBy("name", "at").agg(F.sum(F.col("value").cast("decimal(38, 12)")).alias("value")).toArrow().to_pylist()
    out: dict[str, np.ndarray] = {}
    for name in {r["name"] for r in sums}:
        mine = [r for r in sums if r["name"] == name]
        out[name] = np.zeros(max(r["at"] for r in mine) + 1)
        for r in mine:
            out[name][r["at"]] = float(r["value"])
    return out


def _bins(logits: np.ndarray) -> np.ndarray:
    return np.clip(np.round(logits / BIN), -(BINS // 2), BINS // 2).astype(int) + BINS // 2


def _bounds(counts: np.ndarray, due: float, prior: float) -> tuple[int, int]:
    """The bins from which on the surest documents of either class come: their share of ``due``, and all those of the last bin, since
    equal scores are not told apart. No bin is for both."""
    high, low = np.cumsum(counts[::-1])[::-1], np.cumsum(counts)
    top = int(np.flatnonzero(high >= due * prior)[-1]) if high[0] else BINS
    bottom = int(np.flatnonzero(low >= due * (1 - prior))[0]) if low[-1] else -1
    return (top, bottom) if bottom < top else (BINS, -1)


def _teaches(bins: np.ndarray, y: np.ndarray, top: int, bottom: int) -> bool:
    """Whether naming either class beyond its bound errs at most half as often as naming it everywhere, on labelled rows kept aside."""
    for chosen, right in ((bins >= top, y), (bins <= bottom, 1 - y)):
        wrong = (((1 - right)[chosen]).sum() + 0.5) / (chosen.sum() + 1)
        if chosen.sum() < 5 or wrong > 0.5 * (1 - right).mean():
            return False
    return True


OTHER = {"text": "meta", "meta": "text"}


def co_train(model: Model, lessons: dict[str, Lesson], pool: DataFrame) -> list[dict]:
    """Rounds of exchange over all rows of ``pool``, a feature table; the heads of ``model`` are refitted and combined in place. Gives one
    row for each round, head and view that teaches: how many documents of either class it handed over."""
    handed: list[dict] = []
    views = lambda: {h: {v: getattr(model.heads[h], v) for v in VIEWS} for h in lessons}
    size = pool.count()
    for turn in range(1, ROUNDS + 1) if size and lessons else ():
        now = views()

        def count(b: pa.RecordBatch, now=now) -> dict[str, np.ndarray]:
            rows = view_rows(b, model)
            return {f"{h} {v}": np.bincount(_bins(m.logits(rows[h][v])), minlength=BINS).astype(float) for h, vs in now.items() for v, m in vs.items()}

        counts = _summed(pool, count)
        bounds: dict[tuple[str, str], tuple[int, int]] = {}
        for h, lesson in lessons.items():
            for v in VIEWS:
                n = np.pad(counts.get(f"{h} {v}", np.zeros(0)), (0, BINS))[:BINS]
                top, bottom = _bounds(n, HANDED * turn * size, lesson.prior())
                # One class alone would only shift what the other view expects.
                sound = _teaches(_bins(now[h][v].logits(lesson.aside[v])), lesson.y_aside, top, bottom)
                bounds[h, v] = (top, bottom) if sound else (BINS, -1)
                handed.append({"round": turn, "head": h, "view": v, "yes": int(n[bounds[h, v][0] :].sum()), "no": int(n[: bounds[h, v][1] + 1].sum())})
        # From zero: where a view is already sure, its likelihood is flat and a step from there leads anywhere.
        taught = {h: {v: Logistic(m.ridge, m.mean, m.scale, np.zeros(len(m.weight))) for v, m in vs.items()} for h, vs in now.items()}
        for _ in range(STEPS):

            def slope(b: pa.RecordBatch, now=now, taught=taught, bounds=bounds) -> dict[str, np.ndarray]:
                rows, out = view_rows(b, model), {}
                for (h, v), (top, bottom) in bounds.items():
                    bins = _bins(now[h][v].logits(rows[h][v]))
                    at = np.flatnonzero((bins >= top) | (bins <= bottom))
                    if len(at):
                        out[f"{h} {OTHER[v]}"] = taught[h][OTHER[v]].sums(rows[h][OTHER[v]][at], (bins[at] >= top).astype(float), np.full(len(at), PSEUDO_WEIGHT))
                return out

            found = _summed(pool, slope) if any(b != (BINS, -1) for b in bounds.values()) else {}
            moved = 0.0
            for h, lesson in lessons.items():
                for v in VIEWS:
                    m = taught[h][v]
                    own = m.sums(lesson.fit[v], lesson.y_fit, np.ones(len(lesson.y_fit)))
                    more = found.get(f"{h} {v}", np.zeros(0))
                    taught[h][v] = m.stepped(own + np.pad(more, (0, len(own) - len(more))))
                    moved = max(moved, float(np.abs(taught[h][v].weight - m.weight).max()))
            if moved < 1e-3:
                break
        for h in lessons:
            for v in VIEWS:
                setattr(model.heads[h], v, taught[h][v])
    for h, lesson in lessons.items():
        both = np.stack([getattr(model.heads[h], v).logits(lesson.aside[v]) for v in VIEWS], axis=1)
        model.heads[h].combined = Logistic(ridge=0.1).fit(both, lesson.y_aside)
    return handed


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame, list[dict]]:
    """The model, the feature table of all documents, and what was handed over."""
    key = F.col("doc_id").cast("bigint")
    known = labels.select(key.alias("doc_id"), F.col("quality").cast("int").alias("good"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("doc_id is not null and good is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.min("good").alias("good"), F.max("toxic").alias("toxic"))
    # The sample's ids are bounded in number, so they are broadcast; an id with several texts counts once for each.
    sample = known.orderBy(F.xxhash64("doc_id")).limit(LABELLED)
    rows = fields(docs, doc_id="bigint", text="string", lang="string", source="string", n_chars="bigint").join(F.broadcast(sample), "doc_id")
    rows = rows.dropDuplicates().orderBy(F.xxhash64("doc_id"), F.xxhash64("text"), *META).limit(LABELLED)
    labelled = sorted(rows.toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["text"] or "", str(r["lang"]), str(r["source"]), r["n_chars"] or 0))
    model, lessons = fit(labelled)
    table = materialise(feature_table(docs, model), "quality-features")
    pool = materialise(table.join(known.select("doc_id"), "doc_id", "left_anti"), "quality-pool")
    handed = co_train(model, lessons, pool)
    return model, table, handed


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of labelled and unlabelled documents."""
    return learn(docs, labels)[0]


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, p_good, p_toxic, accepted)`` per document, from one pass over the texts."""
    model, table, _ = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], *_verdicts(model, view_rows(b, model))], names=["doc_id", *SCORED.names])

    return table.mapInArrow(run, "doc_id bigint, p_good double, p_toxic double, accepted boolean")


def _verdicts(model: Model, rows: dict[str, dict[str, np.ndarray]]) -> list[pa.Array]:
    good, toxic = (model.heads[h].probability(rows[h]["text"], rows[h]["meta"]) for h in HEADS)
    return [pa.array(good), pa.array(toxic), pa.array(good * (1 - toxic) >= 0.5)]


SCORED = pa.schema([(c, pa.float64()) for c in ("p_good", "p_toxic")] + [("accepted", pa.bool_())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``p_good``, ``p_toxic`` and ``accepted``; names that ``docs`` has already are replaced."""
    kept = [c for c in docs.columns if c not in SCORED.names]
    inputs = docs.select(*kept)

    read_texts = _features(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats, words = read_texts(b["text"])
            meta = model.meta_features(list(zip(*[b[c].to_pylist() for c in META], strict=True)))
            rows = {h: {"text": np.hstack([stats, words[h]]), "meta": meta} for h in HEADS}
            yield pa.RecordBatch.from_arrays([*b.columns, *_verdicts(model, rows)], names=[*b.schema.names, *SCORED.names])

    out = StructType(list(inputs.schema.fields)).add("p_good", DoubleType()).add("p_toxic", DoubleType()).add("accepted", BooleanType())
    return inputs.mapInArrow(run, out)
