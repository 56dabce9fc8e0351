"""Quality by weak supervision: rules vote or abstain, their accuracies are estimated without labels, and a posterior decides.

Each rule looks at one trait of a text and calls the document good, bad, or neither. A document's votes are written as one number.
Only the distinct vote patterns and how many documents show each of them reach the driver, at most three to the power of the rules,
whatever the size of the corpus. On this table expectation-maximisation fits a model of two hidden classes: for each class and rule,
how often it votes good or bad where it votes; abstaining speaks for neither class. The start is a rule accuracy of ``BELIEF`` either way, which also stays
as a prior worth ``WEIGHT`` documents; documents that fail a base rule are known to be bad. Rules are better than chance by assumption:
of the documents that a rule calls bad, ``LEAST_ACCURACY`` or more are taken to be bad, and of those it calls good, good. Without that
bound the most frequent kind of bad document would have the bad class to itself, and rules for other kinds would count for nothing.
The posterior of a document is the prior odds times one factor for each vote.

Contract: words are split at ASCII white space. A document fails at base with fewer than ten words, or if over a fifth of its words lie
in five-word windows that the text holds twice or more. It is kept if it does not fail and its posterior is 0.5 or more. Null texts
have no words, so they fail, as empty ones do. Texts are taken whole; memory grows with a text's words, about 200 bytes each. Repeated
rows count and appear as often as they occur, other columns are not read, an empty table gives no rows. Ties at 0.5 are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setscope.functions.tables import materialise
from setscope.llm.common import LOWER, UPPER, fields

WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
BELIEF, LEAST_ACCURACY, WEIGHT, PRIOR_GOOD, ROUNDS, SETTLED = 0.85, 0.8, 20.0, 0.75, 200, 1e-9
SYMBOLS, ENDS = "#*$%&|<>", (".", "!", "?", '"', "”", "…", ":", ";", "»")

TRAITS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_marks n_upper n_lower n_distinct n_most n_lettered "
    "n_closed n_ends"
).split()


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of pairs: equal pairs, equal numbers."""
    return np.unique(a * (b.max() + 1) + b, return_inverse=True)[1]


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more. Windows are named exactly, by doubling."""
    if len(ids) <= window:
        return 0
    # A name of 2^k words comes from two names of half that; the window is put together from the widths in its binary number.
    name, width, wide, covered = ids, 1, None, 0
    while True:
        if window & width:
            part = name[covered:]
            wide = part if wide is None else _pairs(wide[: len(part)], part[: len(wide)])
            covered += width
        if covered == window:
            break
        name, width = _pairs(name[:-width], name[width:]), width * 2
    often = np.bincount(wide)[wide] > 1
    steps = np.zeros(len(ids) + 1, dtype=np.int64)
    steps[: len(often)] += often
    steps[window : window + len(often)] -= often
    return int((np.cumsum(steps)[:-1] > 0).sum())


def _without(text: bytes, letters: str) -> int:
    return len(text) - len(text.translate(None, letters.encode()))


def traits(text: str | None) -> tuple[int, ...]:
    """What the rules look at, in the order of TRAITS."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    counts = np.bincount(ids) if len(ids) else np.zeros(1, dtype=np.int64)
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    lettered = np.array([not w.isascii() or w.upper() != w.lower() for w in number], dtype=bool)
    return (
        len(words),
        len(text) - _without(raw, " \t\n\r\x0b\x0c"),
        _without(raw, SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        _without(raw, "!?"),
        _without(raw, UPPER),
        _without(raw, LOWER) + len(text) - len(text.encode("ascii", "ignore")),
        len(number),
        int(counts.max()),
        int(counts[lettered].sum()) if len(number) else 0,
        sum(line.rstrip(" \t\r\x0b\x0c").endswith(ENDS) for line in lines),
        _without(raw, ".!?"),
    )


def document_traits(docs: DataFrame) -> DataFrame:
    """``(doc_id, traits)`` per document."""
    names = ["doc_id", *TRAITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([traits(text.as_py()) for text in b["text"]], dtype=np.int64).reshape(-1, len(TRAITS))
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c) for c in found.T)], names=names)

    return fields(docs, doc_id="bigint", text="string").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else not at all. Both are SQL conditions on the traits."""

    name: str
    bad: str
    good: str


#: Shares are written as products of whole numbers, so votes are exact.
RULES = (
    Rule("enough words", "n_words < 10", "n_words >= 40"),
    Rule("words of usual length", "word_chars < 2 * n_words or word_chars > 14 * n_words", "word_chars between 3 * n_words and 9 * n_words"),
    Rule("few symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("lines differ", "10 * n_dup_lines > 3 * n_lines", "n_lines > 1 and 20 * n_dup_lines <= n_lines"),
    Rule("passages differ", "10 * n_repeat_words > 2 * n_words", "n_words >= 20 and 20 * n_repeat_words <= n_words"),
    Rule("does not shout", "5 * n_marks > n_words or n_upper > n_lower", "20 * n_marks <= n_words and 5 * n_upper <= n_lower"),
    Rule("no word prevails", "n_words >= 20 and 10 * n_most > 3 * n_words", "n_words >= 20 and 100 * n_most <= 15 * n_words"),
    Rule("words vary", "n_words >= 20 and n_words < 2000 and 10 * n_distinct < n_words", "n_words >= 20 and 10 * n_distinct >= 3 * n_words"),
    Rule("words have letters", "10 * n_lettered < 7 * n_words", "10 * n_lettered >= 9 * n_words"),
    Rule("lines are closed", "n_lines > 2 and 10 * n_closed < n_lines", "n_lines > 0 and 2 * n_closed >= n_lines"),
    Rule("sentences end", "n_words > 100 * (n_ends + 1)", "n_ends > 0 and n_words between 2 * n_ends and 40 * n_ends"),
    Rule("letters prevail", "4 * (n_lower + n_upper) < 3 * word_chars", "8 * (n_lower + n_upper) >= 7 * word_chars"),
)
BASE_FAILED = f"(n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words)"


def vote(rule: Rule) -> Column:
    """0 for no vote, 1 for good, 2 for bad."""
    return F.when(F.expr(rule.bad), 2).when(F.expr(rule.good), 1).otherwise(0)


def votes(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with their pattern: one digit to base three for each rule."""
    pattern = F.lit(0).cast("bigint")
    for j, rule in enumerate(rules):
        pattern = pattern + vote(rule) * F.lit(3**j)
    return rows.withColumns({"pattern": pattern, "base_failed": F.expr(BASE_FAILED)})


@dataclass
class Model:
    prior: float  # share of good documents
    rates: np.ndarray  # class (bad, good) x rule x vote (good, bad)
    rounds: int

    def accuracy(self) -> np.ndarray:
        """Per rule, the share of right votes among all its votes."""
        weight = np.array([1 - self.prior, self.prior])[:, None, None] * self.rates
        return (weight[1, :, 0] + weight[0, :, 1]) / weight.sum(axis=(0, 2))


def expectation_maximisation(pattern: np.ndarray, n: np.ndarray, failed: np.ndarray, rules: int) -> Model:
    """Fit to vote patterns that ``n`` documents each show; ``failed`` ones are bad."""
    digits = pattern[:, None] // 3 ** np.arange(rules) % 3
    shown = (digits[:, :, None] == np.array([1, 2])).astype(float)
    belief = np.empty((2, rules, 2))
    belief[0], belief[1] = [1 - BELIEF, BELIEF], [BELIEF, 1 - BELIEF]
    model = Model(PRIOR_GOOD, belief, 0)
    for turn in range(ROUNDS):
        logs = np.log(model.rates)
        odds = np.log(model.prior / (1 - model.prior)) + np.einsum("pjv,jv->p", shown, logs[1] - logs[0])
        good = np.where(failed, 0.0, 1 / (1 + np.exp(-np.clip(odds, -700, 700))))
        weight = np.stack([1 - good, good]) * n
        counts = np.einsum("cp,pjv->cjv", weight, shown) + WEIGHT * belief
        for right, v in ((1, 0), (0, 1)):
            lacking = np.maximum(LEAST_ACCURACY * counts[:, :, v].sum(axis=0) - counts[right, :, v], 0)
            counts[right, :, v] += lacking
            counts[1 - right, :, v] -= lacking
        rates = counts / counts.sum(axis=2, keepdims=True)
        prior = float((weight[1].sum() + WEIGHT * PRIOR_GOOD) / (weight.sum() + WEIGHT))
        change = max(abs(prior - model.prior), float(np.abs(rates - model.rates).max()))
        model = Model(prior, rates, turn + 1)
        if change < SETTLED:
            break
    return model


def fit(voted: DataFrame, rules: tuple[Rule, ...] = RULES) -> Model:
    """The model of all rows; what comes to the driver is a count for each vote pattern."""
    counted = voted.groupBy("pattern", "base_failed").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern", "base_failed").toArrow()
    pattern, failed, n = (c.to_numpy() for c in counted.columns)
    return expectation_maximisation(pattern.astype(np.int64), n.astype(float), failed.astype(bool), len(rules))


def posterior(model: Model, rules: tuple[Rule, ...] = RULES) -> Column:
    """The probability that a row with its votes in ``pattern`` is good."""
    logs = np.log(model.rates)
    odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for j in range(len(rules)):
        factor = (logs[1, j] - logs[0, j]).tolist()
        digit = F.floor(F.col("pattern") / F.lit(3**j)) % 3
        odds = odds + F.when(digit == 1, factor[0]).when(digit == 2, factor[1]).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def rule_scores(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: traits, votes in ``pattern``, ``base_failed``, ``p_good`` and ``kept``. The texts are read once."""
    voted = materialise(votes(document_traits(docs), rules), "rule-votes")
    scored = voted.withColumn("p_good", posterior(fit(voted, rules), rules))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def rule_summary(docs: DataFrame) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"]
    return rule_scores(docs).select(*columns)
