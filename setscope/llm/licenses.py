"""License scan: ordered signature rules behind a keyword prefilter, with overlapping detections resolved.

A text is reduced to lower-case words joined by spaces. A rule runs only where one of its keywords occurs. Detections are taken
strongest first (priority, then length, then place, then name); one inside an interval already taken is suppressed. Beside the rules,
the places of four plain phrases are always reported.

Null texts have no words and no detections; an empty table gives no rows. Other columns are not read, repeated rows give repeated
results. Long texts are scanned whole: places become word numbers by search in the list of word starts, and suppression asks a tree of
ends, so time grows with the text and its detections, up to a logarithm.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setscope.llm.common import MARKS_TO_SPACES, fields, worker_object
from setscope.llm.license_rules import Rule, rules

#: Phrases that are always counted, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

SCHEMA = (
    "doc_id bigint, n_words bigint, places array<struct<start:bigint,label:string>>, "
    "detections array<struct<start:bigint,end:bigint,rule:string,label:string,weight:double>>"
)
ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("places", pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))),
        ("detections", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("rule", pa.string()), ("label", pa.string()), ("weight", pa.float64())]))),
    ]
)


class Scanner:
    def __init__(self, which: list[Rule]):
        self.rules = [(r, re.compile(r.pattern)) for r in which]
        by_word: dict[bytes, list[int]] = {}
        for i, r in enumerate(which):
            for k in r.keywords:
                by_word.setdefault(f" {k}".encode(), []).append(i)
        self.by_word = list(by_word.items())
        self.phrases = [(f" {p} ".encode(), label) for p, label in PHRASES]

    def scan(self, text: str | None) -> tuple[int, list, list]:
        """Number of words, places of the phrases, detections; all in words from 0."""
        words = (text or "").encode().translate(MARKS_TO_SPACES).split()
        line = b" " + b" ".join(words) + b" "
        places, starts = [], None
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                starts = word_starts(words) if starts is None else starts
                places.append((bisect_left(starts, at + 1), label))
                at = line.find(phrase, at + 1)
        due = sorted({i for k, which in self.by_word if k in line for i in which})
        found = []
        if due:
            plain = line.decode()
            starts = word_starts(plain.split(" ")[1:-1])
            for i in due:
                rule, pattern = self.rules[i]
                for m in pattern.finditer(plain):
                    start = bisect_right(starts, m.start()) - 1
                    found.append((rule.priority, m.start() - m.end(), start, start + m[0].strip().count(" ") + 1, rule))
        return len(words), sorted(places), resolve(found)


def word_starts(words: list) -> list[int]:
    """Where words begin that are joined by blanks behind a first blank."""
    return list(accumulate((len(w) + 1 for w in words), initial=1))[:-1]


def resolve(found: list[tuple]) -> list[tuple]:
    """Detections that no stronger one contains, by place."""
    at = {start: i for i, start in enumerate(sorted({d[2] for d in found}), 1)}
    # A binary indexed tree: the farthest end of the intervals taken that start at a place or before it.
    tree, kept = [-1] * (len(at) + 1), []
    for _, _, start, end, rule in sorted(found, key=lambda d: (d[0], d[1], d[2], d[4].name)):
        i, farthest = at[start], -1
        while i:
            farthest = max(farthest, tree[i])
            i &= i - 1
        if farthest >= end:
            continue
        i = at[start]
        while i < len(tree):
            tree[i] = max(tree[i], end)
            i += i & -i
        kept.append((start, end, rule.name, rule.label, rule.weight))
    return sorted(kept)


def scan_licenses(docs: DataFrame, which: list[Rule] | None = None) -> DataFrame:
    """``(doc_id, n_words, places, detections)``: one pass over the texts, no shuffle."""
    which = rules() if which is None else which

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = worker_object(("licenses", tuple(which)), lambda: Scanner(which))
        for b in batches:
            got = [scanner.scan(t.as_py()) for t in b["text"]]
            places = [[{"start": s, "label": x} for s, x in p] for _, p, _ in got]
            detections = [[dict(zip(("start", "end", "rule", "label", "weight"), d, strict=True)) for d in ds] for _, _, ds in got]
            columns = [b["doc_id"], [n for n, _, _ in got], places, detections]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)

    return fields(docs, doc_id="bigint", text="string").mapInArrow(run, SCHEMA)


def license_summary(scanned: DataFrame) -> DataFrame:
    """Per document: counts and labels. The score is the largest weight of its detections, 0 without one."""
    start, base = F.transform("places", lambda p: p["start"]), F.transform("places", lambda p: p["label"])
    found = F.transform("detections", lambda d: d["label"])
    weights = F.transform("detections", lambda d: d["weight"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, found)), ",").alias("labels"),
        F.coalesce(F.array_max(weights), F.lit(0.0)).alias("score"),
    )
