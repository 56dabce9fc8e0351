"""Small tables with everything that may be odd: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

from __future__ import annotations

import random

import pyarrow as pa

#: Names that operators use inside.
CLASHING = (
    "key", "at", "fp", "node", "start", "end", "kind", "label", "words", "spans", "shard", "left", "right", "text_hash", "row_id",
    "row", "id", "hash", "rest", "of_id", "of_hash", "of_doc_id", "of_text_hash", "clean", "before", "_before", "_hash", "_spans", "_doc_id", "_chars",
)


def documents(rows: list[tuple]) -> pa.Table:
    """``(doc_id, text)`` rows as documents; metadata has nulls, too."""
    n = len(rows)
    columns = {
        "doc_id": pa.array([r[0] for r in rows], pa.int64()),
        "text": pa.array([r[1] for r in rows], pa.string()),
        "lang": pa.array([None if i % 5 == 4 else ("en", "de")[i % 2] for i in range(n)], pa.string()),
        "source": pa.array([None if i % 7 == 6 else f"src{i % 3}" for i in range(n)], pa.string()),
        "n_chars": pa.array([None if r[1] is None else len(r[1]) for r in rows], pa.int64()),
    }
    return pa.table(columns | {c: pa.array([f"{c}{i % 2}" if i % 3 else None for i in range(n)], pa.string()) for c in CLASHING})


def words(n: int, seed: int, vocabulary: int = 400) -> str:
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    long = words(6000, 1)
    return [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "x"),
        (5, long),
        (6, long),
        (7, long + " end"),
        (None, "text without an id " + words(60, 2)),
        (8, words(60, 3)),
        (8, words(60, 3)),
        (9, words(30, 4) + " " + words(60, 3) + " " + words(20, 5)),
        (10, "Grüße 漢字 \U0001f600 é " * 3),
        (11, "same " * 300),
        (12, "same " * 301),
        (13, "a" * 30_000),
        (14, words(60, 2)),
    ]


def frame(spark, table: pa.Table):
    return spark.createDataFrame(table)
