"""Near-duplicates by SimHash with deletion-variant signatures.

A fingerprint is cut into so few segments that, of two fingerprints within the permitted distance, one segment differs by one bit at
most: two segments for three bits. Each segment is indexed as it is and with each of its bits left out; equal keys make a bucket, and a
bucket's members are compared bit by bit. A key with a bit left out only links fingerprints that differ in that bit, since all others
meet in the plain key.

Only distinct fingerprints are indexed, however many texts share one. A bucket gives a tree for each connected group of its members, or,
if it has a handful of them, their links. Segment values with very many members (a family of near-copies) are indexed again by the rest of
their bits, for the distance that the bits left out so far leave, until buckets are small or no bits are left. Then a bucket's members
differ in bits left out only, which are as many as the distance at most, so no bucket grows with the input and none is cut short.

Words are split at ASCII white space and A-Z lower-cased. Fewer words than a shingle are one shingle; no words, null texts among them,
give fingerprint zero, which links like any other. Null ids never become class ids. Other columns are not read; repeated rows give
repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setscope.functions.tables import materialise
from setscope.llm.common import fields, partitions
from setscope.llm.components import components

BITS, SEED = 64, 42
#: Members of a bucket that are compared in one task at most.
BUCKET = 4096
#: Buckets of so many members give all their links, larger ones a tree.
SMALL = 16
#: Fingerprints of shingles summed at once: bounds the memory of very long texts.
CHUNK = 1 << 15


def _counts(hashes: Iterator[int], n: int) -> np.ndarray:
    """In how many of ``n`` hashes each bit is set."""
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, CHUNK):
        block = np.fromiter(hashes, dtype=np.uint64, count=min(CHUNK, n - at))
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def _joined(words: list[bytes], width: int) -> tuple[Iterator[bytes], int]:
    if not words:
        return iter(()), 0
    if len(words) < width:
        return iter([b" ".join(words)]), 1
    if width == 1:
        return iter(words), len(words)
    return map(b" ".join, zip(*[words[i:] for i in range(width)])), len(words) - width + 1


def fingerprint(text: str | None, width: int) -> int:
    """SimHash of a text's shingles, as a signed number: a bit is set if it is in over half the hashes."""
    shingles, n = _joined((text or "").encode().lower().split(), width)
    if not n:
        return 0
    counts = _counts(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), n)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, text_hash, fp)``; a null text counts as an empty one."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "text_hash", "fp")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint(text.as_py(), width) for text in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], pa.array(prints, pa.int64())], schema=schema)

    rows = fields(docs, doc_id="bigint", text="string").withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segment_masks(free: int, distance: int) -> list[int]:
    """The free bits cut into segments of which one differs by at most a bit, as masks."""
    bits = [i for i in range(BITS) if free >> i & 1]
    n = distance // 2 + 1
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:]) if z > a]


COLUMNS = ("key", "must", "free", "fp")
SCHEMA = ", ".join(f"{c} bigint" for c in COLUMNS)


def _frame(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns.values()], names=list(columns))


def _keys(rows: DataFrame, distance: int, wildcards: bool = True) -> DataFrame:
    """Each row of COLUMNS once for every key of the next level: ``key`` hashes the path, ``must`` has the bits left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                table = {c: b[c].to_numpy(zero_copy_only=False).view(np.uint64) for c in COLUMNS}
                spent = np.bitwise_count(table["must"]).astype(np.uint64)
                for free, so_far in np.unique(np.stack([table["free"], spent]), axis=1).T:
                    at = (table["free"] == free) & (spent == so_far)
                    own = {c: v[at] for c, v in table.items()}
                    rest = distance - int(so_far)
                    for number, mask in enumerate(segment_masks(int(free), rest)):
                        left_out = [1 << i for i in range(BITS) if mask >> i & 1] if wildcards and rest else []
                        for bit in [0, *left_out]:
                            path = _mix(own["key"] + np.uint64((number << 8) + bit.bit_length() + 1))
                            key = _mix(path ^ (own["fp"] & np.uint64(mask & ~bit)))
                            changed = {"key": key, "must": own["must"] | np.uint64(bit), "free": np.full(len(key), int(free) & ~mask, np.uint64)}
                            yield _frame(**{c: changed.get(c, own[c]) for c in COLUMNS})

    return rows.mapInArrow(run, SCHEMA)


def bucket_links(rows: dict[str, np.ndarray], distance: int) -> list[tuple[int, int]]:
    """A tree for each connected group of one bucket's members."""
    fp, must = rows["fp"], rows["must"][0]
    left, out = np.arange(len(fp)), []
    while len(left) > 1:
        start, left, todo = left[0], left[1:], [left[0]]
        while todo and len(left):
            i = todo.pop()
            apart = fp[left] ^ fp[i]
            near = (np.bitwise_count(apart) <= distance) & ((apart & must) == must)
            if near.any():
                found = left[near]
                out.extend((start, j) for j in found)
                todo.extend(found)
                left = left[~near]
    return [(int(fp[a].view(np.int64)), int(fp[b].view(np.int64))) for a, b in out]


def _bucket_trees(keyed: DataFrame, distance: int) -> DataFrame:
    """Links ``(a, b)`` of keyed rows, sorted by key; memory holds a batch and one bucket."""
    keyed = keyed.select("key", "must", "fp").repartition(partitions(keyed.sparkSession), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None

        def linked(rows: dict[str, np.ndarray], ends: np.ndarray) -> pa.RecordBatch:
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            sizes, out = ends - starts, []
            # Most buckets are small: their pairs are compared all at once, by how far apart they stand.
            small, at, pairs = np.repeat(sizes <= SMALL, sizes), np.arange(ends[-1]), []
            last = np.repeat(ends, sizes)
            for step in range(1, SMALL):
                one = at[small & (at + step < last)]
                if not len(one):
                    break
                apart = rows["fp"][one] ^ rows["fp"][one + step]
                one = one[(np.bitwise_count(apart) <= distance) & ((apart & rows["must"][one]) == rows["must"][one])]
                pairs.append(np.stack([rows["fp"][one], rows["fp"][one + step]], axis=1).view(np.int64))
            for a, z in zip(starts[sizes > SMALL], ends[sizes > SMALL], strict=True):
                out.extend(bucket_links({c: v[a:z] for c, v in rows.items()}, distance))
            found = np.concatenate([np.array(out, dtype=np.int64).reshape(-1, 2), *pairs])
            return _frame(a=found[:, 0], b=found[:, 1])

        for b in batches:
            rows = {c: b[c].to_numpy(zero_copy_only=False).view(np.uint64) for c in b.schema.names}
            if rest is not None:
                rows = {c: np.concatenate([rest[c], v]) for c, v in rows.items()}
            ends = np.flatnonzero(np.diff(rows["key"])) + 1
            if len(ends):
                yield linked({c: v[: ends[-1]] for c, v in rows.items()}, ends)
                rows = {c: v[ends[-1] :] for c, v in rows.items()}
            rest = rows
        if rest is not None and len(rest["key"]):
            yield linked(rest, np.array([len(rest["key"])]))

    return keyed.mapInArrow(run, "a bigint, b bigint")


def near_links(nodes: DataFrame, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct ``fp`` of the nodes within ``distance`` bits."""
    spark = nodes.sparkSession
    zero = F.lit(0).cast("bigint")
    rows = nodes.select("fp").distinct().select(zero.alias("key"), zero.alias("must"), F.lit(-1).cast("bigint").alias("free"), "fp")
    whole = spark.createDataFrame([], "a bigint, b bigint")
    level = 0
    while True:
        # A key with a bit left out holds at most the members of two plain keys, so counting the plain ones is enough.
        plain = _keys(rows, distance, wildcards=False)
        hot = plain.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket // 2)
        keyed = _keys(rows, distance)
        if hot.isEmpty():
            return whole.unionByName(_bucket_trees(keyed, distance))
        keyed = materialise(keyed, f"simhash-keys-{level}")
        # Without bits to tell them apart, members of a bucket differ in the bits left out only: a handful, compared as they are.
        sizes = keyed.filter("free <> 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select("key")
        sizes = materialise(sizes, f"simhash-large-{level}")
        light = keyed.join(sizes, "key", "left_anti")
        whole = whole.unionByName(_bucket_trees(light, distance))
        rows = materialise(keyed.join(sizes, "key", "left_semi").select(*COLUMNS), f"simhash-rest-{level}")
        level += 1


def near_duplicate_classes(docs: DataFrame, width: int = 3, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, text_hash, fp, root, component_id)`` per document; the class id is the smallest id reachable over links, ``root`` a
    fingerprint of the class, which tells classes apart where an id repeats with different texts."""
    prints = materialise(fingerprints(docs, width), "simhash-prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    named = components(near_links(nodes, distance, bucket)).withColumnRenamed("node", "fp")
    roots = materialise(nodes.join(named, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = roots.join(least, "root").select("fp", "root", "component_id")
    return prints.join(classes, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def fingerprint_text(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
