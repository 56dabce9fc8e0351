"""Repeated passages, near-duplicates, components, top-k search and archives beside brute force."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from edge import documents, frame, odd_rows, words

from setscope.llm import simhash, suffixes, topk, warc
from setscope.llm.components import components


@pytest.fixture(scope="module")
def docs(spark):
    passage = words(70, 100)
    more = [(40 + i, words(40, 200 + i) + " " + passage + " " + words(40, 300 + i)) for i in range(6)]
    a, b, c = words(25, 400), words(25, 401), words(40, 402)
    more += [(60, f"{a} {b} {words(30, 403)}"), (61, f"{words(30, 404)} {a} {b} q"), (62, f"{b} {c} z"), (63, f"{words(9, 405)} {b} {c}")]
    near = words(300, 500).split()
    for i in range(12):
        edited = list(near)
        edited[20 * i] = f"edit{i}"
        more.append((70 + i, " ".join(edited)))
    return frame(spark, documents(odd_rows() + more)).cache()


def covered(rows: list[tuple], size: int = 50) -> dict:
    seen, out = defaultdict(set), defaultdict(set)
    split = [(doc, (text or "").encode().split()) for doc, text in rows if doc is not None]
    for doc, w in split:
        for i in range(len(w) - size + 1):
            seen[tuple(w[i : i + size])].add(doc)
    for doc, w in split:
        for i in range(len(w) - size + 1):
            if len(seen[tuple(w[i : i + size])]) > 1:
                out[doc].update(range(i, i + size))
    return {k: v for k, v in out.items() if v}


def found_words(rows) -> dict:
    out = defaultdict(set)
    for r in rows.collect():
        assert r["other_doc_id"] != r["doc_id"]
        out[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    return dict(out)


@pytest.mark.parametrize("small", [False, True])
def test_repeated_passages_equal_brute_force(spark, docs, monkeypatch, small):
    if small:
        monkeypatch.setattr(suffixes, "OPENING", 2)
        monkeypatch.setattr(suffixes, "BROADCAST_KEYS", 0)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found_words(suffixes.repeated_passages(docs)) == covered(rows)


def test_repeated_passages_of_empty_and_of_other_sizes(spark, docs):
    assert suffixes.repeated_passages(docs.limit(0)).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in docs.filter("doc_id < 70").select("doc_id", "text").collect()]
    assert found_words(suffixes.repeated_passages(docs.filter("doc_id < 70"), passage=24, piece=5)) == covered(rows, 24)


def bits(text: str | None) -> int:
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(prints: list[tuple], distance: int) -> dict:
    parent = {i: i for i in range(len(prints))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        least.setdefault(find(i), []).append(doc)
    return {doc: min((d for d in least[find(i)] if d is not None), default=None) for i, (doc, _) in enumerate(prints)}


def test_fingerprints_and_classes_equal_brute_force(spark, docs):
    rows = [(r["doc_id"], bits(r["text"])) for r in docs.select("doc_id", "text").collect()]
    want = classes(rows, 3)
    for bucket in (simhash.BUCKET, 2):
        got = simhash.near_duplicate_classes(docs, bucket=bucket).select("doc_id", simhash.fingerprint_text("fp").alias("fp"), "component_id").collect()
        assert sorted((r["doc_id"] or -1, int(r["fp"], 16)) for r in got) == sorted((d or -1, f) for d, f in rows)
        assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert simhash.near_duplicate_classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("distance", "bucket"), [(3, 4096), (3, 16), (5, 8), (7, 4096)])
def test_links_connect_all_close_fingerprints(spark, distance, bucket):
    rnd = random.Random(distance)
    prints = [rnd.getrandbits(64) for _ in range(60)]
    for p in list(prints[:20]):
        for _ in range(12):
            for b in rnd.sample(range(64), rnd.randrange(1, distance + 1)):
                p ^= 1 << b
            prints.append(p)
    prints = list(dict.fromkeys(prints))
    signed = np.array(prints, dtype=np.uint64).view(np.int64)
    zero = np.zeros(len(prints), dtype=np.int64)
    nodes = frame(spark, pa.table({"node": signed, "fp": signed, "s0": zero, "s1": zero}))
    roots = {r["node"]: r["root"] for r in components(simhash.near_links(nodes, distance, bucket=bucket)).collect()}
    want = classes(list(enumerate(prints)), distance)
    got = defaultdict(set)
    for i, p in enumerate(signed.tolist()):
        got[roots.get(p, ("alone", i))].add(i)
    grouped = defaultdict(set)
    for i, c in want.items():
        grouped[c].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, grouped.values()))


@pytest.mark.parametrize("bucket", [1, 2])
def test_links_when_no_bits_are_left(spark, bucket):
    base = random.Random(5).getrandbits(63)
    prints = [base, base ^ 0b111, base ^ 1 << 40 ^ 1 << 50 ^ 0b1000, base ^ 0b111 ^ 0b11 << 60, base ^ (1 << 63) - 1]
    nodes = spark.createDataFrame([(p, p, s, s) for p in prints for s in range(30)], "node bigint, fp bigint, s0 bigint, s1 bigint")
    roots = {r["node"]: r["root"] for r in components(simhash.near_links(nodes, 3, bucket=bucket)).collect()}
    assert set(roots) == set(prints[:4]) and len(set(roots.values())) == 1


def test_components_of_a_path_a_star_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    rows = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    by_root = defaultdict(set)
    for r in rows:
        by_root[r["root"]].add(r["node"])
    assert sorted(map(len, by_root.values())) == [30, 41]
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicate_stage_keeps_one_of_each_class(spark, docs):
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns
    assert len(ids) == len(set(ids)) and None in ids
    want = classes([(r["doc_id"], bits(r["text"])) for r in docs.select("doc_id", "text").collect()], 3)
    assert set(ids) - {None} == {d for d, c in want.items() if d is not None and d == c} and 5 in ids and 6 not in ids
    # Documents that only share a passage are no near-duplicates.
    assert {40, 41, 42, 43, 44, 45, 60, 61, 62} <= set(ids)


def test_stage_keeps_different_texts_of_one_id(spark):
    one, other, third = words(80, 1, 5000), words(90, 2, 5000), words(70, 3, 5000)
    rows = [(1, one), (1, other), (2, other), (3, one), (3, third), (1, one)]
    kept = corpus_pipeline.near_duplicate_stage(spark, frame(spark, documents(rows)), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, one), (1, other), (3, third)])


def test_top_k_equals_brute_force(spark):
    rnd = np.random.default_rng(5)
    vectors = rnd.normal(size=(300, 16)).round(2).tolist()
    vectors[7] = vectors[8] = vectors[9] = vectors[50]
    vectors[100] = [0.0] * 16
    rows = list(enumerate(vectors)) + [(1000, None), (1001, [1.0] * 15 + [float("nan")]), (1002, [None] + [1.0] * 15), (None, vectors[3]), (1050, [0.5, 1.0]), (50, vectors[50])]
    table = pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float64())), "score": ["x"] * len(rows), "block": ["y"] * len(rows)})
    whole = topk.whole_vectors(frame(spark, table)).distinct().cache()
    usable = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if i is not None and i < 1000 or i == 1050}
    want = []
    for q in [i for i in usable if i % 50 == 0]:
        scores = sorted((-int(v @ usable[q]), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:5], 1)]
    for block in (topk.BLOCK, 40):
        got = topk.top_k(whole, whole.filter("vec_id % 50 = 0"), block=block)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(whole.limit(0), whole.limit(0)).count() == 0


def test_threshold_stops_early_and_is_exact():
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(40, 4)) * 400
    rows = np.floor(np.concatenate([centres + rnd.normal(size=(40, 4)) for _ in range(50)])).astype(np.int64)
    lists = topk.SortedLists(np.arange(len(rows)), rows)
    depths = []
    for q in range(0, len(rows), 97):
        ids, scores, depth = lists.best(rows[q], q, 5)
        order = sorted((-int(v), i) for i, v in enumerate(rows @ rows[q]) if i != q)[:5]
        assert list(zip((-scores).tolist(), ids.tolist())) == order
        depths.append(depth)
    assert min(depths) < len(rows) // 4


def pages_table(rows: list[tuple]) -> pa.Table:
    return pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": pa.array([r[1] for r in rows], pa.string()), "html": pa.array([r[2] for r in rows], pa.string()), "digest": ["x"] * len(rows), "first": ["y"] * len(rows)})


PAGES = [(i, f"http://e.org/{i}", f"<p>{words(30, i % 20)}</p>") for i in range(60)] + [
    (70, None, None), (71, "http://e.org/a b\r\nc", ""), (72, "", "é\r\n\r\nWARC/1.1\r\n"), (73, "http://e.org", "x" * 200_000), (None, "http://e.org/n", "only without an id"), (None, None, f"<p>{words(30, 3)}</p>"), (5, "http://e.org/5", f"<p>{words(30, 5)}</p>"), (10**15, "http://far.org", "far"),
]


def test_archives_come_back(spark, tmp_path):
    pages = frame(spark, pages_table(PAGES))
    for least in (0, 100):
        folder = f"file://{tmp_path}/{least}"
        manifest = warc.write_warc(pages, folder, least_revisit=least, shard_bytes=20_000, file_bytes=3_000)
        rows = warc.read_warc(manifest, folder).collect()
        first = {}
        for i, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0])):
            first.setdefault(html or "", i)
        want = []
        for i, _, html in PAGES:
            payload = (html or "").encode()
            again = first[html or ""] != i and len(payload) >= least
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            want.append((i or -1, len(payload), digest, "revisit" if again else "response", first[html or ""] if again else -1))
        assert sorted((-1 if r[0] is None else r[0] or -1, r[2], r[3], r[4], -1 if r[5] is None else r[5]) for r in rows) == sorted(want)
        assert all(hashlib.sha1(r["payload"]).digest() == base64.b32decode(r["payload_digest"]) for r in rows if r["record_type"] == "response")
        assert manifest.count() > 4 and manifest.agg({"records": "sum"}).first()[0] == len(PAGES)


def test_the_same_pages_make_the_same_files(spark, tmp_path):
    pages = frame(spark, pages_table(PAGES))
    made = []
    for i, parts in enumerate((3, 1)):
        warc.write_warc(pages.repartition(parts), f"file://{tmp_path}/{i}", shard_bytes=20_000, file_bytes=3_000)
        files = sorted((tmp_path / str(i)).glob("*.warc.gz"))
        made.append([(f.name, hashlib.sha256(f.read_bytes()).hexdigest()) for f in files])
        assert zlib.decompress(files[0].read_bytes(), 31).startswith(b"WARC/1.1\r\n")
    assert made[0] == made[1]
    assert warc.read_warc(warc.write_warc(pages.limit(0), f"file://{tmp_path}/none"), f"file://{tmp_path}/none").count() == 0


def test_a_damaged_archive_is_refused():
    data = warc.record(1, "http://e.org", b"payload")
    assert warc.parse(data)[1].endswith(b"payload")
    with pytest.raises(ValueError, match="does not match"):
        warc.parse(data.replace(b"payload", b"pay1oad"))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records_of(iter([warc.member(data)[:-9]])))
