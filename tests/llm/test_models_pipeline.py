"""Quality classifier, language model and pipeline: held-out accuracy, brute force, odd rows."""

import collections
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from edge import documents, frame, odd_rows, words

import __spark_entry__ as entry
import corpus_pipeline
from setscope.llm import hmm, quality
from setscope.llm.quality import OTHER
from setscope.llm.queries import piece_model

GOOD = "the of and river stone window garden morning letter carries over under bright quiet small".split()
RUDE = "grumbold snarvic peltrow".split()


def labelled(n: int, seed: int) -> tuple[list[tuple], list[tuple]]:
    """Documents of three kinds and their labels: good, shouted, rude."""
    rnd, rows, labels = random.Random(seed), [], []
    for i in range(n):
        text = [rnd.choice(GOOD) + str(rnd.randrange(30)) for _ in range(rnd.randrange(30, 120))]
        kind = rnd.choice(("good", "good", "poor", "rude"))
        if kind == "rude":
            text[rnd.randrange(len(text))] = rnd.choice(RUDE)
        joined = " ".join(text)
        rows.append((seed * 10_000 + i, joined.upper().replace(" ", "!! ") if kind == "poor" else joined))
        labels.append((seed * 10_000 + i, int(kind != "poor"), int(kind == "rude")))
    return rows, labels


def label_table(rows: list[tuple]) -> pa.Table:
    return pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(("doc_id", "quality", "toxic"))} | {"text": ["clash"] * len(rows)})


@pytest.fixture(scope="module")
def known():
    return labelled(900, 1)


def test_classifier_on_held_out_documents(spark, known):
    rows, labels = known
    more, truth = labelled(300, 2)
    odd_labels = [(1, None, 0), (2, 1, None), (None, 1, 1), (labels[0][0], 1, 0)]
    docs = frame(spark, documents(rows + more + odd_rows()))
    model = quality.train(docs, frame(spark, label_table(labels + odd_labels)))
    scored = quality.score(docs, model)
    assert scored.count() == len(rows) + len(more) + len(odd_rows())
    got = {r["doc_id"]: r for r in scored.select("doc_id", "p_good", "p_toxic", "accepted").collect()}
    wrong = sum(got[d]["accepted"] != bool(q and not t) for d, q, t in truth)
    assert wrong <= 6
    again = {r["doc_id"]: r["p_good"] for r in quality.score(docs.repartition(3), model).select("doc_id", "p_good").collect()}
    assert all(abs(again[d] - r["p_good"]) < 1e-12 for d, r in got.items())


def test_views_hand_over_what_they_know(spark):
    """Where sources tell the classes apart, both views teach, all unlabelled documents take part, and the shares grow."""
    rows, labels = labelled(1200, 5)
    table = documents(rows).to_pydict()
    poor = {d for d, q, _ in labels if not q}
    table["source"] = ["dump" if d in poor else "press" for d in table["doc_id"]]
    docs = frame(spark, pa.table(table))
    model, features, handed = quality.learn(docs, frame(spark, label_table(labels[:900])))
    by = {(r["round"], r["view"]): r["yes"] + r["no"] for r in handed if r["head"] == "good"}
    assert all(by[t, v] > 0 for t in (1, 2, 3) for v in ("text", "meta")) and by[1, "text"] < by[2, "text"] < by[3, "text"]
    assert features.count() == 1200 and by[3, "text"] <= 300
    got = {r["doc_id"]: r for r in quality.classify(docs, frame(spark, label_table(labels[:900]))).collect()}
    assert sum(got[d]["accepted"] != bool(q and not t) for d, q, t in labels[900:]) <= 10
    # The same numbers, whatever the partitions, and from the other way of scoring.
    again = {r["doc_id"]: r["p_good"] for r in quality.classify(docs.repartition(3), frame(spark, label_table(labels[:900]))).collect()}
    scored = {r["doc_id"]: r["p_good"] for r in quality.score(docs, model).select("doc_id", "p_good").collect()}
    assert all(abs(again[d] - r["p_good"]) < 1e-9 and abs(scored[d] - r["p_good"]) < 1e-9 for d, r in got.items())


def test_a_round_equals_brute_force(spark, monkeypatch):
    """One round in one place: the surest unlabelled rows by sorting, the other view refitted to labelled rows and these."""
    monkeypatch.setattr(quality, "ROUNDS", 1)
    monkeypatch.setattr(quality, "STEPS", 40)
    rows, labels = labelled(1300, 6)
    docs, known = frame(spark, documents(rows)), {d for d, _, _ in labels[:900]}
    start, lessons = quality.fit([
        {"text": t, "lang": r["lang"], "source": r["source"], "n_chars": r["n_chars"], "good": g, "toxic": x}
        for (d, t), r, (_, g, x) in zip(rows, docs.collect(), labels) if d in known
    ])
    table = quality.feature_table(docs, start).filter(f"doc_id not in ({','.join(map(str, known))})")
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in table.collect()], schema=table.toArrow().schema)
    x, head = quality.view_rows(batch, start)["good"], start.heads["good"]
    want = {}
    for view, other in (("text", "meta"), ("meta", "text")):
        logits, lesson = getattr(head, view).logits(x[view]), lessons["good"]
        bins = np.round(logits / quality.BIN).astype(int)
        due, prior = quality.HANDED * len(bins), lesson.prior()
        aside = np.round(getattr(head, view).logits(lesson.aside[view]) / quality.BIN).astype(int)
        top = max(b for b in range(-700, 701) if (bins >= b).sum() >= due * prior)
        bottom = min(b for b in range(-700, 701) if (bins <= b).sum() >= due * (1 - prior))
        if bottom >= top or not quality._teaches(aside, lesson.y_aside, top, bottom):
            top, bottom = 10**6, -(10**6)
        at = np.flatnonzero((bins >= top) | (bins <= bottom))
        m = quality.Logistic()
        m.mean, m.scale, m.weight = getattr(head, other).mean, getattr(head, other).scale, np.zeros(len(getattr(head, other).weight))
        xs = np.vstack([lesson.fit[other], x[other][at]])
        ys, importance = np.concatenate([lesson.y_fit, bins[at] >= top]), np.concatenate([np.ones(len(lesson.y_fit)), np.full(len(at), quality.PSEUDO_WEIGHT)])
        for _ in range(40):
            m = m.stepped(m.sums(xs, ys, importance))
        want[other] = m.weight, len(at)
    handed = quality.co_train(start, lessons, quality.materialise(table, "pool"))
    assert {OTHER[r["view"]]: r["yes"] + r["no"] for r in handed if r["head"] == "good"} == {v: n for v, (_, n) in want.items()}
    assert want["meta"][1] > 0
    assert all(np.allclose(getattr(start.heads["good"], v).weight, w, atol=1e-3) for v, (w, _) in want.items())


def test_classifier_without_labels_or_rows(spark, known):
    docs = frame(spark, documents(known[0][:20]))
    none = frame(spark, label_table(known[1])).limit(0)
    assert quality.score(docs, quality.train(docs, none)).filter("accepted").count() == 20
    one_kind = frame(spark, label_table([(d, 1, 0) for d, _, _ in known[1][:20]]))
    assert quality.score(docs, quality.train(docs, one_kind)).filter("accepted").count() == 20
    assert quality.score(docs.limit(0), quality.train(docs, none)).count() == 0


def test_scores_equal_plain_recursion(spark):
    rows = odd_rows() + [(100 + i, words(120, 900 + i, 60)) for i in range(40)] + [(200 + i, "der die das " * (i + 5)) for i in range(10)]
    docs = frame(spark, documents(rows))
    corpus = hmm.read_corpus(docs, head=30)
    model = hmm.train(corpus, states=3, rounds=2)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and math.isclose(model.start.sum(), 1)
    split = [(d, zlib.crc32((str(d) if d is not None else "").encode()) % 10 == 0, [*(t or "").encode().lower().split(), None]) for d, t in rows]
    counts = collections.Counter(w for _, out, ws in split if not out for w in ws)
    n, v = sum(counts.values()), len(counts)
    symbol = {w: i + hmm.FIRST_WORD for i, (w, _) in enumerate(corpus.head)} | {None: hmm.END}
    rest = sum(c for w, c in counts.items() if w not in symbol)
    kinds = sum(w not in symbol for w in counts)
    want = []
    for doc, out, ws in split:
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        alpha, total = None, 0.0
        for w in ws:
            alpha = (model.start if alpha is None else alpha @ model.move) * model.emit[symbol.get(w, hmm.TAIL)]
            total += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
            if w not in symbol:
                total += math.log10((counts[w] + 0.1) / (rest + 0.1 * (kinds + 1)))
        want.append((doc if doc is not None else -1, out, len(ws), sum(counts[w] > 0 for w in ws), n, base, total))
    got = [(r[0] if r[0] is not None else -1, *r[1:]) for r in map(tuple, hmm.score(corpus, model).collect())]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9)


def test_expected_counts_equal_all_paths():
    rnd = np.random.default_rng(3)
    model = hmm.Model(*(x / x.sum(axis=-1, keepdims=True) for x in (rnd.random(2), rnd.random((2, 2)))), (e := rnd.random((4, 2))) / e.sum(axis=0))
    sequences = [[0, 3, 1, 2], [2], [1, 1, 0]]
    start, moves, emissions = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    logs = []
    for s in sequences:
        paths = {}
        for code in range(2 ** len(s)):
            path = [code >> i & 1 for i in range(len(s))]
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= model.move[a, b] * model.emit[x, b]
            paths[tuple(path)] = p
        whole = sum(paths.values())
        logs.append(math.log(whole))
        for path, p in paths.items():
            start[path[0]] += p / whole
            for x, k in zip(s, path):
                emissions[x, k] += p / whole
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / whole
    ids, starts = np.concatenate(sequences), np.array([0, 4, 5, 8])
    assert np.allclose(hmm.forward(model, ids, starts), logs)
    for got, want in zip(hmm.expected_counts(model, ids, starts), (start, moves, emissions), strict=True):
        assert np.allclose(got, want, atol=1e-6)


def test_scores_without_training_documents_or_rows(spark):
    held_out = [d for d in range(200) if zlib.crc32(str(d).encode()) % 10 == 0][:3]
    rows = hmm.score_documents(frame(spark, documents([(d, "a b a") for d in held_out]))).collect()
    assert [(r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows] == [(True, 4, 0, 0)] * 3
    assert all(math.isclose(r["base_score"], 0.0) and math.isfinite(r["score"]) for r in rows)
    assert hmm.score_documents(frame(spark, documents([(1, "a")])).limit(0)).count() == 0


def test_training_improves_on_the_plain_model(spark):
    rows = [(i, words(80, i, 50) if i % 2 else " ".join(f"k{w}" for w in words(80, i, 50).split())) for i in range(200)]
    found = hmm.score_documents(frame(spark, documents(rows))).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert found["sum(score)"] > found["sum(base_score)"]


@pytest.fixture(scope="module")
def folder(spark, known, tmp_path_factory):
    """The tables of a small run: labelled documents, odd rows, copies, a leak, a secret."""
    path = tmp_path_factory.mktemp("tables")
    item = words(30, 70)
    good = words(200, 60, 4000)
    more = [(500, good), (501, good), (502, good.replace(" w", " w", 1) + " tail"), (503, words(90, 61, 4000) + " " + item), (504, words(120, 62, 4000) + ' password = "hunter22secret"')]
    import pyarrow.parquet as pq

    pq.write_table(documents(known[0] + odd_rows() + more).select(["doc_id", "text", "lang", "source", "n_chars"]), path / "documents.parquet")
    pq.write_table(label_table(known[1] + [(500, 1, 0), (503, 1, 0), (504, 1, 0)]), path / "labels.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [item]}), path / "benchmark.parquet")
    return str(path)


def test_every_stage_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(corpus_pipeline.materialise(stage(spark, kept[-1], folder), "stage"))
    sizes = [k.count() for k in kept]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] == sizes[-3]
    assert all(k.columns == docs.columns for k in kept[:-1])
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    truth = {d: q and not t for d, q, t in labelled(900, 1)[1]}
    rejected = set(truth) - ids[1]
    assert sum(truth[d] for d in rejected) <= 5 and sum(not truth[d] for d in set(truth) & ids[1]) <= 12
    assert {500, 503, 504} <= ids[2] and not {501, 502} & ids[2]
    assert ids[2] - ids[3] == {503}
    redacted = kept[4].filter("doc_id = 504").first()
    assert redacted["text"].endswith('[SECRET]"') and redacted["n_chars"] == len(redacted["text"])
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    want = {(r["doc_id"], hashlib.sha256(",".join(map(str, library.encode(r["text"] or ""))).encode()).hexdigest()) for r in kept[4].collect()}
    assert {(r["doc_id"], r["ids_sha256"]) for r in kept[5].collect()} == want
    assert corpus_pipeline.run(spark, folder).count() == sizes[-1]


def test_stages_give_other_columns_back(spark, folder):
    """Whatever other columns are called, a stage that keeps a document keeps them, and no secret gets into them."""
    table = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    ids = [None if d != d else int(d) for d in table["doc_id"].tolist()]
    docs = frame(spark, documents(list(zip(ids, table["text"].tolist()))))
    names = [c for c in docs.columns if c not in ("text", "n_chars")]
    before = Counter(tuple(r) for r in docs.select(*names).collect())
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema == docs.schema
        rows = out.collect()
        assert not Counter(tuple(r[c] for c in names) for r in rows) - before
    assert not any("hunter22secret" in str(v) for r in rows for v in r if r["doc_id"] == 504)


def test_stages_of_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), "empty")
        assert docs.count() == 0


def test_every_operator_has_a_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5
