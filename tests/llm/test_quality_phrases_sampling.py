"""Weak supervision, collocations and importance resampling beside brute force, on odd rows and on the test tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from edge import documents, frame, odd_rows, words
from oracle import connect, difference, spark_rows, sql_rows

from setscope.llm import importance, phrases, weak_rules
from setscope.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def key(row) -> tuple:
    return tuple((v is not None, v) for v in row)


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def junk(i: int) -> str:
    rnd = random.Random(i)
    base = words(60, 900 + i).split()
    return (
        " | ".join(base),
        " ".join(f"{w}{rnd.choice('#$%&') * 3}" for w in base),
        " ".join(base[:3] * 30),
        " ".join(w.upper() + "!!" for w in base),
    )[i % 4]


@pytest.fixture(scope="module")
def docs(spark):
    prose = [(100 + i, ".\n".join(words(12, 100 * i + k).capitalize() for k in range(8)) + ".") for i in range(40)]
    repeats = [(200, "a b c d e\n" * 4), (201, "a b c d e f a b c d e"), (202, "x\nx\n \n \nx"), (203, "one two #$ <|>")]
    return frame(spark, documents(odd_rows() + prose + repeats + [(300 + i, junk(i)) for i in range(12)])).cache()


# Quality rules


def base_row(text: str | None) -> tuple:
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {i + k for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_base_traits_equal_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = sorted(((d, *base_row(t)) for d, t in rows), key=key)
    found = weak_rules.rule_summary(docs).collect()
    got = sorted((tuple(r)[:7] for r in found), key=key)
    assert got == want
    assert all(r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5) for r in found)


@pytest.mark.parametrize("window", [1, 2, 3, 5, 6, 8])
def test_windows_found_twice(window):
    rnd = random.Random(window)
    for n in (0, 1, window, window + 1, 40, 200):
        ids = [rnd.randrange(3) for _ in range(n)]
        seen = Counter(tuple(ids[i : i + window]) for i in range(n - window + 1))
        want = {i + k for i in range(n - window + 1) if seen[tuple(ids[i : i + window])] > 1 for k in range(window)}
        assert weak_rules.repeated_words(np.array(ids, dtype=np.int64), window) == len(want)


def test_fit_equals_expectation_maximisation_by_document():
    """The same rounds, one document after the other, in plain numbers."""
    rnd = random.Random(4)
    rules, rows = 4, []
    for _ in range(300):
        good = rnd.random() < 0.7
        rows.append(([rnd.choice((0, *(2 * ((1,) if good else (2,))), 2 if good else 1)) for _ in range(rules)], not good and rnd.random() < 0.5))
    prior, rate = weak_rules.PRIOR_GOOD, {(c, j, v): (0.85 if (v == 1) == (c == 1) else 0.15) for c in (0, 1) for j in range(rules) for v in (1, 2)}
    belief = dict(rate)
    for _ in range(60):
        weights = []
        for votes, failed in rows:
            p = [1 - prior, prior]
            for j, v in enumerate(votes):
                for c in (0, 1):
                    p[c] *= rate[c, j, v] if v else 1
            weights.append(0.0 if failed else p[1] / (p[0] + p[1]))
        counts = {x: 20 * belief[x] for x in rate}
        for (votes, _), g in zip(rows, weights):
            for j, v in enumerate(votes):
                if v:
                    counts[0, j, v] += 1 - g
                    counts[1, j, v] += g
        for j in range(rules):
            for right, v in ((1, 1), (0, 2)):
                lacking = max(0.8 * (counts[0, j, v] + counts[1, j, v]) - counts[right, j, v], 0)
                counts[right, j, v] += lacking
                counts[1 - right, j, v] -= lacking
        rate = {(c, j, v): counts[c, j, v] / (counts[c, j, 1] + counts[c, j, 2]) for c, j, v in rate}
        prior = (sum(weights) + 20 * weak_rules.PRIOR_GOOD) / (len(rows) + 20)
    seen = Counter((sum(v * 3**j for j, v in enumerate(votes)), failed) for votes, failed in rows)
    pattern, failed, n = (np.array(x) for x in zip(*[(p, f, k) for (p, f), k in seen.items()]))
    model = weak_rules.expectation_maximisation(pattern, n.astype(float), failed, rules)
    assert math.isclose(model.prior, prior, abs_tol=1e-6)
    assert all(abs(model.rates[c, j, v - 1] - r) < 1e-6 for (c, j, v), r in rate.items())
    assert (model.accuracy() >= 0.5).all()


def test_verdicts_without_labels_agree_with_labels(spark, docs):
    tables = [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]
    found = weak_rules.rule_scores(tables[0]).join(tables[1], "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in found}
    assert n[1, True] >= 0.98 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0))


def test_verdicts_of_odd_rows(spark, docs):
    rows = {r["doc_id"]: r for r in weak_rules.rule_scores(docs).collect()}
    assert all(rows[100 + i]["kept"] for i in range(40))
    assert not any(rows[i]["kept"] for i in (1, 2, 3, 4, 11, 12, 200))
    assert weak_rules.rule_scores(docs.limit(0)).count() == 0


# Collocations


def brute_phrases(rows: list[tuple], least: int, top: int) -> list[tuple]:
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, 6) for i in range(len(ws) - k + 1))
    kept = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in kept.items():
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(
            lang == other and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (other, q), b in kept.items()
        )
        if not inside:
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks, found = Counter(), []
    for lang, *rest in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            found.append((lang, ranks[lang], *rest))
    return found


def phrase_rows(spark):
    rnd = random.Random(9)
    stock = ["of the", "in spite of", "as well as the", "e a b c d", "Ünder ßo", "same"]
    rows = []
    for i in range(300):
        parts = [rnd.choice(stock) if rnd.random() < 0.5 else f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(1, 40))]
        marks = "".join(rnd.choice(("", "", ",", "\n", " ", "\t")) + " " + p for p in parts)
        rows.append((i, marks.title() if i % 9 == 0 else marks))
    rows += [(400 + i, " ".join(stock * 40)) for i in range(5)] * 2
    return frame(spark, documents(odd_rows() + rows))


@pytest.mark.parametrize(("known", "group", "spacing"), [(10**6, 1 << 21, 16), (0, 1 << 21, 3), (10**6, 200, 1), (2, 64, 5)])
def test_phrases_equal_brute_force(spark, monkeypatch, known, group, spacing):
    monkeypatch.setattr(phrases, "GROUP", group)
    docs = phrase_rows(spark)
    want = brute_phrases([(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()], 20, 50)
    got = phrases.collocations(docs, least=20, top=50, known=known, spacing=spacing).collect()
    assert sorted(map(tuple, got)) == sorted(want) and {"und", "en", "de"} == {w[0] for w in want}


def test_chunks_of_a_repeat_are_shared(spark):
    passage = words(4000, 8)
    rows = [(i, f"{words(50, 40 + i)} {passage} {words(50, 60 + i)}") for i in range(6)]
    docs = frame(spark, documents(rows)).select("text").selectExpr("text", "'en' as lang")
    found = phrases.chunk_dictionary(docs)
    total = found.selectExpr("sum(freq)", "count(*)").first()
    assert found.filter("freq = 6").count() > 0.8 * total[1] and total[0] > 4 * total[1]


def test_phrases_of_an_empty_table_and_without_candidates(spark):
    docs = phrase_rows(spark)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs, least=10**6).count() == 0
    assert phrases.collocations(docs.filter("text is null")).count() == 0


def test_phrases_equal_their_sql(spark):
    got = spark_rows(QUERIES["op12_collocations"](spark, SF_DIR.replace("0.001", "0.01")))
    assert difference(got, sql_rows(connect(SF_DIR.replace("0.001", "0.01")), ORACLES["op12_collocations"])) is None and got[1]


# Importance resampling


def brute_sample(docs: list[tuple], target: list[str | None], percent: int) -> list[tuple]:
    def features(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        return len(ws), [zlib.crc32(" ".join(ws[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(ws) - k + 1)]

    found = [(d, *features(text)) for d, text in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for text in target for b in features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for d, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], key((r[0],))))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, rows), key=key)


@pytest.mark.parametrize(("size", "block"), [(1 << 17, 1 << 22), (7, 1 << 22), (0, 1 << 22), (50, 64)])
def test_sample_equals_brute_force(spark, docs, monkeypatch, size, block):
    monkeypatch.setattr(importance, "BLOCK", block)
    monkeypatch.setattr(importance, "GROUP", 5000)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    target = [words(50, 3), None, "", "x | " + "long" * 400, words(30, 4)]
    found = importance.resample(docs, frame(spark, pa.table({"item_id": range(5), "text": pa.array(target, pa.string())})), percent=30, size=size)
    assert sorted(map(tuple, found.collect()), key=key) == brute_sample(rows, target, 30)


def test_checksums_of_runs():
    rnd = random.Random(2)
    ws = [bytes(rnd.randrange(33, 127) for _ in range(n)) for n in (1, 2, 63, 64, 65, 5, 200, 3, 70_000, 9, 1)]
    crc, size = np.array([zlib.crc32(w) for w in ws], dtype=np.uint32), np.array([len(w) for w in ws])
    for k, run in enumerate(importance.Checksums().runs(crc, size, 5), 1):
        assert run.tolist() == [zlib.crc32(b" ".join(ws[i : i + k])) for i in range(len(ws) - k + 1)]


def test_sample_of_empty_tables(spark, docs):
    empty = frame(spark, pa.table({"text": pa.array([], pa.string())}))
    rows = importance.resample(docs, empty).collect()
    assert len(rows) == docs.count()
    assert importance.resample(docs.limit(0), empty).count() == 0
    assert {r["rank"] for r in importance.resample(docs.filter("text is null"), empty).collect()} == {None}
