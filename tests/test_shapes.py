"""Labels, baskets, stored results, served sets and batches."""

import hashlib
import json
import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from setscope.functions import labels as L
from setscope.functions.tables import new_path
from setscope.operators import baskets as B
from setscope.operators import graph as G
from setscope.operators import layout as Y
from setscope.operators import sequences as S
from setscope.operators import stats as N
from setscope.plans import batch, serve
from setscope.sources import readers as R
from setscope.sources import results as T

TRACKS = [
    (1, 0.9, {"Cmaj": 0.5, "C7": 0.3, "Gmin": 0.04, "Amin7": None}, ["Cmaj", "C7", "Gmin"]),
    (2, 0.6, {"Cmaj": 0.05, "Gmin7": 0.95}, ["Gmin7"]),
    (3, 0.2, {"Dbmaj7": 1.0}, []),
]


@pytest.fixture(scope="module")
def tracks(spark):
    rows = [(i, c, m, [(x,) for x in s]) for i, c, m, s in TRACKS]
    return spark.createDataFrame(rows, R.TRACKS)


@pytest.fixture(scope="module")
def meta(spark):
    rows = [
        ("1", "A &amp; B &amp; C", "X", "i", "a", ((["rock", "pop"], ["calm"]),)),
        ("2", "B", "Y", "i", "a", ((["pop"], []),)),
        ("oops", "C", "Z", "i", "a", ((["pop"], []),)),
    ]
    return spark.createDataFrame(rows, R.METADATA)


def test_labels(spark):
    assert len(L.default_labels()) == 60 and len(L.default_labels(True)) == 24
    assert L.default_labels()[:6] == ["Cmaj", "Cmaj7", "Cmin", "Cmin7", "C7", "Dbmaj"]
    roots = L.default_order(spark).select(L.root_of(F.col("node")).alias("r"), "pos").orderBy("pos").collect()
    assert [r.r for r in roots[::5]] == list(L.ROOTS)
    parents = {r.item: r.parent for r in L.chord_roll_up(spark).collect()}
    assert parents["Db7"] == "Dbmaj" and parents["Amin7"] == "Amin" and len(parents) == 60
    assert set(parents.values()) == set(L.default_labels(True))


def test_default_order_has_one_run_per_root(spark):
    runs = Y.root_runs(L.default_order(spark), L.root_of(F.col("node"))).orderBy("first").collect()
    assert [(r.root, r.first, r["last"]) for r in runs] == [(n, 5 * i, 5 * i + 4) for i, n in enumerate(L.ROOTS)]


def test_basket_filters(spark, tracks):
    items = {r._1 if hasattr(r, "_1") else r["_id"]: r["items"] for r in B.basket_items(tracks, 0.05).collect()}
    assert items == {1: ["C7", "Cmaj"], 2: ["Gmin7"], 3: ["Dbmaj7"]}
    assert B.basket_items(tracks, None).filter("_id = 1").first()["items"] == ["C7", "Cmaj", "Gmin"]
    rolled = {r["_id"]: r["items"] for r in B.basket_rollup(tracks, 0.05, L.chord_roll_up(spark)).collect()}
    assert rolled == {1: ["Cmaj"], 2: ["Gmin"], 3: ["Dbmaj"]}
    in_row = B.basket_items(tracks, 0.05).select("_id", B.roll_up_expr(F.col("items"), L.chord_parents()).alias("items"))
    assert {r["_id"]: r["items"] for r in in_row.collect()} == rolled
    assert B.basket_rollup(tracks, 2.0, L.chord_roll_up(spark)).filter(F.size("items") == 0).count() == 3


def test_confidence_is_strict_and_optional(tracks):
    assert B.filter_confidence(tracks, 0.6).count() == 1
    assert B.filter_confidence(tracks, None).count() == 3
    assert B.filter_confidence(tracks, 0.0).count() == 3


def test_sequences(spark, tracks):
    shaped = {r["_id"]: r["sequence"] for r in B.sequence_shape(tracks).collect()}
    assert shaped[1] == [["Cmaj"], ["C7"], ["Gmin"]] and shaped[3] == []
    rolled = B.sequence_rollup(B.sequence_shape(tracks), L.chord_parents()).filter("_id = 1").first()["sequence"]
    assert rolled == [["Cmaj"], ["Cmaj"], ["Gmin"]]


def test_long_sequences_equal_prefixspan(spark):
    data = ["abcab", "acb", "bca", "aab", "cc", "abc", "bbbbb"]
    arrays = spark.createDataFrame([(i, [[c] for c in s]) for i, s in enumerate(data)], "id long, sequence array<array<string>>")
    events = spark.createDataFrame([(i, p, c) for i, s in enumerate(data) for p, c in enumerate(s)], "id long, pos int, label string")
    want = {tuple(x[0] for x in r.sequence): r.freq for r in S.frequent_sequences(arrays, min_support=0.25, max_pattern_length=4).collect()}
    long = S.frequent_sequences_long(events, id_cols=["id"], order_cols=["pos"], min_support=0.25, max_pattern_length=4)
    assert {tuple(r.sequence): r.freq for r in long.collect()} == want and max(map(len, want)) >= 3


def brute_sequences(data, floor, longest):
    found = {}
    for k in range(1, longest + 1):
        for pattern in {p + (x,) for p in (found if k > 1 else {(): 0}) if len(p) == k - 1 for x in {c for s in data for c in s if c}}:
            n = 0
            for s in data:
                rest = iter(s)
                n += all(x in rest for x in pattern)
            if n >= floor:
                found[pattern] = n
    return found


@pytest.mark.parametrize(("slots", "bound"), [("8", 200_000), ("50", 0)])
def test_long_sequences_across_ranges_equal_brute_force(spark, monkeypatch, slots, bound):
    """One sequence holds most events, so it lies in many ranges; ids, labels and order columns have nulls and clashing names."""
    rnd = random.Random(3)
    data = [[rnd.choice("abcd") for _ in range(rnd.randrange(1, 11))] for _ in range(30)]
    data += [[rnd.choice("aabbbce") for _ in range(600)], ["a", None, "b", None, "c"], [None], ["e"] * 40 + ["d"] * 3]
    rows = [(None if i == 5 else i // 2, i % 2, p // 3, p, c, c) for i, s in enumerate(data) for p, c in enumerate(s)]
    rnd.shuffle(rows)
    events = spark.createDataFrame(rows, "pos int, next int, t int, range int, label string, last string")
    monkeypatch.setattr(S, "BROADCAST_KEYS", bound)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slots)
    try:
        found = S.frequent_sequences_long(
            events, id_cols=["pos", "next"], order_cols=["t", "range"], label_col="last", min_support=0.08, max_pattern_length=5,
        ).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {tuple(r.sequence): r.freq for r in found} == brute_sequences(data, 3, 5)
    assert {r.n for r in found} == {len(data)} and max(r.k for r in found) >= 4


def test_metadata(spark, meta, tracks):
    assert [r["_id"] for r in B.normal_ids(meta).collect()] == [1, 2, None]
    assert B.tags_all_of(meta, "genres", "rock,pop").count() == 1
    joined = B.join_meta(B.basket_items(tracks, 0.05), meta, "genres", "pop")
    assert sorted(r["_id"] for r in joined.collect()) == [1, 2]
    found = serve.track_table(serve.search_tracks(meta, tracks, seed="s", tag_vals="rock", items=["Cmaj"])).collect()
    assert [(r.name, r.tags, r.labels) for r in found] == [("A & B &amp; C", "Rock, Pop", ["Cmaj", "C7", "Gmin"])]
    assert found[0].relative == [1.0, 0.3 / 0.5, 0.04 / 0.5]
    everyone = serve.search_tracks(B.normal_ids(meta).filter("_id is not null"), tracks, seed="s").collect()
    assert {r["_id"]: r.labels[0] for r in everyone} == {1: "Cmaj", 2: "Gmin7"}


def test_by_tag_counts_every_track_once_for_the_whole(spark, tracks, meta):
    rows = batch.frequent_by_tag(
        tracks, meta, tag_name="genres", tags=["pop", "rock"], roll_up=L.chord_parents(), min_support=0.01, confidence=None
    ).collect()
    n = {(r.tag, r.rollup): r.n for r in rows}
    assert n == {(None, False): 3, (None, True): 3, ("pop", False): 2, ("pop", True): 2, ("rock", False): 1, ("rock", True): 1}
    assert {r.run_id for r in rows if r.tag == "rock"} == {"0001-0.01-0.05-None-Falsef", "0001-0.01-0.05-None-Truef"}
    assert {r.run_id for r in rows if r.tag is None} == {"0002-0.01-0.05-None-Falsef", "0002-0.01-0.05-None-Truef"}


def test_result_versions(spark):
    def rows(run, value):
        return spark.createDataFrame(
            [(run, "genres", "pop", ["a"], 1, 2, value, 4, "frequent", False), (run, "genres", "pop", ["b"], 1, 2, value, 4, "frequent", False)],
            "run_id string, tag_name string, tag string, itemset array<string>, k int, freq long, value double, n long, fi_type string, rollup boolean",
        )

    def headers(*runs):
        return spark.createDataFrame(
            [(run, "genres", "pop", 0.01, None, 0.6, 4, "frequent", False) for run in runs],
            "run_id string, tag_name string, tag string, minimum double, ratio double, confidence double, n long, fi_type string, rollup boolean",
        )

    path, target = new_path(spark, "test"), new_path(spark, "test")
    T.write_results(headers("r1", "r2", "r3"), rows("r1", 0.1).unionByName(rows("r2", 0.2)).unionByName(rows("r3", 0.3)), path, 0)
    T.write_results(headers("r1", "r3"), rows("r1", 0.9).filter("itemset[0] = 'a'"), path, 1)
    want = [("r1", "a", 0.9), ("r2", "a", 0.2), ("r2", "b", 0.2)]
    assert sorted((r.run_id, r.itemset[0], r.value) for r in T.read_results(spark, path).collect()) == want
    T.compact(spark, path, target)
    assert sorted((r.run_id, r.itemset[0], r.value) for r in T.read_results(spark, target).collect()) == want
    assert sorted(r.run_id for r in T.read_headers(spark, target).collect()) == ["r1", "r2", "r3"]
    with_room = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = T.read_results(spark, path).filter("fi_type = 'hui' and not rollup")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", with_room)
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    # The scan that finds the newest versions is pruned by what the other side's filter leaves.
    assert all("fi_type" in s.split("PartitionFilters: [")[1].split("]")[0] for s in scans)
    assert sum("= hui)" in s for s in scans) >= 2


def test_served_sets_force_roll_up_off_for_utility(spark):
    rows = [
        ("genres", "pop", ["a"], 0.5, "frequent", False), ("genres", "pop", ["A"], 0.6, "frequent", True),
        ("genres", "pop", ["a"], 0.7, "hui", False), (None, None, ["a"], 0.8, "frequent", False),
        ("moods", "pop", ["a"], 0.9, "frequent", False),
    ]
    data = spark.createDataFrame(rows, "tag_name string, tag string, itemset array<string>, value double, fi_type string, rollup boolean")
    assert [r.value for r in serve.served_sets(data, tag_vals="pop,jazz").collect()] == [0.5]
    assert [r.value for r in serve.served_sets(data, tag_vals="pop", rollup=True).collect()] == [0.6]
    assert [r.value for r in serve.served_sets(data, tag_vals="pop", fi_type="hui", rollup=True).collect()] == [0.7]
    assert [r.value for r in serve.served_sets(data).collect()] == [0.8]
    assert serve.served_sets(data, tag_vals="none").count() == 0


def test_id_batches_and_pages(spark):
    ids = list(range(7)) + [70_000, 70_001, 10**9, 10**9 + 1, 10**9 + 2]
    got = R.id_batches(spark.createDataFrame([(i,) for i in ids], "_id long"), size=5).orderBy("batch").collect()
    assert [r.ids for r in got] == [" ".join(map(str, ids[i : i + 5])) for i in range(0, len(ids), 5)]
    pages = spark.createDataFrame([([("7", "n", "a", "i", "u", ((["x"], ["y"]),))],)], R.PAGES)
    row = R.ingest_meta(pages).first()
    assert row["_id"] == "7" and row.musicinfo.tags.genres == ["x"]


def test_readers_round_trip(spark, tracks, meta):
    for fmt in ("parquet", "json", "orc"):
        path = new_path(spark, "tracks")
        tracks.write.format(fmt).save(path)
        assert R.load_tracks(spark, path, fmt).filter("confidence > 0.5").count() == 2
    path = new_path(spark, "meta")
    meta.write.parquet(path)
    assert R.load_metadata(spark, path).count() == 3


def test_pages_sent_again_add_nothing(spark, tmp_path):
    def page(name, ids):
        results = [{"id": str(i), "name": f"n{i}", "artist_name": "a", "image": "i", "audio": "u", "musicinfo": {"tags": {"genres": ["x"], "vartags": []}}} for i in ids]
        return {"results": results} | ({"page": name} if name else {})

    folder, lines, table = tmp_path / "pages", tmp_path / "lines", str(tmp_path / "table")
    folder.mkdir()
    for i, ids in enumerate(([1, 2], [3], [], [4, 5])):
        (folder / f"p{i}.json").write_text(json.dumps(page(None, ids), indent=1))
    lines.write_text("\n".join(json.dumps(page(name, ids)) for name, ids in (("a", [6]), ("p1.json", [3]), ("b", [7, 8]))))
    files, more = R.load_pages(spark, str(folder)), R.load_pages(spark, str(lines), multi_line=False)
    assert sorted(r.page for r in files.collect()) == [f"p{i}.json" for i in range(4)]
    ids = lambda df: sorted(int(r["_id"]) for r in df.collect())
    assert ids(R.ingest_pages(files.filter("page < 'p2'"), table)) == [1, 2, 3]
    assert ids(R.ingest_pages(files, table)) == [1, 2, 3, 4, 5]
    assert ids(R.ingest_pages(files.unionByName(more).unionByName(more), table)) == list(range(1, 9))
    # A run that breaks off after some of its files: a page is there as a whole or not at all, and the rest comes with the next run.
    for file in sorted((tmp_path / "table").glob("*.parquet"))[:1]:
        lost = {r.page for r in spark.read.parquet(str(file)).collect()}
        file.unlink()
    left = R.load_ingested(spark, table)
    assert lost and not lost & {r.page for r in left.collect()}
    assert ids(R.ingest_pages(files.unionByName(more), table)) == list(range(1, 9))
    with pytest.raises(Exception, match="without a name"):
        R.ingest_pages(files.withColumn("page", F.lit(None).cast("string")), table)


def test_draws_reach_every_edge(spark, monkeypatch):
    rows = [("g", i, f"n{i % 7}", f"n{i % 11}") for i in range(40)] + [("h", 1, "a", "b")]
    data = spark.createDataFrame(rows, "graph_id string, edge_id long, u string, v string")
    got = G.bootstrap_edges(data.unionByName(data), [30, 41, 60], seed="s").collect()
    assert {(r.graph_id, r.n) for r in got} == {("g", 30), ("g", 41)} and len(got) == 71
    index = {e: (u, v) for g, e, u, v in rows if g == "g"}
    for r in got:
        ix = int(hashlib.md5(f"s|g|{r.n}|{r.draw}".encode()).hexdigest()[:15], 16) % 40
        assert r.edge_id == ix and (r.u, r.v) == index[ix]
    everything = G.bootstrap_edges(data, [30, 60], seed="s", skip_larger=False)
    assert everything.count() == 180 and {r.edge_id for r in everything.filter("graph_id = 'h'").collect()} == {1}


def test_utility_batch_of_known_tracks(spark, tracks, meta):
    """Tracks without metadata count unless only known ones are asked for."""
    shares = batch.share_transactions(tracks, ratio=0.05, confidence=None)
    values = spark.createDataFrame([(c, 1) for c in ("Cmaj", "C7", "Gmin7", "Dbmaj7")], "item string, eutil int")
    known = meta.filter("_id != '3'")
    found = {
        flag: batch.high_utility_by_tag(
            tracks, shares, values, known, tag_name="genres", tags=["pop"], min_util=0.1, confidence=None, known_only=flag
        ).filter("tag is null").collect()
        for flag in (False, True)
    }
    assert {r.n for r in found[False]} == {3} and {r.n for r in found[True]} == {2}
    assert "Dbmaj7" in {x for r in found[False] for x in r.itemset} and "Dbmaj7" not in {x for r in found[True] for x in r.itemset}


def spline(end, near, far, n=4000):
    """Length of a uniform Catmull-Rom piece by a fine polyline, with Richardson's correction."""
    p, q, r = (np.array(v, float) for v in (end, near, far))
    c1, c2 = p + (q - p) / 6, q - (r - p) / 6

    def polyline(k):
        t = np.linspace(0, 1, k + 1)[:, None]
        path = (1 - t) ** 3 * p + 3 * (1 - t) ** 2 * t * c1 + 3 * (1 - t) * t**2 * c2 + t**3 * q
        return np.sqrt((np.diff(path, axis=0) ** 2).sum(1)).sum()

    return polyline(n) + (polyline(n) - polyline(n // 2)) / 3


def golden(f, a, b):
    g = (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > 1e-9:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def test_ratios_make_curves_shortest(spark):
    rnd = random.Random(2)
    places = {f"n{i}": (rnd.uniform(-300, 300), rnd.uniform(-300, 300)) for i in range(14)}
    pairs = [(i % 2, f"n{rnd.randrange(7)}", f"n{7 + rnd.randrange(7)}") for i in range(16)]
    nodes = spark.createDataFrame([(n, x, y) for n, (x, y) in places.items()], "node string, x double, y double")
    links = spark.createDataFrame(pairs, "cluster int, a string, b string")
    got = {r.cluster: (r.r_left, r.r_right) for r in Y.bundle_ratio_search(links, nodes).collect()}
    curve = spark.range(1).select(Y.curve_length(*[(F.lit(x), F.lit(y)) for x, y in ((3.0, 4.0), (-50.0, 80.0), (200.0, -10.0))])).first()[0]
    assert abs(curve - spline((3, 4), (-50, 80), (200, -10), 40_000)) < 1e-4
    for k in (0, 1):
        mine = [(places[a], places[b]) for c, a, b in pairs if c == k]
        left, right = np.mean([a for a, _ in mine], axis=0), np.mean([b for _, b in mine], axis=0)

        def length(p, q):
            return sum(spline(a, p, q, 400) + spline(b, q, p, 400) for a, b in mine) + math.dist(p, q)

        r_left = golden(lambda r: length(left + r * (right - left), right), 0, 0.5)
        p = left + r_left * (right - left)
        r_right = golden(lambda r: length(p, right + r * (left - right)), 0, 0.5)
        assert abs(got[k][0] - r_left) < 2e-5 and abs(got[k][1] - r_right) < 2e-5


@pytest.mark.parametrize(("heavy", "above"), [(1_000, None), (4, None), (1, None), (12, 6), (1_000, 6)])
def test_cooccurrence_of_wide_rows(spark, monkeypatch, heavy, above):
    """Some rows hold very many tags, some tags are in nearly every row; nulls, repeated tags and equal rows are there too."""
    monkeypatch.setattr(N, "MATRIX_ROWS", 7)
    rnd = random.Random(heavy)
    rows = [[f"h{k}" for k in range(6) if rnd.random() < 0.7] + [f"l{rnd.randrange(60)}" for _ in range(rnd.randrange(4))] for _ in range(120)]
    rows += [[f"l{k}" for k in range(60)], [f"h{k % 6}" for k in range(30)], [None, "h1", "h1", "l3"], [], ["l1"], None] + [["h0", "h1", "Ü"]] * 9
    data = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "_id int, t array<string>")
    # Popularity is by entries, so repeated tags of a row count.
    popular = {x for x, n in Counter(x for t in rows for x in t or []).items() if above is None or n > above}
    want = Counter(p for t in rows for p in combinations(sorted(({*(t or [])} - {None}) & popular), 2))
    got = N.tag_cooccurrence(data, F.col("t"), above=above, heavy_tags=heavy).collect()
    assert {(r.a, r.b): r.weight for r in got} == want and len(got) == len(want)
