"""Operators on small hand-made tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspar.functions import labels as L
from larkspar.functions import names as N
from larkspar.operators import captures, claims, clusters, layout, merge, neighbours, order, scope, timeline
from larkspar.operators.components import components
from larkspar.sources import readers, sinks
from larkspar.streaming import incremental


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in rows.select("i", expression(F.col("x"))).orderBy("i").collect()]


def test_label_strings(spark):
    texts = ["dm-大麻雀-great-tailed bird(95%)", " a-b-C d (7%) ", "bird", "no confidence-x-y", "", None, "a-b-c(x%)"]
    got = column(spark, texts, L.parse_label)
    assert [(r.english, r.confidence) if r else None for r in got] == [("great-tailed bird", 0.95), None, None, None, None, None, None] or got[1].english == "c d"
    assert got[0].native == "大麻雀" and got[2:] == [None] * 5


def test_percent_rounds_halves_to_even(spark):
    assert column(spark, [0.945, 0.125, 0.135, 1.0], L.percent, "double") == [94, 12, 14, 100]


def test_frames_and_trips(spark):
    stems = ["_D8S7785", "_D8S7785-2", "20181229-_D8S7785", "20181229-_D8S7785-2", "20190113-_D8S0025_host_123_Conflict", "holiday-snap", "IMG", "_D8S025"]
    got = column(spark, stems, N.frame_identity)
    assert [(r.code, r.num) if r else None for r in got] == [("D8S", "7785")] * 4 + [("D8S", "0025"), None, None, None]
    assert list(map(str, column(spark, ["2019-05-01 lake", "2019-05", "2019-13", "0000-test", "湖 2019-05-01"], N.trip_date))) == ["2019-05-01", "2019-05-01", "None", "None", "None"]
    assert column(spark, ["a-Enhanced-NR", "a-Pano-2", "a-HDR", "a-2"], N.sidecar_stem) == ["a", "a", "a", "a-2"]
    assert column(spark, ["2019-05-01 10:11:12.50+08:00", " 2019-05-01T10:11:12Z", " x "], N.normalise_datetime) == ["2019-05-01T10:11:12"] * 2 + ["x"]


def test_trip_dates_begin_a_name(spark):
    names = ["2023-10-055", "2023-101", "2023-10x", "2023-10-5", "2023-10-32"]
    assert list(map(str, column(spark, names, N.trip_date))) == ["2023-10-05", "2023-10-01", "2023-10-01", "2023-10-01", "None"]
    assert column(spark, names, N.trip_precision) == ["day", "month", "month", "month", None]


def test_labels_are_trimmed_in_all_parts(spark):
    got = column(spark, [" xs - 小隼 - Merlin (90%)", "a-b-C(5%)"], L.parse_label)
    assert [(r.initials, r.native, r.english, r.confidence) for r in got] == [("xs", "小隼", "merlin", 0.9), ("a", "b", "c", 0.05)]


def test_scope_keeps_to_segments_and_excludes_win(spark):
    rows = spark.createDataFrame([(k,) for k in ("Photos-2/a", "Photos-24/a", "Photos-2", "Photos-2/b/c", "x")], "key string")
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    pick = lambda i, e: sorted(r.key for r in scope.in_scope(rows, "key", paths(*i), paths(*e)).collect())
    assert pick(["Photos-2/"], []) == ["Photos-2", "Photos-2/a", "Photos-2/b/c"]
    assert pick([], ["Photos-2\\b"]) == ["Photos-2", "Photos-2/a", "Photos-24/a", "x"]
    assert pick(["Photos-2", "x"], ["x", "Photos-2/a"]) == ["Photos-2", "Photos-2/b/c"]


def tree(spark, *stems):
    return spark.createDataFrame([tuple(s.rsplit("/", 1)) for s in stems], "folder string, stem string")


def test_claims_and_verdicts(spark):
    side = tree(spark, "f/a", "f/b", "f/c", "f/d", "g/e", "f/IMG-with-dashes")
    images = tree(spark, "f/a", "f/b-2", "f/b-2-3", "f/c-Enhanced-NR", "f/phone", "f/IMG-with-dashes-2", "h/z")
    got = {r.stem: (r.base, r.owns) for r in claims.own(images, side).collect()}
    assert got == {"a": ("a", True), "b-2": ("b", True), "b-2-3": ("b", False), "c-Enhanced-NR": ("c", True), "phone": (None, False), "IMG-with-dashes-2": ("IMG-with-dashes", True), "z": (None, False)}
    assert {r.stem: (r.verdict, r.n_images) for r in claims.resolve(images, side).collect()} == {"a": ("ok", 1), "b": ("derived", 2), "c": ("derived", 1), "d": ("no_jpg", 0), "e": ("no_folder", 0), "IMG-with-dashes": ("derived", 1)}
    assert {r.stem for r in claims.unreached(images, side).collect()} == {"d", "e"}
    assert [(r.base, r.keeper, r.exact_match_wins) for r in claims.multi_claims(images, side).collect()] == [("b", "b-2", False)]


def test_duplicates_and_misplaced(spark):
    rows = spark.createDataFrame([("c1", "t1", True, 1, 0), ("c1", "t1", False, 2, 9), ("c2", "t1", False, 3, 5), ("c2", "t2", False, 4, None), (None, "t1", False, 5, 0), ("c3", "t1", False, 6, 0)], "capture string, trip string, is_copy boolean, key long, days_off long")
    got = {r.key: (r.kind, r.role) for r in captures.duplicate_groups(rows).collect()}
    assert got == {1: ("virtual-copy", "duplicate"), 2: ("virtual-copy", "keep"), 3: ("cross-trip", "keep"), 4: ("cross-trip", "duplicate")}
    days = spark.createDataFrame([("a", 1, 9), ("a", 2, 9), ("a", 3, 0), ("b", 4, 9), ("b", 5, 0), ("b", 6, None)], "trip string, key long, days_off long").withColumn("captured", F.lit("2020-01-01").cast("date"))
    assert sorted((r.kind, r.trip, r.key) for r in captures.misplaced(days).collect()) == [("stray", "b", 4), ("trip", "a", None)]


def test_overlay_needs_equal_columns_and_unique_keys(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert {tuple(r) for r in merge.overlay(base, spark.createDataFrame([(2, None), (3, "c")], "k int, v string"), "k", ["v"]).collect()} == {(1, "a", "kept"), (2, None, "replaced"), (3, "c", "appended")}
    with pytest.raises(ValueError, match="columns"):
        merge.overlay(base, base.withColumnRenamed("v", "w"), "k", [])
    with pytest.raises(ValueError, match="stands 2 times"):
        merge.require_unique(base.union(base), "k")


def greedy_segments(trips):
    out, held, n = [], set(), 1
    for _, keys in sorted(trips.items()):
        if held & keys:
            held, n = set(), n + 1
        held |= keys
        out.append(n)
    return out


def test_segments_are_greedy(spark):
    r = random.Random(3)
    for seed in range(3):
        trips = {p: {f"k{r.randint(0, 40 + 40 * seed)}" for _ in range(r.randint(1, 8))} for p in range(40)}
        rows = [("g", p, k) for p, keys in trips.items() for k in keys] + [("h", 1, "x")]
        got = timeline.segments(timeline.conflicts(spark.createDataFrame(rows, "group string, pos long, key string")))
        assert [x.segment for x in got.filter("group = 'g'").orderBy("pos").collect()] == greedy_segments(trips)


def test_next_fit_packs_in_order(spark):
    r = random.Random(4)
    sizes = [r.choice([1, 5, 30, 60, 99, 100, 130, 200, 250]) for _ in range(50)]
    want, day, used = [], 0, 0
    for i, size in enumerate(sizes):
        if used and used + size > 100:
            day, used = day + 1, 0
        want.append((day + 1, used, "Red" if i % 2 == 0 else "Blue"))
        day, used = day + (used + size) // 100, (used + size) % 100
    got = layout.next_fit(spark.createDataFrame(list(enumerate(sizes, 1)), "position long, size long"), 100)
    assert [(x.bin, x.offset, x.colour) for x in got.orderBy("position").collect()] == want


@pytest.mark.parametrize("few", [0, 100_000])
def test_numbered_and_orbit(spark, monkeypatch, few):
    monkeypatch.setattr(order, "FEW_JUMPS", few)
    names = random.Random(1).sample(range(1000), 90)
    got = order.numbered(spark.createDataFrame([(n,) for n in names], "n long"), "place", "n").collect()
    assert sorted((r.place, r.n) for r in got) == list(enumerate(sorted(names), 1))
    jumps = spark.createDataFrame([("g", i, i * 2 % 37) for i in range(1, 37)], "group string, at long, next long")
    reached = {r.at for r in order.orbit(jumps, spark.createDataFrame([("g", 1)], "group string, at long")).collect()}
    assert reached == {pow(2, i, 37) for i in range(36)}


def blobs(k, per, dim=16, noise=0.05, seed=0):
    r = np.random.default_rng(seed)
    centres = np.linalg.qr(r.normal(size=(dim, dim)))[0][:k]
    v = np.concatenate([c + r.normal(0, noise, (per, dim)) for c in centres])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_density_clusters_find_blobs_and_noise(spark):
    v = blobs(3, 40)
    far = np.eye(16)[-4:] * np.array([[1], [-1], [1], [-1]])
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([v, far]))]
    got = {r.key: r.cluster_id for r in neighbours.density_clusters(spark.createDataFrame(rows, "key long, v array<double>"), 5, 0.4, 10).collect()}
    assert [{got[i] for i in range(40 * b, 40 * b + 40)} for b in range(3)] == [{0}, {40}, {80}]
    assert [got[120 + i] for i in range(4)] == [-1] * 4


def test_nearest_and_medoid_against_all_pairs(spark, monkeypatch):
    v = blobs(3, 15, seed=2)
    rows = [(i // 15, i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "cluster long, key long, v array<double>")
    monkeypatch.setattr(neighbours, "BLOCK", 10)
    monkeypatch.setattr(clusters, "BLOCK", 4)
    cos = v @ v.T - 9 * np.eye(len(v))
    assert {r.key: r.other for r in neighbours.nearest(df.select("key", "v")).collect()} == dict(enumerate(cos.argmax(1).tolist()))
    got = {r.cluster: r for r in clusters.report(df).collect()}
    for c in range(3):
        part = v[15 * c : 15 * c + 15]
        d = np.sqrt(np.maximum(0, 2 - 2 * part @ part.T)).sum(1)
        assert got[c].medoid == 15 * c + d.argmin() and abs(got[c].centroid_norm - np.linalg.norm(part.mean(0))) < 1e-5


def test_spectral_order_of_a_chain(spark):
    angles = {5: 0.1, 2: 0.5, 9: 0.9, 1: 1.3}
    rows = [(c, [math.cos(a), math.sin(a)]) for c, a in angles.items() for _ in range(3)]
    got = [r.cluster for r in layout.spectral_order(spark.createDataFrame(rows, "cluster long, v array<double>")).orderBy("place").collect()]
    assert got in ([5, 2, 9, 1], [1, 9, 2, 5])


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9)], "u long, v long")
    assert {tuple(r) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}


def test_extras_are_what_resolution_left(spark):
    found = lambda images, side: {(r.stem, r.kind, r.parent) for r in claims.extras(tree(spark, *images), tree(spark, *side)).collect()}
    assert found(["f/A-2"], ["f/A"]) == set()
    assert found(["f/a", "f/a-2", "f/phone"], ["f/a"]) == {("a-2", "derived", "a"), ("phone", "orphan", None)}
    assert found(["f/a-2", "f/a-3"], ["f/a", "f/a-2"]) == set()
    assert found(["f/a", "f/a-2-3"], ["f/a", "f/a-2"]) == set()
    assert found(["g/z"], ["f/a"]) == {("z", "orphan", None)}


def test_folders_below_a_root_whose_name_recurs(spark, tmp_path):
    root = tmp_path / "jpg" / "x" / "jpg"
    for at in ("T", "jpg/U", "."):
        (root / at).mkdir(parents=True, exist_ok=True)
        (root / at / "a.b.jpg").write_text("x")
    want = {("T", "a.b"), ("jpg/U", "a.b"), ("", "a.b")}
    assert {(r.folder, r.stem) for r in readers.tree(spark, str(root), "*.jpg").collect()} == want
    assert {(r.folder, r.stem) for r in readers.tree(spark, f"file://{root}/", "*.jpg").collect()} == want


def test_broken_sidecars_are_null_and_unlabelled_ones_empty(spark):
    wrap = lambda inside: f'<?xml version="1.0"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/"><!-- <dc:subject> --><r:RDF a="1" b=\'2\'>{inside}</r:RDF></x:xmpmeta>\n'
    li = lambda *t: "<dc:subject><r:Bag>" + "".join(f"<r:li>{x}</r:li>" for x in t) + "</r:Bag></dc:subject>"
    cases = {
        wrap(""): [], wrap(li()): [], wrap(li("bird", "a &amp; &lt;b&gt;")): ["bird", "a & <b>"], wrap(li("a") + "<q/>" + li("b")): ["a", "b"], wrap("<dc:subject><r:li/><r:li c='d'>e</r:li></dc:subject>"): ["", "e"],
        "<not xml": None, "": None, "text": None, "<a><subject><li>bird</li>": None, "<a></b>": None, "<a/><b/>": None, "<a>&x</a>": None, wrap("<q>"): None, wrap("</q>"): None, "<a b=c/>": None, None: None,
    }
    assert column(spark, list(cases), readers.subjects) == list(cases.values())


def test_names_in_long_lines_and_parts_of_a_vocabulary(spark, monkeypatch):
    from larkspar.operators import audit

    names = spark.createDataFrame([(n,) for n in ("snow goose", "goose x", "ab cd", "b c", "ü é", "snow goose")], "name string")
    texts = [(1, "A Snow Goose X\nnothing"), (2, "x" * 100_000 + " y" * 50_000 + " ab cd"), (3, None), (4, ""), (5, "Ü É")]
    rows = spark.createDataFrame(texts, "id long, text string")
    want = {(1, 1, "goose x"), (2, 1, "ab cd"), (5, 1, "ü é")}
    for size in (1_000_000, 4):
        monkeypatch.setattr(audit, "VOCABULARY_BYTES", size)
        found = audit.identifying(rows, "text", "id", names=names).filter("kind = 'species name'")
        assert {(r.id, r.line, r.found) for r in found.collect()} == want
    assert audit.identifying(rows, "text", "id", names=names.limit(0)).filter("kind = 'species name'").count() == 0


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "labels.csv").write_text('﻿jpg,category,note\na.jpg,bird,"two\nlines, ""quoted"""\n', encoding="utf-8")
    row = readers.label_table(spark, str(tmp_path / "labels.csv")).first()
    assert (row.jpg, row.note, row.label) == ("a.jpg", 'two\nlines, "quoted"', None)
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="jpg"):
        readers.label_table(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "v.jsonl").write_text('{"key": "a", "model": "m", "embedding": [1, 2]}\n\n{"key": "a", "model": "n"}\n{"key": "b", "mo')
    assert [(r.key, r.model) for r in readers.embeddings(spark, str(tmp_path / "v.jsonl")).collect()] == [("a", "n")]
    (tmp_path / "scope.txt").write_text("# all\nPhotos-19\\trip/  # one\n\n")
    assert [r.path for r in readers.manifest(spark, str(tmp_path / "scope.txt")).collect()] == ["Photos-19/trip"]
    (tmp_path / "empty.txt").write_text("# nothing\n")
    with pytest.raises(ValueError, match="no path"):
        readers.manifest(spark, str(tmp_path / "empty.txt"))
    folder = tmp_path / "xmp" / "Photos-19" / "trip"
    folder.mkdir(parents=True)
    (folder / "a-2.xmp").write_text('<x exif:DateTimeOriginal="2019-05-01T10:11:12.3+08:00"><dc:subject><rdf:Bag><rdf:li>bird</rdf:li><rdf:li>a &amp; b</rdf:li></rdf:Bag></dc:subject></x>')
    side = readers.sidecars(spark, str(tmp_path / "xmp")).select("folder", "stem", readers.subjects(F.col("text")).alias("s"), readers.capture_fields(F.col("text"))["captured"].alias("t")).first()
    assert tuple(side) == ("Photos-19/trip", "a-2", ["bird", "a & b"], "2019-05-01T10:11:12")
    assert [(r.folder, r.stem) for r in readers.tree(spark, str(tmp_path / "xmp"), "*.xmp").collect()] == [("Photos-19/trip", "a-2")]
    sinks.append(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "out"))
    sinks.append(spark.createDataFrame([(2,)], "a int"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError, match="columns"):
        sinks.append(spark.createDataFrame([(2,)], "b int"), str(tmp_path / "out"))


def test_incremental_runs_go_on(spark, tmp_path):
    def arrive(rows):
        spark.createDataFrame(rows, "k string, v long, x string").write.mode("append").parquet(f"{tmp_path}/in")
        return {tuple(r) for r in incremental.newest(spark, f"{tmp_path}/in", f"{tmp_path}/run", "k", "v").collect()}

    assert arrive([("a", 1, "p"), ("a", 2, "q")]) == {("a", 2, "q", 2)}
    assert arrive([("a", 0, "r"), ("b", 5, "s")]) == {("a", 2, "q", 3), ("b", 5, "s", 1)}


def test_runs_are_protected_and_know_their_vectors(spark, tmp_path):
    from larkspar.sources import runs

    root, rows = f"{tmp_path}/cluster", spark.range(2).toDF("key")
    with pytest.raises(FileNotFoundError):
        runs.resolve_runs(spark, root)
    run = f"{root}/mcs5"
    rows.write.parquet(f"{run}/half")
    runs.begin(spark, run)  # a partial run is cleared
    (tmp_path / "embed").mkdir()
    (tmp_path / "v.jsonl").write_text("")
    runs.finish(spark, run, rows, {"source": f"{tmp_path}/v.jsonl", "n": 2})
    with pytest.raises(runs.Finished):
        runs.begin(spark, run)
    rows.write.parquet(f"{root}/mcs15/assignments")
    assert [r.rsplit("/", 1)[1] for r in runs.resolve_runs(spark, root)] == ["mcs15", "mcs5"]
    assert runs.vectors_of(spark, run, "given") == "given" and runs.vectors_of(spark, run) == f"{tmp_path}/v.jsonl"
    with pytest.raises(FileNotFoundError):
        runs.vectors_of(spark, f"{root}/mcs15")
    (tmp_path / "embed" / "embeddings.jsonl").write_text("")
    assert runs.vectors_of(spark, f"{root}/mcs15") == f"{tmp_path}/embed/embeddings.jsonl"
    with pytest.raises(ValueError, match="not cleared"):
        runs.begin(spark, f"{tmp_path}/embed")
    runs.begin(spark, run, force=True)
    assert not (tmp_path / "cluster" / "mcs5").exists()


def test_vectors_in_the_order_of_keys(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text('{"key": "a", "embedding": [1]}\n{"key": "b", "embedding": [2]}\n{"key": "a", "embedding": [3]}\n')
    keys = lambda *k: spark.createDataFrame(list(enumerate(k)), "position int, key string")
    assert [(r.key, list(r.embedding)) for r in readers.vectors_for(spark, str(tmp_path / "v.jsonl"), keys("b", "a", "b")).orderBy("position").collect()] == [("b", [2.0]), ("a", [3.0]), ("b", [2.0])]
    with pytest.raises(ValueError, match="2 keys are not in .*, e.g. c"):
        readers.vectors_for(spark, str(tmp_path / "v.jsonl"), keys("d", "a", "c"))


def test_spreadsheets_begin_with_a_mark(spark, tmp_path):
    sinks.spreadsheet(spark.createDataFrame([("é", 1, "no")], "name string, n int, more string"), str(tmp_path / "s"), "name", "n")
    parts = [p.read_bytes() for p in (tmp_path / "s").glob("part-*.csv")]  # the first part may have a header alone
    assert all(p.startswith(b"\xef\xbb\xbfname,n\n") for p in parts)
    assert [line for p in parts for line in p.decode("utf-8-sig").splitlines()[1:]] == ["é,1"]


def test_focus_takes_an_id_before_a_name(spark):
    rows = spark.createDataFrame([(1, "owl", "a"), (2, "snow owl", "b"), (3, None, "c"), (31, "x 3", "d")], "cluster long, name string, key string")
    pick = lambda w: [r.key for r in scope.focused(rows, "cluster", "name", w).collect()]
    assert pick("3") == ["c"] and pick("snow") == ["b"]
    for bad in ("owl", "heron"):
        with pytest.raises(ValueError):
            pick(bad)


def test_paths_from_a_root_and_unreadable_trees(spark):
    assert column(spark, ["/a/b/c", "/a/bc", "/x", None], lambda c: N.display_path(c, "/a/b/")) == ["c", "/a/bc", "/x", None]
    left = spark.createDataFrame([("p", "<a>"), ("q", "<a/>"), ("r", "<b/>")], "path string, content string")
    right = spark.createDataFrame([("p", "<a/>"), ("q", "<a/>"), ("s", "")], "path string, content string")
    got = merge.compare_trees(left, right, readers.subjects(F.col("content")))
    assert {tuple(r) for r in got.collect()} == {("p", "unparseable"), ("q", "identical"), ("r", "not-in-reference")}
