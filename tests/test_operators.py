import random
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fotarium.functions import scalars as S
from fotarium.functions import vectors as V
from fotarium.operators import compare, logs, measure, names, order
from fotarium.sources import reports


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("v")).first()["v"]


def brute_sets(items, gap, look, most=40):
    out, run = [], []
    for it in items:
        if run and it[0] - run[-1][0] <= gap and abs(it[2] - run[-1][2]) <= look and len(run) < most:
            run.append(it)
        else:
            out.append(run)
            run = [it]
    return [[i for _, i, _ in r] for r in [*out, run] if len(r) > 1]


def test_sequences_link_to_the_item_before_and_are_cut(spark):
    rnd = random.Random(1)
    items = [(t * 20, i, rnd.random() / (1 if i % 50 == 0 else 50)) for i, t in enumerate(range(300))] + [(10_000 + i, 1000 + i, 0.0) for i in range(45)]
    df = spark.createDataFrame([("g", *x) for x in items], "g string, at bigint, id bigint, look double")
    got = order.sequences(df, "g", ["at", "id"], ["at", "look"], (F.col("at") - F.col("before_at") <= 60) & (F.abs(F.col("look") - F.col("before_look")) <= 0.5)).collect()
    sets = {}
    for r in sorted(got, key=lambda r: (r["at"], r["id"])):
        sets.setdefault(r["set_id"], []).append(r["id"])
    assert list(sets.values()) == brute_sets(items, 60, 0.5) and list(sets) == list(range(1, len(sets) + 1))
    assert order.sequences(df.limit(0), "g", ["at", "id"], ["at"], F.lit(True)).collect() == []


def test_camera_order(spark):
    paths = ["x/100LEICA/M1103127.DNG", "x/099LEICA/M1.DNG", "x/100LEICA/L1002773.DNG", "x/zoo.dng", "x/101LEICA/M1100001.DNG"]
    df = spark.createDataFrame([("g", p) for p in paths], "g string, path string")
    got = [r["path"] for r in order.camera_order(df, "g", "path").orderBy(*order.CAMERA_KEYS, "path").collect()]
    assert got == [paths[2], paths[0], paths[4], paths[1], paths[3]]
    for path, want in [("100LEICA/M1103127.DNG", (100, 3127)), ("/a/099LEICA/M1.DNG", (0, -1)), ("DSC01234.ARW", (0, 1234)), ("M110276.DNG", (0, -1)), ("M-102767.DNG", (0, -1))]:
        assert (one(spark, S.dcf_folder(F.col("p")), p=path), one(spark, S.dcf_counter(F.col("p")), p=path)) == want


@pytest.mark.parametrize(("n", "keep", "chunks", "final"), [(8, 3, 1, 8), (9, 3, 2, 4), (16, 3, 2, 4), (40, 3, 5, 1), (40, 5, 5, 1), (40, 8, 5, 2)])
def test_chunks(spark, n, keep, chunks, final):
    df = spark.range(n).select(*[c.alias(a) for c, a in zip(order.chunk_of(F.col("id"), F.lit(n)), ("chunk", "chunks"), strict=True)])
    rows = df.withColumn("f", order.finalists(F.col("chunks"), F.lit(keep))).collect()
    assert {r["chunks"] for r in rows} == {chunks} and {r["f"] for r in rows} == {final}
    assert [r["chunk"] for r in rows] == [next(i for i in range(chunks) if p < (i + 1) * n // chunks) for p in range(n)]


def test_log_folds(spark):
    log = spark.createDataFrame([(1, "d", "a", "keep", 0, None), (2, "d", "a", "cull", 3, 1.0), (3, "d", "b", "keep", 0, None), (4, "d", "b", "", 0, None), (5, None, "c", "keep", None, 0.0)], "log_id bigint, dir string, file string, label string, stars int, ev double")
    got = {(r["dir"], r["file"]): (r["label"], r["stars"]) for r in logs.label_fold(log).collect()}
    assert got == {("d", "a"): ("cull", 3), (None, "c"): ("keep", None)}
    assert logs.fold_first(log, ["file"], "log_id").count() == 3


def test_label_file(spark, tmp_path):
    path = tmp_path / "labels.jsonl"
    path.write_text('{"file":"a","label":"keep"}\n\n{"file":"b","stars":3}\n{"file":"torn"')
    assert [(r["log_id"], r["file"]) for r in reports.label_lines(spark, str(path)).collect()] == [(1, "a"), (3, "b")]
    path.write_text('{"file":"a"}\nnonsense\n{"file":"b"}\n')
    with pytest.raises(Exception, match="line 2"):
        reports.label_lines(spark, str(path)).collect()
    path.write_text('{"name":"a","size":1}\nnonsense\n{"size":2}\n{"name":"b"}')
    assert [(r["entry_id"], r["name"]) for r in reports.manifest_lines(spark, str(path), "name string, size bigint").collect()] == [(1, "a"), (4, "b")]


def test_first_object(spark):
    df = spark.createDataFrame([('x {"a": "}\\"{", "b": {}} {"c":1}',), ("{open",), (None,)], "t string")
    assert [r["o"] for r in reports.with_first_object(df, "t", "o").collect()] == ['{"a": "}\\"{", "b": {}}', None, None]


def test_listing(spark, tmp_path):
    for p in ("a/L1.DNG", "a/.hidden.dng", "keep/L2.dng", ".x/L3.dng", "a/note.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    assert [r["path"].rsplit("/", 1)[1] for r in reports.listing(spark, str(tmp_path)).collect()] == ["L1.DNG"]


def test_keywords_as_published(spark):
    raw = ["Portrait", "", "  forest ", "FOREST", "cull:keep", "a|b", "red dress", " ".join("abcdefghijklmn"), "x", "y", "z", "w", "v", "u", "t", "s", "q" * 31]
    assert one(spark, S.keywords(F.col("w")), w=raw) == ["portrait", "forest", "red dress", "x", "y", "z", "w", "v"]


def test_look_distance_bounds(spark):
    side = 8
    plane = [float((x * 31 + y * 17) % 97) for y in range(side) for x in range(side)]
    shifted = [plane[y * side + min(side - 1, x + 1)] for y in range(side) for x in range(side)]
    rows = spark.createDataFrame([(plane, shifted, [1.0])], "a array<double>, b array<double>, c array<double>")
    d = rows.select(V.look_distance(F.col("a"), F.col("a")).alias("same"), V.look_distance(F.col("a"), F.col("b")).alias("shift"), V.look_distance(F.col("a"), F.col("c")).alias("bad")).first()
    assert d["same"] == 0 and d["shift"] < 1e-9 and d["bad"] == 1

    def brute(a, b):
        best = 1.0
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                c = sorted(abs(a[y * 8 + x] - b[(y + dy) * 8 + x + dx]) for y in range(8) for x in range(8) if 0 <= x + dx < 8 and 0 <= y + dy < 8)
                k = -(-len(c) // 4)
                best = min(best, sum(c[-k:]) / k)
        return best

    rnd = random.Random(3)
    for _ in range(3):
        a, b = [[rnd.random() for _ in range(64)] for _ in range(2)]
        assert one(spark, V.look_distance(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(brute(a, b), abs=1e-12)


@pytest.mark.parametrize(("dark", "bright", "contrast", "want"), [(98.0, 0.0, 9.0, "black"), (97.99, 0.0, 9.0, None), (0.0, 95.0, 9.0, "white"), (0.0, 94.99, 9.0, None), (0.0, 0.0, 2.99, "uniform"), (0.0, 0.0, 3.0, None), (99.0, 0.0, 0.5, "black")])
def test_junk_thresholds(spark, dark, bright, contrast, want):
    assert one(spark, measure.junk_kind(F.col("d"), F.col("b"), F.col("c")), d=dark, b=bright, c=contrast) == want


def test_patterns_and_names(spark):
    made = one(spark, S.expand("{date}-{n:4}-{orig}", F.lit("2025-01-02"), F.lit("x"), F.lit("L1"), F.col("n")), n=12345)
    assert made == "2025-01-02-12345-L1"
    assert one(spark, S.round_half_away(F.col("x"), 2), x=0.285) == 0.28
    df = spark.createDataFrame([("g", "a"), ("g", "A.b")], "g string, stem string")
    files = spark.createDataFrame([("g", "a.b.dng"), ("g", "ab.dng"), ("g", "nodot"), ("h", "a.x")], "g string, name string")
    assert sorted((r["stem"], r["name"]) for r in names.stem_conflicts(df, files, "g", "stem", "name").collect()) == [("a", "a.b.dng"), ("a.b", "a.b.dng")]


def test_near_match_and_median(spark):
    a = spark.createDataFrame([(1, "k", 0), (2, "k", 5_000_000), (3, None, 0)], "i int, k string, t bigint")
    b = spark.createDataFrame([(7, "k", 2_000_000), (8, "k", 2_000_001)], "j int, k string, u bigint")
    assert sorted((r["i"], r["j"]) for r in logs.near_match(a, b, ["k"], "t", "u", 2_000_000).collect()) == [(1, 7)]
    values = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4)] + [("h", 5)] * 7, "k string, v int")
    assert sorted(tuple(r) for r in order.upper_median(values, ["k"], "v").collect()) == [("g", 4, 3), ("h", 7, 5)]


def test_confusion_as_published(spark):
    rows = [("keep", "keep"), ("keep", "cull"), ("cull", "keep"), ("review", "review"), ("other", "keep"), (None, "keep")]
    m = compare.confusion(spark.createDataFrame(rows, "l string, d string"), "l", "d")
    r = compare.rates(m).first()
    assert (r["n"], r["false_cull"], r["missed_cull"], r["review_share"]) == (4, 0.5, 1.0, 0.25)


def test_verify_and_resume(spark):
    a = spark.createDataFrame([("x", 1, "d"), ("y", 1, "d"), ("z", 1, "d"), ("w", 1, "d")], "k string, size int, h string")
    b = spark.createDataFrame([("x", 1, "d"), ("y", 2, "d"), ("z", 1, "e"), ("v", 1, "d")], "k string, size int, h string")
    assert {r["k"]: r["state"] for r in logs.verify(a, b, ["k"], "size", "h").collect()} == {"x": "same", "y": "size", "z": "digest", "w": "missing", "v": "unrecorded"}
    assert {r["k"]: r["state"] for r in logs.resume(b, a, "k", ["size"], F.col("h") == "d").collect()} == {"x": "carried", "y": "redo", "z": "carried", "v": "new", "w": "gone"}


def test_broken_clock(spark):
    t = int(datetime(2025, 1, 1).timestamp()) * 1_000_000
    rows = [("bad", i, t + i) for i in range(11)] + [("good", i, t + i * 1_000_000) for i in range(11)] + [("few", i, t) for i in range(5)]
    got = {r["k"]: r["broken"] for r in order.broken_clocks(spark.createDataFrame(rows, "k string, i int, t bigint"), "k", "t", "i").collect()}
    assert got == {"bad": True, "good": False, "few": False}


def test_stored_orders_are_carried(spark):
    members = spark.createDataFrame([("d", 1, f, p, r) for f, p, r in (("a", 0, False), ("b", 1, True), ("c", 2, True))] + [("d", 2, "x", 0, True), ("d", 3, "q", 0, True)], "k string, set_id int, file string, pos int, rankable boolean")
    stored = spark.createDataFrame([("d", 1, ["a", "x"]), ("d", 2, ["c", "b", "gone"])], "k string, stored_id int, order array<string>")
    got = {r["set_id"]: (r["order"], r["covers"]) for r in order.carry_order(members, stored, ["k"]).collect()}
    assert got == {1: (["c", "b"], True), 2: (["x"], True)}


def test_merged_chunks(spark):
    chunks, final = [[2, 0, 3, 1], [5, 7, 4, 6]], [5, 2, 7, 0]
    rows = [("s", f, c, i, final.index(f) if f in final else None) for c, ch in enumerate(chunks) for i, f in enumerate(ch)]
    df = order.merge_orders(spark.createDataFrame(rows, "k string, f int, chunk int, chunk_rank int, final_rank int"), ["k"])
    assert [r["f"] for r in df.orderBy("rank").collect()] == [5, 2, 7, 0, 3, 4, 1, 6]


def test_set_difference_and_faces(spark):
    a = spark.createDataFrame([("k", 1, 1), ("k", 1, 2), ("k", 2, 3)], "k string, s int, m int")
    b = spark.createDataFrame([("k", 9, 2), ("k", 9, 1), ("k", 8, 4)], "k string, s int, m int")
    assert sorted((r["side"], r["members"]) for r in order.set_difference(a, b, ["k"], "s", "m").collect()) == [("first", [3]), ("second", [4])]
    faces = spark.createDataFrame([([(10.0, 1.0), (6.0, 5.0), (4.0, 9.0)],), ([],)], "f array<struct<q:double,area:double>>")
    assert [r["b"] and r["b"]["area"] for r in faces.select(measure.best_face(F.col("f")).alias("b")).collect()] == [5.0, None]
    assert one(spark, order.disputed(F.col("a"), F.col("b"), 3), a=3, b=4) is True
