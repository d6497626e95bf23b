"""Operators of plans, sinks, logs and planes against brute force and small cases."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotarium.functions import planes, shots
from fotarium.functions import vectors as V
from fotarium.operators import compare, logs, measure, names, order
from fotarium.sources import reports, sidecars


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_request_batches_equal_the_greedy_loop(spark):
    rnd = random.Random(5)
    items = [(f"r{i:04d}", rnd.choice([0, 3, 10, 10, 45, 120, None])) for i in range(700)]
    for limit, most, chunk in ((100, 9, 64), (100, 1000, 37), (5, 3, 700), (10**9, 10**6, 100)):
        want, size, n, no = {}, 0, 0, 0
        for k, s in items:
            s = s or 0
            if not no or n >= most or size + s > limit and n:
                no, size, n = no + 1, 0, 0
            size, n = size + s, n + 1
            want[k] = no
        df = spark.createDataFrame(items, "id string, size int")
        got = {r["id"]: r["batch_no"] for r in order.request_batches(df, ["id"], "size", limit, most, chunk).collect()}
        assert got == want
    assert order.request_batches(df.limit(0), ["id"], "size").collect() == []


def test_swapped_names_and_arrays(spark):
    moves = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "z"), (None, "q")], "old string, new string")
    df = spark.createDataFrame([("a", ["a", "x", "b", "a"]), ("b", []), ("c", None), (None, ["c", None])], "file string, members array<string>")
    assert sorted(r["file"] or "" for r in names.mapped(df, "file", moves).collect()) == ["", "a", "b", "z"]
    got = {r["file"]: r["members"] for r in names.mapped(df, "members", moves).collect()}
    assert got == {"a": ["b", "x", "a", "b"], "b": [], "c": None, None: ["z", None]}
    assert [r[0] for r in df.select(names.paths_mapped(F.col("file"), {"a": "b", "b": "a"})).collect()] == ["b", "a", "c", None]


def test_numbers_go_on_and_splits(spark):
    files = spark.createDataFrame([("d", "x1", False), ("d", "x2", True), ("d", "x3", None), ("e", "x4", False), (None, "x5", False)], "dir string, f string, skip boolean")
    taken = spark.createDataFrame([("d", "00007-a.DNG"), ("d", "9-b.dng"), ("d", "free.dng"), ("d", None)], "dir string, name string")
    got = rows(names.numbers_on(files, taken, "dir", ["f"], "name", r"^(\d+)-.+?\.[A-Za-z0-9]+$", F.col("skip")), "f", "n")
    assert got == [("x1", 10), ("x2", None), ("x3", 11), ("x4", 1), ("x5", 1)]
    starts = spark.createDataFrame([("d", "X1"), ("d", "x3")], "dir string, stem string")
    got = rows(names.split_at(files.filter("dir is not null"), "dir", ["f"], F.col("f"), starts), "f", "event_no")
    assert got == [("x1", 1), ("x2", 1), ("x3", 2), ("x4", 1)]
    with pytest.raises(ValueError, match="nine"):
        names.split_at(files, "dir", ["f"], F.col("f"), spark.createDataFrame([("d", "nine")], "dir string, stem string"))


def test_moves_that_nobody_told(spark):
    recorded = spark.createDataFrame([("/s/a", "/s/a", 1, 9), ("/s/b", "/s/b", 1, 9), ("/s/c", "/s/keep/c", 1, 9), ("/s/d", "/s/d", 1, 9), ("/s/e", "/s/e", 1, None)], "file string, at string, size bigint, mtime_us bigint")
    disk = spark.createDataFrame([("/s/a", 1, 9), ("/s/keep/b", 1, 9), ("/s/cull/b", 1, 9), ("/s/c", 1, 9), ("/s/review/d", 2, 9), ("/s/cull/e", 1, None)], "path string, size bigint, mtime_us bigint")
    assert rows(names.reconciled(recorded, disk), "file", "to") == [("/s/c", "/s/c"), ("/s/e", "/s/cull/e")]
    found = {r["path"]: r["found"] for r in logs.path_of(recorded.select(F.col("file").alias("path")), disk, "path").collect()}
    assert found == {"/s/a": "/s/a", "/s/b": "/s/keep/b", "/s/c": "/s/c", "/s/d": "/s/review/d", "/s/e": "/s/cull/e"}


def test_days_patterns_and_quotes(spark):
    df = spark.createDataFrame([("2025-01-02T3", "2024:01:01", "/s/2023-01-01-x"), (None, "0000:00:00 00:00:00", "/s/2023-01-01-x"), ("", "2024:01:01 10", "x"), ("bad", None, "2023-05-06"), (None, None, "/s/none")], "a string, b string, c string")
    assert [r[0] for r in df.select(names.capture_day(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["20250102", "20230101", "20240101", "20230506", None]
    assert [shots.pattern_problem(p) is None for p in ("{n}", "{date}-{orig}", "{n:4}x", "{date}", "a/{n}", "{date:3}{n}", "{x}{n}", ".{n}")] == [True] * 3 + [False] * 5
    one = spark.createDataFrame([("it's \"x\"\n", "a/b.c", "2025:09:14 2025-09-14T1 12025:09:14")], "a string, b string, c string")
    got = one.select(shots.quoted_shell(F.col("a")).alias("a"), shots.quoted_shell(F.col("b")).alias("b"), shots.quoted_script(F.col("a")).alias("s"), shots.redated(F.col("c"), "2025-09-14", "2024-01-31").alias("d")).first()
    assert (got["a"], got["b"], got["s"]) == ("'it'\\''s \"x\"\n'", "a/b.c", '"it\'s \\"x\\"\\n"')
    assert got["d"] == "2024:01:31 2024-01-31T1 12025:09:14"


def test_manifest_fold_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, None, 5, "d", "n1", None, "s"), (2, None, 5, "d", "n2", " ", "s2"), (3, "A", None, "d", "n3", "f", "s"), (4, "a", None, "d", "n4", "f4", "s")], "entry_id bigint, orig string, size bigint, dir string, name string, file_sha256 string, sha256 string")
    got = sorted((r["name"], r["first_id"], r["current_sha256"]) for r in logs.manifest_fold(df).collect())
    assert got == [("n2", 1, "s2"), ("n4", 3, "f4")]


def test_import_is_all_or_nothing(spark):
    frames = spark.createDataFrame([("d", "a"), ("d", "b")], "dir string, file string")
    good = spark.createDataFrame([("d", "a", "keep"), ("d", "a", "cull")], "dir string, file string, label string")
    assert logs.import_labels(good, frames, ["dir", "file"]).count() == 2
    with pytest.raises(ValueError, match="d/z"):
        logs.import_labels(good.union(spark.createDataFrame([("d", "z", "keep")], good.schema)), frames, ["dir", "file"])


def test_runs_with_repeated_names_are_an_error(spark):
    a = spark.createDataFrame([("x", "keep", "s", 1.0), ("y", "cull", "s", 2.0)], "k string, d string, s string, v double")
    assert compare.run_difference(a, a, ["k"], "d", "s", "v").first()["same"] == 2
    with pytest.raises(ValueError, match="x stands more than once in the second run"):
        compare.run_difference(a, a.union(a.limit(1)), ["k"], "d", "s", "v")


def test_calibration_of_nothing(spark):
    frames = spark.createDataFrame([], "d string, decision string, error string")
    labels = spark.createDataFrame([("a", "keep"), ("b", ""), ("c", None)], "d string, label string")
    got = compare.calibration(frames, labels, ["d"], F.lit(True), F.lit(False), F.col("d")).first()
    assert (got["n"], got["missing"], got["junk"], got["junk_keep_names"]) == (0, 1, 0, "")
    sets = spark.createDataFrame([("a", 2, 1, "keep"), ("a", 2, None, "keep"), ("a", 2, 2, "cull"), ("b", 1, 1, "cull"), ("c", 3, 1, "review"), ("c", 3, 2, "")], "s string, set_size int, rank int, label string")
    assert tuple(compare.set_statistics(sets, ["s"], 0).first()) == (2, 1, 2, 1, 2)


FRAME = "frame_id bigint, dir string, file string, moved_to string, error string, decision string, exif struct<date_time_original:string>, orientation int, best boolean, dates_set string, evaluation struct<exposure:struct<status:string,ev_adjust:double>,composition:struct<crop:struct<apply:boolean,left:double,top:double,right:double,bottom:double>>,keywords:array<string>>, tags struct<project:string,event:string,location:string,keywords:array<string>>"


def test_sidecars_with_crop_dates_and_tags(spark):
    e = (("fixable", 0.333), ((True, 0.1, 0.2, 0.9, 0.8),), ["Rope", "rope", None])
    frames = spark.createDataFrame(
        [
            (1, "d", "d/a.DNG", None, None, "keep", ("2025:09:14 16:14:54",), 6, True, "2025-01-02T03:04:05.5", e, ("P&Q", "", None, ["rope", "t"])), (2, "d", "d/b.DNG", None, None, "cull", ("2025:02:30 10:00:00",), 1, False, None, e, None),
            (3, "d", "d/c.DNG", None, None, None, None, None, None, "bad", None, None), (4, "d", "d/e.DNG", "x/e.DNG", "broken", "keep", None, 1, None, None, None, None),
        ],
        FRAME,
    )
    labels = spark.createDataFrame([("d", "b.DNG", "", 3, -0.5), ("d", "c.DNG", "review", 0, None)], "dir string, file string, label string, stars int, ev double")
    side = sidecars.columns(logs.effective(frames, labels), develop=True)
    got = {r["frame_id"]: r for r in side.collect()}
    assert got[1]["subjects"] == ["cull:keep", "cull:best", "rope", "P&Q", "t"] and got[1]["hierarchy"] == ["content|rope", "project|P&Q"]
    assert got[1]["taken"] == "2025-01-02T03:04:05" and got[1]["exposure"] == 0.333
    assert [round(x, 6) for x in got[1]["crop"]] == [0.2, 0.1, 0.8, 0.9]
    assert (got[2]["exposure"], got[2]["crop"], got[2]["rating"], got[2]["taken"]) == (-0.5, None, 3, None)
    assert got[3]["subjects"] == ["cull:review", "cull:labeled"] and got[3]["exposure"] is None
    texts = {r["frame_id"]: r["x"] for r in side.select("frame_id", sidecars.text().alias("x")).collect()}
    assert 'crs:Exposure2012="+0.33" crs:HasCrop="True" crs:CropLeft="0.200000"' in texts[1] and "P&amp;Q" in texts[1] and 'crs:Exposure2012="-0.50"' in texts[2] and "crs:" not in texts[3].split("rdf:about")[1].split(">")[0].replace("xmlns:crs", "")
    assert {r["frame_id"] for r in sidecars.script_rows(side).collect()} == {1, 2, 3}
    existing = spark.createDataFrame([("d/a.xmp", "other"), ("d/b.xmp", texts[2]), ("d/c.xmp", None)], "path string, head string")
    planned = frames.select(sidecars.sidecar_path(F.col("file")).alias("path"))
    assert [r[0] for r in sidecars.sidecar_conflicts(planned, existing, existing.filter("path = 'd/c.xmp'").select("path")).collect()] == ["d/a.xmp"]
    assert rows(sidecars.restore_plan(frames), "source", "target") == [("x/e.DNG", "d/e.DNG")]
    moves = lambda mode: rows(sidecars.move_plan(frames, mode), "frame_id", "target")
    assert moves("sorted") == [(1, "d/keep/a.DNG"), (2, "d/cull/b.DNG")] and moves("culls") == [(2, "d/cull/b.DNG")] and moves("home") == []


def test_cards_with_summaries_of_model_sets_only(spark):
    frames = spark.createDataFrame([(1, "d/a", "keep", True, 2, None, None, 1, 1), (2, "d/b", None, False, 0, "e", "x", 2, 1), (3, "d/c", None, False, 0, None, None, None, None)], "frame_id bigint, file string, verdict string, by_hand boolean, stars int, error string, moved_to string, set_id bigint, rank int")
    sets = spark.createDataFrame([(1, "model", "sharp first"), (1, "model", "sharp first"), (2, "scores", "stale")], "set_id bigint, by string, summary string")
    got = {r["frame_id"]: json.loads(r["card"]) for r in sidecars.cards(frames, sets).collect()}
    assert got[1] == {"id": 1, "name": "a", "path": "d/a", "verdict": "keep", "by_hand": True, "stars": 2, "set": 1, "rank": 1, "set_summary": "sharp first"}
    assert "set_summary" not in got[2] and got[2]["error"] == "e" and "set" not in got[3]


def test_saved_reports_and_labels(spark, tmp_path):
    runs = spark.createDataFrame([(1, 4, "m"), (2, 4, "n")], "report_id bigint, schema_version int, model string")
    results = spark.createDataFrame([(1, "b", "keep"), (1, "a", "cull")], "report_id bigint, file string, decision string")
    docs = sidecars.report_documents(runs, results, "report_id").selectExpr("report_id", "'d' as dir", "timestamp'2025-01-01' as generated_at", "document as raw")
    assert [x["file"] for x in json.loads({r["report_id"]: r["raw"] for r in docs.collect()}[1])["results"]] == ["a", "b"]
    assert rows(reports.frames(docs), "report_id", "file", "decision") == [(1, "a", "cull"), (1, "b", "keep")]
    newer = docs.withColumn("raw", F.replace("raw", F.lit('"schema_version":4'), F.lit('"schema_version":5')))
    with pytest.raises(Exception, match="newer report version: 5"):
        reports.runs(newer).collect()
    assert reports.parsed(newer, newer="skip").count() == 0 and reports.unreadable(newer).count() == 2
    path = str(tmp_path / "log")
    entry = lambda *x: spark.createDataFrame(x, "file string, label string, stars int, ev double")
    sidecars.append_labels(entry(("b", "keep", 1, None), ("a", "", 0, 0.5)), path, ["file"])
    sidecars.append_labels(entry(("c", "cull", 0, None)), path, ["file"])
    assert rows(spark.read.parquet(path), "log_id", "file") == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(ValueError, match="x/y"):
        sidecars.append_labels(entry(("z", "keep", 1, None), ("x/y", "keep", 1, None)), path, ["file"])
    sidecars.save(runs, str(tmp_path / "runs"), ["model"])
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2
    matrix = compare.confusion(spark.createDataFrame([("keep", "cull"), ("keep", "keep")], "label string, decision string"), "label", "decision")
    assert "50.0 %" in sidecars.matrix_text(matrix, compare.rates(matrix))


def test_logs_by_lines_and_listings(spark, tmp_path):
    log = tmp_path / "labels.jsonl"
    log.write_text("\n".join(['{"file":"a","label":"keep"}', "", *[json.dumps({"file": f"f{i}", "stars": i % 6}) for i in range(2000)], '{"file":"z"']))
    got = reports.label_lines(spark, str(log))
    assert got.count() == 2001 and got.agg(F.max("log_id")).first()[0] == 2002
    log.write_text('{"file":"a"}\n{"label":1}\n')
    with pytest.raises(Exception, match="line 2"):
        reports.label_lines(spark, str(log)).collect()
    log.write_text('{"name":"a"}\nbad\n{"name":""}\n{"name":"b"}')
    assert rows(reports.manifest_lines(spark, str(log), "name string"), "entry_id", "name") == [(1, "a"), (4, "b")]
    log.write_text("")
    assert reports.label_lines(spark, str(log)).collect() == []
    shoot = tmp_path / "keep" / ".x" / "shoot"
    for p in ("a.DNG", "b.dng", "c.jpg", ".h.dng", "keep/d.dng", "sub/e.dng", ".hid/f.dng", "sub/culled/g.dng"):
        (shoot / p).parent.mkdir(parents=True, exist_ok=True)
        (shoot / p).write_bytes(b"x")
    base = lambda df: sorted(r["path"].rsplit("/")[-1] for r in df.collect())
    assert base(reports.listing(spark, str(shoot))) == ["a.DNG", "b.dng", "e.dng"]
    assert sorted((r["root"], r["path"].rsplit("/")[-1]) for r in reports.card_scan(spark, [str(shoot / "sub"), str(shoot / "keep")]).collect()) == [(0, "e.dng"), (0, "g.dng"), (1, "d.dng")]
    assert {r["path"].rsplit("/")[-1]: r["place"] for r in reports.shoot_files(spark, str(shoot)).collect()} == {"a.DNG": "", "b.dng": "", "d.dng": "keep", "e.dng": "", "g.dng": "culled"}
    batch = tmp_path / "out.jsonl"
    batch.write_text('{"custom_id":"E-1","result":{"type":"succeeded"}}\n{"custom_id":"E-2","result":{"type":"errored","error":{"message":"no"}}}\n{"custom_id":"E-3","result":{"type":"expired"}}\ntorn')
    assert [(r["custom_id"], r["state"], r["message"]) for r in reports.batch_results(spark, str(batch)).orderBy("custom_id").collect()] == [("E-1", "succeeded", None), ("E-2", "errored", "no"), ("E-3", "other", None)]


SCHEMA = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "string", "enum": ["x", "y"]}}, "c": {"type": "boolean"}}}


def test_answers_against_a_schema(spark):
    texts = ['{"a":1,"b":["x"],"c":true}', '{"b":[]}', '{"a":1.5}', '{"a":true}', '{"a":1,"b":["z"]}', '{"a":1,"q":2}', "[", None, '{"a":2.0}', "[1]"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(shots.schema_check(F.col("t"), SCHEMA)).collect()]
    assert got == [None, "(root): a is missing", "a: not integer", "a: not integer", "b[0]: not one of the allowed values", "(root): q is unexpected", "invalid json", None, None, "(root): not object"]
    assert shots.answer_json({"b": 1, "a": [2]}) == '{"b":1,"a":[2]}'
    df = spark.createDataFrame([([2, 1, 3], 3), ([1, 1], 2), ([], 0), (None, 1), ([1], 2)], "a array<int>, n int")
    assert [r[0] for r in df.select(order.is_permutation(F.col("a"), F.col("n"))).collect()] == [True, False, True, False, False]


def test_look_distance_of_colour_grids(spark):
    rnd = np.random.default_rng(1)
    a = rnd.random((30, 8 * 8 * 3))
    b = np.roll(a.reshape(30, 8, 8, 3), 1, axis=1).reshape(30, -1)

    def brute(x, y, side=8, ch=3):
        best = 1.0
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                cells = [sum(abs(x[(r * side + c) * ch + k] - y[((r + dy) * side + c + dx) * ch + k]) for k in range(ch)) / ch for r in range(side) for c in range(side) if 0 <= r + dy < side and 0 <= c + dx < side]
                most = -(-len(cells) // 4)
                best = min(best, sum(sorted(cells)[-most:]) / most)
        return best

    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))] + [(90, [1.0], a[0].tolist()), (91, None, None)], "i int, a array<double>, b array<double>")
    got = {r["i"]: r["d"] for r in df.select("i", V.look_distance(F.col("a"), F.col("b"), 8, 3).alias("d")).collect()}
    assert all(abs(got[i] - brute(a[i], b[i])) < 1e-12 for i in range(30)) and got[90] == got[91] == 1.0
    one = spark.createDataFrame([(a[0].tolist(),)], "a array<double>").select(V.levelled(F.col("a")).alias("l")).first()["l"]
    assert np.allclose(one, np.minimum(1, a[0] / 1 / 4))


def test_planes(spark):
    rnd = np.random.default_rng(2)
    p = rnd.integers(0, 256, (5, 8)).astype(np.uint8)
    df = spark.createDataFrame([(bytearray(p.tobytes()), 8, 5, o) for o in (1, 3, 6, 8, None)] + [(bytearray(b"xx"), 8, 5, 1), (None, None, None, None)], "p binary, w int, h int, o int")
    got = [r[0] for r in df.select(planes.oriented(F.col("p"), F.col("w"), F.col("h"), F.col("o")).alias("r")).collect()]
    for r, want in zip(got, (p, p[::-1, ::-1], np.rot90(p, -1), np.rot90(p), p), strict=False):
        assert (r["width"], r["height"]) == want.shape[::-1] and bytes(r["plane"]) == np.ascontiguousarray(want).tobytes()
    assert got[5]["plane"] is None and got[6]["plane"] is None
    small = df.limit(1).select(planes.box_shrunk(F.col("p"), F.col("w"), F.col("h"), 3).alias("r")).first()["r"]
    scale = 8 / 3
    spans = lambda n, limit: [(int(i * scale), max(min(int((i + 1) * scale), limit), int(i * scale) + 1)) for i in range(n)]
    want = [int(p[a:b, c:d].astype(int).sum() // ((b - a) * (d - c))) for a, b in spans(2, 5) for c, d in spans(3, 8)]
    assert (small["width"], small["height"], list(small["plane"])) == (3, 2, want)
    flat = [np.full((16, 16), v, np.uint8) for v in (255, 128, 128)]
    assert planes.fingerprint(*flat, 2) == bytes([255] * 12) and len(planes.fingerprint(*flat, 8)) == 192 and planes.fingerprint(*[f[:1, :1] for f in flat], 2)[-3:] == bytes([255] * 3)
    look = spark.createDataFrame([(bytearray([0, 7, 255]), "AAf/"), (None, ""), (None, "*"), (None, None)], "b binary, t string")
    assert [r[0] for r in look.select(planes.decode_look(F.col("t"))).collect()] == [[0.0, 7.0, 255.0], None, None, None]
    assert look.select(planes.encode_look(F.col("b"))).first()[0] == "AAf/"


def test_where_focus_landed(spark):
    cells = [(1, i, float(i), float(i % 5) * 10, 100.0, False) for i in range(20)] + [(2, 0, 0.0, 1.0, 5.0, None)]
    df = spark.createDataFrame(cells, "f int, cell int, fine double, coarse double, mean double, excluded boolean")
    floors = {r["f"]: (r["noise"], r["floor"]) for r in measure.noise_and_floor(df, ["f"]).collect()}
    assert floors == {1: (2.0, 30.0), 2: (0.0, 1.0)}
    assert rows(measure.landed_cells(df, ["f"], "cell", 2).filter("f = 1"), "rank", "cell") == [(1, 18), (2, 19)]
    grey = spark.createDataFrame([([float(v) for v in range(64)],), ([1.0],), (None,)], "p array<double>")
    got = [r[0] for r in grey.select(V.fine_coarse(F.col("p"), 8).alias("x")).collect()]
    assert got[0]["fine"] == 0.0 and got[0]["mean"] == 31.5 and got[1]["fine"] is None
    assert grey.select(measure.fine_to_coarse(F.col("p"), 8)).first()[0] == 0.0


def test_small_expressions(spark):
    df = spark.createDataFrame([(1.5, "Leica", "LEICA M11-P", "x"), (None, "RICOH IMAGING COMPANY, LTD.", "PENTAX K-1", None), (0.5, None, None, ""), (2.0, "Apple", "iPhone", "L")], "t double, mk string, md string, lens string")
    assert [r[0] for r in df.select(shots.camera_text(F.col("mk"), F.col("md"))).collect()] == ["a LEICA M11-P rangefinder (manual focus, often fast lenses shot wide open)", "a RICOH PENTAX K-1", "a digital camera", "an Apple iPhone"]
    text = shots.exposure_text(F.col("t"), F.lit(400), F.col("lens"), F.lit(4.76), F.lit(True), F.lit(35.0))
    assert [r[0] for r in df.select(text).collect()] == ["1.5 s, ~f/4.8 (camera estimate), ISO 400, 35 mm, x", "~f/4.8 (camera estimate), ISO 400, 35 mm", "1/2 s, ~f/4.8 (camera estimate), ISO 400, 35 mm", "2 s, ~f/4.8 (camera estimate), ISO 400, 35 mm, L"]
    box = shots.square(F.lit(10), F.lit(90), F.lit(50), F.lit(100), F.lit(40))
    assert tuple(df.select(box.alias("b")).first()["b"]) == (0, 0, 40, 40)
    eyes = shots.eye_squares(F.array(F.struct(F.lit(50).alias("x"), F.lit(5).alias("y"))), F.lit(200), F.lit(100), F.lit(100))
    assert [tuple(e) for e in df.select(eyes.alias("e")).first()["e"]] == [(20, 0, 80, 60)]
    notes = df.select(shots.once_more(F.array(F.lit("a")), F.lit("a")).alias("x"), shots.once_more(F.lit(None).cast("array<string>"), F.lit("b")).alias("y")).first()
    assert (notes["x"], notes["y"]) == (["a"], ["b"])
    said = [(None, True, "face", True), ("timeout", None, None, None), (None, None, None, None), (None, False, "face", True), (None, True, "none", True), (None, True, "face", False)]
    got = [r[0] for r in spark.createDataFrame(said, "f string, c boolean, k string, v boolean").select(shots.locate_outcome(F.col("f"), F.col("c"), F.col("k"), F.col("v"))).collect()]
    assert got == [None, "locate failed: timeout", "locate failed: no result", "model: no clear subject", "model: no clear subject", "model: invalid box"]
    crop = df.select(shots.crop_kept(F.lit(0.1), F.lit(0.1), F.lit(0.9), F.lit(0.9)).alias("a"), shots.crop_kept(F.lit(0.1), F.lit(0.1), F.lit(0.5), F.lit(0.9)).alias("b"), shots.crop_kept(F.lit(0.9), F.lit(0.1), F.lit(0.1), F.lit(0.9)).alias("c")).first()
    assert tuple(crop) == (True, False, False)
    kinds = df.select(measure.junk_detail(F.lit("black"), F.lit(99.954), F.lit(0.0), F.lit(0.0)).alias("a"), measure.junk_detail(F.lit("uniform"), F.lit(1.0), F.lit(0.0), F.lit(0.3)).alias("b"), measure.junk_detail(F.lit(None).cast("string"), F.lit(1.0), F.lit(0.0), F.lit(0.3)).alias("c")).first()
    assert tuple(kinds) == ("black (99.95% of pixels near-black)", "uniform (thumbnail contrast 0.30)", None)
    empty = spark.createDataFrame([(("", "", None, []), None), (None, ("p", "", "l", ["k"]))], "s struct<project:string,event:string,location:string,keywords:array<string>>, g struct<project:string,event:string,location:string,keywords:array<string>>")
    assert [r[0] and tuple(r[0]) for r in empty.select(shots.merged_tags(F.col("s"), F.col("g"))).collect()] == [None, ("p", None, "l", ["k"])]


def test_answers_of_models_and_contents(spark):
    answers = ['{"sharpness":{"score":7.5,"status":"sharp"},"keywords":["A  b","a b",null,"cull:x"],"more":1}', "[]", "torn {", None, '{"keywords":null}']
    got = [r[0] for r in spark.createDataFrame([(a,) for a in answers], "a string").select(reports.decoded_evaluation(F.col("a")).alias("e")).collect()]
    assert got[0]["sharpness"]["score"] == 7.5 and got[0]["keywords"] == ["a b"] and got[1:4] == [None] * 3 and got[4]["keywords"] is None
    usage = spark.createDataFrame([((5, None, 7),)], "u struct<input_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>")
    assert usage.select(compare.total_in(F.col("u"))).first()[0] == 12
    faces = spark.createDataFrame([([(9.0, 1.0), (5.0, 8.0), (4.0, 99.0), (9.0, 2.0)],), ([],), (None,)], "f array<struct<q:double,area:double>>")
    assert [r["b"] and tuple(r["b"]) for r in faces.select(measure.best_face(F.col("f"), 3.0).alias("b")).collect()] == [(8.0, 5.0), None, None]
    assert [[tuple(x) for x in r["b"] or []] for r in faces.select(measure.faces_by_certainty(F.col("f"), 5.0).alias("b")).collect()] == [[(9.0, 2.0), (9.0, 1.0), (5.0, 8.0)], [], []]


def test_camera_order_card_by_card(spark):
    paths = [(0, "/a/101CORVN/L1230002.DNG"), (0, "/a/100CORVN/L1239999.DNG"), (0, "/a/notes.dng"), (1, "/b/x/L1230009.DNG"), (1, "/b/101CORVN/L1230001.DNG")]
    df = order.camera_order(spark.createDataFrame(paths, "root int, path string"), "root", "path")
    got = [r["path"].rsplit("/")[-1] for r in df.orderBy("root", *order.CAMERA_KEYS, "path").collect()]
    assert got == ["L1239999.DNG", "L1230002.DNG", "notes.dng", "L1230001.DNG", "L1230009.DNG"]  # folders count on the first card alone


def test_final_round_and_calls(spark):
    df = spark.createDataFrame([("s", c, r, 4 * c + r) for c in range(3) for r in range(1, 5)], "k string, chunk int, chunk_rank int, pos int")
    assert order.final_positions(df, ["k"], 3).first()["positions"] == [1, 2, 5, 6, 9, 10]
    sets = spark.createDataFrame([(1, None), (2, "scores"), (9, "model"), (17, None)], "of int, by string")
    assert rows(order.to_rank(sets), "of") == [(2,), (17,)] and rows(order.to_rank(sets, True), "of") == [(2,), (9,), (17,)]
    assert [tuple(r) for r in sets.select(order.rank_calls(F.col("of")), order.rank_calls(F.col("of"), True)).collect()] == [(1, 2), (1, 2), (3, 3), (4, 4)]


def test_hot_groups_in_sequences(spark):
    rnd = random.Random(6)
    items = [("hot" if i % 9 else "b", i, rnd.random()) for i in range(3000)]
    want, run, last = {}, {}, {}
    sizes = {}
    for g, i, v in items:
        linked = g in last and abs(v - last[g]) < 0.93
        run.setdefault(g, [])
        if not linked or len(run[g][-1]) == 40:
            run[g].append([])
        run[g][-1].append(i)
        last[g] = v
    for g, runs in run.items():
        for k, members in enumerate([m for m in runs if len(m) > 1]):
            want |= {i: (g, k + 1) for i in members}
            sizes |= dict.fromkeys(members, len(members))
    df = spark.createDataFrame(items, "g string, i int, v double")
    got = order.sequences(df, "g", ["i"], ["v"], F.abs(F.col("v") - F.col("before_v")) < 0.93).collect()
    assert {r["i"]: (r["g"], r["set_id"]) for r in got} == want and {r["i"]: r["set_size"] for r in got} == sizes
