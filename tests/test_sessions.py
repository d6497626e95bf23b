import random
from datetime import datetime, timedelta

from fotarium.operators.ranges import with_previous, with_rank
from fotarium.operators.sessions import SessionStore, closed_sessions, merge_intervals, merge_sessions, shooting_sessions, stream_sessions, watermark_sessions


def brute(rows, gap):
    out, by = [], {}
    for k, t in rows:
        if k is not None and t is not None:
            by.setdefault(k, []).append(t)
    for k, times in by.items():
        times.sort()
        run = [times[0]]
        for t in times[1:]:
            if t - run[-1] > gap:
                out.append((k, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        out.append((k, run[0], run[-1], len(run)))
    return sorted(out)


def test_sessions_equal_brute_force(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice([None, *[rnd.randrange(0, 9000) for _ in range(9)]])) for _ in range(3000)]
    rows += [("hot", 5)] * 500 + [("edge", 0), ("edge", 10), ("edge", 21)]
    df = spark.createDataFrame(rows, "k string, t bigint")
    for gap in (0, 1, 10):
        got = sorted(tuple(r) for r in merge_sessions(df, "k", "t", gap).collect())
        assert got == brute(rows, gap)
    assert merge_sessions(df.limit(0), "k", "t").collect() == []


def test_frames(spark):
    at = datetime(2025, 1, 1)
    schema = "frame_id bigint, loaded_at timestamp, exif struct<model:string,date_time_original:string,subsec:string>, key string, n int"
    rows = [
        (1, at, (" Cam  X ", "2025:01:01 10:00:00", None), "k", 1), (1, at + timedelta(1), (" Cam  X ", "2025:01:01 10:00:00", None), "k", 1),
        (2, at, ("CAM X", "2025-01-01T10:20:00+09:00", None), None, 1), (3, at, ("cam x", "2025:01:01 10:40:00", "000001"), None, 1),
        (4, at, ("  ", "2025:01:01 10:00:00", None), None, 1), (5, at, None, None, 1), (6, at, ("cam x", "bad", None), None, 1), (None, at, ("cam x", "2025:01:01 10:00:00", None), None, 1),
    ]
    got = sorted((r["model"], r["duration_us"], r["n_frames"]) for r in shooting_sessions(spark.createDataFrame(rows, schema)).collect())
    assert got == [("cam x", 0, 1), ("cam x", 1_200_000_000, 2)]


def test_previous_and_rank_cross_partitions(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["h", "h", "h", "x", None]), i, rnd.random()) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    want, last, count = {}, {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        want[i] = (last.get(k), count.get(k, 0))
        last[k], count[k] = v, count.get(k, 0) + 1
    prev = {r["i"]: r["before"] for r in with_previous(df, ["k"], ["i"], {"before": "v"}, "t").collect()}
    rank = {r["i"]: r["rank0"] for r in with_rank(df, ["i"], "t", within=["k"]).collect()}
    assert {i: (prev[i], rank[i]) for i in want} == want
    assert sorted(r["rank0"] for r in with_rank(df, ["i"], "t").collect()) == list(range(800))


def test_stream(spark, tmp_path):
    start = datetime(2025, 1, 1)
    rows = [("a", start + timedelta(seconds=s)) for s in (0, 600, 1800, 4000)] + [("b", start)]
    spark.createDataFrame(rows, "k string, at timestamp").write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("z", start + timedelta(days=2))], "k string, at timestamp").write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("k string, at timestamp").parquet(str(tmp_path / "in"))
    query = watermark_sessions(events, "k", "at").writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r["k"], (r["end_at"] - r["start_at"]).total_seconds(), r["n"]) for r in spark.table("found").collect())
    assert got == [("a", 0.0, 1), ("a", 1800.0, 3), ("b", 0.0, 1)]


def test_intervals_of_any_length(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(600):
        a = rnd.randrange(0, 20_000)
        rows.append(("hot" if i % 4 else "x", a, a + rnd.choice([0, 0, 3, 40, 6000 if i % 97 == 0 else 1]), rnd.randrange(1, 4)))
    want = []
    for k in ("hot", "x"):
        held = sorted(r[1:] for r in rows if r[0] == k)
        run = list(held[0])
        for a, b, n in held[1:]:
            if a - run[1] > 12:
                want.append((k, *run))
                run = [a, b, n]
            else:
                run = [run[0], max(run[1], b), run[2] + n]
        want.append((k, *run))
    got = merge_intervals(spark.createDataFrame(rows, "key string, start bigint, end bigint, n bigint"), 12).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_store_takes_late_and_repeated_events(spark, tmp_path):
    rnd = random.Random(11)
    day = SessionStore.DAY
    events = [(str(i), rnd.choice(["hot", "hot", "b"]), rnd.randrange(0, 4 * day) // 10**9 * 10**9) for i in range(300)]
    rnd.shuffle(events)
    gap = 900_000_000
    store = SessionStore(spark, str(tmp_path / "s"), gap)
    for k in range(2):
        part = events[k * 150 : k * 150 + 150] + events[:10]  # the first ones come again
        store.add(spark.createDataFrame(part, "id string, key string, at bigint"), k)
    assert store.add(spark.createDataFrame(events[:5], "id string, key string, at bigint"), 1) is None
    assert store.add(spark.createDataFrame(events[:5], "id string, key string, at bigint"), 7) is None
    got = sorted(map(tuple, SessionStore(spark, str(tmp_path / "s"), gap).sessions().collect()))
    assert got == brute([(k, t) for _, k, t in events], gap)
    newest = max(t for *_, t in events)
    assert sorted(map(tuple, store.closed(day).collect())) == [r for r in got if r[2] + gap < newest - day]
    assert closed_sessions(store.sessions(), 0, gap).collect() == []


def test_stream_into_the_store(spark, tmp_path):
    start, inbox = datetime(2025, 1, 1), str(tmp_path / "in")
    schema = "id bigint, model string, at timestamp"
    for part in ([(1, " Cam  A", 0), (2, "cam a", 600)], [(3, "cam b", 200_000)], [(4, "CAM A", 1500), (2, "cam a", 600), (5, None, 1)]):
        spark.createDataFrame([(i, m, start + timedelta(seconds=s)) for i, m, s in part], schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        stream_sessions(stream, "id", "model", "at", str(tmp_path / "s"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r["key"], r["end"] - r["start"], r["n"]) for r in SessionStore(spark, str(tmp_path / "s")).sessions().collect())
    assert got == [("cam a", 1_500_000_000, 3), ("cam b", 0, 1)]
