import random

from pyspark.sql import functions as F

from fotarium.operators.logs import fold_last
from fotarium.streaming.folds import current, fold_stream, merge_batch, standing

SCHEMA = "log_id bigint, file string, label string"


def test_fold_over_restarts(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, f"f{rnd.randrange(30)}", rnd.choice(["keep", "cull", ""])) for i in range(200)]
    rnd.shuffle(rows)
    out, inbox = str(tmp_path / "out"), str(tmp_path / "in")
    for k in range(4):
        spark.createDataFrame(rows[k * 50 : k * 50 + 50], SCHEMA).coalesce(2).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(inbox)
        fold_stream(stream, ["file"], "log_id", out, str(tmp_path / "cp")).awaitTermination()
    want = fold_last(spark.createDataFrame(rows, SCHEMA), ["file"], "log_id")
    empty = F.col("label") == ""
    assert sorted(map(tuple, standing(current(spark, out), empty).select("file", "log_id").collect())) == sorted(map(tuple, want.filter(~empty).select("file", "log_id").collect()))
    assert len(list((tmp_path / "out" / "index").glob("*.json"))) <= 2


def test_only_touched_parts_are_written(spark, tmp_path):
    out = str(tmp_path / "fold")
    rows = [(i, f"f{i}", "keep") for i in range(300)]
    assert merge_batch(spark.createDataFrame(rows, SCHEMA), ["file"], "log_id", out, 0, parts=16) == 16
    again = spark.createDataFrame([(900, "f7", "cull"), (1, "f7", "review")], SCHEMA)
    assert merge_batch(again, ["file"], "log_id", out, 1, parts=16) == 1
    assert merge_batch(again, ["file"], "log_id", out, 1, parts=16) == 0
    got = {r["file"]: (r["log_id"], r["label"]) for r in current(spark, out).collect()}
    assert len(got) == 300 and got["f7"] == (900, "cull")
    assert merge_batch(again.limit(0), ["file"], "log_id", out, 2, parts=16) == 0 and current(spark, out).count() == 300


def test_nothing_yet(spark, tmp_path):
    assert current(spark, str(tmp_path / "none")) is None
