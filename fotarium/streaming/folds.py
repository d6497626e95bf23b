"""Streaming folds of append-only logs into a table, restartable and idempotent, rewriting only what a batch touches."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fotarium.operators.logs import fold_last
from fotarium.session import materialize

#: Parts of a fold by hash of its keys; a batch rewrites the parts that its keys fall in.
PARTS = 64


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return place, place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _index(spark: SparkSession, path: str) -> dict:
    """{version, batch, parts: {part: folder}, schema} of the newest whole fold."""
    place, fs = _fs(spark, path)
    folder = place(f"{path}/index")
    whole = sorted(n for n in (s.getPath().getName() for s in (fs.listStatus(folder) if fs.exists(folder) else [])) if n.endswith(".json"))
    if not whole:
        return {"version": 0, "batch": -1, "parts": {}, "schema": None}
    stream = fs.open(place(f"{path}/index/{whole[-1]}"))
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def _store(spark: SparkSession, path: str, index: dict, keep: int) -> None:
    place, fs = _fs(spark, path)
    part, whole = (place(f"{path}/index/v{index['version']:09d}.{x}") for x in ("part", "json"))
    stream = fs.create(part, True)
    stream.write(bytearray(json.dumps(index).encode()))
    stream.close()
    if not fs.rename(part, whole):
        raise OSError(f"can't store a version in {path}")
    gone = index["version"] - keep
    if gone > 0:  # folders that only older versions than the kept ones used
        held = set(index["parts"].values())
        for v in range(gone + 1, index["version"]):
            at = place(f"{path}/index/v{v:09d}.json")
            if fs.exists(at):
                old = fs.open(at)
                held |= set(json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(old, "UTF-8"))["parts"].values())
                old.close()
        at = place(f"{path}/index/v{gone:09d}.json")
        if fs.exists(at):
            old = fs.open(at)
            for folder in set(json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(old, "UTF-8"))["parts"].values()) - held:
                fs.delete(place(folder), True)
            old.close()
            fs.delete(at, False)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of the newest whole fold, tombstones included; None before the first."""
    index = _index(spark, path)
    return spark.read.schema(index["schema"]).parquet(*index["parts"].values()) if index["parts"] else None


def merge_batch(batch: DataFrame, keys: list[str], seq: str, path: str, batch_id: int, parts: int = PARTS, keep: int = 2) -> int:
    """Merge a batch of log entries into the fold under `path`; gives how many parts were rewritten. A batch with the id
    of the last one, or an older one, was merged before and changes nothing."""
    spark = batch.sparkSession
    index = _index(spark, path)
    if batch_id <= index["batch"]:
        return 0
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    new = materialize(fold_last(batch, keys, seq).select(*batch.columns).withColumn("_part", part), "entries")
    touched = [r["_part"] for r in new.select("_part").distinct().collect()]  # at most `parts`
    if touched:
        rows, old = new.drop("_part"), [index["parts"][str(t)] for t in touched if str(t) in index["parts"]]
        if old:
            rows = rows.unionByName(spark.read.schema(index["schema"]).parquet(*old))
        place = f"{path}/data/{uuid.uuid4().hex}"
        fold_last(rows, keys, seq).select(*batch.columns).withColumn("_part", part).repartition("_part").write.partitionBy("_part").parquet(place)
        index["parts"] |= {str(t): f"{place}/_part={t}" for t in touched}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
    _store(spark, path, {**index, "version": index["version"] + 1, "batch": batch_id, "schema": schema}, keep)
    return len(touched)


def fold_stream(log: DataFrame, keys: list[str], seq: str, path: str, checkpoint: str, keep: int = 2, parts: int = PARTS) -> StreamingQuery:
    """Fold a streaming log into `path`: each micro-batch is merged with the parts of the fold that its keys fall in, and
    an index of the parts is written as a new version. A batch that runs again after a failure finds its id in
    the index, or writes its parts again from the same predecessors, so every entry counts once. The newest
    `keep` versions stay readable.

    Entries may come in any order: the greatest `seq` of a key wins. Tombstones stay in the table, as a later
    batch may bring an older entry; readers filter them with `standing()`."""
    return log.writeStream.foreachBatch(lambda batch, i: merge_batch(batch, keys, seq, path, i, parts, keep)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standing(fold: DataFrame, removed: Column) -> DataFrame:
    """The fold without its tombstones."""
    return fold.filter(~F.coalesce(removed, F.lit(False)))
