"""Problem 5: sessions by merging gap-length intervals, in batch and as a stream."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from fotarium.functions.times import normalise_times
from fotarium.operators.ranges import range_table
from fotarium.session import materialize, only

GAP_US = 1_200_000_000
SESSION = "key string, start bigint, end bigint, n bigint"


def model_key(model):
    """A camera model, lower-case, trimmed, blanks collapsed; null when nothing is left."""
    text = F.lower(F.trim(F.regexp_replace(model, r"[\s\u00a0\u3000]+", " ")))
    return F.when(text != "", text)


def merge_sessions(events: DataFrame, key: str, at_us: str, gap_us: int = GAP_US, label: str = "sessions") -> DataFrame:
    """(key, start_us, end_us, n): activity of each key, split where the gap exceeds `gap_us`.

    Every event opens an interval of `gap_us`; intervals that overlap or touch merge. Events
    with a null key or time count nowhere; repeated rows count as many events; ties belong to
    one session. Only the two columns are read; an empty table gives no rows.

    No key is gathered in one task: events at one instant are counted first, the instants are
    sorted into range partitions that cut through hot keys, and intervals merge inside each
    partition. What is left are partial sessions; those that lie wholly inside a partition are
    final, and only the first and the last of each partition (two rows a partition) can touch
    a neighbour and go through the last merge."""
    points = only(events, key, at_us).select(F.col(key).alias("key"), F.col(at_us).cast("bigint").alias("at")).filter(F.col("key").isNotNull() & F.col("at").isNotNull())
    points = points.groupBy("key", "at").agg(F.count(F.lit(1)).alias("n"))
    found = merge_intervals(points.select("key", F.col("at").alias("start"), F.col("at").alias("end"), "n"), gap_us, label)
    return found.select(F.col("key").alias(key), F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n")


def merge_intervals(intervals: DataFrame, gap_us: int = GAP_US, label: str = "sessions") -> DataFrame:
    """(key, start, end, n): the merging state of sessions. Intervals of a key merge where the next one begins at
    most `gap_us` after the furthest end so far; `n` adds up. Events are intervals of no length, and
    sessions found earlier are intervals again, so late events just merge in.

    Intervals are sorted into range partitions and merge inside each. Only partial sessions at the edges of a
    partition, and those that a long interval of an earlier partition reaches, go through the last merge."""
    rows = range_table(intervals.select("key", "start", "end", "n"), ["key", "start", "end"], label)
    inside = Window.partitionBy("_part", "key").orderBy("start", "end")
    so_far = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    partial = rows.withColumn("_open", F.when(F.col("start") - so_far <= gap_us, 0).otherwise(1)).withColumn("_run", F.sum("_open").over(inside))
    partial = partial.groupBy("_part", "key", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    ends = partial.groupBy("_part", "key").agg(F.max("end").alias("_far"), F.min("start").alias("_lo"), F.max("start").alias("_hi"))
    bounds = ends.groupBy("_part").agg(F.min(F.struct("key", "_lo")).alias("_first"), F.max(F.struct("key", "_hi", "_far")).alias("_last"))
    # how far the intervals of a partition's last key reach: a row a partition
    reach = bounds.withColumn("_far", F.max("_last._far").over(Window.partitionBy("_last.key").orderBy("_part")))
    ahead = Window.orderBy("_part")
    reach = reach.withColumns({"_key0": F.lag("_last.key").over(ahead), "_far0": F.lag("_far").over(ahead)})
    partial = partial.join(F.broadcast(reach.select(F.col("_part").alias("_p"), "_first", "_last", "_key0", "_far0")), F.col("_part") == F.col("_p"))
    first = (F.col("key") == F.col("_first.key")) & (F.col("start") == F.col("_first._lo"))
    last = (F.col("key") == F.col("_last.key")) & (F.col("start") == F.col("_last._hi"))
    reached = (F.col("key") == F.col("_key0")) & (F.col("start") - F.col("_far0") <= gap_us)
    longest = (F.col("key") == F.col("_last.key")) & (F.col("end") >= F.col("_last._far"))
    partial = partial.withColumn("_edge", first | last | longest | F.coalesce(reached, F.lit(False)))
    across = Window.partitionBy("key").orderBy("start", "end")
    rest = partial.filter("_edge")
    far = F.max("end").over(across.rowsBetween(Window.unboundedPreceding, -1))
    rest = rest.withColumn("_open", F.when(F.col("start") - far <= gap_us, 0).otherwise(1)).withColumn("_run", F.sum("_open").over(across))
    rest = rest.groupBy("key", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    return partial.filter(~F.col("_edge")).select("key", "start", "end", "n").unionByName(rest.select("key", "start", "end", "n"))


def closed_sessions(sessions: DataFrame, watermark_us: int, gap_us: int = GAP_US) -> DataFrame:
    """Sessions that no event at or after the watermark can join; a late one still can, through SessionStore.add()."""
    return sessions.filter(F.col("end") + gap_us < watermark_us)


class SessionStore:
    """The sessions of all events so far under `path`, in folders by day of start; batches of events in any order
    merge in. Of what is stored, only days that a batch can touch are read and written again.

    An index (a record a day) is written for every version before it counts. A batch whose id was added already
    changes nothing, so a stream that repeats a batch after a failure counts each event once."""

    DAY = 86_400_000_000

    def __init__(self, spark: SparkSession, path: str, gap_us: int = GAP_US):
        self.spark, self.path, self.gap = spark, path, gap_us

    def _fs(self):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return place, place(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _index(self) -> dict:
        place, fs = self._fs()
        folder = place(f"{self.path}/index")
        whole = sorted(n for n in (x.getPath().getName() for x in (fs.listStatus(folder) if fs.exists(folder) else [])) if n.endswith(".json"))
        if not whole:
            return {"version": 0, "longest": 0, "days": {}, "ids": {}, "batches": [], "newest": None}
        stream = fs.open(place(f"{self.path}/index/{whole[-1]}"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def sessions(self) -> DataFrame:
        """(key, start, end, n) of all sessions."""
        held = self._index()["days"].values()
        return self.spark.read.schema(SESSION).parquet(*held) if held else self.spark.createDataFrame([], SESSION)

    def closed(self, late_us: int) -> DataFrame:
        """Sessions that are final if events come at most `late_us` behind the newest one."""
        newest = self._index()["newest"]
        return closed_sessions(self.sessions(), -(2**62) if newest is None else newest - late_us, self.gap)

    def _unseen(self, events: DataFrame, index: dict) -> DataFrame:
        """Events by `id`, each once and none that was added before: an event that is delivered again has its
        time again, so only the ids of the batch's days are read."""
        once = events.filter("id is not null").groupBy(F.col("id").cast("string").alias("id")).agg(F.min(F.struct("key", "at")).alias("e")).select("id", "e.*")
        once = materialize(once.filter("key is not null and at is not null").withColumn("day", F.floor(F.col("at") / self.DAY)), "ids")
        days = [str(r["day"]) for r in once.select("day").distinct().collect()]
        held = [p for d in days for p in index["ids"].get(d, [])]
        if held:
            once = materialize(once.join(self.spark.read.schema("id string").parquet(*held), "id", "left_anti"), "ids")
        place = f"{self.path}/ids/{uuid.uuid4().hex}"
        once.select("id", "day").repartition("day", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("day").parquet(place)
        for r in once.select("day").distinct().collect():
            index["ids"].setdefault(str(r["day"]), []).append(f"{place}/day={r['day']}")
        return once

    def add(self, events: DataFrame, batch_id: int | None = None) -> DataFrame | None:
        """Merge events (key, at, and where there are such, their id) in; gives the sessions of the days touched,
        None for a batch without new events or added before."""
        index = self._index()
        if batch_id is not None and batch_id in index["batches"]:
            return None
        if "id" in events.columns:
            events = self._unseen(events, index)
        known = events.select("key", F.col("at").cast("bigint").alias("start")).filter("key is not null and start is not null")
        fresh = materialize(known.groupBy("key", "start").agg(F.count(F.lit(1)).alias("n")).select("key", "start", F.col("start").alias("end"), "n"), "events")
        touched = fresh.select(F.floor((F.col("start") - self.gap - index["longest"]) / self.DAY).alias("lo"), F.floor((F.col("start") + self.gap) / self.DAY).alias("hi")).distinct().collect()  # days of a batch
        if not touched:
            return None
        days = {d for r in touched for d in range(r["lo"], r["hi"] + 1)}
        old = [p for d, p in index["days"].items() if int(d) in days]
        rows = fresh.unionByName(self.spark.read.schema(SESSION).parquet(*old)) if old else fresh
        found = merge_intervals(rows, self.gap).withColumn("day", F.floor(F.col("start") / self.DAY))
        place = f"{self.path}/days/{uuid.uuid4().hex}"
        found.repartition("day", F.pmod(F.xxhash64("key"), F.lit(8))).write.partitionBy("day").parquet(place)
        written = self.spark.read.schema(f"{SESSION}, day bigint").parquet(place)
        index["days"] = {d: p for d, p in index["days"].items() if int(d) not in days}
        index["days"] |= {str(r["day"]): f"{place}/day={r['day']}" for r in written.select("day").distinct().collect()}
        index["longest"] = max(index["longest"], written.agg(F.max(F.col("end") - F.col("start"))).first()[0])
        newest = fresh.agg(F.max("end")).first()[0]
        index["newest"] = newest if index["newest"] is None else max(newest, index["newest"])
        index["version"] += 1
        index["batches"] = [*index["batches"], batch_id][-1000:] if batch_id is not None else index["batches"]
        jvm_path, fs = self._fs()
        part, whole = (jvm_path(f"{self.path}/index/v{index['version']:09d}.{x}") for x in ("part", "json"))
        stream = fs.create(part, True)
        stream.write(bytearray(json.dumps(index).encode()))
        stream.close()
        if not fs.rename(part, whole):
            raise OSError(f"can't store a version in {self.path}")
        return written.select("key", "start", "end", "n")


def shooting_sessions(frames: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """(model, start_us, end_us, duration_us, n_frames) of every shooting session.

    A frame counts once however often it was delivered, at its wall-clock time as written (see
    normalise_times). Frames without a model, without an id or with an invalid time count nowhere.
    If deliveries of a frame differ, the last loaded one holds (then the greatest values)."""
    timed = only(frames, "frame_id", "loaded_at", "exif").select("frame_id", "loaded_at", F.col("exif.model").alias("model"), F.col("exif.date_time_original").alias("value"), F.col("exif.subsec").alias("fraction"))
    timed = normalise_times(timed, "value", "_instant", fraction="fraction", wall="at")
    timed = timed.select("frame_id", "loaded_at", model_key(F.col("model")).alias("model"), "at").filter(F.col("frame_id").isNotNull())
    once = timed.groupBy("frame_id").agg(F.max(F.struct("loaded_at", "model", "at")).alias("r")).select("r.model", "r.at")
    found = merge_sessions(once, "model", "at", gap_us)
    return found.select("model", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), F.col("n").alias("n_frames"))


def stream_sessions(events: DataFrame, event_id: str, model: str, at: str, path: str, checkpoint: str, gap_us: int = GAP_US) -> StreamingQuery:
    """The same as a stream into SessionStore(path): every micro-batch merges into the stored sessions, so late events
    count, however late, and open their session again if they touch one. Models are normalised as in
    the batch form, and events delivered again count once. SessionStore.closed() has the watermark."""
    rows = events.select(F.col(event_id).alias("id"), model_key(F.col(model)).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"))

    def take(batch: DataFrame, batch_id: int) -> None:
        SessionStore(batch.sparkSession, path, gap_us).add(batch, batch_id)

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watermark_sessions(events: DataFrame, key: str, at: str, gap: str = "1200 seconds", late: str = "1 hour") -> DataFrame:
    """Sessions as Spark's own session state gives them (append mode): emitted once the watermark, `late` behind the
    newest event, has passed their end. Events behind the watermark are lost, unlike in stream_sessions()."""
    found = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), F.col(key)).agg(F.min(at).alias("start_at"), F.max(at).alias("end_at"), F.count(F.lit(1)).alias("n"))
    return found.select(key, "start_at", "end_at", "n")
