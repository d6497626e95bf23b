"""Problem 4: every recorded time of frames and manifest lines as one UTC instant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotarium.functions.times import normalise_times
from fotarium.session import only


def recorded_times(frames: DataFrame, manifest: DataFrame) -> DataFrame:
    """(field, record_id, dir, value, fraction): one row per recorded time text, both tables in one."""
    exif = frames.select(F.lit("exif").alias("field"), F.col("frame_id").alias("record_id"), "dir", F.col("exif.date_time_original").alias("value"), F.col("exif.subsec").alias("fraction"))
    named = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in ("mtime", "dates_set")])
    lines = manifest.select("entry_id", "dir", F.inline(named)).select("field", F.col("entry_id").alias("record_id"), "dir", "value", F.lit(None).cast("string").alias("fraction"))
    return exif.unionByName(lines).filter(F.col("value").isNotNull())


def utc_instants(frames: DataFrame, manifest: DataFrame, shoots: DataFrame) -> DataFrame:
    """(field, record_id, utc_us): one row per record and field whose time is an instant.

    Rules are those of normalise_times(), with the time zone of the record's shoot as the
    default zone. Rows delivered more than once give one row; records whose time is missing,
    impossible, without a time of day or without a zone give none. A folder with several
    (repeated) shoot rows takes one of their zones, the least by name. A null dir has no zone, a
    null record id gives no row. Empty tables give no rows. Extra columns are not read.

    The zone lookup is a plain join: Spark broadcasts the shoots only below its own size
    threshold; above it the join is by dir, where AQE splits a hot folder's partition."""
    frames, manifest = only(frames, "frame_id", "dir", "exif"), only(manifest, "entry_id", "dir", "mtime", "dates_set")
    zones = only(shoots, "dir", "time_zone").filter(F.col("dir").isNotNull()).groupBy("dir").agg(F.min("time_zone").alias("zone"))
    times = recorded_times(frames, manifest).join(zones, "dir", "left")
    found = normalise_times(times, "value", "utc_us", zone="zone", fraction="fraction")
    found = found.filter(F.col("utc_us").isNotNull() & F.col("record_id").isNotNull())
    return found.groupBy("field", "record_id").agg(F.min("utc_us").alias("utc_us"))
