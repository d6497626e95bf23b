from datetime import UTC, datetime

import pytest

from fotarium.functions.times import normalise_times
from fotarium.operators.timestamps import utc_instants


def us(*args, micro=0):
    return int(datetime(*args, tzinfo=UTC).timestamp()) * 1_000_000 + micro


CASES = [
    ("2025:09:14 16:14:54", "Europe/Berlin", None, us(2025, 9, 14, 14, 14, 54)),
    ("2025-09-14T16:14:54+0545", None, None, us(2025, 9, 14, 10, 29, 54)),
    ("2025-09-14 16:14:54.1234567 -03:30", "Europe/Berlin", None, us(2025, 9, 14, 19, 44, 54, micro=123456)),
    ("2025/09/14 16:14:54", "+03:00", " 47 ", us(2025, 9, 14, 13, 14, 54, micro=470000)),
    ("2025-09-14 16:14:54.5", "UTC", "99", us(2025, 9, 14, 16, 14, 54, micro=500000)),
    ("2025-09-14 16:14:54", "UTC", "--", us(2025, 9, 14, 16, 14, 54)),
    ("Mon, 22 Sep 2025 07:28:31 GMT", None, None, us(2025, 9, 22, 7, 28, 31)),
    ("01 Jan 2000 01:11:30 +0100", None, None, us(2000, 1, 1, 0, 11, 30)),
    ("20250911T000001Z", None, None, us(2025, 9, 11, 0, 0, 1)),
    ("11.09.2025 08:00", "UTC", None, us(2025, 9, 11, 8)),
    ("2025-01-15 10:00:00 EST", None, None, us(2025, 1, 15, 15)),
    ("1759193424", None, None, 1759193424000000),
    ("1759193424.25", None, None, 1759193424250000),
    ("1759193424123", None, None, 1759193424123000),
    # shown twice: the first; skipped: the offset before the change
    ("2023-11-05 01:26", "America/New_York", None, us(2023, 11, 5, 5, 26)),
    ("2025-03-30 02:30:00", "Europe/Berlin", None, us(2025, 3, 30, 1, 30)),
    ("2025-10-05 02:15:00", "Australia/Lord_Howe", None, us(2025, 10, 4, 15, 45)),
    ("2025-09-14 16:14:54", None, None, None),
    ("2025-09-14 16:14:54", "Mars/Base", None, None),
    ("2025-09-14 16:14:54 XYZ", "UTC", None, None),
    ("2025-02-30 16:14:54", "UTC", None, None),
    ("2025-09-14 24:00:00", "UTC", None, None),
    ("2025-09-14 10:60:00", "UTC", None, None),
    ("2025-09:14 10:00:00", "UTC", None, None),
    ("0000:00:00 00:00:00", "UTC", None, None),
    ("0001-01-01T00:00:00Z", None, None, None),
    ("2025-09-14", "UTC", None, None),
    ("    :  :     :  :  ", "UTC", None, None),
    ("unknown", "UTC", None, None),
    ("", "UTC", None, None),
    (None, "UTC", "5", None),
    ("9" * 100_000, "UTC", None, None),
    # any number of digits: finer ones are cut off
    ("2025-09-14 16:14:54." + "1234567890" * 5, "UTC", None, us(2025, 9, 14, 16, 14, 54, micro=123456)),
    ("2025-09-14 16:14:54", "UTC", "47" + "0" * 100, us(2025, 9, 14, 16, 14, 54, micro=470000)),
    ("0" * 20 + "1759193424." + "25" * 40, None, None, 1759193424252525),
    ("123456789012345678", None, None, None),
    ("\u3000 2025-09-14 16:14:54\t\r\n" + " " * 500, "UTC", None, us(2025, 9, 14, 16, 14, 54)),
]


@pytest.mark.parametrize("zone_of_session", ["UTC", "Asia/Tokyo"])
def test_cascade(spark, zone_of_session):
    rows = [(i, v, z, f) for i, (v, z, f, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, value string, zone string, frac string")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone_of_session)
    try:
        got = {r["i"]: r["us"] for r in normalise_times(df, "value", "us", zone="zone", fraction="frac").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == {i: want for i, (*_, want) in enumerate(CASES)}


def test_wall_time_and_clashing_columns(spark):
    df = spark.createDataFrame([("2025-09-14 16:14:54+02:00", "kept")], "value string, _t_form string")
    row = normalise_times(df, "value", "us", wall="wall").first()
    assert row["_t_form"] == "kept" and row["wall"] - row["us"] == 7_200_000_000


FRAMES = "frame_id bigint, dir string, exif struct<date_time_original:string,subsec:string,model:string>, loaded_at timestamp, VALUE string, dir string"


def test_instants_of_records(spark):
    late, early = datetime(2025, 1, 2), datetime(2025, 1, 1)
    frames = spark.createDataFrame(
        [(1, "a", ("2025:01:01 10:00:00", "5", "M"), early, "x", "y"), (1, "a", ("2025:01:01 10:00:00", "5", "M"), late, "x", "y"), (2, None, ("2025:01:01 10:00:00", None, "M"), early, None, None), (3, "a", None, early, None, None), (None, "a", ("2025:01:01 10:00:00", None, "M"), early, None, None)],
        FRAMES,
    )
    manifest = spark.createDataFrame([(1, "a", "1759193424", None), (1, "a", "1759193424", None), (2, "b", None, "2025-01-01 10:00")], "entry_id bigint, dir string, mtime string, dates_set string")
    shoots = spark.createDataFrame([("a", "+01:00"), ("a", "+01:00"), ("b", None), (None, "UTC")], "dir string, time_zone string")
    got = sorted(tuple(r) for r in utc_instants(frames, manifest, shoots).collect())
    assert got == [("exif", 1, us(2025, 1, 1, 9, micro=500000)), ("mtime", 1, 1759193424000000)]
    assert utc_instants(frames.limit(0), manifest.limit(0), shoots.limit(0)).collect() == []
