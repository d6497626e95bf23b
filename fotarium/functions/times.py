"""Timestamps in mixed notations and zones as one instant: a cascade of anchored patterns."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotarium.operators.ranges import fresh

# Minutes east of UTC of the zone abbreviations that are understood. Abbreviations
# that name several zones in use (IST, CST of China, BST of Bangladesh) follow the first one here.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_CLOCK = r"(\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"[ ]?(Z|[A-Za-z]{2,5}|[+-]\d{2}:?\d{2}|[A-Za-z_]+/[A-Za-z_/]+)?"
# Each pattern with what puts it into the common form yyyy-mm-dd|hh|mm|ss|fraction|zone; tried in this order.
CASCADE = (
    (rf"^(\d{{4}})([-:/])(\d{{2}})\2(\d{{2}})[T ]{_CLOCK}{_ZONE}$", "$1-$3-$4|$5|$6|$7|$8|$9"),
    (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?(Z|[+-]\d{2}:?\d{2})?$", "$1-$2-$3|$4|$5|$6|$7|$8"),
    (rf"^(\d{{2}})\.(\d{{2}})\.(\d{{4}})[T ]{_CLOCK}{_ZONE}$", "$3-$2-$1|$4|$5|$6|$7|$8"),
    (rf"^(?:[A-Za-z]{{3,9}},? )?(\d{{2}})[ -]([A-Za-z]{{3}})[ -](\d{{4}}) {_CLOCK}{_ZONE}$", "$3-$2-$1|$4|$5|$6|$7|$8"),
)
NUMBER = r"^[+-]?\d+(\.\d*)?$"
#: Numbers below this are seconds, others milliseconds (in seconds it is the year 5138).
SECONDS_BELOW = 100_000_000_000
MAX_MICROS = 253_402_300_800_000_000  # the year 10000
_BLANKS = " \t\n\x0b\f\r\u00a0\u3000"


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _micros(digits: Column) -> Column:
    """Microseconds of a run of fraction digits; finer digits are cut off; '' is 0."""
    return F.coalesce(F.rpad(F.substring(digits, 1, 6), 6, "0").try_cast("bigint"), F.lit(0).cast("bigint"))


def _offset_us(text: Column) -> Column:
    """Microseconds east of UTC of a written offset or abbreviation; null if it is neither."""
    digits = F.regexp_replace(F.substring(text, 2, 6), ":", "")
    hours, minutes = _int(F.substring(digits, 1, 2)), _int(F.substring(digits, 3, 2))
    numeric = F.when((hours <= 18) & (minutes < 60), hours * 60 + minutes) * F.when(F.startswith(text, F.lit("-")), -1).otherwise(1)
    names = F.create_map(*[F.lit(x) for pair in ZONE_MINUTES.items() for x in pair])
    minutes = F.when(F.regexp_like(text, F.lit(r"^[+-]\d{2}:?\d{2}$")), numeric).otherwise(F.try_element_at(names, F.upper(text)))
    return minutes.cast("bigint") * 60_000_000


def known_zone(zone: Column) -> Column:
    """`zone` trimmed, or null unless it is a region name of the zone database or a fixed offset."""
    zone = F.trim(zone)
    regions = sorted(zoneinfo.available_timezones())
    return F.when(zone.isin(regions) | F.regexp_like(zone, F.lit(r"^[+-](0\d|1[0-7]):[0-5]\d$")), zone)


def wall_to_utc(wall_us: Column, zone: Column) -> Column:
    """UTC microseconds of a wall time in a zone known to known_zone().

    A wall time shown twice means the first; one skipped takes the offset before the change.
    Both are what java.time does, to which to_utc_timestamp() leaves it; the session's own zone
    plays no part because microseconds go in and out."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall_us), zone))


def normalise_times(df: DataFrame, value: str, instant: str, *, zone: str | None = None, fraction: str | None = None, wall: str | None = None) -> DataFrame:
    """Add `instant`: microseconds since 1970 UTC of the text in column `value`, or null.

    The patterns of CASCADE are tried in order, all anchored and strict: an impossible date or
    time gives null, and so do years 0 and 1, dates without a time of day, unknown zone names, empty
    and blank text and null. A written offset or zone decides. Bare numbers are seconds, from
    SECONDS_BELOW on milliseconds, since 1970 UTC. Other values are wall-clock time in the zone of
    column `zone` (a region or a fixed offset; null or unknown: no instant). `fraction` names a
    column with digits of the second, used when `value` has none; other than digits counts as
    none. Missing seconds are 0. Digits beyond microseconds are cut off. `wall`, if given, gets the
    wall-clock time as written, offsets ignored, in microseconds as if the clock showed UTC.
    Digits may be any number: finer ones are cut off. Other columns stay as they are, whatever
    their names; `instant` and `wall` replace columns of these names.

    All work is in built-in expressions: no Python runs per row and nothing is shuffled."""
    keep = [c for c in df.columns if c not in (instant, wall)]
    form, parts, zoned, ground, wall_col, bare_col, shift = fresh(df, "_t_form", "_t_parts", "_t_zone", "_t_ground", "_t_wall", "_t_bare", "_t_shift")
    df = df.withColumn(form, F.btrim(F.col(value), F.lit(_BLANKS)))
    common = F.lit(None).cast("string")
    for pattern, target in reversed(CASCADE):
        common = F.when(F.regexp_like(F.col(form), F.lit(pattern)), F.regexp_replace(F.col(form), pattern, target)).otherwise(common)
    number = F.col(form)
    whole, rest = F.regexp_extract(number, r"^[+-]?0*(\d+)", 1).try_cast("bigint"), F.regexp_extract(number, r"\.(\d*)$", 1)
    bare = F.when(whole < SECONDS_BELOW, whole * 1_000_000 + _micros(rest)).when(whole < MAX_MICROS // 1000, whole * 1000 + F.rpad(F.substring(rest, 1, 3), 3, "0").try_cast("bigint"))
    bare = F.when(F.regexp_like(number, F.lit(NUMBER)), F.when(F.startswith(number, F.lit("-")), -bare).otherwise(bare))
    df = df.withColumns({parts: F.split(common, r"\|", 6), bare_col: bare})
    at = lambda i: F.col(parts)[i]
    month = F.lpad(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(at(0), 6, 3))).cast("string"), 2, "0")
    date = F.when(F.length(at(0)) == 10, at(0)).otherwise(F.concat(F.substring(at(0), 1, 5), month, F.substring(at(0), 9, 3)))
    hours, minutes, seconds = _int(at(1)), _int(at(2)), F.when(at(3) == "", 0).otherwise(_int(at(3)))
    clock = F.when((hours < 24) & (minutes < 60) & (seconds < 60), (hours * 3600 + minutes * 60 + seconds).cast("bigint") * 1_000_000)
    digits = at(4)
    if fraction:
        extra = F.btrim(F.col(fraction), F.lit(_BLANKS))
        digits = F.when((digits == "") & F.regexp_like(extra, F.lit(r"^[0-9]+$")), extra).otherwise(digits)
    years = F.substring(at(0), 1, 4).isin("0000", "0001")
    df = df.withColumns({
        wall_col: F.when(~years, F.unix_date(date.try_cast("date"))).cast("bigint") * 86_400_000_000 + clock + _micros(digits),
        zoned: F.when(at(5) != "", at(5)),
        ground: known_zone(F.col(zone)) if zone else F.lit(None).cast("string"),
    })
    # what to take off: a written offset, else the written region's or the default zone
    regional = F.contains(F.col(zoned), F.lit("/"))
    df = df.withColumns({shift: F.when(~regional, _offset_us(F.col(zoned))), ground: F.when(regional, known_zone(F.col(zoned))).when(F.col(zoned).isNull(), F.col(ground))})
    wall_us = F.col(wall_col)
    bare = F.when(F.abs(F.col(bare_col)) < MAX_MICROS, F.col(bare_col))
    out = {instant: F.coalesce(bare, wall_us - F.col(shift), F.when(F.col(ground).isNotNull(), wall_to_utc(wall_us, F.col(ground))))}
    if wall:
        out[wall] = F.coalesce(bare, wall_us)
    # a generator, as a filter on its output isn't pushed below it: that would copy the whole cascade into the filter
    return df.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(F.struct(*[c.alias(n) for n, c in out.items()]))))
