"""Scalar expressions over names, keywords, boxes and numbers, all built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s 　]+"


def round_half_away(x: Column, places: int = 0) -> Column:
    """Halves away from zero on the value as it is stored: floor(|x| * 10^p + 0.5) / 10^p."""
    scale = F.lit(10.0**places)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The lower-case extension with its dot, '' without one."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    """The lower-case base name without its extension."""
    return F.lower(F.regexp_replace(base_name(path), r"\.[^.]*$", ""))


def keywords(raw: Column, most: int = 8) -> Column:
    """Cleaned keywords in order, each once: blanks collapsed, lower-case; without empty ones, those
    over 30 bytes or three words, with `|` or in the reserved name space; the first `most`."""
    clean = F.transform(raw, lambda w: F.lower(F.trim(F.regexp_replace(w, BLANK, " "))))
    fits = F.filter(clean, lambda w: (w != "") & (F.octet_length(w) <= 30) & (F.size(F.split(w, " ")) <= 3) & ~F.contains(w, F.lit("|")) & ~F.startswith(w, F.lit("cull:")))
    return F.slice(F.array_distinct(fits), 1, most)


def xml_escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def short_id(path: Column) -> Column:
    """`f` and the first 8 bytes of the SHA-1 of a path, in hex."""
    return F.concat(F.lit("f"), F.left(F.sha1(path), F.lit(16)))


def list_key(files: Column) -> Column:
    """The first 8 bytes of the SHA-256 of NUL-joined names, in hex."""
    return F.left(F.sha2(F.array_join(files, "\0"), 256), F.lit(16))


def cache_name(base: Column, kind: Column, size: Column, mtime_ns: Column, extra: Column | None = None) -> Column:
    """`base.kind.` and 4 bytes of the SHA-256 of the version (size, time, and what else the image depends on, such as
    box_text()), in hex."""
    parts = [F.lit("v1"), size.cast("string"), mtime_ns.cast("string"), *([] if extra is None else [extra])]
    return F.concat_ws(".", base, kind, F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(8)))


def box_text(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """A box as text with four places a side."""
    return F.concat_ws(",", *[F.format_string("%.4f", c) for c in (left, top, right, bottom)])


def dcf_folder(path: Column) -> Column:
    """The number of a camera folder (100 to 999 and five characters), 0 if the folder is none."""
    folder = F.element_at(F.split(path, "/"), -2)
    digits = F.regexp_extract(F.when(F.size(F.split(path, "/")) > 1, folder), r"^([1-9]\d\d)[A-Za-z0-9_]{5}$", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def dcf_counter(path: Column) -> Column:
    """The last four digits of a camera file name (four characters and four digits), -1 if it is none."""
    digits = F.regexp_extract(F.regexp_replace(base_name(path), r"\.[^.]*$", ""), r"^[A-Za-z0-9_]{4}(\d{4})$", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(-1))


def expand(pattern: str, date: Column, name: Column, orig: Column, n: Column) -> Column:
    """A naming pattern with {date}, {name}, {orig}, {n} and {n:width} filled in."""
    out = F.lit(pattern)
    for token, value in (("{date}", date), ("{name}", name), ("{orig}", orig), ("{n}", n.cast("string"))):
        out = F.replace(out, F.lit(token), value)
    for width in dict.fromkeys(re.findall(r"\{n:(\d+)\}", pattern)):
        out = F.replace(out, F.lit("{n:" + width + "}"), F.format_string(f"%0{int(width)}d", n))
    return out


def pattern_regex(pattern: str) -> str:
    """A regular expression that finds {n} (group 1) in names made by expand(pattern)."""
    parts = re.split(r"(\{date\}|\{name\}|\{orig\}|\{n(?::\d+)?\})", pattern)
    seen, out = False, ""
    for part in parts:
        if part.startswith("{n}") or part.startswith("{n:"):
            out += r"\d+" if seen else r"(\d+)"
            seen = True
        else:
            out += ".+?" if part in ("{date}", "{name}", "{orig}") else re.escape(part)
    return f"^{out}$"


def box_valid(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Finite, inside the unit square, left of right and above below; false for nulls."""
    sides = (left, top, right, bottom)
    ok = (left < right) & (top < bottom)
    for side in sides:
        ok = ok & (side >= 0) & (side <= 1) & ~F.isnan(side)
    return F.coalesce(ok, F.lit(False))


def box_iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Intersection over union of two boxes (left, top, right, bottom); 0 when they don't meet."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - w * h
    return F.coalesce(F.try_divide(w * h, union), F.lit(0.0))


def box_from_display(orientation: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """A box of the displayed image in the coordinates of the stored one (orientations 3, 6, 8)."""
    pick = lambda l, t, r, b: F.struct(l.alias("left"), t.alias("top"), r.alias("right"), b.alias("bottom"))  # noqa: E731, E741
    return (
        F.when(orientation == 3, pick(1 - right, 1 - bottom, 1 - left, 1 - top))
        .when(orientation == 6, pick(top, 1 - right, bottom, 1 - left))
        .when(orientation == 8, pick(1 - bottom, left, 1 - top, right))
        .otherwise(pick(left, top, right, bottom))
    )
