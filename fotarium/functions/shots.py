"""Expressions over single frames: clamps and crops, predicates, tags, squares, camera and exposure texts, answers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fotarium.functions.scalars import box_valid, clamp, round_half_away

# Statuses of an assessment.
DOUBTFUL = ("soft", "missed_focus", "motion_blur")
CROP_AREA = 0.6


def score_clamped(score: Column) -> Column:
    return clamp(score, 0.0, 10.0)


def ev_clamped(ev: Column) -> Column:
    return clamp(ev, -4.0, 4.0)


def crop_kept(left: Column, top: Column, right: Column, bottom: Column, least: float = CROP_AREA) -> Column:
    """Whether a crop stands: valid, and at least this share of the frame."""
    return box_valid(left, top, right, bottom) & F.coalesce((right - left) * (bottom - top) >= least, F.lit(False))


def rankable(evaluated: Column, decision: Column) -> Column:
    return evaluated & ~decision.eqNullSafe("cull")


def kept_result(error: Column, evaluated: Column, dry_run: Column, junk: Column) -> Column:
    """Whether a resumed run carries a result over: no error, and assessed, measured only, or junk."""
    return (F.coalesce(error, F.lit("")) == "") & (evaluated | dry_run | junk)


def doubtful(status: Column) -> Column:
    return F.coalesce(status.isin(*DOUBTFUL), F.lit(False))


def escalates(status: Column, eyes: Column, wanted: tuple[str, ...]) -> Column:
    """Whether an assessment goes to the second model: by its sharpness status, or `eyes_closed` for closed eyes."""
    closed = (eyes == "closed") & F.lit("eyes_closed" in wanted)
    return F.coalesce(status.isin(*wanted), F.lit(False)) | F.coalesce(closed, F.lit(False))


def other_statuses(first: Column, second: Column) -> Column:
    """The sharpness statuses of the other assessments, the first pass before the second opinion."""
    return F.filter(F.array(first, second), lambda s: s.isNotNull())


def merged_tags(stored: Column, given: Column) -> Column:
    """Tags (project, event, location, keywords) given over stored ones, field by field; a given list replaces the
    stored one. All empty: null."""
    field = lambda n: F.coalesce(F.nullif(given[n], F.lit("")), F.nullif(stored[n], F.lit("")))
    words = F.when(F.size(given["keywords"]) > 0, given["keywords"]).when(F.size(stored["keywords"]) > 0, stored["keywords"])
    fields = [field(n) for n in ("project", "event", "location")]
    return F.when(F.coalesce(*fields, F.array_join(words, "|")).isNotNull(), F.struct(*[c.alias(n) for c, n in zip(fields, ("project", "event", "location"), strict=True)], words.alias("keywords")))


def tag_words(tags: Column) -> Column:
    """Tags as plain keywords: project, event and location, then each keyword."""
    head = F.filter(F.array(tags["project"], tags["event"], tags["location"]), lambda v: v != "")
    return F.concat(head, F.coalesce(tags["keywords"], F.array().cast("array<string>")))


def tag_paths(tags: Column) -> Column:
    """Tags as keyword paths: `project|value` and so on."""
    return F.filter(F.array(*[F.when(tags[n] != "", F.concat(F.lit(n + "|"), tags[n])) for n in ("project", "event", "location")]), lambda v: v.isNotNull())


def tag_problem(value: Column) -> Column:
    """`level` for a tag with `|`, `marker` for one in the name space of verdicts; else null."""
    return F.when(F.contains(value, F.lit("|")), "level").when(F.startswith(F.lower(value), F.lit("cull:")), "marker")


def to_fractions(box: tuple[Column, Column, Column, Column], width: Column, height: Column) -> Column:
    """A pixel box as fractions of the frame, four places."""
    sides = [round_half_away(c / n, 4) for c, n in zip(box, (width, height, width, height), strict=True)]
    return F.struct(*[c.alias(n) for c, n in zip(sides, ("left", "top", "right", "bottom"), strict=True)])


def to_pixels(box: tuple[Column, Column, Column, Column], width: Column, height: Column) -> Column:
    """A box of fractions in pixels: left and top cut off, right and bottom rounded up."""
    whole = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))
    left, top, right, bottom = box
    return F.struct(whole(left * width).alias("left"), whole(top * height).alias("top"), F.ceil(right * width).alias("right"), F.ceil(bottom * height).alias("bottom"))


def square(x: Column, y: Column, side: Column, width: Column, height: Column) -> Column:
    """A square around a point, moved into the frame, and smaller only if the frame is."""
    s = F.least(side, width, height).cast("bigint")
    half = F.floor(s / 2)
    left, top = F.least(F.greatest(x - half, F.lit(0)), width - s), F.least(F.greatest(y - half, F.lit(0)), height - s)
    return F.struct(left.alias("left"), top.alias("top"), (left + s).alias("right"), (top + s).alias("bottom"))


def subject_square(x: Column, y: Column, size: Column, width: Column, height: Column, least: int = 768, most: int = 1536) -> Column:
    return square(x, y, F.least(F.greatest(size, F.lit(least)), F.lit(most)), width, height)


def eye_squares(pupils: Column, size: Column, width: Column, height: Column) -> Column:
    """A square of 0.3 of the face (32 pixels at least) around each pupil (an array of structs x, y)."""
    side = F.greatest(F.lit(32), F.floor(size * 0.3))
    return F.transform(pupils, lambda p: square(p["x"], p["y"], side, width, height))


def _first_word(text: Column) -> Column:
    return F.rtrim(F.regexp_extract(text, r"^\s*(\S*)", 1), F.lit(",."))


def camera_text(make: Column, model: Column, rangefinder: str = r"(?i)^leica m(\d|[\s-]|$)") -> Column:
    """The camera with an article for a prompt: brand and model, the brand once; null if neither is known."""
    mk, md = F.coalesce(F.trim(make), F.lit("")), F.coalesce(F.trim(model), F.lit(""))
    same = (mk == "") | (F.lower(_first_word(mk)) == F.lower(_first_word(md)))
    name = F.when(md == "", F.concat(_first_word(mk), F.lit(" camera"))).when(same, md).otherwise(F.concat(_first_word(mk), F.lit(" "), md))
    name = F.when(F.regexp_like(name, F.lit(rangefinder)), F.concat(name, F.lit(" rangefinder (manual focus, often fast lenses shot wide open)"))).otherwise(name)
    article = F.when(F.regexp_like(name, F.lit("^[AEIOUaeiou]")), "an ").otherwise("a ")
    return F.when((mk == "") & (md == ""), "a digital camera").otherwise(F.concat(article, name))


def number_text(x: Column) -> Column:
    """A number in its shortest decimal form, without a fraction if it is whole."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def exposure_text(exposure: Column, iso: Column, lens: Column, aperture: Column | None = None, estimated: Column | None = None, focal: Column | None = None) -> Column:
    """Exposure time, aperture, ISO, focal length and lens in one line, without what is missing."""
    time = F.when(exposure <= 0, F.lit(None)).when(exposure < 1, F.format_string("1/%d s", F.floor(1 / exposure + 0.5).cast("bigint"))).otherwise(F.concat(number_text(round_half_away(exposure, 2)), F.lit(" s")))
    stop = F.lit(None).cast("string")
    if aperture is not None:
        guess = F.coalesce(estimated, F.lit(False)) if estimated is not None else F.lit(False)
        stop = F.when(aperture > 0, F.when(guess, F.format_string("~f/%.1f (camera estimate)", aperture)).otherwise(F.concat(F.lit("f/"), number_text(aperture))))
    length = F.lit(None).cast("string") if focal is None else F.when(focal > 0, F.concat(number_text(focal), F.lit(" mm")))
    return F.concat_ws(", ", time, stop, F.when(iso > 0, F.concat(F.lit("ISO "), iso.cast("string"))), length, F.nullif(lens, F.lit("")))


def locate_outcome(failed: Column, confident: Column, kind: Column, valid: Column) -> Column:
    """Why a subject search gave no target, in the order in which it is judged; null if it gave one."""
    return (
        F.when(failed.isNotNull(), F.concat(F.lit("locate failed: "), failed)).when(confident.isNull() & kind.isNull(), "locate failed: no result")
        .when(~F.coalesce(confident, F.lit(False)) | kind.eqNullSafe("none"), "model: no clear subject").when(~F.coalesce(valid, F.lit(False)), "model: invalid box")
    )


def once_more(notes: Column, note: Column) -> Column:
    """Notes with one more, unless it is there or null."""
    return F.when(note.isNull(), notes).otherwise(F.array_distinct(F.array_append(F.coalesce(notes, F.array().cast("array<string>")), note)))


def redated(text: Column, old: str, new: str) -> Column:
    """A text with the day `old` (yyyy-mm-dd) as `new` where it stands as a whole date, with colons or dashes: the
    length stays, so it can be written in place."""
    for mark in (":", "-"):
        a, b = old.replace("-", mark), new.replace("-", mark)
        text = F.regexp_replace(text, rf"(?<!\d){re.escape(a)}(?!\d)", b)
    return text


def quoted_shell(text: Column) -> Column:
    """A text as one word of a shell: bare if it is plain, else in single quotes."""
    plain = F.regexp_like(text, F.lit(r"^[A-Za-z0-9_./:@%+=,-]+$"))
    return F.when(plain, text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def quoted_script(text: Column) -> Column:
    """A text as a string of a script: backslashes and quotes escaped, line ends as `\\n`."""
    for raw, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(written))
    return F.concat(F.lit('"'), text, F.lit('"'))


def pattern_problem(pattern: str) -> str | None:
    """Why a naming pattern can't be used; None if it can."""
    tokens = re.findall(r"\{(date|name|orig|n)(?::(\d+))?\}", pattern)
    rest = re.sub(r"\{(?:date|name|orig|n)(?::\d+)?\}", "", pattern)
    if not any(t in ("n", "orig") for t, _ in tokens):
        return "needs {n} or {orig}"
    if re.search(r"[/\\:]", rest):
        return "has a path separator or colon"
    if any(width and t != "n" for t, width in tokens):
        return "only {n} takes a width"
    if "{" in rest or "}" in rest:
        return "has an unknown token"
    return "is hidden" if pattern.startswith(".") else None


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "number": (int, float), "integer": (int, float), "null": type(None)}


def schema_problems(schema: dict, value: object, path: str = "") -> Iterator[str]:
    """What of a value breaks a JSON schema (type, enum, required, properties, additionalProperties, items)."""
    here, kind = path or "(root)", schema.get("type")
    if kind in _KINDS and (not isinstance(value, _KINDS[kind]) or (isinstance(value, bool) and kind in ("number", "integer")) or (kind == "integer" and value != int(value))):
        yield f"{here}: not {kind}"
        return
    if "enum" in schema and value not in schema["enum"]:
        yield f"{here}: not one of the allowed values"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        yield from (f"{here}: {k} is missing" for k in schema.get("required", ()) if k not in value)
        for k in sorted(value):
            if k in known:
                yield from schema_problems(known[k], value[k], f"{path}.{k}" if path else k)
            elif schema.get("additionalProperties") is False:
                yield f"{here}: {k} is unexpected"
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            yield from schema_problems(schema["items"], x, f"{path}[{i}]")


def schema_check(text: Column, schema: dict) -> Column:
    """The first problem of a JSON text against a schema, `invalid json` for what is none; null if it fits or is null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def first(t: str | None) -> str | None:
            if t is None:
                return None
            try:
                return next(schema_problems(schema, json.loads(t)), None)
            except (ValueError, RecursionError):
                return "invalid json"

        return texts.map(first)

    return run(text)


def answer_json(schema: dict) -> str:
    """A schema as JSON text with the order of its keys kept, as models read them in order."""
    return json.dumps(schema, ensure_ascii=False, separators=(",", ":"))
