"""Sinks: sidecar rows and texts, scripts, contact-sheet cards, move plans, reports, saved tables and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotarium.functions.scalars import base_name, box_from_display, keywords, xml_escape
from fotarium.functions.shots import number_text, quoted_script, tag_paths, tag_words
from fotarium.operators.logs import label_entry_ok

# Colour labels and tags of the verdicts.
COLOURS = {"keep": "Green", "review": "Yellow", "cull": "Red"}
COLOUR_TAGS = {"keep": 4, "review": 3, "cull": 1}
FOLDERS = ("keep", "review", "cull")
#: Attribute by which this engine's sidecars are known.
MARKER = 'x:xmptk="fotarium"'
NO_TEXTS = "array<string>"


def _has(df: DataFrame, path: str) -> bool:
    """Whether a (nested) column is there."""
    kind = df.schema
    for name in path.split("."):
        if not hasattr(kind, "fieldNames") or name not in kind.fieldNames():
            return False
        kind = kind[name].dataType
    return True


def date_taken(dates_set: Column, exif_time: Column) -> Column:
    """yyyy-mm-ddThh:mm:ss of the date that was set, else of the camera's; null for what is no time."""
    clock = r"([01]\d|2[0-3]):[0-5]\d:[0-5]\d"
    own = F.when(F.regexp_like(dates_set, F.lit(rf"^\d{{4}}-\d\d-\d\dT{clock}([.,]\d+)?$")), F.substring(dates_set, 1, 19))
    camera = F.when(F.regexp_like(exif_time, F.lit(rf"^\d{{4}}:\d\d:\d\d {clock}$")), F.concat(F.replace(F.substring(exif_time, 1, 10), F.lit(":"), F.lit("-")), F.lit("T"), F.substring(exif_time, 12, 8)))
    real = lambda t: F.when(F.substring(t, 1, 10).try_cast("date").isNotNull(), t)
    return F.coalesce(real(own), real(camera))


def columns(frames: DataFrame, develop: bool = False) -> DataFrame:
    """Frames (as logs.effective() gives them) with the columns of their sidecars: `rating` (null for no stars),
    `color`, `subjects` (marks of verdict, hand label and best of its set, then cleaned content keywords,
    then tags, each once), `hierarchy` (content and tags as paths), `taken`, `exposure` and `crop` (in
    the stored orientation). The exposure set by hand holds; `develop` adds the assessment's, if it
    says `fixable`, and its crop, but never for a frame with the verdict cull.

    `tags`, `best`, `dates_set`, `orientation` and `evaluation.composition.crop` are used where they are."""
    colour = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    best = F.coalesce(F.col("best"), F.lit(False)) if _has(frames, "best") else F.lit(False)
    marks = F.array(F.concat(F.lit("cull:"), F.col("verdict")), F.when(F.col("by_hand"), F.lit("cull:labeled")), F.when(best, F.lit("cull:best")))
    content = F.coalesce(keywords(F.filter("evaluation.keywords", lambda w: w.isNotNull())), F.array().cast(NO_TEXTS))
    words, paths = (F.coalesce(f(F.col("tags")), F.array().cast(NO_TEXTS)) if _has(frames, "tags") else F.array().cast(NO_TEXTS) for f in (tag_words, tag_paths))
    dates = F.col("dates_set") if _has(frames, "dates_set") else F.lit(None).cast("string")
    exposure, crop = F.col("hand_ev"), F.lit(None).cast("struct<left:double,top:double,right:double,bottom:double>")
    if develop:
        open_ = F.col("evaluation").isNotNull() & ~F.col("verdict").eqNullSafe("cull")
        exposure = F.coalesce(exposure, F.when(open_ & (F.col("evaluation.exposure.status") == "fixable"), F.col("evaluation.exposure.ev_adjust")))
        if _has(frames, "evaluation.composition.crop"):
            c = F.col("evaluation.composition.crop")
            turn = F.col("orientation") if _has(frames, "orientation") else F.lit(1)
            crop = F.when(open_ & c["apply"], box_from_display(turn, c["left"], c["top"], c["right"], c["bottom"]))
    return frames.withColumns({
        "rating": F.when(F.col("stars") > 0, F.col("stars")), "color": F.try_element_at(colour, F.coalesce("verdict", F.lit(""))),
        "subjects": F.array_distinct(F.concat(F.filter(marks, lambda m: m.isNotNull()), content, words)),
        "hierarchy": F.array_distinct(F.concat(F.transform(content, lambda k: F.concat(F.lit("content|"), k)), paths)),
        "taken": date_taken(dates, F.col("exif.date_time_original")), "exposure": exposure, "crop": crop,
    })


def text() -> Column:
    """The sidecar packet of a row of columns(), with attributes only for what is there."""
    attribute = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f'{name}="'), xml_escape(value), F.lit('"')))
    exposure, crop, taken = F.col("exposure"), F.col("crop"), F.col("taken")
    side = lambda n: attribute(f"crs:Crop{n.title()}", F.format_string("%.6f", crop[n]))
    cropped = lambda a: F.when(crop.isNotNull(), a)
    items = [
        attribute("xmp:Rating", F.col("rating").cast("string")), attribute("xmp:Label", F.col("color")),
        *[attribute(n, taken) for n in ("exif:DateTimeOriginal", "xmp:CreateDate", "photoshop:DateCreated")],
        F.when(exposure.isNotNull() | crop.isNotNull(), F.lit('crs:HasSettings="True"')), attribute("crs:Exposure2012", F.when(exposure.isNotNull(), F.format_string("%+.2f", exposure))),
        cropped(F.lit('crs:HasCrop="True"')), *[cropped(side(n)) for n in ("left", "top", "right", "bottom")], cropped(F.lit('crs:CropAngle="0"')),
    ]
    spaces = {"xmp": "http://ns.adobe.com/xap/1.0/", "dc": "http://purl.org/dc/elements/1.1/", "crs": "http://ns.adobe.com/camera-raw-settings/1.0/", "lr": "http://ns.adobe.com/lightroom/1.0/", "exif": "http://ns.adobe.com/exif/1.0/", "photoshop": "http://ns.adobe.com/photoshop/1.0/"}

    def bag(tag: str, values: str) -> Column:
        each = F.array_join(F.transform(values, lambda s: F.concat(F.lit("<rdf:li>"), xml_escape(s), F.lit("</rdf:li>"))), "")
        return F.when(F.size(values) > 0, F.concat(F.lit(f"<{tag}><rdf:Bag>"), each, F.lit(f"</rdf:Bag></{tag}>"))).otherwise(F.lit(""))

    head = f'<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/" {MARKER}>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n<rdf:Description rdf:about="" ' + " ".join(f'xmlns:{k}="{v}"' for k, v in spaces.items())
    attributes = F.concat_ws(" ", *items)
    return F.concat(F.lit(head), F.when(attributes != "", F.concat(F.lit(" "), attributes)).otherwise(F.lit("")), F.lit(">"), bag("dc:subject", "subjects"), bag("lr:hierarchicalSubject", "hierarchy"), F.lit('</rdf:Description>\n</rdf:RDF>\n</x:xmpmeta>\n<?xpacket end="w"?>\n'))


def sidecar_path(path: Column) -> Column:
    """The sidecar beside a file: its extension as .xmp."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".xmp"))


def sidecar_conflicts(planned: DataFrame, existing: DataFrame, recorded: DataFrame) -> DataFrame:
    """Rows of `planned` (path) whose sidecar is there already (`existing`: path, head) and is foreign: neither recorded as
    this engine's nor marked so in its first 4096 characters."""
    foreign = existing.filter(~F.contains(F.substring(F.coalesce("head", F.lit("")), 1, 4096), F.lit(MARKER))).select("path").join(recorded.select("path").distinct(), "path", "left_anti")
    return planned.join(foreign.distinct(), "path", "left_semi")


def script_rows(frames: DataFrame) -> DataFrame:
    """(frame_id, script): for every row of columns() with a verdict or stars and no error, the commands that set rating,
    colour tag, keywords and exposure on the images of that name in a photo catalog. Exposures set by hand
    hold; an assessment's goes only over the default."""
    tag = F.create_map(*[F.lit(x) for pair in COLOUR_TAGS.items() for x in pair])
    name, where = base_name(F.col("file")), F.coalesce(F.nullif("moved_to", F.lit("")), F.col("file"))
    bare = F.regexp_replace(name, r"\.[^.]*$", "")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\n"))
    words = F.array_join(F.transform("subjects", lambda k: line("apply keyword ", quoted_script(k), " to v")), "")
    fixable = (F.col("evaluation.exposure.status") == "fixable") & F.col("hand_ev").isNull()
    parts = [
        line("-- ", F.regexp_replace(name, r"[\r\n]", " "), ": ", F.coalesce("verdict", F.lit("")), F.when(F.col("by_hand"), " (yours)").otherwise(" (model)")),
        line("repeat with v in matching images (", quoted_script(where), ", ", quoted_script(name), ", ", quoted_script(bare), ")"),
        F.when(F.col("rating").isNotNull(), line("set rating of v to ", F.col("rating").cast("string"))),
        F.when(F.col("color").isNotNull(), line("set color tag of v to ", F.try_element_at(tag, F.col("verdict")).cast("string"))), words,
        F.when(F.col("hand_ev").isNotNull(), line("set exposure of v to ", number_text(F.col("hand_ev")))),
        F.when(fixable, line("if exposure of v is 0 then set exposure of v to ", number_text(F.col("evaluation.exposure.ev_adjust")))), line("end repeat"),
    ]
    known = frames.filter((F.coalesce("error", F.lit("")) == "") & (F.col("verdict").isNotNull() | F.col("rating").isNotNull()))
    return known.select("frame_id", F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).alias("script"))


def cards(frames: DataFrame, sets: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """(frame_id, card): the JSON card of each frame for a contact sheet. With `sets` (keys, set_id, by, summary) and
    frames that have `set_id` and `rank`, a card has them, and the summary of a set ranked by the model
    (one ranked by scores may carry one of an earlier order). A repeated set takes its least summary."""
    fields = [F.col("frame_id").alias("id"), base_name(F.col("file")).alias("name"), F.col("file").alias("path"), F.col("verdict"), F.col("by_hand"), F.col("stars"), F.nullif("error", F.lit("")).alias("error"), F.nullif("moved_to", F.lit("")).alias("moved_to")]
    if sets is not None:
        on = [*(keys or []), "set_id"]
        named = sets.filter(F.col("by") == "model").groupBy(*on).agg(F.min("summary").alias("_summary"))
        frames = frames.join(named, on, "left")
        fields += [F.col("set_id").alias("set"), F.col("rank"), F.col("_summary").alias("set_summary")]
    return frames.select("frame_id", F.to_json(F.struct(*fields)).alias("card"))


def move_plan(frames: DataFrame, mode: str = "sorted", verdict: str = "decision") -> DataFrame:
    """(frame_id, source, target): the moves that bring every frame where `mode` wants it: `sorted` by verdict into
    folders, `culls` only those of the verdict cull, `home` none. A frame that belongs in no folder goes
    back home; frames with an error stay."""
    wanted = {"sorted": FOLDERS, "culls": ("cull",), "home": ()}[mode]
    place = F.when(F.col(verdict).isin(*wanted), F.col(verdict)) if wanted else F.lit(None).cast("string")
    here = F.coalesce(F.nullif("moved_to", F.lit("")), F.col("file"))
    head, base = F.regexp_extract("file", r"^(.*/)?([^/]*)$", 1), base_name(F.col("file"))
    target = F.when(place.isNull(), F.col("file")).otherwise(F.concat(head, place, F.lit("/"), base))
    ok = (F.coalesce("error", F.lit("")) == "") & target.isNotNull()
    return frames.filter(ok).select("frame_id", here.alias("source"), target.alias("target")).filter(~F.col("source").eqNullSafe(F.col("target")))


def restore_plan(frames: DataFrame) -> DataFrame:
    """(frame_id, source, target): every frame that was moved, back to its own path."""
    return frames.filter(F.nullif("moved_to", F.lit("")).isNotNull() & F.col("file").isNotNull()).select("frame_id", F.col("moved_to").alias("source"), F.col("file").alias("target"))


def report_documents(runs: DataFrame, results: DataFrame, key: str, file: str = "file") -> DataFrame:
    """(key, document): each run with its results, sorted by file, as one JSON document. A document is one row by its
    nature, as it is one file."""
    inner = [c for c in results.columns if c != key]
    listed = results.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(file), *[c for c in inner if c != file]))).alias("results"))
    head = [c for c in runs.columns if c != key]
    return runs.join(listed, key, "left").select(key, F.to_json(F.struct(*head, F.coalesce("results", F.array().cast(listed.schema["results"].dataType)).alias("results"))).alias("document"))


def save(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A table as Parquet, sorted within files by `by` so that readers can skip; replaces what is there."""
    (df.sortWithinPartitions(*by) if by else df).write.mode("overwrite").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_labels(entries: DataFrame, path: str, order: list[str]) -> None:
    """Append label entries (file, label, stars, ev, ...) to a log table in order, with `log_id` going on from its last
    one. A bad entry is an error, and nothing is appended."""
    from fotarium.operators.ranges import with_rank

    ok = label_entry_ok(F.col("file"), F.col("label"), F.col("stars"), F.col("ev"))
    bad = entries.filter(~ok).select(F.min(F.coalesce("file", F.lit("(null)")))).first()[0]
    if bad is not None:
        raise ValueError(f"bad label entry for {bad}: nothing appended")
    try:
        last = entries.sparkSession.read.parquet(path).agg(F.max("log_id")).first()[0] or 0
    except Exception as e:  # no log yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = 0
    append_log(with_rank(entries.drop("log_id"), order, "labels", "log_id").withColumn("log_id", F.col("log_id") + last + 1), path)


def matrix_text(matrix: DataFrame, rates: DataFrame) -> str:
    """A confusion matrix and its rates as lines of text (three rows and one)."""
    rows = {r["label"]: r for r in matrix.collect()}
    lines = [f"{'label / decided':<16}" + "".join(f"{c:>9}" for c in FOLDERS)]
    lines += [f"{c:<16}" + "".join(f"{rows[c][d] if c in rows else 0:>9}" for d in FOLDERS) for c in FOLDERS]
    r = rates.first()
    return "\n".join([*lines, f"false culls {100 * r['false_cull']:.1f} %, missed culls {100 * r['missed_cull']:.1f} %, review {100 * r['review_share']:.1f} % of {r['n']}"])
