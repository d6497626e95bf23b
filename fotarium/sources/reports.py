"""Saved reports and logs as tables: explicit schemas, version gates, torn lines."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fotarium.functions.scalars import keywords
from fotarium.operators.ranges import with_rank
from fotarium.session import materialize

#: The newest schema version that is understood.
SCHEMA_VERSION = 4
# `best` was a name up to version 3 and is a boolean since: it is read as text.
GROUP = "struct<id:bigint,size:bigint,rank:bigint,of:bigint,by:string,best:string>"
REPORT = f"schema_version int, generated string, backend string, model string, keep_best string, results array<struct<file:string,size:bigint,decision:string,keywords:array<string>,group:{GROUP}>>"
LABEL = "file string, label string, stars int, ev double, at string, from string"


def parsed(files: DataFrame, raw: str = "raw", newer: str = "fail") -> DataFrame:
    """(report_id, dir, generated_at, doc): readable documents, each once.

    Torn documents are left out; unreadable() lists them. A document of a newer version than is understood is
    an error (`newer="skip"`: left out); one without a version counts as of the first. A field of
    another type than declared is null."""
    doc = F.from_json(F.col(raw), REPORT, {"mode": "PERMISSIVE"})
    whole = F.expr(f"try_parse_json(`{raw}`)").isNotNull()
    rows = files.filter(whole).select("report_id", "dir", "generated_at", doc.alias("doc"))
    known = F.coalesce("doc.schema_version", F.lit(0)) <= SCHEMA_VERSION
    if newer == "fail":
        known = F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("newer report version: "), F.col("doc.schema_version").cast("string"), F.lit(" of report "), F.col("report_id").cast("string"))).cast("boolean"))
    rows = rows.filter(known)
    return rows.groupBy("report_id").agg(F.first(F.struct("dir", "generated_at", "doc")).alias("r")).select("report_id", "r.*")


def unreadable(files: DataFrame, raw: str = "raw") -> DataFrame:
    return files.filter(F.expr(f"try_parse_json(`{raw}`)").isNull() | (F.from_json(F.col(raw), "schema_version int")["schema_version"] > SCHEMA_VERSION))


def runs(files: DataFrame) -> DataFrame:
    """(report_id, dir, schema_version, backend, model, n_results)."""
    return parsed(files).select("report_id", "dir", "doc.schema_version", "doc.backend", "doc.model", F.coalesce(F.size("doc.results"), F.lit(0)).alias("n_results"))


def frames(files: DataFrame) -> DataFrame:
    """One row per result of each report; before version 4, groups are dropped, as their members and `best`
    meant something else then."""
    rows = parsed(files).select("report_id", "doc.schema_version", F.explode("doc.results").alias("r"))
    now = F.col("schema_version") >= 4
    best = F.when(F.col("r.group.best").isin("true", "false"), F.col("r.group.best") == "true").otherwise(False)
    return rows.select("report_id", "r.file", "r.decision", F.when(now, F.col("r.group.rank")).alias("rank"), F.when(now & F.col("r.group").isNotNull(), best).alias("best"))


def numbered_lines(spark: SparkSession, path: str, torn: bool = True) -> DataFrame:
    """(pos, line) of a text file, numbered from 1, read in splits and numbered in order by range partitions.
    `torn=False` leaves out a last line that has no line end (its writer was stopped)."""
    text = spark.read.text(path, lineSep="\n").select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    numbered = with_rank(materialize(text, "lines"), ["_block", "_at"], "lines", "pos").select((F.col("pos") + 1).alias("pos"), "line")
    if torn or _ends_whole(spark, path):
        return numbered
    return numbered.filter(F.col("pos") < F.lit(numbered.agg(F.max("pos")).first()[0]))


def _ends_whole(spark: SparkSession, path: str) -> bool:
    """Whether a file is empty or its last byte is a line end."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getFileStatus(place).getLen()
    if not size:
        return True
    stream = fs.open(place)
    stream.seek(size - 1)
    last = stream.read()
    stream.close()
    return last == 10


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """A labels log (JSON lines) as (log_id, file, label, stars, ev, at, from): blank lines are skipped, a last
    line without its line end is torn and ignored, any other bad line is an error with its number."""
    rows = numbered_lines(spark, path, torn=False).filter(F.trim("line") != "")
    entry = F.from_json("line", LABEL, {"mode": "PERMISSIVE"})
    bad = F.raise_error(F.concat(F.lit("bad label entry in line "), F.col("pos").cast("string")))
    whole = F.expr("try_parse_json(line)").isNotNull()
    rows = rows.select(F.col("pos").alias("log_id"), F.when(whole & entry["file"].isNotNull(), entry).otherwise(bad).alias("e"))
    return rows.select("log_id", "e.*")


def manifest_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An offload manifest (JSON lines) with its line numbers: lines that can't be read or have no name are
    skipped."""
    rows = numbered_lines(spark, path).filter(F.expr("try_parse_json(line)").isNotNull()).select(F.col("pos").alias("entry_id"), F.from_json("line", schema).alias("e")).select("entry_id", "e.*")
    return rows.filter(F.coalesce("name", F.lit("")) != "")


def listing(spark: SparkSession, path: str, sorted_into: tuple[str, ...] = ("keep", "review", "cull", "culled")) -> DataFrame:
    """(path, size, mtime_us) of the raw files under a folder, without hidden files and folders and those
    already sorted; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][nN][gG]").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime_us"))
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    above = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    inner = F.split(F.substring_index(F.col("path"), above + "/", -1), "/")  # only what is below the folder counts
    folders = F.slice(inner, 1, F.size(inner) - 1)
    return files.filter(~F.exists(inner, lambda x: F.startswith(x, F.lit("."))) & ~F.coalesce(F.arrays_overlap(folders, F.array(*[F.lit(x) for x in sorted_into])), F.lit(False)))


def card_scan(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(root, path, size, mtime_us) of the raw files of several cards, `root` being the place of the card in the
    list: the order of cards comes before the order on one."""
    found = [listing(spark, r, ()).select(F.lit(i).alias("root"), "path", "size", "mtime_us") for i, r in enumerate(roots)]
    return reduce(DataFrame.unionByName, found)


def shoot_files(spark: SparkSession, path: str, places: tuple[str, ...] = ("keep", "review", "cull", "culled")) -> DataFrame:
    """(path, size, mtime_us, place): a folder's own frames (place '') and those sorted into folders of it."""
    every = listing(spark, path, ()).withColumn("place", F.element_at(F.split("path", "/"), -2))
    return every.withColumn("place", F.when(F.col("place").isin(*places), F.col("place")).otherwise(""))


# Fixed value: the shape of an assessment as models answer it.
EVALUATION = "sharpness struct<score:double,status:string>, exposure struct<score:double,status:string,ev_adjust:double>, composition struct<score:double,status:string,crop:struct<apply:boolean,left:double,top:double,right:double,bottom:double>>, people struct<present:boolean,eyes:string,expression:string>, notes string, keywords array<string>"


def decoded_evaluation(answer: Column) -> Column:
    """An assessment from a model's JSON, its keywords cleaned; null for no JSON object."""
    value = F.from_json(answer, EVALUATION, {"mode": "PERMISSIVE"})
    known = F.try_parse_json(answer).isNotNull() & F.startswith(F.trim(answer), F.lit("{"))
    return F.when(known, value.withField("keywords", keywords(F.filter(value["keywords"], lambda w: w.isNotNull()))))


def batch_results(spark: SparkSession, path: str) -> DataFrame:
    """(custom_id, state, message) of a results file (JSON lines) of an asynchronous batch."""
    rows = spark.read.schema("custom_id string, result struct<type:string,error:struct<message:string>>").json(path, mode="DROPMALFORMED")
    kind = F.col("result.type")
    return rows.select("custom_id", F.when(kind.isin("succeeded", "errored"), kind).otherwise("other").alias("state"), F.col("result.error.message").alias("message"))


def first_object(text: str | None) -> str | None:
    """The first complete `{...}` in a text, aware of strings and escapes; None if there is none."""
    start = depth = 0
    inside = escaped = False
    for i, c in enumerate(text or ""):
        if depth and inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
        elif depth and c == '"':
            inside = True
        elif c == "{":
            if depth == 0:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
    return None


def with_first_object(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the first JSON object of a text column (brace matching is not a regular language)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rest = [c for c in df.columns if c != out]
    fields = df.select(*[F.col(f"`{c}`") for c in rest]).schema.add(out, "string")
    schema = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([first_object(t) for t in batch.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], found], schema=schema)

    return df.mapInArrow(run, fields)


