"""Problem 3: saved reports whose fields drift, as one table and a list of changes.

Each report is profiled once (paths, types, value sketches by frame). Reports are chained to the
one before them in their folder; a pair is compared by structure first, and only pairs in which
a field went while one of the same parent and type came have their value sketches joined to
solve the renames by bipartite matching."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotarium.functions import jsonfields as J
from fotarium.operators.ranges import with_previous
from fotarium.session import materialize, only

PROFILE = "report_id bigint, dir string, generated_at timestamp_ntz, types array<struct<path:string,type:string>>, sketches array<struct<path:string,holders:array<bigint>,hashes:array<bigint>>>"
PAIR = "report_id bigint, before_id bigint, side int, path string, type string, change string, field_before string, field_after string"
CHANGES = "report_id bigint, change string, field_before string, field_after string"
NAMES = "a string, name string"
VALUES = "report_id bigint, dir string, generated_at timestamp_ntz, frame string, field string, type string, value string"


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _emit(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def profiles(reports: DataFrame) -> DataFrame:
    """One row per readable report: its fields with types, and the value sketch of each field."""
    schema = _arrow(PROFILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                doc = J.parse(r.pop("raw"))
                if doc is not None:
                    fields = J.profile(doc)
                    rows.append({**r, "types": [{"path": f["path"], "type": f["type"]} for f in fields], "sketches": fields})
            yield _emit(schema, rows)

    known = only(reports, "report_id", "dir", "generated_at", "raw").filter(F.col("report_id").isNotNull()).select("report_id", "dir", F.col("generated_at").cast("timestamp_ntz"), "raw")
    found = known.mapInArrow(run, PROFILE)
    same = [c for c in found.columns if c != "report_id"]
    return found.groupBy("report_id").agg(F.first(F.struct(*same)).alias("r")).select("report_id", "r.*")


def _structure(chained: DataFrame) -> DataFrame:
    """Changes that need no values, and rows (side 0 old, 1 new) of the fields that do."""
    schema = _arrow(PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                before, after = ({f["path"]: f["type"] for f in r[k]} for k in ("types_before", "types"))
                retyped, gone, new = J.structural(before, after)
                base = dict.fromkeys(schema.names) | {"report_id": r["report_id"], "before_id": r["before_id"]}
                old_kinds, new_kinds = {(J.parent(p), before[p]) for p in gone}, {(J.parent(p), after[p]) for p in new}
                rows += [base | {"change": c, "field_before": x, "field_after": y} for c, x, y in retyped]
                for side, paths, kinds, others in ((0, gone, before, new_kinds), (1, new, after, old_kinds)):
                    for p in paths:
                        if (J.parent(p), kinds[p]) in others:
                            rows.append(base | {"side": side, "path": p, "type": kinds[p]})
                        else:
                            rows.append(base | {"change": ("removed", "added")[side], "field_before": ("", p)[side == 0], "field_after": ("", p)[side]})
            yield _emit(schema, rows)

    return chained.mapInArrow(run, PAIR)


def _match(grouped: DataFrame) -> DataFrame:
    schema = _arrow(CHANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                gone, new = (sorted((f["path"], f["type"], dict(zip(f["holders"] or [], f["hashes"] or [], strict=True))) for f in r["fields"] if f["side"] == side) for side in (0, 1))
                pairs = J.renames(gone, new)
                left, right = {p for p, _ in pairs}, {q for _, q in pairs}
                found = [("renamed", p, q) for p, q in pairs]
                found += [("removed", p, "") for p, *_ in gone if p not in left] + [("added", "", q) for q, *_ in new if q not in right]
                rows += [{"report_id": r["report_id"], "change": c, "field_before": x, "field_after": y} for c, x, y in found]
            yield _emit(schema, rows)

    return grouped.mapInArrow(run, CHANGES)


def field_changes(reports: DataFrame) -> DataFrame:
    """(report_id, change, field_before, field_after): every change against the report before.

    "Before" is by generated_at, then report_id, within a dir; rows with a null dir form a folder
    of their own. Torn documents, documents that are no object, and null or empty texts are no
    reports. Rows delivered more than once count once. A path with several types in one report
    has its most frequent one. The first report of a folder, unchanged reports and empty tables
    give no rows."""
    known = materialize(profiles(reports), "profiles")
    chain = known.select("report_id", "dir", "generated_at", "types")
    chain = with_previous(chain, ["dir"], ["generated_at", "report_id"], {"before_id": "report_id", "types_before": "types"}, "chain")
    chain = chain.filter(F.col("before_id").isNotNull() & (F.col("types") != F.col("types_before")))
    diffs = materialize(_structure(chain.select("report_id", "before_id", "types", "types_before")), "structure")
    plain = diffs.filter(F.col("change").isNotNull()).select("report_id", "change", "field_before", "field_after")
    open_ = diffs.filter(F.col("change").isNull()).withColumn("holder_id", F.when(F.col("side") == 0, F.col("before_id")).otherwise(F.col("report_id")))
    need = open_.select("holder_id").distinct()
    sketches = known.select(F.col("report_id").alias("holder_id"), "sketches").join(need, "holder_id", "left_semi").select("holder_id", F.inline("sketches"))
    fields = open_.select("report_id", "holder_id", "side", "path", "type").join(sketches, ["holder_id", "path"], "left")
    grouped = fields.groupBy("report_id").agg(F.collect_list(F.struct("side", "path", "type", "holders", "hashes")).alias("fields"))
    return plain.unionByName(_match(grouped))


def field_values(reports: DataFrame) -> DataFrame:
    """(report_id, dir, generated_at, frame, field, type, value) of every leaf field as it was written;
    `frame` is '' for the run itself, `value` the JSON text of the value."""
    schema = _arrow(VALUES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                doc = J.parse(r.pop("raw"))
                for path, kind, holder, value in J.walk(doc) if doc is not None else ():
                    if kind != "object" and not (kind == "array" and any(isinstance(x, dict) for x in value)):
                        rows.append({**r, "frame": holder, "field": path, "type": kind, "value": J.canonical(value)})
                if len(rows) > 50_000:
                    yield _emit(schema, rows)
                    rows = []
            yield _emit(schema, rows)

    known = only(reports, "report_id", "dir", "generated_at", "raw").filter(F.col("report_id").isNotNull()).dropDuplicates(["report_id"])
    return known.select("report_id", "dir", F.col("generated_at").cast("timestamp_ntz"), "raw").mapInArrow(run, VALUES)


def _names(facts: DataFrame) -> DataFrame:
    """(a, name) of the fields that come under another name, from rows (kind, names, n): `pair` the two
    names of a rename with its reports, `held` names that stand in one frame, `use` a name with its
    reports, `field` a field to be named. All are distinct names, so one task takes them."""
    schema = _arrow(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        of = {kind: [(r["names"], r["n"]) for r in rows if r["kind"] == kind] for kind in ("pair", "held", "use", "field")}
        named = J.one_name([(*names, n) for names, n in of["pair"]], [names for names, _ in of["held"]], {names[0]: n for names, n in of["use"]})
        fields = [(names[0], named(names[0])) for names, _ in of["field"]]
        yield _emit(schema, [{"a": a, "name": name} for a, name in fields if name != a])

    return facts.repartition(1).mapInArrow(run, NAMES)


def unified_reports(reports: DataFrame, changes: DataFrame | None = None, least: int = 1) -> DataFrame:
    """All runs and frames as one long table under one name per field.

    All names that a field (or an object above it) was renamed between in at least `least` reports,
    in either direction and over any number of steps, become the name that most reports use, then
    the first by alphabet. Only names that some frame holds side by side are two fields: where
    renames would join them, the ones that more reports made hold. Text numbers and text booleans
    of a field whose usual type is number or boolean come as such; `type_written` keeps what stood
    there. A value that can't be read as the usual type keeps its own."""
    changes = field_changes(reports) if changes is None else changes
    values = materialize(field_values(reports), "values")
    pair = F.sort_array(F.array("field_before", "field_after"))
    pairs = changes.filter("change = 'renamed'").groupBy(pair.alias("names")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    pairs = materialize(pairs, "renames")
    # a rename of an object carries over to the fields below it
    parts = F.split("field", r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.regexp_replace(F.array_join(F.slice(parts, 1, i), "."), r"\[\]$", ""))
    below = values.select("field").distinct().select("field", F.explode(heads).alias("path")).join(pairs.select(F.explode("names").alias("path")).distinct(), "path")
    below = materialize(below, "renamed-fields")
    held = values.select("report_id", "frame", "field").join(below, "field").groupBy("report_id", "frame").agg(F.sort_array(F.collect_set("path")).alias("names"))
    held = materialize(held.groupBy("report_id", "names").agg(F.lit(1).alias("n")), "renamed-held")
    use = held.select("report_id", F.explode("names").alias("path")).groupBy("path").agg(F.countDistinct("report_id").alias("n"))
    facts = [
        pairs.select(F.lit("pair").alias("kind"), "names", "n"), held.select(F.lit("held").alias("kind"), "names", F.lit(0).alias("n")).distinct(),
        use.select(F.lit("use").alias("kind"), F.array("path").alias("names"), "n"), below.select(F.lit("field").alias("kind"), F.array("field").alias("names"), F.lit(0).alias("n")).distinct(),
    ]
    names = _names(reduce(DataFrame.unionByName, facts))
    out = values.join(names, values["field"] == names["a"], "left").withColumn("field", F.coalesce("name", "field")).drop("a", "name")
    usual = out.groupBy("field", "type").agg(F.count(F.lit(1)).alias("c")).groupBy("field").agg(F.max_by("type", F.struct("c", "type")).alias("usual"))
    out = out.join(usual, "field", "left")
    text = F.regexp_extract(F.col("value"), r'^"(.*)"$', 1)
    number = F.when((F.col("usual") == "number") & (F.col("type") == "string"), text.try_cast("double").cast("string"))
    truth = F.when((F.col("usual") == "boolean") & (F.col("type") == "string") & F.lower(text).isin("true", "false"), F.lower(text))
    unified = F.coalesce(number, truth)
    return out.select("report_id", "dir", "generated_at", "frame", "field", F.when(unified.isNotNull(), F.col("usual")).otherwise(F.col("type")).alias("type"), F.col("type").alias("type_written"), F.coalesce(unified, "value").alias("value"))


def _wide(unified: DataFrame, below: bool, most: int) -> DataFrame:
    keys = ["report_id", "dir", "generated_at", *(["frame"] if below else [])]
    rows = unified.filter((F.col("frame") != "") if below else (F.col("frame") == ""))
    kinds = rows.groupBy("field", "type").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy("field").agg(F.max_by("type", F.struct("n", "type")).alias("type"), F.sum("n").alias("n"))
    heads = sorted(tuple(r) for r in kinds.orderBy(F.col("n").desc(), "field").limit(most).select("field", "type").collect())
    typed = {"number": "double", "boolean": "boolean"}
    cells, taken = [], {k.lower() for k in keys} | {"rest"}
    for field, kind in heads:
        name = field.removeprefix("results[].").replace("[]", "").replace(".", "_")
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        of = (F.col("field") == field) & (F.col("type") == kind)
        text = F.when(F.col("type") == "string", F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")).otherwise(F.col("value"))
        value = F.min(F.when(of, text.try_cast(typed[kind]) if kind in typed else text))
        cells.append(value.alias(name))
    known = F.array(*[F.lit(f"{f}\0{k}") for f, k in heads]).cast("array<string>")
    other = ~F.array_contains(known, F.concat_ws("\0", "field", "type"))
    rest = F.map_from_entries(F.array_sort(F.array_distinct(F.collect_list(F.when(other, F.struct(F.concat_ws(" ", "field", "type").alias("k"), F.col("value").alias("v")))))))
    least = rows.groupBy(*keys, "field", "type").agg(F.min("value").alias("value"))
    return least.groupBy(*keys).agg(*cells, rest.alias("rest"))


def report_runs(unified: DataFrame, most: int = 200) -> DataFrame:
    """One row per run from unified_reports(): a typed column for each of the `most` fields that most runs
    have (numbers as double, booleans, text; arrays as JSON text), named by their paths with `_`, and
    `rest`: a map of all other fields, and of values of another type than the column's, as they stand."""
    return _wide(unified, False, most)


def report_frames(unified: DataFrame, most: int = 200) -> DataFrame:
    """One row per frame of a run, in the same form. Elements of arrays without a `file` have a frame of their
    own named by their place; where a file stands in several results of a run, the least value counts."""
    return _wide(unified, True, most)
