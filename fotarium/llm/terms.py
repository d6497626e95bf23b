"""Problem 1: how often every distinct term occurs, and in how many records.

Heavy-light aggregation: heavy terms, found by a frequent-items sketch over all records, are
broadcast and counted in exact local counter arrays, one row per task and term leaving the
task; only the other terms are shuffled. Both count tables are united at the end."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotarium.session import materialize, only

#: A term is heavy if the sketch sees at least this share of all uses, so there are at most 1 / share.
HEAVY_SHARE = 0.001
#: Counters of the sketch; it can miss no term of more than about 1 / (0.75 * SKETCH) of all uses.
SKETCH = 8192


def clean_term(text: str) -> str | None:
    """A keyword in NFC, blanks collapsed and trimmed, lower-case; None if it is no term: empty, over
    30 bytes, over three words, with a `|`, or in the reserved name space of decision marks."""
    words = unicodedata.normalize("NFC", text).split()
    term = " ".join(words).lower()
    if not words or len(words) > 3 or len(term.encode("utf-8", "surrogatepass")) > 30 or "|" in term or term.startswith("cull:"):
        return None
    return term


def record_terms(records: DataFrame, record_id: str, column: str, keywords: Column) -> DataFrame:
    """(terms): of each record once, the terms of its keywords in their order, repeats kept.

    `keywords` is an array of strings in (or of) the column named `column`.
    A record delivered more than once counts once; deliveries are alike, any of them is taken.
    Null records, null arrays and null elements have no terms; records with a null id don't
    count. Only the two columns are read, so others may have any name."""
    once = only(records, record_id, column).select(F.col(record_id).alias("id"), keywords.cast("array<string>").alias("words")).filter(F.col("id").isNotNull())
    once = once.groupBy("id").agg(F.first("words", ignorenulls=True).alias("words")).filter(F.size("words") > 0).select("words")
    out = pa.schema([("terms", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.ListArray.from_arrays(batch.column(0).offsets, batch.column(0).values.cast(pa.string())) if batch.num_rows else batch.column(0)
            if not batch.num_rows:
                continue
            flat = words.flatten()
            of_row = words.value_parent_indices().to_numpy(zero_copy_only=False)
            coded = flat.dictionary_encode()
            names = [None if w is None else clean_term(w) for w in coded.dictionary.to_pylist()]
            fits = np.array([n is not None for n in names] + [False], bool)
            codes = coded.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
            kept = fits[codes]
            terms = pa.array(names, pa.string()).take(pa.array(codes[kept]))
            ends = np.concatenate([[0], np.cumsum(np.bincount(of_row[kept], minlength=batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), terms)], schema=out)

    return once.mapInArrow(run, "terms array<string>").filter(F.size("terms") > 0)


def _heavy_counts(records: DataFrame, heavy: list[str]) -> DataFrame:
    """(term, uses, records) of the heavy terms: one row per term and task, from two counter arrays."""
    schema = pa.schema([("term", pa.string()), ("uses", pa.int64()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(heavy, pa.string())
        uses, held = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0)
            codes = pa.compute.index_in(lists.flatten(), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
            rows = lists.value_parent_indices().to_numpy(zero_copy_only=False)
            rows, codes = rows[codes >= 0].astype(np.int64), codes[codes >= 0]
            uses += np.bincount(codes, minlength=len(heavy))
            held += np.bincount(np.unique(rows * len(heavy) + codes) % len(heavy), minlength=len(heavy))
        if uses.any():
            yield pa.RecordBatch.from_arrays([names, pa.array(uses), pa.array(held)], schema=schema)

    return records.select("terms").mapInArrow(run, "term string, uses bigint, records bigint")


def _light_counts(records: DataFrame, heavy: list[str]) -> DataFrame:
    """(term, uses, records) of all other terms: one row per term and Arrow batch."""
    schema = pa.schema([("term", pa.string()), ("uses", pa.int64()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(heavy, pa.string())
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0)
            coded = lists.flatten().dictionary_encode()
            light = pa.compute.invert(pa.compute.is_in(coded.dictionary, value_set=names)).to_numpy(zero_copy_only=False)
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            rows = lists.value_parent_indices().to_numpy(zero_copy_only=False).astype(np.int64)
            n = len(coded.dictionary)
            uses, held = np.bincount(codes, minlength=n), np.bincount(np.unique(rows * n + codes) % n, minlength=n)
            at = pa.array(np.flatnonzero(light))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(at), pa.array(uses[light]), pa.array(held[light])], schema=schema)

    return records.select("terms").mapInArrow(run, "term string, uses bigint, records bigint")


def term_counts(records: DataFrame, heavy_share: float = HEAVY_SHARE, sketch: int = SKETCH) -> tuple[DataFrame, int]:
    """((term, uses, records), number of records that have a term), exact for every term.

    `records` has a column `terms`, as record_terms() gives it, and should be a written table: it
    is read three times. Which terms count as heavy changes the work, never the counts."""
    most = max(1, min(int(1 / heavy_share), sketch // 2))
    heads = records.select(F.posexplode("terms").alias("pos", "term"))
    seen = heads.agg(F.count_if(F.col("pos") == 0).alias("records"), F.count(F.lit(1)).alias("uses"), F.expr(f"approx_top_k(term, {most}, {sketch})").alias("top")).first()
    heavy = sorted(x["item"] for x in seen["top"] or [] if x["item"] is not None and x["count"] >= heavy_share * seen["uses"])
    light = _light_counts(records, heavy).groupBy("term").agg(F.sum("uses").alias("uses"), F.sum("records").alias("records"))
    if not heavy:
        return light, seen["records"]
    tasks = _heavy_counts(records, heavy).groupBy("term").agg(F.sum("uses").alias("uses"), F.sum("records").alias("records"))
    return light.unionByName(tasks), seen["records"]


def marked_terms(counts: DataFrame, n_records: int, least_records: int = 4, least_uses: int = 6, most_share: float = 0.15) -> DataFrame:
    """The counts with `mark`: `rare` (in fewer than `least_records` records, or fewer than `least_uses`
    uses), else `common` (in more than `most_share` of the records that have a term), else null."""
    rare = (F.col("records") < least_records) | (F.col("uses") < least_uses)
    common = F.col("records") > F.lit(most_share) * F.lit(n_records)
    return counts.withColumn("mark", F.when(rare, "rare").when(common, "common"))


def keyword_terms(frames: DataFrame) -> DataFrame:
    """(term, uses, frames, mark) of every term in the keywords of all frames."""
    terms = materialize(record_terms(frames, "frame_id", "evaluation", F.col("evaluation.keywords")), "terms")
    counts, n = term_counts(terms)
    return marked_terms(counts, n).withColumnRenamed("records", "frames")
