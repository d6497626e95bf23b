"""Queries of the training-data problems over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotarium.llm.forest import HashForest, admit_batches, records
from fotarium.llm.packing import fill, pack_texts
from fotarium.llm.sentences import sentences
from fotarium.llm.sql import SQL  # noqa: F401
from fotarium.llm.terms import keyword_terms
from fotarium.llm.tokens import token_ids
from fotarium.session import materialize, table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return keyword_terms(table(spark, base, "frames")).filter(F.col("mark").isNotNull()).select("term", "mark")


def p1_terms(spark: SparkSession, base: str) -> DataFrame:
    return keyword_terms(table(spark, base, "frames"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    cards = table(spark, base, "card_files")
    new = materialize(records(cards, "file_id", file_digest=False), "card-records")
    old = materialize(records(table(spark, base, "manifest"), "entry_id", file_digest=True), "manifest-records")
    starts = [r["start"] for r in cards.filter("file_id is not null").groupBy("batch_no").agg(F.min("file_id").alias("start")).collect()]  # a row a batch
    return admit_batches(HashForest.of(old, known=new), new, starts, sizes_known=True)[0]


def p6_ids(spark: SparkSession, base: str) -> DataFrame:
    return token_ids(table(spark, base, "documents"))


def p7_packs(spark: SparkSession, base: str) -> DataFrame:
    return pack_texts(table(spark, base, "documents"), table(spark, base, "pack_sizes"))


def p7_fill(spark: SparkSession, base: str) -> DataFrame:
    return fill(p7_packs(spark, base), table(spark, base, "pack_sizes"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return sentences(table(spark, base, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p2_found, p6_ids, p7_packs, p7_fill, p8_found)}
