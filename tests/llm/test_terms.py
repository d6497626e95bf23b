import random
from collections import Counter

import pytest

from fotarium.llm.terms import clean_term, keyword_terms, marked_terms, record_terms, term_counts
from fotarium.session import materialize
from pyspark.sql import functions as F

SCHEMA = "frame_id bigint, evaluation struct<keywords:array<string>>, term string, mark string, EVALUATION string, loaded_at int"


def frames(spark, rows):
    return spark.createDataFrame([(i, None if k is None else (None if k == "null" else k,), "x", "y", "z", n) for n, (i, k) in enumerate(rows)], SCHEMA)


def brute(rows):
    uses, held, n, seen = Counter(), Counter(), 0, set()
    for i, words in rows:
        if i is None or i in seen:
            continue
        seen.add(i)
        terms = [t for t in map(clean_term, [w for w in words or [] if w is not None]) if t] if words != "null" else []
        uses.update(terms)
        held.update(set(terms))
        n += bool(terms)
    return uses, held, n


def test_clean_term():
    assert clean_term("  Déjà \n POSED ") == "déjà posed"
    assert clean_term("é" * 15) == "é" * 15 and clean_term("é" * 16) is None
    assert [clean_term(x) for x in ("", " \t", "a|b", "CULL:keep", "a b c d", "x" * 31, "x" * 100_000)] == [None] * 7


@pytest.mark.parametrize("share", [0.3, 0.01, 0.001])
def test_counts_are_exact_whatever_is_heavy(spark, share):
    rnd = random.Random(7)
    words = ["people", "PEOPLE ", "night", None, "", "a|b", *[f"w{i}" for i in range(200)]]
    rows = [(i if i % 9 else None, rnd.choice([None, "null", [], [rnd.choice(words[:3] * 40 + words) for _ in range(rnd.randrange(9))]])) for i in range(600)]
    rows += [r for r in rows[:100]]
    uses, held, n = brute(rows)
    records = materialize(record_terms(frames(spark, rows).repartition(5), "frame_id", "evaluation", F.col("evaluation.keywords")), "t")
    counts, total = term_counts(records, heavy_share=share, sketch=512)
    assert total == n
    assert {r["term"]: (r["uses"], r["records"]) for r in counts.collect()} == {t: (uses[t], held[t]) for t in uses}


def test_marks(spark):
    rows = [(i, ["common"] + (["rare", "rare", "rare"] if i < 3 else []) + (["six"] if i < 6 else []) + (["five"] if i < 5 else [])) for i in range(40)]
    got = {r["term"]: (r["uses"], r["frames"], r["mark"]) for r in keyword_terms(frames(spark, rows)).collect()}
    assert got == {"common": (40, 40, "common"), "rare": (9, 3, "rare"), "six": (6, 6, None), "five": (5, 5, "rare")}
    assert keyword_terms(frames(spark, rows).limit(0)).collect() == []
    tie = spark.createDataFrame([("t", 15, 15)], "term string, uses bigint, records bigint")
    assert marked_terms(tie, 100).first()["mark"] is None and marked_terms(tie, 99).first()["mark"] == "common"
