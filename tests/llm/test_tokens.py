import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokens = pytest.importorskip("fotarium.llm.tokens")

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(tokens.VOCABULARY), reason="no vocabulary")


@given(st.text(alphabet="aé'stlvdmrR 12 \n\t　.,!一ไ́²\U0001f600\x1c\x85", max_size=60), st.sampled_from([1, 2, 3, 7]))
@settings(max_examples=300, deadline=None)
def test_tree_equals_direct(text, leaf):
    encoding, _ = tokens.vocabulary(tokens.VOCABULARY)
    assert tokens.encode_text(text, leaf=leaf).tolist() == encoding.encode_ordinary(text)


def test_long_texts_without_breaks_and_round_trip():
    encoding, _ = tokens.vocabulary(tokens.VOCABULARY)
    rnd = random.Random(1)
    for text in ("a" * 30_000, "漢字仮名" * 5000, " " * 9000 + "x", "".join(rnd.choice("ab 1") for _ in range(50_000)), "<|endoftext|>" * 50):
        ids = tokens.encode_text(text, leaf=1000).tolist()
        assert ids == encoding.encode_ordinary(text) and tokens.decode_ids(ids) == text
        assert 50256 not in ids


def test_rows(spark):
    rows = [(1, "Hello world", "e"), (1, "Hello world", "e"), (2, "", "e"), (3, None, None), (None, " ", "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"] or 0, r["ids"]) for r in tokens.token_ids(df).collect())
    assert got == [(0, [220]), (1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert tokens.token_ids(df.limit(0)).collect() == []
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df).collect()}[3] == 0


def test_whole_table(spark, base):
    encoding, _ = tokens.vocabulary(tokens.VOCABULARY)
    docs = spark.read.parquet(f"{base}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: list(r["ids"]) for r in tokens.token_ids(docs).collect()} == {i: encoding.encode_ordinary(t or "") for i, t in texts.items()}


def test_decoding_up_the_tree(spark):
    texts = ["", "写真" * 300 + " 😀" * 50, "plain words"]
    for leaf in (1, 3, 4096):
        for t in texts:
            assert tokens.decode_ids(tokens.encode_text(t).tolist(), leaf=leaf) == t
    df = tokens.token_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert {r["doc_id"]: r["text"] for r in tokens.token_texts(df, leaf=2).collect()} == dict(enumerate(texts))
