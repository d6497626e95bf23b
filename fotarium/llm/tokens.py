"""Problem 6: token ids of every text by a public byte-level BPE vocabulary.

Monoid tree reduction: a text is cut into leaves, each leaf is encoded on its own, and
neighbours are joined up a binary tree. A join re-encodes a window around the seam that grows to
both sides until it meets a place where the vocabulary's own word pattern must break whatever
stands around it; tokens outside such breaks can't depend on the other side, so they stay.
Decoding concatenates up the same tree."""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotarium.session import only, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts text into words before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = 50_256  # Fixed value: the tokens of the vocabulary that PATTERN belongs to
LEAF_CHARS = 4096


def shipped(spark: SparkSession, path: str) -> Callable[[], str]:
    """Send a vocabulary file to the executors once; the result gives its path where it is called."""
    if path not in _shipped.setdefault(spark.sparkContext.applicationId, set()):
        spark.sparkContext.addFile(path)
        _shipped[spark.sparkContext.applicationId].add(path)
    name = os.path.basename(path)

    def local() -> str:
        held = SparkFiles.get(name)
        return held if os.path.exists(held) else path

    return local


_shipped: dict[str, set[str]] = {}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder of a rank file, and the length of every id in bytes. PATTERN and the certain breaks
    belong to one family of vocabularies: of another size than its are refused."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if len(ranks) != RANKS:
        raise ValueError(f"{path} has {len(ranks)} ranks, the word pattern belongs to a vocabulary of {RANKS}")
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def _kind(c: str) -> str:
    """Class of a character in PATTERN: letter, number, white space, other."""
    g = unicodedata.category(c)[0]
    return "L" if g == "L" else "N" if g == "N" else "S" if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else "O"


def _breaks(a: str, b: str) -> bool:
    """Whether PATTERN breaks between the characters a and b in every text.

    No alternative goes from a character that isn't white space into white space, nor from letters to
    numbers or back, so a word ends there whatever precedes and follows."""
    x, y = _kind(a), _kind(b)
    return (y == "S" and x != "S") or (x == "L" and y == "N") or (x == "N" and y == "L")


def last_break(text: str) -> int:
    """The last certain break in `text` (0 if there is none: its start)."""
    for i in range(len(text) - 1, 0, -1):
        if _breaks(text[i - 1], text[i]):
            return i
    return 0


def first_break(text: str) -> int:
    """The first certain break in `text` (its length if there is none)."""
    for i in range(1, len(text)):
        if _breaks(text[i - 1], text[i]):
            return i
    return len(text)


class Node:
    """A stretch of text with its ids: the element of the monoid."""

    __slots__ = ("text", "ids")

    def __init__(self, text: str, ids: np.ndarray):
        self.text, self.ids = text, ids


def join(left: Node, right: Node, encode, lengths: np.ndarray) -> Node:
    """Ids of left.text + right.text from the ids of both, re-encoding only around the seam."""
    if not left.text or not right.text:
        return right if not left.text else left
    a, b = last_break(left.text), first_break(right.text)
    cut, upto = len(left.text[a:].encode()), len(right.text[:b].encode())
    keep = len(left.ids) - int(np.searchsorted(np.cumsum(lengths[left.ids[::-1]]), cut, "left")) - 1 if cut else len(left.ids)
    skip = int(np.searchsorted(np.cumsum(lengths[right.ids]), upto, "left")) + 1
    seam = np.asarray(encode(left.text[a:] + right.text[:b]), np.int32)
    return Node(left.text + right.text, np.concatenate([left.ids[:keep], seam, right.ids[skip:]]))


def reduce_tree(nodes: list[Node], encode, lengths: np.ndarray) -> np.ndarray:
    while len(nodes) > 1:
        nodes = [join(nodes[i], nodes[i + 1], encode, lengths) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0].ids if nodes else np.zeros(0, np.int32)


def encode_text(text: str | None, path: str = VOCABULARY, leaf: int = LEAF_CHARS) -> np.ndarray:
    encoding, lengths = vocabulary(path)
    encode = encoding.encode_ordinary
    if not text:
        return np.zeros(0, np.int32)
    leaves = [text[i : i + leaf] for i in range(0, len(text), leaf)]
    return reduce_tree([Node(x, np.asarray(encode(x), np.int32)) for x in leaves], encode, lengths)


def decode_ids(ids: list[int], path: str = VOCABULARY, leaf: int = LEAF_CHARS) -> str:
    """The text of token ids: leaves of `leaf` ids are decoded to bytes on their own and concatenated up the
    tree. A character may lie across a seam, so bytes become text only at the root."""
    encoding, _ = vocabulary(path)
    nodes = [encoding.decode_bytes(ids[i : i + leaf]) for i in range(0, len(ids), leaf)]
    while len(nodes) > 1:
        nodes = [b"".join(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return b"".join(nodes).decode("utf-8", "replace")


def token_texts(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str = VOCABULARY, leaf: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, text): the texts of arrays of ids; null and empty arrays give ''."""
    kind, local = encoded.schema[doc_id].dataType, shipped(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([decode_ids(x or [], local(), leaf) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[doc_id, "text"])

    return only(encoded, doc_id, ids).mapInArrow(run, f"`{doc_id}` {kind.simpleString()}, text string")


def token_ids(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY, leaf: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, ids): the token ids of every text, without special tokens, whose spellings are plain text.

    Empty and null texts have an empty array. Each row gives one row, repeated rows too. Texts are
    encoded whole; other columns are not read. Each task maps its own rows; only inputs of fewer partitions than cores
    are spread first."""
    kind = documents.schema[doc_id].dataType
    local = shipped(documents.sparkSession, path)
    source = spread(only(documents, doc_id, text)).select(F.col(doc_id), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [encode_text(t.as_py(), local(), leaf) for t in part.column(1)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], names=[doc_id, "ids"])

    return source.mapInArrow(run, f"`{doc_id}` {kind.simpleString()}, ids array<int>")


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY, leaf: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, n_tokens) of every text; 0 for empty and null ones."""
    return token_ids(documents, doc_id, text, path, leaf).select(doc_id, F.size("ids").cast("bigint").alias("n_tokens"))
