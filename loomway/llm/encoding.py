"""Encoding of whole corpora with a public byte-level tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from loomway.llm.bpe import Vocabulary, decode, encode

VOCABULARY_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_LOADED: dict[int, Vocabulary] = {}


def _vocabulary(content: bytes) -> Vocabulary:
    """One vocabulary, with its caches, for each worker process."""
    key = hash(content)
    if key not in _LOADED:
        _LOADED[key] = Vocabulary.parse(content)
    return _LOADED[key]


def _columns(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    from pyspark.sql import functions as F

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY_PATH) -> DataFrame:
    """(doc_id, ids) of every document, without special tokens.

    An empty and a null text give an empty list; repeated ids give a row each,
    and so does a null id. No shuffle: texts stream through the transducer
    where they are read. The vocabulary (under 1 MB) is broadcast.
    """
    content = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(content.value)
        for b in batches:
            ids = pa.array([encode(v, t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])

    return _columns(docs, doc_id, text).mapInArrow(run, "doc_id long, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY_PATH) -> DataFrame:
    """The kept columns with `tokens`, the length of each text in tokens (0 for null and empty ones)."""
    from pyspark.sql import functions as F

    content = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(content.value)
        for b in batches:
            n = pa.array([len(encode(v, t)) for t in b.column("_text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), n], [*keep, "tokens"])

    return rows.mapInArrow(run, f"{fields}, tokens long")


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY_PATH) -> DataFrame:
    """(doc_id, tokens, same): whether decoding each document's ids gives its text again; null counts as empty."""
    content = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(content.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            ids = [encode(v, t) for t in texts]
            same = [decode(v, i) == (t or "") for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "tokens", "same"])

    return _columns(docs, doc_id, text).mapInArrow(run, "doc_id long, tokens long, same boolean")
