"""Cuts by tokens: chunks and contexts measured by a tokenizer that the user plugs in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.functions.text import ended

#: Maps texts to the (start, end) of their tokens, in characters, ascending; runs in the tasks.
Offsets = Callable[[list[str]], list[list[tuple[int, int]]]]
#: Characters of texts that the slot gets at once, about.
STEP = 1 << 20


def _batches(batches: Iterator[pa.RecordBatch], offsets: Offsets) -> Iterator[tuple[pa.Array, list[str], list[list[tuple[int, int]]]]]:
    for batch in batches:
        texts, at = [t or "" for t in batch.column(1).to_pylist()], 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size < STEP:
                to, size = to + 1, size + len(texts[to])
            yield batch.column(0).slice(at, to - at), texts[at:to], offsets(texts[at:to])
            at = to


def token_chunks(docs: DataFrame, offsets: Offsets, size: int = 1200, overlap: int = 100) -> DataFrame:
    """doc_id, chunk_idx, n_tokens, text: windows of ``size`` tokens that overlap, cut out of the text as it stands.

    A text without tokens has no chunk; a window that would hold nothing but what the one before ended with is not begun.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap has to be less than the size")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, spans in _batches(batches, offsets):
            rows = [(i, k, len(s[a : a + size]), t[s[a][0] : s[min(a + size, len(s)) - 1][1]]) for i, (t, s) in enumerate(zip(texts, spans)) for k, a in enumerate(range(0, len(s), size - overlap)) if a == 0 or a + overlap < len(s)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string())], ["doc_id", "chunk_idx", "n_tokens", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, chunk_idx long, n_tokens long, text string")


def token_contexts(docs: DataFrame, offsets: Offsets, most: int) -> DataFrame:
    """doc_id, context: texts of ``most`` tokens at most; longer ones are cut behind that token and ended as ``ended`` does."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, spans in _batches(batches, offsets):
            cut = [t if len(s) <= most else t[: s[most - 1][1]] if most else "" for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cut, pa.string()), pa.array([len(s) > most for s in spans], pa.bool_())], ["doc_id", "cut", "shortened"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, cut string, shortened boolean")
    return rows.select("doc_id", F.when(F.col("shortened"), ended(F.col("cut"))).otherwise(F.col("cut")).alias("context"))
