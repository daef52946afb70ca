"""The chain of a batch of parsed documents: from blocks to chunks, nodes, edges and statuses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions.ids import prefixed
from foliate.operators import blocks as b
from foliate.operators import control, graph


def process(blocks: DataFrame, status: DataFrame, describe: Callable[[DataFrame], DataFrame], extract: Callable[[DataFrame], DataFrame], entity: Column) -> dict[str, DataFrame]:
    """Tables that the blocks which are no text add: chunks, nodes, edges and the statuses after them.

    blocks: doc_id, block_idx, type, text, path, caption, footnote, format; status: doc_id, chunks, n_chunks so far.
    ``describe`` adds a column description to blocks, ``extract`` turns chunks (doc_id, chunk_id, text) into rows of
    doc_id, chunk_id, entity; ``entity`` names a block's own entity. Numbers of chunks go on from a status's count, or
    from zero without one. A chunk that repeats within a document is extracted once and belongs to its last block.
    """
    described = describe(b.separate(blocks)[1]).join(status.select("doc_id", "n_chunks"), "doc_id", "left")
    text = b.chunk_text(*map(F.col, ("type", "text", "path", "caption", "footnote", "format", "description")))
    chunks = b.order_index(described.withColumn("chunk", text), F.coalesce("n_chunks", F.lit(0)))
    chunks = chunks.select("doc_id", "block_idx", "type", F.col("chunk").alias("text"), prefixed("chunk-", F.col("chunk")).alias("chunk_id"), F.col("chunk_order_index").cast("long").alias("ord"), entity.alias("modal_entity"))
    nodes = graph.main_nodes(chunks.select("modal_entity", "type", "doc_id", "chunk_id", "ord"), "modal_entity", "ord")
    found = extract(chunks.select("doc_id", "chunk_id", "text").dropDuplicates(["doc_id", "chunk_id"]))
    edges = graph.belongs_to(graph.with_owner(found, chunks, ["doc_id", "chunk_id"]))
    return {"chunks": chunks, "nodes": nodes, "edges": edges, "status": control.append_chunks(status, chunks)}
