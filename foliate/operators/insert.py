"""One chain from parsed documents to chunks, nodes, edges and statuses, in which what fails is led aside and the rest goes on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions.ids import prefixed
from foliate.operators import blocks as b
from foliate.operators import graph
from foliate.operators.store import KeyedStore
from foliate.sources.shared import durable, stored

Slot = Callable[[DataFrame], DataFrame]


@dataclass
class Slots:
    """Where models are plugged in; each adds its column and a column error, null for rows that went well.

    Other columns of the rows go through a slot. ``describe`` adds description to blocks, ``extract`` adds entities (array of string) to chunks (doc_id, chunk_id, text). The second of each
    pair gets the rows that the first failed on, one by one as it were: a smaller model, a longer wait, a shorter prompt.
    """

    describe: Slot
    describe_one: Slot
    extract: Slot
    extract_one: Slot


def attempt(rows: DataFrame, keys: list[str], slot: Slot, one: Slot, kept: list[str], use: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """What a slot, or else the individual one, did well: keys, the columns ``kept`` and via (batch or individual); and what failed twice (keys, error).

    This is written down, so that no model is asked twice, and of rows that failed what the slot was given: they are tried again from there,
    and nothing is read, made or shuffled a second time for them. ``use`` is a column of a slot's output that is kept as ``made``.
    """
    wanted = [*keys, *kept, *([use.alias("made")] if use is not None else []), "error"]
    asked = slot(rows.withColumn("_given", F.struct(*rows.columns)))
    first = stored(asked.select(*wanted, F.when(F.col("error").isNotNull(), F.col("_given")).alias("_given")), "attempt")
    second = stored(one(first.where("error IS NOT NULL").select("_given.*")).select(*wanted), "attempt")
    good = first.where("error IS NULL").drop("_given").withColumn("via", F.lit("batch")).unionByName(second.where("error IS NULL").withColumn("via", F.lit("individual")))
    return good.drop("error"), second.where("error IS NOT NULL").select(*keys, "error")


def items_of(parsed: DataFrame) -> DataFrame:
    """doc_id, block_idx, page_idx, type, text, path, caption, footnote, format of parsed blocks (see ``content_blocks``): each type's own fields."""
    t, joined = F.col("type"), lambda c: F.nullif(F.array_join(c, ", "), F.lit(""))
    filled = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names), F.lit(""))
    text = F.when(t == "table", filled("table_body", "text")).when(t == "equation", filled("latex", "text")).when(t.isin("text", "image"), F.col("text")).otherwise(filled("content", "text"))
    caption = F.when(t == "table", joined("table_caption")).otherwise(joined("image_caption"))
    footnote = F.when(t == "table", joined("table_footnote")).otherwise(joined("image_footnote"))
    return parsed.select("doc_id", "block_idx", "page_idx", "type", text.alias("text"), F.col("img_path").alias("path"), caption.alias("caption"), footnote.alias("footnote"), F.coalesce("text_format", F.lit("")).alias("format"))


def insert(items: DataFrame, unread: DataFrame, slots: Slots, entity: Column, size: int = 1200, overlap: int = 100) -> dict[str, DataFrame]:
    """What documents add: chunks, nodes, edges, errors (doc_id, block_idx, chunk_id, stage, error) and a status a document.

    ``items`` is as ``items_of`` gives it, ``unread`` has doc_id and error. Texts are cut into chunks, other blocks are described and follow as
    chunks of their own; entities are extracted from all. A document that can't be read is failed. Of one that can, blocks and
    chunks that fail twice are errors, and it is processed without them.
    """
    texts, others = b.separate(items)
    texts = stored(texts.select("doc_id", "text", "n_other"), "texts")  # so that files are read twice in all, for texts and for other blocks
    cut = b.overlapping_chunks(texts.select("doc_id", "text"), size, overlap)
    body = b.chunk_text(*map(F.col, ("type", "text", "path", "caption", "footnote", "format", "description")))
    described, undescribed = attempt(others, ["doc_id", "block_idx"], slots.describe, slots.describe_one, ["type"], body)
    counts = cut.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    modal = b.order_index(described.join(counts, "doc_id", "left"), F.coalesce("_n", F.lit(0)))
    modal = modal.select("doc_id", F.col("chunk_order_index").cast("long").alias("ord"), F.col("made").alias("text"), "type", "block_idx", entity.alias("modal_entity"))
    plain = cut.select("doc_id", F.col("chunk_idx").alias("ord"), "text", F.lit("text").alias("type"), F.lit(None).cast("long").alias("block_idx"), F.lit(None).cast("string").alias("modal_entity"))
    keyed = lambda rows: rows.withColumn("chunk_id", prefixed("chunk-", F.col("text")))
    chunks = keyed(plain).unionByName(keyed(modal))
    # Rows of a document lie together, so repeats are numbered without another shuffle.
    nth = F.row_number().over(Window.partitionBy("doc_id", "chunk_id").orderBy("ord"))
    asked = keyed(plain).withColumn("_nth", nth).unionByName(keyed(modal).withColumn("_nth", nth)).where("_nth = 1").select("doc_id", "chunk_id", "text")
    found, failed = attempt(asked, ["doc_id", "chunk_id"], slots.extract, slots.extract_one, ["entities"])
    found, failed = found.dropDuplicates(["doc_id", "chunk_id"]), failed.distinct()
    entities = found.select("doc_id", "chunk_id", F.explode("entities").alias("entity"))
    edges = graph.belongs_to(graph.with_owner(entities, chunks, ["doc_id", "chunk_id"]).where("modal_entity IS NOT NULL"))
    named = chunks.where("modal_entity IS NOT NULL").select("modal_entity", "type", "doc_id", "chunk_id", "ord")

    none = lambda kind: F.lit(None).cast(kind)
    errors = unread.select("doc_id", none("long").alias("block_idx"), none("string").alias("chunk_id"), F.lit("read").alias("stage"), "error")
    errors = errors.unionByName(undescribed.select("doc_id", "block_idx", none("string").alias("chunk_id"), F.lit("describe").alias("stage"), "error"))
    errors = durable(errors.unionByName(failed.select("doc_id", none("long").alias("block_idx"), "chunk_id", F.lit("extract").alias("stage"), "error")))

    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    of_chunks = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    of_errors = errors.groupBy("doc_id").agg(F.count_if(F.col("stage") == "describe").alias("n_failed_items"), F.count_if(F.col("stage") == "extract").alias("n_failed_chunks"))
    read = texts.select("doc_id", F.col("n_other").alias("n_items")).join(of_chunks, "doc_id", "left").join(of_errors, "doc_id", "left")
    status = read.select("doc_id", F.lit("processed").alias("status"), none("string").alias("error"), F.lit(True).alias("multimodal_processed"), n("n_chunks").alias("n_chunks"), n("n_items").alias("n_items"), n("n_failed_items").alias("n_failed_items"), n("n_failed_chunks").alias("n_failed_chunks"))
    zero = F.lit(0).cast("long")
    gone = unread.groupBy("doc_id").agg(F.min("error").alias("error")).select("doc_id", F.lit("failed").alias("status"), "error", F.lit(False).alias("multimodal_processed"), *[zero.alias(c) for c in ("n_chunks", "n_items", "n_failed_items", "n_failed_chunks")])
    return {"chunks": chunks, "nodes": graph.main_nodes(named, "modal_entity", "ord"), "edges": edges, "entities": entities, "errors": errors, "status": status.unionByName(gone)}


STATUS = "doc_id string, status string, error string, multimodal_processed boolean, n_chunks long, n_items long, n_failed_items long, n_failed_chunks long"
CHUNKS = "chunk_id string, doc_id string, ord long, type string, text string"


def commit(out: dict[str, DataFrame], chunks: KeyedStore, status: KeyedStore) -> None:
    """Chunks first and statuses last, so that no document is called processed whose chunks are not there; doing it again changes nothing."""
    chunks.upsert(out["chunks"].select("chunk_id", "doc_id", "ord", "type", "text"), F.struct("doc_id", "ord"))
    status.upsert(out["status"])
