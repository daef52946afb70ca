"""Content blocks: separation, context windows, chunk templates and chunking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions.ids import block_signature, digest, prefixed
from foliate.functions.text import fill_template, strip, title_case, truncate_context
from foliate.operators.running import running


def _joined(order: str, text: Column, sep: str) -> Column:
    """Texts of a group in order; null texts are left out."""
    pairs = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(F.col(order).alias("o"), text.alias("t")))))
    return F.array_join(F.transform(pairs, lambda x: x["t"]), sep)


def separate(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text of each document (non-blank text blocks in order, parted by blank lines), and its other blocks."""
    kind = F.coalesce("type", F.lit("text"))
    text = F.when((kind == "text") & (strip(F.coalesce("text", F.lit(""))) != ""), F.col("text"))
    texts = blocks.groupBy("doc_id").agg(_joined("block_idx", text, "\n\n").alias("text"), F.count(text).alias("n_text"), F.count_if(kind != "text").alias("n_other"))
    return texts, blocks.where(kind != "text")


def content_ids(blocks: DataFrame) -> DataFrame:
    """doc_id and the id made from the signatures of all its blocks in order."""
    signature = block_signature(F.coalesce("type", F.lit("text")), F.coalesce("text", F.lit("")))
    return blocks.groupBy("doc_id").agg(prefixed("doc-", _joined("block_idx", signature, "\n")).alias("content_id"))


def type_histogram(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def item_text(type_: Column, text: Column, level: Column, caption: Column, headers: bool = True, captions: bool = True) -> Column:
    """What a block adds to a context: text with heading marks, or the captions of images and tables."""
    heading = F.when((level > 0) & F.lit(headers), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).otherwise(text)
    named = lambda label: F.when(F.lit(captions) & (F.coalesce(caption, F.lit("")) != ""), F.concat(F.lit(f"[{label}: "), caption, F.lit("]")))
    return F.coalesce(F.when(type_ == "text", heading).when(type_ == "image", named("Image")).when(type_ == "table", named("Table")), F.lit(""))


def page_contexts(blocks: DataFrame, pages: int = 1, types: tuple[str, ...] = ("text",)) -> DataFrame:
    """doc_id, page_idx, context of every page that has blocks: texts of the pages around it in block order, other pages marked.

    All blocks of a page have one context, so it is made once a page: each page's texts are gathered once and
    sent to the ``2 * pages + 1`` pages that see them, by an equi-join on document and page. A null page is page 0.
    """
    page = F.coalesce("page_idx", F.lit(0)).cast("long").alias("page_idx")
    usable = F.coalesce(F.col("type").isin(*types) & (strip(F.coalesce("text", F.lit(""))) != ""), F.lit(False))
    items = F.array_compact(F.collect_list(F.when(usable, F.struct("block_idx", "text"))))
    each = blocks.groupBy("doc_id", page).agg(items.alias("own"))
    sent = each.select("doc_id", F.col("page_idx").alias("from"), "own", F.explode(F.array(*[F.lit(k).cast("long") for k in range(-pages, pages + 1)])).alias("step"))
    seen = sent.where((F.size("own") > 0) | (F.col("step") == 0)).select("doc_id", (F.col("from") + F.col("step")).alias("page_idx"), F.col("step") == 0, F.col("from"), "own").toDF("doc_id", "page_idx", "same", "from", "own")
    mark = F.when(F.col("same"), F.lit("")).otherwise(F.concat(F.lit("[Page "), F.col("from").cast("string"), F.lit("] ")))
    seen = seen.withColumn("own", F.transform("own", lambda x: F.struct(x["block_idx"].alias("block_idx"), F.concat(mark, x["text"]).alias("text"))))
    around = seen.groupBy("doc_id", "page_idx").agg(F.max("same").alias("there"), F.array_sort(F.flatten(F.collect_list("own"))).alias("all")).where("there")
    return around.select("doc_id", "page_idx", F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("context"))


def page_context(blocks: DataFrame, pages: int = 1, types: tuple[str, ...] = ("text",), most: int | None = None, use: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, block_idx, context: the context of each block's page (see ``page_contexts``), cut to ``most`` characters.

    ``use`` is computed of a context once a page; with it or ``most`` what is joined to the blocks is short, and the work linear.
    """
    contexts = page_contexts(blocks, pages, types)
    cut = truncate_context(F.col("context"), most) if most else F.col("context")
    contexts = contexts.withColumn("context", use(cut) if use else cut)
    own = blocks.select("doc_id", "block_idx", F.coalesce("page_idx", F.lit(0)).cast("long").alias("page_idx"))
    return own.join(contexts.withColumnRenamed("doc_id", "_doc").withColumnRenamed("page_idx", "_page"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("page_idx") == F.col("_page"))).select("doc_id", "block_idx", "context")


def chunk_context(blocks: DataFrame, chunks: int = 1) -> DataFrame:
    """doc_id, block_idx, context: texts of the neighbours by position, the block itself left out."""
    order = Window.partitionBy("doc_id").orderBy("block_idx")
    text = F.when((F.col("type") == "text") & (strip(F.coalesce("text", F.lit(""))) != ""), F.col("text"))
    both = F.concat(F.collect_list(text).over(order.rowsBetween(-chunks, -1)), F.collect_list(text).over(order.rowsBetween(1, chunks)))
    return blocks.select("doc_id", "block_idx", F.array_join(both, "\n").alias("context"))


#: The chunk template of each type of block.
TEMPLATES = {
    "image": "\nImage Content Analysis:\nImage Path: {image_path}\nCaptions: {captions}\nFootnotes: {footnotes}\n\nVisual Analysis: {enhanced_caption}",
    "table": "Table Analysis:\nImage Path: {table_img_path}\nCaption: {table_caption}\nStructure: {table_body}\nFootnotes: {table_footnote}\n\nAnalysis: {enhanced_caption}",
    "equation": "Mathematical Equation Analysis:\nEquation: {equation_text}\nFormat: {equation_format}\n\nMathematical Analysis: {enhanced_caption}",
    "generic": "{content_type} Content Analysis:\nContent: {content}\n\nAnalysis: {enhanced_caption}",
}


def chunk_text(type_: Column, text: Column, path: Column, caption: Column, footnote: Column, format_: Column, description: Column) -> Column:
    """Chunk of a described block by its type's template; empty captions and footnotes read None."""
    empty = lambda x: F.coalesce(x, F.lit(""))
    named = lambda x: F.coalesce(F.nullif(empty(x), F.lit("")), F.lit("None"))
    fill = lambda kind, **values: fill_template(F.lit(TEMPLATES[kind]), {**values, "enhanced_caption": description})
    image = fill("image", image_path=empty(path), captions=named(caption), footnotes=named(footnote))
    table = fill("table", table_img_path=empty(path), table_caption=named(caption), table_body=empty(text), table_footnote=named(footnote))
    equation = fill("equation", equation_text=empty(text), equation_format=empty(format_))
    other = fill("generic", content_type=title_case(type_), content=empty(text))
    return F.when(type_ == "image", image).when(type_ == "table", table).when(type_ == "equation", equation).otherwise(other)


def order_index(blocks: DataFrame, base: Column, spread: bool = False) -> DataFrame:
    """Blocks with their number among the document's, counted on from ``base``; ``spread``: by many tasks also within one document (``running``)."""
    if spread:
        return running(blocks, ["doc_id"], ["block_idx"], "_n").withColumn("chunk_order_index", F.col("_n") - 1 + base).drop("_n")
    return blocks.withColumn("chunk_order_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_idx")) - 1 + base)


def dedup_chunks(chunks: DataFrame, order: str) -> DataFrame:
    """One row a chunk text, the last by ``order``; a partial aggregate, so frequent chunks combine before the shuffle."""
    keyed = chunks.withColumn("chunk_id", prefixed("chunk-", F.col("text")))
    rest = [c for c in keyed.columns if c != "chunk_id"]
    return keyed.groupBy("chunk_id").agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"), F.count(F.lit(1)).alias("n_copies")).select("chunk_id", "r.*", "n_copies")


def overlapping_chunks(docs: DataFrame, size: int = 1200, overlap: int = 100) -> DataFrame:
    """doc_id, chunk_idx, n_tokens, text: windows of white-space tokens that overlap."""
    tokens = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("tokens") - 1, F.lit(0)), F.lit(size - overlap)), lambda s: (s == 0) | (s + overlap < F.size("tokens")))
    cut = docs.select("doc_id", tokens.alias("tokens")).where(F.size("tokens") > 0).select("doc_id", "tokens", F.posexplode(starts).alias("chunk_idx", "start"))
    piece = F.slice("tokens", F.col("start") + 1, size)
    return cut.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.size(piece).cast("long").alias("n_tokens"), F.array_join(piece, " ").alias("text"))


#: The processor of each type of block, and what it supports.
PROCESSORS = {"image": "image", "table": "table", "equation": "equation"}
SUPPORTS = {
    "image": ("Image content analysis", "Visual understanding", "Image description generation", "Image entity extraction"),
    "table": ("Table structure analysis", "Data statistics", "Trend identification", "Table entity extraction"),
    "equation": ("Mathematical formula parsing", "Variable identification", "Formula meaning explanation", "Formula entity extraction"),
    "generic": ("General content analysis", "Structured processing", "Entity extraction"),
}


def processor_of(type_: Column, disabled: tuple[str, ...] = ()) -> Column:
    """The processor of a type: its own (null if disabled), or the generic one for types without."""
    own = F.create_map(*[F.lit(x) for k, v in PROCESSORS.items() for x in (k, v)])
    return F.when(type_.isin(*disabled), None).otherwise(F.coalesce(F.try_element_at(own, type_), F.lit("generic")))


def features(processors: DataFrame) -> DataFrame:
    """processor, feature: what each distinct processor supports; null ones are disabled and support nothing."""
    known = F.create_map(*[y for k, v in SUPPORTS.items() for y in (F.lit(k), F.array(*map(F.lit, v)))])
    return processors.select("processor").where("processor IS NOT NULL").distinct().select("processor", F.explode(F.try_element_at(known, F.col("processor"))).alias("feature"))


def short_digest(x: Column) -> Column:
    return F.substring(digest(x), 1, 8)
