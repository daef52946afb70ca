"""Retrieval: cosine top-k, mode dispatch, query texts and image marks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions.ids import basename, cache_key, digest


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, src, tgt, weight: edges that touch the nodes (column node) of each query.

    An edge with both ends among a query's nodes counts once, by its source; repeated edges stay.
    """
    nodes = nodes.select("query_id", "node").distinct()
    out = nodes.join(edges, F.col("node") == F.col("src")).select("query_id", "src", "tgt", "weight")
    into = nodes.join(edges, F.col("node") == F.col("tgt")).select("query_id", "src", "tgt", "weight")
    return out.unionByName(into.join(nodes.withColumnRenamed("node", "src"), ["query_id", "src"], "left_anti").select("query_id", "src", "tgt", "weight"))


def by_mode(mode: str, naive: DataFrame, local: DataFrame, global_: DataFrame) -> DataFrame:
    """query_id, item of a retrieval mode; bypass retrieves nothing."""
    plans = {"naive": [naive], "local": [local], "global": [global_], "hybrid": [local, global_], "mix": [local, global_, naive], "bypass": []}
    if mode not in plans:
        raise ValueError(f"unknown mode {mode}; one of {', '.join(plans)}")
    found = naive.where(F.lit(False))
    for part in plans[mode]:
        found = found.unionByName(part)
    return found.select("query_id", "item").distinct()


#: Fixed value: what closes a query with related content.
SUFFIX = "\n\nPlease provide a comprehensive answer based on the user query and the provided multimodal content information."


def multimodal_query(items: DataFrame, query: Column, suffix: str = SUFFIX) -> DataFrame:
    """doc_id and the query text with the content of each item in order."""
    part = F.struct("block_idx", F.concat(F.lit("\nRelated "), F.col("type"), F.lit(" content: "), F.col("description")).alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["s"]), "\n")
    return items.groupBy("doc_id").agg(F.concat(F.lit("User query: "), F.first(query), F.lit("\n"), joined, F.lit(suffix)).alias("query"))


def keyed_queries(queries: DataFrame, items: DataFrame, suffix: str = SUFFIX) -> DataFrame:
    """doc_id, key, text of multimodal queries (doc_id, query, mode) with their items (doc_id, block_idx, type, description).

    The key covers the trimmed query, the mode and the items in order. A query without items is asked as it is and has no key.
    """
    in_order = F.array_sort(F.collect_list(F.struct("block_idx", "type", "description")))
    content = digest(F.array_join(F.transform("_items", lambda x: F.concat(x["type"], F.lit(":"), x["description"])), "\n"))
    related = F.array_join(F.transform("_items", lambda x: F.concat(F.lit("\nRelated "), x["type"], F.lit(" content: "), x["description"])), "\n")
    asked = queries.join(items.groupBy("doc_id").agg(in_order.alias("_items")), "doc_id", "left")
    key = F.when(F.col("_items").isNotNull(), cache_key({"query": F.btrim("query"), "mode": F.col("mode"), "content": content}, "multimodal_query:"))
    text = F.when(F.col("_items").isNotNull(), F.concat(F.lit("User query: "), F.col("query"), F.lit("\n"), related, F.lit(suffix))).otherwise(F.col("query"))
    return asked.select("doc_id", key.alias("key"), text.alias("text"))


def answered(keyed: DataFrame, cache: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """doc_id, key, hit, answer of keyed queries; and the cache (key, answer) with the new answers.

    ``answer`` is the model's slot: it gets the rows that the cache has no answer for, and adds a column answer. Empty
    stored answers are no hits; of several answers for one key the least is stored.
    """
    stored = cache.where(F.coalesce("answer", F.lit("")) != "").groupBy("key").agg(F.min("answer").alias("answer"))
    hits = keyed.join(stored, "key").select("doc_id", "key", F.lit(True).alias("hit"), "answer")
    missed = answer(keyed.join(stored, "key", "left_anti")).select("doc_id", "key", F.lit(False).alias("hit"), "answer")
    new = missed.where("key IS NOT NULL").groupBy("key").agg(F.min("answer").alias("answer"))
    return hits.unionByName(missed), stored.unionByName(new)


def vision_or_plain(prompts: DataFrame, vision: Callable[[DataFrame], DataFrame], plain: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, via, answer of marked prompts (doc_id, prompt): by the vision slot where an image is marked, else by the plain one.

    Both slots add a column answer; the vision slot also finds the column parts (see ``vlm_parts``). A null prompt is plain.
    """
    seen = F.coalesce(F.col("prompt").rlike(r"\[VLM_IMAGE_\d+\]"), F.lit(False))
    shown = vision(prompts.where(seen).withColumn("parts", vlm_parts(F.col("prompt")))).select("doc_id", F.lit("vision").alias("via"), "answer")
    return shown.unionByName(plain(prompts.where(~seen)).select("doc_id", F.lit("plain").alias("via"), "answer"))


def query_key(query: Column, mode: Column, path: Column, table: Column) -> Column:
    """Cache key of a multimodal query: trimmed query, mode, base name of paths, digest of long tables."""
    short = F.when(F.length(table) > 200, F.concat(F.lit("hash:"), digest(table))).otherwise(table)
    return cache_key({"query": F.btrim(query), "mode": mode, "path": basename(path), "table": short}, "multimodal_query:")


#: Image suffixes that a vision model may see, and the most bytes of a file.
IMAGES = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "tif")
IMAGE_BYTES = 50 * 1024 * 1024


def safe_path(path: Column, folders: tuple[str, ...]) -> Column:
    """Whether a normalised path lies below one of the folders; no step upwards counts as safe."""
    below = F.exists(F.array(*map(F.lit, folders)), lambda d: F.startswith(path, F.concat(F.rtrim(d, F.lit("/")), F.lit("/"))))
    return below & ~path.rlike(r"(^|/)\.\.(/|$)")


def blank_unsafe(path: Column, folders: tuple[str, ...]) -> Column:
    return F.when(safe_path(path, folders), path).otherwise(F.lit(""))


def image_path(line: Column) -> Column:
    """The path of a line that names an image, up to one of the suffixes; null where there is none."""
    return F.nullif(F.regexp_extract(line, rf"Image Path:\s*([^\r\n]*?\.(?:{'|'.join(IMAGES)}))", 1), F.lit(""))


def image_marks(prompts: DataFrame, ok: Column) -> DataFrame:
    """doc_id, line_idx, line: lines that name an image path, marked by the running number of the usable ones (column path)."""
    usable = F.col("path").isNotNull() & ok
    n = F.sum(usable.cast("int")).over(Window.partitionBy("doc_id").orderBy("line_idx"))
    return prompts.withColumn("n", n).withColumn("line", F.when(usable, F.concat(F.col("line"), F.lit("\n[VLM_IMAGE_"), F.col("n").cast("string"), F.lit("]"))).otherwise(F.col("line"))).drop("n")


def vlm_parts(prompt: Column) -> Column:
    """Text and image parts of a marked prompt, in order; blank texts are dropped."""
    pieces = F.split(prompt, r"\[VLM_IMAGE_")

    def part(x: Column, i: Column) -> Column:
        number = F.when(i > 0, F.regexp_extract(x, r"^(\d+)\]", 1))
        rest = F.btrim(F.when(i > 0, F.regexp_replace(x, r"^\d+\]", "")).otherwise(x), F.lit(" \n\t"))
        image = F.when(number.isNotNull(), F.struct(F.lit("image").alias("type"), number.alias("value")))
        text = F.when(rest != "", F.struct(F.lit("text").alias("type"), rest.alias("value")))
        return F.filter(F.array(image, text), lambda y: y.isNotNull())

    return F.flatten(F.transform(pieces, part))


def valid_image(path: Column, size: Column, link: Column) -> Column:
    """Whether a file may be shown to a vision model: an image suffix, no link, and not too large."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*IMAGES) & ~F.coalesce(link, F.lit(False)) & (size <= IMAGE_BYTES)
