"""File discovery, parsed-document readers and sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliate.functions.ids import basename, suffix
from foliate.schemas import CONTENT_LIST
from foliate.sources.shared import stored

#: Names that may be broadcast.
FEW = 1_000_000
# Suffixes by kind.
OFFICE = (".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx")
IMAGE = (".png", ".jpeg", ".jpg", ".bmp", ".tiff", ".tif", ".gif", ".webp")
TEXT = (".txt", ".md")
HTML = (".html", ".htm", ".xhtml")
SUPPORTED = tuple(sorted({*OFFICE, *IMAGE, *TEXT, ".pdf"}))


def supported(paths: DataFrame, col: str) -> DataFrame:
    """Rows whose path has a supported suffix, in any case of letters."""
    return paths.where(suffix(F.col(col)).isin(*SUPPORTED))


def route(path: Column) -> Column:
    """The parser a path goes to: pdf, image, office (with HTML), text or generic."""
    s = suffix(path)
    return F.when(s == ".pdf", "pdf").when(s.isin(*IMAGE), "image").when(s.isin(*OFFICE, *HTML), "office").when(s.isin(*TEXT), "text").otherwise("generic")


def scan_folder(spark: SparkSession, folder: str, recursive: bool = True, content: bool = False) -> DataFrame:
    """path, modificationTime, length (and content) of the supported files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return supported(found if content else found.drop("content"), "path")


@F.pandas_udf(StringType())
def _gbk(content: pd.Series) -> pd.Series:
    """Spark's own decoders have no GBK."""

    def decode(raw):
        try:
            return None if raw is None else bytes(raw).decode("gbk")
        except UnicodeDecodeError:
            return None

    return content.map(decode, na_action=None)


def batch_plan(paths: DataFrame, col: str, root: str, out: str, recursive: bool = True) -> DataFrame:
    """path, parser, folder of what a batch would parse, as a dry run: supported files below ``root`` only.

    The folder mirrors the file's place below the root and ends in its name without suffix. Not ``recursive``: files of the root itself.
    """
    base = root.rstrip("/") + "/"
    inner = F.substr(F.col(col), F.lit(len(base) + 1))
    below = supported(paths, col).where(F.startswith(F.col(col), F.lit(base)))
    if not recursive:
        below = below.where(~F.contains(inner, F.lit("/")))
    return below.select(F.col(col).alias("path"), route(F.col(col)).alias("parser"), F.concat(F.lit(out.rstrip("/") + "/"), F.regexp_replace(inner, r"\.[^./]*$", "")).alias("folder"))


def split_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The results without an error, and those with one (column error)."""
    return results.where("error IS NULL").drop("error"), results.where("error IS NOT NULL")


def decode_text(content: Column, gbk: bool = False) -> Column:
    """Bytes as text: UTF-8 if valid, else (with ``gbk``) GBK if valid, else Latin-1, which any bytes are.

    Many Latin-1 texts are valid GBK, so that step is for those who expect it. Only bytes that are no UTF-8 are decoded in Python.
    """
    valid, latin = F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1")
    return F.coalesce(valid, _gbk(F.when(valid.isNull(), content)), latin) if gbk else F.coalesce(valid, latin)


def content_blocks(parsed: DataFrame, key: str, base: str = "") -> DataFrame:
    """Blocks of parsed content lists (column ``all``), by ``key``: caption names of either spelling; image paths below ``base`` or blank."""
    each = parsed.select(key, F.posexplode("all").alias("block_idx", "b"))
    empty = F.array().cast("array<string>")
    outside = F.col("b.img_path").rlike(r"(^|/)\.\.(/|$)|^/")
    image = F.when(F.coalesce("b.img_path", F.lit("")) == "", F.lit("")).when(outside, F.lit("")).otherwise(F.concat(F.lit(base), F.col("b.img_path")))
    return each.select(
        key, F.col("block_idx").cast("long").alias("block_idx"), F.coalesce("b.page_idx", F.lit(0)).alias("page_idx"), F.coalesce("b.type", F.lit("text")).alias("type"), F.coalesce("b.text", F.lit("")).alias("text"), F.coalesce("b.text_level", F.lit(0)).alias("text_level"),
        image.alias("img_path"), F.coalesce("b.image_caption", "b.img_caption", empty).alias("image_caption"), F.coalesce("b.image_footnote", "b.img_footnote", empty).alias("image_footnote"), F.coalesce("b.table_body", F.lit("")).alias("table_body"),
        F.coalesce("b.table_caption", empty).alias("table_caption"), F.coalesce("b.table_footnote", empty).alias("table_footnote"), "b.latex", "b.text_format", "b.content",
    )


def read_content_lists(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """Blocks of parsed documents: one JSON array a file (column file); see ``content_blocks``."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("file"), F.from_json("value", CONTENT_LIST).alias("all"))
    return content_blocks(raw, "file", base)


def read_bundles(spark: SparkSession, path: str, base: str = "") -> tuple[DataFrame, DataFrame]:
    """Blocks of parsed documents (doc_id is the name), and the documents that can't be read (doc_id, error); many documents a file.

    A line is a name, a tab and a JSON array of blocks. What fails goes to the errors, the rest goes on: a line without a name, a name that
    several lines share, what is no JSON array, and an array without blocks.
    """
    lines = spark.read.text(path).where("value <> ''").select(F.when(F.contains("value", F.lit("\t")), F.substring_index("value", "\t", 1)).alias("doc_id"), F.regexp_replace("value", r"^[^\t]*\t", "").alias("body"))
    whole = F.col("body").rlike(r"^\s*\[")  # what is cut or no JSON is null
    again = stored(lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id", F.lit(True).alias("_again")), "names")
    again = F.broadcast(again) if again.count() <= FEW else again  # so that bodies are not shuffled
    read = lines.select("doc_id", F.when(whole, F.from_json("body", CONTENT_LIST)).alias("all")).join(again, "doc_id", "left")
    error = F.when(F.coalesce("doc_id", F.lit("")) == "", "no name").when(F.col("_again"), "a name twice").when(F.col("all").isNull(), "no content list").when(F.size("all") == 0, "no blocks")
    read = read.withColumn("error", error)
    unread = stored(read.where("error IS NOT NULL").select("doc_id", "error").distinct(), "unread")  # for errors and for statuses
    return content_blocks(read.where("error IS NULL"), "doc_id", base), unread


def ocr_blocks(results: DataFrame) -> DataFrame:
    """doc_id, block_idx, page_idx, text from OCR pages (lines: array of struct text, confidence); repeated lines stay."""
    each = results.select("doc_id", "page_idx", F.posexplode("lines").alias("i", "l")).where(F.trim("l.text") != "")
    return each.select("doc_id", "page_idx", F.col("i").cast("long").alias("block_idx"), F.lit("text").alias("type"), F.trim("l.text").alias("text"))


def write_json(records: DataFrame, folder: str) -> None:
    """Whole records as JSON lines, nulls included."""
    records.write.option("ignoreNullFields", "false").json(folder)


def file_name(path: Column, full: bool = False) -> Column:
    return path if full else basename(path)
