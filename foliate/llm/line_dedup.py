"""Line deduplication by site-relative frequency (native: DataFrame functions only).

A line is boilerplate on a host when the share of the host's pages that contain it exceeds a
ratio. Pages with the very same text count once, so a group of exact copies does not turn its
own lines into boilerplate. Lines are compared after trimming spaces; blank lines are never
counted and never removed.

Defined results: a null host is a host of its own; a null text has no lines, counts as no page
and stays null; a page left without lines becomes the empty text; repeated rows are cleaned like
any other row; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.common import durable, table

#: A line on more than this share of a host's pages is boilerplate ...
RATIO = 0.1
#: ... if it is on this many pages at least (else each line of a one-page host would be).
MIN_PAGES = 4
#: Boilerplate lines (a 32-character digest and a host each) up to which the table is broadcast.
BROADCAST_LINES = 100_000


def _digests(text: Column) -> Column:
    """Digests of the distinct lines that are not blank."""
    lines = F.array_distinct(F.transform(F.split(text, "\n"), lambda x: F.trim(x)))
    return F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.md5(x.cast("binary")))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, line (md5 of the trimmed line), n_pages, host_pages for every boilerplate line.

    Each row explodes to its own distinct lines; counts combine before the shuffle, so neither a
    hot host nor a line on every page gathers in one task.
    """
    pages = docs.where(F.col(text_col).isNotNull()).select(F.col(host_col).alias("host"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("page"))
    totals = pages.groupBy("host").agg(F.countDistinct("page").alias("host_pages"))
    counts = pages.select("host", "page", F.explode(_digests(F.col("text"))).alias("line")).groupBy("host", "line").agg(F.countDistinct("page").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    both = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    return both.where(F.col("n_pages") > ratio * F.col("host_pages")).select("c.host", "line", "n_pages", "host_pages")


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``docs`` with boilerplate lines cut from the text, and the counts ``__foliate_lines`` and ``__foliate_dropped``.

    A host has fewer than (lines per page / ratio) boilerplate lines, since each fills that share
    of its pages, so a host's list is small. The table of lists is broadcast if a count of it is
    within ``broadcast_lines``; beyond that a join on the host follows, which Spark splits where
    a host is hot.
    """
    found = durable(boilerplate(docs, host_col, text_col, ratio, min_pages).select("host", "line"))
    lists = found.groupBy("host").agg(F.collect_set("line").alias("__foliate_boilerplate")).withColumnRenamed("host", "__foliate_host")
    if found.count() <= broadcast_lines:
        lists = F.broadcast(lists)
    lines = F.split(F.col(text_col), "\n")
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__foliate_boilerplate"), F.md5(F.trim(x).cast("binary"))))
    listed = F.col("__foliate_boilerplate").isNotNull() & F.col(text_col).isNotNull()
    out = docs.join(lists, F.col(host_col).eqNullSafe(F.col("__foliate_host")), "left")
    out = out.withColumn("__foliate_kept", F.when(listed, kept)).withColumn("__foliate_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    out = out.withColumn("__foliate_dropped", F.when(listed, F.col("__foliate_lines") - F.size("__foliate_kept")).otherwise(F.lit(0)).cast("long"))
    out = out.withColumn(text_col, F.when(listed, F.array_join("__foliate_kept", "\n")).otherwise(F.col(text_col)))
    return out.select(*docs.columns, F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.col("__foliate_lines")).cast("long").alias("__foliate_lines"), "__foliate_dropped")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the remaining text of every document; a document's source is its host."""
    out = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", F.col("__foliate_lines").alias("n_lines"), F.col("__foliate_dropped").alias("n_dropped"), "text")


ORACLE_SQL = f"""
WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
totals AS (SELECT source, count(*) AS host_pages FROM pages GROUP BY source),
lines AS (SELECT DISTINCT source, text, trim(u.line, ' ') AS line FROM pages, unnest(string_split(text, chr(10))) AS u(line)),
found AS (SELECT l.source, l.line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
          WHERE l.line <> '' GROUP BY l.source, l.line, t.host_pages
          HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO}::DOUBLE * t.host_pages),
lists AS (SELECT source, list(line) AS cut FROM found GROUP BY source),
cut AS (SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS all_lines,
               list_filter(string_split(d.text, chr(10)), lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(l.cut, []), trim(x, ' '))) AS kept
        FROM documents d LEFT JOIN lists l ON d.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, coalesce(len(all_lines), 0)::BIGINT AS n_lines, coalesce(len(all_lines) - len(kept), 0)::BIGINT AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text
FROM cut
"""
