"""Inputs that queries derive from the generated tables, each with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks: ten a page, types by position."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_idx", "text"))
    kind = F.expr("CASE block_idx % 7 WHEN 0 THEN 'image' WHEN 1 THEN 'table' WHEN 2 THEN 'equation' WHEN 3 THEN 'custom_type' ELSE 'text' END")
    return docs.select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), F.expr("CAST(block_idx div 10 AS BIGINT)").alias("page_idx"), kind.alias("type"), "text")


BLK = """blk AS (SELECT doc_id, i - 1 AS block_idx, (i - 1) // 10 AS page_idx,
    CASE (i - 1) % 7 WHEN 0 THEN 'image' WHEN 1 THEN 'table' WHEN 2 THEN 'equation' WHEN 3 THEN 'custom_type' ELSE 'text' END AS type, lines[i] AS text
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents))"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by region, nation, priority and segment."""
    t = lambda name: table(spark, sf_dir, name)
    customers = t("customer").join(F.broadcast(t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("r_regionkey", "r_name", "n_nationkey", "n_name", "o_orderpriority", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


COUNTS = """counts AS (SELECT r_regionkey, r_name, n_nationkey, n_name, o_orderpriority, c_mktsegment, count(*) AS n
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""


def _list(order: str, text, sep: str):
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return F.array_join(F.transform(pairs, lambda x: x["t"]), sep)


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plan_id, md: a plan for each region: nations by order priorities, with effects, decisions and risks."""
    counts = _counts(spark, sf_dir)
    numbered = F.array_sort(F.collect_list(F.struct("c_mktsegment", "n")))
    cell = F.array_join(F.transform(numbered, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["c_mktsegment"], F.lit(" "), x["n"].cast("string"))), "<br>")
    cells = counts.groupBy("r_regionkey", "r_name", "n_nationkey", "n_name", "o_orderpriority").agg(cell.alias("cell"))
    rows = cells.groupBy("r_regionkey", "r_name", "n_nationkey", "n_name").agg(_list("o_orderpriority", F.col("cell"), " | ").alias("cells"), F.array_sort(F.collect_set("o_orderpriority")).alias("heads"))
    unit = F.concat(F.lit("| "), "n_name", F.lit(" (N-"), F.col("n_nationkey").cast("string"), F.lit(") *(unit of "), "r_name", F.lit(")* | "), "cells", F.lit(" |"))
    effect = F.concat(F.lit("| E"), F.col("n_nationkey").cast("string"), F.lit(" | Serve "), "n_name", F.lit(" | calls; visits；mails | N_"), F.col("n_nationkey").cast("string"), F.lit(", HQ |"))
    decision = F.concat(F.lit("| D"), F.col("n_nationkey").cast("string"), F.lit(" | Phase_1 | load of "), "n_name", F.lit(" | 若late则rush; calm: wait；hold |"))
    risk = F.concat(F.lit("| "), F.when(F.col("n_nationkey") % 2 == 0, F.lit("-")).otherwise(F.lit("SUPPLY")), F.lit(" | delay in "), "n_name", F.lit(" | stock |"))
    whole = rows.groupBy("r_regionkey", "r_name").agg(_list("n_nationkey", unit, "\n").alias("u"), _list("n_nationkey", effect, "\n").alias("e"), _list("n_nationkey", decision, "\n").alias("d"), _list("n_nationkey", risk, "\n").alias("k"), F.max("heads").alias("heads"))
    header = F.array_join(F.transform("heads", lambda h, i: F.concat(F.lit("阶段"), (i + 1).cast("string"), F.lit(": "), h, F.lit(" *(H+"), i.cast("string"), F.lit("min)* *(处理"), h, F.lit(")*"))), " | ")
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size("heads") + 1))
    md = F.concat(
        F.lit("# COA方案："), "r_name", F.lit("\n\n## 概述\nOrders of "), "r_name", F.lit("\n\n## COA矩阵\n| 单元 | "), header, F.lit(" |\n"), rule, F.lit("\n"), "u",
        F.lit("\n\n## 效果链\n| 效果ID | 描述 | 度量 | 实现单元 |\n|---|---|---|---|\n"), "e", F.lit("\n\n## 决策点\n| 决策点ID | 阶段 | 条件 | 选项 |\n|---|---|---|---|\n"), "d",
        F.lit("\n\n## 风险\n| 类别 | 描述 | 缓解 |\n|---|---|---|\n"), "k", F.lit("\n"),
    )
    return whole.select(F.col("r_regionkey").cast("long").alias("plan_id"), md.alias("md"))


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged rounds: the events of each user in order."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", F.row_number().over(order).cast("long").alias("iteration"), F.round(F.col("value") % 10, 2).alias("score"), F.upper("event_type").alias("verdict"))


ROUNDS = """rounds AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration, round(value % 10, 2) AS score, upper(event_type) AS verdict FROM events)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies with a fence, a trailing comma, a think block, or no JSON."""
    score = (F.col("event_id") % 10).cast("string")
    body = F.concat(F.lit('{"overall_score": '), score, F.lit('.5, "verdict": "'), F.upper("event_type"), F.lit('", "feedback": "user '), F.col("user_id").cast("string"), F.lit('", "detailed_description": "seen '), "event_type", F.lit('", "entity_info": {"entity_name": "U'), F.col("user_id").cast("string"), F.lit('", "entity_type": "user", "summary": "s"}'))
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("}\n```"))).when(F.col("event_id") % 4 == 1, F.concat(body, F.lit(",}"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("<think>hm</think>\n"), body, F.lit("}"))).otherwise(F.concat(F.lit("no json from "), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", "event_type", raw.alias("raw"))


REPLY = """reply AS (SELECT event_id, event_type, user_id, CASE event_id % 4 WHEN 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || body || '}' || chr(10) || '```' WHEN 1 THEN body || ',}' WHEN 2 THEN '<think>hm</think>' || chr(10) || body || '}' ELSE 'no json from ' || event_type END AS raw
    FROM (SELECT *, '{"overall_score": ' || (event_id % 10) || '.5, "verdict": "' || upper(event_type) || '", "feedback": "user ' || user_id || '", "detailed_description": "seen ' || event_type || '", "entity_info": {"entity_name": "U' || user_id || '", "entity_type": "user", "summary": "s"}' AS body FROM events))"""
