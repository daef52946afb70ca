"""Edges of the chained operators that the generated tables don't hold."""

import pytest
from pyspark.sql import functions as F

from foliate.functions import text
from foliate.operators import batch, control, graph, retrieve
from foliate.plans import markdown


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_settings_missing_or_null_fail(spark):
    settings = spark.sql("SELECT 'a' AS agent, 'm' AS model")
    good = spark.sql("SELECT 1 AS id, 'a' AS agent")
    assert rows(control.settings_of(good, settings, "agent")) == [(1, "a", "m")]
    for bad in ("'b'", "CAST(NULL AS STRING)"):
        with pytest.raises(Exception, match="no settings for"):
            control.settings_of(spark.sql(f"SELECT 1 AS id, {bad} AS agent"), settings, "agent").collect()
    assert control.settings_of(good.where("false"), settings, "agent").count() == 0


def test_owner_last_wins_and_unmatched_stay(spark):
    found = spark.sql("SELECT * FROM VALUES ('c1', 'X'), ('c1', 'X'), ('c2', 'Y'), (NULL, 'Z') AS t(chunk_id, entity)")
    owners = spark.sql("SELECT * FROM VALUES ('c1', 'old', 1), ('c1', 'new', 2), (NULL, 'none', 3) AS t(chunk_id, modal_entity, ord)")
    assert rows(graph.with_owner(found, owners, ["chunk_id"])) == rows(spark.sql("SELECT * FROM VALUES ('c1', 'X', 'new'), ('c1', 'X', 'new'), ('c2', 'Y', NULL), (NULL, 'Z', NULL)"))


def test_answers_come_from_the_cache_once_stored(spark):
    queries = spark.sql("SELECT * FROM VALUES (1, ' q ', 'mix'), (2, 'q', 'mix'), (3, 'q', 'mix'), (4, 'q', 'local') AS t(doc_id, query, mode)")
    items = spark.sql("SELECT * FROM VALUES (1, 0, 'table', 'a'), (2, 0, 'table', 'a'), (4, 0, 'table', 'a') AS t(doc_id, block_idx, type, description)")
    keyed = retrieve.keyed_queries(queries, items)
    ask = lambda misses: misses.withColumn("answer", F.concat(F.lit("to "), F.col("text")))
    empty = keyed.select("key", F.lit("").alias("answer"))
    first, cache = retrieve.answered(keyed, empty, ask)
    assert [r.hit for r in first.collect()] == [False] * 4
    assert cache.count() == 2
    again, cache = retrieve.answered(keyed, cache, ask)
    assert {r.doc_id: r.hit for r in again.collect()} == {1: True, 2: True, 3: False, 4: True}
    assert {r.doc_id: r.answer for r in again.collect()}[3] == "to q"
    assert cache.count() == 2


def test_plan_record_of_short_and_bare_plans(spark):
    bare = "# COA方案：Alpha\n\n## 概述\n" + "words " * 20
    plans = spark.createDataFrame([(1, bare), (2, "   short   "), (3, None)], "plan_id long, md string")
    (got,) = markdown.assemble(plans).collect()
    assert (got.plan_id, got.name, got.overview) == (1, "Alpha", ("words " * 20).strip())
    assert [got[c] for c in ("units", "phases", "cells", "effects", "decisions", "risks")] == [[]] * 6
    assert [r.plan_id for r in markdown.rejected(plans).orderBy("plan_id").collect()] == [2, 3]


def test_last_of_repeated_headers_counts(spark):
    body = "| id | id | note |\n|---|---|---|\n| 1 | 2 | x |\n| 3 |"
    found = markdown.records(spark.createDataFrame([(1, body)], "plan_id long, body string"), {"id": ("id",), "note": ("note",)})
    assert [(r.id, r.note) for r in found.orderBy("row_idx").collect()] == [("2", "x"), (None, None)]


def test_wrapped_items_and_settings(spark):
    raw = spark.createDataFrame([('{"a": 1}', "image"), ("x", "table"), ("[1]", "other"), ("{bad", "equation"), (None, "image"), ("", None)], "raw string, type string")
    got = [r[0] for r in raw.coalesce(1).select(text.wrapped_item(F.col("raw"), F.col("type"))).collect()]
    assert got == ['{"a": 1}', '{"table_body":"x"}', '{"content":"[1]"}', '{"equation":"{bad"}', None, '{"content":""}']
    value = lambda s, path: spark.range(1).select(text.config_value(F.lit(s), path, "d")).collect()[0][0]
    assert [value('{"a": {"b": 2}}', p) for p in ("a.b", "a.c", "a.b.c", "z")] == ["2", "d", "d", "d"]


def test_batch_of_repeated_chunks(spark):
    blocks = spark.sql("""SELECT doc_id, block_idx, type, text, CAST(NULL AS STRING) AS path, CAST(NULL AS STRING) AS caption, CAST(NULL AS STRING) AS footnote, 'latex' AS format
        FROM VALUES (1, 0L, 'equation', 'x = y'), (1, 1L, 'equation', 'x = y'), (2, 0L, 'text', 'only text') AS t(doc_id, block_idx, type, text)""")
    status = spark.sql("SELECT 1 AS doc_id, array('a', 'a') AS chunks, 2L AS n_chunks UNION ALL SELECT 2, array('b'), 1L")
    describe = lambda b: b.withColumn("description", F.lit("d"))
    extract = lambda c: c.select("doc_id", "chunk_id", F.lit("E").alias("entity"))
    out = batch.process(blocks, status, describe, extract, F.concat_ws(" ", "type", "doc_id", "block_idx"))
    assert [(r.ord, r.modal_entity) for r in out["chunks"].orderBy("ord").collect()] == [(2, "equation 1 0"), (3, "equation 1 1")]
    assert [(r.src, r.tgt) for r in out["edges"].collect()] == [("E", "equation 1 1")]
    got = {r.doc_id: (r.chunks[:2], r.n_chunks, len(r.chunks)) for r in out["status"].collect()}
    assert got == {1: (["a", "a"], 4, 4), 2: (["b"], 1, 1)}
