"""The queries of the library, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliate import fixtures as fx
from foliate.fixtures import BLK, COUNTS, REPLY, ROUNDS, table
from foliate.functions import ids, text
from foliate.operators import batch, blocks, control, graph, insert, nearest, retrieve, settings, tokens, walk
from foliate.operators.store import KeyedStore
from foliate.plans import markdown, matrix
from foliate.sources import files, ocr, tree
from foliate.sources.shared import new_folder
from foliate.streaming import machine, status

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Blocks, ids and contexts


@query(f"""WITH {BLK} SELECT doc_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY block_idx) FILTER (type = 'text' AND trim(text) <> ''), '') AS text,
    count(*) FILTER (type = 'text' AND trim(text) <> '') AS n_text, count(*) FILTER (type <> 'text') AS n_other FROM blk GROUP BY doc_id""")
def content_separation(spark, d):
    return blocks.separate(fx.blocks(spark, d))[0]


@query(f"WITH {BLK} SELECT type, count(*) AS n FROM blk GROUP BY type")
def block_type_histogram(spark, d):
    return blocks.type_histogram(fx.blocks(spark, d))


@query(f"""WITH {BLK} SELECT doc_id, 'doc-' || md5(string_agg(CASE type WHEN 'text' THEN trim(text) WHEN 'image' THEN 'image:' || text WHEN 'table' THEN 'table:' || text WHEN 'equation' THEN 'equation:' || text ELSE type || ':' || text END, chr(10) ORDER BY block_idx)) AS content_id FROM blk GROUP BY doc_id""")
def doc_content_id(spark, d):
    return blocks.content_ids(fx.blocks(spark, d))


@query("SELECT 'chunk-' || md5(text) AS chunk_id, max(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY text")
def chunk_dedup_last_wins(spark, d):
    return blocks.dedup_chunks(table(spark, d, "documents").select("doc_id", "text"), "doc_id").drop("text")


@query(f"""WITH {BLK}, t AS (SELECT a.doc_id, a.block_idx, string_agg(CASE WHEN b.page_idx = a.page_idx THEN b.text ELSE '[Page ' || b.page_idx || '] ' || b.text END, chr(10) ORDER BY b.block_idx) AS context
    FROM blk a JOIN blk b ON a.doc_id = b.doc_id AND b.page_idx BETWEEN a.page_idx - 1 AND a.page_idx + 1 AND b.type = 'text' AND trim(b.text) <> '' GROUP BY ALL)
    SELECT b.doc_id, b.block_idx, md5(coalesce(t.context, '')) AS context FROM blk b LEFT JOIN t USING (doc_id, block_idx)""")
def page_window_context(spark, d):
    return blocks.page_context(fx.blocks(spark, d), use=ids.digest)


@query(f"""WITH {BLK}, t AS (SELECT a.doc_id, a.block_idx, string_agg(b.text, chr(10) ORDER BY b.block_idx) AS context FROM blk a JOIN blk b ON a.doc_id = b.doc_id AND b.block_idx BETWEEN a.block_idx - 2 AND a.block_idx + 2 AND b.block_idx <> a.block_idx AND b.type = 'text' AND trim(b.text) <> '' GROUP BY ALL)
    SELECT b.doc_id, b.block_idx, md5(coalesce(t.context, '')) AS context FROM blk b LEFT JOIN t USING (doc_id, block_idx)""")
def chunk_window_context(spark, d):
    return blocks.chunk_context(fx.blocks(spark, d), 2).withColumn("context", ids.digest(F.col("context")))


@query("""WITH c AS (SELECT doc_id, text, left(text, 500) AS cut FROM documents), p AS (SELECT *, length(cut) AS n, CASE WHEN contains(cut, '.') THEN length(cut) - instr(reverse(cut), '.') ELSE -1 END AS dot, CASE WHEN contains(cut, chr(10)) THEN length(cut) - instr(reverse(cut), chr(10)) ELSE -1 END AS nl FROM c)
    SELECT doc_id, CASE WHEN length(text) <= 500 THEN text WHEN dot > 0.8 * n THEN left(cut, dot + 1) WHEN nl > 0.8 * n THEN left(cut, nl) ELSE cut || '...' END AS context FROM p""")
def context_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate_context(F.col("text"), 500).alias("context"))


_CHUNK = """CASE type
    WHEN 'image' THEN chr(10) || 'Image Content Analysis:' || chr(10) || 'Image Path: ' || doc_id || '.png' || chr(10) || 'Captions: ' || CASE WHEN block_idx % 2 = 0 THEN 'c' || block_idx ELSE 'None' END || chr(10) || 'Footnotes: None' || chr(10) || chr(10) || 'Visual Analysis: ' || left(text, 100)
    WHEN 'table' THEN 'Table Analysis:' || chr(10) || 'Image Path: ' || doc_id || '.png' || chr(10) || 'Caption: ' || CASE WHEN block_idx % 2 = 0 THEN 'c' || block_idx ELSE 'None' END || chr(10) || 'Structure: ' || text || chr(10) || 'Footnotes: None' || chr(10) || chr(10) || 'Analysis: ' || left(text, 100)
    WHEN 'equation' THEN 'Mathematical Equation Analysis:' || chr(10) || 'Equation: ' || text || chr(10) || 'Format: latex' || chr(10) || chr(10) || 'Mathematical Analysis: ' || left(text, 100)
    ELSE 'Custom_Type Content Analysis:' || chr(10) || 'Content: ' || text || chr(10) || chr(10) || 'Analysis: ' || left(text, 100) END"""


@query(f"WITH {BLK} SELECT doc_id, block_idx, md5({_CHUNK}) AS chunk FROM blk WHERE type <> 'text'")
def chunk_templates(spark, d):
    b = _captioned(spark, d).where("type <> 'text'")
    chunk = blocks.chunk_text(*map(F.col, ("type", "text", "path", "caption", "footnote", "format", "description")))
    return b.select("doc_id", "block_idx", ids.digest(chunk).alias("chunk"))


def _captioned(spark, d):
    """Blocks with a path, captions on even ones, and their first characters as the description."""
    caption = F.when(F.col("block_idx") % 2 == 0, F.concat(F.lit("c"), F.col("block_idx").cast("string")))
    return fx.blocks(spark, d).withColumns({"path": F.concat(F.col("doc_id").cast("string"), F.lit(".png")), "caption": caption, "footnote": F.lit(None).cast("string"), "format": F.lit("latex"), "description": F.substring("text", 1, 100)})


@query(f"""WITH {BLK} SELECT doc_id, block_idx, CASE type WHEN 'text' THEN CASE WHEN block_idx % 3 > 0 THEN repeat('#', (block_idx % 3)::INT) || ' ' || text ELSE text END
    WHEN 'image' THEN '[Image: ' || left(text, 20) || ']' WHEN 'table' THEN '[Table: ' || left(text, 20) || ']' ELSE '' END AS item FROM blk WHERE text <> ''""")
def item_to_text(spark, d):
    item = blocks.item_text(F.col("type"), F.col("text"), (F.col("block_idx") % 3).cast("int"), F.substring("text", 1, 20))
    return fx.blocks(spark, d).where("text <> ''").select("doc_id", "block_idx", item.alias("item"))


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1, 180)) AS s FROM t WHERE len(w) > 0)
    SELECT doc_id, s // 180 AS chunk_idx, len(w[s + 1 : s + 200])::BIGINT AS n_tokens, array_to_string(w[s + 1 : s + 200], ' ') AS text FROM s WHERE s = 0 OR s + 20 < len(w)""")
def text_chunking_overlap(spark, d):
    return blocks.overlapping_chunks(table(spark, d, "documents"), 200, 20)


@query(f"WITH {BLK} SELECT doc_id, block_idx, doc_id % 5 + row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) - 1 AS chunk_order_index FROM blk WHERE type <> 'text'")
def chunk_order_index(spark, d):
    out = blocks.order_index(fx.blocks(spark, d).where("type <> 'text'").select("doc_id", "block_idx"), F.col("doc_id") % 5, True)
    return out.select("doc_id", "block_idx", F.col("chunk_order_index").cast("long").alias("chunk_order_index"))


@query(f"WITH {BLK} SELECT type, CASE type WHEN 'table' THEN NULL WHEN 'image' THEN 'image' WHEN 'equation' THEN 'equation' ELSE 'generic' END AS processor, count(*) AS n FROM blk GROUP BY ALL")
def route_by_type(spark, d):
    b = fx.blocks(spark, d).withColumn("processor", blocks.processor_of(F.col("type"), ("table",)))
    return b.groupBy("type", "processor").agg(F.count(F.lit(1)).alias("n"))


# Files

_FILE = "regexp_replace(url, '[?#].*$', '') || CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.png' WHEN 3 THEN '.exe' ELSE '' END"


def _paths(spark, d):
    tail = F.expr("CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.png' WHEN 3 THEN '.exe' ELSE '' END")
    return table(spark, d, "pages").select("page_id", F.concat(F.regexp_replace("url", "[?#].*$", ""), tail).alias("path"))


@query(f"SELECT page_id, path, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'office' ELSE 'image' END AS route FROM (SELECT page_id, {_FILE} AS path FROM pages WHERE page_id % 5 IN (0, 1, 2)) WHERE NOT contains(path, '/.')")
def supported_file_filter(spark, d):
    return files.supported(_paths(spark, d), "path").withColumn("route", files.route(F.col("path")))


@query(f"SELECT page_id, split_part(p, '/', -1) AS name FROM (SELECT page_id, {_FILE} AS p FROM pages)")
def file_reference_basename(spark, d):
    return _paths(spark, d).select("page_id", ids.basename(F.col("path")).alias("name"))


@query(f"SELECT page_id, regexp_replace(split_part(p, '/', -1), '\\.[^.]*$', '') || '_' || left(md5(p), 8) AS folder FROM (SELECT page_id, {_FILE} AS p FROM pages)")
def unique_output_dir(spark, d):
    return _paths(spark, d).select("page_id", ids.output_name(F.col("path")).alias("folder"))


@query("SELECT page_id, CASE WHEN page_id % 3 <> 1 THEN p ELSE '' END AS path FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/data/in/' || page_id WHEN 1 THEN '/data/in/../etc/' || page_id ELSE '/tmp/out/x/' || page_id END AS p FROM pages)")
def safe_path_predicate(spark, d):
    p = F.expr("CASE page_id % 3 WHEN 0 THEN concat('/data/in/', page_id) WHEN 1 THEN concat('/data/in/../etc/', page_id) ELSE concat('/tmp/out/x/', page_id) END")
    return table(spark, d, "pages").select("page_id", retrieve.blank_unsafe(p, ("/data/in", "/tmp/out/")).alias("path"))


# Plans

_UNITS = f"WITH {COUNTS}, n AS (SELECT DISTINCT r_regionkey::BIGINT AS plan_id, r_name, n_nationkey, n_name FROM counts)"
_HEADS = f"WITH {COUNTS}, h AS (SELECT plan_id, p, row_number() OVER (PARTITION BY plan_id ORDER BY p) AS i FROM (SELECT DISTINCT r_regionkey::BIGINT AS plan_id, o_orderpriority AS p FROM counts))"


@query(_UNITS + " SELECT DISTINCT plan_id, r_name AS name, 'Orders of ' || r_name AS overview FROM n")
def plan_sections(spark, d):
    plans = fx.plans(spark, d)
    overview = markdown.find_section(markdown.sections(plans), *markdown.SECTIONS["overview"])
    return markdown.titles(plans).join(overview.withColumnRenamed("body", "overview"), "plan_id")


def _rows(spark, d):
    return markdown.table_rows(markdown.find_section(markdown.sections(fx.plans(spark, d)), *markdown.SECTIONS["matrix"]))


@query(f"""WITH {COUNTS}, n AS (SELECT r_regionkey::BIGINT AS plan_id, r_name, n_nationkey, n_name, count(DISTINCT o_orderpriority) AS k FROM counts GROUP BY ALL)
    SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY n_nationkey) AS row_idx, k + 1 AS n_cells, n_name || ' (N-' || n_nationkey || ') *(unit of ' || r_name || ')*' AS first FROM n
    UNION ALL SELECT r_regionkey::BIGINT, 0, count(DISTINCT o_orderpriority) + 1, '单元' FROM counts GROUP BY r_regionkey""")
def plan_table_rows(spark, d):
    return _rows(spark, d).select("plan_id", F.col("row_idx").cast("long").alias("row_idx"), F.size("cells").cast("long").alias("n_cells"), F.element_at("cells", 1).alias("first"))


@query(_HEADS + " SELECT plan_id, 'Phase_' || i AS phase_id, p AS name, 'H+' || (i - 1) || 'min' AS trigger, '处理' || p AS objective FROM h")
def plan_phases(spark, d):
    return markdown.phases(_rows(spark, d)).drop("ord")


@query(_UNITS + " SELECT plan_id, 'N_' || n_nationkey AS unit_id, n_name || ' (N-' || n_nationkey || ')' AS name, 'unit of ' || r_name AS role FROM n")
def plan_units(spark, d):
    return markdown.units(_rows(spark, d)).drop("ord", "row_idx")


_CELLS = f"""WITH {COUNTS}, c AS (SELECT r_regionkey::BIGINT AS plan_id, n_nationkey, 'N_' || n_nationkey AS unit_id, 'Phase_' || dense_rank() OVER (PARTITION BY r_regionkey ORDER BY o_orderpriority) AS phase_id,
    c_mktsegment || ' ' || n AS action, row_number() OVER (PARTITION BY r_regionkey, n_nationkey, o_orderpriority ORDER BY c_mktsegment) AS k FROM counts)"""


def _cells(spark, d):
    return markdown.cells(_rows(spark, d))


@query(_CELLS + " SELECT plan_id, unit_id, phase_id, k - 1 AS action_idx, action FROM c")
def plan_cells(spark, d):
    return _cells(spark, d).select("plan_id", "unit_id", "phase_id", F.posexplode("actions").alias("i", "action")).select("plan_id", "unit_id", "phase_id", F.col("i").cast("long").alias("action_idx"), "action")


@query(_UNITS + " SELECT plan_id, 'E' || n_nationkey AS effect_id, 'Serve ' || n_name AS description, 'calls,visits,mails' AS measures, 'N_' || n_nationkey || ',HQ' AS achieved_by FROM n")
def plan_effects(spark, d):
    e = markdown.effects(markdown.sections(fx.plans(spark, d)))
    return e.select("plan_id", "effect_id", "description", F.array_join("measures", ",").alias("measures"), F.array_join("achieved_by", ",").alias("achieved_by"))


@query(_UNITS + " SELECT plan_id, 'D' || n_nationkey AS dp_id, 'Phase_1' AS phase_id, 'load of ' || n_name AS condition, 'late>rush,calm>wait,default>hold' AS options FROM n")
def plan_decisions(spark, d):
    x = markdown.decisions(markdown.sections(fx.plans(spark, d)))
    return x.select("plan_id", "dp_id", "phase_id", "condition", F.array_join(F.transform("options", lambda o: F.concat(o["if"], F.lit(">"), o["then"])), ",").alias("options"))


@query(_UNITS + " SELECT plan_id, CASE WHEN n_nationkey % 2 = 0 THEN 'GENERAL' ELSE 'SUPPLY' END AS category, 'delay in ' || n_name AS description, 'stock' AS mitigation FROM n")
def plan_risks(spark, d):
    return markdown.risks(markdown.sections(fx.plans(spark, d))).drop("row_idx")


@query(_CELLS + " SELECT plan_id, unit_id, phase_id, string_agg(action, '; ' ORDER BY k) AS actions FROM c GROUP BY ALL")
def flat_matrix(spark, d):
    rows = _rows(spark, d)
    cells = markdown.cells(rows).withColumn("ord", F.struct("unit_ord", "phase_ord"))
    return matrix.flat(markdown.units(rows), markdown.phases(rows), cells).withColumn("actions", F.array_join("actions", "; "))


@query(_CELLS + ", j AS (SELECT plan_id, unit_id, phase_id, string_agg(action, '; ' ORDER BY k) AS a FROM c GROUP BY ALL) SELECT plan_id, unit_id, " + ", ".join(f"max(a) FILTER (phase_id = 'Phase_{i}') AS Phase_{i}" for i in range(1, 6)) + " FROM j GROUP BY ALL")
def flat_matrix_pivot(spark, d):
    return matrix.pivot(_cells(spark, d))


@query(_UNITS + f", h AS (SELECT r_regionkey::BIGINT AS plan_id, count(DISTINCT o_orderpriority) AS k FROM counts GROUP BY 1) SELECT n.plan_id, count(*) AS n_units, max(k) AS n_phases, count(*) * max(k) AS n_cells, count(*) AS n_effects, count(*) AS n_decisions, count(*) AS n_risks, true AS is_valid FROM n JOIN h USING (plan_id) GROUP BY ALL")
def condensed_metrics(spark, d):
    plans = fx.plans(spark, d)
    parts, rows = markdown.sections(plans), _rows(spark, d)
    out = matrix.metrics(plans, units=markdown.units(rows), phases=markdown.phases(rows), cells=markdown.cells(rows), effects=markdown.effects(parts), decisions=markdown.decisions(parts), risks=markdown.risks(parts))
    overview = markdown.find_section(parts, *markdown.SECTIONS["overview"])
    return out.join(overview, "plan_id", "left").withColumn("is_valid", matrix.valid(F.col("n_units"), F.col("n_phases"), F.col("body"))).drop("body")


@query(_CELLS + ", j AS (SELECT plan_id, unit_id, phase_id, n_nationkey, string_agg(action, '; ' ORDER BY k) AS a FROM c GROUP BY ALL) SELECT plan_id, phase_id, string_agg(unit_id || ': ' || a, chr(10) ORDER BY n_nationkey) AS units FROM j GROUP BY ALL")
def condensed_report(spark, d):
    return matrix.condensed(_cells(spark, d))


def _repeated(spark, d):
    cells = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("plan_id"), F.col("l_returnflag").alias("unit_id"), F.col("l_linestatus").alias("phase_id"), F.array(F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))).alias("actions"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return cells


_REP = "SELECT l_suppkey % 5 AS plan_id, l_returnflag AS unit_id, l_linestatus AS phase_id, 'o' || l_orderkey AS a, l_orderkey * 10 + l_linenumber AS ord FROM lineitem"


@query(f"SELECT plan_id, unit_id, string_agg(phase_id || '=' || a, ',' ORDER BY phase_id) AS actions FROM (SELECT plan_id, unit_id, phase_id, arg_max(a, ord) AS a FROM ({_REP}) GROUP BY ALL) GROUP BY ALL")
def unit_slice_last_wins(spark, d):
    s = matrix.slices(_repeated(spark, d), "unit_id", "phase_id")
    return s.select("plan_id", "unit_id", F.array_join(F.transform(F.map_entries("actions"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ";"))), ",").alias("actions"))


@query(f"""WITH r AS ({_REP}), f AS (SELECT plan_id, unit_id, phase_id, arg_min(a, ord) AS actions FROM r GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT plan_id, unit_id FROM r) JOIN (SELECT DISTINCT plan_id, phase_id FROM r) USING (plan_id))
    SELECT plan_id, unit_id, phase_id, coalesce(actions, '') AS actions FROM g LEFT JOIN f USING (plan_id, unit_id, phase_id)""")
def cell_lookup_first_wins(spark, d):
    r = _repeated(spark, d)
    return matrix.flat(r, r, r).withColumn("actions", F.array_join("actions", ";"))


@query(_UNITS + ", r AS (SELECT plan_id, CASE WHEN n_nationkey % 2 = 0 THEN 'GENERAL' ELSE 'SUPPLY' END AS category FROM n) SELECT plan_id, category, count(*) AS n, (sum(count(*)) OVER (PARTITION BY plan_id))::BIGINT AS total FROM r GROUP BY plan_id, category")
def risk_summary(spark, d):
    return matrix.risk_summary(markdown.risks(markdown.sections(fx.plans(spark, d))))


def _tasks(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("task_id"), F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("unit"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).otherwise(F.lit("")).alias("start_condition"), F.when(F.col("event_id") % 4 == 0, F.lit("done")).otherwise(F.lit("")).alias("end_condition"), F.when(F.col("event_id") % 7 == 0, F.lit("base")).otherwise(F.lit("")).alias("location"))


_TASKS = "tasks AS (SELECT event_id AS task_id, 'u' || (user_id % 20) AS unit, CASE WHEN event_id % 3 > 0 THEN event_type ELSE '' END AS start_condition, CASE WHEN event_id % 4 = 0 THEN 'done' ELSE '' END AS end_condition, CASE WHEN event_id % 7 = 0 THEN 'base' ELSE '' END AS location FROM events)"


@query(f"""WITH {_TASKS}, e AS (SELECT unit, task_id, unnest(CASE WHEN start_condition = '' AND end_condition = '' AND location = '' THEN ['GENERAL'] ELSE list_filter(list_distinct([start_condition, end_condition, CASE WHEN location <> '' THEN 'at_' || location ELSE '' END]), lambda x: x <> '') END) AS event FROM tasks)
    SELECT unit AS entity, event, count(*) AS n_tasks, min(task_id) AS first_task, max(task_id) AS last_task FROM e GROUP BY ALL""")
def event_matrix(spark, d):
    return matrix.event_matrix(_tasks(spark, d))


@query(f"WITH {_TASKS} SELECT DISTINCT 'entity' AS kind, unit AS name FROM tasks UNION ALL SELECT DISTINCT 'event', name FROM (SELECT start_condition AS name FROM tasks UNION ALL SELECT end_condition FROM tasks) WHERE name <> ''")
def entity_event_lists(spark, d):
    return matrix.entities_and_events(_tasks(spark, d))


@query("SELECT p_partkey, p_brand AS id, CASE WHEN n = 1 THEN p_brand ELSE p_brand || '_' || (n - 1) END AS new_id FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def duplicate_id_repair(spark, d):
    return matrix.repaired_ids(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("id")), "id", "p_partkey").select("p_partkey", "id", "new_id")


# Control


@query(f"""WITH {ROUNDS}, s AS (SELECT *, coalesce(max(CASE WHEN score >= 8 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM rounds)
    SELECT user_id, iteration, score, verdict FROM s WHERE done = 0 AND iteration <= 3""")
def loop_until_threshold(spark, d):
    return control.until_threshold(fx.rounds(spark, d), "user_id", 8.0, 3)


@query(f"WITH {ROUNDS} SELECT user_id, max(score) AS best_score, arg_max(score, iteration) AS final_score, arg_max(verdict, iteration) AS final_verdict, count(*) AS n_rounds FROM rounds GROUP BY user_id")
def best_and_final_score(spark, d):
    return control.best_and_final(fx.rounds(spark, d), "user_id")


@query(f"""WITH {REPLY} SELECT event_id, CASE WHEN event_id % 4 IN (0, 2) THEN event_id % 10 + 0.5 ELSE 5.0 END::DOUBLE AS score, CASE WHEN event_id % 4 IN (0, 2) THEN upper(event_type) ELSE 'REVISE' END AS verdict, CASE WHEN event_id % 4 IN (0, 2) THEN 'user ' || user_id ELSE raw END AS feedback FROM reply""")
def judge_parse(spark, d):
    return fx.replies(spark, d).select("event_id", text.judge_reply(F.col("raw")).alias("j")).select("event_id", "j.score", "j.verdict", "j.feedback")


@query(f"""WITH {REPLY} SELECT event_id, CASE event_id % 4 WHEN 0 THEN regexp_extract(raw, '(?s)```json\\n(.*)\\n```', 1) WHEN 2 THEN substr(raw, instr(raw, '{{')) ELSE raw END AS json FROM reply""")
def json_extract(spark, d):
    return fx.replies(spark, d).select("event_id", text.extract_json(F.col("raw")).alias("json"))


@query(f"WITH {REPLY} SELECT event_id, replace(raw, ',}}', '}}') AS json FROM reply")
def json_trailing_comma(spark, d):
    return fx.replies(spark, d).select("event_id", text.drop_trailing_commas(F.col("raw")).alias("json"))


@query(f"""WITH {REPLY} SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '' ELSE 'seen ' || event_type END AS detailed_description, CASE WHEN event_id % 4 = 3 THEN 'unknown_entity' ELSE 'U' || user_id END AS entity_name, CASE WHEN event_id % 4 = 3 THEN 'unknown' ELSE 'user' END AS entity_type, CASE WHEN event_id % 4 = 3 THEN '' ELSE 's' END AS summary FROM reply""")
def json_field_fallback(spark, d):
    return fx.replies(spark, d).select("event_id", text.json_fields(F.col("raw")).alias("f")).select("event_id", "f.*")


@query(f"""WITH {REPLY} SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'image_' || md5(raw) ELSE 'U' || user_id || ' (user)' END AS entity_name, CASE WHEN event_id % 4 = 3 THEN 'image' ELSE 'user' END AS entity_type, CASE WHEN event_id % 4 = 3 THEN raw ELSE 's' END AS summary, CASE WHEN event_id % 4 = 3 THEN raw ELSE 'seen ' || event_type END AS description FROM reply""")
def response_normalise(spark, d):
    return fx.replies(spark, d).select("event_id", text.modal_entity(F.col("raw"), F.lit("image")).alias("m")).select("event_id", "m.*")


@query("SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 6)::DOUBLE AS success_rate FROM events")
def batch_summary(spark, d):
    return control.batch_summary(table(spark, d, "events"), F.col("event_type") != "error")


_STATE = "CASE event_type WHEN 'view' THEN 'ready' WHEN 'click' THEN 'handling' WHEN 'signup' THEN 'processing' WHEN 'purchase' THEN 'processed' ELSE 'failed' END"


@query(f"SELECT user_id, arg_max({_STATE}, (ts, event_id)) AS status, max(event_id % 2 = 0) AS multimodal, count(*) AS n, arg_max({_STATE}, (ts, event_id)) = 'processed' AND max(event_id % 2 = 0) AS fully FROM events GROUP BY user_id")
def doc_status_latest(spark, d):
    e = table(spark, d, "events").withColumn("status", F.expr(_STATE))
    out = e.groupBy("user_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max(F.col("event_id") % 2 == 0).alias("multimodal"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("fully", control.fully_processed(F.col("status"), F.col("multimodal")))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unprocessed_docs(spark, d):
    return control.unfinished(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("""SELECT d.doc_id, coalesce(l.doc_id IS NOT NULL AND n_chars % 7 = d.doc_id % 7 AND lang = CASE WHEN quality = 1 THEN 'en' ELSE 'de' END AND quality = 1, false) AS hit FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def parse_cache_probe(spark, d):
    wanted = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 7).alias("mtime"), F.col("lang").alias("config"))
    cache = table(spark, d, "labels").select("doc_id", (F.col("doc_id") % 7).alias("mtime"), F.when(F.col("quality") == 1, F.lit("en")).otherwise(F.lit("de")).alias("config"), F.when(F.col("quality") == 1, F.lit("blocks")).alias("payload"))
    return control.cache_probe(wanted, cache, "doc_id").select("doc_id", "hit")


@query("SELECT event_id, event_id % 11 <= 5 AND event_id % 600 < 300 AS valid FROM events")
def config_ttl_valid(spark, d):
    return table(spark, d, "events").select("event_id", control.cache_valid(F.col("event_id") % 11, F.lit(5), F.lit(0), F.col("event_id") % 600).alias("valid"))


@query("SELECT user_id, event_id, coalesce(value > lag(value) OVER (PARTITION BY user_id ORDER BY event_id), true) AS reload FROM events")
def prompt_hot_reload(spark, d):
    return control.reloads(table(spark, d, "events").withColumn("mtime", F.col("value")), "user_id", "event_id").select("user_id", "event_id", "reload")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'one' WHEN 2 THEN 'fallback' ELSE NULL END AS value FROM part")
def env_substitution(spark, d):
    value = F.element_at(F.array(*map(F.lit, ("plain", "${A}", "${B:fallback}", "${C}"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    env = spark.sql("SELECT 'A' AS name, 'one' AS value")
    return control.substitute_env(table(spark, d, "part").select("p_partkey", value.alias("value")), env)


@query("""SELECT id, unnest(list_filter([CASE WHEN provider = '' THEN 'provider missing' END, CASE WHEN provider = 'other' THEN 'provider unknown' END, CASE WHEN model = '' THEN 'model missing' END, CASE WHEN it <= 0 THEN 'iterations not positive' END, CASE WHEN th > 10 THEN 'threshold out of range' END], lambda x: x IS NOT NULL)) AS rule
    FROM (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'other' ELSE 'openai' END AS provider, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'm' END AS model, p_partkey % 4 AS it, p_size % 12 AS th FROM part)""")
def basic_validation(spark, d):
    m = table(spark, d, "part").selectExpr("p_partkey AS id", "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'other' ELSE 'openai' END AS provider", "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'm' END AS model", "p_partkey % 4 AS max_iterations", "p_size % 12 AS quality_threshold")
    return control.setting_violations(m)


@query("SELECT c_custkey, 'Dear ' || c_name || ', segment ' || c_mktsegment || ' {other} ' || c_name AS prompt FROM customer")
def prompt_fill(spark, d):
    filled = text.fill_template(F.lit("Dear {name}, segment {segment} {other} {name}"), {"name": F.col("c_name"), "segment": F.col("c_mktsegment")})
    return table(spark, d, "customer").select("c_custkey", filled.alias("prompt"))


@query("""WITH t AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'model' ELSE role END AS role, text, role <> 'system' AS talk, row_number() OVER (PARTITION BY conv_id, role <> 'system' ORDER BY turn DESC) AS back FROM conversations)
    SELECT conv_id, coalesce(arg_min(text, turn) FILTER (NOT talk), '') AS system, coalesce(string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (talk AND back > 1), '') AS history, coalesce(max(text) FILTER (talk AND back = 1), '') AS prompt FROM t GROUP BY conv_id""")
def messages_alt_provider_a(spark, d):
    return control.messages_popped(table(spark, d, "conversations"))


@query("""WITH t AS (SELECT conv_id, count(*) FILTER (role IN ('user', 'assistant')) AS n, coalesce(arg_max(role, turn) FILTER (role IN ('user', 'assistant')), 'user') AS last, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'system'), '') AS system,
    coalesce(string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (role IN ('user', 'assistant')), '') AS said FROM conversations GROUP BY conv_id)
    SELECT conv_id, system, CASE WHEN last = 'user' THEN said ELSE said || chr(10) || 'user: 请继续' END AS messages, n + CASE WHEN last = 'user' THEN 0 ELSE 1 END AS n_messages FROM t""")
def messages_alt_provider_b(spark, d):
    return control.messages_joined(table(spark, d, "conversations"))


@query("SELECT conv_id, turn, role, text, CASE WHEN turn % 2 = 0 THEN 0.1 ELSE 0.7 END::DOUBLE AS temperature FROM conversations")
def messages_passthrough(spark, d):
    return control.messages_plain(table(spark, d, "conversations"), F.when(F.col("turn") % 2 == 0, F.lit(0.1)))


# Graph and retrieval


@query(f"""WITH {BLK} SELECT doc_id, 'User query: what is in ' || doc_id || chr(10) || string_agg(chr(10) || 'Related ' || type || ' content: ' || text, chr(10) ORDER BY block_idx) || chr(10) || chr(10) || 'Please provide a comprehensive answer based on the user query and the provided multimodal content information.' AS query FROM blk WHERE type <> 'text' GROUP BY doc_id""")
def multimodal_query_text(spark, d):
    items = fx.blocks(spark, d).where("type <> 'text'").withColumn("description", F.col("text"))
    return retrieve.multimodal_query(items, F.concat(F.lit("what is in "), F.col("doc_id").cast("string")))


@query("""SELECT doc_id, 'multimodal_query:' || md5('mode=mix' || chr(10) || 'path=' || doc_id || '.png' || chr(10) || 'query=' || lang || chr(10) || 'table=' || CASE WHEN length(text) > 200 THEN 'hash:' || md5(text) ELSE text END) AS key FROM documents""")
def query_cache_key(spark, d):
    key = retrieve.query_key(F.concat(F.lit(" "), F.col("lang"), F.lit(" ")), F.lit("mix"), F.concat(F.lit("/a/b/"), F.col("doc_id").cast("string"), F.lit(".png")), F.col("text"))
    return table(spark, d, "documents").select("doc_id", key.alias("key"))


@query(f"""WITH {BLK}, l AS (SELECT doc_id, block_idx AS line_idx, CASE WHEN block_idx % 3 = 0 THEN 'Image Path: /data/' || block_idx || '.' || ['jpg', 'jpeg', 'png', 'gif', 'bmp', 'webp', 'tiff', 'tif', 'svg'][(block_idx // 3 % 9 + 1)::INT] ELSE text END AS line, block_idx % 3 = 0 AND block_idx % 2 = 0 AND block_idx // 3 % 9 < 8 AS ok FROM blk)
    SELECT doc_id, line_idx, CASE WHEN ok THEN line || chr(10) || '[VLM_IMAGE_' || (sum(ok::INT) OVER (PARTITION BY doc_id ORDER BY line_idx))::BIGINT || ']' ELSE line END AS line FROM l""")
def image_marker_rewrite(spark, d):
    """Lines that name images of all suffixes, and one that is none."""
    i = F.col("block_idx")
    suffix = F.element_at(F.array(*map(F.lit, (*retrieve.IMAGES, "svg"))), (F.floor(i / 3) % 9 + 1).cast("int"))
    line = F.when(i % 3 == 0, F.concat(F.lit("Image Path: /data/"), i.cast("string"), F.lit("."), suffix)).otherwise(F.col("text"))
    lines = fx.blocks(spark, d).select("doc_id", i.alias("line_idx"), line.alias("line")).withColumn("path", retrieve.image_path(F.col("line")))
    return retrieve.image_marks(lines, retrieve.safe_path(F.col("path"), ("/data",)) & (F.col("line_idx") % 2 == 0)).drop("path")


@query("""SELECT doc_id, concat_ws('|', CASE WHEN trim(text, ' ' || chr(9) || chr(10)) <> '' THEN 'text:' || trim(text, ' ' || chr(9) || chr(10)) END, 'image:1|text:and|image:2') AS parts FROM documents""")
def vlm_message_parts(spark, d):
    prompt = F.concat(F.coalesce("text", F.lit("")), F.lit("\n[VLM_IMAGE_1] and [VLM_IMAGE_2] "))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(retrieve.vlm_parts(prompt), lambda x: F.concat(x["type"], F.lit(":"), x["value"])), "|").alias("parts"))


@query("""WITH e AS (SELECT doc_id, unnest(list_distinct(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_matches(w, '^[A-Z][a-z]{3,}[.,;:!?]*$')), lambda w: regexp_replace(w, '[.,;:!?]+$', '')))) AS entity FROM documents), m AS (SELECT doc_id, entity, 'Doc ' || doc_id AS owner FROM e)
    SELECT doc_id, entity AS src, owner AS tgt, 'belongs_to,part_of,contained_in' AS keywords, 10.0::DOUBLE AS weight, 'Entity ' || entity || ' belongs to ' || owner AS description, 'rel-' || md5(entity || owner) AS rel_id,
    'belongs_to,part_of,contained_in' || chr(9) || entity || chr(10) || owner || chr(10) || 'Entity ' || entity || ' belongs to ' || owner AS content FROM m""")
def belongs_to_edges(spark, d):
    e = graph.capitalised(table(spark, d, "documents"))
    return graph.belongs_to(e.withColumn("modal_entity", F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))))


@query("SELECT 'ent-' || md5(l_suppkey::VARCHAR) AS ent_id, l_suppkey, count(*) AS n_mentions, count(DISTINCT l_partkey) AS n_sources FROM lineitem GROUP BY l_suppkey")
def graph_node_merge(spark, d):
    return graph.merge_nodes(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("SELECT l_suppkey AS src, l_partkey AS tgt, sum(l_linenumber)::BIGINT AS weight, count(*) AS n FROM lineitem GROUP BY ALL")
def graph_edge_merge(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("tgt"), F.col("l_linenumber").cast("long").alias("weight"))
    return graph.merge_edges(e)


@query("SELECT 'ent-' || md5(lang || '/' || source) AS ent_id, lang || '/' || source AS entity_name, max(doc_id) AS doc_id FROM documents GROUP BY ALL")
def main_entity_nodes(spark, d):
    items = table(spark, d, "documents").select(F.concat_ws("/", "lang", "source").alias("entity_name"), "doc_id")
    return graph.main_nodes(items, "entity_name", "doc_id")


@query("SELECT doc_id, string_agg(entity, ',' ORDER BY entity) AS entity_names, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_matches(w, '^[A-Z][a-z]{3,}[.,;:!?]*$')), lambda w: regexp_replace(w, '[.,;:!?]+$', '')))) AS entity FROM documents) GROUP BY doc_id")
def full_entities(spark, d):
    return graph.entity_names(graph.capitalised(table(spark, d, "documents")))


_COS = """pairs AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6) AS score
    FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0), naive AS (SELECT query_id, vec_id AS item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs WHERE score >= 0.2)"""
_EDGES = "edges AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS tgt FROM lineitem)"
_LOCAL = "local AS (SELECT DISTINCT query_id, tgt AS item FROM naive JOIN edges ON src = item WHERE rank <= 5)"
_GLOBAL = "global_ AS (SELECT DISTINCT query_id, src AS item FROM naive JOIN edges ON tgt = item WHERE rank <= 5)"


def _found(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return nearest.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


def _by_mode(spark, d, mode):
    near = _found(spark, d).select("query_id", F.col("vec_id").alias("node"))
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("tgt")).distinct()
    local = near.join(edges, F.col("node") == F.col("src")).select("query_id", F.col("tgt").alias("item"))
    global_ = near.join(edges, F.col("node") == F.col("tgt")).select("query_id", F.col("src").alias("item"))
    return retrieve.by_mode(mode, near.select("query_id", F.col("node").alias("item")), local, global_)


@query(f"WITH {_COS} SELECT query_id, item AS vec_id, score, rank FROM naive WHERE rank <= 5")
def vector_top_k(spark, d):
    return _found(spark, d).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_COS} SELECT query_id, item FROM naive WHERE rank <= 5")
def retrieve_naive(spark, d):
    return _by_mode(spark, d, "naive")


@query(f"WITH {_COS}, {_EDGES}, {_LOCAL} SELECT * FROM local")
def retrieve_local(spark, d):
    return _by_mode(spark, d, "local")


@query(f"WITH {_COS}, {_EDGES}, {_GLOBAL} SELECT * FROM global_")
def retrieve_global(spark, d):
    return _by_mode(spark, d, "global")


@query(f"WITH {_COS}, {_EDGES}, {_LOCAL}, {_GLOBAL} SELECT * FROM local UNION SELECT * FROM global_")
def retrieve_hybrid(spark, d):
    return _by_mode(spark, d, "hybrid")


@query(f"WITH {_COS}, {_EDGES}, {_LOCAL}, {_GLOBAL} SELECT * FROM local UNION SELECT * FROM global_ UNION SELECT query_id, item FROM naive WHERE rank <= 5")
def retrieve_mix(spark, d):
    return _by_mode(spark, d, "mix")


# Prompts, descriptions and marks


@query("""SELECT c_custkey, 'M:' || c_name || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || '【改进建议（请根据以下反馈改进）】' || chr(10) || c_mktsegment || chr(10) ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || '【上一版COA表格（请在此基础上改进）】' || chr(10) || 'old' || chr(10) ELSE '' END || chr(10) || 'end' AS prompt FROM customer""")
def planner_prompt(spark, d):
    prompt = text.plan_prompt(F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), F.when(F.col("c_custkey") % 3 == 0, F.lit("old")), "M:", "end")
    return table(spark, d, "customer").select("c_custkey", prompt.alias("prompt"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'c' || lang WHEN 1 THEN 't' || lang ELSE lang || chr(10) || source END AS context FROM documents")
def context_from_map(spark, d):
    m = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("text"), F.lit("x"), F.lit("content"), F.concat(F.lit("c"), F.col("lang")))).when(F.col("doc_id") % 3 == 1, F.create_map(F.lit("text"), F.concat(F.lit("t"), F.col("lang")), F.lit("z"), F.lit("y"))).otherwise(F.create_map(F.lit("b"), F.col("source"), F.lit("a"), F.col("lang")))
    return table(spark, d, "documents").select("doc_id", text.dict_context(m).alias("context"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Image path: ' || url WHEN 1 THEN 'Image path: ' || url || '; Image captions: c' || page_id || '; Image footnotes: f' ELSE 'Image content information incomplete' END AS description FROM pages""")
def query_image_description(spark, d):
    k = F.col("page_id") % 3
    described = text.image_description(F.when(k < 2, F.col("url")), F.when(k == 1, F.concat(F.lit("c"), F.col("page_id").cast("string"))), F.when(k == 1, F.lit("f")).otherwise(F.lit("")))
    return table(spark, d, "pages").select("page_id", described.alias("description"))


@query("SELECT doc_id, coalesce(base64(encode(text)), '') AS b64 FROM documents")
def base64_encode(spark, d):
    return table(spark, d, "documents").select("doc_id", text.base64_text(F.col("text").cast("binary")).alias("b64"))


@query("SELECT page_id, page_id % 5 IN (2) AND page_id % 7 <> 0 AND length(html) * 20000 <= 52428800 AS valid FROM pages")
def image_validity(spark, d):
    valid = retrieve.valid_image(F.col("path"), F.col("size"), F.col("page_id") % 7 == 0)
    sizes = table(spark, d, "pages").select("page_id", (F.length("html") * 20000).alias("size"))
    return _paths(spark, d).join(sizes, "page_id").select("page_id", valid.alias("valid"))


@query("SELECT event_id, event_type, CASE event_type WHEN 'click' THEN '点击' WHEN 'view' THEN '浏览' ELSE event_type END AS translation FROM events")
def rule_translation(spark, d):
    known = spark.sql("SELECT * FROM VALUES ('click', '点击'), ('view', '浏览') AS t(event_type, translation)")
    return control.translated(table(spark, d, "events").select("event_id", "event_type"), known, "event_type")


@query("""SELECT user_id, done, total FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS done, count(*) OVER (PARTITION BY user_id) AS total FROM events)
    WHERE done % greatest(1, floor(total * 0.1::DOUBLE)::BIGINT) = 0 OR done = total""")
def progress_marks(spark, d):
    return control.progress_marks(table(spark, d, "events"), "user_id")


@query("SELECT l_suppkey AS node, count(*) AS n_edges, count(DISTINCT l_partkey) AS n_neighbours FROM lineitem WHERE l_suppkey % 50 = 0 GROUP BY ALL")
def graph_neighbours(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("tgt"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("weight")).withColumn("src", F.col("src").cast("string"))
    nodes = table(spark, d, "supplier").where("s_suppkey % 50 = 0").select(F.col("s_suppkey").cast("string").alias("node"), F.col("s_suppkey").alias("query_id"))
    return retrieve.neighbours(nodes, edges).groupBy(F.col("query_id").alias("node")).agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("tgt").alias("n_neighbours"))


# Chains, assembled records and lists


_NAMES = "list_distinct(list_transform(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: regexp_matches(w, '^[A-Z][a-z]{{3,}}[.,;:!?]*$')), lambda w: regexp_replace(w, '[.,;:!?]+$', '')))"
_FOUND = f"e AS (SELECT doc_id, unnest({_NAMES.format('text')}) AS entity FROM documents)"


@query(f"""WITH {_FOUND}, o AS (SELECT DISTINCT doc_id, 'Doc ' || doc_id AS modal_entity FROM labels)
    SELECT doc_id, entity, modal_entity, 'rel-' || md5(entity || modal_entity) AS rel_id FROM e LEFT JOIN o USING (doc_id)""")
def chunk_result_owner(spark, d):
    owners = table(spark, d, "labels").select("doc_id", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("modal_entity"), F.lit(0).alias("ord"))
    found = graph.with_owner(graph.capitalised(table(spark, d, "documents")), owners, ["doc_id"])
    return found.withColumn("rel_id", ids.relation_id(F.col("entity"), F.col("modal_entity")))


@query(f"""WITH {_FOUND}, u AS (SELECT * FROM e UNION SELECT doc_id, 'Label ' || quality FROM labels UNION SELECT doc_id, 'Known' FROM labels)
    SELECT doc_id, string_agg(entity, ',' ORDER BY entity) AS entity_names, count(*) AS n FROM u GROUP BY doc_id""")
def entity_names_union(spark, d):
    names = F.array(F.concat(F.lit("Label "), F.col("quality").cast("string")), F.lit("Known"))
    stored = table(spark, d, "labels").select("doc_id", F.explode(names).alias("entity"))
    return graph.with_stored(graph.capitalised(table(spark, d, "documents")), stored)


@query("SELECT c_custkey, n_name AS model, r_name AS provider FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def agent_settings(spark, d):
    models = table(spark, d, "region").select(F.col("r_regionkey").alias("model_id"), F.col("r_name").alias("provider"))
    agents = table(spark, d, "nation").select(F.col("n_nationkey").alias("agent_id"), F.col("n_name").alias("model"), F.col("n_regionkey").alias("model_id"))
    customers = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("agent_id"))
    return control.settings_of(control.settings_of(customers, agents, "agent_id"), models, "model_id").select("c_custkey", "model", "provider")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'none' END AS brand, p_size::VARCHAR AS size, 'none' AS absent, NULL::VARCHAR AS nothing FROM part")
def nested_setting(spark, d):
    part = table(spark, d, "part")
    limits = F.concat(F.lit('"limits": {"size": '), F.col("p_size").cast("string"), F.lit("}"))
    brand = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"brand": "'), "p_brand", F.lit('", '))).otherwise(F.lit(""))
    settings = part.select("p_partkey", F.concat(F.lit('{"model": {'), brand, limits, F.lit("}}")).alias("s"))
    get = lambda path, default=None: text.config_value(F.col("s"), path, default)
    return settings.select("p_partkey", get("model.brand", "none").alias("brand"), get("model.limits.size").alias("size"), get("model.limits.size.unit", "none").alias("absent"), get("other").alias("nothing"))


@query(f"WITH {_TASKS}, e AS (SELECT unit, task_id, unnest(CASE WHEN start_condition = '' AND end_condition = '' AND location = '' THEN ['GENERAL'] ELSE list_filter(list_distinct([start_condition, end_condition, CASE WHEN location <> '' THEN 'at_' || location ELSE '' END]), lambda x: x <> '') END) AS event FROM tasks) SELECT unit AS entity, event, task_id FROM e")
def event_matrix_tasks(spark, d):
    return matrix.event_tasks(_tasks(spark, d))


@query(_CELLS + f""", c1 AS (SELECT plan_id, n_nationkey, phase_id, string_agg(action, '; ' ORDER BY k) AS a FROM c GROUP BY ALL), n AS (SELECT DISTINCT r_regionkey::BIGINT AS plan_id, r_name, n_nationkey, n_name FROM counts),
    u AS (SELECT plan_id, any_value(r_name) AS name, string_agg('N_' || n_nationkey, ',' ORDER BY n_nationkey) AS units, string_agg('E' || n_nationkey, ',' ORDER BY n_nationkey) AS effects, string_agg('D' || n_nationkey || ':3', ',' ORDER BY n_nationkey) AS decisions, string_agg('delay in ' || n_name, ',' ORDER BY n_nationkey) AS risks FROM n GROUP BY plan_id),
    h AS (SELECT plan_id, string_agg(p, ',' ORDER BY p) AS phases FROM (SELECT DISTINCT r_regionkey::BIGINT AS plan_id, o_orderpriority AS p FROM counts) GROUP BY plan_id),
    m AS (SELECT plan_id, string_agg('N_' || n_nationkey || '/' || phase_id || '=' || a, chr(10) ORDER BY n_nationkey, phase_id) AS cells FROM c1 GROUP BY plan_id)
    SELECT plan_id, name, 'Orders of ' || name AS overview, units, phases, cells, effects, decisions, risks FROM u JOIN h USING (plan_id) JOIN m USING (plan_id)""")
def plan_record(spark, d):
    joined = lambda name, f, sep=",": F.array_join(F.transform(name, f), sep).alias(name)
    return markdown.assemble(fx.plans(spark, d)).select(
        "plan_id", "name", "overview", joined("units", lambda u: u["unit_id"]), joined("phases", lambda p: p["name"]),
        joined("cells", lambda c: F.concat(c["unit_id"], F.lit("/"), c["phase_id"], F.lit("="), F.array_join(c["actions"], "; ")), "\n"),
        joined("effects", lambda e: e["effect_id"]), joined("decisions", lambda x: F.concat(x["dp_id"], F.lit(":"), F.size(x["options"]).cast("string"))), joined("risks", lambda r: r["description"]),
    )


@query(f"""WITH {BLK}, i AS (SELECT doc_id, md5(string_agg(type || ':' || text, chr(10) ORDER BY block_idx)) AS content, string_agg(chr(10) || 'Related ' || type || ' content: ' || text, chr(10) ORDER BY block_idx) AS body FROM blk WHERE type <> 'text' AND doc_id % 4 <> 0 GROUP BY doc_id),
    q AS (SELECT d.doc_id, 'what is in ' || lang AS query, body, CASE WHEN content IS NOT NULL THEN 'multimodal_query:' || md5('content=' || content || chr(10) || 'mode=mix' || chr(10) || 'query=what is in ' || lang) END AS key FROM documents d LEFT JOIN i USING (doc_id)), c AS (SELECT DISTINCT key FROM q WHERE doc_id % 3 = 0 AND key IS NOT NULL)
    SELECT doc_id, q.key AS key, c.key IS NOT NULL AS hit, CASE WHEN c.key IS NOT NULL THEN 'stored' WHEN q.key IS NULL THEN md5(query) ELSE md5('User query: ' || query || chr(10) || body || '{retrieve.SUFFIX}') END AS answer FROM q LEFT JOIN c ON q.key = c.key""")
def multimodal_query_chain(spark, d):
    queries = table(spark, d, "documents").select("doc_id", F.concat(F.lit("what is in "), "lang").alias("query"), F.lit("mix").alias("mode"))
    items = fx.blocks(spark, d).where("type <> 'text' AND doc_id % 4 <> 0").withColumn("description", F.col("text"))
    keyed = retrieve.keyed_queries(queries, items)
    cache = keyed.where("doc_id % 3 = 0 AND key IS NOT NULL").select("key", F.lit("stored").alias("answer"))
    return retrieve.answered(keyed, cache, lambda rows: rows.withColumn("answer", ids.digest(F.col("text"))))[0]


@query(f"""WITH {BLK}, c AS (SELECT doc_id, block_idx, {_CHUNK} AS chunk FROM blk WHERE type <> 'text'), e AS (SELECT doc_id, sum(len({_NAMES.format('chunk')}))::BIGINT AS n_edges FROM (SELECT DISTINCT doc_id, chunk FROM c) GROUP BY doc_id)
    SELECT c.doc_id, md5('first,' || string_agg('chunk-' || md5(chunk), ',' ORDER BY block_idx)) AS chunks, count(*) + 1 AS n_chunks, 1::BIGINT AS first_index, count(*) AS n_nodes, n_edges FROM c JOIN e USING (doc_id) GROUP BY c.doc_id, n_edges""")
def multimodal_batch(spark, d):
    status = table(spark, d, "documents").select("doc_id", F.array(F.lit("first")).alias("chunks"), F.lit(1).cast("long").alias("n_chunks"))
    extract = lambda c: graph.capitalised(c.select(F.struct("doc_id", "chunk_id").alias("doc_id"), "text")).select("doc_id.*", "entity")
    name = F.concat_ws(" ", "type", "doc_id", "block_idx")
    out = batch.process(_captioned(spark, d), status, lambda rows: rows, extract, name)
    chunks = out["chunks"].groupBy("doc_id").agg(F.min("ord").alias("first_index"))
    nodes = out["nodes"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    edges = out["edges"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_edges"))
    found = chunks.join(nodes, "doc_id").join(edges, "doc_id", "left").fillna(0, ["n_edges"])
    return found.join(out["status"], "doc_id").withColumn("chunks", ids.digest(F.array_join("chunks", ",")))


@query(f"""WITH {BLK} SELECT doc_id, list_transform(list_sort(list({{'b': block_idx, 'c': 'chunk-' || md5(text)}}) FILTER (type = 'text')), lambda x: x.c) IS NOT NULL AS has_text, md5(concat_ws(',', string_agg('chunk-' || md5(text), ',' ORDER BY block_idx) FILTER (type = 'text'), string_agg('chunk-' || md5(text), ',' ORDER BY block_idx) FILTER (type <> 'text'))) AS chunks, count(*) AS n_chunks FROM blk GROUP BY doc_id""")
def doc_status_chunks(spark, d):
    b = fx.blocks(spark, d).withColumns({"chunk_id": ids.prefixed("chunk-", F.col("text")), "ord": F.col("block_idx")})
    none = b.select("doc_id").distinct().select("doc_id", F.array().cast("array<string>").alias("chunks"), F.lit(0).cast("long").alias("n_chunks"))
    texts = control.append_chunks(none, b.where("type = 'text'"))
    out = control.append_chunks(texts, b.where("type <> 'text'"))
    has = texts.select("doc_id", (F.size("chunks") > 0).alias("has_text"))
    return out.join(has, "doc_id").select("doc_id", "has_text", ids.digest(F.array_join("chunks", ",")).alias("chunks"), "n_chunks")


@query("""SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 6)::DOUBLE AS success_rate,
    count(*) FILTER (event_type <> 'error' AND event_id % 5 > 0) AS inserted, count(*) FILTER (event_type <> 'error' AND event_id % 5 = 0) AS insert_failed FROM events""")
def parse_then_insert(spark, d):
    return control.parse_then_insert(table(spark, d, "events"), F.col("event_type") != "error", F.col("event_id") % 5 > 0)


@query(f"""WITH {BLK} SELECT doc_id, block_idx, CASE WHEN block_idx % 2 = 0 THEN 'own' ELSE text END AS item FROM blk WHERE type <> 'text'""")
def wrapped_item(spark, d):
    b = fx.blocks(spark, d).where("type <> 'text'")
    wrapped = text.wrapped_item(F.when(F.col("block_idx") % 2 == 0, F.lit(' {"item": "own"}')).otherwise(F.col("text")), F.col("type"))
    value = F.coalesce(*[F.get_json_object("w", f"$.{key}") for key in ("item", *text.WRAPPERS.values(), text.WRAPPER)])
    return b.select("doc_id", "block_idx", wrapped.alias("w")).select("doc_id", "block_idx", value.alias("item"))


@query(f"WITH {BLK} SELECT doc_id, block_idx, CASE WHEN block_idx % 2 = 0 THEN 'seen ' || type ELSE type || ' content: ' || left(text, 100) END AS description FROM blk WHERE type <> 'text'")
def query_item_description(spark, d):
    described = F.when(F.col("block_idx") % 2 == 0, F.concat(F.lit("seen "), "type"))
    return fx.blocks(spark, d).where("type <> 'text'").select("doc_id", "block_idx", text.query_description(F.col("type"), F.col("text"), described).alias("description"))


@query("""SELECT page_id, md5('file_path=' || url || chr(10) || CASE WHEN page_id % 2 = 0 THEN 'lang=en' || chr(10) ELSE '' END || 'mtime=' || page_id || chr(10) || 'parse_method=auto' || chr(10) || 'parser=own' || CASE WHEN page_id % 2 = 1 THEN chr(10) || 'start_page=' || (page_id % 9) ELSE '' END) AS key FROM pages""")
def parse_cache_key(spark, d):
    even = F.create_map(F.lit("lang"), F.lit("en"), F.lit("colour"), F.lit("red"))
    odd = F.create_map(F.lit("start_page"), (F.col("page_id") % 9).cast("string"), F.lit("workers"), F.lit("4"))
    key = ids.parse_key(F.col("url"), F.col("page_id"), F.lit("own"), F.lit("auto"), F.when(F.col("page_id") % 2 == 0, even).otherwise(odd))
    return table(spark, d, "pages").select("page_id", key.alias("key"))


@query(f"WITH {BLK}, p AS (SELECT DISTINCT CASE WHEN type IN ('image', 'equation') THEN type ELSE 'generic' END AS processor FROM blk WHERE type <> 'table'), f(processor, feature) AS (VALUES {', '.join(f'({k!r}, {x!r})' for k, v in blocks.SUPPORTS.items() for x in v)}) SELECT processor, feature FROM p JOIN f USING (processor)")
def processor_features(spark, d):
    return blocks.features(fx.blocks(spark, d).select(blocks.processor_of(F.col("type"), ("table",)).alias("processor")))


# Streaming, with the batch result in SQL


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    return status.run_daily_counts(spark, f"{d}/events.parquet")


@query(f"SELECT user_id, arg_max({_STATE}, (ts, event_id)) AS status, count(*) AS n FROM events GROUP BY user_id")
def stream_status(spark, d):
    return status.run_latest_status(spark, f"{d}/events.parquet", F.expr(_STATE))


_PATH = "concat('/in/', source, '/', doc_id, CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.docx' WHEN 3 THEN '.md' WHEN 4 THEN '.zip' ELSE '' END)"


@query(f"""SELECT {_PATH} AS path, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'office' ELSE 'text' END AS parser, concat('/out/', source, '/', doc_id) AS folder FROM documents WHERE doc_id % 6 < 4""")
def batch_dry_run(spark, d):
    return files.batch_plan(table(spark, d, "documents").select(F.expr(_PATH).alias("path")), "path", "/in", "/out/")


@query("""SELECT doc_id, md5(concat_ws('|', lang, CASE WHEN trim(text, ' ' || chr(9) || chr(10)) <> '' THEN trim(text, ' ' || chr(9) || chr(10)) END, source, 'end')) AS lines FROM documents""")
def ocr_result_lines(spark, d):
    record = F.struct(F.array(F.col("lang")).alias("rec_texts"), F.col("text"))
    result = F.concat(F.lit("[["), F.to_json(record), F.lit(',{"page":[[[[0,0],[9,9]],["'), F.col("source"), F.lit('",0.9]],null,["end",1]]}]]'))
    return table(spark, d, "documents").select("doc_id", ids.digest(F.array_join(ocr.ocr_lines(result), "|")).alias("lines"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'vision' ELSE 'plain' END AS via, CASE WHEN doc_id % 3 = 0 THEN 'text|image|text' ELSE lang END AS answer FROM documents""")
def vision_query_fallback(spark, d):
    prompt = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("\n[VLM_IMAGE_1]\nwhat is this"))).otherwise(F.col("lang"))
    prompts = table(spark, d, "documents").select("doc_id", prompt.alias("prompt"))
    shown = lambda rows: rows.withColumn("answer", F.array_join(F.transform("parts", lambda x: x["type"]), "|"))
    return retrieve.vision_or_plain(prompts, shown, lambda rows: rows.withColumn("answer", F.col("prompt")))


_RULES = ", ".join(f"('{a or ''}', '{b}')" for a, after in machine.RULES.items() for b in after)
_LIMIT = int(machine.LIMITS["handling"] * 3_600_000_000)


@query(f"""WITH RECURSIVE rules(a, b) AS (VALUES {_RULES}), cut AS (SELECT epoch_us(max(ts)) // 1000 * 1000 - 86400000000 AS cut FROM events),
    e AS (SELECT user_id, epoch_us(ts) AS tm, {_STATE} AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events, cut WHERE epoch_us(ts) <= cut),
    s(user_id, i, status, since, ok, bad, late) AS (SELECT DISTINCT user_id, 0::BIGINT, '', 0::BIGINT, 0, 0, 0 FROM e UNION ALL
        SELECT user_id, i, CASE WHEN ok THEN status ELSE was END, CASE WHEN ok THEN tm WHEN timed THEN since + {_LIMIT} ELSE since END, n + ok::INT, bad + (NOT ok AND status <> was)::INT, late + timed::INT
        FROM (SELECT *, (was, status) IN (SELECT (a, b) FROM rules) AS ok FROM (SELECT e.*, s.since, s.ok AS n, s.bad, s.late, s.status = 'handling' AND s.since + {_LIMIT} < e.tm AS timed, CASE WHEN s.status = 'handling' AND s.since + {_LIMIT} < e.tm THEN 'failed' ELSE s.status END AS was
            FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))),
    f AS (SELECT * FROM s WHERE i > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1)
    SELECT user_id::VARCHAR AS doc_id, nullif(CASE WHEN status = 'handling' AND since + {_LIMIT} < cut THEN 'failed' ELSE status END, '') AS status, ok::BIGINT AS n_changes, bad::BIGINT AS n_forbidden, 0::BIGINT AS n_late, (late + (status = 'handling' AND since + {_LIMIT} < cut)::INT)::BIGINT AS n_timeouts FROM f, cut""")
def stream_status_machine(spark, d):
    events = status.read_events(spark, f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("doc_id"), "event_id", "ts", F.expr(_STATE).alias("status"))
    return machine.final_status(machine.run_changes(spark, events, new_folder(spark, "machine")))


def _parsed(spark, d):
    """Documents as parses: two of each key in every batch of three; the settings are the language, the payload the text's digest."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.concat(F.lit("k"), F.expr("doc_id div 6").cast("string")).alias("key"), F.col("n_chars").alias("mtime"), F.col("lang").alias("config"), ids.digest(F.col("text")).alias("payload"))


@query("""WITH p AS (SELECT doc_id, 'k' || (doc_id // 6) AS key, n_chars AS mtime, lang AS config, md5(text) AS payload FROM documents),
    b AS (SELECT key, doc_id % 3 AS b, arg_max((mtime, config, payload, doc_id), doc_id) AS r FROM p GROUP BY ALL), one AS (SELECT key, arg_max(r, b) AS r FROM b WHERE b < 2 GROUP BY key),
    gone AS (SELECT DISTINCT p.key FROM p JOIN one ON one.key = p.key WHERE doc_id % 3 = 2 AND doc_id % 6 = 2 AND (mtime <> r[1] OR config <> r[2])),
    kept AS (SELECT * FROM one WHERE key NOT IN (SELECT key FROM gone)), two AS (SELECT key, r FROM b WHERE b = 2 AND r[2] = 'en'),
    s AS (SELECT * FROM two UNION ALL SELECT * FROM kept WHERE key NOT IN (SELECT key FROM two))
    SELECT p.doc_id, p.key, coalesce(r[1] = mtime AND r[2] = config AND r[3] <> '', false) AS hit, r[4] AS stored FROM p LEFT JOIN s ON s.key = p.key""")
def parse_store(spark, d):
    """Two batches of parses are stored, what a third finds changed is taken out, its English ones are stored, and all are probed."""
    store = KeyedStore(spark, new_folder(spark, "parses"), "key", "key string, mtime long, config string, payload string, doc_id long")
    rows = _parsed(spark, d)
    for b in (0, 1):
        store.upsert(rows.where(F.col("doc_id") % 3 == b), "doc_id")
    store.delete(control.invalid(rows.where(F.col("doc_id") % 6 == 2).select("key", "mtime", "config"), store.read(), "key"))
    third = rows.where(F.col("doc_id") % 3 == 2)
    last = third.groupBy("key").agg(F.max_by(F.struct("mtime", "config", "payload", "doc_id"), "doc_id").alias("r")).select("key", "r.*")
    store.upsert(last.where("config = 'en'"), "doc_id")
    stored = store.read()
    probed = control.cache_probe(rows.select("doc_id", "key", "mtime", "config"), stored, "key")
    return probed.join(stored.select("key", F.col("doc_id").alias("stored")), "key", "left").select("doc_id", "key", "hit", "stored")


def _bundles(spark, d):
    """A line a document: its name and its blocks as a content list (those of ``_captioned``); some are cut, no JSON, or without blocks."""

    def block(text, i):
        kind = F.element_at(F.array(*map(F.lit, ("image", "table", "equation", "custom_type", "text", "text", "text"))), i % 7 + 1)
        captions = F.when(i % 2 == 0, F.array(F.concat(F.lit("c"), i.cast("string"))))
        only = lambda name, x: F.when(kind == name, x)
        fields = {
            "type": kind, "page_idx": F.floor(i / 10), "text": F.when(kind.isin("text", "image"), text), "img_path": F.concat(F.col("doc_id").cast("string"), F.lit(".png")), "image_caption": only("image", captions),
            "table_caption": only("table", captions), "table_body": only("table", text), "latex": only("equation", text), "text_format": only("equation", F.lit("latex")), "content": only("custom_type", text),
        }
        return F.struct(*[x.alias(name) for name, x in fields.items()])

    lists = table(spark, d, "documents").select("doc_id", F.to_json(F.transform(F.split("text", "\n"), block)).alias("j"))
    body = F.when(F.col("doc_id") % 10 == 3, F.expr("left(j, length(j) div 2)")).when(F.col("doc_id") % 10 == 7, "no json").when(F.col("doc_id") % 50 == 9, "[]").otherwise(F.col("j"))
    return lists.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("\t"), body).alias("value"))


def _slots():
    """Stand-ins for models; each fails on some lengths, and the individual ones on fewer."""
    fails = lambda n: F.when(F.length("text") % n == 0, F.lit("refused")).alias("error")
    describe = lambda n: lambda rows: rows.select("*", F.substring("text", 1, 100).alias("description"), fails(n))
    extract = lambda n: lambda rows: rows.select("*", graph.capitalised_words(F.col("text")).alias("entities"), fails(n))
    return insert.Slots(describe(5), describe(10), extract(11), extract(22))


@query(f"""WITH {BLK}, g AS (SELECT * FROM blk WHERE doc_id % 10 NOT IN (3, 7) AND doc_id % 50 <> 9), t AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY block_idx) FILTER (type = 'text' AND trim(text) <> '') AS text FROM g GROUP BY doc_id),
    w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM t WHERE text IS NOT NULL), s AS (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1, 180)) AS s FROM w WHERE len(w) > 0),
    c AS (SELECT doc_id, array_to_string(w[s + 1 : s + 200], ' ') AS text FROM s WHERE s = 0 OR s + 20 < len(w) UNION ALL SELECT doc_id, {_CHUNK} FROM g WHERE type <> 'text' AND length(text) % 10 <> 0),
    x AS (SELECT DISTINCT doc_id, text FROM c), e AS (SELECT doc_id, count(DISTINCT entity) AS n_entities FROM (SELECT doc_id, unnest({_NAMES.format("text")}) AS entity FROM x WHERE length(text) % 22 <> 0) GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS n_chunks FROM c GROUP BY doc_id), i AS (SELECT doc_id, count(*) FILTER (type <> 'text') AS n_items, count(*) FILTER (type <> 'text' AND length(text) % 10 = 0) AS n_failed_items FROM g GROUP BY doc_id), f AS (SELECT doc_id, count(*) AS n_failed_chunks FROM x WHERE length(text) % 22 = 0 GROUP BY doc_id)
    SELECT 'doc-' || d.doc_id AS doc_id, CASE WHEN i.doc_id IS NULL THEN 'failed' ELSE 'processed' END AS status, CASE WHEN d.doc_id % 10 IN (3, 7) THEN 'no content list' WHEN d.doc_id % 50 = 9 THEN 'no blocks' END AS error, i.doc_id IS NOT NULL AS multimodal_processed,
        coalesce(n_chunks, 0) AS n_chunks, coalesce(n_items, 0) AS n_items, coalesce(n_failed_items, 0) AS n_failed_items, coalesce(n_failed_chunks, 0) AS n_failed_chunks, coalesce(n_entities, 0) AS n_entities
    FROM documents d LEFT JOIN i USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN e USING (doc_id)""")
def files_to_statuses(spark, d):
    """Content lists are written as files, read, processed and stored; the statuses come from the store."""
    folder = new_folder(spark, "bundles")
    _bundles(spark, d).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(f"{folder}/in")
    parsed, unread = files.read_bundles(spark, f"{folder}/in")
    out = insert.insert(insert.items_of(parsed), unread, _slots(), F.concat_ws(" ", "type", "doc_id", "block_idx"), 200, 20)
    chunks, states = KeyedStore(spark, f"{folder}/chunks", "chunk_id", insert.CHUNKS), KeyedStore(spark, f"{folder}/status", "doc_id", insert.STATUS)
    insert.commit(out, chunks, states)
    entities = out["entities"].groupBy("doc_id").agg(F.countDistinct("entity").alias("n_entities"))
    return states.read().join(entities, "doc_id", "left").withColumn("n_entities", F.coalesce("n_entities", F.lit(0).cast("long")))


@query(r"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '\frac{a}{b} \alpha ' || event_type WHEN 1 THEN 'say "' || event_type || '" now' WHEN 2 THEN 'a,} ' || event_type || ',]' WHEN 3 THEN 'curly ' || event_type WHEN 4 THEN 'tab' || chr(9) || event_type ELSE 'C:\dir "' || event_type || '"' END AS text,
    CASE event_id % 6 WHEN 2 THEN 2 ELSE 1 END::BIGINT AS n FROM events""")
def json_repair(spark, d):
    """Replies with LaTeX, quotes, commas and brackets inside strings, curly quotes, and a valid one."""
    kinds = [r'{"d": "\frac{a}{b} \alpha @", "n": 1}', '{"d": "say "@" now", "n": 1,}', '{"d": "a,} @,]", "n": 2, "l": [1, 2,],}', "{“d”: “curly @”, “n”: 1}", r'{"d": "tab\t@", "n": 1}', r'{"d": "C:\dir "@"", "n": 1}']
    raw = F.replace(F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 6 + 1).cast("int")), F.lit("@"), F.col("event_type"))
    parsed = table(spark, d, "events").select("event_id", text.parse_json(F.concat(F.lit("Reply: "), raw)).alias("v"))
    return parsed.select("event_id", F.try_variant_get("v", "$.d", "string").alias("text"), F.try_variant_get("v", "$.n", "bigint").alias("n"))


@query("""SELECT r AS doc_id, CASE WHEN o IS NOT NULL THEN 'o' || o WHEN c IS NOT NULL THEN 'c' || c WHEN n IS NOT NULL THEN 'n' || n ELSE 'body' END AS node_id, row_number() OVER (PARTITION BY r ORDER BY n, c, o) - 1 AS ord
    FROM (SELECT r_regionkey::BIGINT AS r, n_nationkey AS n, c_custkey AS c, o_orderkey AS o FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey)""")
def tree_leaves(spark, d):
    """Regions as trees of nations, customers and orders: their leaves in depth-first order."""
    t = lambda name: table(spark, d, name)
    at = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    region = F.col("n_regionkey").cast("long").alias("doc_id")
    nations = t("nation").select(region, at("n", "n_nationkey").alias("node_id"), F.lit("body").alias("parent_id"), F.col("n_nationkey").cast("long").alias("child_idx"), "n_nationkey")
    customers = t("customer").join(F.broadcast(nations.select("doc_id", "n_nationkey")), F.col("c_nationkey") == F.col("n_nationkey")).select("doc_id", at("c", "c_custkey").alias("node_id"), at("n", "c_nationkey").alias("parent_id"), F.col("c_custkey").cast("long").alias("child_idx"), "c_custkey")
    orders = t("orders").join(customers.select("doc_id", "c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select("doc_id", at("o", "o_orderkey").alias("node_id"), at("c", "o_custkey").alias("parent_id"), F.col("o_orderkey").cast("long").alias("child_idx"))
    roots = t("region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit("body").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("child_idx"))
    nodes = roots.unionByName(nations.drop("n_nationkey")).unionByName(customers.drop("c_custkey")).unionByName(orders)
    return tree.flatten_nodes(nodes).select("doc_id", "node_id", "ord")


@query("""WITH e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), l AS (SELECT a AS node, b AS nxt FROM e UNION SELECT b, a FROM e), h0 AS (SELECT s_suppkey AS query_id, 's' || s_suppkey AS node FROM supplier WHERE s_suppkey % 50 = 0),
    h1 AS (SELECT * FROM (SELECT DISTINCT query_id, nxt AS node FROM h0 JOIN l USING (node)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY node) <= 99), n AS (SELECT query_id, count(*) + 1 AS have FROM h1 GROUP BY 1),
    h2 AS (SELECT query_id, node FROM (SELECT DISTINCT query_id, nxt AS node, have FROM h1 JOIN n USING (query_id) JOIN l USING (node)) WHERE (query_id, node) NOT IN (SELECT (query_id, node) FROM h0) AND (query_id, node) NOT IN (SELECT (query_id, node) FROM h1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY node) + have <= 100)
    SELECT query_id, node, 0 AS hop FROM h0 UNION ALL SELECT query_id, node, 1 FROM h1 UNION ALL SELECT query_id, node, 2 FROM h2""")
def neighbour_walk(spark, d):
    """Suppliers and parts within two hops of a supplier, 100 at most."""
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("tgt"))
    starts = table(spark, d, "supplier").where("s_suppkey % 50 = 0").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return walk.neighbourhood(starts, edges, 2, 100)


def _told(spark, d):
    """Each document tells of its source, a node, and of its language, which the source belongs to; the batch is its id's parity."""
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", F.col("doc_id").cast("string").alias("source_id"), F.concat(F.lit("said "), (F.col("n_chars") % 9).cast("string")).alias("description"))
    nodes = rows.select("doc_id", F.col("source").alias("name"), F.col("lang").alias("type"), "description", "source_id")
    return nodes, rows.select("doc_id", F.col("source").alias("src"), F.col("lang").alias("tgt"), F.lit("belongs_to").alias("keywords"), "description", F.lit(2.0).alias("weight"), "source_id")


def _stored_parts(spark, d, which):
    nodes, edges = _told(spark, d)
    rows, make, schema = ((nodes, graph.node_parts, graph.NODE_PARTS), (edges, graph.edge_parts, graph.EDGE_PARTS))[which]
    store = KeyedStore(spark, new_folder(spark, "graph"), "key", schema)
    for b in (0, 1, 0):  # the first batch comes a second time
        store.upsert(make(rows.where(F.col("doc_id") % 2 == b)))
    return store.read()


@query("""WITH t AS (SELECT source AS name, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL), k AS (SELECT name, arg_min(lang, (-n, lang)) AS type FROM t GROUP BY name)
    SELECT source AS name, type, count(DISTINCT n_chars % 9) AS n_descriptions, count(*) AS n_sources FROM documents JOIN k ON name = source GROUP BY source, type""")
def stored_graph_nodes(spark, d):
    return graph.united_nodes(_stored_parts(spark, d, 0))


@query("SELECT least(source, lang) AS src, greatest(source, lang) AS tgt, sum(2.0)::DOUBLE AS weight, count(*) AS n_sources FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL")
def stored_graph_edges(spark, d):
    return graph.united_edges(_stored_parts(spark, d, 1))


@query("""SELECT p_partkey, '{"empty":{},"list":[],"model":{"keys":["' || n.n_name || '",{"deep":"' || p_brand || ' \\"q\\""}],"limit":' || p_partkey || ',"none":null,"on":true,"other":' || CASE WHEN p_partkey % 30 < 25 THEN '"' || e.n_name || '"' ELSE '"dflt"' END || '},"plain":null}' AS settings
    FROM part JOIN nation n ON n.n_nationkey = p_partkey % 25 LEFT JOIN nation e ON e.n_nationkey = p_partkey % 30""")
def nested_settings(spark, d):
    """Settings three levels deep, whose variables are the nations' names."""
    raw = F.concat(F.lit('{"plain": "${NONE}", "model": {"limit": '), F.col("p_partkey").cast("string"), F.lit(', "on": true, "none": null, "keys": ["${N'), (F.col("p_partkey") % 25).cast("string"), F.lit('}", {"deep": "'), "p_brand", F.lit(' \\"q\\""}], "other": "${N'), (F.col("p_partkey") % 30).cast("string"), F.lit(':dflt}"}, "empty": {}, "list": []}'))
    env = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("value"))
    return settings.substituted(table(spark, d, "part").select("p_partkey", raw.alias("settings")), env, "p_partkey")


def _letters(texts):
    """A stand-in tokenizer: runs of letters or digits, and every other visible character."""
    import re

    return [[m.span() for m in re.finditer(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]", t)] for t in texts]


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9[:space:]]') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 90)) AS s FROM t)
    SELECT doc_id, s // 90 AS chunk_idx, len(w[s + 1 : s + 100])::BIGINT AS n_tokens, md5(array_to_string(w[s + 1 : s + 100], '')) AS digest FROM s WHERE s = 0 OR s + 10 < len(w)""")
def token_chunking(spark, d):
    chunks = tokens.token_chunks(table(spark, d, "documents"), _letters, 100, 10)
    return chunks.select("doc_id", "chunk_idx", "n_tokens", ids.digest(F.regexp_replace("text", r"\s+", "")).alias("digest"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'é' || lang END AS text FROM documents")
def decoded_text(spark, d):
    """Bytes in UTF-8, and in Latin-1 where they are no UTF-8."""
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.concat(F.unhex(F.lit("E9")), F.encode("lang", "UTF-8")))
    return table(spark, d, "documents").select("doc_id", files.decode_text(content).alias("text"))


@query("SELECT doc_id, '<b>' || source || '</b> and <code>' || lang || '</code> &lt;<i>' || doc_id || '</i>&gt; <a href=\"u\">t</a>' AS html FROM documents")
def inline_markdown(spark, d):
    line = F.concat(F.lit("**"), "source", F.lit("** and `"), "lang", F.lit("` <*"), F.col("doc_id").cast("string"), F.lit("*> [t](u)"))
    return table(spark, d, "documents").select("doc_id", text.inline_markdown(line).alias("html"))


@query("""WITH d AS (SELECT lang || '/' || source AS key, doc_id, n_chars FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL), a AS (SELECT key, doc_id % 2 AS b, arg_max(n_chars, doc_id) AS n_chars, max(doc_id) AS doc_id FROM d GROUP BY ALL)
    SELECT key, arg_max(doc_id, b) AS doc_id, arg_max(n_chars, b) AS n_chars FROM a GROUP BY key""")
def keyed_overwrite(spark, d):
    """Rows of odd ids over those of even ones, by language and source."""
    rows = table(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select(F.concat_ws("/", "lang", "source").alias("key"), "doc_id", "n_chars")
    return control.upsert(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), "key", "doc_id")


@query("""WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN source WHEN 2 THEN lang || chr(10) || source ELSE text END AS t FROM documents), p AS (SELECT *, left(t, 300) AS cut FROM c),
    q AS (SELECT *, length(cut) AS n, CASE WHEN contains(cut, '.') THEN length(cut) - instr(reverse(cut), '.') ELSE -1 END AS dot, CASE WHEN contains(cut, chr(10)) THEN length(cut) - instr(reverse(cut), chr(10)) ELSE -1 END AS nl FROM p)
    SELECT doc_id, coalesce(CASE WHEN length(t) <= 300 THEN t WHEN dot > 0.8 * n THEN left(cut, dot + 1) WHEN nl > 0.8 * n THEN left(cut, nl) ELSE cut || '...' END, '') AS context FROM q""")
def context_from_any(spark, d):
    """Contexts from maps with a content, with a text, with other keys, and from plain texts."""
    kind = F.col("doc_id") % 4
    as_map = F.when(kind == 0, F.create_map(F.lit("content"), "text")).when(kind == 1, F.create_map(F.lit("text"), "source", F.lit("z"), "lang")).when(kind == 2, F.create_map(F.lit("b"), "source", F.lit("a"), "lang"))
    return table(spark, d, "documents").select("doc_id", text.source_context(as_map, F.col("text"), 300).alias("context"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '- ' || event_type WHEN 2 THEN '- ' || event_type || chr(10) || '- u' || user_id ELSE '- ' || event_type || chr(10) || '- u' || user_id || chr(10) || '- third' END AS issues FROM events")
def first_three_issues(spark, d):
    named = F.slice(F.array("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("third"), F.lit("fourth")), F.lit(1), (F.col("event_id") % 5).cast("int"))
    return table(spark, d, "events").select("event_id", text.first_issues(named).alias("issues"))
