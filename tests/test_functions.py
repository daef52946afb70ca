"""Rules of the parsers and builders on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from foliate import catalog
from foliate.functions import ids, text
from foliate.operators import blocks, control, retrieve
from foliate.plans import markdown, matrix
from foliate.sources import files, ocr, tree


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("cell", "actions"),
    [("A; B", ["A; B"]), ("-", []), ("—", []), ("N/A", []), ("  ", []), ("intro 1. A 2. B", ["intro", "A", "B"]), ("1. A\n2. B", ["A", "B"]), ("plain", ["plain"])],
)
def test_action_cell(spark, cell, actions):
    assert one(spark, cell, text.action_cell) == actions


@pytest.mark.parametrize(("line", "cells"), [("| a | b |", ["a", "b"]), ("a|b", ["a", "b"]), ("| a || c |", ["a", "", "c"]), ("|a|", ["a"])])
def test_row_cells(spark, line, cells):
    assert one(spark, line, text.row_cells) == cells


@pytest.mark.parametrize(
    ("options", "want"),
    [("若A，则B；C", [("A", "B"), ("default", "C")]), ("if x then y", [("x", "y")]), ("a: b", [("a", "b")]), ("", [])],
)
def test_decision_options(spark, options, want):
    assert [tuple(o) for o in one(spark, options, text.decision_options)] == want


def test_truncate(spark):
    cut = lambda v: one(spark, v, lambda x: text.truncate_context(x, 10))
    assert cut("short") == "short"
    assert cut("abcdefghi. more") == "abcdefghi."
    assert cut("abcdefghi\nmore") == "abcdefghi"
    assert cut("ab.defghijklm") == "ab.defghij..."


def test_json_recovery(spark):
    read = lambda v: one(spark, v, lambda x: text.parse_json(x).cast("string"))
    assert json.loads(read('```json\n{"a": 1}\n```')) == {"a": 1}
    assert json.loads(read('<think>x {no}</think> say {"a": 1,}')) == {"a": 1}
    assert json.loads(read('{"a": "\\alpha"}')) == {"a": "\\alpha"}
    assert read("{}") is None
    assert read("nothing") is None


BROKEN = [
    (r'{"a": "\frac{1}{2} \alpha \tau"}', {"a": r"\frac{1}{2} \alpha \tau"}),
    (r'{"a": "tab\there", "b": "\u0041"}', {"a": "tab\there", "b": "A"}),  # valid, so it stays as it is
    (r'{"a": "C:\dir", "b": "x\\y \" z \q"}', {"a": r"C:\dir", "b": 'x\\y " z \\q'}),
    ('{"a": "he said "no, never" to me", "b": 1}', {"a": 'he said "no, never" to me', "b": 1}),
    ('{"a": "x,} y,]", "b": [1, 2,], }', {"a": "x,} y,]", "b": [1, 2]}),
    ('{"a": "x,}", "b": "say "z"",}', {"a": "x,}", "b": 'say "z"'}),
    ("{“a”: “it is ,] \"so\"”, }", None),
    ("{“a”: “curly ”, \"b\": \"a “word” here\"}", {"a": "curly ", "b": "a “word” here"}),
    ('{"a": "two\nlines", "b": "q"q"}', {"a": "two\nlines", "b": 'q"q'}),
    ('{"a": ""}', {"a": ""}),
    ('{"a": "never closed}', None),
    ('{"a": "\\', None),
    ('{"a": "{ brace", "b": 1,}', {"a": "{ brace", "b": 1}),
]


def test_json_repair_knows_strings(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(BROKEN)], "i int, x string")
    got = {r["i"]: r["v"] for r in df.select("i", text.parse_json(F.col("x")).cast("string").alias("v")).collect()}
    for i, (x, want) in enumerate(BROKEN):
        if x.startswith("{“a”: “it"):  # straight quotes within curly ones are escaped
            want = {"a": 'it is ,] "so"'}
        assert (json.loads(got[i]) if got[i] else None) == want, x
    whole = df.select(text.repaired_json(F.col("x"), True).alias("a"), text.repaired_json(F.lit("")).alias("b"), text.repaired_json(F.lit(None).cast("string")).alias("c")).first()
    assert whole["b"] == "" and whole["c"] is None


def test_json_repair_of_long_replies(spark):
    long = '{"a": "' + "\\alpha and \\beta, " * 4000 + '"}'
    got = one(spark, long, lambda x: text.parse_json(x).cast("string"))
    assert json.loads(got) == {"a": "\\alpha and \\beta, " * 4000}


def test_judge_defaults(spark):
    read = lambda v: tuple(one(spark, v, text.judge_reply))
    assert read("bad") == (5.0, "REVISE", "bad")
    assert read('{"verdict": "OK"}') == (5.0, "OK", "")


def test_title_and_inline(spark):
    assert one(spark, "custom_type", text.title_case) == "Custom_Type"
    assert one(spark, "a **b** `c` ~~d~~ [e](f) <g>", text.inline_markdown) == 'a <b>b</b> <code>c</code> <s>d</s> <a href="f">e</a> &lt;g&gt;'


PLAN = """# COA方案：Test

## 概述
About.

## COA矩阵
| 单元 | 阶段1: 出发 *(潮水退去→)* *(清点)* | 阶段 2: 返回 (Return & Count)<br>*(H-30min ~ H+05min)* |
|---|---|---|
| 测绘小队 (GEO-7B) *(岸线测绘)* | 1. A<br>2. B | - |
|  | x | y |
| 预备队 | A; B |

## 风险
| 类别 | 描述 | 缓解 |
|---|---|---|
| - | storm | wait |
"""


def test_plan(spark):
    plans = spark.createDataFrame([(1, PLAN), (2, "short")], "plan_id int, md string")
    parts = markdown.sections(plans)
    rows = markdown.table_rows(markdown.find_section(parts, *markdown.SECTIONS["matrix"]))
    assert [tuple(r) for r in markdown.phases(rows).orderBy("ord").select("name", "trigger", "objective").collect()] == [("出发", "潮水退去→", "清点"), ("返回", "H-30min ~ H+05min", "")]
    assert [tuple(r) for r in markdown.units(rows).orderBy("ord").select("unit_id", "name", "role").collect()] == [("GEO_7B", "测绘小队 (GEO-7B)", "岸线测绘"), ("Unit_2", "预备队", "")]
    cells = {(r["unit_id"], r["phase_id"]): r["actions"] for r in markdown.cells(rows).collect()}
    assert cells == {("GEO_7B", "Phase_1"): ["A", "B"], ("GEO_7B", "Phase_2"): [], ("Unit_2", "Phase_1"): ["A; B"], ("Unit_2", "Phase_2"): []}
    assert [tuple(r) for r in markdown.risks(parts).select("category", "description").collect()] == [("GENERAL", "storm")]
    assert {r["plan_id"]: r["name"] for r in markdown.titles(plans).collect()} == {1: "Test", 2: "Generated COA"}
    assert [r["ok"] for r in plans.orderBy("plan_id").select(markdown.accepted(F.col("md")).alias("ok")).collect()] == [True, False]


def test_blank_blocks_are_left_out(spark):
    b = spark.createDataFrame([(1, 0, "text", "a"), (1, 1, "text", " \t"), (1, 2, None, "b"), (1, 3, "image", "i")], "doc_id long, block_idx long, type string, text string")
    texts, others = blocks.separate(b)
    assert tuple(texts.first()) == (1, "a\n\nb", 2, 1)
    assert others.count() == 1


def test_repaired_ids_skip_taken_names(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a_1"), (4, "a")], "k int, id string")
    assert {r["k"]: r["new_id"] for r in matrix.repaired_ids(rows, "id", "k").collect()} == {1: "a", 2: "a_2", 3: "a_1", 4: "a_3"}


def test_upsert_and_probe(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, control.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_unknown_mode(spark):
    empty = spark.createDataFrame([], "query_id long, item long")
    assert retrieve.by_mode("bypass", empty, empty, empty).count() == 0
    with pytest.raises(ValueError, match="unknown mode"):
        retrieve.by_mode("other", empty, empty, empty)


def test_content_list_reader(spark, tmp_path):
    items = [{"type": "text", "text": "T", "page_idx": 0, "text_level": 1}, {"type": "image", "img_path": "i.png", "img_caption": ["c"], "page_idx": 1}, {"type": "image", "img_path": "../x.png"}, {"type": "table", "table_body": "|a|", "table_caption": ["t"], "page_idx": 2}]
    (tmp_path / "d_content_list.json").write_text(json.dumps(items))
    rows = files.read_content_lists(spark, str(tmp_path), "out/").orderBy("block_idx").collect()
    assert [r["type"] for r in rows] == ["text", "image", "image", "table"]
    assert [r["img_path"] for r in rows] == ["", "out/i.png", "", ""]
    assert rows[1]["image_caption"] == ["c"]
    assert rows[3]["table_body"] == "|a|"


def test_scan_folder(spark, tmp_path):
    for name in ("a.PDF", "b.txt", "c.exe", "sub/d.Docx"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    found = files.scan_folder(spark, str(tmp_path))
    assert sorted(r["n"] for r in found.select(ids.basename(F.col("path")).alias("n")).collect()) == ["a.PDF", "b.txt", "d.Docx"]


def test_flatten_nodes(spark):
    nodes = spark.createDataFrame([(1, "body", None, 0), (1, "g1", "body", 0), (1, "t2", "body", 1), (1, "t1", "g1", 0), (1, "t3", "g1", 1)], "doc_id long, node_id string, parent_id string, child_idx int")
    assert [r["node_id"] for r in tree.flatten_nodes(nodes).orderBy("path").collect()] == ["t1", "t3", "t2"]


def test_flatten_deep_chains_and_circles(spark):
    chain = [(1, "body", None, 0)] + [(1, f"n{i}", f"n{i - 1}" if i else "body", 0) for i in range(41)]
    schema = "doc_id long, node_id string, parent_id string, child_idx int"
    assert [r["node_id"] for r in tree.flatten_nodes(spark.createDataFrame(chain, schema)).collect()] == ["n40"]
    with pytest.raises(ValueError, match="circle"):
        tree.flatten_nodes(spark.createDataFrame([(1, "body", None, 0), (1, "a", "body", 0), (1, "b", "a", 0), (1, "a", "b", 0)], schema))
    assert tree.flatten_nodes(spark.createDataFrame([], schema)).count() == 0


def test_repeated_edges_stay_and_inner_ones_count_once(spark):
    nodes = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b")], "query_id long, node string")
    edges = spark.createDataFrame([("a", "x", 1), ("a", "x", 1), ("a", "b", 2), ("y", "b", 3), ("a", "a", 4)], "src string, tgt string, weight int")
    want = [(1, "a", "a", 4), (1, "a", "b", 2), (1, "a", "x", 1), (1, "a", "x", 1), (1, "y", "b", 3), (2, "a", "b", 2), (2, "y", "b", 3)]
    assert sorted(map(tuple, retrieve.neighbours(nodes, edges).collect())) == want


def test_all_json_candidates_are_tried(spark):
    read = lambda v: one(spark, v, lambda x: text.parse_json(x).cast("string"))
    assert json.loads(read('text {not json} and {"a": {"b": 1}} end')) == {"a": {"b": 1}}
    assert json.loads(read('{bad} {"a": 1,} {"c": 2}')) == {"c": 2}
    assert json.loads(read('} {"a": {"b": 2}}')) == {"b": 2}
    candidates = one(spark, '```json\n{"x": 1}\n``` {a{b}} {', lambda x: F.to_json(text.json_candidates(x)))
    assert json.loads(candidates) == ['{"x": 1}', "{a{b}}", '{"x": 1}\n``` {a{b}}']


def test_replies_are_parsed_once(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("r")).select(text.modal_entity(F.col("r"), F.lit("image")).alias("m")).select("m.*")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 3  # one a repair


def test_options_without_a_side(spark):
    read = lambda v: [tuple(o) for o in one(spark, v, text.decision_options)]
    assert read("IF x THEN y; : z; w:") == [("x", "y"), ("default", ": z"), ("default", "w:")]
    assert read("若（晚）则（快）") == [("晚", "快")]


def test_ocr_lines_stay(spark):
    pages = spark.createDataFrame([(1, 7, [("Same", 0.9), ("Same", 0.8), (" ", 0.1)])], "doc_id long, page_idx long, lines array<struct<text: string, confidence: double>>")
    assert [r["text"] for r in files.ocr_blocks(pages).collect()] == ["Same", "Same"]


def test_decode_text(spark):
    rows = spark.createDataFrame([(bytearray("é中".encode()),), (bytearray(b"\xe9a"),)], "c binary")
    assert [r["t"] for r in rows.select(files.decode_text(F.col("c")).alias("t")).collect()] == ["é中", "éa"]


def test_setting_rules_and_chunks(spark):
    models = spark.createDataFrame([(1, "openai", "m", 3, 8.0), (2, "none", "", 0, 11.0), (3, None, "m", None, None)], "id int, provider string, model string, max_iterations int, quality_threshold double")
    broken = {}
    for r in control.setting_violations(models).collect():
        broken.setdefault(r["id"], set()).add(r["rule"])
    assert broken == {2: {"provider unknown", "model missing", "iterations not positive", "threshold out of range"}, 3: {"provider missing", "iterations not positive", "threshold out of range"}}
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a"), (3, " "), (4, "a b c")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["chunk_idx"], r["text"]) for r in blocks.overlapping_chunks(docs, 3, 1).collect()) == [(1, 0, "a b c"), (1, 1, "c d e"), (2, 0, "a"), (4, 0, "a b c")]


def test_whole_texts_with_blank_parts_and_line_feeds(spark, tmp_path):
    import base64

    texts = ["", None, " \n\t", "  a\nb  ", "x" * 200 + "\né", " one"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["b64"] for r in catalog.QUERIES["base64_encode"](spark, str(tmp_path)).collect()}
    assert got == {i: base64.b64encode((t or "").encode()).decode() for i, t in enumerate(texts)}
    got = {r["doc_id"]: r["parts"] for r in catalog.QUERIES["vlm_message_parts"](spark, str(tmp_path)).collect()}
    assert got == {i: "|".join([f"text:{(t or str()).strip()}"] * bool((t or "").strip()) + ["image:1", "text:and", "image:2"]) for i, t in enumerate(texts)}


def test_decode_text_gbk(spark):
    rows = spark.createDataFrame([("é中".encode(),), ("中文".encode("gbk"),), (b"\xff\xff",), (b"",), (None,)], "c binary")
    assert [r["t"] for r in rows.select(files.decode_text(F.col("c"), gbk=True).alias("t")).collect()] == ["é中", "中文", "ÿÿ", "", None]


def test_ocr_lines_of_any_nesting(spark):
    cases = {
        json.dumps([[[[0, 0], [9, 9]], ["one", 0.9]], [[[1, 1]], ["two", 0.8]]]): ["one", "two"],
        json.dumps({"more": {"text": " c "}, "texts": ["b", {"text": "d"}], "rec_texts": ["a", "a"]}): ["a", "a", "b", "d", "c"],
        json.dumps([{"text": ["no"]}, None, ["x", 0.5], ["y"], ["p", "q"], 3]): ["x", "y", "p", "q"],
        " no JSON {": ["no JSON {"], "": [], "[]": [], "[" * 100_000: ["[" * 100_000], None: [],
    }
    rows = spark.createDataFrame([(i, case) for i, case in enumerate(cases)], "i int, c string")
    assert [r["t"] for r in rows.select("i", ocr.ocr_lines(F.col("c")).alias("t")).orderBy("i").collect()] == list(cases.values())


def test_batch_plan_mirrors_folders(spark):
    paths = spark.createDataFrame([("/in/a.pdf",), ("/in/x.y/b.c.TXT",), ("/in/d.zip",), ("/else/e.pdf",), (None,)], "path string")
    plan = {r["path"]: (r["parser"], r["folder"]) for r in files.batch_plan(paths, "path", "/in/", "/out").collect()}
    assert plan == {"/in/a.pdf": ("pdf", "/out/a"), "/in/x.y/b.c.TXT": ("text", "/out/x.y/b.c")}
    assert [r["path"] for r in files.batch_plan(paths, "path", "/in", "/out", recursive=False).collect()] == ["/in/a.pdf"]
    done, failed = files.split_results(spark.createDataFrame([("a", None), ("b", "broken")], "path string, error string"))
    assert [tuple(r) for r in done.collect()] == [("a",)] and [tuple(r) for r in failed.collect()] == [("b", "broken")]


def test_vision_or_plain(spark):
    prompts = spark.createDataFrame([(1, "see [VLM_IMAGE_1]"), (2, "see"), (3, None)], "doc_id long, prompt string")
    say = lambda word: lambda rows: rows.withColumn("answer", F.lit(word))
    got = {tuple(r) for r in retrieve.vision_or_plain(prompts, say("v"), say("p")).collect()}
    assert got == {(1, "vision", "v"), (2, "plain", "p"), (3, "plain", "p")}


def test_json_sink_reads_back(spark, tmp_path):
    rows = [(1, "a\nb \"q\" é", None, ["x", None]), (2, None, 2.5, []), (3, "", 0.0, None)]
    df = spark.createDataFrame(rows, "id int, t string, n double, l array<string>")
    files.write_json(df, f"{tmp_path}/j")
    lines = [json.loads(line) for p in tmp_path.glob("j/part-*") for line in p.read_text().splitlines()]
    assert sorted((r["id"], r["t"], r["n"], r["l"]) for r in lines) == rows
    assert sorted(map(tuple, spark.read.schema(df.schema).json(f"{tmp_path}/j").collect())) == rows


def test_image_paths_of_all_suffixes(spark):
    read = lambda v: one(spark, v, retrieve.image_path)
    for suffix in retrieve.IMAGES:
        assert read(f"see Image Path:  /d/a b.{suffix} there") == f"/d/a b.{suffix}"
    assert read("Image Path: /d/a.svg") is None and read("no path.png") is None and read("") is None


def test_cells_of_odd_form(spark):
    rows = spark.createDataFrame([(1, 0, ["单元", "**阶段 2 ： Name （x）** (A -> B)*(goal 目标)*", "plain *(H-5)*", "阶段x: y", ""]), (1, 1, ["Team（A/1） *(role (sub))*<br>more"]), (1, 2, ["  "]), (1, 3, ["Bare"])], "plan_id long, row_idx int, cells array<string>")
    got = [tuple(r) for r in markdown.phases(rows).orderBy("ord").select("name", "trigger", "objective").collect()]
    assert got == [("Name （x）", "A -> B", "goal 目标"), ("plain *(H-5)*", "H-5", ""), ("阶段x: y", "", ""), ("", "", "")]
    assert [tuple(r) for r in markdown.units(rows).orderBy("ord").select("unit_id", "name", "role").collect()] == [("A_1", "Team（A/1）", "role (sub)"), ("Unit_2", "Bare", "")]
