"""Walks with hubs and limits, the stored graph, nested settings, cuts by tokens."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from foliate.operators import control, graph, settings, tokens, walk
from foliate.operators.store import KeyedStore
from foliate.plans import matrix


def steps(starts, edges, hops, most, both):
    links = {(a, b) for a, b in edges if a and b and a != b} | ({(b, a) for a, b in edges if a and b and a != b} if both else set())
    out = []
    for q in sorted({q for q, n in starts if q is not None and n}):
        found = {n: 0 for n in sorted({n for s, n in starts if s == q and n})[:most]}
        for hop in range(1, hops + 1):
            new = sorted({b for a, b in links if found.get(a) == hop - 1} - set(found))
            found |= {n: hop for n in new[: most - len(found)]}
        out += [(q, n, h) for n, h in found.items()]
    return sorted(out)


@pytest.mark.parametrize(("hops", "most", "both"), [(1, 1000, True), (2, 12, True), (3, 40, False), (0, 2, True)])
def test_walk_same_as_steps_with_split_hubs(spark, monkeypatch, hops, most, both):
    monkeypatch.setattr(walk, "PART", 7)
    rng = random.Random(hops)
    names = [f"n{i:02d}" for i in range(60)]
    edges = [("hub", n) for n in names] * 2 + [(rng.choice(names), rng.choice(names)) for _ in range(80)] + [("a", "a"), (None, "a"), ("a", None)]
    starts = [(1, "n01"), (1, "n01"), (2, "hub"), (3, "nowhere"), (4, "n05"), (4, "n06"), (4, "n07"), (None, "n01"), (5, None)]
    e = spark.createDataFrame([(*x, "w") for x in edges], "src string, tgt string, node string")
    s = spark.createDataFrame([(*x, 1) for x in starts], "query_id int, node string, hop int")
    got = walk.neighbourhood(s, e, hops, most, both)
    assert sorted(map(tuple, got.collect())) == steps(starts, edges, hops, most, both)
    inner = walk.edges_within(got, e.select("src", "tgt"))
    reached = {(q, n) for q, n, _ in steps(starts, edges, hops, most, both)}
    assert inner.count() == sum((q, a) in reached and (q, b) in reached for q in (1, 2, 3, 4) for a, b in edges)
    assert walk.neighbourhood(s, e.where("false")).count() == 6


def test_stored_graph_of_batches(spark, tmp_path):
    nodes, edges = (KeyedStore(spark, str(tmp_path / n), "key", schema) for n, schema in (("n", graph.NODE_PARTS), ("e", graph.EDGE_PARTS)))
    told = lambda *rows: spark.createDataFrame(rows, "name string, type string, description string, source_id string")
    linked = lambda *rows: spark.createDataFrame(rows, "src string, tgt string, keywords string, description string, weight double, source_id string")
    first = told(("A", "org", "d1", "s1"), ("A", "org", "d1", "s2"), ("B", None, "", "s1"), (None, "x", "y", "s1"))
    second = told(("A", "place", "d2", "s3"), ("A", "org", "changed", "s1"))
    ones = linked(("A", "B", "k", "d", 1.0, "s1"), ("B", "A", "k", "d", 2.0, "s1"), ("A", "C", None, None, None, "s1"), (None, "A", "k", "d", 1.0, "s1"))
    for batch in (first, second, second):
        nodes.upsert(graph.node_parts(batch))
    for batch in (ones, linked(("B", "A", "k2", "e", 4.0, "s2")), ones):
        edges.upsert(graph.edge_parts(batch))
    assert sorted(map(tuple, graph.united_nodes(nodes.read()).collect())) == [("A", "org", 3, 3), ("B", None, 0, 1)]
    assert sorted(map(tuple, graph.united_texts(nodes.read(), ["name"]).collect())) == [("A", "changed", 1), ("A", "d1", 1), ("A", "d2", 1)]
    assert sorted(map(tuple, graph.united_edges(edges.read()).collect())) == [("A", "B", 7.0, 2), ("A", "C", 1.0, 1)]


def substituted(x, env):
    if isinstance(x, dict):
        return {k: substituted(v, env) for k, v in x.items()}
    if isinstance(x, list):
        return [substituted(v, env) for v in x]
    m = re.fullmatch(r"\$\{([^:}]+)(?::([^}]*))?\}", x) if isinstance(x, str) else None
    return x if not m else env.get(m[1], m[2])


def test_nested_settings(spark, tmp_path):
    env = {"A": "1", "Q": 'say "x" \\ é\n', "E": ""}
    cases = [
        {"a": {"b": {"c": ["${A}", {"d": "${Q}"}, ["${NO}", "${NO:dflt}"], []]}}, "e": "${E}", "n": 1.5, "t": False, "z": None},
        {},
        {"list": [[["${A}"]], {}, "x ${A}", "${A} "], "${A}": "keys stay", 'odd "key" \\': {"": "${A}"}},
        {"l": [f"${{N{i}:v{i}}}" for i in range(12)]},
    ]
    rows = [(i, json.dumps(c)) for i, c in enumerate(cases)] + [(9, None), (10, "no json")]
    got = settings.substituted(spark.createDataFrame(rows, "id int, settings string"), spark.createDataFrame(list(env.items()), "name string, value string"), "id").collect()
    assert {r["id"]: json.loads(r["settings"]) for r in got} == {i: substituted(c, env) for i, c in enumerate(cases)}
    (tmp_path / "a.json").write_text(json.dumps(cases[0]))
    (tmp_path / "b.json").write_text("{broken")
    read = {r["file"].rsplit("/", 1)[1]: r["settings"] for r in settings.read_settings(spark, str(tmp_path)).collect()}
    assert json.loads(read["a.json"]) == cases[0] and read["b.json"] is None
    with pytest.raises(ValueError, match="deeper"):
        settings.leaves(spark.createDataFrame([(1, '{"a":{"a":{"a":1}}}')], "id int, settings string"), "id", 2)


def test_token_cuts(spark):
    offsets = lambda texts: [[m.span() for m in re.finditer(r"\w+|[^\w\s]", t)] for t in texts]
    docs = [(1, "One two, three. Four  five six seven."), (2, ""), (3, None), (4, "  "), (5, "é中 x"), (1, "a b c d e f g h i j k l m")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, chunk_idx string")
    want = []
    for i, t in docs:
        s = offsets([t or ""])[0]
        want += [(i, k, len(s[a : a + 4]), t[s[a][0] : s[a : a + 4][-1][1]]) for k, a in enumerate(range(0, len(s), 3)) if a == 0 or a + 1 < len(s)]
    assert sorted(map(tuple, tokens.token_chunks(df, offsets, 4, 1).collect())) == sorted(want)
    with pytest.raises(ValueError, match="overlap"):
        tokens.token_chunks(df, offsets, 4, 4)
    got = sorted((r["doc_id"], r["context"]) for r in tokens.token_contexts(df, offsets, 5).collect())
    assert got == [(1, "One two, three."), (1, "a b c d e..."), (2, ""), (3, ""), (4, "  "), (5, "é中 x")]


def test_numbers_without_one_task_a_key(spark, monkeypatch):
    monkeypatch.setattr(matrix, "STRETCH", 3)
    rows = spark.createDataFrame([(i, "a") for i in range(20)] + [(20, "a_2"), (21, "a_7"), (22, None), (23, None)], "k int, id string")
    got = {r["k"]: r["new_id"] for r in matrix.repaired_ids(rows.where("id IS NOT NULL"), "id", "k").collect()}
    free = [n for n in range(1, 40) if n not in (2, 7)]
    assert got == {0: "a", 20: "a_2", 21: "a_7", **{i: f"a_{free[i - 1]}" for i in range(1, 20)}}
    marks = spark.createDataFrame([("u", i) for i in range(25)] + [("v", 1), (None, 1), (None, 2)], "u string, i int")
    assert sorted(map(tuple, control.progress_marks(marks, "u").collect()), key=repr) == sorted([*[("u", n, 25) for n in (*range(2, 25, 2), 25)], ("v", 1, 1), (None, 1, 2), (None, 2, 2)], key=repr)
    assert control.progress_marks(marks.where(F.lit(False)), "u").count() == 0
