"""Trees in depth-first order against a recursive walk; deep chains, wide nodes, and what no root reaches."""

from __future__ import annotations

import random

import pytest

from foliate.sources import tree

SCHEMA = "doc_id long, node_id string, parent_id string, child_idx long, path string, top string"


def walk(rows):
    out = []
    for doc in sorted({r[0] for r in rows}):
        children = {}
        for d, node, parent, i in rows:
            if d == doc and node != "body":
                children.setdefault(parent, []).append((i, node))
        todo, found = ["body"] if any(r[:2] == (doc, "body") for r in rows) else [], []
        while todo:
            node = todo.pop()
            if node in children:
                todo += [n for _, n in sorted(children[node], reverse=True)]
            else:
                found.append(node)
        out += [(doc, node, k) for k, node in enumerate(found)]
    return out


def run(spark, rows):
    got = tree.flatten_nodes(spark.createDataFrame([(*r, "p", "t") for r in rows], SCHEMA))
    return sorted((r["doc_id"], r["ord"], r["node_id"]) for r in got.collect())


def test_same_as_a_walk(spark):
    rng, rows = random.Random(5), []
    for doc in range(3):
        names = ["body"]
        rows.append((doc, "body", "body" if doc == 1 else None, 0))
        for i in range(120):
            parent = rng.choice(names[-6:] if doc else names)
            rows.append((doc, f"n{i}", parent, rng.choice([i % 4, 100_000_000 + i, 5])))
            names.append(f"n{i}")
    rows += [(0, "lost", "nowhere", 0), (0, "lost2", "lost", 0), (0, "free", None, 0), (7, "x", "y", 0), (8, "body", None, 0)]
    assert run(spark, rows) == [(d, k, n) for d, n, k in sorted(walk(rows), key=lambda r: (r[0], r[2]))]


def test_chain_of_ten_thousand(spark, monkeypatch):
    rounds, climbed = [], tree._climbed
    monkeypatch.setattr(tree, "_climbed", lambda s, c: rounds.append(tuple(c)) or climbed(s, c))
    rows = [(1, "body", None, 0)] + [(1, f"n{i}", f"n{i - 1}" if i else "body", 0) for i in range(10_000)] + [(1, "last", "body", 1)]
    assert run(spark, rows) == [(1, 0, "n9999"), (1, 1, "last")]
    assert rounds.count(()) < 20 and rounds.count(("before",)) < 20


def test_circles_and_repeated_nodes(spark):
    for bad in ([(1, "a", "b", 0), (1, "b", "a", 0)], [(1, "a", "a", 0)], [(1, "a", "body", 0), (1, "a", "body", 1)]):
        with pytest.raises(ValueError, match="circle"):
            run(spark, [(1, "body", None, 0), *bad])


def test_leaves_are_not_climbed(spark, monkeypatch):
    """Rounds move inner nodes only; a tree of 300 leaves has four of these."""
    moved, climbed = [], tree._climbed
    monkeypatch.setattr(tree, "_climbed", lambda s, c: moved.append(s.count()) or climbed(s, c))
    rows = [(1, "body", None, 0)] + [(1, f"p{i}", "body", i) for i in range(3)] + [(1, f"n{i}", f"p{i % 3}", i) for i in range(300)]
    assert run(spark, rows) == [(d, k, n) for d, n, k in sorted(walk(rows), key=lambda r: (r[0], r[2]))]
    assert max(moved) == 4
