"""Page contexts against a plain loop."""

from __future__ import annotations

import random

import pytest

from foliate.operators import blocks


def brute(rows, pages):
    out = []
    for doc, i, page, _, _ in rows:
        seen = [(j, p or 0, t) for d, j, p, k, t in rows if d == doc and abs((p or 0) - (page or 0)) <= pages and k == "text" and (t or "").strip()]
        out.append((doc, i, "\n".join(t if p == (page or 0) else f"[Page {p}] {t}" for j, p, t in sorted(seen))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("pages", [0, 1, 3])
def test_page_contexts_of_pages_in_any_order(spark, pages):
    rng = random.Random(pages)
    rows = [(d, i, rng.choice([None, 0, 1, 2, 5, 6, 40]), rng.choice(["text", "text", "image", None]), rng.choice(["a", " ", "", None, f"b{i}", "中 c"])) for d in (1, 2, None) for i in range(40)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, block_idx long, page_idx long, type string, text string, context string, own string")
    got = blocks.page_context(df, pages)
    assert got.columns == ["doc_id", "block_idx", "context"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, pages)
    cut = {(r["doc_id"], r["block_idx"]): r["context"] for r in blocks.page_context(df, pages, most=10).collect()}
    assert all(len(c) <= 13 for c in cut.values()) and len(cut) == len(rows)
    assert blocks.page_context(df.where("false"), pages).count() == 0
