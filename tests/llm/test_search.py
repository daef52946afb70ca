"""Ranked lexical search against a brute force, and its windows and heaps."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from foliate.llm import search
from tests.llm.helpers import ROWS, awkward, nothing, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top):
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c, n in counted:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc))
        out += [(item, k, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, prose(1, 30)), (2, "ONE 中文 é"), (3, None), (4, ""), (5, prose(5, 200)), (5, prose(1, 30)), (None, prose(9, 40)), (6, "nowhere"), (7, "alpha7 alpha7 alpha7 one"), (8, prose(1, 30))]


def test_brute_force_on_awkward_rows(spark):
    items = spark.createDataFrame([(i, t, "x", "y") for i, t in ITEMS], "item_id long, text string, key string, rank string")
    docs = [(r[0], r[1]) for r in ROWS]
    for top, size in ((20, 1 << 20), (3, 200)):  # one block of queries, and many
        got = search.ranked(awkward(spark), items, top, item_bytes=size)
        assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, ITEMS, top)


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.ranked(nothing(spark), items).count() == 0
    assert search.ranked(awkward(spark), items.where("false")).count() == 0
    assert search.ranked(awkward(spark).withColumn("text", search.F.lit(None).cast("string")), items).count() == 0


def test_sql(spark, sf_dir, same):
    same(search.op13_search(spark, sf_dir), search.ORACLE_SQL)


def test_all_characters_part_terms_as_the_pattern_does():
    text = "".join(map(chr, range(1, 1000))) + "Ünïcode ﷽ x y\u0085z" + "A-Z_a.z0'9"
    assert [t.decode() for t in search.terms(text)] == words(text)


def test_long_texts_in_stretches(monkeypatch):
    text = prose(3, 5000).encode()
    vocabulary = {t: i for i, t in enumerate(search.terms(text)[:50])}
    whole = Counter(vocabulary[t] for t in search.terms(text) if t in vocabulary)
    for step in (1, 7, 1000, 1 << 22):
        monkeypatch.setattr(search, "STEP", step)
        assert search._long(text, vocabulary) == (5000, whole)


def test_windows_of_any_size_give_the_same_heaps(monkeypatch):
    rng = random.Random(1)
    docs = [(i // 2, rng.randrange(1, 90), {t: rng.randrange(1, 4) for t in rng.sample(range(30), rng.randrange(12))}) for i in range(1000)]
    queries = [{t: rng.randrange(1, 3) for t in rng.sample(range(30), 4)} for _ in range(20)] + [{}]
    weights = np.array([rng.randrange(3) for _ in range(30)])
    total = sum(n for _, n, _ in docs)
    value = lambda n, tf: 10**9 * tf // (1000 * tf + 12 * (75 + 25 * n * 1000 // total))
    want = [sorted(((-s, i) for i, n, d in docs if (s := sum(x * int(weights[t]) * value(n, d[t]) for t, x in q.items() if t in d))))[:7] for q in queries]
    for window, block in ((1, 1), (64, 64), (4, 2), (1 << 15, 64)):
        monkeypatch.setattr(search, "WINDOW", window)
        monkeypatch.setattr(search, "BLOCK", block)
        scorer = search.Scorer(queries, weights, 1000, total, 7)
        for at in range(0, 1000, window):
            part = docs[at : at + window]
            scorer.window([i for i, _, _ in part], np.array([n for _, n, _ in part]), np.cumsum([0, *(len(d) for _, _, d in part)]), np.array([t for _, _, d in part for t in d], np.int64), np.array([x for _, _, d in part for x in d.values()], np.int64))
        got = [[] for _ in queries]
        for q, doc, score in scorer.rows():
            got[q].append((-score, doc))
        assert [sorted(x) for x in got] == want
