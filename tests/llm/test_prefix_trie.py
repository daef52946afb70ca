"""The trie of conversations against one built turn by turn."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from foliate.llm import common, prefix_trie
from tests.llm.helpers import nothing


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def sequences(rows):
    """conv_id to its rebuilt turns."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, _sha(f"{len(role or '')}:{role or ''}{text or ''}"), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + own[c][h[c] :] for c in own}


def brute(rows):
    talks = sequences(rows)
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for seq in nodes:
        if seq:
            children[seq[:-1]].append(seq)
    leaves, saved = {}, {}
    for seq in sorted(nodes, key=len, reverse=True):
        leaves[seq] = sum(leaves[x] for x in children[seq]) or 1
        saved[seq] = sum(saved[x] for x in children[seq]) + (len(nodes[seq]) - 1) * (len(seq[-1][1]) if seq else 0)
    return sorted((min(m), len(s), min(nodes[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s], _sha(",".join(map(str, sorted(ends[s]))))) for s, m in nodes.items())


def talks(seed, n):
    """Few different turns, so that many begin alike; copies, a long one, and every awkward value."""
    rng, rows = random.Random(seed), []
    say = lambda: (rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "bé中", "", None, "x" * 50]))
    for conv in rng.sample(range(1000), n):
        rows += [(conv, k, *say()) for k in range(rng.randrange(1, 9))]
    same = [say() for _ in range(7)]
    for conv in range(1000, 1060):  # copies, that end at the same node or one before
        rows += [(conv, k, *t) for k, t in enumerate(same[: 7 - (conv % 3 == 0)])]
    rows += [(2000 + 100 * i, k, "user", "comb") for i in range(12) for k in range(i + 1)]  # each hangs on the one before
    rows += [(2000 + 100 * i, i + 1, "user", f"tooth {i}") for i in range(12)]
    rows += [(3000, k, "user", str(k // 3)) for k in range(300)] + [(3001, k, "user", str(k // 3)) for k in range(299)]
    rows += [(4000, None, "a", "first"), (4000, 5, "b", "x"), (4000, 5, "a", "x"), (4000, 5, "a", "x"), (4000, None, None, None)]  # ties and repeated rows
    rows += [(None, 1, "user", "no id"), (None, None, None, None), (9_000_000_000, 1, "user", "a")]
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(*r, "c", "d", "o") for r in rows], "conv_id long, turn long, role string, text string, content string, depth string, owner string")
    out = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered(df)))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()))


def test_brute_force(spark):
    rows = talks(1, 300)
    assert run(spark, rows) == brute(rows)


def test_brute_force_when_nothing_is_broadcast_and_every_key_is_hot(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FEW", 0)
    monkeypatch.setattr(common, "FEW", 0)
    monkeypatch.setattr(common, "HOT_LEAST", 1)
    monkeypatch.setattr(common, "HOT", 50)
    rows = talks(2, 120)
    assert run(spark, rows) == brute(rows)


def test_one_conversation_and_none(spark):
    for rows in ([(5, 1, "u", "t")], [(7, k, "u", "t") for k in range(9)]):
        assert run(spark, rows) == brute(rows)
    empty = nothing(spark).selectExpr("doc_id AS conv_id", "doc_id AS turn", "text AS role", "text", "lang")
    assert prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered(empty))).count() == 0


@pytest.mark.parametrize("block", [1, 30, 1 << 20])
def test_ends_in_blocks(block, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = [(c, d, i) for c in (1, 2) for d in (0, 3) for i in range(0, 50 * c)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k : k + 17])], ["conv_id", "depth", "id"]) for k in range(0, len(rows), 17)]
    got = {(r["conv_id"], r["depth"]): r["ends_sha256"] for b in prefix_trie._hashed(prefix_trie._blocks(batches)) for r in b.to_pylist()}
    assert got == {(c, d): _sha(",".join(map(str, range(50 * c)))) for c in (1, 2) for d in (0, 3)}


def test_sql(spark, sf_dir, same):
    same(prefix_trie.op12_prefix_trie(spark, sf_dir), prefix_trie.ORACLE_SQL)
