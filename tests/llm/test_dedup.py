"""Line dedup, SimHash groups and components against brute force, and their edge cases."""

import random
import re

import xxhash

from foliate.llm import line_dedup, simhash
from foliate.llm.components import components
from tests.llm.helpers import CLASHING, ROWS, awkward, nothing


def test_line_dedup_same_as_sql(spark, sf_dir, same):
    same(line_dedup.op10_line_dedup(spark, sf_dir), line_dedup.ORACLE_SQL)


def _pages(spark):
    rows = [(i, "h" if i < 20 else None, f"menu\nbody {i}\n\nmenu" if i % 2 else f"body {i}") for i in range(30)]
    rows += [(100 + i, "h", "copy line") for i in range(10)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_frequent_lines_go_and_copies_stay(spark):
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(_pages(spark)).collect()}
    assert got[1] == "body 1\n"
    assert got[21] == "body 21\n"
    assert got[2] == "body 2"
    assert got[100] == "copy line"


def test_join_beyond_the_bound_gives_the_same(spark):
    a = line_dedup.drop_boilerplate(_pages(spark)).collect()
    b = line_dedup.drop_boilerplate(_pages(spark), broadcast_lines=0).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_line_dedup_edges(spark):
    out = line_dedup.drop_boilerplate(awkward(spark))
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(CLASHING) <= set(out.columns)
    assert out.count() == len(ROWS)
    assert {r["__foliate_lines"] for r in out.where("text IS NULL").collect()} == {0}
    assert line_dedup.drop_boilerplate(nothing(spark)).count() == 0


def _fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _roots(points, linked):
    up = {p: p for p in points}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in points:
        for b in points:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {p: find(p) for p in points}


def test_simhash_same_as_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {d: _fingerprint(t) for d, t in docs.items()}
    roots = _roots(sorted(docs), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    want = {d: (f"{fps[d]:016x}", roots[d]) for d in docs}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op3_simhash(spark, sf_dir).collect()} == want


def test_links_reach_all_near_fingerprints_for_any_bucket(spark):
    draw = random.Random(3)
    centres = [draw.getrandbits(64) for _ in range(6)]
    points = set(centres)
    for c in centres[:3]:
        for _ in range(60):
            x = c
            for _ in range(draw.randint(0, 4)):
                x ^= 1 << draw.randrange(64)
            points.add(x)
    points = sorted(simhash._signed(p) for p in points)
    want = _roots(points, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    frame = spark.createDataFrame([(p,) for p in points], "fp long")
    for bucket in (1, 8, 1000):
        got = {p: p for p in points} | {r["node"]: r["root"] for r in components(simhash.links(frame, bucket)).collect()}
        assert got == want


def test_components_of_a_chain_and_a_star(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_edges(spark):
    out = [tuple(r) for r in simhash.near_duplicates(awkward(spark)).select("doc_id", "fp", "component_id").collect()]
    assert len(out) == len(ROWS)
    group = {(d, c) for d, _, c in out}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (None, 3)} <= group
    assert simhash.near_duplicates(nothing(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    kept = simhash.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 3, 6, None, 7, 8, 9]))
    assert simhash.keep_one(nothing(spark)).count() == 0


def test_texts_that_share_an_id_stay_apart(spark):
    from tests.llm.helpers import prose

    rows = [(1, prose(1, 90)), (1, prose(2, 90)), (2, prose(3, 90)), (2, prose(1, 90)), (None, prose(4, 90)), (None, prose(4, 90)), (None, prose(1, 90)), (3, prose(2, 90))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, kept.collect())) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in [(1, prose(1, 90)), (1, prose(2, 90)), (2, prose(3, 90)), (None, prose(4, 90))])


def test_hot_keys_are_split_without_loss(spark, monkeypatch):
    from foliate.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 3)
    monkeypatch.setattr(common, "HOT", 40)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (3, 1), (4, 20)) for i in range(n)], "k long, i long").repartition(3)
    each = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k long, x string")
    want = sorted(map(str, rows.join(each, ["k"], "left").collect()))
    assert sorted(map(str, common.split_join(rows, each, ["k"], "i", "left").collect())) == want
    assert common.split_join(rows, each, ["k"], "i").count() == 73
    star = spark.createDataFrame([(i, 0) for i in range(1, 200)] + [(i, i + 1) for i in range(300, 340)], "u long, v long")
    assert {r["node"]: r["root"] for r in components(star).collect()} == {**{i: 0 for i in range(200)}, **{i: 300 for i in range(300, 341)}}
