"""Near copies by verified shingle similarity, against brute force."""

import random
import time
from collections import Counter
from pathlib import Path

from foliate.llm import similar, simhash
from foliate.llm.common import durable
from foliate.llm.components import components
from foliate.llm.similar import _pairs_across, crowd_links
from pyspark.sql import functions as F
from tests.llm.helpers import prose
from tests.llm.test_dedup import _roots


def _texts():
    draw, texts = random.Random(4), {}
    for g in range(12):
        words = prose(g * 13 + 1, 150 + g).split()
        for k in range(8):
            copy = list(words)
            for _ in range(2 if k else 0):
                copy[draw.randrange(len(copy))] = f"new{draw.randrange(1000)}"
            texts[g * 100 + k] = " ".join(copy)
    return texts


def _similar(texts):
    words = {d: t.split() for d, t in texts.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in words.items()}
    return lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])


def test_near_copies_at_a_similarity_of_eight_tenths_are_all_found(spark):
    texts = _texts()
    want = _roots(sorted(texts), _similar(texts))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(frame).collect()} == set(want.values())


def test_small_buckets_compare_all_members_and_larger_ones_are_split(spark):
    texts = _texts()
    want = _roots(sorted(texts), _similar(texts))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for bucket in (1, 2, 1000):
        assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame, bucket=bucket).collect()} == want


def test_crowds_lose_no_link(spark):
    """Texts of one form: most pairs are similar to 0.7 or so and share keys, some to 0.8; every link counts."""
    draw, texts = random.Random(9), {}
    form = prose(3, 200).split()
    for d in range(60):
        words = list(form)
        for _ in range(draw.randint(3, 4)):
            words[draw.randrange(len(words))] = f"own{draw.randrange(10_000)}"
        texts[d] = " ".join(words)
    similar = _similar(texts)
    want = _roots(sorted(texts), similar)
    assert 1 < len(set(want.values())) < 60
    words = {d: t.split() for d, t in texts.items()}
    number = {}
    sets = [(d, sorted({number.setdefault(tuple(w[i : i + 5]), len(number)) for i in range(len(w) - 4)})) for d, w in words.items()]
    frame = spark.createDataFrame(sets, "node long, shingles array<int>")
    none = spark.createDataFrame([], "u long, v long")
    for bucket in (4, 32):
        got = {d: d for d in texts} | {r["node"]: r["root"] for r in components(crowd_links(frame, none, bucket)).collect()}
        assert got == want


def test_members_outside_the_largest_component_meet_all_others_once(spark):
    """A shingle with one large component and some others gives each pair across components once, and no others."""
    draw = random.Random(2)
    members = [(s, d, 0 if d < 40 else d % 5) for s in (7, 8) for d in range(60) if draw.random() < 0.8] + [(9, d, 3) for d in range(50)]
    want = {(a, b) for s, a, ra in members for t, b, rb in members if s == t and a < b and ra != rb}
    frame = spark.createDataFrame(members, "shingle int, node long, root long")
    for bucket in (1, 4, 100):
        got = [tuple(r) for r in _pairs_across(frame, bucket).select("u", "v").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_blocks_get_few_copies_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Texts of one form that link through some of them: what is left for the blocks is far below members times blocks."""
    draw, texts = random.Random(3), {}
    form = prose(5, 200).split()
    for d in range(150):
        words = list(form)
        for _ in range(draw.randint(1, 4)):
            words[draw.randrange(len(words))] = f"own{draw.randrange(10_000)}"
        texts[d] = " ".join(words)
    number, sets = {}, []
    for d, text in texts.items():
        w = text.split()
        sets.append((d, sorted({number.setdefault(tuple(w[i : i + 5]), len(number)) for i in range(len(w) - 4)})))
    copies, across = [], similar._pairs_across

    def counted(members, bucket, least=None):
        sizes = Counter((r["shingle"], r["root"]) for r in members.collect())
        for shingle in {s for s, _ in sizes}:
            each = [n for (s, _), n in sizes.items() if s == shingle]
            copies.append((sum(each) - max(each)) * -(-sum(each) // bucket))
        return across(members, bucket, least)

    monkeypatch.setattr(similar, "_pairs_across", counted)
    got = {d: d for d in texts} | {r["node"]: r["root"] for r in components(crowd_links(spark.createDataFrame(sets, "node long, shingles array<int>"), spark.createDataFrame([], "u long, v long"), 4)).collect()}
    assert got == _roots(sorted(texts), _similar(texts))
    assert sum(copies) < 6000  # 53,367 without the choice of members


def test_shuffle_files_go_when_a_checkpoint_is_there(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    local = [f"{d}" for d in manager.localDirsString()]
    files = lambda: {f for d in local for f in Path(d).rglob("shuffle_*")}
    before = files()
    counts = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    kept = durable(counts)
    for _ in range(100):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left
    assert kept.count() == counts.count() == 10
