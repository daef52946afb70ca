"""The keyed store: merges, deletions, versions that a dying writer can't spoil, and repeated keys everywhere."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from foliate.operators import control, store
from foliate.operators.store import Conflict, KeyedStore, one_each

SCHEMA = "k string, v long, at long"


def rows_of(s):
    return sorted(map(tuple, s.read().collect()))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", other string")


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_same_as_a_dictionary(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(store, "FEW", few)
    monkeypatch.setattr(store, "CHANGES", 3)
    s, want, rng = KeyedStore(spark, f"file://{tmp_path}/s", "k", SCHEMA), {}, random.Random(few)
    assert rows_of(s) == [] and s.version() is None
    for step in range(6):
        if step in (2, 4):
            gone = [f"k{rng.randrange(12)}" for _ in range(6)] + [None]
            s.delete(spark.createDataFrame([(k,) for k in gone], "k string"))
            want = {k: v for k, v in want.items() if k not in gone}
        else:
            batch = [(rng.choice([f"k{rng.randrange(12)}", ""]), rng.randrange(100), i) for i in range(20)] + [(None, 1, 1)]
            s.upsert(frame(spark, batch), "at")
            want |= {k: (k, v, at) for k, v, at in sorted(batch[:-1], key=lambda r: r[2])}
        assert rows_of(s) == sorted(want.values())
    assert s.version().number == 6 and len(s.version().changes) <= 3
    before = rows_of(s)
    assert s.vacuum() > 0 and rows_of(s) == before and s.vacuum() == 0


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    s = KeyedStore(spark, str(tmp_path / "s"), "k", SCHEMA)
    s.upsert(frame(spark, [("a", 1, 1)]))
    old = rows_of(s)
    with monkeypatch.context() as m:  # after the data, before the manifest
        m.setattr(s, "_publish", lambda v: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            s.upsert(frame(spark, [("a", 2, 2)]))
    assert rows_of(s) == old
    Path(tmp_path / "s/_versions/000000000002").write_text("\ndata-x 1\nen")  # within the manifest
    assert rows_of(s) == old and s.version().number == 1
    s.upsert(frame(spark, [("a", 3, 3)]))
    assert rows_of(s) == [("a", 3, 3)] and s.version().number == 2


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    s = KeyedStore(spark, str(tmp_path / "s"), "k", SCHEMA)
    s.upsert(frame(spark, [("a", 1, 1)]))
    seen = s.version()
    s.upsert(frame(spark, [("b", 1, 1)]))
    with monkeypatch.context() as m:
        m.setattr(s, "version", lambda: seen)
        with pytest.raises(Conflict):
            s.upsert(frame(spark, [("c", 1, 1)]))
    assert rows_of(s) == [("a", 1, 1), ("b", 1, 1)]


def test_one_row_a_key_everywhere(spark):
    rows = frame(spark, [("a", 1, 1), ("a", 2, 3), ("a", 3, 2), ("b", 1, 1), ("b", 1, 1), (None, 5, 1)])
    assert sorted(map(tuple, one_each(rows.drop("other"), "k", "at").collect()), key=repr) == sorted([("a", 2, 3), ("b", 1, 1), (None, 5, 1)], key=repr)
    assert one_each(rows, "k").count() == 3 and one_each(rows, ["k", "v"]).count() == 5
    merged = control.upsert(rows.drop("other"), frame(spark, [("a", 9, 1), ("a", 8, 2), ("c", 1, 1)]).drop("other"), "k", "at")
    assert sorted((r["k"] or "", r["v"]) for r in merged.collect()) == [("", 5), ("a", 8), ("b", 1), ("c", 1)]
    wanted = spark.createDataFrame([("a", 2, "x"), ("a", 2, "x"), ("b", 1, "x"), ("d", 1, "x")], "k string, mtime long, config string")
    cache = spark.createDataFrame([("a", 1, "x", "p"), ("a", 2, "x", "p"), ("a", 2, "x", None), ("b", 3, "x", "p"), ("b", 1, "x", "p"), (None, 1, "x", "p")], "k string, mtime long, config string, payload string")
    assert sorted((r["k"], r["hit"]) for r in control.cache_probe(wanted, cache, "k").collect()) == [("a", True), ("a", True), ("b", False), ("d", False)]
    assert [r["k"] for r in control.invalid(wanted, cache, "k").collect()] == ["b"]
    known = spark.createDataFrame([("r1", "t2"), ("r1", "t1"), ("r1", "t1")], "rule string, translation string")
    rules = spark.createDataFrame([("r1",), ("r2",), (None,)], "rule string")
    assert sorted(map(tuple, control.translated(rules, known, "rule").collect()), key=repr) == sorted([("r1", "t1"), ("r2", "r2"), (None, None)], key=repr)
    env = spark.createDataFrame([("V", "1"), ("V", "2"), (None, "3")], "name string, value string")
    settings = spark.createDataFrame([("s", "${V}"), ("t", "${W:d}"), ("u", "plain")], "id string, value string")
    assert sorted(map(tuple, control.substitute_env(settings, env).collect())) == [("s", "2"), ("t", "d"), ("u", "plain")]


def test_batches_are_packed_with_zstd(spark, tmp_path):
    """Texts of chunks take a third less disk than with Spark's default."""
    store = KeyedStore(spark, f"{tmp_path}/s", "k", "k string, v string")
    store.upsert(spark.createDataFrame([("a", "x")], "k string, v string"))
    files = [p.name for p in tmp_path.glob("s/data-*/*.parquet")]
    assert files and all(n.endswith(".zstd.parquet") for n in files)
