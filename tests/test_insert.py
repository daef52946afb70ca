"""The chain from files to statuses: what fails is led aside, and a second run with repaired files mends it."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from foliate.operators import insert
from foliate.operators.store import KeyedStore
from foliate.sources import files

GOOD = [{"type": "text", "text": "Alpha beta. Gamma delta"}, {"type": "image", "img_path": "a.png", "image_caption": ["Caption"], "text": "refuse once"}, {"type": "table", "table_body": "| x |", "text": ""}, {"type": "equation", "latex": "E=mc"}, {"type": "video", "content": "refuse always"}, {"text": "no type"}]


def put(folder, *lines):
    folder.mkdir(exist_ok=True)
    (folder / "part").write_text("\n".join(lines))


def slots(fail_chunk=""):
    refuse = lambda what: F.when(F.col("text").rlike(what), F.lit("refused")).alias("error")
    describe = lambda what: lambda rows: rows.select("*", F.concat(F.lit("Seen "), "type").alias("description"), refuse(what))
    extract = lambda what: lambda rows: rows.select("*", F.array(F.lit("Alpha"), F.substring("text", 1, 5)).alias("entities"), refuse(what))
    return insert.Slots(describe("refuse"), describe("always"), extract(fail_chunk or "^$"), extract("Math" if fail_chunk else "^$"))


def run(spark, tmp_path, s):
    parsed, unread = files.read_bundles(spark, str(tmp_path / "in"))
    out = insert.insert(insert.items_of(parsed), unread, s, F.concat_ws(" ", "type", "doc_id", "block_idx"))
    stores = [KeyedStore(spark, f"{tmp_path}/{n}", k, schema) for n, k, schema in (("c", "chunk_id", insert.CHUNKS), ("s", "doc_id", insert.STATUS))]
    insert.commit(out, *stores)
    return out, *stores


def test_failures_and_repair(spark, tmp_path):
    whole = json.dumps(GOOD)
    put(tmp_path / "in", f"good\t{whole}", f"cut\t{whole[:-5]}", "none\tnot json", "empty\t[]", "object\t{}", "no tab", f"\t{whole}", f"twice\t{whole}", f"twice\t{whole}", 'words\t[{"text": "  "}]', "")
    out, chunks, status = run(spark, tmp_path, slots("Equation|Table"))
    got = {r["doc_id"]: (r["status"], r["error"], r["n_chunks"], r["n_items"], r["n_failed_items"], r["n_failed_chunks"]) for r in status.read().collect()}
    assert got == {
        "good": ("processed", None, 4, 4, 1, 1), "words": ("processed", None, 0, 0, 0, 0), "cut": ("failed", "no content list", 0, 0, 0, 0), "none": ("failed", "no content list", 0, 0, 0, 0),
        "empty": ("failed", "no blocks", 0, 0, 0, 0), "object": ("failed", "no content list", 0, 0, 0, 0), "": ("failed", "no name", 0, 0, 0, 0), "twice": ("failed", "a name twice", 0, 0, 0, 0),
    }
    errors = {(r["doc_id"], r["stage"], r["block_idx"], r["error"]) for r in out["errors"].collect()}
    assert errors == {("good", "describe", 4, "refused"), ("good", "extract", None, "refused"), *((d, "read", None, g[1]) for d, g in got.items() if g[0] == "failed"), (None, "read", None, "no name")}
    held = sorted((r["ord"], r["type"], r["text"].split("\n")[0]) for r in chunks.read().collect())
    assert held == [(0, "text", "Alpha beta. Gamma delta no type"), (1, "image", ""), (2, "table", "Table Analysis:"), (3, "equation", "Mathematical Equation Analysis:")]
    assert {(r["src"], r["tgt"]) for r in out["edges"].collect()} == {("Alpha", "image good 1"), ("\nImag", "image good 1"), ("Alpha", "table good 2"), ("Table", "table good 2")}

    put(tmp_path / "in", f"cut\t{whole}", f"twice\t{whole}")  # the repaired ones again; the others stay as they are
    _, chunks, status = run(spark, tmp_path, slots())
    again = {r["doc_id"]: r["status"] for r in status.read().collect()}
    assert again == {d: "processed" if d in ("cut", "twice", "good", "words") else "failed" for d in got}
    before = sorted(map(tuple, chunks.read().collect()))
    _, chunks, status = run(spark, tmp_path, slots())  # the same once more changes nothing
    assert sorted(map(tuple, chunks.read().collect())) == before


def test_what_failed_is_tried_again_from_what_was_kept(spark, tmp_path):
    """The second slot gets the rows that failed and no others, and neither the input nor the keys are read and joined for it."""
    spark.createDataFrame([(1, "fine"), (1, "refuse x"), (2, "refuse y"), (None, "refuse z")], "doc_id long, text string").write.parquet(f"{tmp_path}/rows")
    read, given = [], spark.read.parquet(f"{tmp_path}/rows")
    once = lambda rows: rows.select("*", F.upper("text").alias("said"), F.when(F.startswith("text", F.lit("refuse")), F.lit("refused")).alias("error"))

    def one(rows):
        read.extend(rows.inputFiles())
        return rows.select("*", F.reverse("text").alias("said"), F.when(F.col("doc_id") == 2, F.lit("no")).alias("error"))

    good, failed = insert.attempt(given, ["doc_id"], once, one, ["text"], F.col("said"))
    assert read and not any(f"{tmp_path}/rows" in f for f in read)
    assert {tuple(r) for r in good.collect()} == {(1, "fine", "FINE", "batch"), (1, "refuse x", "x esufer", "individual"), (None, "refuse z", "z esufer", "individual")} and good.count() == 3
    assert [tuple(r) for r in failed.collect()] == [(2, "no")]


def test_nothing_to_insert(spark, tmp_path):
    put(tmp_path / "in", "")
    out, chunks, status = run(spark, tmp_path, slots())
    assert all(out[k].count() == 0 for k in out) and status.read().count() == 0
