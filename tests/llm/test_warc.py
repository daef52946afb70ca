"""WARC archives: round trip, the format as gzip reads it, and salvage against what damage has left untouched."""

from __future__ import annotations

import gzip
import random
import re
import time
import zlib
from collections import defaultdict
from pathlib import Path

import pytest

from foliate.llm import warc
from tests.llm.helpers import awkward, nothing, prose

PAGES = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, "same"), (3, "http://a/3", "same"), (3, "http://a/3", "same"), (4, "http://a b/\n4", ""), (5, "", None), (None, "http://n", None), (None, "http://n", "only"), (6, "x", "é中\0\r\n\r\nWARC/1.1\r\n"), (7, "y", prose(1, 3000)), (8, "y", "same ")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "k", "u", "z") for r in rows], "page_id long, url string, html string, key string, kind string, id string")


def brute(rows, least=0):
    groups = defaultdict(list)
    for k, (i, _, html) in enumerate(rows):
        groups[html or ""].append((i is not None, i or 0, k))
    out = []
    for payload, own in groups.items():
        data, first = payload.encode(), max(own)
        for n, (_, i, k) in enumerate(sorted(own, reverse=True)):
            again = n > 0 and len(data) >= least
            out.append((rows[k][0], len(data), warc.digest(data), "revisit" if again else "response", rows[first[2]][0] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, compress, least):
    folder = f"{tmp_path}/w"
    warc.write_warc(pages(spark), folder, least=least, compress=compress, records=2)
    read = warc.read_warc(spark, folder, payloads=True)
    assert read.where("gap IS NOT NULL OR NOT intact").count() == 0
    assert sorted(map(tuple, warc.captured(read).collect()), key=repr) == brute(PAGES, least)
    assert read.select("record_id").distinct().count() == len(PAGES)
    rows = {r["record_id"]: r for r in read.collect()}
    for r in rows.values():
        if r["type"] == "revisit":  # each refers to a response that is there, with the same payload
            assert rows[r["refers_to"]]["type"] == "response" and rows[r["refers_to"]]["payload_digest"] == r["payload_digest"]
            assert r["payload"] == b""
    assert sorted(r["payload"].decode() for r in rows.values() if r["type"] == "response" and least == 0) == (sorted({p or "" for _, _, p in PAGES}) if least == 0 else [])


def test_files_are_plain_gzip(spark, tmp_path):
    warc.write_warc(pages(spark), f"{tmp_path}/w")
    held = b"".join(gzip.decompress(p.read_bytes()) for p in Path(f"{tmp_path}/w").glob("part-*") if p.stat().st_size)
    assert held.count(b"WARC/1.1\r\nWARC-Type") == len(PAGES)


def test_awkward_and_empty_tables(spark, tmp_path):
    warc.write_warc(awkward(spark), f"{tmp_path}/a", "doc_id", "source", "text")
    assert warc.captured(warc.read_warc(spark, f"{tmp_path}/a")).count() == awkward(spark).count()
    warc.write_warc(nothing(spark), f"{tmp_path}/n", "doc_id", "source", "text")
    assert warc.read_warc(spark, f"{tmp_path}/n").count() == 0


def test_shuffled_when_digests_are_many(spark, monkeypatch):
    monkeypatch.setattr(warc, "FEW", 0)
    got = warc.deduplicated(pages(spark)).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in got} == {"response": 6, "revisit": 6}


def test_records_past_sixteen_megabytes():
    record = warc.record_of("response", "<urn:x>", "u", bytes(1 << 24))
    member = warc.member_of(record)
    assert member[-1] == 0 and gzip.decompress(member) == record + warc.END
    found = list(warc.salvage(member + warc.member_of(warc.record_of("response", "<urn:y>", "u", b"z"))))
    assert [(x.reason, len(x.payload)) for x in found] == [(None, 1 << 24), (None, 1)]


def test_sql(spark, sf_dir, same):
    same(warc.op11_warc(spark, sf_dir), warc.ORACLE_SQL)


def archive(compress, n=40, seed=0):
    rng = random.Random(seed)
    records = [warc.record_of("response" if rng.random() < 0.8 else "revisit", f"<urn:{i}>", f"http://h/{i}", prose(i, rng.randrange(200)).encode()) for i in range(n)]
    return [warc.member_of(r) if compress else r + warc.END for r in records]


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_keeps_all_that_damage_left_whole(compress):
    for seed in range(40):
        rng, parts = random.Random(seed), archive(compress, seed=seed)
        out, want, bad, at = [], [], 0, 0
        for i, part in enumerate(parts):
            how = rng.choice(["whole"] * 5 + ["flip", "cut", "lost", "junk"])
            if how == "flip":
                k = rng.randrange(len(part) - 4)  # not in the closing lines of a plain record alone
                part = part[:k] + bytes([part[k] ^ 0x5A]) + part[k + 1 :]
            elif how == "cut":
                part = part[: rng.randrange(1, len(part))]
            elif how == "junk":
                part += rng.randbytes(rng.randrange(1, 300)) + b"\x1f\x8b\x08"
            if how in ("whole", "junk"):
                want.append((f"<urn:{i}>", at))
            if how != "lost":
                out.append(part)
                at += len(part)
        data = b"".join(out)
        found = list(warc.salvage(data))
        records = {(x.headers["warc-record-id"], x.at) for x in found if x.reason is None and x.intact}
        assert records >= set(want)
        spans = sorted((x.at, x.at + x.length) for x in found if x.reason is not None or x.intact)
        assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))  # nothing is passed over in silence


def test_damage_in_the_last_of_many_records_of_one_member():
    records = [warc.record_of("response", f"<urn:{i}>", "u", prose(i, 4000).encode()) + warc.END for i in range(30)]
    data = zlib.compress(b"".join(records), wbits=31)
    assert [x.headers["warc-record-id"] for x in warc.salvage(data)] == [f"<urn:{i}>" for i in range(30)]
    broken = list(warc.salvage(data[:-100] + warc.member_of(records[0][:-4])))
    assert [x.headers["warc-record-id"] for x in broken if x.reason is None][:20] == [f"<urn:{i}>" for i in range(20)]
    assert [x.reason for x in broken if x.reason] == ["gzip check failed"] and broken[-1].intact and not broken[0].intact


def test_reasons():
    good = warc.record_of("response", "<urn:1>", "u", b"text") + warc.END
    why = lambda data: [x.reason for x in warc.salvage(data) if x.reason]
    assert why(good) == []
    assert why(good.replace(b"\r\n\r\ntext", b"\r\n\r\ntest") + good) == ["digest"]
    assert why(good[:-6] + good) == ["no end where its length says"]
    assert why(good[:-6]) == ["it breaks off"]
    assert why(re.sub(rb"Content-Length: \d+\r\n\r\nHTTP", b"Content-Length: x\r\n\r\nHTTP", good)) == ["no length"]
    assert why(good.replace(b"WARC-Record-ID", b"WARC-Record")) == ["a needed header line is missing or there twice"]
    assert why(b"junk" + good) == ["no member or version line"]
    assert why(warc.member_of(good[:-4])[:-30] + good) in (["gzip check failed"], ["it breaks off"])
    assert why(gzip.compress(b"no archive at all") + good) == ["no version line in the member"]


def test_search_takes_linear_time():
    began = time.time()
    for junk in (warc.MAGIC * 400_000, b"WARC/1.0\r\n" * 200_000, b"WARC/1.0\r\nA: b\r\n" * 100_000, b"\x1f\x8b\x08\0\0\0\0\0\0\x03" * 200_000):
        assert [x.reason is None for x in warc.salvage(junk + warc.member_of(warc.record_of("response", "<urn:1>", "u", b"x")))][-1]
    assert time.time() - began < 60


def test_damaged_files_through_spark(spark, tmp_path):
    for k, compress in enumerate((True, False)):
        parts = archive(compress, 20)
        parts[7] = parts[7][:-20] + b"\0\0" + parts[7][-18:]
        (tmp_path / f"{k}.warc").write_bytes(b"".join(parts))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r["record_id"] for r in got if r["gap"] is None) == sorted([f"<urn:{i}>" for i in range(20) if i != 7] * 2)
    assert len([r for r in got if r["gap"]]) == 2
