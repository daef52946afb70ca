"""Secret scan with corpus-wide ownership frequency.

Patterns find candidates in every whole text. The digest of each candidate value is counted over
the corpus by distinct repositories (the ``source`` column) and by distinct owners (a repository's name up to its first
slash; the whole name without one). A value that more than ``EXAMPLE_OWNERS`` owners or ``EXAMPLE_REPOSITORIES`` repositories
hold is a widely copied example; one that few hold, with the look of a live credential (see ``live_looking``), is live.
Live spans are added to the base spans, which all stay.

Only candidates move: texts are read once and never shuffled. A value in very many rows combines by
(value, owner) before the shuffle.

Defined results: null and empty texts have no spans; a null repository is one of its own, with an owner of its own; repeated
rows count once an owner and each give their row; a null id is passed on; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.common import as_text, durable, split_join, table

#: Kinds in order, their patterns, and the least characters of the value.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
#: Owners and repositories that a live credential has at most.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 2, 8
#: Least characters of a live value, and the least share of the bits a character that its length allows (16 symbols count at most).
LIVE_LEAST, LIVE_SHARE = 12, 0.75
#: Words of values that stand in for a credential.
PLACEHOLDERS = ("password", "passwd", "changeme", "change_me", "example", "sample", "placeholder", "dummy", "your", "test", "secret", "token", "xxxx", "none", "null", "default", "redacted", "123456", "abcdef")


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """kind, start, end, value of the base spans, by start and then kind; leftmost, not overlapping within a kind."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def entropy(value: str) -> float:
    """Bits a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def live_looking(value: str) -> bool:
    """Whether a value looks like a credential in use: long enough, no placeholder, letters and digits or both cases, and random for its length."""
    low = value.lower()
    if len(value) < LIVE_LEAST or any(w in low for w in PLACEHOLDERS):
        return False
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)) and (low == value or value.upper() == value):
        return False
    return entropy(value) >= LIVE_SHARE * math.log2(min(len(value), 16))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """doc_id, owner, found (kind, start, end, value digest, random) of every row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), as_text(F.col(text_col)).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("random", pa.bool_())])

    def run(batches):
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b, "value": hashlib.sha256(v.encode()).hexdigest()[:32], "random": live_looking(v)} for k, a, b, v in candidates(t)] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(span))], ["doc_id", "owner", "found"])

    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {id_type}, owner string, found array<struct<kind: string, start: long, end: long, value: string, random: boolean>>")


def ownership(scanned: DataFrame) -> DataFrame:
    """value, owners, repositories: the number of distinct ones that hold each candidate value, a null counted as one."""
    held = scanned.select(F.coalesce(F.concat(F.lit("+"), "owner"), F.lit("-")).alias("repository"), F.explode("found.value").alias("value")).distinct()
    by_owner = held.groupBy("value", F.substring_index("repository", "/", 1).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """doc_id, owner, spans of every row: an array of (start, kind order, kind, end, owners, status).

    status is example (many owners or repositories), live (few, and it looks like a credential) or weak (few, and it does not).
    """
    scanned = durable(scan(docs, id_col, text_col, owner_col).withColumn("row", F.monotonically_increasing_id()))
    found = durable(scanned.select("row", F.explode("found").alias("x")).withColumn("value", F.col("x.value")))
    each = split_join(found, ownership(scanned), ["value"], "row")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("x.kind")).cast("int")
    status = F.when((F.col("owners") > example_owners) | (F.col("repositories") > example_repositories), "example").when(F.col("x.random"), "live").otherwise("weak")
    spans = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("x.start").alias("start"), order.alias("at"), F.col("x.kind").alias("kind"), F.col("x.end").alias("end"), "owners", status.alias("status")))).alias("spans"))
    with_any = scanned.where(F.size("found") > 0).select("row", "doc_id", "owner").join(spans, "row").select("doc_id", "owner", "spans")
    kind = with_any.schema["spans"].dataType.simpleString()
    without = scanned.where(F.size("found") == 0).select("doc_id", "owner", F.array().cast(kind).alias("spans"))
    return with_any.unionByName(without)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts and digest, and all spans of every document; then the live and example counts.

    Added spans are of kind ``live``: a candidate of few owners whose value is random, at its place.
    """
    out = classify(table(spark, sf_dir, "documents"))
    of = lambda name: F.size(F.filter("spans", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")
    with_status = lambda name: F.size(F.filter("spans", lambda x: x["status"] == name)).cast("long").alias(f"n_{name}")
    written = lambda kind, x: F.concat_ws(":", kind, x["start"].cast("string"), x["end"].cast("string"))
    base = F.concat_ws(",", F.transform("spans", lambda x: written(x["kind"], x)))
    live = F.transform(F.filter("spans", lambda x: x["status"] == "live"), lambda x: F.struct(x["start"].alias("start"), (F.lit(len(KINDS)) + x["at"]).alias("at"), written(F.lit("live"), x).alias("s")))
    own = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["at"].alias("at"), written(x["kind"], x).alias("s")))
    every = F.concat_ws(",", F.transform(F.array_sort(F.concat(own, live)), lambda x: x["s"]))
    return out.select("doc_id", *map(of, KINDS), F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), with_status("live"), with_status("example"))
