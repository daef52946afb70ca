"""WARC archives written by Spark, and a reader that salvages what damaged archives still hold.

Writing: one record a page, each a gzip member of its own (or plain). Payloads that several pages share are
kept once: the row of the largest id is the response, the others revisit it. Only digests and ids are grouped and
shuffled; texts stay in the tasks that read them while the repeated digests may be broadcast (``common.FEW`` rows),
else they are joined once, hot payloads split. Files go through Spark's own committer: a row is a member without its
last byte, and that byte, always zero, is the line separator (a longer record, whose length reaches that byte, is followed by an
empty member). So a lost executor leaves no half archive, and any store that Spark writes will do.

Reading: every check has to hold: the gzip checksum, the version line and header, the length, the closing
empty lines, and SHA-1 digests where a record has them. After a failed check the reader searches for the next place
at which a whole member or record is valid, goes on from there and gives what it left out as a gap with its reason. Of a
member that breaks off, records with a digest that holds are still given (``intact`` is false). One file is in memory at a time;
``write_warc`` bounds the records of a file.

Defined results: a null html is an empty payload; null ids come before all others; of rows that share the largest id as well one is
the response (the least by a hash of the url, equal rows by number); a null url leaves its header out; other columns are ignored; an
empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.common import FEW, as_text, durable, shared_folder, split_join, table

#: Payloads of fewer bytes are stored anew each time.
LEAST = 0
#: Records of a written file, at most.
RECORDS = 50_000
DATE = "1970-01-01T00:00:00Z"
LEVEL = 6
#: Bytes of a record's header, at most; bytes inflated at a time.
HEADER = 1 << 16
SLICE = 1 << 16
#: So many bytes of a member tell whether a version line begins it; a search tries no more at each place.
FIRST = 1 << 10
#: No row of Spark holds more bytes, so no longer member can be a record.
MEMBER = (1 << 31) - 1

# Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ONCE = ("warc-type", "warc-record-id", "content-length")
_HEAD = re.compile(rb"WARC/\d+\.\d+\r\n((?:[^\r\n:]+:[^\r\n]*\r\n(?:[ \t][^\r\n]*\r\n)*)*)\r\n")
_PLACE = re.compile(rb"\x1f\x8b\x08|WARC/\d")
_VERSION = re.compile(rb"WARC/\d")


def digest(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# Writing


def record_of(kind: str, record_id: str, url: str | None, payload: bytes, refers_to: str | None = None, date: str = DATE) -> bytes:
    """A response or revisit record without its closing empty lines; a revisit has the HTTP header only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if kind == "revisit" else payload
    lines = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id,
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url),
        "WARC-Payload-Digest": "sha1:" + digest(payload),
        "WARC-Block-Digest": "sha1:" + digest(block),
        "WARC-Refers-To": refers_to,
        "WARC-Profile": PROFILE if kind == "revisit" else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines.items() if v is not None) + b"\r\n" + block


def member_of(record: bytes) -> bytes:
    """A whole record as a gzip member; what it gives ends in a zero byte."""
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = squeeze.compress(record) + squeeze.compress(END) + squeeze.flush()
    return out if out[-1] == 0 else out + zlib.compress(b"", wbits=31)


def deduplicated(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """id, url, payload, key, kind, refers_to: every page as a response, or as a revisit of an equal payload."""
    keyed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), as_text(F.col(payload_col)).cast("binary").alias("payload"))
    keyed = keyed.withColumns({"key": F.unhex(F.sha2("payload", 256)), "mark": -F.xxhash64("url").cast("decimal(20,0)")})
    each = keyed.where(F.octet_length("payload") >= least).groupBy("key", "id", "mark").agg(F.count(F.lit(1)).alias("same"))
    tops = each.groupBy("key").agg(F.max(F.struct("id", "mark", "same")).alias("top"), F.sum("same").alias("n")).where("n > 1")
    tops = durable(tops.select("key", F.col("top.id").alias("top_id"), F.col("top.mark").alias("top_mark"), F.col("top.same").alias("same")))
    few = tops.count() <= FEW
    joined = keyed.join(F.broadcast(tops), "key", "left") if few else split_join(keyed, tops, ["key"], "id", "left")
    first = F.col("same").isNotNull() & F.col("id").eqNullSafe(F.col("top_id")) & (F.col("mark") == F.col("top_mark"))
    joined = joined.withColumn("first", first).withColumn("nth", F.lit(1).cast("long"))
    if not tops.where("same > 1").isEmpty():  # equal rows of the largest id: the first of them is the response
        tied = joined.where(F.col("first") & (F.col("same") > 1))
        names = ["key", "id", "mark", "top_id", "top_mark", "same", "first"]
        tied = tied.groupBy(*names).agg(F.first("url").alias("url"), F.first("payload").alias("payload"))
        tied = tied.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "same")))
        joined = joined.where(~F.col("first") | (F.col("same") == 1)).unionByName(tied)
    again = F.col("same").isNotNull() & ~(F.col("first") & (F.col("nth") == 1))
    return joined.select("id", "url", "payload", "key", F.when(again, "revisit").otherwise("response").alias("kind"), F.col("same").isNotNull().alias("shared"), "top_id")


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, compress: bool = True, records: int = RECORDS, date: str = DATE) -> None:
    """One record a page in archives below ``folder``; ids stand in the record ids, ``<urn:x-capture:id:key...>``."""
    rows = deduplicated(pages, id_col, url_col, payload_col, least).select(F.col("id").cast("string").alias("id"), "url", "payload", F.substring(F.hex("key"), 1, 32).alias("key"), "kind", "shared", F.col("top_id").cast("string").alias("top_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        name = lambda i, key: f"<urn:x-capture:{'' if i is None else quote(i, safe='')}:{key}"
        for batch in batches:
            for k in range(batch.num_rows):
                i, url, payload, key, kind, shared, top = (c[k].as_py() for c in batch.columns)
                own = name(i, key) + (">" if shared and kind == "response" else f":{part}-{n}>")
                record = record_of(kind, own, url, payload, name(top, key) + ">" if kind == "revisit" else None, date)
                yield pa.RecordBatch.from_arrays([pa.array([member_of(record)[:-1] if compress else record], pa.binary())], ["member"])
                n += 1

    out = rows.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
    out.write.option("lineSep", "\0" if compress else END.decode()).option("maxRecordsPerFile", records).text(folder)


# Reading


@dataclass
class Found:
    """A record at a place of a file, or a gap of so many bytes with its reason."""

    at: int
    length: int
    reason: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    proven: bool = False
    intact: bool = True


class Bad(ValueError):
    """A failed check; ``resume`` is where the record ends if its frame is whole."""

    def __init__(self, why: str, resume: int | None = None) -> None:
        super().__init__(why)
        self.resume = resume


def _holds(said: str, data: bytes) -> bool | None:
    """Whether a SHA-1 digest, base32 or hex, is that of the data; None for other kinds."""
    kind, _, value = said.strip().partition(":")
    if kind.lower() not in ("sha1", "sha-1") or len(value) not in (32, 40):
        return None
    return value.upper() == (digest(data) if len(value) == 32 else hashlib.sha1(data).hexdigest().upper())


def _record(data: bytes, at: int) -> Found:
    """The record at a place, all checks done."""
    head = _HEAD.match(data, at, at + HEADER)
    if not head:
        raise Bad("no whole header")
    lines = re.sub(r"\r\n[ \t]+", " ", head[1].decode("utf-8", "replace")).split("\r\n")
    named = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines if x)]
    headers = dict(named)
    if any(sum(k == name for k, _ in named) != 1 for name in ONCE):  # twice: the rest of one header before another
        raise Bad("a needed header line is missing or there twice")
    length = headers["content-length"]
    if not re.fullmatch(r"[0-9]{1,19}", length):
        raise Bad("no length")
    start, end = head.end(), head.end() + int(length)
    if end + 4 > len(data):
        raise Bad("it breaks off")
    if data[end : end + 4] != END:
        raise Bad("no end where its length says")
    block = data[start:end]
    http = headers.get("content-type", "").replace(" ", "").startswith("application/http")
    cut = block.find(END) + 4 if http and END in block else len(block) if http else 0
    payload = block[cut:]
    own = _holds(headers.get("warc-block-digest", ""), block)
    whole = None if headers.get("warc-type") == "revisit" else _holds(headers.get("warc-payload-digest", ""), payload)
    if own is False or whole is False:
        raise Bad("digest", end + 4)
    if headers.get("warc-type") == "revisit":
        said = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", block)
        headers["payload-bytes"] = said[1].decode() if said else ""
    return Found(at, end + 4 - at, None, headers, payload, bool(own or whole))


def _plain(data: bytes) -> Iterator[Found]:
    """Records and gaps of plain data."""
    at, bad, why = 0, None, ""
    while at < len(data):
        try:
            found = _record(data, at)
        except Bad as e:
            bad, why = (at, str(e)) if bad is None else (bad, why)
            place = None if e.resume else _VERSION.search(data, at + 1)
            at = e.resume or (place.start() if place else len(data))
            continue
        if bad is not None:
            yield Found(bad, at - bad, why)
            bad = None
        yield found
        at += found.length
    if bad is not None:
        yield Found(bad, len(data) - bad, why)


def _inflated(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """What the gzip member at a place holds, its end (None if it fails), and why it fails."""
    inflate, out, size, fed, view = zlib.decompressobj(31), [], 0, at, memoryview(data)
    try:
        while not inflate.eof and fed < len(data):
            first, to = fed == at, fed + (FIRST if fed == at else SLICE)
            out.append(inflate.decompress(view[fed:to]))
            fed, size = to, size + len(out[-1])
            if first and out[0][:5] != b"WARC/"[: len(out[0])] or first and not out[0] and not inflate.eof and fed < len(data):
                return b"", None, "no version line in the member"
            if size > MEMBER:
                return b"", None, "a member too long for a record"
    except zlib.error:
        return b"".join(out), None, "gzip check failed"
    if not inflate.eof:
        return b"".join(out), None, "it breaks off"
    return b"".join(out), min(fed, len(data)) - len(inflate.unused_data), ""


def _attempt(data: bytes, at: int) -> tuple[list[Found], int | None, str]:
    """The records at a place, where they end (None if only a search can tell), and the reason of a failure."""
    if not data.startswith(MAGIC, at):
        try:
            found = _record(data, at)
            return [found], at + found.length, ""
        except Bad as e:
            return [], e.resume, str(e) if data.startswith(b"WARC/", at) else "no member or version line"
    inner, end, why = _inflated(data, at)
    rows = list(_plain(inner))
    why = why or next((x.reason for x in rows if x.reason is not None), "")
    # Of a member that breaks off only records with a digest of their own count.
    records = [x for x in rows if x.reason is None and (x.proven or end is not None)]
    for x in records:
        x.at, x.length, x.intact = at, (end or len(data)) - at, not why
    return records, end, why


def salvage(data: bytes) -> Iterator[Found]:
    """All valid records of an archive in order, and the gaps between them."""
    at, bad, reason = 0, None, ""
    while at < len(data):
        records, end, why = _attempt(data, at)
        if why and bad is None:
            bad, reason = at, why
        if not why and bad is not None:
            yield Found(bad, at - bad, reason)
            bad = None
        yield from records
        if end is None:
            place = _PLACE.search(data, at + 1)
            end = place.start() if place else len(data)
        at = end
    if bad is not None:
        yield Found(bad, len(data) - bad, reason)


SCHEMA = "file string, at long, length long, gap string, intact boolean, type string, record_id string, refers_to string, target_uri string, date string, payload_bytes long, payload_digest string"


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records and gaps (column gap: the reason, null for records) of all archives below a path.

    ``payload_bytes`` and ``payload_digest`` are those of the payload read; of a revisit those it states. ``payload`` comes if asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    schema = SCHEMA + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def row(file: str, x: Found) -> tuple:
        if x.reason is not None:
            return (file, x.at, x.length, x.reason, *[None] * (8 + payloads))
        h, again = x.headers, x.headers.get("warc-type") == "revisit"
        said = h.get("warc-payload-digest", "").rpartition(":")[2] or None
        size = (int(h["payload-bytes"]) if h["payload-bytes"] else None) if again else len(x.payload)
        return (file, x.at, x.length, None, x.intact, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), size, said if again else digest(x.payload), *[x.payload] * payloads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file, held, size = batch.column(0)[k].as_py(), [], 0
                for x in salvage(batch.column(1)[k].as_buffer().to_pybytes()):
                    held.append(row(file, x))
                    size += len(x.payload) * payloads
                    if len(held) >= 5000 or size >= 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    return files.mapInArrow(run, schema)


def captured(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records that ``write_warc`` wrote."""
    page = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^<urn:x-capture:([^:>]*)', 1), '') AS long)")
    rows = records.where("gap IS NULL AND type IN ('response', 'revisit')")
    return rows.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives written to the shared folder."""
    folder = shared_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return captured(read_warc(spark, folder))


#: Base 32 of a SHA-1: 8 times 20 bits, each 4 letters.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
t AS (SELECT html, max(page_id) AS top FROM p GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN t USING (html)"""
