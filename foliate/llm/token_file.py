"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits, one level each. A level holds its chunks in a row, a
continuation bitmap (does the id go on in the next level?) and a rank directory (set bits before
every ``RANK`` positions). The chunk of an id in the next level lies at the rank of its bit, so any
token is found by one step a level, without decoding what stands before it.

Documents are laid out in ascending id order. A file is a Parquet file without compression whose rows are
segments of ``SEGMENT`` ids or more (never more than one document beyond): the document ids and lengths, and the
levels. Segments are written by Spark's own committer, so lost executors leave no half files. The
place of a document in the corpus is the sum of its part's place (one number a part on the
driver), its segment's place in the part and its place in the segment.

Defined results: a null or empty text has the end id alone; null ids come first, ties in id are
ordered by a hash of the text; repeated rows are all written; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.common import ensure_checkpoint_dir, id_and_text, table
from foliate.llm.pieces import PieceTable

END_ID = 0
CHUNK = 8
#: Positions between entries of the rank directory; a multiple of 8.
RANK = 512
SEGMENT = 1 << 20
#: Characters of texts tokenized at a time, and pieces in one call of the tokenizer.
STEP = 1 << 22
LINES = 200

_ONES = np.array([i.bit_count() for i in range(256)], np.uint8)


class Codes:
    """Directly addressable codes of unsigned integers: ``levels`` of (chunks, bitmap, ranks) as bytes."""

    def __init__(self, levels: list[tuple[bytes, bytes, bytes]]) -> None:
        self.levels = [(np.frombuffer(c, np.uint8), np.frombuffer(b, np.uint8), np.frombuffer(r, "<u4")) for c, b, r in levels]

    @staticmethod
    def pack(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
        levels, left = [], ids.astype(np.uint32)
        while True:
            more = left >> CHUNK > 0
            bits = np.packbits(more, bitorder="little")
            steps = np.add.reduceat(_ONES[bits], np.arange(0, len(bits), RANK // 8), dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
            ranks = (np.cumsum(steps) - steps).astype("<u4")
            levels.append(((left & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
            if not more.any():
                return levels
            left = left[more] >> CHUNK

    def _rank(self, level: int, at: int) -> int:
        """Set bits before a position: a directory entry and the bytes after it."""
        _, bits, ranks = self.levels[level]
        if at // RANK >= len(ranks):  # just past the end
            return int(ranks[-1]) + int(_ONES[bits[(len(ranks) - 1) * RANK // 8 :]].sum(dtype=np.int64)) if len(ranks) else 0
        count = int(ranks[at // RANK]) + int(_ONES[bits[at // RANK * RANK // 8 : at // 8]].sum(dtype=np.int64))
        return count + (int(bits[at // 8]) & (1 << at % 8) - 1).bit_count() if at % 8 else count

    def at(self, position: int) -> int:
        """One id."""
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[position]) << CHUNK * level
            if not bits[position // 8] >> position % 8 & 1:
                break
            position = self._rank(level, position)
        return value

    def run(self, start: int, n: int) -> np.ndarray:
        """Ids of a stretch, found by its first position: only its own chunks are read."""
        out, where = np.zeros(n, np.uint32), np.arange(n)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if not n:
                break
            out[where] |= chunks[start : start + n].astype(np.uint32) << np.uint32(CHUNK * level)
            first = start // 8
            more = np.unpackbits(bits[first : (start + n + 7) // 8], bitorder="little")[start - 8 * first : start - 8 * first + n].astype(bool)
            start, where = self._rank(level, start), where[more]
            n = len(where)
        return out


_loaded: dict[str, PieceTable] = {}


def _worker(text: str) -> PieceTable:
    """One tokenizer of the tokenizers library and its table of pieces a worker process."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _loaded:
        from tokenizers import Tokenizer

        file = json.loads(text) | {"truncation": None, "padding": None}
        tokenizer = Tokenizer.from_str(json.dumps(file))
        line_feed = tokenizer.token_to_id("\u010a")

        def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Ids, places and numbers; pieces go as lines, since a line feed parts them."""
            if len(texts) < 2 or line_feed is None or any("\n" in t[1:] for t in texts):
                found = [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                n = np.array([*map(len, found)], np.int64)
                return np.array([i for ids in found for i in ids], np.uint32), np.cumsum(n) - n, n
            lines = [t.removeprefix("\n") for t in texts]
            calls = tokenizer.encode_batch_fast(["\n" + "\n".join(lines[i : i + LINES]) for i in range(0, len(lines), LINES)], add_special_tokens=False)
            ids = np.array([i for x in calls for i in x.ids], np.uint32)
            feeds = np.flatnonzero(ids == line_feed)
            led = np.fromiter((t[0] == "\n" for t in texts), np.int64, len(texts))
            return ids, feeds + 1 - led, np.append(feeds[1:], len(ids)) - (feeds + 1 - led)

        _loaded[key] = PieceTable(encode, END_ID)
    return _loaded[key]


def _groups(batches: Iterator, pieces: PieceTable) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Document ids, ids and lengths of some rows at a time."""
    for batch in batches:
        texts, at = batch.column(1).to_pylist(), 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size < STEP:
                to, size = to + 1, size + len(texts[to])
            yield batch.column(0).slice(at, to - at), *pieces.ids_of(texts[at:to])
            at = to


def _segments(batches: Iterator, file: str) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """(seq, start in part, document ids, lengths, ids) of one task's sorted rows."""
    seq = start = size = 0
    held: list[tuple] = []

    def segment():
        names, ids, lengths = zip(*held)
        return seq, start, pa.concat_arrays(names), np.concatenate(lengths), np.concatenate(ids)

    for names, ids, lengths in _groups(batches, _worker(file)):
        ends, at = np.cumsum(lengths), 0
        while at < len(names):
            before = int(ends[at - 1]) if at else 0
            to = min(int(np.searchsorted(ends, before + SEGMENT - size)) + 1, len(names))
            held.append((names.slice(at, to - at), ids[before : ends[to - 1]], lengths[at:to]))
            size, at = size + int(ends[to - 1]) - before, to
            if size >= SEGMENT:
                yield segment()
                seq, start, size, held = seq + 1, start + size, 0, []
    if held:
        yield segment()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_token_ids(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize every text, append the end id and write the files into ``folder``.

    One range shuffle of the texts puts them in order; nothing else moves. Rows of one id are told
    apart by a hash of the text and a row number, so an id that many rows share is split too.
    """
    file = docs.sparkSession.sparkContext.broadcast(Path(path or default_path()).read_text(encoding="utf-8"))
    keyed = id_and_text(docs, id_col, text_col).withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    source = keyed.repartitionByRange("doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row").select("doc_id", "text")
    id_type = source.schema["doc_id"].dataType.simpleString()
    level = pa.struct([("chunks", pa.binary()), ("bits", pa.binary()), ("ranks", pa.binary())])

    def run(batches):
        part = TaskContext.get().partitionId()
        for seq, start, names, lengths, ids in _segments(batches, file.value):
            levels = [dict(zip(("chunks", "bits", "ranks"), x)) for x in Codes.pack(ids)]
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            row = [pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (start, pa.int64()), (len(ids), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*row, one(names), one(pa.array(lengths, pa.int64())), pa.array([levels], pa.list_(level))], ["part", "seq", "start", "n_ids", "doc_ids", "lengths", "levels"])

    schema = f"part int, seq int, start long, n_ids long, doc_ids array<{id_type}>, lengths array<long>, levels array<struct<chunks: binary, bits: binary, ranks: binary>>"
    rows = source.mapInArrow(run, schema).withColumns({"first_id": F.array_min("doc_ids"), "last_id": F.array_max("doc_ids")})
    rows.write.option("compression", "none").option("parquet.block.size", 32 << 20).parquet(folder)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _codes(row: pa.RecordBatch) -> Codes:
    return Codes([(x["chunks"], x["bits"], x["ranks"]) for x in _column(row, "levels")[0].as_py()])


def read_token_ids(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids (unless left out) and ids_crc32 of every document in the files."""
    files = spark.read.parquet(folder)
    # One row a written part, that is a task: their places follow from the sums.
    sizes = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    places = spark.sparkContext.broadcast(dict(zip([p for p, _ in sizes], accumulate([0, *[n for _, n in sizes]]))))
    names = ["doc_id", "start", "n_tokens", *["ids"] * with_ids, "ids_crc32"]
    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                lengths = _column(row, "lengths").flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(lengths)
                ids = _codes(row).run(0, int(ends[-1]))
                base = places.value[_column(row, "part")[0].as_py()] + _column(row, "start")[0].as_py()
                view, stops = memoryview(ids.astype("<u4").view(np.uint8)), (4 * ends).tolist()
                sums = [zlib.crc32(view[a:b]) for a, b in zip([0, *stops], stops)]
                columns = [_column(row, "doc_ids").flatten(), pa.array(ends - lengths + base, pa.int64()), pa.array(lengths, pa.int64())]
                columns += [pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(ids.astype(np.int32)))] * with_ids
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.int64())], names)

    return files.select("part", "start", "doc_ids", "lengths", "levels").mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, {'ids array<int>, ' * with_ids}ids_crc32 long")


def token_at(spark: SparkSession, folder: str, doc_id, position: int) -> int | None:
    """The token at a position of a document (null if there is none): its segment is found by its ids, and nothing else is decoded.

    Of several documents with that id, the first in the files that is long enough is taken.
    """
    files = spark.read.parquet(folder)
    with_it = files.where((F.col("first_id") <= F.lit(doc_id)) & (F.col("last_id") >= F.lit(doc_id)))
    # One pass over the segment's documents: where each begins, and the place in the first that is meant.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("place"))
    meant = lambda s, x: F.when((x["doc_ids"] == F.lit(doc_id)) & (x["lengths"] > position), s["at"] + F.lit(position).cast("long"))
    step = lambda s, x: F.struct((s["at"] + x["lengths"]).alias("at"), F.coalesce(s["place"], meant(s, x)).alias("place"))
    place = F.aggregate(F.arrays_zip("doc_ids", "lengths"), start, step, lambda s: s["place"])
    row = with_it.select("part", "seq", "levels", place.alias("place")).where("place IS NOT NULL").orderBy("part", "seq").limit(1)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array([_codes(batch.slice(k, 1)).at(_column(batch, "place")[k].as_py())], pa.int64())], ["token"])

    one = row.mapInArrow(run, "token long").first()
    return one["token"] if one else None


def op8_token_file(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from files written to the shared folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/token_ids-{uuid.uuid4()}"
    write_token_ids(table(spark, sf_dir, "documents"), folder, path)
    return read_token_ids(spark, folder, with_ids=False)
