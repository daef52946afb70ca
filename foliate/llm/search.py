"""Ranked lexical search by windowed bucket scoring.

Documents are tokenized once for a block of queries; of each only its number of terms and the frequencies of the
queries' terms are written down. Read back in ascending id order, ``WINDOW`` documents at a time are turned
into posting lists. For each query the lists of its terms are added into one array with a slot a document, small enough for a
core's cache; a bitmap marks the blocks of ``BLOCK`` slots that were touched, and only these are
harvested into the query's heap and cleared. Each task gives ``top`` rows a query at most; the best of all
tasks are the result. Nothing is left out on the way: every document is scored for every query that shares a term.

The collection's figures (documents with a term, all terms, documents a term) are counted over all documents.
Queries go to the tasks in blocks of about ``ITEM_BYTES`` of distinct text, one pass over the documents each.

Defined results: a null or empty text has no term and is not counted; a query without terms has no rows;
repeated documents are ranked each by itself, a null id before others of its score; repeated queries each have
their rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliate.llm.common import as_text, id_and_text, table, written

TOP = 20
#: Documents a window: their sums of eight bytes take a quarter of a megabyte.
WINDOW = 1 << 15
BLOCK = 64
#: Bytes of distinct query text in one pass over the documents, about.
ITEM_BYTES = 8 << 20
#: Bytes of text tokenized at a time.
STEP = 1 << 22

#: All ASCII but letters and digits parts terms; A-Z become lower case; every other character belongs to a term.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | bytes) -> list[bytes]:
    """The terms of a text as UTF-8."""
    return (text if isinstance(text, bytes) else text.encode()).translate(_TABLE).split()


def _long(text: bytes, vocabulary: dict[bytes, int]) -> tuple[int, Counter]:
    """Number of terms and frequencies of known ones, a stretch of the text at a time."""
    n, found, at = 0, Counter(), 0
    text = text.translate(_TABLE)
    while at < len(text):
        to = text.find(b" ", at + STEP)
        words = text[at : to if to >= 0 else len(text)].split()
        n, at = n + len(words), to if to >= 0 else len(text)
        found.update(i for i in map(vocabulary.get, words) if i is not None)
    return n, found


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, ids, tfs: the number of terms and the frequencies of known ones."""
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        at = 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            if size > STEP:
                n, found = _long(texts[at], vocabulary)
                lists = [pa.array([x], pa.list_(pa.int32())) for x in (list(found), list(found.values()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([n], pa.int64()), *lists], ["doc_id", "n", "ids", "tfs"])
                at = to
                continue
            while to < len(texts) and size < STEP:
                to, size = to + 1, size + len(texts[to])
            words = [terms(t) for t in texts[at:to]]
            n = np.fromiter(map(len, words), np.int64, to - at)
            ids = np.fromiter((i for w in words for i in map(vocabulary.get, w, repeat(-1))), np.int64, int(n.sum()))
            keys = (np.repeat(np.arange(to - at), n) * max(1, len(vocabulary)) + ids)[ids >= 0]
            keys, tfs = np.unique(keys, return_counts=True)
            docs, ids = np.divmod(keys, max(1, len(vocabulary)))
            ends = np.append(0, np.cumsum(np.bincount(docs, minlength=to - at))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(n), *lists], ["doc_id", "n", "ids", "tfs"])
            at = to


class Scorer:
    """The heaps of all queries, filled window by window."""

    def __init__(self, queries: list[dict[int, int]], weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> None:
        self.queries, self.weights, self.n_docs, self.n_terms, self.top = queries, weights, n_docs, n_terms, top
        self.heaps: list[list[tuple]] = [[] for _ in queries]
        self.sums = np.zeros((WINDOW // BLOCK, BLOCK), np.int64)
        self.touched = np.zeros(WINDOW // BLOCK, bool)

    def window(self, docs: list, n: np.ndarray, ends: np.ndarray, ids: np.ndarray, tfs: np.ndarray) -> None:
        """Score ``WINDOW`` documents at most, in ascending id order."""
        slots = np.repeat(np.arange(len(docs)), np.diff(ends))
        length = 100 - 25 + (25 * n * self.n_docs) // self.n_terms
        tf = tfs.astype(np.int64)
        values = self.weights[ids] * ((1_000_000_000 * tf) // (1000 * tf + 12 * length[slots]))
        order = np.argsort(ids, kind="stable")
        slots, values = slots[order], values[order]
        first = np.searchsorted(ids[order], np.arange(len(self.weights) + 1)).tolist()
        flat = self.sums.reshape(-1)
        for query, heap in zip(self.queries, self.heaps):
            for term, times in query.items():
                if (a := first[term]) < (b := first[term + 1]):
                    flat[slots[a:b]] += times * values[a:b]
                    self.touched[slots[a:b] // BLOCK] = True
            blocks = np.flatnonzero(self.touched)
            if len(blocks):
                self._harvest(heap, blocks, docs)
                self.sums[blocks] = 0
                self.touched[blocks] = False

    def _harvest(self, heap: list[tuple], blocks: np.ndarray, docs: list) -> None:
        scores = self.sums[blocks].reshape(-1)
        found = np.flatnonzero(scores >= (heap[0][0] if len(heap) == self.top else 1))
        if len(found) > self.top:
            found = found[scores[found] >= np.partition(scores[found], -self.top)[-self.top]]
            found = found[np.argsort(-scores[found], kind="stable")[: self.top]]
        for at in found.tolist():
            doc = docs[int(blocks[at // BLOCK]) * BLOCK + at % BLOCK]
            entry = (int(scores[at]), doc is None, 0 if doc is None else -doc, doc)
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry[:3] > heap[0][:3]:
                heapq.heapreplace(heap, entry)

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for q, heap in enumerate(self.heaps):
            for score, _, _, doc in heap:
                yield q, doc, score


def _scored(batches: Iterator[pa.RecordBatch], scorer: Scorer, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """key, doc_id, score: the best of one task's documents for each query."""

    def flush(held: list[pa.RecordBatch]) -> None:
        docs = [x for b in held for x in b.column(0).to_pylist()]
        n = np.concatenate([b.column(1).to_numpy() for b in held])
        sizes = np.concatenate([b.column(2).value_lengths().to_numpy() for b in held])
        ids, tfs = (np.concatenate([b.column(k).flatten().to_numpy() for b in held]) for k in (2, 3))
        scorer.window(docs, n, np.append(0, np.cumsum(sizes)), ids, tfs)

    held, size = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, WINDOW - size)
            held, size, at = [*held, part], size + part.num_rows, at + part.num_rows
            if size == WINDOW:
                flush(held)
                held, size = [], 0
    if held:
        flush(held)
    best = list(scorer.rows())
    if best:
        q, docs, scores = zip(*best)
        yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in q]), pa.array(docs, pa.int64()), pa.array(scores, pa.int64())], ["key", "doc_id", "score"])


def weight(n_docs: int, df: int) -> int:
    """A term's weight; a ratio of doubles."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _block(docs: DataFrame, asked: list, top: int) -> DataFrame:
    """key, doc_id, score: the best rows of each task for the queries (key, text) of one block."""
    spark = docs.sparkSession
    counts = [Counter(terms(r["text"])) for r in asked]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    sent = spark.sparkContext.broadcast(vocabulary)
    narrow = written(docs.mapInArrow(lambda b: _counted(b, sent.value), "doc_id long, n long, ids array<int>, tfs array<int>"), "postings")
    total = narrow.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    held = narrow.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df")).collect()  # a row a query term at most
    weights = np.zeros(len(vocabulary), np.int64)
    for r in held:
        weights[r["id"]] = weight(total["docs"], r["df"])
    queries = [{i: times for t, times in c.items() if weights[i := vocabulary[t]]} for c in counts]
    told = spark.sparkContext.broadcast((queries, weights, total["docs"], total["terms"] or 0, top, [r["key"] for r in asked]))
    # Rows of one id are told apart by a row number, so an id that many rows share is split too.
    rows = narrow.where(F.size("ids") > 0).withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id").select("doc_id", "n", "ids", "tfs")
    return ordered.mapInArrow(lambda b: _scored(b, Scorer(*told.value[:-1]), told.value[-1]), "key string, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of every item (item_id, text), equal scores by ascending id."""
    docs = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    items = items.select("item_id", as_text(F.col("text")).alias("text")).withColumn("key", F.sha2("text", 256)).where("text <> ''")
    asked = items.groupBy("key").agg(F.first("text").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // item_bytes))
    blocks = [_block(docs, rows, top) for i in range(n) if (rows := asked.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i).collect())]
    if not blocks:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    found = reduce(DataFrame.unionByName, blocks).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return items.select("item_id", "key").join(found, "key").select("item_id", "rank", "doc_id", "score")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 20 best documents of every benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents), q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id), g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
t AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, g GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN t USING (term) JOIN n USING (doc_id), g GROUP BY ALL HAVING score > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20"""
