"""Benchmark decontamination: a BM25 inverted index of the test items, searched by every passage.

The test items are the index and the training passages the queries. Items are cut into parts of
``PART`` words at most; a document's passages are overlapping windows of two blocks of ``PART`` words, so
a part that a text holds lies whole in some passage. A part's score is divided by the score it
gives itself, so the threshold means the same for long and short items. Search is block-max WAND, with
its weak-and test run first on all of a document's passages at once: a part's most common words,
worth ``REST`` of its score at most, count as present, and if the impacts of its other words in a passage
do not make up the difference for any part, no part can reach the threshold there. Passages that pass are
searched, with the blocks' largest impacts to step over what can't reach it. Every
part at or above it is retrieved, and its item is verified: enough of the word 5-grams of the
question, and of the answer, must be in the document.

The index is broadcast in shards of about ``SHARD_BYTES`` of item text, as many as the benchmark needs, with
word counts over the whole benchmark. The documents are read once a shard, so no task holds more
than one shard, and are never shuffled.

Defined results: null or empty texts and items without words match nothing; repeated rows each
give their rows; items with the same text are all reported; a null id is passed on; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from foliate.llm.common import as_text, durable, id_and_text, table

PART = 64
K1, B = 1.2, 0.75
#: Least share of a part's own score that retrieves it.
THRESHOLD = 0.5
#: Word n-grams and the least share of them that verifies a question or an answer.
GRAM, OVERLAP = 5, 0.8
#: Most of a part's own score that its commonest words, left out of the first test, may make up.
REST = 0.3
#: Postings a block.
BLOCK = 32
SHARD_BYTES = 8 << 20

#: ASCII letters and digits stay, other ASCII characters part words; other bytes belong to words.
_WORD_BYTES = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The first line and the rest; of one line the last sentence is the answer, of one sentence its second half."""
    lines = [x for x in text.split("\n") if words_of(x)]
    if len(lines) < 2:
        lines = [x for x in (lines[0] if lines else "").split(". ") if words_of(x)]
        if len(lines) < 2:
            words = words_of(lines[0]) if lines else []
            half = (len(words) + 1) // 2
            return words[:half], words[half:]
        return words_of(". ".join(lines[:-1])), words_of(lines[-1])
    return words_of(lines[0]), words_of("\n".join(lines[1:]))


def _grams(words: list[bytes]) -> list[bytes]:
    """Distinct word n-grams, framed by spaces; of fewer words, the whole sequence."""
    if not words:
        return []
    return list(dict.fromkeys(b" " + b" ".join(words[i : i + GRAM]) + b" " for i in range(max(1, len(words) - GRAM + 1))))


class Index:
    """Posting lists of normalised BM25 impacts with block maxima, over parts of items."""

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int], n_parts: int, mean_words: float) -> None:
        self.items = [(i, *(_grams(x) for x in question_and_answer(t))) for i, t in items]
        self.item_of: list[int] = []
        rest: list[float] = []
        rarer: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        postings: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for k, (_, text) in enumerate(items):
            for part in parts_of(text):
                tf = Counter(part)
                raw = {w: math.log(1 + (n_parts - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(part) / mean_words)) for w, f in tf.items()}
                own, left = sum(raw.values()), 0.0
                for w in sorted(raw, key=lambda w: (-df[w], w)):
                    x = raw[w] / own
                    postings[w].append((len(self.item_of), x))
                    if left + x <= REST:
                        left += x
                    else:
                        rarer[w].append((len(self.item_of), x))
                rest.append(left)
                self.item_of.append(k)
        self.terms = {w: i for i, w in enumerate(postings)}
        self.parts = [[p for p, _ in x] for x in postings.values()]
        self.impacts = [[s for _, s in x] for x in postings.values()]
        self.tops = [[max(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)] for x in self.impacts]
        self.most = np.array([max(x) for x in self.tops] or [0.0])
        lists = [rarer.get(w, []) for w in postings]
        self.first_len = np.array([len(x) for x in lists], np.int64)
        self.first_at = np.concatenate(([0], np.cumsum(self.first_len)))[:-1]
        self.first_part = np.array([p for x in lists for p, _ in x], np.int64)
        self.first_impact = np.array([s for x in lists for _, s in x])
        self.rest = np.array(rest)

    def passages(self, blocks: np.ndarray, terms: np.ndarray, n: int, threshold: float) -> list[int]:
        """The passages (blocks w and w + 1 of n) where some part passes the weak-and test."""
        counts = self.first_len[terms]
        row = np.repeat(np.arange(len(terms)), counts)
        at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + self.first_at[terms[row]]
        part, impact, block, size = self.first_part[at], self.first_impact[at], blocks[row], len(self.rest)
        need = threshold - 1e-9 - self.rest
        if n * size <= 1 << 22:
            sums = np.bincount(block * size + part, impact, n * size).reshape(n, size)
            if n > 1:
                sums = sums[:-1] + sums[1:]
            return np.flatnonzero((sums >= need).any(axis=1)).tolist()
        if n > 1:  # each block in the passage that it begins and the one that it ends
            part, impact = np.concatenate((part, part)), np.concatenate((impact, impact))
            block = np.concatenate((block, block - 1))
        keys, inverse = np.unique((block + 1) * size + part, return_inverse=True)
        passing = keys[np.bincount(inverse, impact, len(keys)) >= need[keys % size]]
        last = max(n - 2, 0)
        return [w for w in np.unique(passing // size - 1).tolist() if 0 <= w <= last]

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> dict[int, float]:
        """part -> score of all parts whose score over the distinct ``terms`` reaches the threshold."""
        found: dict[int, float] = {}
        floor = threshold - 1e-9
        most = self.most
        cursors = [[self.parts[t][0], 0, t] for t in terms]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += most[c[2]]
                if bound >= floor:
                    pivot = k
                    break
            if pivot < 0:
                break
            part = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == part:
                pivot += 1
            blocks = 0.0
            for c in cursors[: pivot + 1]:
                c[1] = self._seek(c[2], c[1], part)
                if c[1] < len(self.parts[c[2]]):
                    blocks += self.tops[c[2]][c[1] // BLOCK]
            if blocks >= floor:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    at, t = c[1], c[2]
                    if at < len(self.parts[t]) and self.parts[t][at] == part:
                        score += self.impacts[t][at]
                        c[1] = at + 1
                if score >= floor:
                    found[part] = score
                target = part + 1
            else:
                # No part before the nearest end of these blocks, or before the next list's part, can reach it.
                ends = [self.parts[c[2]][min((c[1] // BLOCK + 1) * BLOCK, len(self.parts[c[2]])) - 1] + 1 for c in cursors[: pivot + 1] if c[1] < len(self.parts[c[2]])]
                target = min(ends + [c[0] for c in cursors[pivot + 1 : pivot + 2]] or [part + 1])
                target = max(target, part + 1)
            for c in cursors[: pivot + 1]:
                c[1] = self._seek(c[2], c[1], target)
            cursors = [[self.parts[t][at], at, t] for _, at, t in cursors if at < len(self.parts[t])]
        return found

    def _seek(self, term: int, at: int, part: int) -> int:
        """The first posting from ``at`` on whose part is ``part`` or later; whole blocks are stepped over."""
        parts = self.parts[term]
        while at < len(parts) and parts[min((at // BLOCK + 1) * BLOCK, len(parts)) - 1] < part:
            at = (at // BLOCK + 1) * BLOCK
        while at < len(parts) and parts[at] < part:
            at += 1
        return at

    def matches(self, text: str, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, float, float, float]]:
        """item id, best score, question and answer overlap of the items that a whole text holds."""
        words = words_of(text)
        if not words or not self.terms:
            return []
        get = self.terms.get
        terms = np.array([get(w, -1) for w in words], np.int64)
        at = np.flatnonzero(terms >= 0)
        if not len(at):
            return []
        size = len(self.terms)
        keys = np.unique(at // PART * size + terms[at])
        blocks, terms = keys // size, keys % size
        n = (len(words) + PART - 1) // PART
        best: dict[int, float] = {}
        for w in self.passages(blocks, terms, n, threshold):
            inside = np.unique(terms[np.searchsorted(blocks, w) : np.searchsorted(blocks, w + 2)])
            for part, score in self.search(inside.tolist(), threshold).items():
                k = self.item_of[part]
                best[k] = max(best.get(k, 0.0), score)
        if not best:
            return []
        joined, out = b" " + b" ".join(words) + b" ", []
        for k, score in sorted(best.items()):
            item, *sides = self.items[k]
            shares = [sum(g in joined for g in grams) / len(grams) if grams else 1.0 for grams in sides]
            if min(shares) >= overlap:
                out.append((item, score, *shares))
        return out


def parts_of(text: str) -> list[list[bytes]]:
    """An item's words in parts of even length, ``PART`` at most."""
    words = words_of(text)
    n = -(-len(words) // PART)
    return [words[i * len(words) // n : (i + 1) * len(words) // n] for i in range(n)]


def _indexes(items: DataFrame, item_id: str, item_text: str, shard_bytes: int):
    """The broadcast shards of the index, one after the other."""
    spark = items.sparkSession
    items = items.select(F.col(item_id).alias("item_id"), as_text(F.col(item_text)).alias("text"))

    def part_words(batches):
        for batch in batches:
            rows = [(str(i), k, len(p), w) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, p in enumerate(parts_of(t)) for w in sorted(set(p))]
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.binary()))], ["item", "part", "n_words", "word"])

    schema = "item string, part int, n_words int, word binary"
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    parts = items.mapInArrow(part_words, schema)
    # One row a part gives the number of parts and their mean length.
    size = parts.groupBy("item", "part").agg(F.max("n_words").alias("n")).agg(F.count("n").alias("parts"), F.coalesce(F.avg("n"), F.lit(1.0)).alias("mean")).first()
    counts = parts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    shards = max(1, -(-total // shard_bytes))
    for k in range(shards):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k) if shards > 1 else items
        used = own.mapInArrow(part_words, schema).select("word").distinct()
        df = {bytes(r["word"]): r["df"] for r in counts.join(used, "word").collect()}
        rows = sorted(((r["item_id"], r["text"]) for r in own.collect()), key=repr)
        yield spark.sparkContext.broadcast(Index(rows, df, size["parts"], size["mean"]))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every verified match."""
    source, id_type = id_and_text(docs, id_col, text_col), items.schema[item_id].dataType
    doc_type, item_type = source.schema["doc_id"].dataType.simpleString(), to_arrow_type(id_type)
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]

    def found(index):
        def run(batches):
            for batch in batches:
                hits = [(k, *m) for k, t in enumerate(batch.column(1).to_pylist()) for m in index.value.matches(t, threshold, overlap)]
                rows, items_, *numbers = list(zip(*hits)) or [[]] * 5
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items_, item_type), *(pa.array(x, pa.float64()) for x in numbers)]
                yield pa.RecordBatch.from_arrays(columns, names)

        return source.mapInArrow(run, f"doc_id {doc_type}, item_id {id_type.simpleString()}, score double, question_overlap double, answer_overlap double")

    return reduce(DataFrame.unionByName, map(found, _indexes(items, item_id, item_text, shard_bytes)))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a test item; all columns are kept and nothing is shuffled.

    Between shards the rows left are written to the shared folder, so each pass holds one shard.
    """

    def without(index):
        def run(batches):
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                yield batch.filter(pa.array([not (t and index.value.matches(t, threshold, overlap)) for t in texts], pa.bool_()))

        return run

    left = None
    for index in _indexes(items, item_id, item_text, shard_bytes):
        left = (docs if left is None else durable(left)).mapInArrow(without(index), docs.schema)
    return left


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score and the two overlaps for every document that holds a benchmark item."""
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumns({c: F.round(c, 6) for c in ("score", "question_overlap", "answer_overlap")})
