"""Exact nearest vectors by cosine, with angles to pivots that spare most comparisons.

Each vector belongs to the pivot that it makes the smallest angle with, and is stored by (pivot, angle): an index of all
vectors, written once. By the triangle inequality of angles, a vector at angle t of a pivot makes an angle of
|t - s| at least with a query at angle s of it. A block of neighbours in the index spans a few angles of one pivot, so
it is compared only with the queries for which that bound still allows a score as good as what they have: first every query
looks in its own pivot's part for a score that its k-th nearest has at least, then in all blocks that can beat it. A comparison
of a block with its queries is one product of matrices. Results are those of comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from foliate.sources.shared import new_folder

#: Pivots, chosen far apart of so many rows times ``OF`` that a hash picks; rows of the index compared at once.
PIVOTS, OF, BLOCK = 128, 8, 512
#: Bytes of query vectors that every task holds at a time, at most (as doubles).
BYTES = 64 << 20
#: Candidates that a task holds before it drops those beyond a query's best.
HELD = 1 << 20
#: More than the rounding of scores to ``DIGITS`` and of angles can add up to.
DIGITS, SLACK = 6, 2e-6


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(x) @ pivots.T, -1.0, 1.0))


def _usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """vec_id, embedding of vectors that have a direction: no nulls, not all zeros, only finite numbers."""
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).select("vec_id", "embedding")
    return rows if dim is None else rows.where(F.size("embedding") == dim)


def choose_pivots(vectors: DataFrame, dim: int, n: int = PIVOTS) -> np.ndarray:
    """Directions far from one another: each next is the farthest from all before, among ``n * OF`` rows that a hash picks."""
    rows = vectors.orderBy(F.xxhash64("vec_id", "embedding")).limit(n * OF).collect()
    if not rows:
        return np.zeros((0, dim))
    sample = _unit(np.array([r["embedding"] for r in rows], np.float64))
    picked, near = [0], sample @ sample[0]
    while len(picked) < min(n, len(sample)) and near.min() < 1 - 1e-12:
        picked.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[picked[-1]])
    return sample[picked]


def index(vectors: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """vec_id, embedding, pivot, angle of all vectors, sorted by pivot and angle in the shared folder."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = _angles(_matrix(batch.column(1), dim), sent.value)
                own = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(angles[np.arange(len(own)), own])], ["vec_id", "embedding", "pivot", "angle"])

    rows = vectors.mapInArrow(run, f"vec_id {kinds['vec_id']}, embedding {kinds['embedding']}, pivot int, angle double")
    folder = new_folder(vectors.sparkSession, "vectors")
    # The id comes last, so that many vectors at one angle, as copies have, are dealt out too.
    rows.repartitionByRange("pivot", "angle", "vec_id").sortWithinPartitions("pivot", "angle").write.parquet(folder)
    return vectors.sparkSession.read.schema(rows.schema).parquet(folder)


class Search:
    """The best vectors of all queries of a block, within one task."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, least: np.ndarray, k: int, own_only: bool) -> None:
        self.ids, self.queries, self.k, self.own_only = ids, queries, k, own_only
        self.norms = np.linalg.norm(queries, axis=1)
        self.angles = _angles(queries, pivots)
        self.own = self.angles.argmin(axis=1)
        self.least = least.copy()
        self.pairs, self.held, self.size = 0, [], 0

    def block(self, vec_ids: np.ndarray, x: np.ndarray, pivot: int, low: float, high: float) -> None:
        """Compare vectors between two angles of a pivot with the queries that they may matter to."""
        angle = self.angles[:, pivot]
        gap = np.maximum(0.0, np.maximum(angle - high, low - angle))
        active = np.cos(np.minimum(gap, np.pi)) >= self.least - SLACK
        if self.own_only:
            active &= self.own == pivot
        q = np.flatnonzero(active)
        if not len(q):
            return
        self.pairs += len(q) * len(x)
        scores = np.round(self.queries[q] @ x.T / (self.norms[q][:, None] * np.linalg.norm(x, axis=1)[None, :]), DIGITS)
        good = (scores >= self.least[q][:, None]) & (self.ids[q][:, None] != vec_ids[None, :])
        at, row = np.nonzero(good)
        if len(at):
            self.held.append((q[at], vec_ids[row], scores[at, row]))
            self.size += len(at)
            if self.size > HELD:
                self.shrink()

    def shrink(self) -> None:
        """Keep each query's best, equal scores by id, and expect no less from now on."""
        if not self.held:
            return
        q, ids, scores = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        last = rank == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], scores[last])
        keep = rank < self.k
        self.held, self.size = [(q[keep], ids[keep], scores[keep])], int(keep.sum())


def _found(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, least: np.ndarray, k: int, own_only: bool) -> DataFrame:
    """query_id, vec_id, score, pairs: each task's best, and the comparisons it made (with a null query in the last row)."""
    kind, dim = rows.schema["vec_id"].dataType.simpleString(), queries.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast((ids, queries, pivots, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, type_ = Search(*sent.value, k, own_only), None
        for batch in batches:
            if not batch.num_rows:
                continue
            type_ = batch.column(0).type
            vec_ids, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), dim)
            pivot, angle = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ends = np.append(np.flatnonzero(pivot[1:] != pivot[:-1]) + 1, len(pivot))
            at = 0
            for end in ends.tolist():
                for a in range(at, end, BLOCK):
                    b = min(a + BLOCK, end)
                    search.block(vec_ids[a:b], x[a:b], int(pivot[a]), float(angle[a:b].min()), float(angle[a:b].max()))
                at = end
        search.shrink()
        if type_ is None:
            return
        q, vec_ids, scores = search.held[0] if search.held else (np.zeros(0, int), search.ids[:0], np.zeros(0))
        names = ["query_id", "vec_id", "score", "pairs"]
        yield pa.RecordBatch.from_arrays([pa.array(search.ids[q], type_), pa.array(vec_ids, type_), pa.array(scores, pa.float64()), pa.array(np.zeros(len(q), np.int64))], names)
        yield pa.RecordBatch.from_arrays([pa.array([None], type_), pa.array([None], type_), pa.array([None], pa.float64()), pa.array([search.pairs], pa.int64())], names)

    return rows.mapInArrow(run, f"query_id {kind}, vec_id {kind}, score double, pairs long")


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, threshold: float = 0.2, most_bytes: int = BYTES, pivots: int = PIVOTS, observed: list[Observation] | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: the ``k`` nearest other vectors of each query at or above the threshold, equal scores by id.

    Both tables have vec_id and embedding. Query vectors go to the tasks in blocks of ``most_bytes`` at most, the index is read twice a block. Queries that share
    an id share its ``k`` places. Rows without an id or a direction (null, zero or not finite), and pairs of different length, have no
    score. ``observed`` gets an ``Observation`` a block, whose ``pairs`` are the comparisons made, once the result has been computed.
    """
    named = _usable(queries)
    parts = []
    for row in named.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect():  # a row a length of vectors
        dim, blocks = row["dim"], max(1, -(-row["n"] * row["dim"] * 8 // most_bytes))
        all_ = _usable(vectors, dim)
        far = choose_pivots(all_, dim, pivots)
        if not len(far):
            continue
        rows = index(all_, far, dim)
        for i in range(blocks):
            own = named.where((F.size("embedding") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)).toArrow()
            if not own.num_rows:
                continue
            ids, x = own.column("vec_id").to_numpy(), _matrix(own.column("embedding").combine_chunks(), dim)
            least = np.full(len(ids), float(threshold))
            near = _found(rows, ids, x, far, least, k, True).where("query_id IS NOT NULL")
            order = Window.partitionBy("query_id").orderBy(F.col("score").desc())
            worst = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", "score").collect()  # a number a query
            place = {q: j for j, q in enumerate(ids.tolist())}
            for r in worst:
                least[place[r["query_id"]]] = max(threshold, r["score"])
            found = _found(rows, ids, x, far, least, k, False)
            if observed is not None:
                observed.append(Observation())
                found = found.observe(observed[-1], F.sum("pairs").alias("pairs"))
            parts.append(found.where("query_id IS NOT NULL").drop("pairs"))
    if not parts:
        nothing = named.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        return nothing.where("false")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
