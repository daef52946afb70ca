"""Text quality by a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Byte embeddings go through
learned filters; each filter's maximum over a chunk (with the chunk's length and its logarithm) feeds a hidden layer, and
each hidden unit's maximum over all chunks feeds one logistic output: the probability of label 1.
Few distinct maxima in a chunk tell repetition, high ones tell junk patterns.

The network is fitted on the driver on a bounded sample of labelled rows, ``SAMPLE`` a class at most, on all chunks
of their whole texts; scoring runs on whole texts in Arrow batches and shuffles nothing.

Defined results: null and empty texts are scored as one empty chunk; without labelled rows of both
classes the score is the share of label 1 among them (0.5 without any); labels that contradict
each other count as the lower; repeated rows score alike; other columns pass through.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from foliate.llm.common import as_text, table

CHUNK, OVERLAP = 512, 64
#: Embedding size, bytes a filter spans, its step, filters and hidden units.
DIM, WIDTH, STEP, FILTERS, HIDDEN = 8, 8, 4, 32, 16
#: Bound of the training sample: labelled rows a class.
SAMPLE = 1600
#: Passes over the sample, and the least number of steps, which small samples reach by more passes.
EPOCHS, STEPS, BATCH, RATE, SEED = 12, 320, 64, 0.004, 7
KEEP = 0.3
#: Bytes of text that are scored at a time.
GROUP = 1 << 18


def chunk_starts(n: int) -> list[int]:
    """Starts of the chunks of n bytes: overlapping, the last one ends with the text."""
    if n <= CHUNK:
        return [0]
    return [*range(0, n - CHUNK, CHUNK - OVERLAP), n - CHUNK]


def chunks_of(data: bytes, starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks as rows of bytes, padded by zeros, and their lengths."""
    room = np.zeros(max(len(data), CHUNK), np.uint8)
    room[: len(data)] = np.frombuffer(data, np.uint8)
    return room[np.array(starts)[:, None] + np.arange(CHUNK)], np.full(len(starts), min(len(data), CHUNK))


class Network:
    """Parameters by name, and the passes through them."""

    def __init__(self, seed: int = SEED) -> None:
        draw = np.random.default_rng(seed)
        self.constant: float | None = None
        self.p = {
            "embed": draw.normal(0, 1, (256, DIM)).astype(np.float32),
            "filters": draw.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "hidden": draw.normal(0, (FILTERS + 2) ** -0.5, (FILTERS + 2, HIDDEN)).astype(np.float32),
            "hidden_bias": np.full(HIDDEN, 0.1, np.float32),
            "out": draw.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }

    def features(self, chunks: np.ndarray, lengths: np.ndarray, where: bool = False):
        """Each filter's maximum in each chunk, with the length; and the positions of the maxima."""
        half = STEP * DIM
        blocks = self.p["embed"][chunks].reshape(len(chunks), CHUNK // STEP, half)
        size = WIDTH // STEP
        n = CHUNK // STEP - size + 1
        filters = self.p["filters"]
        out = reduce(np.add, ((blocks @ filters[i * half : (i + 1) * half])[:, i : i + n] for i in range(size)))
        for k in np.flatnonzero(lengths < CHUNK):
            out[k, max(1, (int(lengths[k]) - WIDTH) // STEP + 1) :] = -np.inf
        at = out.argmax(axis=1) if where else None
        top = np.maximum(out.max(axis=1) + self.p["bias"], 0)
        share = lengths[:, None].astype(np.float32) / CHUNK
        return np.concatenate((top, share, np.log1p(share * CHUNK) / np.float32(6)), axis=1), at

    def scores(self, chunks: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of label 1 of the texts whose chunks begin at rows ``first``."""
        hidden = np.maximum(self.features(chunks, lengths)[0] @ self.p["hidden"] + self.p["hidden_bias"], 0)
        z = np.maximum.reduceat(hidden, first, axis=0).astype(np.float64) @ self.p["out"] + self.p["out_bias"]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def gradients(self, chunks: np.ndarray, lengths: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss: they reach the positions that gave the maxima alone."""
        p = self.p
        feats, at = self.features(chunks, lengths, where=True)
        pre = feats @ p["hidden"] + p["hidden_bias"]
        hidden = np.maximum(pre, 0)
        bounds = [*first.tolist(), len(chunks)]
        winner = np.array([a + hidden[a:b].argmax(axis=0) for a, b in zip(bounds, bounds[1:])])
        pooled = np.take_along_axis(hidden, winner, axis=0)
        z = pooled @ p["out"] + p["out_bias"]
        dz = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels) / len(labels)
        dpre = np.zeros_like(pre)
        np.add.at(dpre, (winner, np.arange(HIDDEN)), dz[:, None] * p["out"] * (pooled > 0))
        dtop = (dpre @ p["hidden"].T)[:, :FILTERS] * (feats[:, :FILTERS] > 0)
        rows = at[:, :, None] * STEP + np.arange(WIDTH)
        seen = chunks[np.arange(len(chunks))[:, None, None], rows]
        windows = p["embed"][seen].reshape(len(chunks), FILTERS, WIDTH * DIM)
        dembed = np.zeros_like(p["embed"])
        np.add.at(dembed, seen, (dtop[:, :, None] * p["filters"].T).reshape(*seen.shape, DIM))
        return {"out": pooled.T @ dz, "out_bias": dz.sum(keepdims=True), "hidden": feats.T @ dpre, "hidden_bias": dpre.sum(axis=0), "filters": np.einsum("cf,cfw->wf", dtop, windows), "bias": dtop.sum(axis=0), "embed": dembed}


def train(texts: list[str], labels: list[int], seed: int = SEED) -> Network:
    """Adam on the mean log loss; rows come in a fixed order, so the same sample gives the same network."""
    net = Network(seed)
    if len(set(labels)) < 2:
        net.constant = float(np.mean(labels)) if labels else 0.5
        return net
    examples = []
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        examples.append(chunks_of(data, chunk_starts(len(data))))
    targets = np.array(labels, np.float32)
    draw = np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(examples)))
    for epoch in range(epochs):
        order = draw.permutation(len(examples))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            lengths = np.concatenate([examples[k][1] for k in own])
            counts = [len(examples[k][1]) for k in own]
            found = net.gradients(np.concatenate([examples[k][0] for k in own]), lengths, np.cumsum(counts) - counts, targets[own])
            step += 1
            rate = RATE * min(1.0, 2.0 * (1 - epoch / epochs)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for k, g in found.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                net.p[k] -= (rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
    return net


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Network:
    """A network fitted to ``sample`` labelled rows of each class at most, none of them held out.

    The sample is drawn by a hash of the id, and of the rows of one id the one with the least hash of its text counts (chosen in the
    tasks), so it is the same for any layout of the table and the driver gets a row an id.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label")).where(~held_out(F.col("_id")))
    picked = [known.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(sample) for k in (0, 1)]
    rows = docs.select(F.col(id_col).alias("_id"), as_text(F.col(text_col)).alias("_text")).join(F.broadcast(picked[0].unionByName(picked[1])), "_id")
    one = rows.groupBy("_id").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), F.octet_length("_text"))).alias("_text"), F.min("_label").alias("_label"))
    got = sorted({r["_id"]: (r["_text"], r["_label"]) for r in one.collect()}.items(), key=lambda x: (zlib.crc32(str(x[0]).encode()), x[0]))
    net = train([t for _, (t, _) in got], [k for _, (_, k) in got])
    if net.constant is None:
        # The sample holds the classes evenly; the shares of all labelled rows correct the odds.
        all_, used = dict(known.groupBy("_label").count().collect()), Counter(k for _, (_, k) in got)
        net.p["out_bias"] += np.float32(np.log(all_[1] / used[1] * used[0] / all_[0]))
    return net


def score_texts(net: Network, texts: list[str]) -> np.ndarray:
    """Scores of whole texts, a group of some bytes at a time."""
    if net.constant is not None:
        return np.full(len(texts), net.constant)
    out: list[np.ndarray] = []
    rows, lengths, first, n, size = [], [], [], 0, 0

    def flush():
        nonlocal rows, lengths, first, n, size
        if first:
            out.append(net.scores(np.concatenate(rows), np.concatenate(lengths), np.array(first)))
        rows, lengths, first, n, size = [], [], [], 0, 0

    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        starts = chunk_starts(len(data))
        if size + len(starts) * CHUNK > 2 * GROUP and len(starts) * CHUNK > GROUP:
            flush()
            out.append(_long(net, data, starts))
            continue
        chunks, own = chunks_of(data, starts)
        rows.append(chunks)
        lengths.append(own)
        first.append(n)
        n, size = n + len(starts), size + chunks.size
        if size >= GROUP:
            flush()
    flush()
    return np.concatenate(out) if out else np.zeros(0)


def _long(net: Network, data: bytes, starts: list[int]) -> np.ndarray:
    """The score of one very long text: the maxima of its groups of chunks are maxima of the whole."""
    p, step, pooled = net.p, GROUP // CHUNK, None
    for i in range(0, len(starts), step):
        feats, _ = net.features(*chunks_of(data, starts[i : i + step]))
        top = np.maximum(feats @ p["hidden"] + p["hidden_bias"], 0).max(axis=0)
        pooled = top if pooled is None else np.maximum(pooled, top)
    z = pooled.astype(np.float64) @ p["out"] + p["out_bias"]
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def scored(docs: DataFrame, net: Network, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` (but for one named ``score_col``) and the score of the whole text."""
    docs = docs.select(*[c for c in docs.columns if c != score_col])
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_texts(model.value, texts), pa.float64())], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def op6_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, net, "text", "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
