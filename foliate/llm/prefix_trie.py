"""The trie of conversations that begin alike.

A node is a distinct sequence of first turns; its owner is the smallest conversation that begins with it, so a node is
named by its owner and its depth. Whoever owns a node owns all deeper ones on its way, so what a
conversation owns is one chain, and its first owned depth is found by binary search: in each round all
conversations probe one depth in a join with the minima of the prefix digests. Where the depth before the chain
ends, the chain hangs on the node of another owner: the chains form a tree, many times smaller than the trie. Totals of
chains go up that tree by pointer doubling, in rounds that grow with the logarithm of its height; running totals
along each chain, from its end, then give every node's.

Digests of prefixes are running sums of the digests of (depth, turn), so a conversation of any length is numbered and
summed by many tasks (``running``). Texts are never shuffled, only their digests and lengths are. The ids of the
conversations that end at a node are joined in order in blocks by many tasks; only the last step, a SHA-256, which has no
parallel form, passes a node's blocks through one task as a stream.

Defined results: rows without a conversation id are left out; null roles and texts are empty; equal turn numbers are
ordered by a digest of role and text, and repeated rows all count; other columns are ignored; no conversations, no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.common import FEW, as_text, durable, split_join, table, written
from foliate.operators.running import running

#: Conversation ids with the same quotient by this have one base; prefixes taken from it have fewer turns than ``TAKEN``.
GROUP, TAKEN = 100, 6
#: Bytes of joined ids in one block.
BLOCK = 1 << 20


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), content (a digest of role and text), chars of every turn with a conversation."""
    role, text = as_text(F.col("role")), as_text(F.col("text"))
    content = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", content.alias("content"), F.length(text).cast("long").alias("chars"))
    return running(rows, ["conv_id"], ["turn", "content"], "pos").drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, content, chars) that begin with the first ones of the group's base, and conversations (conv_id, n).

    The first h = crc32(id) % 6 turns come from conversation id - id % 100 (all if it has fewer, none if there is none);
    the conversation's own come after its first h.
    """
    sizes = durable(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")))
    base = (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")
    convs = sizes.select("conv_id", "own", base, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % TAKEN).alias("h"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left")
    convs = durable(convs.select("conv_id", "base", "own", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken")))
    # At most GROUP conversations take TAKEN - 1 rows of a base each.
    heads = turns.where(F.col("pos") < TAKEN).withColumnRenamed("conv_id", "base")
    begin = convs.where("taken > 0").select("conv_id", "base", "taken").join(heads, "base").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "content", "chars")
    rest = split_join(turns, convs.select("conv_id", "h", "taken"), ["conv_id"], "pos").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "content", "chars")
    return begin.unionByName(rest), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest, chars: every turn with the digest of all turns up to it."""
    each = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), "content"), 256)
    parts = [F.conv(F.substring("each", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"e{i}") for i in range(4)]
    rows = turns.withColumn("each", each).select("conv_id", "depth", "chars", *parts)
    summed = running(rows, ["conv_id"], ["depth"], "rank", {f"e{i}": f"s{i}" for i in range(4)})
    digest = F.unhex(F.md5(F.concat_ws(",", *(F.col(f"s{i}").cast("string") for i in range(4))).cast("binary")))
    return written(summed.select("conv_id", "depth", digest.alias("digest"), "chars"), "prefixes")


def _owners(probes: DataFrame, prefixes: DataFrame, shared: DataFrame, few: tuple[bool, bool]) -> DataFrame:
    """``probes`` (conv_id, depth and others) with the owner of the node there; few: whether probes and shared nodes may be broadcast."""
    held = prefixes.select("conv_id", "depth", "digest")
    at = held.join(F.broadcast(probes) if few[0] else probes, ["conv_id", "depth"])
    met = at.join(F.broadcast(shared), ["depth", "digest"], "left") if few[1] else split_join(durable(at), shared, ["depth", "digest"], "conv_id", "left")
    return met.withColumn("owner", F.coalesce("owner", "conv_id")).drop("digest")


def _chains(prefixes: DataFrame, nodes: DataFrame, convs: DataFrame, n: int, longest: int, root: int) -> DataFrame:
    """conv_id, n, first (its first owned depth; n + 1: none), up (the owner of the node above that; null for the root's chain)."""
    shared = durable(nodes.where("n_convs > 1").select("depth", "digest", F.col("conv_id").alias("owner")))
    few = n <= FEW, shared.count() <= FEW
    state = convs.select("conv_id", "n", F.lit(1).cast("long").alias("lo"), (F.col("n") + 1).alias("hi"))
    for _ in range(longest.bit_length()):
        probes = state.where("lo < hi").select("conv_id", F.expr("(lo + hi) div 2").alias("depth"), "n", "lo", "hi")
        owned = F.col("owner") == F.col("conv_id")
        found = _owners(probes, prefixes, shared, few).select("conv_id", "n", F.when(owned, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(owned, F.col("depth")).otherwise(F.col("hi")).alias("hi"))
        state = durable(found.unionByName(state.where("lo >= hi")))
    above = _owners(state.where("lo > 1").select("conv_id", (F.col("lo") - 1).alias("depth"), "n", F.col("lo").alias("first")), prefixes, shared, few)
    up = F.when(F.col("conv_id") != root, F.lit(root)).cast("long")
    first = F.when(F.col("conv_id") == root, F.lit(0)).otherwise(F.lit(1)).cast("long")
    top = state.where("lo = 1").select("conv_id", "n", first.alias("first"), up.alias("up"))
    return durable(above.select("conv_id", "n", "first", F.col("owner").alias("up")).unionByName(top))


def _totals(chains: DataFrame, own: DataFrame) -> DataFrame:
    """conv_id, leaves, saved of each chain with all that hang on it: sums go up 1, 2, 4, ... chains a round."""
    # Parquet, not a checkpoint: that keeps its plan's estimates of size, which a self-join a round makes ever longer.
    state = written(chains.select("conv_id", "up").join(own, "conv_id"), "totals")
    while not state.where("up IS NOT NULL").isEmpty():
        below = state.where("up IS NOT NULL").groupBy("up").agg(F.sum("leaves").alias("more"), F.sum("saved").alias("kept")).withColumnRenamed("up", "conv_id")
        higher = split_join(state.where("up IS NOT NULL"), state.select(F.col("conv_id").alias("up"), F.col("up").alias("next")), ["up"], "conv_id").select("conv_id", F.col("next").alias("up"), "leaves", "saved")
        moved = higher.unionByName(state.where("up IS NULL").select("conv_id", "up", "leaves", "saved"))
        state = written(moved.join(below, "conv_id", "left").select("conv_id", "up", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("kept", F.lit(0))).alias("saved")), "totals")
    return state.select("conv_id", "leaves", "saved")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, depth, first, ids: ids of one node, joined, in blocks."""
    node, first, held, size = None, None, [], 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*node, first)), pa.array([",".join(held)])], ["conv_id", "depth", "first", "ids"])

    for batch in batches:
        for conv, depth, i in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (node != (conv, depth) or size >= BLOCK):
                yield block()
                held, size = [], 0
            if not held:
                node, first = (conv, depth), i
            held.append(str(i))
            size += len(held[-1]) + 1
    if held:
        yield block()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, depth, ends_sha256 from the blocks of each node in order."""
    node, state = None, None
    for batch in batches:
        out = []
        for conv, depth, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
            if node == (conv, depth):
                state.update(b",")
            else:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (conv, depth), hashlib.sha256()
            state.update(ids.encode())
        yield _hashes(out)
    if node:
        yield _hashes([(*node, state.hexdigest())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256: SHA-256 of each node's ids (column id), ascending, joined by commas."""
    ordered = ends.repartitionByRange("conv_id", "depth", "id").sortWithinPartitions("conv_id", "depth", "id").select("conv_id", "depth", "id")
    blocks = ordered.mapInArrow(_blocks, "conv_id long, depth long, first long, ids string")
    return blocks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(_hashed, "conv_id long, depth long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row a node: conv_id (its owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, depth (1, 2, ... of each conversation), content (a digest) and chars; ``convs`` has conv_id and n, its number of turns.
    """
    convs = durable(convs)
    size = convs.agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("longest"), F.min("conv_id").alias("root")).first()
    root = -1 if size["root"] is None else size["root"]
    prefixes = _prefixes(turns)
    nodes = written(prefixes.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars")), "nodes")
    chains = _chains(prefixes, nodes, convs, size["n"], size["longest"] or 0, root)
    owning = chains.where(F.col("first") <= F.col("n"))
    hung = owning.where("up IS NOT NULL")

    # What hangs on a node, and the ends of chains without anything there: leaves. The root's chain may have no turn.
    last = F.col("n").alias("depth")
    joints = hung.groupBy(F.col("up").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("hanging"))
    leaf = owning.select("conv_id", last).join(joints, ["conv_id", "depth"], "left").select("conv_id", F.when(F.col("hanging").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    saved = nodes.groupBy("conv_id").agg(F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    own = leaf.join(saved, "conv_id", "left").select("conv_id", "leaves", F.coalesce("saved", F.lit(0).cast("long")).alias("saved"))
    own = durable(own)
    totals = _totals(owning, own)

    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    marks = hung.join(totals, "conv_id").select(F.col("up").alias("conv_id"), (F.col("first") - 1).alias("depth"), F.lit(1).cast("long").alias("hanging"), "leaves", "saved", none.alias("up"), zero.alias("last"))
    marks = marks.unionByName(hung.select("conv_id", F.col("first").alias("depth"), zero.alias("hanging"), zero.alias("leaves"), zero.alias("saved"), "up", zero.alias("last")))
    marks = marks.unionByName(owning.select("conv_id", last, zero.alias("hanging"), zero.alias("leaves"), zero.alias("saved"), none.alias("up"), F.lit(1).cast("long").alias("last")))
    marks = marks.groupBy("conv_id", "depth").agg(*(F.sum(c).alias(c) for c in ("hanging", "leaves", "saved")), F.max("up").alias("up"), F.max("last").alias("last"))
    top = convs.where(F.col("conv_id") == root).select("conv_id", zero.alias("depth"), F.lit(size["n"]).cast("long").alias("n_convs"), zero.alias("chars"))
    all_ = nodes.select("conv_id", "depth", "n_convs", "chars").unionByName(top).join(marks, ["conv_id", "depth"], "left")
    count = lambda c: F.coalesce(c, zero)
    end = count("last") == 1
    rows = all_.select(
        "conv_id", (-F.col("depth")).alias("back"), F.when(F.col("depth") > 0, F.coalesce("up", "conv_id")).alias("parent_conv_id"), "n_convs",
        (count("hanging") + F.when(end, zero).otherwise(F.lit(1))).alias("n_children"),
        (count("leaves") + F.when(end & (count("hanging") == 0), F.lit(1)).otherwise(zero)).alias("leaves"), (count("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    summed = running(rows, ["conv_id"], ["back"], "rank", {"leaves": "n_leaves", "saved": "saved_tokens"})
    owner = F.when((F.col("first") <= F.col("n")), F.col("conv_id")).otherwise(F.col("up"))
    ends = end_hashes(chains.select(owner.alias("conv_id"), last, F.col("conv_id").alias("id")))
    out = summed.withColumn("depth", -F.col("back")).join(ends, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all rebuilt conversations."""
    return trie(*rebuilt(numbered(table(spark, sf_dir, "conversations"))))


_STEP = "xor(c >> 1, 3988292384 * (c & 1))"
_CRC = f"xor(list_reduce(list_transform(range(length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, (i + 1)::INT, 1))::BIGINT), lambda a, b: list_reduce(range(8), lambda c, k: {_STEP}, xor(a, b)), 4294967295::BIGINT), 4294967295)"

ORACLE_SQL = f"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM o GROUP BY conv_id),
k AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.own, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT k.conv_id, pos AS depth, role, text FROM k JOIN o ON o.conv_id = k.base AND pos <= taken UNION ALL SELECT k.conv_id, pos - h + taken, role, text FROM k JOIN o USING (conv_id) WHERE pos > h),
p AS (SELECT conv_id, depth, length(text) AS chars, md5(string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS prefix FROM r
    UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM p GROUP BY depth, prefix),
m AS (SELECT p.conv_id AS member, p.depth, n.conv_id, n_convs, n.chars, max(p.depth) OVER (PARTITION BY p.conv_id) AS longest FROM p JOIN n USING (depth, prefix)),
u AS (SELECT c.conv_id, c.depth, a.conv_id AS parent_conv_id, c.n_convs, c.chars FROM m c LEFT JOIN m a ON a.member = c.member AND a.depth = c.depth - 1 WHERE c.member = c.conv_id),
d AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL),
s AS (SELECT a.conv_id, a.depth, count(*) FILTER (d.n_children IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.chars) AS saved FROM u JOIN m a ON a.member = u.conv_id AND a.depth <= u.depth LEFT JOIN d ON d.conv_id = u.conv_id AND d.depth = u.depth GROUP BY ALL),
e AS (SELECT conv_id, depth, string_agg(member::VARCHAR, ',' ORDER BY member) AS ids FROM m WHERE depth = longest GROUP BY ALL)
SELECT u.conv_id, u.depth, u.parent_conv_id, u.n_convs, coalesce(d.n_children, 0) AS n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM u JOIN s ON s.conv_id = u.conv_id AND s.depth = u.depth LEFT JOIN d ON d.conv_id = u.conv_id AND d.depth = u.depth LEFT JOIN e ON e.conv_id = u.conv_id AND e.depth = u.depth"""
