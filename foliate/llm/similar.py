"""Links of texts whose 5-word shingles are similar to ``SIMILAR`` or more, each verified on the whole shingle sets.

Candidates share one of ``BANDS`` keys of ``ROWS`` minima of hashes (MinHash). A key is shared by texts with
shingles in common only, so buckets don't fill as the input grows, and the share of pairs found depends on their
similarity alone: 1 - (1 - s^ROWS)^BANDS, 0.998 at 0.8.

First every bucket links to its least member; then the members of each bucket that are still in different
components are compared with each other. Members of buckets over ``BUCKET`` go to an exact way instead (``crowd_links``),
which finds each link among them whatever the keys are: two sets that are similar to 0.8 share a
shingle among the rarest fifth of either, so only texts with a rare shingle in common are compared, first
with some of them (``CENTRES``), then, in blocks, the members outside a shingle's largest component with all. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import durable, split_join
from foliate.llm.components import components

SIMILAR = 0.8
BANDS, ROWS = 20, 6
BUCKET = 32
#: So many members of a shingle are compared with all others first.
CENTRES = 4
_DRAW = np.random.default_rng(42)
_XOR = _DRAW.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None]
_ODD = _DRAW.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] << np.uint64(1) | np.uint64(1)
_MIX = _DRAW.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) << np.uint64(1) | np.uint64(1)


def keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a text, from the hashes of its shingles; none for a text without any."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[None, i : i + 1024] ^ _XOR) * _ODD).min(axis=1))
    mixed = ((least.reshape(BANDS, ROWS) ^ (least.reshape(BANDS, ROWS) >> np.uint64(31))) * _MIX).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """The distinct shingles of a text, as 32 bits of their hashes."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32)).view(np.int32)


def verified(pairs: DataFrame, sets: DataFrame, least: float = SIMILAR) -> DataFrame:
    """u, v: the pairs (u, v) whose shingle sets (node, shingles) have at least that share of their union in common."""
    pairs = durable(pairs)
    whole = lambda end: sets.select(F.col("node").alias(end), F.col("shingles").alias(f"_{end}"))
    both = split_join(pairs, whole("v"), ["v"], "u").join(whole("u"), "u")
    shared = F.size(F.array_intersect("_u", "_v"))
    # The size of the smaller set bounds what they share: most other pairs need no look at the sets.
    may = F.least(F.size("_u"), F.size("_v")) >= least * F.greatest(F.size("_u"), F.size("_v"))
    return both.where(may).where(shared >= least * (F.size("_u") + F.size("_v") - shared)).select("u", "v")


def _all_pairs(members: DataFrame, key: list[str]) -> DataFrame:
    """u, v: pairs of a bucket's members (node, root) in different components."""
    all_ = members.groupBy(*key).agg(F.collect_list(F.struct("node", "root")).alias("all"))
    others = F.filter("all", lambda x: (x["node"] < F.col("a.node")) & (x["root"] != F.col("a.root")))
    return all_.select("all", F.explode("all").alias("a")).select(F.col("a.node").alias("u"), F.explode(others).alias("b")).select("u", F.col("b.node").alias("v"))


def _counted(members: DataFrame, key: list[str]) -> DataFrame:
    """Members of the buckets with more than one component, and the size of their bucket."""
    sizes = members.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").drop("low", "high")
    return split_join(members, sizes, key, "node")


def _rooted(members: DataFrame, stars: DataFrame) -> DataFrame:
    """``members`` with the root of their node's component, by links (u, v) from each node to its root."""
    roots = stars.select(F.col("u").alias("_node"), F.col("v").alias("root"))
    return members.join(roots, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node")).drop("_node")


def _stars(links: DataFrame) -> DataFrame:
    """u, v: links from each node to the root of its component; they stand for all ``links``, and more can be added."""
    return durable(components(links).where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))


def _reaches(size: Column, pos: Column, other: Column, other_pos: Column | int = 0, least: float = SIMILAR) -> Column:
    """Whether sets of these sizes can be similar if the first shingle that they share is at these positions, from 0, rarest first.

    What follows that shingle bounds what they share; for a similar pair it holds at its first shared shingle.
    """
    shared = F.least(size - pos, other - other_pos)
    return shared * (1 + least) >= (size + other) * least - 1e-6


def crowd_links(sets: DataFrame, known: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """u, v: links that, with the ``known`` ones, connect exactly the similar sets (node, shingles)."""
    tokens = durable(sets.select("node", F.explode("shingles").alias("shingle")))
    counts = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("held"))
    ordered = split_join(tokens, counts, ["shingle"], "node").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("all"))
    n = F.size("all")
    # A shingle that no other text holds makes no pair, but keeps its position.
    rare = F.filter(F.transform(F.slice("all", F.lit(1), (n - F.ceil(F.lit(SIMILAR) * n) + 1).cast("int")), lambda x, i: F.struct(i.alias("pos"), x["shingle"].alias("shingle"), x["held"].alias("held"))), lambda x: x["held"] > 1)
    members = durable(ordered.select("node", n.alias("size"), F.explode(rare).alias("s")).select("node", "size", "s.pos", "s.shingle"))
    # The same texts are the centres of most shingles that they hold, as one hash chooses them everywhere.
    centre = lambda k: F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("draw"), "node", "size", "pos"))
    centres = members.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("smallest"), F.array_distinct(F.array(*[centre(k) for k in range(CENTRES)])).alias("centres")).where("n > 1").drop("n")
    members = split_join(members, centres, ["shingle"], "node")
    # Members that no size there is in their shingle can be similar to are of no use in it.
    smallest = F.greatest(F.col("smallest"), F.ceil(F.lit(SIMILAR) * F.col("size") - 1e-6))
    members = durable(members.where(_reaches(F.col("size"), F.col("pos"), smallest)).drop("smallest"))
    near = F.filter("centres", lambda c: (c["node"] != F.col("node")) & _reaches(F.col("size"), F.col("pos"), c["size"], c["pos"]))
    pairs = members.select("node", F.explode(near).alias("c")).select(F.least("node", "c.node").alias("u"), F.greatest("node", "c.node").alias("v")).distinct()
    first = verified(pairs, sets)
    stars = _stars(first.unionByName(known))
    across = _pairs_across(durable(_rooted(members.drop("centres"), stars)), bucket, SIMILAR)
    return stars.unionByName(verified(across, sets))


def _pairs_across(members: DataFrame, bucket: int, least: float | None = None) -> DataFrame:
    """u, v: pairs of members (shingle, node, root) with one shingle in different components, made in blocks of ``bucket`` or so.

    The largest component of a shingle needs no pairs of its own: each member of the others (``minor``) meets all
    members. Members are dealt to blocks by a hash, and every block of all meets every block of the minor once.

    With ``least``, members also have the size of their set and the position, from 0, of the shingle in it, rarest first.
    A pair that can't be similar if this shingle is the first that it shares (``_reaches``) is left out here.
    """
    roots = members.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = roots.groupBy("shingle").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("large")).where(F.col("n") > F.col("large.n"))
    sizes = sizes.select("shingle", F.col("large.root").alias("large"), F.ceil(F.col("n") / bucket).cast("int").alias("all_blocks"), F.ceil((F.col("n") - F.col("large.n")) / bucket).cast("int").alias("minor_blocks"))
    rest = durable(split_join(members, sizes, ["shingle"], "node").withColumn("minor", F.col("root") != F.col("large")))
    own = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    member = F.struct("node", "root", "minor", *["size", "pos"] * (least is not None))
    any_ = rest.select("shingle", own("all_blocks").alias("i"), every("minor_blocks").alias("j"), member.alias("a"), F.lit(None).cast(rest.select(member).schema[0].dataType).alias("b"))
    minor = rest.where("minor").select("shingle", own("minor_blocks").alias("j"), every("all_blocks").alias("i"), member.alias("b"), F.lit(None).cast(rest.select(member).schema[0].dataType).alias("a"))
    met = any_.unionByName(minor).groupBy("shingle", "i", "j").agg(F.collect_list("a").alias("as"), F.collect_list("b").alias("bs"))
    # Two minor members meet from either side; one of these is enough.
    def may(x: Column) -> Column:
        across = (x["root"] != F.col("b.root")) & (~x["minor"] | (x["node"] < F.col("b.node")))
        if least is None:
            return across
        return across & _reaches(x["size"], x["pos"], F.col("b.size"), F.col("b.pos"), least)

    others = F.filter("as", may)
    pairs = met.select("as", F.explode("bs").alias("b")).select(F.col("b.node").alias("u"), F.explode(others).alias("a")).select("u", F.col("a.node").alias("v"))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def similar_links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], known: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """u, v: links that connect similar texts, the ``known`` links among them (as such, or by others that connect the same).

    ``nodes`` has node and keys, one row a node; ``sets_of`` gives the sets (node, shingles) of some nodes (node):
    only those of candidates move.
    """
    keyed = durable(nodes.select("node", F.explode("keys").alias("key")))
    stars = keyed.groupBy("key").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = durable(split_join(keyed, stars, ["key"], "node"))
    held = durable(sets_of(members.select("node").distinct()))
    first = verified(members.where("node <> v").select(F.col("node").alias("u"), "v").distinct(), held)
    stars = _stars(first.unionByName(known))
    members = durable(_counted(durable(_rooted(members.drop("v"), stars)), ["key"]))
    few = _all_pairs(members.where(F.col("n") <= bucket), ["key"]).distinct()
    found = durable(stars.unionByName(verified(few, held)))
    crowd = members.where(F.col("n") > bucket).select("node").distinct()
    if crowd.isEmpty():
        return found
    return crowd_links(durable(held.join(crowd, "node", "left_semi")), found, bucket)
