"""Trees given as parent links, walked depth first in rounds that grow with the logarithm of their depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.operators.running import running
from foliate.sources.shared import stored


def _climbed(state: DataFrame, columns: list[str]) -> DataFrame:
    """Each node's pointer moved to where its pointer's pointer goes; ``columns`` of what it passes are added, ``top`` is the last node reached."""
    higher = state.select("doc_id", F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"), *[F.col(c).alias(f"_{c}") for c in columns])
    moved = state.where("up IS NOT NULL").join(higher, ["doc_id", "up"])
    added = [(F.col(c) + F.col(f"_{c}")).alias(c) for c in columns]
    return moved.select("doc_id", "node_id", F.col("_up").alias("up"), F.col("_top").alias("top"), *added).unionByName(state.where("up IS NULL"))


def flatten_nodes(nodes: DataFrame, root: str = "body") -> DataFrame:
    """doc_id, node_id, ord (from 0 in each document), path (ord as padded text) of the leaves below ``root`` in depth-first order.

    ``nodes`` has doc_id, node_id, parent_id, child_idx; siblings go by child_idx, then node_id. Two passes of pointer doubling over the inner
    nodes: sums of the leaves below each, which tell how many leaves stand before it among its siblings, and sums of these up to the root. A tree of
    depth d takes twice log2(d) joins of inner nodes, and a node one row of fixed size; leaves only count for their parents, then look up where
    these begin. Nodes that the root does not reach are left out. A node that is there twice, or a circle, is an error.
    """
    own = nodes.select("doc_id", "node_id", F.when(F.col("node_id") != root, F.col("parent_id")).alias("parent_id"), F.col("child_idx").cast("long").alias("child_idx"), F.lit(1).alias("n"))
    none = lambda kind: F.lit(None).cast(kind)
    named = own.where("parent_id IS NOT NULL").select("doc_id", F.col("parent_id").alias("node_id"), none(own.schema["parent_id"].dataType), none("long"), F.lit(0)).toDF(*own.columns)
    # A node and the calls of it as a parent meet once, which tells nodes from leaves; a parent that is not there is no row.
    each = own.unionByName(named.distinct()).groupBy("doc_id", "node_id").agg(F.sum("n").alias("n"), F.min(F.when(F.col("n") == 1, F.struct("parent_id", "child_idx"))).alias("r"), F.min("n").alias("low")).where("n > 0")
    each = stored(each.select("doc_id", "node_id", "n", F.col("r.parent_id").alias("up"), F.col("r.child_idx").alias("child_idx"), (F.col("low") == 0).alias("inner")), "tree")
    size = each.agg(F.count_if("inner").alias("n"), F.max("n").alias("most")).first()
    if (size["most"] or 0) > 1:
        raise ValueError("the nodes hold a circle, or a node twice")
    leaves, inner = each.where("NOT inner").drop("n"), each.where("inner").drop("n")
    counts = leaves.where("up IS NOT NULL").groupBy("doc_id", "up").agg(F.count(F.lit(1)).alias("leaves")).withColumnRenamed("up", "node_id")
    # A parent that is not there ends the way; it is not the root, so its nodes are left out in the end.
    there = inner.select("doc_id", F.col("node_id").alias("up"), F.lit(True).alias("_there"))
    linked = inner.join(there, ["doc_id", "up"], "left").join(counts, ["doc_id", "node_id"], "left")
    linked = stored(linked.select("doc_id", "node_id", F.when(F.col("_there"), F.col("up")).alias("up"), "child_idx", F.coalesce("leaves", F.lit(0)).cast("long").alias("leaves")), "tree")

    state = linked.select("doc_id", "node_id", "up", F.col("node_id").alias("top"), "leaves")
    for _ in range(size["n"].bit_length() + 1):
        if state.where("up IS NOT NULL").isEmpty():
            break
        below = state.where("up IS NOT NULL").groupBy("doc_id", "up").agg(F.sum("leaves").alias("_more")).withColumnRenamed("up", "node_id")
        moved = _climbed(state.drop("leaves"), [])
        totals = state.select("doc_id", "node_id", "leaves").join(below, ["doc_id", "node_id"], "left").select("doc_id", "node_id", (F.col("leaves") + F.coalesce("_more", F.lit(0))).alias("leaves"))
        state = stored(moved.join(totals, ["doc_id", "node_id"]), "tree")
    else:
        raise ValueError("the nodes hold a circle, or a node twice")

    sized = linked.drop("leaves").join(state.select("doc_id", "node_id", "leaves"), ["doc_id", "node_id"]).withColumn("inner", F.lit(True))
    siblings = sized.unionByName(leaves.where("up IS NOT NULL").withColumn("leaves", F.lit(1).cast("long")))
    ranked = running(siblings, ["doc_id", "up"], ["child_idx", "node_id"], "_n", {"leaves": "_upto"})
    before = F.when(F.col("up").isNull(), F.lit(0)).otherwise(F.col("_upto") - F.col("leaves")).cast("long").alias("before")
    walk = stored(ranked.where("inner").select("doc_id", "node_id", "up", F.col("node_id").alias("top"), before), "tree")
    while not walk.where("up IS NOT NULL").isEmpty():
        walk = stored(_climbed(walk, ["before"]), "tree")
    begins = walk.where(F.col("top") == root).select("doc_id", F.col("node_id").alias("up"), F.col("before").alias("_begin"))
    ends = ranked.where("NOT inner").select("doc_id", "node_id", "up", before).join(begins, ["doc_id", "up"]).select("doc_id", "node_id", (F.col("before") + F.col("_begin")).alias("before"))
    ends = ends.unionByName(leaves.where(F.col("node_id") == root).select("doc_id", "node_id", F.lit(0).cast("long").alias("before")))
    return ends.select("doc_id", "node_id", F.col("before").alias("ord"), F.lpad(F.col("before").cast("string"), 19, "0").alias("path"))
