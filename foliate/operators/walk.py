"""Walks over a graph: the nodes within some hops of each query's start, up to a number of nodes in a defined order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliate.sources.shared import stored

#: Nodes that a walk finds, at most.
MOST = 1000
#: Edges of a node in one part; a hub has many parts.
PART = 100_000


def neighbourhood(starts: DataFrame, edges: DataFrame, hops: int = 2, most: int = MOST, both_ways: bool = True) -> DataFrame:
    """query_id, node, hop of the nodes that each query reaches: by hop, then node, ``most`` at most; its starts are hop 0.

    ``starts`` has query_id and node, ``edges`` src and tgt. Nodes are taken hop by hop; once a query has its ``most`` it stops. A frontier
    holds ``most`` nodes a query at most, so a hop's join is of that many rows with the edges. Hubs are split: the edges of a node are dealt to parts
    of about ``PART`` and the frontier's rows of a hub go to each of them; of what a part finds for a query only its first ``most`` are kept before they
    are brought together. Repeated edges, edges to a node itself and null ends add nothing.
    """
    links = edges.select(F.col("src").alias("node"), F.col("tgt").alias("next"))
    if both_ways:
        links = links.unionByName(edges.select(F.col("tgt").alias("node"), F.col("src").alias("next")))
    links = links.where("node IS NOT NULL AND next IS NOT NULL AND node <> next")
    hubs = stored(links.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > PART).select("node", F.ceil(F.col("_n") / PART).cast("int").alias("_parts")), "hubs")
    small = hubs.count() <= PART
    hubs = F.broadcast(hubs) if small else hubs
    part = F.pmod(F.xxhash64("next"), F.coalesce("_parts", F.lit(1))).cast("int").alias("_part")
    dealt = links.join(hubs, "node", "left").select("node", "next", part)

    order = Window.partitionBy("query_id").orderBy("node")
    first = starts.select("query_id", "node").where("query_id IS NOT NULL AND node IS NOT NULL").distinct()
    found = first.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).select("query_id", "node", F.lit(0).alias("hop"))
    found = stored(found, "walk")
    for hop in range(1, hops + 1):
        counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("_have"))
        frontier = found.where(F.col("hop") == hop - 1).join(counts.where(F.col("_have") < most), "query_id").select("query_id", "node", "_have")
        sent = frontier.join(hubs, "node", "left").select("query_id", "_have", "node", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part"))
        reached = sent.join(dealt, ["node", "_part"]).select("query_id", F.col("next").alias("node"), "_have").distinct()
        new = reached.join(found.select("query_id", "node"), ["query_id", "node"], "left_anti")
        new = new.withColumn("_k", F.row_number().over(order)).where(F.col("_k") + F.col("_have") <= most).select("query_id", "node", F.lit(hop).alias("hop"))
        found = stored(found.unionByName(new), "walk")
    return found


def edges_within(found: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id and the edges with both ends among a query's nodes."""
    ends = found.select("query_id", F.col("node").alias("src"))
    return ends.join(edges, "src").join(found.select("query_id", F.col("node").alias("tgt")), ["query_id", "tgt"]).select("query_id", *edges.columns)
