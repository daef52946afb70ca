"""Connected components of a link table, on Spark from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import FEW, durable, split_join


def _mark(links: DataFrame) -> tuple:
    """Count and order-free checksum of a link table: one row to the driver."""
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (two columns ``u`` and ``v`` of longs); root is the smallest node reached.

    Alternating large and small stars: each round hangs every node below the smallest neighbour
    seen, by a partial minimum and a join that splits hubs, so that no task holds a large group, and chains
    shorten by a factor a round. Minima of few links are broadcast, so that the links are not shuffled for the join.
    Rounds go on until nothing changes. Self links and repeats do no harm;
    links with a null end are left out, as null names no node.
    """
    star = durable(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(star)
    while mark[0]:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Both ends of a link have a minimum, so there are twice as many minima as links at most.
        joined = (lambda rows, least: rows.join(F.broadcast(least), "u")) if 2 * mark[0] <= FEW else (lambda rows, least: split_join(rows, least, ["u"], "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = joined(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large if 2 * mark[0] <= FEW else large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = joined(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        star = durable(small.distinct())
        if mark == (mark := _mark(star)):
            break
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
