"""Positions and running totals against a plain loop; a key may span all tasks."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliate.operators.running import running


def brute(rows):
    out, seen = [], defaultdict(lambda: [0, 0])
    for k, o, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)):
        seen[k][0] += 1
        seen[k][1] += v or 0
        out.append((k, o, v, *seen[k]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_same_as_a_loop(spark, hot):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < hot else rng.choice(["a", "b", None, "", *map(str, range(200))]), None if i == 5 else i, rng.choice([None, i % 7, -i])) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(7)
    for batch in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = running(df, ["k"], ["o"], "n", {"v": "total"})
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_key_with_all_rows_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 20_000, 1, 6).select(F.lit(1).alias("k"), F.col("id").alias("o"))
        got = running(df, ["k"], ["o"])
        assert got.where("rank <> o + 1").count() == 0
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= 4 and max(sizes) < 10_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_rows(spark):
    assert running(spark.createDataFrame([], "k int, o int"), ["k"], ["o"]).count() == 0
