"""Positions and running totals within a key, without a task that takes a whole key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.sources.shared import durable


def _starts(batch: pa.RecordBatch, keys: list[int], before: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where another key begins, and the last row's key."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    row = lambda i: tuple(batch.column(k)[i].as_py() for k in keys)
    new[0] = before != row(0)
    return new, row(batch.num_rows - 1)


def _local(batches: Iterator[pa.RecordBatch], keys: list[int], sums: list[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Positions and totals within one task's sorted rows, for each key; its place and whether it is the task's first key."""
    part, before, head, at = TaskContext.get().partitionId(), None, True, 0
    carry = np.zeros(1 + len(sums), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        first = at == 0
        new, before = _starts(batch, keys, before)
        starts = np.flatnonzero(new)
        heads = np.zeros(batch.num_rows, bool)
        if head:  # the task's first key goes on until another begins
            later = starts[starts > 0] if first else starts
            heads[: later[0] if len(later) else batch.num_rows] = True
            head = not len(later)
        group = np.cumsum(new) - 1  # -1: the key of the batch before goes on
        columns = []
        for i, values in enumerate([np.ones(batch.num_rows, np.int64), *(pc.fill_null(batch.column(k), 0).to_numpy(zero_copy_only=False) for k in sums)]):
            total = np.cumsum(values)
            base = np.append(total[starts] - values[starts], -carry[i : i + 1])  # the last entry is for group -1
            total = total - base[group]
            carry[i] = total[-1]
            columns.append(pa.array(total))
        places = np.arange(at, at + batch.num_rows)
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(places), pa.array(heads)], names)


def running(rows: DataFrame, keys: list[str], order: list[str], rank: str = "rank", sums: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with their position in their key by ``order`` (from 1), and running totals of long columns (``sums``: column to new name).

    Ascending, nulls first; rows that are equal in ``order`` are numbered in any order. One range shuffle by key and order deals a key of any size out to many
    tasks, each of which numbers what it has; the result is written down. One row a task, with the totals of its
    last key, goes through the driver and tells the next tasks what comes before their first key. Null values add nothing; totals have to stay in 64 bits.
    """
    sums = sums or {}
    names = [*rows.columns, rank, *sums.values(), "_part", "_place", "_head"]
    at = {c: i for i, c in enumerate(rows.columns)}
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    schema = ", ".join([*types, *(f"`{c}` long" for c in (rank, *sums.values())), "_part int, _place long, _head boolean"])
    ordered = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    own_keys, own_sums = [at[k] for k in keys], [at[c] for c in sums]
    local = durable(ordered.mapInArrow(lambda b: _local(b, own_keys, own_sums, names), schema))
    totals = [rank, *sums.values()]
    ends = local.groupBy("_part").agg(F.min_by(F.struct(*keys), "_place").alias("first"), F.max_by(F.struct(*keys), "_place").alias("last"), F.max_by(F.struct("_head", *totals), "_place").alias("end"))
    offsets, before, carried = [], None, [0] * len(totals)
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        carried = carried if before is not None and before == r["first"] else [0] * len(totals)
        if any(carried):
            offsets.append((r["_part"], *carried))
        carried = [r["end"][t] + (c if r["end"]["_head"] else 0) for t, c in zip(totals, carried)]
        before = r["last"]
    if not offsets:
        return local.drop("_part", "_place", "_head")
    more = rows.sparkSession.createDataFrame(offsets, ", ".join(["_part int", *(f"`_add{i}` long" for i in range(len(totals)))]))
    joined = local.join(F.broadcast(more), "_part", "left")
    added = {t: F.col(t) + F.when(F.col("_head"), F.coalesce(f"_add{i}", F.lit(0))).otherwise(F.lit(0)) for i, t in enumerate(totals)}
    return joined.withColumns(added).select(*rows.columns, *totals)
