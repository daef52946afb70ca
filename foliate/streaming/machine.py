"""The status machine of documents as keyed state with timers: rules of change, an error output, and a limit of time.

Events of a document are applied in the order of their own time, whatever order they arrive in: they wait in the document's state until the
watermark has passed them. A change that the rules forbid leaves the status as it is and goes to the error output; so does an
event that arrives after the watermark has passed it. A document too long in a timed status becomes ``failed`` at the very moment its time is up.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: What may follow a status; a document without one begins anywhere but at the end of the way.
RULES = {
    None: ("ready", "handling"),
    "ready": ("handling", "failed"),
    "handling": ("pending", "processing", "processed", "failed"),
    "pending": ("processing", "failed"),
    "processing": ("processed", "failed"),
    "processed": (),
    "failed": ("ready", "handling"),
}
#: Hours that a document may stay in a status.
LIMITS = {"handling": 24.0}

SCHEMA = "doc_id string, event_id long, at long, before string, after string, outcome string"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def applied(state: list, events: list[tuple], upto: int, rules: dict, limits: dict) -> list[tuple]:
    """(event_id, at, before, after, outcome) of sorted events (at, event_id, status), and of limits passed up to a time; ``state`` (status, since) follows."""
    out = []

    def expire(now: int) -> None:
        limit = limits.get(state[0])
        if limit is not None and state[1] + limit < now:
            out.append((None, state[1] + limit, state[0], "failed", "timeout"))
            state[:] = ["failed", state[1] + limit]

    for at, event, status in events:
        expire(at)
        if status in rules.get(state[0], ()):
            out.append((event, at, state[0], status, "changed"))
            state[:] = [status, at]
        else:
            out.append((event, at, state[0], status, "same" if status == state[0] else "forbidden"))
    expire(upto)
    return out


class Machine(StatefulProcessor):
    """State of a document: its status, since when, and the events that wait for the watermark (JSON, in order)."""

    def __init__(self, rules: dict, limits: dict) -> None:
        self.rules, self.limits = rules, {k: int(v * 3_600_000_000) for k, v in limits.items()}

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", "status string, since long, waiting string")

    def _go_on(self, key: tuple, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        """Apply what the watermark (in milliseconds) has passed, and set the timer for what comes next."""
        passed = watermark * 1000
        held = self.state.get() if self.state.exists() else None
        state = [held[0], held[1]] if held else [None, 0]
        late = [x for x in new if x[0] <= passed]
        waiting = sorted([*(tuple(x) for x in json.loads(held[2])), *(x for x in new if x[0] > passed)] if held else [x for x in new if x[0] > passed], key=lambda x: (x[0], x[1]))
        ready = [x for x in waiting if x[0] <= passed]
        rows = [(event, at, state[0], status, "late") for at, event, status in sorted(late, key=lambda x: (x[0], x[1]))]
        rows += applied(state, ready, passed, self.rules, self.limits)
        waiting = waiting[len(ready) :]
        self.state.update((*state, json.dumps(waiting)))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        following = [x[0] for x in waiting[:1]] + ([state[1] + self.limits[state[0]] + 1] if state[0] in self.limits else [])
        if following:
            self.handle.registerTimer(-(-min(following) // 1000))
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=_NAMES).astype({"event_id": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(at), int(event), status) for part in rows for at, event, status in zip(part["at"], part["event_id"], part["status"])]
        yield from self._go_on(key, new, max(0, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go_on(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


#: The state store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def status_changes(events: DataFrame, rules: dict = RULES, limits: dict = LIMITS) -> DataFrame:
    """doc_id, event_id, at (microseconds), before, after, outcome of a stream (doc_id string, event_id, ts with a watermark, status).

    outcome: changed, same, forbidden, late or timeout. Rows without a document, a time, a number or a status are left out. A query over it needs
    ``STORE`` as its ``spark.sql.streaming.stateStore.providerClass``.
    """
    named = events.where("doc_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL AND status IS NOT NULL")
    # A copy of the time without the watermark's mark: Spark would drop late rows, here they are an output.
    rows = named.select("doc_id", "event_id", F.unix_micros("ts").alias("at"), "status")
    return rows.groupBy("doc_id").transformWithStateInPandas(Machine(rules, limits), SCHEMA, "Append", "EventTime")


def final_status(changes: DataFrame) -> DataFrame:
    """doc_id, status, n_changes, n_forbidden, n_late, n_timeouts from the outcomes of a stream."""
    n = lambda kind: F.count_if(F.col("outcome") == kind)
    went = F.col("outcome").isin("changed", "timeout")
    last = F.max_by(F.when(went, F.col("after")), F.when(went, F.struct("at", F.col("event_id").isNotNull(), "event_id")))
    return changes.groupBy("doc_id").agg(last.alias("status"), n("changed").alias("n_changes"), n("forbidden").alias("n_forbidden"), n("late").alias("n_late"), n("timeout").alias("n_timeouts"))


def run_changes(spark: SparkSession, events: DataFrame, folder: str, rules: dict = RULES, limits: dict = LIMITS) -> DataFrame:
    """The outcomes so far below ``folder`` after all events that are there now; called again, it goes on from its checkpoint there."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        out = status_changes(events, rules, limits).writeStream.format("parquet").option("path", f"{folder}/outcomes").option("checkpointLocation", f"{folder}/state")
        out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(SCHEMA).parquet(f"{folder}/outcomes")
