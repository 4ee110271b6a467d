"""Handoffs as a stream: a lease machine per handoff, with timers.

Events (id, at, seq, action, actor, expected, ts) may come in any order within the
allowed lateness, and more than once. The state of a handoff is a base, all events
before the watermark folded, and the events since, by (at, seq); each batch folds
base and events anew and puts out the result, so it is what a batch fold of all
events up to then gives. Events behind the watermark are dropped by Spark before
they arrive; so the base never changes again and stays one row, and the events kept
are those of the allowed lateness.

An event with ``expected`` is a compare and swap: it counts only at that revision.
A timer at the end of a lease puts out the handoff again, as one that needs
attention; a completed handoff is forgotten ``keep`` after its return, when no event
of it can arrive any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from factlake.operators.lifecycle import latest_by
from factlake.staging import new_dir

ROW = "id long, state string, holder string, revision int, expires long, events long, overdue boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Timers and map state need the store that keeps state on disk.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Lease:
    """What is known of a handoff after some events."""

    state: str = "none"
    holder: str | None = None
    revision: int = 0
    expires: int | None = None
    events: int = 0

    def after(self, at: int, action: str, actor: str | None, expected: int | None, lease: int) -> Lease:
        """One event later; an event that does not apply only counts."""
        now = replace(self, events=self.events + 1)
        if expected is not None and expected != self.revision:
            return now
        lives = self.expires is not None and self.expires > at
        mine = self.holder is not None and self.holder == actor
        step = replace(now, revision=self.revision + 1)
        if action == "dispatch" and self.state == "none":
            return replace(step, state="pending")
        if action == "accept" and (self.state == "pending" or (self.state == "accepted" and not lives)):
            return replace(step, state="accepted", holder=actor, expires=at + lease)
        if action == "heartbeat" and self.state == "accepted" and mine and lives:
            return replace(step, expires=at + lease)
        if action == "return" and self.state == "accepted" and mine:
            return replace(step, state="completed", expires=None)
        return now


class LeaseMachine(StatefulProcessor):
    """State of one handoff: a base and the events since the watermark."""

    def __init__(self, lease: int, keep: int) -> None:
        self.lease, self.keep = lease, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # every call to the state is a message to the JVM, so the events of a handoff are read and written as one list
        self.base = handle.getValueState("base", "state string, holder string, revision int, expires long, events long, timer long")
        self.later = handle.getListState("later", "at long, seq long, action string, actor string, expected int")

    def _read(self) -> tuple[Lease, int | None, dict[tuple[int, int], tuple]]:
        base = self.base.get()
        if base is None:
            return Lease(), None, {}
        return Lease(*base[:-1]), base[-1], {(at, seq): (action, actor, expected) for at, seq, action, actor, expected in self.later.get()}

    def _write(self, base: Lease, timer: int | None) -> None:
        self.base.update((base.state, base.holder, base.revision, base.expires, base.events, timer))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        base, timer, later = self._read()
        fresh = []
        for r in rows:
            event = (r["at"], r["seq"])
            if event not in later:  # the same event again changes nothing
                later[event] = (r["action"], r["actor"], r["expected"])
                fresh.append((*event, *later[event]))
        now, watermark = base, timerValues.getCurrentWatermarkInMs()
        kept = []
        for event in sorted(later):
            now = now.after(event[0], *later[event], self.lease)
            if event[0] < watermark:
                base = now
            else:
                kept.append((*event, *later[event]))
        if not kept:
            self.later.clear()
        elif len(kept) < len(later):
            self.later.put(kept)
        elif fresh:
            self.later.appendList(fresh)
        wake = now.expires if now.state == "accepted" else max(later)[0] + self.keep if now.state == "completed" else None
        due = None if wake is None else max(wake, watermark + 1)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self._write(base, due)
        yield self._row(key, now, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        base, _, later = self._read()
        now = base
        for event in sorted(later):
            now = now.after(event[0], *later[event], self.lease)
        if now.state == "completed":
            self.base.clear()
            self.later.clear()
        else:
            self._write(base, None)
            yield self._row(key, now, True)

    def _row(self, key: Any, now: Lease, overdue: bool) -> Row:
        return Row(id=key[0], state=now.state, holder=now.holder, revision=now.revision, expires=now.expires, events=now.events, overdue=overdue)

    def close(self) -> None:
        pass


def lease_states(events: DataFrame, lease: int, lateness: str = "1 hour", keep: int = 7 * 86_400_000) -> DataFrame:
    """A row (``ROW``) for each change of a handoff, from a stream of events with the event time ``ts``."""
    rows = events.withWatermark("ts", lateness).select("id", "at", "seq", "action", "actor", F.col("expected").cast("int").alias("expected"), "ts")
    return rows.groupBy("id").transformWithState(statefulProcessor=LeaseMachine(lease, keep), outputStructType=ROW, outputMode="Update", timeMode="EventTime")


class LeaseTable:
    """The latest row of each handoff, from the batches of a stream; a batch that runs again is written anew."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or new_dir(spark, "leases")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def table(self, now: int) -> DataFrame:
        """(id, state, holder, revision, lane) at the time ``now``."""
        try:
            rows = self.spark.read.schema(f"{ROW}, batch long").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], f"{ROW}, batch long")
        rows = latest_by(rows, ["id"], [F.desc("batch"), F.desc("overdue")])
        return rows.select("id", "state", "holder", "revision", lane(F.col("state"), F.col("expires"), now).alias("lane"))


def lane(state: Column, expires: Column, now: int) -> Column:
    return (
        F.when(state == "pending", "ready").when(state == "completed", "returned")
        .when((state == "accepted") & (expires <= now), "attention").when(state == "accepted", "in_progress").otherwise("none")
    )


def follow_leases(events: DataFrame, table: LeaseTable, checkpoint: str, lease: int, lateness: str = "1 hour", keep: int = 7 * 86_400_000) -> StreamingQuery:
    """Take in everything the stream has now, then stop; another call over the checkpoint goes on from there."""
    spark = table.spark
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        writer = lease_states(events, lease, lateness, keep).writeStream.outputMode("update").foreachBatch(table.write)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        # the query has its own copy of the session's settings
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
