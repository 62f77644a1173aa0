"""Which load is current, as a stream: publications of all sources in, changes of each source's pointer out.

A publication ``(source, load_id, snapshot_at)`` takes over when its load is newer
than the one that is current.  Publications arrive in any order, twice, or after a
restart; the answer is that of all of them in order of their cut-off: each waits in
its source's state until the watermark has passed its cut-off, then those due are
applied in order of (cut-off, load).  Spark refuses those that come after the
watermark.  State holds a source's current load and what waits; of the publications
of one batch only those wait that are newer than all with an earlier cut-off.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGE = "source string, load_id long, snapshot_at timestamp, previous long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that stateful processors need, as it was afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Pointer(StatefulProcessor):
    """State of one source: the load that is current, and publications that are not due yet by (cut-off, load)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "load_id long")
        self.waiting = handle.getMapState("waiting", "at long, load_id long", "snapshot_at timestamp")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = None
        for at, load_id, when in sorted((r.at_ms, r.load_id, r.snapshot_at) for r in rows if r.load_id is not None):
            if newest is None or load_id > newest:  # others come after a newer load and can never take over
                newest = load_id
                self.waiting.updateValue((at, load_id), (when,))  # a repeat is the same entry
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        ready = sorted((at, load_id, when[0]) for (at, load_id), when in self.waiting.iterator() if at <= due)
        for at, load_id, when in ready:
            self.waiting.removeKey((at, load_id))
            held = self.current.get() if self.current.exists() else None
            if held is None or load_id > held[0]:
                self.current.update((load_id,))
                yield Row(source=key[0], load_id=load_id, snapshot_at=when, previous=None if held is None else held[0])

    def close(self) -> None:
        return


def changes(publications: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``source, load_id, snapshot_at, previous`` of every takeover, from a stream of publications.

    The session's state store must be the RocksDB one while the stream runs
    (:func:`rocks`), as stateful processors need it.  Rows without a source or a cut-off are left out.
    """
    due = publications.where("source IS NOT NULL AND snapshot_at IS NOT NULL").select("source", "load_id", "snapshot_at").withWatermark("snapshot_at", delay)
    timed = due.withColumn("at_ms", F.unix_millis("snapshot_at"))
    return timed.groupBy("source").transformWithState(Pointer(), CHANGE, "append", "EventTime")


def takeovers(publications: DataFrame) -> DataFrame:
    """The same of a whole table at once: publications whose load is newer than all of their source with an earlier cut-off."""
    due = publications.where("source IS NOT NULL AND snapshot_at IS NOT NULL AND load_id IS NOT NULL").select("source", "load_id", "snapshot_at").distinct()
    before = Window.partitionBy("source").orderBy(F.unix_millis("snapshot_at"), "load_id").rowsBetween(Window.unboundedPreceding, -1)
    return due.withColumn("previous", F.max("load_id").over(before)).where("previous IS NULL OR load_id > previous")
