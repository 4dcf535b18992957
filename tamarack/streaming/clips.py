"""The streaming twin of consecutive de-duplication: of each session the last clip, until it has been idle for long enough."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LastClip(StatefulProcessor):
    """State: the last clip's id and time. With an event time, a timer ends it."""

    def __init__(self, session: str, order: list[str], clip_id: str, kind: T.DataType, event_time: str | None, idle: timedelta) -> None:
        self.session, self.order, self.clip_id, self.kind, self.event_time = session, order, clip_id, kind, event_time
        self.span = int(idle.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = T.StructType([T.StructField("id", self.kind), T.StructField("at", T.LongType())])
        self.last = handle.getValueState("last", schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = self.last.get() if self.last.exists() else None
        for r in sorted(rows, key=lambda r: tuple(r[x] for x in self.order)):
            at = round(r[self.event_time].timestamp() * 1000) if self.event_time else None  # milliseconds, as timers have
            if last is None or last[0] is None or last[0] != r[self.clip_id] or (self.event_time and at - last[1] > self.span):
                yield r
            last = (r[self.clip_id], at)
        self.last.update(tuple(last))
        if self.event_time:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last[1] + self.span + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def consecutive_stream(clips: DataFrame, session: str, order: str | list[str], clip_id: str, event_time: str | None = None, delay: str = "0 seconds", idle: timedelta = timedelta(hours=1)) -> DataFrame:
    """Clips of a stream whose id differs from the one before in their session.

    Within a micro-batch, a session's clips are taken in order; across batches, in arrival. A null
    id differs from any other. With event_time, a timestamp that grows with order, a clip also counts
    that comes after the session was idle for longer than ``idle``, and a session's state ends when
    the watermark, ``delay`` behind the newest clip, has passed that; so what comes out is what
    sessions.consecutive gives with the same event_time and idle, whenever state was dropped. Without
    it, state stays: a time to live by the clock would keep a query that takes what is available from
    ending. The state store has to be RocksDB, and the session is set to that here.
    """
    clips.sparkSession.conf.set(_STORE, ROCKS)
    processor = _LastClip(session, [order] if isinstance(order, str) else order, clip_id, clips.schema[clip_id].dataType, event_time, idle)
    timed = clips.withWatermark(event_time, delay) if event_time else clips
    return timed.groupBy(session).transformWithState(processor, clips.schema, "append", "EventTime" if event_time else "None")
