"""The status-event log as a stream.

The batch operators of operators.progress hold for a stream where a step keeps no state (routing, critical events, requests
that follow an event) or where Spark aggregates (health by window). Here are those with a state of their own. Events of a key
are handled in the order of (event_time, sequence): they wait until the watermark has passed them.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..model import STATUS_EVENT
from ..operators import progress as S
from ..sources.keyed import BUCKETS, KeyedTable
from ..sources.sinks import merge_critical, merge_snapshots, write_step_status

log = logging.getLogger(__name__)


def read_status_events(spark: SparkSession, path: str) -> DataFrame:
    """Events from JSON files as they arrive."""
    return S.status_events(spark.readStream.schema(STATUS_EVENT).json(path))


class _Dedup(StatefulProcessor):
    """Passes an event on if it comes at least its window after the last one that was passed on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_us long")
        self.waiting = handle.getListState("waiting", "at_us long, window_us long, row string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for r in frame.itertuples(index=False):
                self.waiting.appendValue((int(r.at_us), int(r.window_us), r.row))
        mark = timerValues.getCurrentWatermarkInMs()
        yield from self._pass(mark)
        self._wake(mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        yield from self._pass(mark)
        self._wake(mark)

    def _wake(self, mark: int) -> None:
        held = [w[0] for w in self.waiting.get()]
        if held:
            self.handle.registerTimer(max(min(held) // 1000 + 1, mark + 1))

    def _pass(self, mark: int) -> Iterator[pd.DataFrame]:
        held = sorted(self.waiting.get(), key=lambda w: (w[0], w[2]))
        due, later = [w for w in held if w[0] // 1000 < mark], [w for w in held if w[0] // 1000 >= mark]
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for at, window, row in due:
            if last is None or at - last >= window:
                last = at
                out.append(row)
        if due:
            self.last.update((last,))
            self.waiting.put(later) if later else self.waiting.clear()
        yield pd.DataFrame({"row": pd.Series(out, dtype=str)})

    def close(self) -> None:
        pass


def dedup_stream(events: DataFrame, short_ms: int = 25, long_ms: int = 100, keys: list[str] = S.KEY_FIELDS, late: str = "1 minute") -> DataFrame:
    """dedup_events() on a stream. An event later than `late` is dropped."""
    rows = events.withWatermark("event_time", late)
    packed = rows.select(
        F.to_json(F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys])).alias("key"), "event_time",
        F.unix_micros(F.col("event_time").cast("timestamp")).alias("at_us"), (S.dedup_window(short_ms, long_ms) * 1000).alias("window_us"),
        F.concat(F.lpad(F.col("sequence").cast("string"), 20, "0"), F.lit("|"), F.to_json(F.struct(*events.columns))).alias("row"),
    )
    passed = packed.groupBy("key").transformWithStateInPandas(_Dedup(), "row string", "Append", "EventTime")
    parsed = F.from_json(F.substring("row", 22, 1 << 30), events.schema)
    return passed.select(parsed.alias("e")).select("e.*")


def throttle_stream(events: DataFrame, window_ms: int = 200) -> DataFrame:
    return dedup_stream(events.filter("event_type = 'step_progress'"), window_ms, window_ms, ["task_id", "step_id"])


def health_stream(events: DataFrame, every: str = "5 seconds", backlog: int = 500, late: str = "1 minute") -> DataFrame:
    return S.status_health(events.withWatermark("event_time", late), every, backlog)


class _Absence(StatefulProcessor):
    """Tells once of each time that nothing came for longer than `limit_us`: when a timer goes off, or when the next event shows it."""

    def __init__(self, limit_us: int):
        self.limit_us = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_us long, told boolean")
        self.waiting = handle.getListState("waiting", "at_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for at in frame["at_us"]:
                self.waiting.appendValue((int(at),))
        yield from self._pass(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._pass(key[0], timerValues.getCurrentWatermarkInMs())

    def _pass(self, key: str, mark: int) -> Iterator[pd.DataFrame]:
        """Events that the watermark has passed, in order; whatever is later may still be preceded by others."""
        held = sorted(w[0] for w in self.waiting.get())
        due, later = [t for t in held if t // 1000 < mark], [t for t in held if t // 1000 >= mark]
        last, told = self.last.get() if self.last.exists() else (None, False)
        out = []
        for at in due:
            if last is not None and at - last > self.limit_us and not told:
                out.append(last)
            if last is None or at > last:
                last, told = at, False
        if last is not None and not told and (last + self.limit_us) // 1000 < mark:
            out.append(last)
            told = True
        if last is not None:
            self.last.update((last, told))
        if due:
            self.waiting.put([(t,) for t in later]) if later else self.waiting.clear()
        wake = ([later[0] // 1000 + 1] if later else []) + ([(last + self.limit_us) // 1000 + 1] if last is not None and not told else [])
        if wake:
            self.handle.registerTimer(max(min(wake), mark + 1))
        yield pd.DataFrame({"key": pd.Series([key] * len(out), dtype=str), "last_us": pd.Series(out, dtype="int64")})

    def close(self) -> None:
        pass


def absence_stream(events: DataFrame, keys: list[str], seconds: int = 30, late: str = "1 minute") -> DataFrame:
    """keys, last_seen, alert_at of absences() as the watermark shows them, once each, also where nothing comes any more. An event later than `late` is
    dropped."""
    named = F.to_json(F.struct(*[F.col(k).alias(k) for k in keys])) if keys else F.lit("{}")
    rows = events.withWatermark("event_time", late).select(named.alias("key"), "event_time", F.unix_micros(F.col("event_time").cast("timestamp")).alias("at_us"))
    found = rows.groupBy("key").transformWithStateInPandas(_Absence(seconds * 1_000_000), "key string, last_us long", "Append", "EventTime")
    own = F.from_json("key", StructType([events.schema[k] for k in keys])) if keys else F.struct(F.lit(0).alias("_"))
    last = F.timestamp_micros("last_us")
    return found.select(own.alias("k"), last.alias("last_seen"), F.timestamp_micros(F.col("last_us") + seconds * 1_000_000).alias("alert_at")).select(*[F.col("k")[k].alias(k) for k in keys], "last_seen", "alert_at")


def step_state_stream(events: DataFrame, numbered: bool = False) -> DataFrame:
    """fold_step_state() as a running aggregate; write it in update or complete mode."""
    return S.fold_step_state(events, numbered)


#: Columns of the table that sync_snapshots() keeps.
STEP_TABLE = "task_id long, step_id int, status string, current_item int, total_items int, error_message string, started_at {time}, updated_at {time}, events long, sequence long, progress double"


def step_table(spark: SparkSession, folder: str, buckets: int = BUCKETS, time: str = "timestamp") -> KeyedTable:
    """The table of sync_snapshots(); time is the type of the log's event_time."""
    return KeyedTable(spark, folder, STEP_TABLE.format(time=time), ["task_id", "step_id"], buckets)


def sync_snapshots(events: DataFrame, table: KeyedTable, checkpoint: str, every: str = "500 milliseconds") -> list[StreamingQuery]:
    """Keeps a stored step table in step with the log by two queries over it: at every trigger the changed states, and with each batch that has any the
    critical events, at once. Batches count once, also when a query that has failed tries them again."""
    columns = [f.name for f in table.read().schema.fields]

    def snapshot(states: DataFrame, batch: int) -> None:
        table.apply(states.select(columns), batch, merge_snapshots, "snapshots")

    def critical(found: DataFrame, batch: int) -> None:
        table.apply(S.fold_step_state(found, True).select(columns), batch, merge_critical, "critical")

    states = step_state_stream(events, True).writeStream.outputMode("update").option("checkpointLocation", f"{checkpoint}/snapshots")
    ends = S.critical_events(events).filter("step_id is not null").writeStream.option("checkpointLocation", f"{checkpoint}/critical")
    return [states.trigger(processingTime=every).foreachBatch(snapshot).start(), ends.foreachBatch(critical).start()]


def upsert_stream(updates: DataFrame, table: KeyedTable, checkpoint: str, writer: str = "main") -> StreamingQuery:
    """Applies a stream of partial step updates to a stored table, each batch once, also after a restart from the checkpoint."""

    def apply(batch: DataFrame, number: int) -> None:
        write_step_status(table, batch, number, writer)

    return updates.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply).start()


Callback = Callable[[DataFrame, int], None]


def _guarded(name: str, callback: Callable, *args) -> None:
    """A callback's error is told of, and ends neither the query nor the other callbacks."""
    try:
        callback(*args)
    except Exception as error:  # noqa: BLE001
        log.warning("%s: %s: %s", name, type(error).__name__, error)


def on_event(events: DataFrame, kind: str, callback: Callback | list[Callback], checkpoint: str) -> StreamingQuery:
    """Calls back, one callback after another, with each batch of events of a kind."""
    callbacks = callback if isinstance(callback, list) else [callback]

    def call(batch: DataFrame, number: int) -> None:
        for each in callbacks:
            _guarded(f"on_event({kind}), batch {number}", each, batch, number)

    return events.filter(F.col("event_type") == kind).writeStream.option("checkpointLocation", checkpoint).foreachBatch(call).start()


class QueryReports(StreamingQueryListener):
    """Reports of streaming queries to callbacks: a dict with the query's id and name, and what has happened, `started`, `progress` (with batch, rows and
    rows a second), `idle` or `ended` (with the error, if any). Register it with spark.streams.addListener()."""

    def __init__(self, *callbacks: Callable[[dict], None]):
        self.callbacks = callbacks

    def _tell(self, **report) -> None:
        for each in self.callbacks:
            _guarded(f"report of {report['id']}", each, report)

    def onQueryStarted(self, event) -> None:
        self._tell(what="started", id=str(event.id), name=event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._tell(what="progress", id=str(p.id), name=p.name, batch=p.batchId, rows=p.numInputRows, rows_a_second=p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        self._tell(what="idle", id=str(event.id), name=None)

    def onQueryTerminated(self, event) -> None:
        self._tell(what="ended", id=str(event.id), name=None, error=event.exception)


def flush_events(*queries: StreamingQuery) -> None:
    """Waits until everything that has arrived is processed."""
    for query in queries:
        query.processAllAvailable()
