"""The event operators on a stream: watermark, duplicates dropped, tumbling windows, sessions by gap and by marker."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def timed(events: DataFrame, delay: str = "10 minutes", key: str = "event_id") -> DataFrame:
    """Event time as a zoned timestamp with a watermark; repeated ids within it are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def tumbling_metrics(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts, sums and approximate distinct targets per window, player and ability."""
    grouped = timed(events, delay).groupBy(F.window("ts", width), "player", "ability")
    return grouped.agg(F.count("*").alias("events"), F.sum(F.col("amount").cast("decimal(18,4)")).alias("amount"), F.approx_count_distinct("target").alias("targets"))


def session_metrics(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Gap sessions per player; in append mode a session is given out once the watermark has passed its end.

    So sessions that end within ``gap`` and ``delay`` of the last event are
    still open when a stream is stopped, and come with later events.
    """
    grouped = timed(events, delay).groupBy(F.session_window("ts", gap), "player")
    return grouped.agg(F.count("*").alias("events"), F.sum(F.col("amount").cast("decimal(18,4)")).alias("amount"))


MARKED = "player long, session long, started timestamp, ended timestamp, events long, closed_by string"
BUFFERED = "event_id long, ts timestamp, marker boolean"
OPEN = "session long, active boolean, started timestamp, ended timestamp, events long"


def marked_processor() -> StatefulProcessor:
    """The processor of ``marked_stream``; its class is local, so it goes to the workers by value."""

    columns, buffered, opened = MARKED, BUFFERED, OPEN

    class MarkedSessions(StatefulProcessor):
        """Sessions of one player between start and stop markers, in event time.

        Rows wait in a list until the watermark has passed them, so they are applied
        in the order of time and id however they arrive. Rows before the watermark
        were dropped before they get here, and repeated ids within it are dropped
        too. What is kept per player: the rows not yet passed, and the open session.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", buffered)
            self.state = handle.getValueState("open", opened)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            passed = timerValues.getCurrentWatermarkInMs()
            for frame in rows:
                for event_id, ts, marker in zip(frame["event_id"], frame["ts"], frame["marker"], strict=True):
                    self.waiting.appendValue((int(event_id), ts.to_pydatetime(), None if pd.isna(marker) else bool(marker)))
                    at = int(ts.timestamp() * 1000)
                    if at >= passed:
                        self.handle.registerTimer(at + 1)
            yield from ()  # nothing is given out before the watermark has passed it

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            passed = timerValues.getCurrentWatermarkInMs()
            held = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[1], r[0]))
            due, later = [], []
            for row in held:
                (due if int(row[1].timestamp() * 1000) < passed else later).append(row)
            if not due:
                return
            session, active, started, ended, events = tuple(self.state.get()) if self.state.exists() else (0, False, None, None, 0)
            closed = []
            for _, ts, marker in due:
                if marker is True:
                    if active:
                        closed.append((key[0], session, started, ended, events, "start"))
                    session, active, started, ended, events = session + 1, True, ts, ts, 1
                elif marker is False:
                    if active:
                        closed.append((key[0], session, started, ended, events, "stop"))
                    active = False
                elif active:
                    ended, events = ts, events + 1
            self.state.update((session, active, started, ended, events))
            self.waiting.clear()
            if later:
                self.waiting.put(later)
            if closed:
                yield pd.DataFrame(closed, columns=[c.split()[0] for c in columns.split(", ")])

        def close(self) -> None:
            pass

    return MarkedSessions()


def marked_stream(events: DataFrame, is_start: Column, is_stop: Column, delay: str = "10 minutes") -> DataFrame:
    """Closed sessions between markers per player, as ``marked_sessions`` has them: ``closed_by`` a stop or the next start.

    A session is given out when the watermark has passed the marker that closes
    it; those still open stay in the state. Needs the RocksDB state store.
    """
    marker = F.when(is_start, F.lit(True)).when(is_stop, F.lit(False))
    rows = timed(events.withColumn("marker", marker), delay).select("player", "event_id", "ts", "marker")
    return rows.groupBy("player").transformWithStateInPandas(marked_processor(), MARKED, "Append", "EventTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


STORE = "spark.sql.streaming.stateStore.providerClass"


def late_rows(progress: list) -> int:
    """Rows that came after the watermark had passed them, from a query's progress reports."""
    reports = [json.loads(p.json) if hasattr(p, "json") else p for p in progress]
    return sum(op.get("numRowsDroppedByWatermark", 0) for r in reports for op in r.get("stateOperators", []))


def run_available(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, progress: list | None = None, store: str | None = None) -> DataFrame:
    """Process what is there, append to Parquet, and return the written table; progress reports go to ``progress``.

    Run again with the same checkpoint it goes on where it stopped: what was
    written stays, state is read back, and only new files are read. ``store`` is
    the state store of this query alone.
    """
    before = spark.conf.get(STORE)
    if store:
        spark.conf.set(STORE, store)
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    if progress is not None:
        progress.extend(query.recentProgress)
    return spark.read.schema(stream.schema).parquet(path)
