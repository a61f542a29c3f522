"""Event logs: fallbacks of the engine's parts, appended and summed; and windows over event streams."""

from __future__ import annotations

import json
import threading
from collections import Counter
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "component string, trigger string, action string, severity string, details map<string, string>, ts timestamp"


@dataclass
class FallbackEvent:
    component: str
    trigger: str
    action: str
    severity: str = "warning"
    details: dict[str, str] = field(default_factory=dict)
    ts: str = field(default_factory=lambda: datetime.now(UTC).isoformat())


class FallbackTracker:
    """Keeps events in memory, and appends them to a file of JSON lines where one is named; a file that fails loses nothing else."""

    def __init__(self, path: str | None = None, enabled: bool = True):
        self.path, self.enabled, self._events, self._lock = path, enabled, [], threading.Lock()

    def record(self, component: str, trigger: str, action: str, severity: str = "warning", **details) -> None:
        if not self.enabled:
            return
        event = FallbackEvent(component, trigger, action, severity, {k: str(v) for k, v in details.items()})
        with self._lock:
            self._events.append(event)
            if self.path:
                try:
                    with Path(self.path).open("a") as f:
                        f.write(json.dumps(asdict(event)) + "\n")
                except OSError:
                    pass  # the log is a convenience; the work goes on

    def component(self, name: str) -> ComponentTracker:
        return ComponentTracker(self, name)

    def summary(self) -> dict[str, dict[str, int]]:
        out: dict[str, dict[str, int]] = {}
        for (c, t), n in Counter((e.component, e.trigger) for e in self._events).items():
            out.setdefault(c, {})[t] = n
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(e.component, e.trigger, e.action, e.severity, e.details, e.ts) for e in self._events]
        return spark.createDataFrame(rows, EVENT.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))

    def reset(self) -> None:
        with self._lock:
            self._events.clear()


@dataclass
class ComponentTracker:
    tracker: FallbackTracker
    name: str

    def record(self, trigger: str, action: str, severity: str = "warning", **details) -> None:
        self.tracker.record(self.name, trigger, action, severity, **details)


_tracker = FallbackTracker()


def get_tracker() -> FallbackTracker:
    return _tracker


def summarize_events(events: DataFrame) -> DataFrame:
    """``component, triggers``: how often each component met each trigger, as a map."""
    counts = events.groupBy("component", "trigger").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("component").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("trigger", "n")))).alias("triggers"))


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Events of a folder of JSON lines, at once or as they come."""
    return (spark.readStream if stream else spark.read).schema(EVENT).json(path)


def tumbling_counts(events: DataFrame, width: str = "1 hour", by: str = "event_type", time: str = "ts", late: str | None = None) -> DataFrame:
    """``window_start, <by>, n, total``: counts and sums of ``value`` in windows that follow each other.

    On a stream ``late`` is how long a window waits for late events; state is kept no longer.
    """
    rows = events.withColumn("_ts", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_ts", late) if late else rows
    sums = rows.groupBy(F.window("_ts", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", time: str = "ts", late: str | None = None) -> DataFrame:
    """``<key>, session_start, session_end, n``: runs of events of a key with less than ``gap`` between them; the end is the last event."""
    rows = events.withColumn("_ts", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_ts", late) if late else rows
    runs = rows.groupBy(F.session_window("_ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.max("_ts").alias("session_end"))
    return runs.select(key, F.col("w.start").alias("session_start"), "session_end", "n")


def last_before(events: DataFrame, key: str = "user_id", time: str = "ts") -> DataFrame:
    """Each event with the one before of its key: ``prev_event_id``, by time, then id."""
    order = Window.partitionBy(key).orderBy(time, "event_id")
    return events.withColumn("prev_event_id", F.lag("event_id").over(order))


def start_rollup(events: DataFrame, path: str, checkpoint: str, width: str = "1 hour", late: str = "2 hours") -> StreamingQuery:
    """Write finished windows of an event stream as Parquet, as far as the input goes; a query started again goes on from its checkpoint."""
    return tumbling_counts(events, width, late=late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
