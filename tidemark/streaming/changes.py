"""Change events: JSON files in a folder, each seen once, which empty the result cache.

`ChangeListener` lists the folder on the driver; `change_stream` is the durable form, whose checkpoint remembers files across
restarts (it passes over empty files and names that begin with `_` or `.`).
"""

from __future__ import annotations

import logging
import os
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.cache import ResultCache

log = logging.getLogger(__name__)


class ChangeListener:
    def __init__(self, path: str):
        self.path, self._seen = path, set()

    def sync(self, cache: ResultCache) -> int:
        """New event files; any clears the cache. A path that is no local folder has none. Unreadable files are tried again."""
        if not os.path.isdir(self.path):
            log.warning("%s is not a folder; no change events are read", self.path)
            return 0
        new = 0
        for entry in sorted(os.scandir(self.path), key=lambda e: e.name):
            if not entry.name.endswith(".json") or not entry.is_file() or entry.path in self._seen:
                continue
            try:
                with open(entry.path, encoding="utf-8") as f:
                    log.info("change event %s: %s", entry.name, f.read().strip())
            except (OSError, UnicodeDecodeError) as e:
                log.warning("change event %s can't be read: %s", entry.name, e)
                continue
            self._seen.add(entry.path)
            new += 1
        if new:
            cache.clear()
        return new

    def poll(self, cache: ResultCache, seconds: float) -> threading.Event:
        """Syncs at once and then every so often; set the returned event to stop."""
        stop = threading.Event()

        def loop() -> None:
            while True:
                try:
                    self.sync(cache)
                except Exception:
                    log.exception("reading change events failed")
                if stop.wait(seconds):
                    return

        threading.Thread(target=loop, daemon=True).start()
        return stop


def change_stream(spark: SparkSession, path: str, cache: ResultCache, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    events = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(path)

    def react(batch: DataFrame, _: int) -> None:
        if batch.head(1):
            cache.clear()

    writer = events.writeStream.foreachBatch(react).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, n, total over event-time windows; on a stream, rows later than `late` are dropped once their
    window has been given out."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")
