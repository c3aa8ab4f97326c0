"""Structured Streaming forms: debounce, windows, duplicates, daily quota."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..session import ship


def event_stream(spark: SparkSession, path: str, schema: StructType, ts: str = "ts", files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream; times without a zone are taken as the session's, which watermarks need."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def debounce(events: DataFrame, key: str, ts: str = "ts", kind: str = "event_type", quiet: str = "2 seconds", late: str | None = None) -> DataFrame:
    """One row for each burst of a key's events, when it has been quiet: the last event's time and kind, and how many."""
    if late is not None:
        events = events.withWatermark(ts, late)
    burst = events.groupBy(key, F.session_window(ts, quiet).alias("w"))
    rows = burst.agg(F.max(ts).alias("last_ts"), F.max_by(kind, ts).alias("last_kind"), F.count(F.lit(1)).alias("n_events"))
    return rows.select(key, F.col("w.start").alias("first_ts"), "last_ts", "last_kind", "n_events")


def windowed(events: DataFrame, by: str, ts: str = "ts", width: str = "1 hour", slide: str | None = None, late: str | None = None, value: str = "value") -> DataFrame:
    """Counts and sums in tumbling (or, with a slide, sliding) windows."""
    if late is not None:
        events = events.withWatermark(ts, late)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    rows = events.groupBy(window.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n", "total")


def without_duplicates(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def quota_gate(log: DataFrame, day: str, tokens: str, limit: int, order: str | None = None) -> DataFrame:
    """(day, asked, granted, used): requests of a day are granted while they fit, those of one batch by ``order``; the state is the day's sum."""
    ship(log.sparkSession)

    def gate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        rows = []
        batch = pd.concat(list(batches))
        # rows of a group come in the order of the shuffle
        for n in (batch.sort_values([order, tokens], kind="stable") if order else batch)[tokens]:
            granted = used + int(n) <= limit
            used += int(n) if granted else 0
            rows.append((key[0], int(n), granted, used))
        state.update((used,))
        yield pd.DataFrame(rows, columns=["day", "asked", "granted", "used"])

    return log.groupBy(day).applyInPandasWithState(gate, "day string, asked long, granted boolean, used long", "used long", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now, into a table in memory."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
