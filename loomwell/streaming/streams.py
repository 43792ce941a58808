"""Structured Streaming twins of the log operators. Late rows count for one day unless stated; each equals its batch form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE = "1 day"


def log_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """A growing folder of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def daily_mentions(log: DataFrame, time: str = "created_at", key: str = "query") -> DataFrame:
    """Rows per key and day."""
    return log.withWatermark(time, LATE).groupBy(F.window(time, "1 day").alias("w"), key).agg(F.count("*").alias("n"))


def rolling(log: DataFrame, time: str = "created_at", key: str = "tool", days: int = 7) -> DataFrame:
    """Rows per key in windows of so many days, one a day."""
    return log.withWatermark(time, LATE).groupBy(F.window(time, f"{days} days", "1 day").alias("w"), key).agg(F.count("*").alias("n"))


def sessions(log: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "6 hours") -> DataFrame:
    """Rows per session: a gap ends one."""
    return log.withWatermark(time, LATE).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))


def bumps(hits: DataFrame, time: str = "created_at") -> DataFrame:
    """Query-time bumps of pages: the tool's value times the position's weight, summed per page."""
    value = F.when(F.col("tool") == "expand", 0.15).when(F.col("tool") == "graph", 0.05).otherwise(0.1)
    weight = F.when(F.col("pos") == 1, 1.0).when(F.col("pos") == 2, 0.7).when(F.col("pos") == 3, 0.5).otherwise(0.2)
    return hits.withWatermark(time, LATE).groupBy("slug").agg(F.sum(value * weight).alias("bump"))


def distinct_events(log: DataFrame, time: str = "created_at", key: str = "id") -> DataFrame:
    """Each id once, with state that the watermark bounds."""
    return log.withWatermark(time, LATE).dropDuplicatesWithinWatermark([key])


def start(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None] | None = None, table: str | None = None, mode: str = "append") -> StreamingQuery:
    """Run until the present input is used up; progress is kept in the checkpoint folder, so a restart goes on from there."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if batch:
        return writer.foreachBatch(batch).start()
    return writer.format("parquet").option("path", table).start()


def merge_batches(path: str, plan: Callable[[DataFrame], DataFrame], most: int = 50) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch's plan once, under its number, so that a repeated batch changes nothing.
    A batch of more than ``most`` changes is held for review instead."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        held = batch.count() > most
        plan(batch).write.mode("overwrite").parquet(f"{path}/{'held' if held else 'done'}/batch={number}")
        batch.unpersist()

    return run


QUARANTINE = "slug string, state string, failures int"


def quarantine(results: DataFrame, limit: int = 3) -> DataFrame:
    """From results (slug, content_hash, ok): the state of a page after each batch. Three failures on the same content quarantine it
    until the content changes."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        content, failures = state.get if state.exists else ("", 0)
        for pdf in frames:
            for h, ok in zip(pdf["content_hash"], pdf["ok"]):
                if h != content:
                    content, failures = h, 0
                failures = 0 if ok else failures + 1
        state.update((content, failures))
        yield pd.DataFrame({"slug": [key[0]], "state": ["quarantined" if failures >= limit else "active"], "failures": [failures]})

    return results.groupBy("slug").applyInPandasWithState(step, QUARANTINE, "content string, failures int", "update", GroupStateTimeout.NoTimeout)
