"""Incremental monitoring: the batch monitor's counts as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """Events as they arrive as Parquet files; ts becomes a zoned timestamp, which watermarks need."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_alerts(events: DataFrame, size: str = "1 day", late: str = "1 day", threshold: float = 50.0) -> DataFrame:
    """By window and event type: rows, total and mean value, and whether the mean passes the threshold. Rows later than ``late`` are dropped by the watermark."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    rows = g.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    mean = F.col("cents") / 100.0 / F.col("n")
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", (F.col("cents") / 100.0).alias("total"), mean.alias("mean"), (mean >= threshold).cast("int").alias("alert"))


def sliding_alerts(events: DataFrame, size: str = "3 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """By overlapping window and event type: rows, users (approximately, as exact distinct counts need all of a window's rows) and total value; each event counts in every window that holds it."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type")
    rows = g.agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "users", (F.col("cents") / 100.0).alias("total"))


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, however often it is delivered: what has been seen is kept until the watermark passes its time, so the state is bounded. Rows later than that are dropped."""
    return events.withWatermark("ts", late).dropDuplicates(["event_id", "ts"])


def all_windows(stream: DataFrame, path: str) -> None:
    """All that has arrived, windows still open too, to Parquet under ``path``: each run's batch replaces the last one's, so only the newest state is there."""

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    stream.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finished windows to Parquet, exactly once, from where the checkpoint says."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """By user and session (events less than ``gap`` apart): start, end, events, total value."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    rows = g.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", (F.col("cents") / 100.0).alias("total"))


def with_limits(events: DataFrame, limits: DataFrame) -> DataFrame:
    """A stream against a static table: events above their type's limit (event_type, high)."""
    return events.join(F.broadcast(limits), "event_type").filter(F.col("value") > F.col("high"))


def cusum_alarms(events: DataFrame, centre: float, slack: float, limit: float) -> DataFrame:
    """By user: an alarm whenever the running sum of (value - centre - slack), never below 0, passes ``limit``; it then starts anew.

    The sum is the user's keyed state, kept from batch to batch; within a batch a user's events are taken in the order of time.
    """

    def advance(key, batches, state):
        import pandas as pd

        total = state.get[0] if state.exists else 0.0
        found: list[tuple] = []
        for rows in batches:
            for e in rows.sort_values(["ts", "event_id"]).itertuples():
                total = max(0.0, total + e.value - centre - slack)
                if total > limit:
                    found.append((key[0], e.event_id, e.ts, total))
                    total = 0.0
        state.update((total,))
        yield pd.DataFrame(found, columns=["user_id", "event_id", "ts", "total"])

    return events.groupBy("user_id").applyInPandasWithState(advance, "user_id long, event_id long, ts timestamp, total double", "total double", "append", "NoTimeout")
