"""Usage events as streams: hourly buckets with a watermark, deduplication, upserts of whole buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """New JSON files below ``path``; the checkpoint remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)


def hourly_totals(events: DataFrame, late_by: str = "2 hours", ts: str = "ts", key: str = "provider_id") -> DataFrame:
    """Totals of each hour and key; events later than ``late_by`` are left out."""
    out = events.withWatermark(ts, late_by).groupBy(F.window(ts, "1 hour").alias("w"), key).agg(F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("events"))
    return out.select(F.col("w.start").alias("hour_start"), key, "total_tokens", "events")


def once_each(events: DataFrame, keys: list[str], late_by: str = "2 hours", ts: str = "ts") -> DataFrame:
    """The first event of each key; keys are forgotten after ``late_by``."""
    return events.withWatermark(ts, late_by).dropDuplicatesWithinWatermark(keys)


def bursts(events: DataFrame, key: str, gap: str = "1 second", late_by: str = "1 minute", ts: str = "ts") -> DataFrame:
    out = events.withWatermark(ts, late_by).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("events"), F.sum("total_tokens").alias("total_tokens"))
    return out.select(F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), key, "events", "total_tokens")


def store_days(events: DataFrame, target: str, checkpoint: str):
    """Write each batch into parts of ``target`` of its own, by day and batch: a batch that is written again replaces itself
    and nothing else, so a day may come in any number of batches."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(target)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_snapshots(rows: DataFrame, scope: list[str], version: str) -> DataFrame:
    """Of snapshots that came for a scope the newest one counts, whole; its rows may be in several batches."""
    newest = rows.groupBy(*scope).agg(F.max(version).alias("__newest"))
    return rows.join(newest, scope).where(F.col(version) == F.col("__newest")).drop("__newest")
