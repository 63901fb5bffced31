"""Message streams: sampling, repeats, routing by severity, expiry, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema, files_each: int = 1) -> DataFrame:
    """Parquet files that arrive under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def one_in(rows: DataFrame, counter: str, n: int = 10) -> DataFrame:
    """Every n-th message by its number."""
    return rows.filter(F.col(counter) % n == 0)


def first_of_each(rows: DataFrame, message: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each message once: over the whole history, or with ``time`` within the watermark, so that state stays bounded."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([message]) if time else rows.dropDuplicates([message])


def write_routed(rows: DataFrame, severity: str, path: str, checkpoint: str) -> StreamingQuery:
    """Messages in a folder for each severity, once for all that is there now."""
    return rows.writeStream.partitionBy(severity).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alive(rows: DataFrame, written: str, now: str | None = None, days: int = 7) -> DataFrame:
    """Cache entries no older than ``days``."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return rows.filter(F.col(written) >= at - F.expr(f"INTERVAL {days} DAYS"))


def windowed(rows: DataFrame, time: str, size: str, slide: str | None, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Counts by event-time window (an extension: the audited tools have no windows)."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return rows.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(rows: DataFrame, time: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Counts by session, ended by a gap without events (an extension)."""
    return rows.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
