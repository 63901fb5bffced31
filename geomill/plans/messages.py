"""Message queries: events as messages; the batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.plans.registry import query
from geomill.session import table
from geomill.streaming import messages


@query("SELECT event_id, event_type FROM events WHERE event_id % 10 = 0")
def sampled_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.one_in(table(spark, sf_dir, "events"), "event_id").select("event_id", "event_type")


@query("SELECT DISTINCT props FROM events")
def distinct_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.first_of_each(table(spark, sf_dir, "events"), "props").select("props")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1")
def messages_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def alive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return messages.alive(events, "ts", str(events.agg(F.max("ts")).first()[0])).select("event_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.windowed(table(spark, sf_dir, "events"), "ts", "1 hour", None, ["event_type"])


@query("SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) = 1")
def last_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    best = rows.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return rows.join(best, ["conv_id", "turn"]).groupBy("conv_id", "turn").agg(F.min("text").alias("text"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))
