"""The log as a stream: double-encoded JSON lines, validated and summed by stage and window.

An extension: the log is written line by line, so it can be followed as it grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.telemetry import event_problem

SCHEMA = (
    "schema_version string, ts timestamp, event string, job_id string, trace_id string, stage string, duration_ms long, rss_bytes long, chunk_index int, "
    "model string, tokens_in long, tokens_out long, status string, bench_run_id string, workload string"
)


def parse(lines: DataFrame) -> DataFrame:
    """Events of ``lines(value)``; an event may be the line itself or text in its ``message``."""
    body = F.coalesce(F.get_json_object("value", "$.message"), F.col("value"))
    body = F.when(F.get_json_object("value", "$.event").isNotNull(), F.col("value")).otherwise(body)
    return lines.select(F.from_json(body, SCHEMA).alias("e")).select("e.*").withColumn("problem", event_problem())


def follow(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.readStream.text(path))


def by_stage(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events, time and peak memory by window and stage; works on tables and streams."""
    good = events.where("problem IS NULL").withWatermark("ts", late)
    return good.groupBy(F.window("ts", width), "stage").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("duration_ms"), F.max("rss_bytes").alias("peak_rss"))
