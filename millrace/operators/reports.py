"""Preflight rows, job details, display strings and counts over results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import preflight


def preflight_rows(files: DataFrame, pages: DataFrame) -> DataFrame:
    """``(job_id, name, file_type, bytes, page_count, has_text_layer, est_tokens)``.

    ``files(job_id, path, content)``; ``pages(job_id, page_index, text)``: a PDF's kind follows from its first pages.
    """
    kinds = preflight.pdf_kind(pages).withColumnRenamed("file_type", "_pdf")
    sizes = pages.groupBy("job_id").agg(F.count(F.lit(1)).alias("page_count"))
    tokens = preflight.token_estimate(pages, "job_id")
    kind = preflight.file_kind(F.col("path"), F.col("content"))
    rows = files.select("job_id", F.element_at(F.split("path", "/"), -1).alias("name"), kind.alias("_kind"), F.octet_length("content").alias("bytes"))
    rows = rows.join(kinds, "job_id", "left").join(sizes, "job_id", "left").join(tokens, "job_id", "left")
    is_pdf = F.col("_kind") == "pdf"
    return rows.select(
        "job_id", "name", F.when(is_pdf, F.coalesce("_pdf", F.lit("pdf_scanned"))).otherwise(F.col("_kind")).alias("file_type"), "bytes",
        F.coalesce("page_count", F.lit(0)).alias("page_count"), F.when(is_pdf, F.coalesce("has_text_layer", F.lit(False))).alias("has_text_layer"), F.coalesce("est_tokens", F.lit(0)).alias("est_tokens"),
    )


def rows_in_results(results: DataFrame, *keys: str) -> DataFrame:
    """Sum of the lengths of JSON arrays in ``record_json``; other and broken values count nothing."""
    n = F.coalesce(F.json_array_length("record_json"), F.lit(0))
    return results.groupBy(*keys).agg(F.coalesce(F.sum(n), F.lit(0)).alias("n_rows"))


def job_detail(jobs: DataFrame, runs: DataFrame, stages: DataFrame) -> DataFrame:
    """Each job with the numbers of its runs and stages and the time that its stages took."""
    r = runs.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("latency_ms").alias("latency_ms"))
    s = stages.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_stages"), F.sum("duration_ms").alias("stage_ms"))
    out = jobs.join(r, "job_id", "left").join(s, "job_id", "left")
    return out.fillna(0, ["n_runs", "latency_ms", "n_stages", "stage_ms"])


def short_id(x: Column) -> Column:
    """An id cut to 27 characters and an ellipsis where it has more than 28."""
    return F.when(F.length(x) > 28, F.concat(F.substring(x, 1, 27), F.lit("…"))).otherwise(x)


def status_line(status: Column, done: Column, total: Column) -> Column:
    """``partial (3/4)``; without a total the status alone."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, status).otherwise(F.concat(status, F.lit(" ("), done.cast("string"), F.lit("/"), total.cast("string"), F.lit(")")))


def utc_seconds(ts: Column) -> Column:
    """``2024-01-31T12:00:00Z``; the session's time zone is taken to be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def local_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def daily_name(ts: Column, prefix: str) -> Column:
    """File name of the day's log."""
    return F.concat(F.lit(f"{prefix}-"), F.date_format(ts, "yyyyMMdd"), F.lit(".ndjson"))


def confidence(lines: DataFrame, *keys: str) -> DataFrame:
    """Mean confidence of the lines of a page; 0 without any."""
    return lines.groupBy(*keys).agg(F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("confidence"))
