"""Call statistics, bench metrics and log-event validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Event names of the log schema and the fields that each needs beside version and name.
EVENTS = {
    "stage.start": ("stage",),
    "stage.end": ("stage",),
    "rss.sample": ("stage", "rss_bytes"),
    "chunk.done": ("chunk_index",),
    "llm.call": ("model", "tokens_in", "tokens_out"),
    "job.start": (),
    "job.end": ("status",),
    "bench.workload.start": ("bench_run_id", "workload"),
    "bench.workload.end": ("bench_run_id", "status"),
    "bench.summary": ("bench_run_id",),
}


def run_stats(runs: DataFrame, *keys: str) -> DataFrame:
    """Counts, token sums and latencies of ``runs``; without keys one total row."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), total("tokens_in").alias("tokens_in"), total("tokens_out").alias("tokens_out"), total("latency_ms").alias("latency_sum"),
        F.round(F.avg("latency_ms"), 6).alias("latency_avg"), F.min("latency_ms").alias("latency_min"), F.max("latency_ms").alias("latency_max"),
        F.count_if(F.col("run_type") == "repair").alias("repairs"), F.count_if(~F.col("validation_passed")).alias("failures"),
    )


def pass_rate(passed: Column) -> Column:
    """Share of passing runs; 1 without runs."""
    return F.coalesce(F.try_divide(F.count_if(passed), F.count(F.lit(1))), F.lit(1.0))


def per_minute(n: Column, seconds: Column) -> Column:
    """Null when nothing was done or no time passed."""
    return F.when((n > 0) & (seconds > 0), n * 60 / seconds)


def overhead_percent(plain: Column, dual: Column) -> Column:
    return F.when(plain > 0, (dual - plain) / plain * 100).otherwise(0.0)


def is_regression(workload: Column, percent: Column) -> Column:
    return (workload == "pdf_text_small") & (percent > 10.0)


def event_problem(events: dict[str, tuple[str, ...]] | None = None) -> Column:
    """What is wrong with a flat log event, null if nothing: version, name, then missing fields."""
    events = EVENTS if events is None else events
    missing = F.lit(None).cast("string")
    for name, needs in events.items():
        gone = F.lit(False)
        for c in needs:
            gone = gone | F.col(c).isNull()
        missing = F.when((F.col("event") == name) & gone, "missing field").otherwise(missing)
    return (
        F.when(~F.coalesce(F.col("schema_version").rlike(r"^\d+\.\d+$"), F.lit(False)), "bad version")
        .when(~F.coalesce(F.col("event").isin(*events), F.lit(False)), "unknown event")
        .when(F.col("ts").isNull(), "missing field").otherwise(missing)
    )
