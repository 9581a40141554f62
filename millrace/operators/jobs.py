"""Job bookkeeping over append-only tables: reuse, resume, retry and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; a per-key limit that is applied before the shuffle, too."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def reusable_jobs(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """The latest completed job of each key; jobs without a content hash are never reused."""
    done = jobs.where((F.col("status") == "completed") & (F.coalesce("content_sha256", F.lit("")) != ""))
    done = done.withColumns({c: F.coalesce(c, F.lit("")) for c in keys})
    return latest(done, keys, [F.col("completed_at").desc(), F.col("created_at").desc(), F.col("id").desc()])


def pending_chunks(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks without a result row."""
    return chunks.join(results.select("job_id", "chunk_index").distinct(), ["job_id", "chunk_index"], "left_anti")


def job_status(counts: DataFrame) -> Column:
    """From ``completed_chunks`` and ``failed_chunks``: no failure is completed, also with no chunks at all."""
    return F.when(F.col("failed_chunks") == 0, "completed").when(F.col("completed_chunks") > 0, "partial").otherwise("failed")


def promotable(jobs: DataFrame, results: DataFrame, dead_letters: DataFrame) -> DataFrame:
    """Jobs that a retry completes: partial or failed, nothing pending, a result for every chunk."""
    done = results.groupBy("job_id").agg(F.countDistinct("chunk_index").alias("n_done"))
    waiting = dead_letters.where(F.col("status") == "pending").select("job_id").distinct()
    open_jobs = jobs.where(F.col("status").isin("partial", "failed")).join(waiting, "job_id", "left_anti")
    return open_jobs.join(done, "job_id", "left").where(F.coalesce("n_done", F.lit(0)) == F.col("total_chunks")).drop("n_done")


def numbered_attempts(runs: DataFrame, keys: list[str], order: list[str], first: str = "extraction") -> DataFrame:
    """``attempt``, ``run_type``, ``is_last`` and ``validation_passed``: only a last attempt without error passes."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = runs.withColumn("attempt", F.row_number().over(w)).withColumn("is_last", F.lead(F.lit(1)).over(w).isNull())
    return out.withColumn("run_type", F.when(F.col("attempt") == 1, first).otherwise("repair")).withColumn(
        "validation_passed", F.col("is_last") & F.col("error").isNull()
    )


def insert_missing(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet, one each: insert or ignore."""
    return new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")


def delete_jobs(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables keyed by ``job_id`` without the rows of ``gone(job_id)``."""
    return {name: df.join(gone.select("job_id"), "job_id", "left_anti") for name, df in tables.items()}
