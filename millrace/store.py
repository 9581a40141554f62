"""Tables of jobs and what they made: append-only Parquet folders, read through views of the latest rows.

Nothing is updated in place: a changed status is another row, and readers take the last. Every write is one batch for
all jobs at hand, and its rows carry the moment it was made.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import jobs as ops

#: Columns of each table. ``seq`` orders the rows of one key within one write.
TABLES = {
    "jobs": "job_id string, path string, content_sha256 string, schema_name string, pages_spec string, model string, contract_id string, file_type string, status string, total_chunks long, created_at timestamp, completed_at timestamp, at timestamp, seq int",
    "pages": "job_id string, page_index int, text string",
    "chunks": "job_id string, chunk_index int, text string, source_pages array<int>, estimated_tokens long",
    "contracts": "contract_id string, schema_json string, prompt_version string, schema_name string, at timestamp",
    "outcomes": "job_id string, chunk_index int, outcome string, record_json string, error string, retry_count int, runs array<struct<attempt:int,run_type:string,model:string,tokens_in:long,tokens_out:long,latency_ms:long,validation_passed:boolean,raw_output:string>>, kind string, at timestamp",
    "dead_letters": "job_id string, chunk_index int, last_error string, retry_count int, status string, at timestamp, seq int",
    "stages": "job_id string, stage string, started_at timestamp, ended_at timestamp, duration_ms long, detail string",
}


class Store:
    """The tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def init(self) -> None:
        """Make the tables that are not there."""
        for name in TABLES:
            if not self._exists(name):
                self.spark.createDataFrame([], TABLES[name]).write.parquet(self.path(name))

    def _exists(self, name: str) -> bool:
        try:
            self.spark.read.parquet(self.path(name))
            return True
        except AnalysisException:
            return False

    def read(self, name: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(self.path(name))

    def append(self, name: str, rows: DataFrame) -> None:
        """Add ``rows``; missing columns are null, ``at`` is now."""
        columns = self.spark.createDataFrame([], TABLES[name]).schema
        have = {c.lower() for c in rows.columns}
        default = {"at": F.current_timestamp(), "seq": F.lit(0)}
        out = rows.select(*[(F.col(f.name) if f.name in have else default.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in columns])
        out.write.mode("append").parquet(self.path(name))

    def jobs(self) -> DataFrame:
        """Each job as it stands, the newest first."""
        last = ops.latest(self.read("jobs"), ["job_id"], [F.col("at").desc(), F.col("seq").desc()])
        return last.drop("at", "seq").orderBy(F.col("created_at").desc(), "job_id")

    def results(self) -> DataFrame:
        """``(job_id, chunk_index, record_json, at)`` of completed chunks, the last outcome of each, by chunk."""
        done = self.read("outcomes").where("outcome = 'completed'")
        last = ops.latest(done, ["job_id", "chunk_index"], [F.col("at").desc()])
        return last.select("job_id", "chunk_index", "record_json", "at").orderBy("job_id", "chunk_index")

    def runs(self) -> DataFrame:
        """Every call of the backend, by chunk and time."""
        return self.read("outcomes").select("job_id", "chunk_index", "at", F.inline("runs")).orderBy("job_id", "chunk_index", "at", "attempt")

    def dead_letters(self, status: str | None = None) -> DataFrame:
        last = ops.latest(self.read("dead_letters"), ["job_id", "chunk_index"], [F.col("at").desc(), F.col("seq").desc()]).drop("seq")
        return (last if status is None else last.where(F.col("status") == status)).orderBy("job_id", "chunk_index")

    def stages(self) -> DataFrame:
        return self.read("stages").orderBy("job_id", "started_at")

    def delete(self, gone: DataFrame) -> None:
        """Remove the jobs ``gone(job_id)`` and all that hangs on them; contracts stay."""
        names = [n for n, columns in TABLES.items() if columns.startswith("job_id ") and self._exists(n)]
        kept = ops.delete_jobs({n: self.read(n) for n in names}, gone)
        for name, rows in kept.items():  # written beside, then put in place, as a table cannot be read and overwritten at once
            rows.write.mode("overwrite").parquet(self.path(f"{name}_new"))
        for name in names:
            self.spark.read.schema(TABLES[name]).parquet(self.path(f"{name}_new")).write.mode("overwrite").parquet(self.path(name))
