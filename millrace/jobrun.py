"""Running extraction jobs over a :class:`~millrace.store.Store`: run, resume, retry and status.

A call takes all files at once: each becomes a job, and every step is one plan over all of them. The one step that is
not a plan, the backend's calls, is written to ``outcomes`` before anything is derived from it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import hashing
from .operators import chunking, extraction, jobs, preflight
from .sources import documents
from .store import Store

REUSE_KEYS = ["content_sha256", "schema_name", "pages_spec", "model"]


@contextmanager
def stage(store: Store, job_ids: DataFrame, name: str, detail: str = "") -> Iterator[None]:
    """Record how long a step took, for each job that took part; a step that fails leaves its row, too."""
    began = time.time()
    try:
        yield
    finally:
        ended = time.time()
        moment = lambda x: F.timestamp_seconds(F.lit(x))
        store.append("stages", job_ids.select("job_id", F.lit(name).alias("stage"), moment(began).alias("started_at"), moment(ended).alias("ended_at"), F.lit(int((ended - began) * 1000)).alias("duration_ms"), F.lit(detail).alias("detail")))


def _written(store: Store, outcomes: DataFrame, kind: str) -> DataFrame:
    """Write outcomes under a mark of their own and read them back: later steps must not call the backend again."""
    mark = f"{kind}:{uuid.uuid4().hex}"
    store.append("outcomes", outcomes.withColumn("kind", F.lit(mark)))
    return store.read("outcomes").where(F.col("kind") == mark)


def _close(store: Store, job_ids: DataFrame) -> None:
    """Status of each job from its chunks: all done, some, or none."""
    done = store.results().groupBy("job_id").agg(F.count(F.lit(1)).alias("completed_chunks"))
    now = store.jobs().join(job_ids.select("job_id").distinct(), "job_id").join(done, "job_id", "left").fillna(0, ["completed_chunks"])
    now = now.withColumn("failed_chunks", F.coalesce("total_chunks", F.lit(0)) - F.col("completed_chunks"))
    status = jobs.job_status(now)
    done_at = F.when(status == "completed", F.current_timestamp())
    store.append("jobs", now.withColumn("status", status).withColumn("completed_at", done_at).withColumn("seq", F.lit(9)))


def _finish(store: Store, outcomes: DataFrame) -> None:
    store.append("dead_letters", extraction.dead_letters(outcomes))
    _close(store, outcomes)


def run(
    store: Store, path: str, schema_name: str, fields: list[extraction.Field], backend: Callable[[], extraction.Backend], *, model: str = "", pages_spec: str | None = None,
    force: bool = False, max_retries: int = 2, workers: int = 4, ocr: documents.Ocr | None = None,
) -> DataFrame:
    """Extract records from the files at ``path``; gives the jobs as they stand, reused ones among them."""
    spark = store.spark
    spec = (pages_spec or "").strip()
    preflight.parse_pages_spec(spec)
    files = documents.files(spark, path).withColumn("content_sha256", F.sha2("content", 256))
    keys = {"schema_name": schema_name, "pages_spec": spec, "model": model}
    known = jobs.reusable_jobs(store.jobs().withColumnRenamed("job_id", "id"), REUSE_KEYS)
    for column, value in keys.items():
        known = known.where(F.col(column) == value)
    batch = uuid.uuid4().hex[:12]
    name = F.concat(F.lit(f"{batch}-"), F.substring(F.sha2("path", 256), 1, 16))
    fresh = files if force else files.join(known.select("content_sha256"), "content_sha256", "left_anti")
    fresh = fresh.withColumns({"job_id": name, "file_type": preflight.file_kind(F.col("path"), F.col("content"))}).withColumns({c: F.lit(v) for c, v in keys.items()})
    started = fresh.withColumns({"status": F.lit("normalizing"), "created_at": F.current_timestamp()})
    store.append("jobs", started)
    mine = store.jobs().where(F.col("job_id").startswith(batch))

    with stage(store, mine, "normalization"):
        given = fresh.select(F.col("job_id").alias("path"), "content", "file_type")
        sheets = documents.workbook_pages(documents.workbook_rows(given.where("file_type = 'excel'")))
        texts = documents.pdf_pages(given.where("file_type = 'pdf'"), ocr).select("path", "page_index", "text")
        pages = preflight.select_pages(sheets.unionByName(texts).withColumnRenamed("path", "job_id"), spec)
        store.append("pages", pages)
    with stage(store, mine, "chunking"):
        stored = store.read("pages").where(F.col("job_id").startswith(batch))
        store.append("chunks", chunking.chunk_pages(stored))
    chunks = store.read("chunks").where(F.col("job_id").startswith(batch))

    schema_json = hashing.canonical_json_schema(extraction.json_schema(fields))
    prompt = hashing.prompt_version_of(extraction.SYSTEM_PROMPT, extraction.USER_TEMPLATE)
    contract = spark.range(1).select(F.lit(schema_json).alias("schema_json"), F.lit(prompt).alias("prompt_version"), F.lit(schema_name).alias("schema_name"))
    contract = contract.withColumn("contract_id", hashing.contract_id(F.col("schema_json"), F.col("prompt_version"), F.col("schema_name")))
    store.append("contracts", jobs.insert_missing(store.read("contracts"), contract, ["contract_id"]))
    sizes = chunks.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_chunks"))
    bound = mine.drop("contract_id", "total_chunks").crossJoin(F.broadcast(contract.select("contract_id"))).join(sizes, "job_id", "left").fillna(0, ["total_chunks"])
    store.append("jobs", bound.withColumn("status", F.lit("extracting")).withColumn("seq", F.lit(1)))

    with stage(store, mine, "extraction"):
        outcomes = _written(store, extraction.extract(chunks, backend, fields, max_retries, workers=workers), "extraction")
    _finish(store, outcomes)
    _close(store, mine.select("job_id"))  # jobs without chunks, too
    again = known.join(files.select("content_sha256"), "content_sha256", "left_semi").select(F.col("id").alias("job_id")) if not force else mine.limit(0).select("job_id")
    wanted = store.jobs().where(F.col("job_id").startswith(batch)).select("job_id").unionByName(again)
    return store.jobs().join(wanted, "job_id", "left_semi")


def resume(store: Store, job_id: str, fields: list[extraction.Field], backend: Callable[[], extraction.Backend], max_retries: int = 2, workers: int = 4) -> DataFrame:
    """Extract the chunks of a job that have no result yet."""
    job = store.jobs().where(F.col("job_id") == job_id).first()
    if job is None:
        raise ValueError(f"no job {job_id}")
    if job.status == "completed":
        raise ValueError(f"job {job_id} is complete")
    chunks = store.read("chunks").where(F.col("job_id") == job_id)
    n = chunks.count()
    if not n or n != (job.total_chunks or n):
        raise ValueError(f"job {job_id} has {n} stored chunks and should have {job.total_chunks}")
    mine = store.jobs().where(F.col("job_id") == job_id)
    with stage(store, mine, "extraction", "resume"):
        outcomes = _written(store, extraction.extract(jobs.pending_chunks(chunks, store.results()), backend, fields, max_retries, workers=workers), "resume")
    store.append("dead_letters", extraction.dead_letters(outcomes))
    _replayed(store, outcomes)
    _close(store, mine)
    return store.jobs().where(F.col("job_id") == job_id)


def _replayed(store: Store, outcomes: DataFrame) -> None:
    """Dead letters whose chunk is complete by now wait no longer."""
    done = outcomes.where("outcome = 'completed'").select("job_id", "chunk_index")
    closed = store.dead_letters("pending").drop("at").join(done, ["job_id", "chunk_index"], "left_semi")
    store.append("dead_letters", closed.withColumn("status", F.lit("replayed")).withColumn("seq", F.lit(1)))


def retry(store: Store, fields: list[extraction.Field], backend: Callable[[], extraction.Backend], job_id: str | None = None, max_retries: int = 2) -> DataFrame:
    """Ask again for pending dead letters; gives the outcomes. Jobs that are whole by now become complete."""
    dead = store.dead_letters("pending")
    dead = dead if job_id is None else dead.where(F.col("job_id") == job_id)
    outcomes = _written(store, extraction.retry(dead, store.read("chunks"), backend, fields, max_retries), "retry")
    _replayed(store, outcomes)
    whole = jobs.promotable(store.jobs(), store.results(), store.dead_letters())
    store.append("jobs", whole.withColumns({"status": F.lit("completed"), "completed_at": F.current_timestamp(), "seq": F.lit(9)}))
    return outcomes


def missing_chunks(store: Store) -> DataFrame:
    """Pending dead letters whose chunk is not stored: a retry cannot reach them."""
    return store.dead_letters("pending").join(store.read("chunks").select("job_id", "chunk_index"), ["job_id", "chunk_index"], "left_anti")


def records(store: Store, job_id: str | None = None) -> DataFrame:
    """``(job_id, chunk_index, i, record)``: each extracted record as JSON."""
    rows = store.results() if job_id is None else store.results().where(F.col("job_id") == job_id)
    return rows.select("job_id", "chunk_index", F.posexplode(F.from_json("record_json", "array<string>")).alias("i", "record"))
