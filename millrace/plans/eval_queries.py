"""Registered queries over evaluation, reports and stored jobs; the test tables stand in for jobs and their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import evaluation, reports
from .queries import query, t

def _id() -> Column:
    return F.col("doc_id")


@query
def rows_in_results(spark: SparkSession, d: str) -> DataFrame:
    cell = F.when(_id() % 4 == 0, '[{"a":1},{"a":2}]').when(_id() % 4 == 1, '{"a":1}').when(_id() % 4 == 2, "broken [").otherwise("[]")
    return reports.rows_in_results(t(spark, d, "documents").select("source", cell.alias("record_json")), "source")


@query
def page_sets(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(",", (_id() % 7).cast("string"), F.lit(" x"), F.concat(F.lit(" "), (_id() % 5).cast("string")), F.lit(""), (_id() % 7).cast("string"))
    return t(spark, d, "documents").select("doc_id", F.array_join(evaluation.page_set(text).cast("array<string>"), ",").alias("pages"))


@query
def chunk_extent(spark: SparkSession, d: str) -> DataFrame:
    pages = F.when(_id() % 6 == 0, "").otherwise(F.concat_ws(",", (_id() % 9).cast("string"), (_id() % 4).cast("string")))
    return evaluation.page_extent(t(spark, d, "documents").select(F.col("source").alias("fixture"), (_id() % 10).alias("chunk_index"), pages.alias("source_pages")))


@query
def duplicate_anchors(spark: SparkSession, d: str) -> DataFrame:
    anchor = F.when(_id() % 97 == 0, "\t ").otherwise((_id() % 97).cast("string"))
    return evaluation.duplicate_anchors(t(spark, d, "documents").select("lang", anchor.alias("anchor")), ["lang"], "anchor")


@query
def job_detail(spark: SparkSession, d: str) -> DataFrame:
    jobs = t(spark, d, "documents").groupBy(F.col("source").alias("job_id")).agg(F.count(F.lit(1)).alias("n_docs"))
    runs = t(spark, d, "conversations").select(F.concat(F.lit("src"), (F.col("conv_id") % 30).cast("string")).alias("job_id"), F.length("text").alias("latency_ms"))
    stages = t(spark, d, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 12).cast("string")).alias("job_id"), F.floor(F.coalesce("value", F.lit(0.0))).cast("long").alias("duration_ms"))
    return reports.job_detail(jobs, runs, stages)


@query
def display_strings(spark: SparkSession, d: str) -> DataFrame:
    whole = hashing.contract_id(F.col("lang"), F.col("source"), F.lit("m:C"))
    name = F.when(_id() % 3 == 0, F.substring(whole, 1, 28)).otherwise(whole)
    return t(spark, d, "documents").select("doc_id", reports.short_id(name).alias("shown"), reports.status_line(F.lit("partial"), _id() % 5, _id() % 7).alias("status"))


@query
def timestamps(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return t(spark, d, "events").select("event_id", reports.utc_seconds(ts).alias("utc"), reports.local_millis(ts).alias("local"), reports.daily_name(ts, "log").alias("file"))


@query
def confidence_mean(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "events").select("user_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("confidence"))
    return reports.confidence(lines, "user_id")


@query
def preflight_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").withColumn("job_id", _id().cast("string"))
    suffix = F.when(_id() % 3 == 0, "PDF").when(_id() % 3 == 1, "xlsx").otherwise("bin")
    files = docs.select("job_id", F.concat(F.lit("/d/"), "source", F.lit("/"), "job_id", F.lit("."), suffix).alias("path"), F.encode("text", "UTF-8").alias("content"))
    pages = docs.where(_id() % 10 > 0).select("job_id", F.lit(0).alias("page_index"), "text")
    return reports.preflight_rows(files, pages)


@query
def golden_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select(F.col("source").alias("fixture"), _id().alias("exp_id"), F.when(_id() % 4 < 3, _id()).alias("chunk_index"), F.when(_id() % 4 == 3, F.array(F.lit(1))).alias("pages"))
    given = lambda what, where: t(spark, d, "documents").where(where).select(F.col("source").alias("fixture"), _id().alias("exp_id"), _id().alias("chunk_index"), F.lit(what).alias("golden_json"))
    lines = given("[3]", "doc_id % 2 = 0 AND source <> 'src1'")
    out = evaluation.with_golden(docs, given("[1]", "doc_id % 3 = 0"), given("[2]", "doc_id % 5 = 0"), lines)
    return out.select("fixture", "exp_id", "golden_json", F.col("golden_problem").isNotNull().alias("has_problem"))


def _suite(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every document is an expectation of one chunk, by index or by page."""
    docs = t(spark, d, "documents").withColumn("fixture", F.col("source"))
    by_page = _id() % 23 == 0
    expectations = docs.select(
        "fixture", _id().alias("exp_id"), F.when(_id() % 5 == 0, "negative").otherwise("positive").alias("label"), (_id() % 2 == 0).alias("allow_empty"),
        F.when(~by_page, _id()).alias("chunk_index"), F.when(by_page, F.array(_id().cast("int"))).alias("pages"),
    )
    record = F.array(F.struct(_id().alias("id"), F.col("lang"), F.col("n_chars").alias("n")))
    cell = F.when(_id() % 11 == 0, "not json").when(_id() % 17 == 0, "[]").otherwise(F.to_json(record))
    columns = ["fixture", _id().alias("chunk_index"), cell.alias("record_json"), (_id() % 13 > 0).alias("validation_passed"), _id().cast("string").alias("source_pages")]
    results = docs.where(_id() % 7 > 0).select(*columns, F.lit(2).alias("seq"))
    stale = docs.where(_id() % 21 == 1).select(*columns, F.lit(1).alias("seq")).withColumn("record_json", F.lit("stale"))
    wanted = F.struct(_id().alias("id"), F.when(_id() % 4 == 0, "zz").otherwise(F.col("lang")).alias("lang"), F.col("n_chars").alias("n"))
    golden = F.when(_id() % 19 == 0, '["x"]').otherwise(F.to_json(wanted))
    inline = docs.where(_id() % 3 != 1).select("fixture", _id().alias("chunk_index"), golden.alias("golden_json"))
    nothing = docs.limit(0).select("fixture", _id().alias("exp_id"), _id().alias("chunk_index"), F.lit("").alias("golden_json"))
    return evaluation.score(expectations, results.unionByName(stale), (inline, nothing, nothing))


@query
def score_fixtures(spark: SparkSession, d: str) -> DataFrame:
    return _suite(spark, d)[0]


@query
def score_fields(spark: SparkSession, d: str) -> DataFrame:
    return _suite(spark, d)[1]


@query
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.summary(*_suite(spark, d))
