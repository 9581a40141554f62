"""Scoring whole fixtures: what was expected of each chunk, what a job gave, and what golden records say.

Inputs are tables keyed by ``fixture``, so a suite of any number of fixtures is one plan. The verdict of each
expectation and its field differences are separate results; the summary is an aggregate over the verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compare import compare
from ..functions.json_records import is_json
from ..functions.text import is_absent, strip
from . import scoring
from .jobs import latest

#: What a golden file for a whole manifest cannot say: which of its lines a page range means.
RANGE_NEEDS_OWN_FILE = "a page range needs a golden file of its own"


def page_set(pages: Column) -> Column:
    """Pages of ``1, 2,5``, sorted; parts that are no integers are skipped, null has none."""
    numbers = F.transform(F.split(F.coalesce(pages, F.lit("")), ","), lambda x: strip(x).try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull())))


def page_extent(results: DataFrame) -> DataFrame:
    """``(fixture, chunk_index, first_page, last_page)``; chunks without pages are left out."""
    pages = results.select("fixture", "chunk_index", page_set(F.col("source_pages")).alias("p")).where(F.size("p") > 0)
    return pages.groupBy("fixture", "chunk_index").agg(F.min(F.array_min("p")).alias("first_page"), F.max(F.array_max("p")).alias("last_page"))


def records_of(text: Column) -> Column:
    """``struct(records, error)`` of a record cell: an array of objects, or one object; anything else is an error."""
    text = strip(text)
    array = F.when(F.json_array_length(text).isNotNull() & is_json(text), F.from_json(text, "array<string>"))
    one = F.when(F.json_object_keys(text).isNotNull() & is_json(text), F.array(text))
    records = F.coalesce(array, one)
    odd = F.exists(records, lambda x: x.isNull() | F.json_object_keys(x).isNull())
    error = F.when(records.isNull(), "not a JSON array or object").when(odd, "an element is not an object")
    return F.struct(F.when(error.isNull(), records).alias("records"), error.alias("error"))


def duplicate_anchors(records: DataFrame, keys: list[str], anchor: str) -> DataFrame:
    """``(keys, anchor, n)`` of anchors that several records of a group share; absent anchors don't count."""
    return records.where(~is_absent(F.col(anchor))).groupBy(*keys, anchor).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def with_golden(expectations: DataFrame, inline: DataFrame, own: DataFrame, lines: DataFrame) -> DataFrame:
    """``expectations`` with ``golden_json`` and ``golden_problem``.

    In order: records given inline for the chunk (``fixture, chunk_index, golden_json``), the expectation's own file
    (``fixture, exp_id, golden_json``), the line of the manifest's file (``fixture, chunk_index, golden_json``). Expectations of
    page ranges have no line: with a manifest's file and none of their own that is a problem.
    """
    at_chunk = inline.select("fixture", "chunk_index", F.col("golden_json").alias("_inline"))
    of_own = own.select("fixture", "exp_id", F.col("golden_json").alias("_own"))
    of_line = lines.select("fixture", "chunk_index", F.col("golden_json").alias("_line"))
    has_lines = lines.select("fixture", F.lit(True).alias("_has_lines")).distinct()
    out = expectations.join(at_chunk, ["fixture", "chunk_index"], "left").join(of_own, ["fixture", "exp_id"], "left")
    out = out.join(of_line, ["fixture", "chunk_index"], "left").join(has_lines, "fixture", "left")
    golden = F.coalesce("_inline", "_own", F.when(F.col("pages").isNull(), F.col("_line")))
    lost = golden.isNull() & F.col("pages").isNotNull() & F.coalesce("_has_lines", F.lit(False))
    return out.withColumn("golden_json", golden).withColumn("golden_problem", F.when(lost, RANGE_NEEDS_OWN_FILE)).drop("_inline", "_own", "_line", "_has_lines")


def field_differences(compared: DataFrame, match_key: str | None = None, hint: str | None = None) -> DataFrame:
    """``(fixture, exp_id, pairing, field, g_value, a_value, match)`` of ``compared(fixture, exp_id, golden, actual)``.

    Records pair by ``match_key`` (equal anchors first come, first served) or by place; a pair's fields are the union
    of its keys, in order. A whole record that is missing or extra has one row for each of its fields.
    """
    keys = ["fixture", "exp_id"]

    def side(column: str) -> DataFrame:
        rows = compared.select(*keys, F.posexplode(column).alias("i", "_json")).withColumn("cells", F.from_json("_json", "map<string,string>"))
        rows = rows.withColumn("anchor", F.col("cells")[match_key] if match_key else F.lit(None).cast("string"))
        return rows.select(*keys, "i", "anchor", "cells")

    golden, actual = side("golden"), side("actual")
    if match_key:
        pairs = scoring.pair_by_anchor(golden, actual, keys, "anchor", ["i"])
    else:
        pairs = scoring.pair_by_index(golden, actual, keys)
    none = F.expr("cast(map() as map<string,string>)")
    g, a = F.coalesce("g_cells", none), F.coalesce("a_cells", none)
    fields = F.array_sort(F.array_union(F.map_keys(g), F.map_keys(a)))
    cells = F.transform(fields, lambda f: F.struct(f.alias("field"), g[f].alias("g_value"), a[f].alias("a_value")))
    long = pairs.select(*keys, "pairing", F.inline(cells))
    whole = F.when(F.col("pairing") != "paired", F.col("pairing"))
    return compare(long, "g_value", "a_value", hint).withColumn("match", F.coalesce(whole, F.col("match")))


def score(expectations: DataFrame, results: DataFrame, goldens: tuple[DataFrame, DataFrame, DataFrame], match_key: str | None = None, hint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Verdicts ``(fixture, exp_id, label, chunk_index, reason, passed, n_golden, n_actual)`` and field differences.

    ``expectations(fixture, exp_id, label, allow_empty, chunk_index, pages)``: one of ``chunk_index`` and ``pages`` is null.
    ``results(fixture, chunk_index, record_json, validation_passed, source_pages, seq)``: of several for a chunk the last counts.
    What both results rest on is kept in Spark's cache; ``spark.catalog.clearCache()`` lets it go.
    """
    last = latest(results, ["fixture", "chunk_index"], [F.col("seq").desc()])
    asked = expectations.where("pages IS NOT NULL").select("fixture", F.col("exp_id").alias("range_id"), "pages")
    held = last.select("fixture", F.col("chunk_index").alias("chunk_index"), page_set(F.col("source_pages")).alias("chunk_pages"))
    found = scoring.resolve_ranges(asked, held, "fixture").select("fixture", F.col("range_id").alias("exp_id"), F.col("reason").alias("_range"), F.col("chunk_index").alias("_found"))
    given = with_golden(expectations, *goldens).join(found, ["fixture", "exp_id"], "left")
    given = given.withColumn("chunk_index", F.coalesce("chunk_index", "_found")).drop("_found")
    got = last.select("fixture", "chunk_index", F.lit(True).alias("_present"), records_of(F.col("record_json")).alias("_got"), "validation_passed")
    rows = given.join(got, ["fixture", "chunk_index"], "left").withColumn("_want", F.when(F.col("golden_json").isNotNull(), records_of(F.col("golden_json"))))
    parse_error = F.coalesce(F.col("_got.error").isNotNull(), F.lit(False))
    golden_error = F.coalesce(F.col("_want.error").isNotNull(), F.lit(False)) | F.col("golden_problem").isNotNull()
    rows = rows.withColumns(
        {
            "present": F.coalesce("_present", F.lit(False)), "parse_error": parse_error, "validated": F.coalesce("validation_passed", F.lit(True)),
            "n_records": F.coalesce(F.size("_got.records"), F.lit(0)), "golden_error": golden_error, "has_golden": F.col("golden_json").isNotNull(),
        }
    )
    rows = rows.persist()  # both results and every side of the pairing read it
    resolved = F.coalesce(F.col("_range"), F.lit("resolved")) == "resolved"
    comparable = resolved & F.col("present") & ~parse_error & F.col("validated") & (F.col("n_records") > 0) & F.col("has_golden") & ~golden_error & (F.col("label") == "positive")
    differences = field_differences(rows.where(comparable).select("fixture", "exp_id", F.col("_want.records").alias("golden"), F.col("_got.records").alias("actual")), match_key, hint).persist()
    fits = differences.groupBy("fixture", "exp_id").agg(F.bool_and(F.col("match").isin("exact", "normalized")).alias("_fits"))
    judged = rows.join(fits, ["fixture", "exp_id"], "left").withColumn("fields_ok", F.coalesce("_fits", F.lit(True)))
    reason = F.when(resolved, scoring.reason()).otherwise(F.col("_range"))
    verdicts = judged.select(
        "fixture", "exp_id", "label", "chunk_index", reason.alias("reason"), scoring.passed(reason).alias("passed"),
        F.coalesce(F.size("_want.records"), F.lit(0)).alias("n_golden"), "n_records",
    ).withColumnRenamed("n_records", "n_actual")
    return verdicts, differences


def summary(verdicts: DataFrame, differences: DataFrame, *keys: str) -> DataFrame:
    """Totals by label, false-positive rate, accuracy over fields and numbers of paired, missing and extra records."""
    keys = keys or ("fixture",)
    totals = scoring.summary(verdicts, *keys)
    fields = differences.groupBy(*keys).agg(F.round(scoring.accuracy(F.col("match")), 6).alias("accuracy"), F.count_if(F.col("match") == "mismatch").alias("field_mismatches"))
    return totals.join(fields, list(keys), "left")


def overall_ok(verdicts: DataFrame) -> DataFrame:
    """One row: whether there are verdicts and all pass."""
    return verdicts.agg((F.coalesce(F.every("passed"), F.lit(False)) & (F.count(F.lit(1)) > 0)).alias("overall_ok"))


def outcomes_json(verdicts: DataFrame, differences: DataFrame) -> DataFrame:
    """``(fixture, json)``: a fixture's verdicts, each with its differences that are not exact."""
    wrong = differences.where("match <> 'exact'").groupBy("fixture", "exp_id").agg(F.sort_array(F.collect_list(F.struct("field", "g_value", "a_value", "match"))).alias("diffs"))
    rows = verdicts.join(wrong, ["fixture", "exp_id"], "left")
    one = F.struct("exp_id", "label", "chunk_index", "reason", "passed", F.coalesce("diffs", F.array()).alias("diffs"))
    return rows.groupBy("fixture").agg(F.to_json(F.struct(F.sort_array(F.collect_list(one)).alias("outcomes")), {"ignoreNullFields": "false"}).alias("json"))


def anchors_missing(lines: DataFrame, match_key: str) -> DataFrame:
    """``(fixture, chunk_index)`` of golden lines with several records of which one lacks ``match_key``."""
    cells = lines.select("fixture", "chunk_index", records_of(F.col("golden_json"))["records"].alias("records")).where(F.size("records") > 1)
    lacks = F.exists("records", lambda x: is_absent(F.get_json_object(x, f"$.{match_key}")))
    return cells.where(lacks).select("fixture", "chunk_index")


def numbered(results: DataFrame, order: list[str]) -> DataFrame:
    """``results`` with ``seq``, the place of a row within its fixture."""
    return results.withColumn("seq", F.row_number().over(Window.partitionBy("fixture").orderBy(*order)))
