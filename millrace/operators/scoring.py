"""Scoring results against golden records: pairing, addressing, verdicts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compare import compare
from ..functions.text import is_absent


def pair_by_anchor(golden: DataFrame, actual: DataFrame, keys: list[str], anchor: str, order: list[str]) -> DataFrame:
    """Full outer pairs on (keys, anchor, ordinal): equal anchors pair first come, first served.

    Rows without an anchor never pair; they bypass the join. Payload columns get the prefixes ``g_`` and ``a_``.
    """

    def side(df: DataFrame, mark: str) -> tuple[DataFrame, DataFrame]:
        place = F.row_number().over(Window.partitionBy(*keys, anchor).orderBy(*order))
        payload = [F.col(c).alias(f"{mark}_{c}") for c in df.columns if c not in keys]
        gone = is_absent(F.col(anchor).cast("string"))
        with_anchor = df.where(~gone).withColumn("_n", place).select(*keys, F.col(anchor).cast("string").alias("_anchor"), "_n", *payload, F.lit(True).alias(f"_{mark}"))
        return with_anchor, df.where(gone).select(*keys, *payload)

    g, g_loose = side(golden, "g")
    a, a_loose = side(actual, "a")
    state = F.when(F.col("_g") & F.col("_a"), "paired").when(F.col("_g"), "missing").otherwise("extra")
    joined = g.join(a, [*keys, "_anchor", "_n"], "full").withColumn("pairing", state).drop("_anchor", "_n", "_g", "_a")
    loose = g_loose.withColumn("pairing", F.lit("missing")).unionByName(a_loose.withColumn("pairing", F.lit("extra")), allowMissingColumns=True)
    return joined.unionByName(loose, allowMissingColumns=True)


def pair_by_index(golden: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer pairs on (keys, ``i``)."""
    g = golden.select(*keys, "i", *[F.col(c).alias(f"g_{c}") for c in golden.columns if c not in (*keys, "i")], F.lit(True).alias("_g"))
    a = actual.select(*keys, "i", *[F.col(c).alias(f"a_{c}") for c in actual.columns if c not in (*keys, "i")], F.lit(True).alias("_a"))
    state = F.when(F.col("_g") & F.col("_a"), "paired").when(F.col("_g"), "missing").otherwise("extra")
    return g.join(a, [*keys, "i"], "full").withColumn("pairing", state).drop("_g", "_a")


def field_diffs(pairs: DataFrame, keys: list[str], fields: list[str], hint: str | None = None) -> DataFrame:
    """One row for each pair and field: ``field, g_value, a_value, match``; extras of a whole row are ``extra``."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"g_{f}").cast("string").alias("g_value"), F.col(f"a_{f}").cast("string").alias("a_value")) for f in sorted(fields)])
    long = pairs.select(*keys, "pairing", F.inline(cells))
    return compare(long, "g_value", "a_value", hint).withColumn("match", F.when(F.col("pairing") == "extra", "extra").when(F.col("pairing") == "missing", "missing").otherwise(F.col("match")))


def accuracy(match: Column) -> Column:
    """Share of exact and normalized among diffs that are not errors; null without any."""
    good, counted = F.count_if(match.isin("exact", "normalized")), F.count_if(match != "error")
    return F.try_divide(good, counted)


def resolve_ranges(asked: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """``(key, range_id, reason, chunk_index)``: chunks within the asked pages, else chunks that hold them all.

    ``asked(key, range_id, pages)`` meets ``chunks(key, chunk_index, chunk_pages)`` page by page and not range by chunk: the
    pages that both have are counted, and a side of which all are counted lies within the other. Chunks of the same pages
    are one row with their number. No pages at all lie within every chunk that has some.
    """
    sets = chunks.where(F.size("chunk_pages") > 0).groupBy(key, F.array_sort(F.array_distinct("chunk_pages")).alias("_set")).agg(F.count(F.lit(1)).alias("_n"), F.min("chunk_index").alias("_c"))
    ranges = asked.where(F.size("pages") > 0).select(key, "range_id", F.array_sort(F.array_distinct("pages")).alias("_set"))
    # ids may repeat with other pages: the place among those tells them apart
    place = lambda c: F.row_number().over(Window.partitionBy(key, c).orderBy("_set"))
    a = ranges.withColumn("_a", place("range_id")).select(key, "range_id", "_a", F.size("_set").alias("_asked"), F.explode("_set").alias("_page")).alias("a")
    b = sets.withColumn("_b", place("_c")).select(key, "_c", "_b", "_n", F.size("_set").alias("_held"), F.explode("_set").alias("_page")).alias("b")
    met = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & F.col("a._page").eqNullSafe(F.col("b._page"))).groupBy(F.col(f"a.{key}").alias(key), "range_id", "_a", "_c", "_b")
    met = met.agg(F.count(F.lit(1)).alias("_both"), F.max("_asked").alias("_asked"), F.max("_held").alias("_held"), F.max("_n").alias("_n"))
    inside, holds = F.col("_both") == F.col("_held"), F.col("_both") == F.col("_asked")
    fits = met.where(inside | holds).select(
        key, "range_id", F.when(inside, F.col("_n")).alias("n1"), F.when(inside, F.col("_c")).alias("c1"), F.when(holds, F.col("_n")).alias("n2"), F.when(holds, F.col("_c")).alias("c2")
    )
    every = sets.groupBy(key).agg(F.sum("_n").alias("n2"), F.min("_c").alias("c2"))
    empty = asked.where(F.size("pages") == 0).select(key, "range_id").join(every, key)
    agg = asked.select(key, "range_id").unionByName(fits, allowMissingColumns=True).unionByName(empty, allowMissingColumns=True).groupBy(key, "range_id")
    agg = agg.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("n1", "n2")], *[F.min(c).alias(c) for c in ("c1", "c2")])
    n = F.when(F.col("n1") > 0, F.col("n1")).otherwise(F.col("n2"))
    c = F.when(F.col("n1") > 0, F.col("c1")).otherwise(F.col("c2"))
    reason = F.when(n == 0, "page_range_unresolved").when(n > 1, "page_range_ambiguous").otherwise("resolved")
    return agg.select(key, "range_id", reason.alias("reason"), F.when(n == 1, c).alias("chunk_index"))


def reason() -> Column:
    """Verdict of one expectation over ``label, allow_empty, present, parse_error, validated, n_records, golden_error,
    has_golden, fields_ok``."""
    c = F.col
    negative = (
        F.when(~c("present"), "correct_abstention").when(c("parse_error"), "record_json_parse_error").when(~c("validated"), "correct_abstention")
        .when((c("n_records") == 0) & c("allow_empty"), "correct_abstention").otherwise("false_positive")
    )
    positive = (
        F.when(~c("present"), "missing_chunk_in_results").when(c("parse_error"), "record_json_parse_error").when(~c("validated"), "schema_reject")
        .when(c("n_records") == 0, "missing_output").when(c("golden_error"), "golden_parse_error").when(~c("has_golden"), "schema_pass_no_golden")
        .when(c("fields_ok"), "match").otherwise("field_mismatch")
    )
    return F.when(c("label") == "negative", negative).otherwise(positive)


def passed(reason: Column) -> Column:
    return reason.isin("correct_abstention", "schema_pass_no_golden", "match")


def summary(scored: DataFrame, *keys: str) -> DataFrame:
    """Totals by label, false-positive rate and whether all is well, of ``scored(label, reason)``."""
    ok, negative = passed(F.col("reason")), F.col("label") == "negative"
    count = lambda x: F.count_if(x)
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), count(ok).alias("passed"), count(negative).alias("negatives"), count(negative & ok).alias("negatives_passed"),
        count(~negative & ok).alias("positives_passed"), F.round(F.try_divide(count(F.col("reason") == "false_positive"), count(negative)), 6).alias("false_positive_rate"),
        (F.every(ok) & (F.count(F.lit(1)) > 0)).alias("overall_ok"),
    )
