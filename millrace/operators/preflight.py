"""Classifying and sizing input files, and selecting pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: File suffixes that are read.
EXCEL_SUFFIXES = ("xlsx", "xlsm", "xltx", "xltm")
SCANNED_BELOW, SAMPLE_PAGES, SAMPLE_ROWS, SAMPLE_ABOVE = 50, 5, 500, 10_000


def list_files(paths: DataFrame) -> DataFrame:
    """Rows of ``paths(path)`` with a readable suffix, sorted."""
    return paths.where(F.lower("path").rlike(rf"\.({'|'.join(EXCEL_SUFFIXES)}|pdf)$")).orderBy("path")


def file_kind(path: Column, content: Column) -> Column:
    """``excel``, ``pdf`` or ``unknown``: by suffix, else by the first bytes."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return (
        F.when(suffix.isin(*EXCEL_SUFFIXES), "excel")
        .when(suffix == "pdf", "pdf")
        .when(F.hex(F.substring(content, 1, 2)) == "504B", "excel")
        .when(F.hex(F.substring(content, 1, 4)) == "25504446", "pdf")
        .otherwise("unknown")
    )


def pdf_kind(pages: DataFrame) -> DataFrame:
    """``(job_id, file_type, has_text_layer)`` of ``pages(job_id, page_index, text)`` by their first pages' mean text."""
    first = F.when(F.col("page_index") < SAMPLE_PAGES, F.length(strip(F.col("text"))))
    mean = F.coalesce(F.avg(first), F.lit(0.0))
    return pages.groupBy("job_id").agg((mean >= SCANNED_BELOW).alias("has_text_layer")).select(
        "job_id", F.when(F.col("has_text_layer"), "pdf_text").otherwise("pdf_scanned").alias("file_type"), "has_text_layer"
    )


def token_estimate(pages: DataFrame, *keys: str) -> DataFrame:
    return pages.groupBy(*keys).agg(F.floor(F.coalesce(F.sum(F.length("text")), F.lit(0)) / 4).cast("long").alias("est_tokens"))


def sampled_estimate(rows: DataFrame, group: str, order: list[str], chars: Column) -> DataFrame:
    """Characters of a group's first rows scaled to all its rows, rounded down.

    The first rows are picked with a per-group limit that Spark applies before the shuffle.
    """
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    first = rows.withColumn("_place", place).where(F.col("_place") <= SAMPLE_ROWS)
    sampled = first.groupBy(group).agg(F.sum(chars).alias("chars"), F.count(F.lit(1)).alias("n"))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    return sizes.join(sampled, group).select(group, "rows", F.floor(F.col("chars") * F.col("rows") / F.col("n")).cast("long").alias("est_chars"))


def parse_pages_spec(spec: str | None) -> set[int] | None:
    """1-based pages of ``1,3-5``; blank means all (None)."""
    if spec is None or not spec.strip():
        return None
    pages: set[int] = set()
    for part in spec.split(","):
        low, dash, high = part.strip().partition("-")
        try:
            a, b = int(low), int(high) if dash else int(low)
        except ValueError:
            raise ValueError(f"not a page or range: {part.strip()!r}") from None
        if a < 1 or b < a:
            raise ValueError(f"not a valid range: {part.strip()!r}")
        pages.update(range(a, b + 1))
    return pages


def resolve_pages(spec: str | None, page_count: int) -> set[int] | None:
    """0-based page indexes; the smallest page out of range is reported."""
    pages = parse_pages_spec(spec)
    if pages is None:
        return None
    if bad := [p for p in pages if p > page_count]:
        raise ValueError(f"page {min(bad)} is out of range (1-{page_count})")
    return {p - 1 for p in pages}


def select_pages(pages: DataFrame, spec: str | None, column: str = "page_index", base: int = 0) -> DataFrame:
    wanted = parse_pages_spec(spec)
    return pages if wanted is None else pages.where(F.col(column).isin(sorted(p - 1 + base for p in wanted)))
