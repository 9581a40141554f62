"""Seeded synthetic tables: rows are functions of their number, so any size is one distributed plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAKES = ("Aster", "Borealis", "Cobalt", "Delta", "Ember")


def _draw(row: Column, seed: int, salt: str, n: int) -> Column:
    """A number from 0 to n - 1."""
    return F.pmod(F.xxhash64(row, F.lit(seed), F.lit(salt)), F.lit(n))


def fleet(spark: SparkSession, rows: int = 1500, seed: int = 1, null_percent: int = 5) -> DataFrame:
    """``(row, make, year, vin, value)``; about ``null_percent`` of makes, years and numbers are null."""
    row = F.col("row")
    some = lambda salt, value: F.when(_draw(row, seed, f"null {salt}", 100) >= null_percent, value)
    return spark.range(rows).withColumnRenamed("id", "row").select(
        "row", some("make", F.element_at(F.lit(list(MAKES)), (_draw(row, seed, "make", len(MAKES)) + 1).cast("int"))).alias("make"), some("year", (2000 + _draw(row, seed, "year", 25)).cast("int")).alias("year"),
        some("vin", F.upper(F.substring(F.md5(F.concat_ws(":", row.cast("string"), F.lit(str(seed)))), 1, 17))).alias("vin"), (5000 + _draw(row, seed, "value", 90_000)).cast("double").alias("value"),
    )


def workbook_rows(table: DataFrame, sheet: str, order: str, titles: tuple[str, ...] = ()) -> DataFrame:
    """A table as the rows of one sheet: title rows, the header, then its rows; as the workbook source gives them."""
    columns = [c for c in table.columns if c != order]
    at = lambda n, cells: (sheet, sheet, 0, n, cells)
    head = [at(n, [t]) for n, t in enumerate(titles)] + [at(len(titles), columns)]
    schema = "path string, sheet string, sheet_index int, row int, cells array<string>"
    body = table.select(F.lit(sheet).alias("path"), F.lit(sheet).alias("sheet"), F.lit(0).alias("sheet_index"), (F.col(order) + len(titles) + 1).cast("int").alias("row"), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("cells"))
    return table.sparkSession.createDataFrame(head, schema).unionByName(body)


def policy_pages(spark: SparkSession, pages: int = 15, seed: int = 1, on_first: int = 5) -> DataFrame:
    """``(job_id, page_index, text)``: vehicles on the first page, endorsements of seeded length after it."""
    cars = fleet(spark, on_first, seed, 0).select(F.lit(0).alias("page_index"), "row", F.concat(F.lit("Vehicle "), (F.col("row") + 1).cast("string"), F.lit("\nMake: "), "make", F.lit("\nYear: "), F.col("year").cast("string"), F.lit("\nVIN: "), "vin").alias("line"))
    page = F.col("page_index")
    notes = spark.range(1, pages).select(F.col("id").cast("int").alias("page_index"))
    notes = notes.select("page_index", F.lit(0).cast("long").alias("row"), F.concat(F.lit("Endorsement "), page.cast("string"), F.lit("\n"), F.repeat(F.lit("The terms above stay in force. "), (_draw(page, seed, "length", 40) + 1).cast("int"))).alias("line"))
    lines = cars.unionByName(notes)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n\n")
    return lines.groupBy("page_index").agg(text.alias("text")).select(F.lit("policy").alias("job_id"), "page_index", "text")
