"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Where the session names no folder, one is made only if driver and executors share a machine (``local[...]``), as in
    tests; elsewhere each executor would write to its own disk, so that is an error. The checkpoint is all that later
    steps read, so the shuffle files that made it are removed at once and do not add up over a long job.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(tidy, "false")
    spark.conf.set(tidy, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under that setting
    finally:
        spark.conf.set(tidy, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text: maximal runs of anything but ASCII white space; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def spread(spark: SparkSession, least: int = 1) -> int:
    """Partitions for a shuffle that follows the session's own setting."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranked(df: DataFrame, order: list[str], parts: int) -> DataFrame:
    """``df`` with ``rank``, its place from 0 in the order of ``order``, by range partitions and not in one task.

    Equal keys are spread too if ``order`` ends in something unique.
    """
    here = settle(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = here.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        here.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn("rank", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_at", "_part", "_start")
    )
