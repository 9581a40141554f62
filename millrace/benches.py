"""Timing registered queries, with results as JSON and CSV files."""

from __future__ import annotations

import csv
import datetime
import json
import subprocess
import time
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def measure(spark: SparkSession, queries: dict[str, Callable[[SparkSession, str], DataFrame]], folder: str) -> list[dict[str, Any]]:
    """Seconds of each query; one that fails has its error and the others go on."""
    out = []
    for name, query in queries.items():
        began = time.time()
        try:
            query(spark, folder).write.format("noop").mode("overwrite").save()
            out.append({"workload": name, "wall_s": round(time.time() - began, 3), "error": None})
        except Exception as e:  # whatever a query may raise
            out.append({"workload": name, "wall_s": None, "error": f"{type(e).__name__}: {str(e)[:200]}"})
    return out


def write(rows: list[dict[str, Any]], folder: str) -> Path:
    """``YYYYMMDD_commit.json`` and the same as CSV."""
    commit = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True).stdout.strip() or "none"
    path = Path(folder) / f"{datetime.date.today():%Y%m%d}_{commit}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(rows, indent=2))
    with path.with_suffix(".csv").open("w", newline="") as f:
        writer = csv.DictWriter(f, ["workload", "wall_s", "error"])
        writer.writeheader()
        writer.writerows(rows)
    return path
