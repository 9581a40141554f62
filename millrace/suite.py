"""Scoring a results file against a manifest and its golden files, and suites of several."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluation
from .sources import records


def golden_file(text: str) -> str:
    """The JSON of a golden file: the whole of it, or its first line where the whole does not parse."""
    for part in (text, text.strip().split("\n")[0]):
        try:
            json.loads(part)
            return part
        except ValueError:
            continue
    return text


def expectations_of(spark: SparkSession, manifest: dict[str, Any], fixture: str, base: Path) -> tuple[DataFrame, tuple[DataFrame, DataFrame, DataFrame]]:
    """Expectations and goldens (inline, own files, lines of the manifest's file) of one manifest."""
    wanted, inline, own = [], [], []
    for k, chunk in enumerate(manifest["chunks"]):
        span = chunk.get("page_range")
        if span is not None:
            first, last = span if isinstance(span, list) else (span["start"], span["end"])
        wanted.append((fixture, k, chunk["label"], bool(chunk.get("allow_empty", True)), chunk.get("chunk_index"), list(range(first, last + 1)) if span is not None else None))
        if chunk.get("golden") is not None:
            target = inline if chunk.get("chunk_index") is not None else own
            target.append((fixture, k, chunk.get("chunk_index"), json.dumps(chunk["golden"])))
        elif chunk.get("golden_path"):
            path = base / chunk["golden_path"]
            own.append((fixture, k, None, golden_file(path.read_text()) if path.is_file() else f"no file {path.name}"))
    lines = []
    if manifest.get("golden_path"):
        path = base / manifest["golden_path"]
        for n, line in enumerate(path.read_text().splitlines() if path.is_file() else []):
            if line.strip():
                lines.append((fixture, None, n, line))
    golden = "fixture string, exp_id long, chunk_index long, golden_json string"
    frame = spark.createDataFrame(wanted, "fixture string, exp_id long, label string, allow_empty boolean, chunk_index long, pages array<int>")
    return frame, tuple(spark.createDataFrame(x, golden) for x in (inline, own, lines))


def score_file(spark: SparkSession, manifest_path: str, results_path: str) -> tuple[DataFrame, DataFrame]:
    """Verdicts and field differences of a file of job results, JSON lines."""
    path = Path(manifest_path)
    manifest = records.load_manifest(path.read_text())
    expectations, goldens = expectations_of(spark, manifest, path.stem, path.parent)
    rows = spark.read.text(results_path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("seq", "line")).where("trim(line) <> ''")
    cell = lambda name: F.get_json_object("line", f"$.{name}")
    results = rows.select(
        F.lit(path.stem).alias("fixture"), cell("chunk_index").try_cast("long").alias("chunk_index"), F.coalesce(cell("record_json"), cell("records")).alias("record_json"),
        F.coalesce(cell("validation_passed") != "false", F.lit(True)).alias("validation_passed"), cell("source_pages").alias("source_pages"), "seq",
    )
    bad = results.where("chunk_index IS NULL").select(F.min("seq")).first()[0]
    if bad is not None:
        raise ValueError(f"line {bad + 1} of {results_path} is not an object with a chunk_index")
    if manifest.get("match_key"):
        lacking = [r.chunk_index for r in evaluation.anchors_missing(goldens[2].unionByName(goldens[0]), manifest["match_key"]).collect()]
        if lacking:
            raise ValueError(f"golden records of chunks {sorted(lacking)} lack {manifest['match_key']}")
    return evaluation.score(expectations, results, goldens, manifest.get("match_key"), manifest.get("hint"))


def report(verdicts: DataFrame, differences: DataFrame) -> dict[str, Any]:
    """Outcomes, summary and whether all passed, as plain values: a manifest's expectations are few."""
    outcomes = [json.loads(r.json) for r in evaluation.outcomes_json(verdicts, differences).collect()]
    summary = [r.asDict() for r in evaluation.summary(verdicts, differences).collect()]
    return {"outcomes": [x for o in outcomes for x in o["outcomes"]], "summary": summary, "overall_ok": bool(evaluation.overall_ok(verdicts).first()[0])}
