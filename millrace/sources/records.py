"""Record sources and sinks: JSON lines, golden files, manifests, settings and exports."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_records import is_json


def job_results(spark: SparkSession, path: str) -> DataFrame:
    """``(line, chunk_index, record_json, problem)``: blank lines are skipped, lines count from 1."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "value")).where("trim(value) <> ''")
    obj = F.json_object_keys("value").isNotNull() & is_json(F.col("value"))
    index = F.get_json_object("value", "$.chunk_index").try_cast("int")
    problem = F.when(~obj, "not an object").when(index.isNull(), "no chunk_index")
    records = F.coalesce(F.get_json_object("value", "$.record_json"), F.get_json_object("value", "$.records"))
    return whole.select((F.col("at") + 1).alias("line"), index.alias("chunk_index"), records.alias("record_json"), problem.alias("problem"))


def golden_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(chunk_index, golden_json, problem)``: the line number from 0 is the chunk; one object is an array of one."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n")).alias("chunk_index", "value"))
    value = F.trim("value")
    array, obj = F.json_array_length(value).isNotNull() & is_json(value), F.json_object_keys(value).isNotNull() & is_json(value)
    return whole.select("chunk_index", F.when(array, value).when(obj, F.concat(F.lit("["), value, F.lit("]"))).alias("golden_json"), F.when(~(array | obj), "not records").alias("problem"))


def load_manifest(text: str) -> dict[str, Any]:
    """A checked manifest from YAML (if installed) or JSON; raises ``ValueError``."""
    try:
        data = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise ValueError("reading YAML needs PyYAML") from None
        try:
            data = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(f"malformed manifest: {e}") from None
    if not isinstance(data, dict) or not data.get("chunks"):
        raise ValueError("a manifest needs at least one chunk")
    mode = data.get("addressing", "chunk_index")
    for chunk in data["chunks"]:
        if (chunk.get("chunk_index") is None) == (chunk.get("page_range") is None):
            raise ValueError("a chunk needs exactly one of chunk_index and page_range")
        if mode != "mixed" and chunk.get(mode) is None:
            raise ValueError(f"chunks are to be addressed by {mode}")
        if chunk.get("label") not in ("positive", "negative"):
            raise ValueError("label is positive or negative")
        if chunk.get("page_range") is not None:
            span = chunk["page_range"]
            start, end = span if isinstance(span, list) else (span["start"], span["end"])
            if start < 1 or end < start:
                raise ValueError("page_range starts at 1 and ends after its start")
    return data


def load_config(*paths: str) -> dict[str, Any]:
    """The first TOML file that exists."""
    found = next((Path(p) for p in paths if Path(p).is_file()), None)
    return tomllib.loads(found.read_text()) if found else {}


def write_jsonl(records: DataFrame, path: str) -> None:
    records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_csv(records: DataFrame, path: str) -> None:
    records.write.csv(path, header=True)


def merge_golden(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lines of ``old(chunk_index, golden_json)`` replaced and added from ``new``; gaps are blank lines."""
    both = old.join(new.withColumnRenamed("golden_json", "_new"), "chunk_index", "full").select("chunk_index", F.coalesce("_new", "golden_json").alias("golden_json"))
    last = both.agg(F.max("chunk_index")).first()[0]
    lines = old.sparkSession.range(0, (last if last is not None else -1) + 1).select(F.col("id").cast("int").alias("chunk_index"))
    return lines.join(both, "chunk_index", "left").select("chunk_index", F.coalesce("golden_json", F.lit("")).alias("value")).orderBy("chunk_index")
