"""Content-addressed identities: files, schemas, prompts and contracts."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def canonical_json_schema(schema: dict[str, Any]) -> str:
    """Sorted keys, no spaces, non-ASCII kept."""
    return json.dumps(schema, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def contract_id(schema_json: Column, prompt: Column, schema_class: Column) -> Column:
    zero = F.unhex(F.lit("00"))
    data = F.concat(F.encode(schema_json, "UTF-8"), zero, F.encode(prompt, "UTF-8"), zero, F.encode(schema_class, "UTF-8"))
    return F.concat(F.lit("ctr_"), F.substring(F.sha2(data, 256), 1, 32))


def prompt_version(system: Column, template: Column) -> Column:
    return F.substring(F.sha2(F.concat(system, F.lit("\n---\n"), template), 256), 1, 16)


def prompt_version_of(system: str, template: str) -> str:
    """The same on the driver."""
    return hashlib.sha256(f"{system}\n---\n{template}".encode()).hexdigest()[:16]


def effective_model(override: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(override), F.lit("")), default)
