"""Extraction: call a backend for each chunk, parse, validate and repair, and split the outcomes.

The call is the one step that is not a plan: it runs in ``mapInArrow`` with a backend built on the worker, and
its outcomes are to be written (or checkpointed) once before results, runs and dead letters are projected from
them, or the model would be asked again for each. Turn speculation off for jobs that call a paid model.
"""

from __future__ import annotations

import json
import math
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json_records import WRAPPERS

SYSTEM_PROMPT = "Extract every record that fits the given JSON schema from the text. Answer with a JSON array of objects and nothing else; use null for what the text does not say, and [] if it holds no record."
USER_TEMPLATE = "Schema:\n```json\n{schema}\n```\n\nText:\n{text}\n\nAnswer with the JSON array only."
REPAIR_TEMPLATE = "This answer does not fit the schema.\n\nProblem: {error}\n\nAnswer:\n```json\n{answer}\n```\n\nSchema:\n```json\n{schema}\n```\n\nSend the corrected JSON array only."


@dataclass(frozen=True)
class Reply:
    text: str
    tokens_in: int = 0
    tokens_out: int = 0
    latency_ms: int = 0
    model: str = ""


class Backend(Protocol):
    def complete(self, system: str, user: str) -> Reply: ...


class StubBackend:
    """Answers by a function of the prompt, for tests and benches."""

    def __init__(self, answer: Callable[[str], str], model: str = "stub"):
        self.answer, self.model = answer, model

    def complete(self, system: str, user: str) -> Reply:
        text = self.answer(user)
        return Reply(text, len(user) // 4, len(text) // 4, 1, self.model)


def _ask(url: str, body: dict[str, Any] | None, timeout: float, key: str | None = None) -> Any:
    """JSON answer of an endpoint; without a body it is only looked at."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), headers)
    with urllib.request.urlopen(request, timeout=timeout) as response:
        return json.load(response)


def _messages(system: str, user: str) -> list[dict[str, str]]:
    return [{"role": "system", "content": system}, {"role": "user", "content": user}]


class OllamaBackend:
    """A chat endpoint that speaks the Ollama protocol."""

    def __init__(self, url: str, model: str, timeout: float = 120):
        self.base, self.model, self.timeout = url.rstrip("/"), model, timeout

    def complete(self, system: str, user: str) -> Reply:
        began = time.monotonic()
        got = _ask(f"{self.base}/api/chat", {"model": self.model, "stream": False, "format": "json", "messages": _messages(system, user)}, self.timeout)
        return Reply(got["message"]["content"], got.get("prompt_eval_count", 0), got.get("eval_count", 0), int(1000 * (time.monotonic() - began)), self.model)

    def problem(self) -> str | None:
        """Why calls would fail, null if the endpoint answers and has the model."""
        try:
            names = {m.get("name", "") for m in _ask(f"{self.base}/api/tags", None, 5).get("models", [])}
        except OSError as e:
            return f"no answer from {self.base}: {e}"
        return None if self.model in names or f"{self.model}:latest" in names else f"{self.base} has no model {self.model}"


class ChatBackend:
    """A chat endpoint that speaks the widespread ``/chat/completions`` protocol; asked again after failures that may pass."""

    def __init__(self, url: str, model: str, key: str | None = None, timeout: float = 120, tries: int = 3, pause: float = 1.0):
        self.base, self.model, self.key, self.timeout, self.tries, self.pause = url.rstrip("/"), model, key, timeout, tries, pause

    def complete(self, system: str, user: str) -> Reply:
        body = {"model": self.model, "messages": _messages(system, user), "response_format": {"type": "json_object"}}
        began = time.monotonic()
        for turn in range(self.tries):
            try:
                got = _ask(f"{self.base}/chat/completions", body, self.timeout, self.key)
                break
            except OSError as e:
                code = getattr(e, "code", 500)  # an answer that says the request is wrong will not change
                if turn == self.tries - 1 or 400 <= code < 500 and code not in (408, 429):
                    raise
                time.sleep(self.pause * 2**turn)
        use = got.get("usage") or {}
        return Reply(got["choices"][0]["message"]["content"], use.get("prompt_tokens", 0), use.get("completion_tokens", 0), int(1000 * (time.monotonic() - began)), self.model)

    def problem(self) -> str | None:
        """Why calls would fail, null if there is a key and the endpoint answers."""
        if not self.key:
            return "no key is set"
        try:
            _ask(f"{self.base}/models", None, 5, self.key)
        except OSError as e:
            return f"no answer from {self.base}: {e}"
        return None


@dataclass(frozen=True)
class Field:
    """``kind``: string, int, float, bool or map."""

    name: str
    kind: str
    required: bool = False


def json_schema(fields: list[Field]) -> dict[str, Any]:
    kinds = {"string": "string", "int": "integer", "float": "number", "bool": "boolean", "map": "object"}
    return {"type": "object", "properties": {f.name: {"type": kinds[f.kind]} for f in fields}, "required": [f.name for f in fields if f.required]}


_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
_NUMERIC = re.compile(r"[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+)([eE][+-]?\d+)?")


def parse_records(text: str) -> list[Any]:
    """Records of an answer: an array, a wrapped array or one object. Raises ``ValueError``."""
    fenced = _FENCE.search(text)
    value = json.loads((fenced[1] if fenced else text).strip())
    if isinstance(value, list):
        return value
    if not isinstance(value, dict):
        raise ValueError(f"neither array nor object but {type(value).__name__}")
    wrapped = next((value[k] for k in WRAPPERS if isinstance(value.get(k), list)), None)
    if wrapped is not None:
        return wrapped
    return [value] if any(v is not None for v in value.values()) else []


def coerce(value: Any, kind: str) -> Any:
    """``value`` as ``kind`` by lax rules; raises ``ValueError``."""
    if kind == "string" and isinstance(value, str):
        return value
    if kind == "map" and isinstance(value, dict):
        return value
    if kind == "bool":
        if isinstance(value, bool):
            return value
        word = value.strip().lower() if isinstance(value, str) else value
        if word in (1, "1", "true", "t", "yes", "y", "on"):
            return True
        if word in (0, "0", "false", "f", "no", "n", "off"):
            return False
    if kind in ("int", "float"):
        if isinstance(value, str):
            word = value.strip()
            if kind == "float" and word.lower().lstrip("+-") in ("nan", "inf", "infinity"):
                return float(word)
            if not _NUMERIC.fullmatch(word):
                raise ValueError(f"not a number: {value!r}")
            value = int(word) if re.fullmatch(r"[+-]?\d+(_\d+)*", word) else float(word)
        if isinstance(value, (int, float)):
            if kind == "float":
                return float(value)
            if not isinstance(value, float) or math.isfinite(value) and value == int(value):
                return int(value)
    raise ValueError(f"not {kind}: {value!r}")


def validate(text: str, fields: list[Field]) -> tuple[list[dict[str, Any]], str]:
    """Valid records and what was wrong with the others."""
    try:
        records = parse_records(text)
    except ValueError as e:
        return [], f"JSON parse error: {e}"
    valid, errors = [], []
    for record in records:
        try:
            if not isinstance(record, dict):
                raise ValueError("not an object")
            out = {}
            for f in fields:
                if f.required and record.get(f.name) is None:
                    raise ValueError(f"{f.name} is required")
                out[f.name] = None if record.get(f.name) is None else coerce(record[f.name], f.kind)
            valid.append(out)
        except ValueError as e:
            errors.append(str(e))
    return [r for r in valid if any(v is not None for v in r.values())], "; ".join(errors)


def extract_one(text: str, backend: Backend, fields: list[Field], max_retries: int, first: str = "extraction") -> dict[str, Any]:
    """Outcome of one chunk: ``completed``, ``completed_without_result`` or ``dead_letter``.

    With ``first`` = ``retry``, whatever valid records there are complete the chunk, and an answer without any does not.
    """
    schema = json.dumps(json_schema(fields), indent=2)
    runs: list[dict[str, Any]] = []

    def ask(prompt: str) -> str:
        reply = backend.complete(SYSTEM_PROMPT, prompt)
        runs.append({"run_type": "repair" if runs else first, "model": reply.model, "tokens_in": reply.tokens_in, "tokens_out": reply.tokens_out, "latency_ms": reply.latency_ms, "raw_output": reply.text})
        return reply.text

    try:
        answer = ask(USER_TEMPLATE.format(schema=schema, text=text))
    except Exception as e:  # any failure of the backend makes a dead letter and leaves no run
        return {"outcome": "dead_letter", "record_json": None, "error": str(e), "retry_count": 0, "runs": []}
    valid, error = validate(answer, fields)
    attempts = 1
    while error and attempts <= max_retries:
        try:
            answer = ask(REPAIR_TEMPLATE.format(error=error, answer=answer, schema=schema))
        except Exception as e:
            valid, error = [], f"Repair call failed: {e}"
            break
        attempts += 1
        valid, error = validate(answer, fields)
    if first == "retry":
        outcome = "completed" if valid else "dead_letter"
    else:
        outcome = "completed" if not error else "completed_without_result" if valid else "dead_letter"
    for i, run in enumerate(runs):
        passed = not error and (first != "retry" or bool(valid))
        run |= {"attempt": i + 1, "validation_passed": i == len(runs) - 1 and passed}
    return {"outcome": outcome, "record_json": json.dumps(valid, ensure_ascii=False) if outcome == "completed" else None, "error": error or None, "retry_count": attempts, "runs": runs}


RUN = "attempt int, run_type string, model string, tokens_in long, tokens_out long, latency_ms long, validation_passed boolean, raw_output string"


def extract(chunks: DataFrame, backend: Callable[[], Backend], fields: list[Field], max_retries: int = 2, first: str = "extraction", workers: int = 4) -> DataFrame:
    """Outcomes of ``chunks(job_id, chunk_index, text)``; ``backend()`` is called once in each task.

    Each task keeps up to ``workers`` calls in flight, so a backend must stand calls from several threads.
    """
    schema = f"job_id string, chunk_index int, outcome string, record_json string, error string, retry_count int, runs array<struct<{RUN.replace(' ', ':').replace(',:', ',')}>>"

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = backend()
        kind = pa.list_(pa.struct([("attempt", pa.int32()), ("run_type", pa.string()), ("model", pa.string()), ("tokens_in", pa.int64()), ("tokens_out", pa.int64()), ("latency_ms", pa.int64()), ("validation_passed", pa.bool_()), ("raw_output", pa.string())]))
        pool = ThreadPoolExecutor(workers)
        for batch in batches:
            rows = list(pool.map(lambda text: extract_one(text or "", client, fields, max_retries, first), batch.column("text").to_pylist()))
            columns = {"outcome": pa.string(), "record_json": pa.string(), "error": pa.string(), "retry_count": pa.int32(), "runs": kind}
            yield pa.RecordBatch.from_arrays(
                [batch.column("job_id"), batch.column("chunk_index"), *(pa.array([r[c] for r in rows], t) for c, t in columns.items())], ["job_id", "chunk_index", *columns]
            )
        pool.shutdown()

    given = chunks.select(F.col("job_id").cast("string").alias("job_id"), F.col("chunk_index").cast("int").alias("chunk_index"), "text")
    return given.mapInArrow(call, schema)


def results(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("outcome = 'completed'").select("job_id", "chunk_index", "record_json")


def runs(outcomes: DataFrame) -> DataFrame:
    return outcomes.select("job_id", "chunk_index", F.inline("runs"))


def dead_letters(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("outcome = 'dead_letter'").select("job_id", "chunk_index", F.col("error").alias("last_error"), "retry_count", F.lit("pending").alias("status"))


def retry(dead: DataFrame, chunks: DataFrame, backend: Callable[[], Backend], fields: list[Field], max_retries: int = 2) -> DataFrame:
    """Outcomes of pending dead letters; unlike a first run, partly valid answers count and an empty one does not."""
    again = chunks.join(dead.where("status = 'pending'").select("job_id", "chunk_index"), ["job_id", "chunk_index"])
    return extract(again, backend, fields, max_retries, first="retry")
