"""Stored jobs from files to records: run, reuse, resume, retry, clean; suites and the command line."""

import json

import pytest

from millrace import cli, jobrun, schemas, suite
from millrace.operators import extraction
from millrace.store import Store
from tests.test_core import workbook

FIELDS = [extraction.Field("n", "int"), extraction.Field("name", "string", True)]
GOOD, HALF, BAD = '[{"n": 1, "name": "x"}]', '[{"n": 1, "name": "x"}, {"n": "many", "name": "y"}]', "none"


def backend(answer):
    return lambda: extraction.StubBackend(lambda prompt: answer)


def test_runs_are_stored_and_reused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xlsx").write_bytes(workbook())
    store = Store(spark, str(tmp_path / "store"))
    store.init()
    job = jobrun.run(store, str(tmp_path / "in"), "s", FIELDS, backend(GOOD)).collect()
    assert [(r.status, r.total_chunks) for r in job] == [("completed", 1)] and job[0].contract_id.startswith("ctr_")
    assert [json.loads(r.record) for r in jobrun.records(store).collect()] == [{"n": 1, "name": "x"}]
    assert [r.run_type for r in store.runs().collect()] == ["extraction"] and {r.stage for r in store.stages().collect()} == {"normalization", "chunking", "extraction"}
    again = jobrun.run(store, str(tmp_path / "in"), "s", FIELDS, backend(BAD)).collect()
    assert [r.job_id for r in again] == [job[0].job_id] and store.jobs().count() == 1
    failed = jobrun.run(store, str(tmp_path / "in"), "s", FIELDS, backend(BAD), force=True, max_retries=0).collect()
    assert [r.status for r in failed] == ["failed"] and store.read("contracts").count() == 1
    mine = failed[0].job_id
    assert [(r.job_id, r.retry_count) for r in store.dead_letters("pending").collect()] == [(mine, 1)]

    # a retry takes what is valid of a partly valid answer, and not an empty one
    assert [r.outcome for r in jobrun.retry(store, FIELDS, backend("[]")).collect()] == ["dead_letter"]
    done = jobrun.retry(store, FIELDS, backend(HALF), max_retries=0).collect()
    assert [(r.outcome, json.loads(r.record_json)) for r in done] == [("completed", [{"n": 1, "name": "x"}])] and done[0].runs[0].run_type == "retry"
    assert store.dead_letters("pending").count() == 0 and {r.status for r in store.jobs().collect()} == {"completed"}
    with pytest.raises(ValueError):
        jobrun.resume(store, mine, FIELDS, backend(GOOD))

    other = jobrun.run(store, str(tmp_path / "in"), "t", FIELDS, backend(BAD), max_retries=0).first()
    assert jobrun.resume(store, other.job_id, FIELDS, backend(GOOD)).first().status == "completed"
    assert cli.main(["clean", mine, "--store", store.root]) == 1 and cli.main(["clean", mine, "--store", store.root, "--yes"]) == 0
    assert mine not in {r.job_id for r in store.jobs().collect()} and store.jobs().count() == 2 and store.read("chunks").where(f"job_id = '{mine}'").isEmpty()
    assert cli.main(["export", other.job_id, str(tmp_path / "out"), "--store", store.root]) == 0
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()] == [{"n": 1, "name": "x"}]


def test_suite_from_files(spark, tmp_path):
    chunks = [{"chunk_index": 0, "label": "positive"}, {"chunk_index": 1, "label": "negative"}, {"page_range": [2, 3], "label": "positive", "golden": [{"id": "b", "n": 2}]}]
    (tmp_path / "m.json").write_text(json.dumps({"addressing": "mixed", "match_key": "id", "golden_path": "g.jsonl", "chunks": chunks}))
    (tmp_path / "g.jsonl").write_text('[{"id": "x", "n": 1}, {"id": "x", "n": 2}, {"id": "y", "n": "3"}]\n')
    rows = [
        {"chunk_index": 0, "records": [{"id": "y", "n": 3.0}, {"id": "x", "n": 1}, {"id": "z", "n": 9}]}, {"chunk_index": 1, "record_json": "[]"}, {"chunk_index": 2, "records": [{"id": "b", "n": 2}], "source_pages": "2"},
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    verdicts, differences = suite.score_file(spark, str(tmp_path / "m.json"), str(tmp_path / "r.jsonl"))
    assert {r.exp_id: r.reason for r in verdicts.collect()} == {0: "field_mismatch", 1: "correct_abstention", 2: "match"}
    got = sorted((r.pairing, r.field, r.match) for r in differences.where("exp_id = 0").collect())
    assert got == [("extra", "id", "extra"), ("extra", "n", "extra"), ("missing", "id", "missing"), ("missing", "n", "missing"), *[("paired", "id", "exact")] * 2, *[("paired", "n", "exact")] * 2]
    assert cli.main(["eval", str(tmp_path / "m.json"), str(tmp_path / "r.jsonl"), "--out", str(tmp_path / "o.json")]) == 1
    assert len(json.loads((tmp_path / "o.json").read_text())["outcomes"]) == 3
    (tmp_path / "g.jsonl").write_text('[{"id": "x"}, {"n": 2}]\n')
    with pytest.raises(ValueError):
        suite.score_file(spark, str(tmp_path / "m.json"), str(tmp_path / "r.jsonl"))


def test_schemas_are_found(tmp_path):
    (tmp_path / "own.py").write_text("from millrace.operators.extraction import Field\nCARS = [Field('vin', 'string', True)]\n_HIDDEN = [Field('x', 'int')]\nEMPTY = []\n")
    (tmp_path / "broken.py").write_text("import nowhere_at_all\n")
    found, problems = schemas.discover(str(tmp_path))
    assert list(found) == ["cars", "generic_row", "invoice_line"] and list(problems) == ["broken.py"]
