"""Value-level cases of the core operators."""

import io
import json
import random
import re
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.functions import compare, hashing, json_records, text
from millrace.operators import chunking, evaluation, extraction, jobs, preflight, scoring, telemetry
from millrace.plans.queries import QUERIES
from millrace.sources import documents, records
from millrace.streaming import events


def test_comparator(spark):
    cases = [
        (None, None, None, "exact"), ("", "  ", None, "exact"), ("x", None, None, "missing"), (None, "x", None, "mismatch"), ("5", "5.0", None, "exact"), ("1,000.5", "1000.5", None, "exact"),
        ("  Toyota ", "toyota", None, "normalized"), ("a", "b", None, "mismatch"), ("$350,000.00", "350000.0", "currency", "exact"), ("5%", "0.05", None, "exact"), ("0.05", "5%", "percent", "exact"),
        ("50", "50%", None, "exact"), ("2024-01-15", "01/15/2024", None, "normalized"), ("2", "3", "number", "mismatch"), ("x", "y", "date", "mismatch"), ("1.0000000001", "1.0000000002", None, "normalized"),
        ("1", "2", "strict", "mismatch"), ("1", "1", "strict", "exact"), ("12d", "12", "number", "mismatch"), ("nan", "NaN", None, "normalized"), ("inf", "Infinity", None, "exact"), ("Straße", "STRASSE", None, "normalized"),
        ("10:00", "10:00", None, "exact"), ("2024-01-15T10:00:00Z", "2024-01-15T12:00:00+02:00", None, "mismatch"), ("2024-01-15T10:00:00Z", "2024-01-15T10:00:00.5+00:00", "date", "normalized"),
        ("15-jan-2024", "Jan 15, 2024", "date", "normalized"), ("2024-02-30", "2024-02-30", "date", "mismatch"), ("\x1cx ", "x", None, "normalized"), ("1", "1%", "percent", "mismatch"),
    ]
    for hint in {c[2] for c in cases}:
        mine = [(i, e, a, m) for i, (e, a, h, m) in enumerate(cases) if h == hint]
        df = spark.createDataFrame(mine, "i int, e string, a string, want string")
        wrong = compare.compare(df, "e", "a", hint).where("match <> want").collect()
        assert not wrong, wrong


def test_bool_is_not_a_number(spark):
    df = spark.createDataFrame([("True", "1", "bool", "number")], "e string, a string, ek string, ak string")
    assert compare.compare(df, "e", "a", kinds=("ek", "ak")).first().match == "mismatch"


def test_date_keys(spark):
    want = {"01/15/2024": "2024-01-15", "2024-01-15T14:30:00": "2024-01-15T14:30:00", "": None, "not a date": None, "20240115": "2024-01-15", "2024-01-15T10": "2024-01-15T10:00:00", "25/12/2024": "2024-12-25", "2024-01-15T25:00": None}
    df = spark.createDataFrame([(k,) for k in want], "x string").select("x", compare.date_key(F.col("x")).alias("y"))
    assert {r.x: r.y for r in df.collect()} == want


def test_fences_and_wrappers(spark):
    want = {'```json\n[{"a": 1}]\n```': 1, '{"items": [1, 2]}': 2, '{"a": 1}': 1, "[1] trailing": None, "no": None, "[]": 0}
    df = spark.createDataFrame([(k,) for k in want], "x string").select("x", F.json_array_length(json_records.records_json(F.col("x"))).alias("n"))
    assert {r.x: r.n for r in df.collect()} == want
    assert text.strip_fences(F.lit("x")) is not None


def test_strict_parsing():
    parse = extraction.parse_records
    assert parse("{}") == parse('{"a": null}') == parse("[]") == [] and parse('{"a":1,"a":2}') == [{"a": 2}]
    for bad in ("not json", "[1] trailing", "", "3"):
        with pytest.raises(ValueError):
            parse(bad)
    accepted = [("int", x) for x in (5, 5.0, "5", "5.0", " 5 ", "1_000", True, 10**20)] + [("float", x) for x in (5, "5.5", "1e3", "nan", True, " 5 ")]
    refused = [("int", x) for x in (5.5, "5.5", "x", [])] + [("float", "$5"), ("float", "12d"), ("string", 5), ("map", [])]
    for kind, value in accepted:
        extraction.coerce(value, kind)
    for kind, value in refused:
        with pytest.raises(ValueError):
            extraction.coerce(value, kind)


FIELDS = [extraction.Field("n", "int"), extraction.Field("name", "string", True)]


@pytest.mark.parametrize(
    ("answers", "outcome", "runs"),
    [
        (["[]"], "completed", 1), (['[{"n": 1, "name": "x"}]'], "completed", 1), (["bad", '[{"name": "x"}]'], "completed", 2), (["bad"] * 3, "dead_letter", 3),
        (['[{"n": "q", "name": "x"}, {"name": "y"}]'] * 3, "completed_without_result", 3), ([], "dead_letter", 0), (["bad"], "dead_letter", 1),
    ],
)
def test_repair_loop(answers, outcome, runs):
    left = iter(answers)
    got = extraction.extract_one("text", extraction.StubBackend(lambda _: next(left)), FIELDS, 2)
    assert (got["outcome"], len(got["runs"])) == (outcome, runs)
    assert sum(r["validation_passed"] for r in got["runs"]) == (outcome == "completed")


def test_outcomes_split_and_retry(spark):
    chunks = spark.createDataFrame([("j", i, "x" * i) for i in range(8)], "job_id string, chunk_index int, text string")
    from millrace.plans.queries import stub_backend

    out = extraction.extract(chunks, stub_backend, FIELDS).cache()
    dead = extraction.dead_letters(out)
    assert extraction.results(out).count() + dead.count() == 8 and extraction.runs(out).count() > 8
    again = extraction.retry(dead, chunks, stub_backend, FIELDS)
    assert again.count() == dead.count() and again.where("outcome = 'completed'").count() == 0


def chunk(spark, rows, **options):
    pages = spark.createDataFrame(rows, "job_id string, page_index int, text string")
    return sorted(chunking.chunk_pages(pages, **options).collect(), key=lambda r: (r.job_id, r.chunk_index))


def test_chunks(spark):
    got = chunk(spark, [("j", i, f"page {i}") for i in range(5)])
    assert len(got) == 1 and got[0].source_pages == [0, 1, 2, 3, 4] and got[0].text.count("\n\n") == 4
    assert len(chunk(spark, [("j", 0, "X" * 40_000)], context_window=1000)) > 10
    assert chunk(spark, []) == [] and chunk(spark, [("j", 0, "")]) == [] and chunk(spark, [("j", 0, None)]) == []
    got = chunk(spark, [("j", 0, ""), ("j", 1, "a"), ("j", 2, ""), ("j", 3, "b")])
    assert got[0].text == "a\n\n\n\nb"


def test_table_chunks_come_last(spark):
    rows = "".join(f"| r{i} | {'v' * 40} |\n" for i in range(185))
    table = "# Sheet1\n\n| name | value |\n| --- | --- |\n" + rows
    got = chunk(spark, [("j", 0, table), ("j", 1, "short")], context_window=4000)
    assert [r.source_pages for r in got] == [[1], [0], [0], [0]] and got[1].text.startswith("# Sheet1\n\n")
    assert all("| name | value |\n| --- | --- |\n" in r.text for r in got[1:]) and [r.text.count("| r") for r in got[1:]] == [80, 80, 25]
    assert chunking.split_table("| a |\n| 1 |\n| 2 |\n| b |\n") == ["| a |\n| 1 |\n| b |\n"]  # digits alone look like a separator


def test_row_blocks_agree_with_split_table(spark):
    """Blocks of rows are those of the whole sheet's text: separators dropped, a sheet of nothing else whole, null and negative keys."""
    cells = lambda s, i: ["7", "-", None][i % 3] if s == "digits" or i % 5 == 0 else f"r{i}|"
    rows = [(s, None if s is None and i == 0 else (i * 37) % n - 20, i, cells(s, i)) for s, n in (("a", 500), (None, 90), ("digits", 170), ("one", 1), ("b", 2)) for i in range(n)]
    head = "# Sheet\n\n| k | v |\n| --- | --- |\n"
    line = text.markdown_row(F.array(F.col("k").cast("string"), F.col("v")))
    table = spark.createDataFrame(rows, "sheet string, k int, i int, v string").repartition(7)
    got = {(r.sheet, r.block): r.piece for r in chunking.row_blocks(table, ["sheet"], ["k", "i"], line, head).collect()}
    sheets = table.select("sheet", "k", "i", line.alias("line")).collect()
    want = {}
    for sheet in {r.sheet for r in sheets}:
        lines = [r.line for r in sorted((r for r in sheets if r.sheet == sheet), key=lambda r: (r.k is not None, r.k or 0, r.i))]
        want |= {((sheet, n)): piece for n, piece in enumerate(chunking.split_table(head + "\n".join(lines) + "\n"))}
    assert got == want and len(got) > 8
    assert chunking.row_blocks(table.limit(0), ["sheet"], ["k", "i"], line, head).count() == 0


def test_table_blocks_puts_no_sheet_together(spark, sf):
    """Neither a sheet's rows nor their numbers meet in one task: windows are parted by slices, too, and no plan runs Python."""
    plan = QUERIES["table_blocks"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [row_number" in x]
    assert windows and all("_slice" in x for x in windows) and "PythonUDF" not in plan and "ArrowEval" not in plan


def test_ranges_agree_with_brute_force(spark):
    """Random and odd sets of pages: empty, null, with null or repeated pages, ids that repeat, keys that are null or have no chunk."""
    rng = random.Random(5)
    pages = lambda: rng.choice([None, [], [None, 1]]) if rng.random() < 0.15 else [rng.randrange(6) for _ in range(rng.randrange(1, 5))]
    asked = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(40)]), pages()) for _ in range(150)] + [("one", i, p) for i, p in enumerate([[], [4], [4, 5], [5], None])]
    chunks = [(rng.choice(["a", "b", None]), rng.choice([None, *range(12)]), pages()) for _ in range(30)] + [("one", 3, [4, 4]), ("one", 9, [])]
    want = {}
    for key, range_id in {x[:2] for x in asked}:
        tried = [(set(p), set(q), c) for k, r, p in asked if (k, r) == (key, range_id) and p is not None for l, c, q in chunks if l == key and key is not None and q]
        inside, holds = [c for p, q, c in tried if q <= p], [c for p, q, c in tried if p <= q]
        fits = inside or holds
        want[key, range_id] = ("resolved", fits[0]) if len(fits) == 1 else ("page_range_ambiguous" if fits else "page_range_unresolved", None)
    a, b = spark.createDataFrame(asked, "k string, range_id int, pages array<int>"), spark.createDataFrame(chunks, "k string, chunk_index int, chunk_pages array<int>")
    got = scoring.resolve_ranges(a, b, "k").collect()
    assert {(r.k, r.range_id): (r.reason, r.chunk_index) for r in got} == want and len(got) == len(want) and len({x[0] for x in want.values()}) == 3


def test_ranges_meet_chunks_by_page(spark):
    """No range is paired with every chunk of its fixture: only a range without pages joins on the fixture alone, with one row."""
    asked = spark.range(9).selectExpr("'f' AS k", "id AS range_id", "array(int(id)) AS pages")
    chunks = spark.range(9).selectExpr("'f' AS k", "id AS chunk_index", "array(int(id)) AS chunk_pages")
    plan = scoring.resolve_ranges(asked, chunks, "k")._jdf.queryExecution().analyzed().toString()
    joins = [x for x in plan.splitlines() if "Join " in x]
    assert sum("_page" in x for x in joins) == 1 and len(joins) == 2 and re.search(r"Filter \(size\(pages#\d+, \w+\) = 0\)", plan)


def test_fields_of_one_large_fixture(spark):
    """Expectations by page in one fixture find their chunks page by page, and their fields are compared."""
    wanted = spark.range(400).selectExpr("'f' AS fixture", "id AS exp_id", "'positive' AS label", "true AS allow_empty", "CAST(NULL AS bigint) AS chunk_index", "array(int(id), int(id) + 1) AS pages")
    given = spark.range(400).selectExpr("'f' AS fixture", "id AS chunk_index", "concat('[{\"v\":', id, '}]') AS record_json", "true AS validation_passed", "if(id % 2 = 0, concat(id, ',', id + 1), concat(id, ',900')) AS source_pages", "1 AS seq")
    own = spark.range(400).selectExpr("'f' AS fixture", "id AS exp_id", "CAST(NULL AS bigint) AS chunk_index", "concat('{\"v\":', if(id % 4 = 0, -1, id), '}') AS golden_json")
    verdicts, fields = evaluation.score(wanted, given, (own.limit(0), own, own.limit(0)))
    assert re.search(r"_page#\d+ <=> _page#\d+", fields._jdf.queryExecution().analyzed().toString())
    assert {(r.exp_id, r.field, r.match) for r in fields.collect()} == {(i, "v", "mismatch" if i % 4 == 0 else "exact") for i in range(0, 400, 2)}
    assert {(r.reason, r.n) for r in verdicts.groupBy("reason").agg(F.count("*").alias("n")).collect()} == {("page_range_unresolved", 200), ("match", 100), ("field_mismatch", 100)}
    spark.catalog.clearCache()


def test_page_specs():
    assert preflight.parse_pages_spec("1,3-5,10") == {1, 3, 4, 5, 10} and preflight.parse_pages_spec(" 1 , 2 ") == {1, 2} and preflight.parse_pages_spec(" ") is None
    assert preflight.resolve_pages("2-3", 3) == {1, 2}
    for bad in ("0", "5-3", "x", "1,,2"):
        with pytest.raises(ValueError):
            preflight.parse_pages_spec(bad)
    with pytest.raises(ValueError, match="99"):
        preflight.resolve_pages("99", 10)


def test_identities(spark):
    assert hashing.canonical_json_schema({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    row = spark.range(1).select(hashing.contract_id(F.lit("x"), F.lit("y"), F.lit("z")).alias("c"), hashing.prompt_version(F.lit("s"), F.lit("t")).alias("p"), hashing.effective_model(F.lit(" "), F.lit("d")).alias("m")).first()
    assert len(row.c) == 36 and row.c.startswith("ctr_") and row.p == hashing.prompt_version_of("s", "t") and row.m == "d"


def test_pairs_and_orphans(spark):
    golden = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, None, 2), (1, "b", 3)], "chunk int, key string, i int")
    actual = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "c", 2), (1, " ", 3)], "chunk int, key string, i int")
    got = sorted((r.pairing, r.g_i, r.a_i) for r in scoring.pair_by_anchor(golden, actual, ["chunk"], "key", ["i"]).collect())
    assert sorted(got, key=str) == sorted([("paired", 0, 1), ("paired", 3, 0), ("missing", 1, None), ("missing", 2, None), ("extra", None, 2), ("extra", None, 3)], key=str)


def test_reasons_and_summary(spark):
    base = {"label": "positive", "allow_empty": True, "present": True, "parse_error": False, "validated": True, "n_records": 1, "golden_error": False, "has_golden": True, "fields_ok": True}
    cases = {
        "match": {}, "field_mismatch": {"fields_ok": False}, "schema_pass_no_golden": {"has_golden": False}, "golden_parse_error": {"golden_error": True}, "missing_output": {"n_records": 0}, "schema_reject": {"validated": False},
        "record_json_parse_error": {"parse_error": True}, "missing_chunk_in_results": {"present": False}, "correct_abstention": {"label": "negative", "n_records": 0}, "false_positive": {"label": "negative"},
    }
    df = spark.createDataFrame([base | change | {"want": want} for want, change in cases.items()]).withColumn("reason", scoring.reason())
    assert df.where("reason <> want").count() == 0
    row = scoring.summary(df).first()
    assert (row.total, row.passed, row.false_positive_rate, row.overall_ok) == (10, 3, 0.5, False)


def test_job_rules(spark):
    df = spark.createDataFrame([(0, 0), (3, 0), (2, 1), (0, 2)], "completed_chunks int, failed_chunks int")
    assert [r.s for r in df.select(jobs.job_status(df).alias("s")).collect()] == ["completed", "completed", "partial", "failed"]
    kept = jobs.delete_jobs({"runs": spark.createDataFrame([("a",), ("b",)], "job_id string")}, spark.createDataFrame([("a",)], "job_id string"))
    assert [r.job_id for r in kept["runs"].collect()] == ["b"]


def test_telemetry_without_runs(spark):
    row = spark.createDataFrame([], "ok boolean").agg(telemetry.pass_rate(F.col("ok")).alias("rate")).first()
    assert row.rate == 1.0 and len(telemetry.EVENTS) == 10


def workbook() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rows = "".join(f'<row r="{i + 2}"><c r="A{i + 2}"><v>{i}</v></c><c r="C{i + 2}" t="inlineStr"><is><t>a|b</t></is></c></row>' for i in range(52))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Cars" sheetId="1" r:id="r1"/><sheet name="Empty" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>1</v></c></row>{rows}</sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    return out.getvalue()


def test_workbook_source(spark, tmp_path):
    (tmp_path / "a.XLSX").write_bytes(workbook())
    (tmp_path / "b.txt").write_text("no")
    pages = documents.workbook_pages(documents.workbook_rows(documents.files(spark, str(tmp_path)))).collect()
    cars = next(r.text for r in pages if r.text.startswith("# Cars"))
    assert cars.count("| id | name | name |\n| --- | --- | --- |\n") == 2 and "| 51 |  | a\\|b |\n" in cars
    assert "| 49 |  | a\\|b |\n\n| id |" in cars and cars.endswith("| 51 |  | a\\|b |\n\n")
    assert sorted(r.text for r in pages if r.text != cars) == ["# Empty\n\n*Empty sheet*\n"]
    rows = spark.createDataFrame([("f", "Head", 0, 0, ["a", "b"])], "path string, sheet string, sheet_index int, row int, cells array<string>")
    assert documents.workbook_pages(rows).first().text == "# Head\n\n"


def test_cell_values():
    assert [documents._shown(*x) for x in (("1", "b", False), ("0", "b", False), ("5", None, False), ("5.50", "n", False), ("x", "str", False), ("45306", None, True), ("45306.5", None, True), ("0.25", None, True))] == [
        "True", "False", "5", "5.5", "x", "2024-01-15 00:00:00", "2024-01-15 12:00:00", "06:00:00",
    ]


def test_pdf_source(spark, tmp_path):
    body = zlib.compress(rb"BT (Hello \(world\)) Tj T* [(a) -20 (b)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj << /Length 9 /Filter /FlateDecode >> stream\n" + body + b"\nendstream endobj"
    assert documents.pdf_texts(pdf) == ["Hello (world)\nab"]
    (tmp_path / "x.pdf").write_bytes(pdf)
    assert documents.pdf_pages(documents.files(spark, str(tmp_path))).first().text == "# Page 1\n\nHello (world)\nab\n"
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 scanned")
    read = documents.pdf_pages(documents.files(spark, str(tmp_path)), ocr=lambda data, page, dpi: (f"at {dpi}", dpi / 400)).first()
    assert read.text == "# Page 1\n\nat 300\n"
    scan = b"%PDF-1.4\n" + b"".join(b"%d 0 obj << /Length 9 >> stream\nq /Im0 Do Q\nendstream endobj\n" % i for i in range(2)) + b"9 0 obj << /Subtype /Image >> stream\nxx\nendstream"
    assert documents.pdf_texts(scan) == ["", ""]
    (tmp_path / "x.pdf").write_bytes(scan)
    read = documents.pdf_pages(documents.files(spark, str(tmp_path)), ocr=lambda data, page, dpi: (f"p{page} at {dpi}", 0.7)).orderBy("page_index").collect()
    assert [(r.page_index, r.text) for r in read] == [(0, "# Page 1\n\np0 at 150\n"), (1, "# Page 2\n\np1 at 150\n")]


def test_reading_a_page():
    import time

    asked = []
    assert documents.read_page(lambda data, page, dpi: asked.append(dpi) or ("t", 0.69), b"", 0) == ("t", 0.69) and asked == [150, 300]
    assert documents.read_page(lambda data, page, dpi: time.sleep(5), b"", 0, most=150, seconds=0.05) == (documents.TIMED_OUT, 0.0)

    def absent():
        raise ImportError

    assert documents.first_engine(absent, lambda: "second") == "second" and documents.first_engine(absent) is None
    assert documents.mean_confidence([]) == 0 and documents.mean_confidence([0.5, 1.0]) == 0.75


def test_record_files(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"chunk_index": 0, "records": [1]}\n\n[1]\n{"x": 1}\n')
    got = {r.line: (r.chunk_index, r.problem) for r in records.job_results(spark, str(tmp_path / "r.jsonl")).collect()}
    assert got == {1: (0, None), 3: (None, "not an object"), 4: (None, "no chunk_index")}
    (tmp_path / "g.jsonl").write_text('[{"a": 1}]\n{"a": 2}\n\nbad\n')
    got = [(r.golden_json, r.problem) for r in records.golden_lines(spark, str(tmp_path / "g.jsonl")).orderBy("chunk_index").collect()]
    assert got == [('[{"a": 1}]', None), ('[{"a": 2}]', None), (None, "not records"), (None, "not records")]
    old = spark.createDataFrame([(0, "[]")], "chunk_index int, golden_json string")
    new = spark.createDataFrame([(2, "[1]")], "chunk_index int, golden_json string")
    assert [r.value for r in records.merge_golden(old, new).collect()] == ["[]", "", "[1]"]
    records.write_jsonl(old, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value) == {"chunk_index": 0, "golden_json": "[]"}


def test_manifests():
    good = {"chunks": [{"chunk_index": 0, "label": "positive"}]}
    assert records.load_manifest(json.dumps(good)) == good
    for bad in ("", "[]", '{"chunks": []}', '{"chunks": [{"label": "positive"}]}', '{"chunks": [{"chunk_index": 0, "label": "x"}]}', '{"addressing": "page_range", "chunks": [{"page_range": [2, 1], "label": "positive"}]}'):
        with pytest.raises(ValueError):
            records.load_manifest(bad)


def test_event_stream(spark, tmp_path):
    event = {"schema_version": "1.0", "ts": "2024-01-01T00:01:00Z", "event": "stage.end", "stage": "chunking", "duration_ms": 5}
    lines = [json.dumps(event), json.dumps({"level": "INFO", "message": json.dumps(event)}), json.dumps(event | {"event": "nope"}), "not json"]
    (tmp_path / "a.ndjson").write_text("\n".join(lines))
    stream = events.by_stage(events.follow(spark, str(tmp_path)))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("stages").start()
    run.processAllAvailable()
    run.stop()
    row = spark.table("stages").first()
    assert (row.stage, row.n, row.duration_ms) == ("chunking", 2, 10)
