"""Backends, the event log, token windows and synthetic tables."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from millrace.operators import chunking, extraction
from millrace.sources import generators
from millrace.streaming import events, log


@pytest.fixture
def endpoint():
    """A server that fails once and then answers both protocols."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def _say(self, code, body):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self._say(200, {"models": [{"name": "m:latest"}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, body))
            if body["model"] == "wrong":
                self._say(400, {})
            elif len(asked) == 1:
                self._say(503, {})
            elif self.path == "/api/chat":
                self._say(200, {"message": {"content": "[]"}, "prompt_eval_count": 3, "eval_count": 1})
            else:
                self._say(200, {"choices": [{"message": {"content": "[1]"}}], "usage": {"prompt_tokens": 7, "completion_tokens": 2}})

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_backends(endpoint):
    url, asked = endpoint
    reply = extraction.ChatBackend(url, "m", "k", pause=0).complete("s", "u")
    assert (reply.text, reply.tokens_in, reply.tokens_out) == ("[1]", 7, 2) and len(asked) == 2 and asked[1][1]["response_format"] == {"type": "json_object"}
    with pytest.raises(OSError):
        extraction.ChatBackend(url, "wrong", "k", pause=0).complete("s", "u")
    assert len(asked) == 3
    assert extraction.OllamaBackend(url, "m").complete("s", "u").tokens_in == 3
    assert extraction.OllamaBackend(url, "m").problem() is None and "no model" in extraction.OllamaBackend(url, "other").problem()
    assert extraction.ChatBackend(url, "m").problem() == "no key is set" and extraction.ChatBackend(url, "m", "k").problem() is None
    assert "no answer" in extraction.OllamaBackend("http://127.0.0.1:9", "m").problem()


def test_event_log(spark, tmp_path, capsys):
    own = log.EventLog(str(tmp_path / "log"))
    with log.bind(job_id="j"), log.timed_stage(own, "chunking", every=0.01):
        threading.Event().wait(0.1)
    (path,) = (tmp_path / "log").iterdir()
    rows = events.parse(spark.read.text(str(path))).collect()
    assert {r.problem for r in rows} == {None} and {r.job_id for r in rows} == {"j"} and [r.event for r in rows][0] == "stage.start" and rows[-1].event == "stage.end"
    assert sum(r.event == "rss.sample" for r in rows) > 2
    (tmp_path / "file").write_text("")
    broken = log.EventLog(str(tmp_path / "file" / "x"))
    broken.write("job.start")
    broken.write("job.start")
    assert capsys.readouterr().err.count("event log is off") == 1


def test_token_windows(spark):
    class Words:
        def encode(self, text):
            return text.split()

        def decode(self, ids):
            return " ".join(ids)

    docs = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, ""), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.part, r.text, r.n_tokens) for r in chunking.token_windows(docs, Words, 4, 0.25).collect())
    assert got == [(1, 0, "0 1 2 3", 4), (1, 1, "3 4 5 6", 4), (1, 2, "6 7 8 9", 4), (1, 3, "9", 1)]


def test_synthetic_tables(spark):
    rows = generators.fleet(spark, 2000, seed=3)
    assert rows.collect() == generators.fleet(spark, 2000, seed=3).collect() and rows.count() == 2000
    nulls = rows.agg(F.count_if(F.col("make").isNull()), F.count_if(F.col("vin").isNull())).first()
    assert all(50 < n < 150 for n in nulls)
    sheet = generators.workbook_rows(rows.limit(3), "Fleet", "row", ("Title", "", "")).orderBy("row").collect()
    assert sheet[3].cells == ["make", "year", "vin", "value"] and len(sheet) == 7 and len(sheet[4].cells) == 4
    pages = generators.policy_pages(spark).orderBy("page_index").collect()
    assert len(pages) == 15 and pages[0].text.count("VIN:") == 5 and pages[1].text.startswith("Endorsement 1\n")
