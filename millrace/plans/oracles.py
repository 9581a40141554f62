"""DuckDB SQL for the registered queries."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["token_estimate"] = "SELECT lang, floor(sum(length(text)) / 4)::BIGINT AS est_tokens FROM documents GROUP BY lang"

ORACLE_SQL["preflight_classify"] = """
SELECT CASE WHEN length(trim(text, ' \t\n\r')) >= 50 THEN 'pdf_text' ELSE 'pdf_scanned' END AS file_type, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1
"""

ORACLE_SQL["file_kinds"] = """
SELECT CASE doc_id % 4 WHEN 0 THEN 'excel' WHEN 1 THEN 'pdf' ELSE CASE doc_id % 8 WHEN 2 THEN 'pdf' WHEN 3 THEN 'excel' ELSE 'unknown' END END AS file_type, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1
"""

ORACLE_SQL["text_windows"] = """
SELECT doc_id, (i / 7373)::INT AS part, length(substr(text, i::BIGINT + 1, 8192)) AS n_chars, sha256(substr(text, i::BIGINT + 1, 8192)) AS sha256
FROM (SELECT doc_id, text, unnest(range(0, length(text), 7373)) AS i FROM documents WHERE length(text) // 4 > 2048)
"""

_FOLD = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY page_index, part) AS rn FROM parts),
fold AS (
  SELECT job_id, rn, page_index, part, tokens, text, 0 AS chunk_index, tokens AS cur, length(text) > 0 AS filled FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.job_id, n.rn, n.page_index, n.part, n.tokens, n.text, f.chunk_index + (f.filled AND f.cur + n.tokens > 2048)::INT,
    CASE WHEN f.filled AND f.cur + n.tokens > 2048 THEN n.tokens ELSE f.cur + n.tokens END,
    CASE WHEN f.filled AND f.cur + n.tokens > 2048 THEN length(n.text) > 0 ELSE f.filled OR length(n.text) > 0 END
  FROM fold f JOIN numbered n ON n.job_id = f.job_id AND n.rn = f.rn + 1)
"""

ORACLE_SQL["merge_segments"] = f"""
WITH RECURSIVE parts AS (SELECT source AS job_id, doc_id AS page_index, 0 AS part, length(text) // 4 AS tokens, text FROM documents), {_FOLD}
SELECT job_id, chunk_index, sum(tokens)::BIGINT AS tokens, count(*) AS n_pages, min(page_index) AS first_page, max(page_index) AS last_page FROM fold GROUP BY job_id, chunk_index
"""

# no page of the test tables is long and table-like, so the text branch is the whole
ORACLE_SQL["chunk_documents"] = f"""
WITH RECURSIVE cut AS (
  SELECT source AS job_id, doc_id AS page_index, unnest(CASE WHEN length(text) // 4 <= 2048 THEN [text] ELSE list_transform(range(0, length(text), 7373), lambda i: substr(text, i::BIGINT + 1, 8192)) END) AS text,
    unnest(CASE WHEN length(text) // 4 <= 2048 THEN [0] ELSE range(0, ((length(text) - 1) // 7373 + 1)::BIGINT) END) AS part FROM documents),
parts AS (SELECT *, length(text) // 4 AS tokens FROM cut), {_FOLD},
chunks AS (SELECT job_id, chunk_index, count(DISTINCT page_index) AS n_pages, min(page_index) AS first_page, sum(tokens)::BIGINT AS estimated_tokens,
  string_agg(text, chr(10) || chr(10) ORDER BY rn) AS text FROM fold GROUP BY job_id, chunk_index)
SELECT job_id, chunk_index, n_pages, first_page, estimated_tokens, length(text) AS n_chars, sha256(text) AS sha256 FROM chunks
"""

ORACLE_SQL["table_blocks"] = """
WITH lines AS (SELECT (l_orderkey % 16)::INT AS sheet, '| ' || l_orderkey || ' | ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_returnflag || ' |' AS line,
  row_number() OVER (PARTITION BY l_orderkey % 16 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS i FROM lineitem),
blocks AS (SELECT sheet, (i // 80)::INT AS block, string_agg(line, chr(10) ORDER BY i) AS body FROM lines GROUP BY 1, 2),
pieces AS (SELECT sheet, block, CASE WHEN block = 0 THEN '# Sheet' || chr(10) || chr(10) || chr(10) ELSE '' END || '| order | line | part | flag |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || body || chr(10) AS piece FROM blocks)
SELECT sheet, block, length(piece) AS n_chars, sha256(piece) AS sha256 FROM pieces
"""

ORACLE_SQL["separator_rows"] = """
SELECT l_linenumber, count(*) FILTER (NOT regexp_matches(line, '[a-zA-Z]')) AS separators, 0::BIGINT AS strict, count(*) AS n
FROM (SELECT l_linenumber, '| ' || l_orderkey || ' | ' || l_linenumber || ' | ' || CASE WHEN l_linenumber > 3 THEN l_returnflag ELSE '-' END || ' |' AS line FROM lineitem) GROUP BY 1
"""

ORACLE_SQL["page_select"] = "SELECT conv_id, turn, role FROM conversations WHERE turn IN (1, 3, 4, 5)"

ORACLE_SQL["content_dedup"] = """
SELECT id, content_sha256, completed_at FROM (SELECT doc_id AS id, sha256(text) AS content_sha256, doc_id % 7 AS completed_at,
  row_number() OVER (PARTITION BY sha256(text), lang ORDER BY doc_id % 7 DESC, doc_id DESC) AS rn FROM documents WHERE doc_id % 5 <> 0) WHERE rn = 1
"""

ORACLE_SQL["content_dup_groups"] = "SELECT sha256(text) AS content_sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1"

ORACLE_SQL["contract_ids"] = "SELECT DISTINCT lang, source, 'ctr_' || substr(sha256(lang || chr(0) || source || chr(0) || 'm:C'), 1, 32) AS contract_id FROM documents WHERE lang <> 'en'"

ORACLE_SQL["prompt_versions"] = "SELECT doc_id, substr(sha256(lang || chr(10) || '---' || chr(10) || text), 1, 16) AS prompt_version FROM documents"

ORACLE_SQL["json_props"] = """
SELECT event_type, count(*) FILTER (json_valid(props)) AS n_json, sum((props::JSON->>'k')::BIGINT)::BIGINT AS sum_k, count(*) FILTER ((props::JSON->>'k') IS NULL) AS absent FROM events GROUP BY 1
"""

ORACLE_SQL["json_wrapped"] = "SELECT event_id, CASE event_id % 6 WHEN 1 THEN 2 WHEN 4 THEN NULL WHEN 5 THEN 0 ELSE 1 END::INT AS n_records FROM events"

ORACLE_SQL["validate_records"] = """
SELECT event_id, CASE WHEN event_id % 5 IN (0, 4) THEN 1 ELSE 0 END::INT AS n_valid, event_id % 5 IN (1, 3) AS has_error,
  CASE WHEN event_id % 5 IN (0, 4) THEN (props::JSON->>'k')::BIGINT END AS k FROM events
"""

ORACLE_SQL["drop_all_null"] = """
SELECT a, count(*) AS n, count(b) AS n_b FROM (SELECT CASE WHEN event_id % 3 > 0 THEN event_type END AS a, CASE WHEN event_id % 2 > 0 THEN value END AS b FROM events)
WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY a
"""

# golden day and actual day are the same date; priorities differ by case or altogether
_PAIRS = """
golden AS (SELECT o_orderstatus AS chunk, o_orderkey AS i, o_orderpriority AS priority FROM orders),
diffs AS (
  SELECT chunk, i, priority, i % 11 = 0 AS lost, i % 13 = 0 AS loose, f.field,
    CASE WHEN i % 11 = 0 OR i % 13 = 0 THEN 'missing'
      WHEN f.field = 'day' THEN CASE WHEN i % 3 = 0 THEN 'normalized' ELSE 'exact' END
      WHEN i % 5 = 0 THEN CASE WHEN lower(priority) = priority THEN 'exact' ELSE 'normalized' END WHEN i % 7 = 0 THEN 'mismatch' ELSE 'exact' END AS match
  FROM golden, (VALUES ('day'), ('priority')) f(field)
  UNION ALL
  SELECT chunk, i, priority, false, true, f.field, 'extra' FROM golden, (VALUES ('day'), ('priority')) f(field) WHERE i % 13 = 0 AND i % 11 <> 0)
"""
ORACLE_SQL["anchor_score"] = f"WITH {_PAIRS} SELECT chunk, field, match, count(*) AS n FROM diffs GROUP BY ALL"
ORACLE_SQL["anchor_accuracy"] = f"WITH {_PAIRS} SELECT chunk, round(count(*) FILTER (match IN ('exact', 'normalized')) / count(*), 6) AS accuracy, bool_and(match IN ('exact', 'normalized')) AS all_ok FROM diffs GROUP BY ALL"

ORACLE_SQL["index_score"] = """
SELECT o_orderstatus AS chunk, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' ELSE 'paired' END AS pairing,
  CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN CASE WHEN lower(o_orderpriority) = o_orderpriority THEN 'exact' ELSE 'normalized' END WHEN o_orderkey % 7 = 0 THEN 'mismatch' ELSE 'exact' END AS match, count(*) AS n
FROM orders GROUP BY ALL
"""

ORACLE_SQL["duplicate_anchor_fifo"] = """
WITH sides AS (SELECT l_orderkey % 8 AS chunk, l_orderkey || '-' || l_linenumber AS key, count(*) AS g, count(*) FILTER (l_partkey % 3 > 0) AS a FROM lineitem GROUP BY 1, 2)
SELECT chunk, 'paired' AS pairing, sum(least(g, a))::BIGINT AS n FROM sides GROUP BY chunk UNION ALL SELECT chunk, 'missing', sum(g - a)::BIGINT FROM sides GROUP BY chunk
"""

ORACLE_SQL["page_range_resolve"] = """
WITH chunks AS (SELECT conv_id AS fixture, (turn // 2)::INT AS chunk_index, list(DISTINCT turn) AS pages FROM conversations GROUP BY 1, 2),
asked AS (SELECT conv_id AS fixture, turn AS range_id, range(turn, turn + conv_id % 4 + 1) AS pages FROM conversations),
tested AS (SELECT a.fixture, range_id, chunk_index, len(list_filter(c.pages, lambda p: NOT list_contains(a.pages, p))) = 0 AS inside,
  len(list_filter(a.pages, lambda p: NOT list_contains(c.pages, p))) = 0 AS holds FROM asked a JOIN chunks c USING (fixture)),
counted AS (SELECT fixture, range_id, count(*) FILTER (inside) AS n1, min(chunk_index) FILTER (inside) AS c1, count(*) FILTER (holds) AS n2, min(chunk_index) FILTER (holds) AS c2 FROM tested GROUP BY 1, 2),
picked AS (SELECT fixture, range_id, CASE WHEN n1 > 0 THEN n1 ELSE n2 END AS n, CASE WHEN n1 > 0 THEN c1 ELSE c2 END AS c FROM counted)
SELECT fixture, range_id, CASE WHEN n = 0 THEN 'page_range_unresolved' WHEN n > 1 THEN 'page_range_ambiguous' ELSE 'resolved' END AS reason, CASE WHEN n = 1 THEN c END AS chunk_index FROM picked
"""

_VERDICTS = """
facts AS (SELECT d.doc_id, lang, CASE WHEN coalesce(quality, 1) = 1 THEN 'positive' ELSE 'negative' END AS label, quality IS NOT NULL AS present, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
verdicts AS (SELECT doc_id, lang, label, CASE
  WHEN label = 'negative' AND NOT present THEN 'correct_abstention' WHEN NOT present THEN 'missing_chunk_in_results' WHEN doc_id % 17 = 0 THEN 'record_json_parse_error'
  WHEN label = 'negative' THEN CASE WHEN doc_id % 13 = 0 OR (toxic = 0 AND doc_id % 2 = 0) THEN 'correct_abstention' ELSE 'false_positive' END
  WHEN doc_id % 13 = 0 THEN 'schema_reject' WHEN toxic = 1 THEN 'missing_output' WHEN doc_id % 19 = 0 THEN 'golden_parse_error' WHEN doc_id % 5 = 0 THEN 'schema_pass_no_golden'
  WHEN doc_id % 3 > 0 THEN 'match' ELSE 'field_mismatch' END AS reason FROM facts),
judged AS (SELECT *, reason IN ('correct_abstention', 'schema_pass_no_golden', 'match') AS passed FROM verdicts)
"""
ORACLE_SQL["eval_reasons"] = f"WITH {_VERDICTS} SELECT doc_id, label, reason, passed FROM judged"
ORACLE_SQL["eval_summary"] = f"""
WITH {_VERDICTS} SELECT lang, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (label = 'negative') AS negatives, count(*) FILTER (label = 'negative' AND passed) AS negatives_passed,
  count(*) FILTER (label = 'positive' AND passed) AS positives_passed, round(count(*) FILTER (reason = 'false_positive') / nullif(count(*) FILTER (label = 'negative'), 0), 6) AS false_positive_rate, bool_and(passed) AS overall_ok
FROM judged GROUP BY lang
"""

ORACLE_SQL["compare_number"] = "SELECT l_orderkey % 6 AS k, CASE l_orderkey % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'exact' WHEN 4 THEN 'normalized' WHEN 5 THEN 'missing' ELSE 'mismatch' END AS match, count(*) AS n FROM lineitem GROUP BY ALL"
ORACLE_SQL["compare_currency"] = "SELECT o_orderkey % 4 AS k, CASE o_orderkey % 4 WHEN 2 THEN 'mismatch' ELSE 'exact' END AS match, count(*) AS n FROM orders GROUP BY ALL"
ORACLE_SQL["compare_percent"] = """
SELECT l_orderkey % 3 AS k, CASE WHEN l_orderkey % 3 = 2 THEN 'mismatch' WHEN l_orderkey % 3 = 0 AND e <> a THEN 'normalized' ELSE 'exact' END AS match, count(*) AS n
FROM (SELECT l_orderkey, round(l_discount * 100)::DOUBLE / 100 AS e, ('0.' || lpad(round(l_discount * 100)::BIGINT::VARCHAR, 2, '0'))::DOUBLE AS a FROM lineitem) GROUP BY ALL
"""
ORACLE_SQL["compare_date"] = "SELECT o_orderkey % 5 AS k, CASE o_orderkey % 5 WHEN 3 THEN 'mismatch' WHEN 4 THEN 'exact' ELSE 'normalized' END AS match, count(*) AS n FROM orders GROUP BY ALL"
ORACLE_SQL["compare_string"] = "SELECT c_custkey % 4 AS k, CASE c_custkey % 4 WHEN 2 THEN 'mismatch' WHEN 3 THEN 'exact' ELSE 'normalized' END AS match, count(*) AS n FROM customer GROUP BY ALL"

ORACLE_SQL["resume_pending"] = "SELECT source AS job_id, count(*) AS pending, min(doc_id) AS first_chunk FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1"

ORACLE_SQL["retry_promotion"] = """
WITH lines AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS total, count(DISTINCT l_linenumber) FILTER (l_linenumber < 6) AS done, bool_or(l_returnflag = 'R' AND l_linenumber = 7) AS waiting FROM lineitem GROUP BY 1)
SELECT CASE o_orderstatus WHEN 'O' THEN 'partial' ELSE 'failed' END AS status, count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM orders JOIN lines ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' AND NOT waiting AND done = total GROUP BY 1
"""

ORACLE_SQL["job_status"] = """
WITH counts AS (SELECT o_orderkey, count(*) FILTER (l_returnflag <> 'R') AS done, count(*) FILTER (l_returnflag = 'R') AS failed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT CASE WHEN failed = 0 THEN 'completed' WHEN done > 0 THEN 'partial' ELSE 'failed' END AS status, count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM counts GROUP BY 1
"""

ORACLE_SQL["attempt_runs"] = """
SELECT event_id, row_number() OVER w AS attempt, CASE WHEN row_number() OVER w = 1 THEN 'extraction' ELSE 'repair' END AS run_type, lead(1) OVER w IS NULL AS is_last,
  lead(1) OVER w IS NULL AND event_type <> 'error' AS validation_passed FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)
"""

_STATS = """count(*) AS calls, sum(length(props) + event_id % 100)::BIGINT AS tokens_in, sum(length(event_type))::BIGINT AS tokens_out, sum(floor(abs(value)))::BIGINT AS latency_sum, round(avg(floor(abs(value))), 6) AS latency_avg,
  min(floor(abs(value)))::BIGINT AS latency_min, max(floor(abs(value)))::BIGINT AS latency_max, count(*) FILTER (event_type = 'click') AS repairs, count(*) FILTER (event_type = 'error') AS failures FROM events"""
ORACLE_SQL["llm_run_stats"] = f"SELECT user_id, {_STATS} GROUP BY user_id"
ORACLE_SQL["suite_totals"] = f"SELECT {_STATS}"

ORACLE_SQL["bench_metrics"] = """
WITH days AS (SELECT ts::DATE AS day, count(*) FILTER (event_type <> 'error') / count(*) AS pass_rate, count(*) AS n, max(floor(abs(value)))::BIGINT AS peak, count(*) FILTER (event_type = 'view') AS plain, count(*) FILTER (event_type = 'click') AS dual FROM events GROUP BY 1)
SELECT day::VARCHAR AS day, round(pass_rate, 6) AS pass_rate, peak, round(n * 60 / 86400, 6) AS per_minute, round(CASE WHEN plain > 0 THEN (dual - plain) / plain * 100 ELSE 0 END, 6) AS overhead, CASE WHEN plain > 0 THEN (dual - plain) / plain * 100 ELSE 0 END > 10 AS regression FROM days
"""

ORACLE_SQL["event_validate"] = """
SELECT CASE WHEN event_id % 9 = 0 THEN 'bad version' WHEN event_type = 'purchase' THEN 'unknown event' WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'missing field' WHEN event_type = 'view' AND event_id % 7 = 0 THEN 'missing field'
  WHEN event_type = 'error' AND (event_id % 4 = 0 OR event_id % 5 = 0) THEN 'missing field' END AS problem, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1
"""

ORACLE_SQL["last_write_wins"] = "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"

ORACLE_SQL["export_records"] = """
SELECT event_id, unnest(range(0, CASE event_id % 6 WHEN 1 THEN 2 WHEN 4 THEN 0 WHEN 5 THEN 0 ELSE 1 END))::INT AS i, (props::JSON->>'k')::BIGINT AS k FROM events
"""

ORACLE_SQL["sampled_estimate"] = """
WITH rows AS (SELECT l_returnflag, length(l_orderkey || '' || l_partkey || l_returnflag) AS chars, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem),
parts AS (SELECT l_returnflag, count(*) AS rows, sum(chars) FILTER (rn <= 500) AS chars, count(*) FILTER (rn <= 500) AS n FROM rows GROUP BY 1)
SELECT l_returnflag, rows, floor(chars * rows / n)::BIGINT AS est_chars FROM parts
"""

from . import eval_oracles  # noqa: E402, F401  (adds its statements)
