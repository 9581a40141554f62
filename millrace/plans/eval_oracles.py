"""DuckDB SQL for the queries of :mod:`.eval_queries`."""

from __future__ import annotations

from .oracles import ORACLE_SQL

ORACLE_SQL["rows_in_results"] = "SELECT source, sum(CASE doc_id % 4 WHEN 0 THEN 2 ELSE 0 END)::BIGINT AS n_rows FROM documents GROUP BY source"

ORACLE_SQL["page_sets"] = "SELECT doc_id, array_to_string(list_sort(list_distinct([doc_id % 7, doc_id % 5])), ',') AS pages FROM documents"

ORACLE_SQL["chunk_extent"] = """
SELECT source AS fixture, doc_id % 10 AS chunk_index, min(least(doc_id % 9, doc_id % 4))::INT AS first_page, max(greatest(doc_id % 9, doc_id % 4))::INT AS last_page
FROM documents WHERE doc_id % 6 <> 0 GROUP BY 1, 2
"""

ORACLE_SQL["duplicate_anchors"] = "SELECT lang, (doc_id % 97)::VARCHAR AS anchor, count(*) AS n FROM documents WHERE doc_id % 97 <> 0 GROUP BY 1, 2 HAVING count(*) > 1"

ORACLE_SQL["job_detail"] = """
WITH jobs AS (SELECT source AS job_id, count(*) AS n_docs FROM documents GROUP BY 1),
runs AS (SELECT 'src' || conv_id % 30 AS job_id, count(*) AS n_runs, sum(length(text))::BIGINT AS latency_ms FROM conversations GROUP BY 1),
stages AS (SELECT 'src' || user_id % 12 AS job_id, count(*) AS n_stages, sum(floor(coalesce(value, 0)))::BIGINT AS stage_ms FROM events GROUP BY 1)
SELECT job_id, n_docs, coalesce(n_runs, 0) AS n_runs, coalesce(latency_ms, 0) AS latency_ms, coalesce(n_stages, 0) AS n_stages, coalesce(stage_ms, 0) AS stage_ms
FROM jobs LEFT JOIN runs USING (job_id) LEFT JOIN stages USING (job_id)
"""

ORACLE_SQL["display_strings"] = r"""
WITH ids AS (SELECT doc_id, 'ctr_' || substr(sha256(lang || chr(0) || source || chr(0) || 'm:C'), 1, 32) AS id FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substr(id, 1, 28) ELSE substr(id, 1, 27) || '…' END AS shown,
  CASE WHEN doc_id % 7 = 0 THEN 'partial' ELSE 'partial (' || doc_id % 5 || '/' || doc_id % 7 || ')' END AS status FROM ids
"""

ORACLE_SQL["timestamps"] = """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS local, 'log-' || strftime(ts, '%Y%m%d') || '.ndjson' AS file FROM events
"""

ORACLE_SQL["confidence_mean"] = "SELECT user_id, round(coalesce(avg(value) FILTER (event_id % 3 > 0), 0), 6) AS confidence FROM events GROUP BY user_id"

ORACLE_SQL["preflight_rows"] = r"""
SELECT doc_id::VARCHAR AS job_id, doc_id || CASE doc_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.xlsx' ELSE '.bin' END AS name,
  CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 10 > 0 AND length(trim(text, E' \t\n\r')) >= 50 THEN 'pdf_text' ELSE 'pdf_scanned' END WHEN 1 THEN 'excel' ELSE 'unknown' END AS file_type,
  strlen(text) AS bytes, (doc_id % 10 > 0)::BIGINT AS page_count,
  CASE WHEN doc_id % 3 = 0 THEN doc_id % 10 > 0 AND length(trim(text, E' \t\n\r')) >= 50 END AS has_text_layer, CASE WHEN doc_id % 10 > 0 THEN length(text) // 4 ELSE 0 END AS est_tokens
FROM documents
"""

ORACLE_SQL["golden_lookup"] = """
SELECT source AS fixture, doc_id AS exp_id, CASE WHEN doc_id % 4 = 3 THEN CASE WHEN doc_id % 5 = 0 THEN '[2]' END
  WHEN doc_id % 3 = 0 THEN '[1]' WHEN doc_id % 5 = 0 THEN '[2]' WHEN doc_id % 2 = 0 AND source <> 'src1' THEN '[3]' END AS golden_json,
  doc_id % 4 = 3 AND doc_id % 5 <> 0 AND source IN (SELECT source FROM documents WHERE doc_id % 2 = 0 AND source <> 'src1') AS has_problem FROM documents
"""

_SUITE = """
given AS (SELECT source AS fixture, doc_id AS id, lang, n_chars AS n, CASE WHEN doc_id % 5 = 0 THEN 'negative' ELSE 'positive' END AS label,
    doc_id % 23 = 0 AS by_page, doc_id % 7 > 0 OR doc_id % 21 = 1 AS present, doc_id % 7 = 0 AND doc_id % 21 = 1 OR doc_id % 11 = 0 AS broken, doc_id % 13 > 0 AS valid,
    doc_id % 17 = 0 AS none, doc_id % 3 <> 1 AND doc_id % 23 <> 0 AS has_golden, doc_id % 19 = 0 AS bad_golden FROM documents),
judged AS (SELECT *, CASE WHEN by_page AND NOT present THEN 'page_range_unresolved'
    WHEN label = 'negative' THEN CASE WHEN NOT present THEN 'correct_abstention' WHEN broken THEN 'record_json_parse_error' WHEN NOT valid THEN 'correct_abstention'
      WHEN none AND id % 2 = 0 THEN 'correct_abstention' ELSE 'false_positive' END
    WHEN NOT present THEN 'missing_chunk_in_results' WHEN broken THEN 'record_json_parse_error' WHEN NOT valid THEN 'schema_reject' WHEN none THEN 'missing_output'
    WHEN has_golden AND bad_golden THEN 'golden_parse_error' WHEN NOT has_golden THEN 'schema_pass_no_golden' WHEN id % 4 = 0 THEN 'field_mismatch' ELSE 'match' END AS reason FROM given),
verdicts AS (SELECT fixture, id AS exp_id, label, CASE WHEN by_page AND NOT present THEN NULL ELSE id END AS chunk_index, reason, reason IN ('correct_abstention', 'schema_pass_no_golden', 'match') AS passed,
    (has_golden AND NOT bad_golden)::INT AS n_golden, (present AND NOT broken AND NOT none)::INT AS n_actual FROM judged),
fields AS (SELECT fixture, id AS exp_id, 'paired' AS pairing, unnest(['id', 'lang', 'n']) AS field, unnest([id::VARCHAR, CASE WHEN id % 4 = 0 THEN 'zz' ELSE lang END, n::VARCHAR]) AS g_value,
    unnest([id::VARCHAR, lang, n::VARCHAR]) AS a_value, unnest(['exact', CASE WHEN id % 4 = 0 THEN 'mismatch' ELSE 'exact' END, 'exact']) AS match FROM judged WHERE reason IN ('match', 'field_mismatch'))
"""

ORACLE_SQL["score_fixtures"] = f"WITH {_SUITE} SELECT * FROM verdicts"

ORACLE_SQL["score_fields"] = f"WITH {_SUITE} SELECT * FROM fields"

ORACLE_SQL["score_summary"] = f"""
WITH {_SUITE},
totals AS (SELECT fixture, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (label = 'negative') AS negatives, count(*) FILTER (label = 'negative' AND passed) AS negatives_passed,
  count(*) FILTER (label <> 'negative' AND passed) AS positives_passed, round(count(*) FILTER (reason = 'false_positive') / nullif(count(*) FILTER (label = 'negative'), 0), 6) AS false_positive_rate,
  bool_and(passed) AS overall_ok FROM verdicts GROUP BY fixture),
seen AS (SELECT fixture, round(count(*) FILTER (match = 'exact') / count(*), 6) AS accuracy, count(*) FILTER (match = 'mismatch') AS field_mismatches FROM fields GROUP BY fixture)
SELECT * FROM totals LEFT JOIN seen USING (fixture)
"""

# the stub answers by the length of its prompt, which is the text's length and a multiple of four; answers that do not fit are asked for twice more
ORACLE_SQL["extract_stub"] = """
SELECT source AS job_id, doc_id::INT AS chunk_index, CASE WHEN length(text) % 2 = 0 THEN 'completed' ELSE 'dead_letter' END AS outcome, CASE WHEN length(text) % 2 = 0 THEN 1 ELSE 3 END AS n_runs FROM documents
"""
