"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .quality import CATCH, GOOD, ROUNDS, RULES, SLIP, WEIGHT

OP1 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) = '' THEN 'other'
         ELSE 'd' || (regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1)::BIGINT % 4) END AS domain,
         lang, source, greatest(1, ceil(strlen(coalesce(text, '')) / 4))::BIGINT AS n_tokens
  FROM documents),
leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, 2 * sum(n_tokens)::BIGINT AS cap,
         CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS w1,
         CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w2, 1 AS w3
  FROM docs GROUP BY ALL),
d1 AS (SELECT domain, sum(cap)::BIGINT AS cap, max(w1) AS w, (SELECT floor(sum(tokens) * 0.8::DOUBLE)::BIGINT FROM leaves) AS amount FROM leaves GROUP BY domain),
f1 AS (SELECT *, amount - coalesce(sum(cap) OVER b, 0) AS room, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_left FROM d1
       WINDOW b AS (ORDER BY cap / w, domain NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g1 AS (SELECT *, room * w >= cap * w_left AS is_full FROM f1),
a1 AS (SELECT domain, least(cap, CASE WHEN is_full THEN cap ELSE floor(greatest(0, amount - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) * w
       / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ()) END)::BIGINT AS granted FROM g1),
d2 AS (SELECT l.domain, l.lang, sum(l.cap)::BIGINT AS cap, max(w2) AS w, any_value(a.granted) AS amount
       FROM leaves l JOIN a1 a ON l.domain IS NOT DISTINCT FROM a.domain GROUP BY l.domain, l.lang),
f2 AS (SELECT *, amount - coalesce(sum(cap) OVER b, 0) AS room, sum(w) OVER (PARTITION BY domain) - coalesce(sum(w) OVER b, 0) AS w_left FROM d2
       WINDOW b AS (PARTITION BY domain ORDER BY cap / w, domain NULLS FIRST, lang NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g2 AS (SELECT *, room * w >= cap * w_left AS is_full FROM f2),
a2 AS (SELECT domain, lang, least(cap, CASE WHEN is_full THEN cap ELSE floor(greatest(0, amount - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY domain)) * w
       / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY domain)) END)::BIGINT AS granted FROM g2),
d3 AS (SELECT l.domain, l.lang, l.source, l.cap, l.tokens, w3 AS w, a.granted AS amount
       FROM leaves l JOIN a2 a ON l.domain IS NOT DISTINCT FROM a.domain AND l.lang IS NOT DISTINCT FROM a.lang),
f3 AS (SELECT *, amount - coalesce(sum(cap) OVER b, 0) AS room, sum(w) OVER (PARTITION BY domain, lang) - coalesce(sum(w) OVER b, 0) AS w_left FROM d3
       WINDOW b AS (PARTITION BY domain, lang ORDER BY cap / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g3 AS (SELECT *, room * w >= cap * w_left AS is_full FROM f3),
a3 AS (SELECT domain, lang, source, tokens, least(cap, CASE WHEN is_full THEN cap ELSE floor(greatest(0, amount - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY domain, lang)) * w
       / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY domain, lang)) END)::BIGINT AS quota FROM g3),
q AS (SELECT *, quota // tokens AS whole, quota % tokens AS rest FROM a3 WHERE quota > 0),
placed AS (
  SELECT d.*, q.whole, q.rest,
    coalesce(sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('17:' || q.whole || ':' || coalesce(doc_id::VARCHAR, '') || ':' || n_tokens), doc_id, n_tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM docs d JOIN q ON d.domain IS NOT DISTINCT FROM q.domain AND d.lang IS NOT DISTINCT FROM q.lang AND d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, domain, lang, source, n_tokens, (whole + CASE WHEN pos < rest THEN 1 ELSE 0 END)::BIGINT AS copies,
  (whole * n_tokens + CASE WHEN pos < rest THEN least(n_tokens, rest - pos) ELSE 0 END)::BIGINT AS take_tokens
FROM placed WHERE whole + CASE WHEN pos < rest THEN 1 ELSE 0 END > 0
"""

def quality_ctes(source: str = "documents") -> str:
    """CTEs up to ``judged(doc_id, features..., base_failed, kept)``."""
    m = len(RULES)
    each = range(1, m + 1)
    cols = ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END" for r in RULES)
    odds = " + ".join(
        f"CASE v[{j}] WHEN -1 THEN ln(g[{j}] / b[{j}]) WHEN 1 THEN ln((1 - g[{j}]) / (1 - b[{j}])) ELSE 0 END" for j in each
    )
    good = f"1 / (1 + exp(-(ln(pi / (1 - pi)) + {odds})))"
    prior = f"{WEIGHT}::DOUBLE * any_value(total)"
    rate = lambda j, of, start: (
        f"(sum(CASE WHEN v[{j}] = -1 THEN n * {of} ELSE 0 END) + {prior} * {start}::DOUBLE) / (sum(CASE WHEN v[{j}] <> 0 THEN n * {of} ELSE 0 END) + {prior})"
    )
    gs, bs = ", ".join(rate(j, "c", SLIP) for j in each), ", ".join(rate(j, "(1 - c)", CATCH) for j in each)
    share = f"(sum(n * c) + {prior} * {GOOD}::DOUBLE) / (any_value(total) + {prior})"
    g0, b0 = [SLIP] * m, [CATCH] * m
    return rf"""
q_words AS (SELECT doc_id, rn, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM (SELECT *, row_number() OVER () AS rn FROM {source})),
q_windows AS (SELECT rn, i, array_to_string(words[i:i + 4], ' ') AS w FROM (SELECT rn, words, unnest(range(1, len(words) - 3)) AS i FROM q_words)),
q_again AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, w) AS c FROM q_windows) WHERE c > 1),
q_cover AS (SELECT rn, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT rn, i, lead(i) OVER (PARTITION BY rn ORDER BY i) AS nxt FROM q_again) GROUP BY rn),
q_feat AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!]+', '', 'g')) AS n_shouts
  FROM q_words LEFT JOIN q_cover USING (rn)),
q_votes AS (SELECT *, [{cols}] AS v FROM q_feat),
q_pats AS (SELECT v, count(*)::DOUBLE AS n, (SELECT count(*) FROM q_votes)::DOUBLE AS total FROM q_votes GROUP BY v),
q_em AS (
  SELECT 0 AS it, {GOOD}::DOUBLE AS pi, {g0}::DOUBLE[] AS g, {b0}::DOUBLE[] AS b
  UNION ALL
  SELECT it + 1, {share}, [{gs}], [{bs}]
  FROM (SELECT it, v, n, total, {good} AS c FROM q_em, q_pats WHERE it < {ROUNDS}) GROUP BY it),
q_judged AS (SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {good} >= 0.5 AS kept
  FROM q_votes, (SELECT * FROM q_em ORDER BY it DESC LIMIT 1))"""


OP3 = f"WITH RECURSIVE {quality_ctes()} SELECT * FROM q_judged"

OP8 = r"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules AS (SELECT *, split_part(rule, '/', 1) AS h, substr(rule, position('/' IN rule)) AS p FROM (VALUES
  ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')) t(verdict, rule)),
fits AS (SELECT page_id, host, path, rule, verdict FROM parsed, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
ruled AS (SELECT DISTINCT page_id, arg_max(rule, length(rule)) OVER (PARTITION BY page_id) AS rule, arg_max(verdict, length(rule)) OVER (PARTITION BY page_id) AS verdict FROM fits),
hosts AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, 
    CASE WHEN is_address THEN name ELSE array_to_string(string_split(name, '.')[-(2 + two):], '.') END AS domain,
    CASE WHEN is_address THEN name ELSE array_to_string(string_split(name, '.')[-(1 + two):], '.') END AS suffix
  FROM (SELECT *, regexp_matches(name, '^([0-9]{1,3}\.){3}[0-9]{1,3}$|^\[.*\]$') AS is_address,
    regexp_matches(name, '\.(ac|co|com|edu|gob|gouv|gov|go|ltd|me|mil|ne|net|nom|or|org|plc|sch)\.[a-z][a-z]$')::INT AS two
    FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS name FROM parsed)) LEFT JOIN (SELECT doc_id, (quality = 0 OR toxic = 1)::BIGINT AS bad FROM labels WHERE (quality = 0 OR toxic = 1) IS NOT NULL) ON page_id = doc_id GROUP BY host, name, is_address, two),
domains AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
stats AS (SELECT lvl, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, count(*) AS k, sum(n::DOUBLE * n) AS sq, sum(bad::DOUBLE * bad / n) AS ratio, (sum(bad) + 1) / (sum(n) + 2) AS p
  FROM (SELECT 'h' AS lvl, n, bad FROM hosts UNION ALL SELECT 'd', n, bad FROM domains UNION ALL SELECT 's', n, bad FROM suffixes) WHERE n > 0 GROUP BY lvl),
shares AS (SELECT lvl, p, CASE WHEN k < 2 OR n - sq / n <= 0 THEN 0 ELSE (ratio - 2 * p * bad + p * p * n - (k - 1) * p * (1 - p)) / ((n - sq / n) * p * (1 - p)) END AS share FROM stats),
strengths AS (SELECT coalesce(max(p), 0.5) AS overall, coalesce(max(m) FILTER (lvl = 'h'), 1000) AS mh, coalesce(max(m) FILTER (lvl = 'd'), 1000) AS md, coalesce(max(m) FILTER (lvl = 's'), 1000) AS ms
  FROM (SELECT lvl, p, CASE WHEN share <= 0 THEN 1000 ELSE least(1000, greatest(1, 1 / share - 1)) END AS m FROM shares)),
means AS (SELECT host, h.n, mh, (mh * ((md * ((ms * overall + s.bad) / (ms + s.n)) + d.bad) / (md + d.n)) + h.bad) / (mh + h.n) AS mean
  FROM hosts h JOIN domains d ON h.domain = d.domain JOIN suffixes s ON d.suffix = s.suffix, strengths)
SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.verdict, CASE WHEN mean - 1.0 * sqrt(mean * (1 - mean) / (mh + n + 1)) > 0.3 THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed p JOIN means m ON p.host = m.host LEFT JOIN ruled r ON p.page_id = r.page_id
"""

OP5 = r"""
WITH words AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
each AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM words),
windows AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS w FROM each),
firsts AS (SELECT w, min(doc_id) AS first_doc FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM windows JOIN firsts USING (w) WHERE first_doc < doc_id),
holes AS (SELECT doc_id, list(pos) AS ats FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, words, CASE WHEN ats IS NULL THEN words ELSE list_filter(words, lambda w, i: NOT list_contains(ats, i)) END AS left_words
  FROM words LEFT JOIN holes USING (doc_id))
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - len(left_words))::BIGINT AS n_removed, sha256(array_to_string(left_words, ' ')) AS kept_sha256 FROM kept
"""

OP10 = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
shingles AS (SELECT DISTINCT doc_id, hash(array_to_string(words[i:i + 4], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM words WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b USING (h) JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (SELECT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
parts AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id)::BIGINT AS component_id FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN parts USING (doc_id)
"""

ORACLE_SQL = {"op10_jaccard_join": OP10, "op5_substring_dedup": OP5, "op1_mixing": OP1, "op3_quality": OP3, "op8_url_filter": OP8}
