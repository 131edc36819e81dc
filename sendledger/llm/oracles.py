r"""DuckDB SQL of the queries that SQL can express."""

UP = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL: dict[str, str] = {}

SQL["op1_ngram_jaccard"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UP}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT i.a, i.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM s x JOIN s y USING (g)
    WHERE x.doc_id <> y.doc_id GROUP BY ALL) i
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * inter >= 75 * (na.n + nb.n - inter)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles,
  least(w.doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id)"""

SQL["op2_url_rules"] = rf"""
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
x AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '(?s)^[^/?#]*'), {UP}), '') AS host,
  coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '(?s)^[^/?#]*')) + 1), '(?s)^[^?#]*'), '') AS path FROM u)
SELECT page_id, host, path, best.rule, coalesce(best.verdict, 'allow') AS verdict
FROM x LEFT JOIN (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM x) JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL) best USING (host, path)"""

SQL["op5_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
g AS (SELECT *, bool_or(regexp_matches(text, '<\\*\|im_(start|end)\|>')) OVER (PARTITION BY conv_id) AS odd FROM c),
f AS (SELECT *, CASE WHEN odd THEN regexp_replace(text, '<(\\*)\|im_(start|end)\|>', '<\\\1|im_\2|>', 'g') ELSE text END
  AS shown FROM g)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(length(string_agg(text, '') FILTER (role = 'assistant')), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>' || role || chr(10) || shown || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars,
  any_value(odd) AS escaped, true AS identical
FROM f GROUP BY conv_id"""

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _found(name: str, kind: int, pattern: str, group: int) -> str:
    return f"""{name} AS (
  SELECT doc_id, source, lang, text_key, {kind} AS kind, unnest(list_transform(generate_series(1, len(m)), lambda i: {{
    'start': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
    'size': length(m[i]), 'value': v[i]}})) AS s
  FROM (SELECT doc_id, source, lang, md5(coalesce(text, '')) AS text_key, regexp_extract_all(coalesce(text, ''), '{pattern}') AS m,
    regexp_extract_all(coalesce(text, ''), '{pattern}', {group}) AS v,
    string_split_regex(coalesce(text, ''), '{pattern}') AS p FROM documents) WHERE len(m) > 0)"""


SQL["op6_secret_scan"] = f"""
WITH {_found("fa", 0, _ASSIGN, 2)}, {_found("fk", 1, "AKIA[A-Z0-9]{16,}", 0)}, {_found("fh", 2, "[0-9a-f]{24,}", 0)},
base AS (
  SELECT doc_id, source, lang, text_key, kind, s.start::BIGINT AS start, (s.start + s.size)::BIGINT AS stop, s.value AS value
  FROM (FROM fa UNION ALL FROM fk UNION ALL FROM fh) WHERE kind <> 0 OR length(s.value) >= 6),
live AS (
  SELECT value FROM base GROUP BY value HAVING count(DISTINCT coalesce(source, '')) = 1
    AND count(DISTINCT concat_ws('/', source, lang)) = 1 AND count(DISTINCT text_key) <= 5 AND length(value) >= 12
    AND len(list_distinct(string_split(value, ''))) >= 8 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')),
every AS (
  SELECT doc_id, kind, start, stop FROM base
  UNION SELECT doc_id, 3, stop - length(value), stop FROM base WHERE value IN (FROM live)),
named AS (SELECT *, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || start || ':' || stop AS name FROM every),
each AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex, string_agg(name, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
    string_agg(name, ',' ORDER BY start, kind) AS spans FROM named GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN each USING (doc_id)"""

SQL["op8_line_dedup"] = f"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, {SPACES}), {UP}) AS key FROM l),
f AS (SELECT key AS often FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(often) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (often IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON key = often GROUP BY doc_id"""

SQL["op9_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {UP}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op10_decontaminate"] = f"""
WITH i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
wins AS (
  SELECT item_id, size, unnest(list_transform(generate_series(1, len(ws) - size + 1),
    lambda p: array_to_string(ws[p:p + size - 1], ' '))) AS win
  FROM (SELECT *, least(13, len(ws)) AS size FROM i WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS (
  SELECT doc_id, size, unnest(generate_series(1, len(ws) - size + 1)) AS pos,
    unnest(list_transform(generate_series(1, len(ws) - size + 1), lambda p: array_to_string(ws[p:p + size - 1], ' '))) AS win
  FROM d, (SELECT DISTINCT size FROM wins) WHERE len(ws) >= size),
hits AS (SELECT DISTINCT doc_id, pos, size, item_id FROM dw JOIN wins USING (size, win)),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(generate_series(pos, pos + size - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)"""

SQL["op11_collocations"] = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), {UP}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, p, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
x AS (
  SELECT lang, word AS a1, a1 || ' ' || lead(word, 1) OVER piece AS a2, a2 || ' ' || lead(word, 2) OVER piece AS a3,
    a3 || ' ' || lead(word, 3) OVER piece AS a4 FROM t WINDOW piece AS (PARTITION BY p ORDER BY pos)),
g AS MATERIALIZED (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, unnest([1, 2, 3, 4]) AS size, unnest([a1, a2, a3, a4]) AS phrase FROM x) WHERE phrase IS NOT NULL
  GROUP BY lang, size, phrase HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE size > 1),
parts AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(ws[:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest
  FROM c JOIN (VALUES (1), (2), (3)) v(k) ON k < size),
cuts AS (
  SELECT parts.lang, parts.phrase, a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM parts JOIN g x ON x.lang = parts.lang AND x.phrase = first JOIN g y ON y.lang = parts.lang AND y.phrase = rest),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM c JOIN (VALUES (2), (3)) t(m) ON m < size, (VALUES (1), (2), (3)) u(i) WHERE i + m - 1 <= size
  GROUP BY 1, 2),
kept AS (SELECT weakest.* FROM weakest LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""

SQL["op12_ranked_search"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS terms FROM d WHERE len(ws) > 0),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, docs),
r AS (
  SELECT item_id, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN t USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 20"""

# for the markup that the given pages have: one article of headings and paragraphs, and these references
_REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;?", '"'), ("&#39;", "''"), ("&copy;?", "\u00a9"), ("&middot;?", "\u00b7"), ("&amp;?", "&")]
_DECODED = "piece"
for _reference, _character in _REFERENCES:
    _DECODED = f"regexp_replace({_DECODED}, '{_reference}', '{_character}', 'g')"

SQL["op13_main_text"] = rf"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)(</article>|$)', 1) AS body FROM pages),
p AS (
  SELECT page_id, url, list_transform(
    string_split(regexp_replace(body, '</?(p|h[1-6])( [^>]*)?>', chr(1), 'g'), chr(1)),
    lambda x: regexp_replace(regexp_replace(x, '<br */?>', ' ', 'g'), '<[^>]*>', '', 'g')) AS pieces FROM a),
t AS (
  SELECT page_id, url, list_transform(pieces, lambda piece: trim(regexp_replace({_DECODED}, '\s+', ' ', 'g'))) AS pieces FROM p)
SELECT page_id, url, array_to_string(list_filter(pieces, lambda x: x <> ''), chr(10)) AS text,
  length(array_to_string(list_filter(pieces, lambda x: x <> ''), chr(10))) AS n_chars FROM t"""
