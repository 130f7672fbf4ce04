"""SQL for a second engine, for the queries that SQL can express."""

from __future__ import annotations

from gridlake.llm import licenses

SUBSTRING = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
hit AS (SELECT r, i FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + j AS pos FROM hit, range(35) t(j)),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY pos) AS t FROM words ANTI JOIN gone ON gone.r = words.r AND gone.pos = words.pos GROUP BY words.r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + 14 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


def license_scan() -> str:
    idf, other, vectors = licenses.weights()
    rows = ", ".join(f"('{t}', {w!r}::DOUBLE)" for t, w in idf.items())
    templates = ", ".join(f"('{name}', '{name.removesuffix(' notice')}', '{t}', {w!r}::DOUBLE)" for name, v in vectors.items() for t, w in v.items())
    cue = licenses.CUE
    return f"""
WITH idf(term, w) AS (VALUES {rows}), tpl(tid, name, term, w) AS (VALUES {templates}),
f AS (SELECT row_number() OVER () AS r, doc_id, text, CASE WHEN NOT regexp_matches(string_split(text, chr(10))[1], '{cue}') THEN source || '/' || (doc_id // 100) || '/' || doc_id || '.txt'
  WHEN doc_id % 10 = 0 THEN source || '/LICENSE.' || doc_id ELSE source || '/' || (doc_id // 100) || '/LICENSE.' || doc_id END AS path FROM documents),
l AS (SELECT r, line FROM (SELECT DISTINCT r, unnest(string_split(text, chr(10))) AS line FROM f) WHERE regexp_matches(line, '{cue}')),
t AS (SELECT r, line, term, count(*) AS n FROM (SELECT r, line, unnest(regexp_extract_all(lower(line), '[a-z]+|[0-9]+')) AS term FROM l) GROUP BY ALL),
v AS (SELECT r, line, t.term, n * coalesce(idf.w, {other!r}::DOUBLE) AS w FROM t LEFT JOIN idf ON idf.term = t.term),
norm AS (SELECT r, line, sqrt(sum(w * w)) AS norm FROM v GROUP BY r, line),
scored AS (SELECT v.r, v.line, tpl.tid, any_value(tpl.name) AS name, sum(v.w * tpl.w) AS dot FROM v JOIN tpl ON tpl.term = v.term GROUP BY v.r, v.line, tpl.tid),
best AS (SELECT r, max({{'score': round(dot / norm, 6), 'name': name}}) AS b FROM scored JOIN norm USING (r, line) GROUP BY r),
own AS (SELECT f.r, doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, CASE WHEN b.score >= {licenses.LEAST} THEN b.name END AS own_license, coalesce(b.score, 0.0::DOUBLE) AS own_score FROM f LEFT JOIN best USING (r)),
declared AS (SELECT dir, arg_min(own_license, {{'s': -own_score, 'l': own_license}}) AS found FROM own WHERE regexp_matches(path, '{licenses.LICENCE_FILE}') AND own_license IS NOT NULL GROUP BY dir),
near AS (SELECT o.r, arg_max(found, length(d.dir)) AS found, arg_max(d.dir, length(d.dir)) AS above FROM own o JOIN declared d ON d.dir = o.dir OR d.dir = '' OR starts_with(o.dir, d.dir || '/') GROUP BY o.r)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, found) AS license, CASE WHEN own_license IS NULL THEN above END AS inherited_from FROM own LEFT JOIN near USING (r)
"""
