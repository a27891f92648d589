"""DuckDB SQL of the registered queries that SQL can express."""

from .licenses import RULES, SENTENCES, _sequence, expression

EXACT = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""

LINES = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), s AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < s.top, false) AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

WARC = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS resp FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN resp < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN resp < page_id THEN resp END AS refers_to
FROM r
"""

PHRASES = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
), g AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(size) WHERE len(w) >= size)
), f AS (
  SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL
), total AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), c AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE a >= 30 AND size > 1
), longer AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, a, w, size, k, unnest(generate_series(1, size - k + 1)) AS i FROM c, (VALUES (2), (3)) s(k) WHERE k < size)
  GROUP BY ALL
), kept AS (
  SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT
), cut AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
  FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM kept)
), scored AS (
  SELECT cut.lang, cut.phrase, cut.a, k, l.a AS l, r.a AS r, (2000000 * cut.a::HUGEINT // (l.a + r.a))::BIGINT AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def licences() -> str:
    known = ", ".join(f"('{s}', {i})" for s, i in SENTENCES.items())
    rules = ", ".join(f"({k}, '{n}', '{lic}', '{kind}', '{_sequence(seq)}', '{expression(lic, seq)}')" for k, (n, lic, kind, seq) in enumerate(RULES))
    return rf"""
WITH known(sentence, id) AS (VALUES {known}), rules(nr, rule, licence, kind, ids, expression) AS (VALUES {rules}),
cut AS (
  SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.!?]+(?:[\x20\x09-\x0D]+|\z)|\n') AS parts FROM documents)
), hit AS (
  SELECT doc_id, pos, id FROM cut
  JOIN known ON trim(regexp_replace(lower(part), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) = sentence
), chain AS (
  SELECT doc_id, ',' || string_agg(id::varchar, ',' ORDER BY pos) || ',' AS ids FROM hit GROUP BY doc_id
), fit AS (
  SELECT doc_id, r.* FROM chain c JOIN rules r ON contains(c.ids, r.ids)
), best AS (
  SELECT * FROM fit f WHERE NOT EXISTS (
    SELECT 1 FROM fit o WHERE o.doc_id = f.doc_id AND length(o.ids) > length(f.ids) AND contains(o.ids, f.ids))
), named AS (
  SELECT doc_id, string_agg(rule, '|' ORDER BY nr) AS rules FROM best GROUP BY doc_id
), licence AS (
  SELECT doc_id, string_agg(licence, '|' ORDER BY nr) AS licences
  FROM (SELECT doc_id, licence, min(nr) AS nr FROM best GROUP BY ALL) GROUP BY doc_id
), versioned AS (
  SELECT doc_id, string_agg(expression, '|' ORDER BY nr) AS expressions
  FROM (SELECT doc_id, expression, min(nr) AS nr FROM best GROUP BY ALL) GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.ids, ',') AS sentence_ids, coalesce(n.rules, '') AS rules, coalesce(l.licences, '') AS licences, coalesce(v.expressions, '') AS expressions
FROM documents d LEFT JOIN chain c USING (doc_id) LEFT JOIN named n USING (doc_id) LEFT JOIN licence l USING (doc_id) LEFT JOIN versioned v USING (doc_id)
"""


LICENCES = licences()
