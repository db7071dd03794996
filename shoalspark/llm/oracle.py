"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from shoalspark.llm import licences

WS = r"\x20\x09-\x0D"

ORACLE = {
    "op2_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
keyed AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
rep AS (
  SELECT k, min(doc_id) AS f FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
judged AS (
  SELECT keyed.*, rep.k IS NOT NULL AND doc_id <> f AS gone FROM keyed LEFT JOIN rep ON keyed.k = rep.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op3_url_filters": r"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                          ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM parts JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id)
SELECT parts.page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id""",
    "op7_repeated_phrases": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (
  SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM words WHERE len(w) >= 50)),
firsts AS (SELECT win, min(doc_id) AS f FROM wins GROUP BY win HAVING min(doc_id) <> max(doc_id)),
bad AS (
  SELECT doc_id, list(s) AS starts FROM wins JOIN firsts USING (win) WHERE doc_id > f GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, s + k AS i FROM (SELECT doc_id, unnest(starts) AS s FROM bad), range(50) AS r(k)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) FILTER (g.i IS NULL) AS t, count(g.i) AS n_removed
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT words.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)""",
    "op6_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
classes AS (SELECT array_to_string(w, ' ') AS t, any_value(w) AS w, min(doc_id) AS c, count(*) AS n FROM words WHERE len(w) > 0 GROUP BY 1),
grams AS (
  SELECT DISTINCT c, array_to_string(w[s:s + 4], ' ') AS g
  FROM (SELECT c, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM classes)),
sizes AS (SELECT c, count(*) AS k FROM grams GROUP BY c),
links AS (
  SELECT x.c AS a, y.c AS b FROM grams x JOIN grams y ON x.g = y.g AND x.c <> y.c
  JOIN sizes sx ON sx.c = x.c JOIN sizes sy ON sy.c = y.c
  GROUP BY x.c, y.c HAVING count(*) * 1000 >= 800 * (any_value(sx.k) + any_value(sy.k) - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
grp AS (SELECT a AS c, min(b) AS g FROM reach GROUP BY a),
deg AS (SELECT a AS c, sum(n) AS links FROM links JOIN classes ON classes.c = links.b GROUP BY a)
SELECT words.doc_id, coalesce(k.c, words.doc_id) AS class_id,
       CAST(coalesce(k.n - 1, 0) + coalesce(deg.links, 0) AS BIGINT) AS n_links,
       coalesce(least(grp.g, k.c), k.c, words.doc_id) AS group_id,
       words.doc_id = coalesce(least(grp.g, k.c), k.c, words.doc_id) AS kept
FROM words LEFT JOIN classes k ON len(words.w) > 0 AND k.t = array_to_string(words.w, ' ')
LEFT JOIN grp ON grp.c = k.c LEFT JOIN deg ON deg.c = k.c""",
    "op4_near_vectors": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
grp AS (SELECT a, min(b) AS g FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(g, vec_id), vec_id) AS component_id,
       vec_id = coalesce(least(g, vec_id), vec_id) AS kept
FROM embeddings LEFT JOIN grp ON grp.a = vec_id LEFT JOIN deg ON deg.a = vec_id""",
}


def template_rows() -> str:
    """(t, label, base, q, word, must, m, n_must) of every template word."""
    return ", ".join(
        f"({i}, '{t.label}', {t.base}, {q}, '{w.decode()}', {q in t.must}, {len(t.words)}, {len(t.must)})"
        for i, t in enumerate(licences.templates()) for q, w in enumerate(t.words))


ORACLE["op11_licence_scan"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
each AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS p FROM docs),
template(t, label, base, q, word, must, m, n_must) AS (VALUES """ + template_rows() + r"""),
hits AS (
  SELECT r, t, any_value(label) AS label, any_value(base) AS base, p - q AS s, count(*) AS k, any_value(m) AS m
  FROM each JOIN template USING (word) GROUP BY r, t, p - q
  HAVING count(*) FILTER (must) = any_value(n_must) AND 5 * count(*) >= 4 * any_value(m)),
found AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(k / m) AS score FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN found USING (r)"""

ORACLE["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, array_to_string(w[s:s + k - 1], ' ') AS phrase, k
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM words, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY lang, phrase, k),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
parts AS MATERIALIZED (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:size], ' ') AS rp
  FROM (SELECT lang, phrase, a, w, k AS size, unnest(range(1, k)) AS cut FROM cand)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM parts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[s:s + 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest([1, 2]) AS s FROM cand WHERE k = 3) GROUP BY 1, 2),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
       score::BIGINT AS score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000"""

ORACLE["op13_conversation_repair"] = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY b) AS tab FROM (
    SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v
    FROM range(256) AS t(b))),
keyed AS (
  SELECT c.*, tab, [4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
         lambda x: ord(x)::BIGINT) AS bytes FROM conversations c, tab),
kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(bytes, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind FROM keyed),
bad AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copies(k)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM bad),
seen AS (
  SELECT *, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
         trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM placed),
f AS (
  SELECT *, CASE WHEN core = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS then_ini FROM seen),
r AS (
  SELECT *, fault NOT IN ('blank', 'duplicate') AS free, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS x FROM f),
sums AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (ini || then_ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id),
g(conv_id, i, v) AS (
  SELECT conv_id, n + 1, [0, 6, 3, 0]::BIGINT[] FROM sums
  UNION ALL
  SELECT conv_id, i, [least(h[1], 3 + h[3], 6 + h[4]), least(h[2], 3 + h[3], 6 + h[4]), least(h[3], 3 + h[4]), least(h[4], 3 + h[3])]
  FROM (
    SELECT r.conv_id, r.i, [
      least(4 + v[1], CASE WHEN free AND ini = 's' THEN x + v[2] ELSE 999999 END, CASE WHEN free THEN x + v[3] + CASE ini WHEN 'u' THEN 0 ELSE 3 END ELSE 999999 END),
      least(4 + v[2], CASE WHEN free THEN x + v[3] + CASE ini WHEN 'u' THEN 0 ELSE 3 END ELSE 999999 END),
      least(4 + v[3], CASE WHEN free THEN x + v[4] + CASE ini WHEN 'a' THEN 0 ELSE 3 END ELSE 999999 END),
      least(4 + v[4], CASE WHEN free THEN x + v[3] + CASE ini WHEN 'u' THEN 0 ELSE 3 END ELSE 999999 END)] AS h
    FROM g JOIN r ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.i = g.i - 1)),
walk(conv_id, i, state, audit, lines) AS (
  SELECT conv_id, 1::BIGINT, 1, '', []::VARCHAR[] FROM sums
  UNION ALL
  SELECT conv_id, CASE op WHEN 'I' THEN i ELSE i + 1 END, CASE op WHEN 'D' THEN state WHEN 'K' THEN kto ELSE uto END, audit || op,
         CASE op WHEN 'D' THEN lines WHEN 'K' THEN lines || [role || ':' || text]
           ELSE lines || [CASE state WHEN 3 THEN 'assistant' ELSE 'user' END || ':' || CASE op WHEN 'I' THEN '' ELSE text END] END
  FROM (
    SELECT w.*, role, text, uto, kto, CASE
        WHEN r.i IS NOT NULL AND 4 + b.v[state] = a.v[state] THEN 'D'
        WHEN 3 + a.v[uto] = a.v[state] THEN 'I'
        WHEN free AND kto IS NOT NULL AND x + b.v[kto] = a.v[state] THEN 'K'
        WHEN free AND 3 + x + b.v[uto] = a.v[state] THEN 'R' END AS op
    FROM (SELECT walk.*, CASE state WHEN 3 THEN 4 ELSE 3 END AS uto FROM walk) w
    JOIN g a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.i = w.i
    LEFT JOIN (SELECT *, CASE ini WHEN 's' THEN 2 WHEN 'u' THEN 3 WHEN 'a' THEN 4 END AS kto_any FROM r) r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i
    LEFT JOIN g b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.i + 1,
    LATERAL (SELECT CASE WHEN ini = 's' AND state = 1 OR ini = 'u' AND state <> 3 OR ini = 'a' AND state = 3 THEN kto_any END AS kto))
  WHERE op IS NOT NULL),
told AS (SELECT conv_id, max_by(audit, length(audit)) AS audit, max_by(lines, length(audit)) AS lines FROM walk GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(g.v[1], 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id AND g.i = 1 LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id"""
