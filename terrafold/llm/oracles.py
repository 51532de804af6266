"""SQL of the operators' queries that SQL can express."""

from __future__ import annotations

from terrafold.llm.licenses import LEAST, SHINGLE, TEMPLATES

LM = r"""WITH t AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\S+') AS w FROM documents),
p AS MATERIALIZED (SELECT doc_id, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS z FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM t)),
u AS (SELECT a, count(*) AS c FROM p GROUP BY 1),
bi AS MATERIALIZED (SELECT b, a, count(*) AS c FROM p WHERE b IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2),
tri AS (SELECT z, b, a, count(*) AS c FROM p WHERE z IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2),
s AS (SELECT doc_id, sum(CASE WHEN tri.c IS NOT NULL THEN ln(tri.c / bp.c::DOUBLE) WHEN bi.c IS NOT NULL THEN ln(bi.c / ub.c::DOUBLE) + CASE WHEN p.z IS NOT NULL THEN ln(0.4::DOUBLE) ELSE 0 END
        ELSE ln(u.c / (SELECT count(*) FROM p)::DOUBLE) + ((p.b IS NOT NULL)::INT + (p.z IS NOT NULL)::INT) * ln(0.4::DOUBLE) END) AS score
    FROM p JOIN u ON u.a = p.a LEFT JOIN u ub ON ub.a = p.b LEFT JOIN bi ON bi.a = p.a AND bi.b = p.b LEFT JOIN tri ON tri.a = p.a AND tri.b = p.b AND tri.z = p.z LEFT JOIN bi bp ON bp.a = p.b AND bp.b = p.z GROUP BY 1)
SELECT t.doc_id, len(w) AS n_words, round(coalesce(score, 0), 4) AS score, round(coalesce(score / len(w), 0), 6) AS mean_score FROM t LEFT JOIN s ON s.doc_id = t.doc_id"""

JACCARD = r"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN len(w) || ':' || array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS v, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v WHERE r.root < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.root, d.doc_id)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT v, min(root) AS root FROM r GROUP BY 1) m ON m.v = d.doc_id"""

_QUOTED = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in TEMPLATES.items())
_GRAMS = f"array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS g FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - {SHINGLE - 1}))) AS i FROM"
LICENSES = f"""WITH tp(license, t) AS (VALUES {_QUOTED}),
tg AS MATERIALIZED (SELECT DISTINCT license, {_GRAMS} (SELECT license, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM tp))),
k AS (SELECT license, count(*) AS k FROM tg GROUP BY 1),
dg AS (SELECT DISTINCT doc_id, {_GRAMS} (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents))),
m AS (SELECT doc_id, license, count(*)::DOUBLE / any_value(k.k) AS containment FROM dg JOIN tg ON tg.g = dg.g JOIN k USING (license) GROUP BY 1, 2 HAVING count(*)::DOUBLE / any_value(k.k) >= {LEAST})
SELECT d.doc_id, count(m.license) AS n_licenses, coalesce(string_agg(m.license, ',' ORDER BY m.license), '') AS licenses, coalesce(max(m.containment), 0)::DOUBLE AS containment FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id"""

DIVERGENCE = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT k, lang, source, unnest(w) AS term FROM d),
v AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= 3),
c AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN (SELECT lang, term FROM v) USING (lang, term) GROUP BY 1, 2, 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM v GROUP BY 1),
g AS MATERIALIZED (SELECT d.lang, d.source, coalesce(any_value(c.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2) c ON c.lang = d.lang AND c.source = d.source GROUP BY 1, 2),
p AS MATERIALIZED (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + l.v) AS p, 1 + 1000000000::HUGEINT * (v.n + 1) // (l.n + l.v) AS q
    FROM g JOIN v ON v.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM f) WHERE part = 'pair' OR rank <= 200"""

WARC = r"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS m, sha1(h) AS x FROM p GROUP BY 1)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes,
    array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, (i // 4) * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)), 1)), '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM p JOIN f ON f.h = p.h"""

# The CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(str_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT),
    lambda a, x: list_reduce([xor(a, x)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda y, z: xor(y >> 1, CASE WHEN y % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""
TRIE = f"""WITH o AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT c, w, ({_CRC} % 9)::INT AS h FROM o),
b AS MATERIALIZED (SELECT h.c, coalesce(list_slice(o.w, 1, h.h), []) || list_slice(h.w, h.h + 1, len(h.w)) AS w FROM h LEFT JOIN o ON o.c = h.c - h.c % 5),
n AS (SELECT c, d, list_slice(w, 1, d) AS p, len(w) AS k FROM (SELECT *, unnest(generate_series(0, len(w))) AS d FROM b)),
g AS MATERIALIZED (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (k = d), '')) AS ends FROM n GROUP BY 1, 2),
k AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n FROM g WHERE d > 0 GROUP BY 1),
f AS MATERIALIZED (SELECT g.*, coalesce(k.n, 0) AS n_children FROM g LEFT JOIN k ON k.p = g.p),
s AS (SELECT list_slice(p, 1, a) AS p, sum((n_children = 0)::INT) AS n_leaves, sum(CASE WHEN d > 0 THEN (n_convs - 1) * strlen(p[d].t) ELSE 0 END) AS saved FROM (SELECT *, unnest(generate_series(0, d)) AS a FROM f) GROUP BY 1)
SELECT f.conv_id, f.d::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN s ON s.p = f.p LEFT JOIN f q ON f.d > 0 AND q.p = list_slice(f.p, 1, f.d - 1)"""

ORACLE_SQL = {"op3_lm_scoring": LM, "op4_ngram_jaccard_join": JACCARD, "op5_license_scan": LICENSES, "op11_source_divergence_audit": DIVERGENCE, "op12_conversation_prefix_trie": TRIE, "op13_warc": WARC}
