"""Comparison SQL of the queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
SPACED = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORD}) AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS k
  FROM (SELECT item_id, regexp_extract_all({LOWER}, {WORD}) AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM i)),
grams AS (SELECT doc_id, s, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM i))),
met AS (SELECT doc_id, s, k, item_id FROM grams JOIN windows USING (k, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, {SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score,
  CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) AS INTEGER) AS rank
FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
QUALIFY rank <= 20"""

# CRC-32 of the digits of an id, a bit at a time; 3988292384 is its polynomial.
PREFIX_TRIE = """WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({'r': r, 'x': x} ORDER BY i) AS w FROM t GROUP BY c),
bits AS (SELECT c, w, list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
  lambda d: list_transform(range(8), lambda b: (ascii(d)::BIGINT >> b) & 1)))) AS bits FROM own),
heads AS (SELECT c, w, xor(4294967295::BIGINT, list_reduce(bits,
  lambda z, b: CASE WHEN xor(z, b) & 1 = 1 THEN xor(z >> 1, 3988292384::BIGINT) ELSE z >> 1 END)) % 9 AS h FROM bits),
rebuilt AS (SELECT a.c, list_concat(coalesce(list_slice(b.w, 1, a.h), []), list_slice(a.w, a.h + 1, len(a.w))) AS w
  FROM heads a LEFT JOIN heads b ON b.c = a.c - a.c % 5),
cells AS (SELECT c, d, list_slice(w, 1, d) AS p, len(w) = d AS ends, coalesce(strlen(w[d].x), 0) AS size
  FROM (SELECT *, unnest(range(0, len(w) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM cells GROUP BY d, p),
tree AS (SELECT n.*, u.conv_id AS parent_conv_id,
  (SELECT count(*) FROM nodes k WHERE k.d = n.d + 1 AND list_slice(k.p, 1, n.d) = n.p) AS n_children
  FROM nodes n LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = list_slice(n.p, 1, n.d - 1))
SELECT n.conv_id, n.d AS depth, n.parent_conv_id, n.n_convs, n.n_children,
  CAST(sum(CASE WHEN s.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
  CAST(sum(s.saved) AS BIGINT) AS saved_tokens, n.ends_sha256
FROM tree n JOIN tree s ON s.d >= n.d AND list_slice(s.p, 1, n.d) = n.p
GROUP BY n.p, n.conv_id, n.d, n.parent_conv_id, n.n_convs, n.n_children, n.ends_sha256"""

REPEATS = """WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
w AS (SELECT doc_id, s, md5(substr(x, 2 * s + 1, 200)) AS g FROM (SELECT *, unnest(range(0, strlen(x) // 2 - 99)) AS s FROM d)),
gone AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS i FROM w) WHERE i > 1),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS r
  FROM (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM gone))
  GROUP BY doc_id, r),
kept AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS e FROM runs),
cut AS (SELECT doc_id, count(*) AS n, sum(b - a) AS gone, max(b) AS e,
  string_agg(substr(x, 2 * k.e + 1, 2 * (a - k.e)), '' ORDER BY a) AS x FROM kept k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(strlen(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(c.x, '') || substr(d.x, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut c USING (doc_id)"""

TERM = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"

DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all({LOWER}, {TERM}) AS w FROM documents),
t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(lang_total, 0) AS lang_total,
    coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN langs USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 2)::HUGEINT // (total + 2 * v) AS p,
    1 + 1000000000 * (lang_n + 2)::HUGEINT // (lang_total + 2 * v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gaps AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
listed AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN gaps x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM listed QUALIFY part = 'pair' OR rank <= 10"""

ORACLE: dict[str, str] = {
    "op1_decontamination": DECONTAMINATION,
    "op3_ngram_jaccard_join": JACCARD,
    "op6_exact_top_k": TOP_K,
    "op11_conversation_prefix_trie": PREFIX_TRIE,
    "op12_suffix_array_dedup": REPEATS,
    "op13_source_divergence_audit": DIVERGENCE,
}
