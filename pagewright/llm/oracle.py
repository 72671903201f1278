"""DuckDB SQL for the queries that SQL can express on whole tables.

op1, op6, op7, op8 and op11 need models or tokenizers, op3 and op9 hashes that SQL lacks, op4 a tree: these are tested against
brute force in ``tests/llm``.
"""

from .licenses import COVER, DRIFT, REACH, templates

#: The base phrases as the contract has them: words, label.
PHRASES = """(VALUES (1, ['under', 'the', 'mit', 'license'], 'mit'), (2, ['apache', 'license', 'version', '2'], 'apache-2'), (3, ['cc', 'by', 'nc'], 'cc-by-nc'))"""

#: Brute force: all queries against all rows.
TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.x, d.x)::BIGINT AS score FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id)
SELECT * FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s) WHERE rank <= 20"""

#: Every window of 35 words as one text, counted.
SUBSTRINGS = """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d)),
hit AS (SELECT doc_id, p FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM hit),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS k FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)"""


#: Cuts by numbers of code points.
INFILL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT doc_id, t, n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


#: Every two sources of a language, term by term.
DIVERGENCE = """WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, row, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT d.lang, d.source, coalesce(any_value(total), 0) AS total FROM d LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source) GROUP BY d.lang, d.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.total + v.v))::BIGINT AS p,
 (1 + 1000000000 * (k.n + 1) // (v.total + v.v))::BIGINT AS q FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r) WHERE part = 'pair' OR rank <= 200"""


def _licenses() -> str:
    """Base phrases by looking at every place; the method's rules as in the scan: votes by diagonal, neighbouring
    diagonals as spans, and of each diagonal what lies past those before it."""
    grams = ", ".join(f"({i}, {k}, '{a} {b}', {len(w) - 1})" for i, text, _, _ in templates() for w in [text.split(" ")] for k, (a, b) in enumerate(zip(w, w[1:], strict=False)))
    labels = ", ".join(f"({i}, '{label}', {str(base).lower()})" for i, _, label, base in templates())
    return f"""WITH t(template, pos, gram, size) AS (VALUES {grams}), l(template, label, base) AS (VALUES {labels}), f(phrase, words, label) AS {PHRASES},
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM d),
b AS (SELECT doc_id, count(*)::BIGINT AS n_base, min(p)::BIGINT AS first_word, max(p)::BIGINT AS last_word, list(DISTINCT label) AS names FROM places JOIN f ON w[p + 1] = words[1] AND w[p + 1:p + len(words)] = words GROUP BY doc_id),
g AS (SELECT doc_id, p, w[p + 1] || ' ' || w[p + 2] AS gram FROM places WHERE p < len(w) - 1),
v AS (SELECT doc_id, template, p - pos AS diagonal, any_value(size) AS size, min(p) AS low, max(p) AS high, max(pos) AS top, bit_or(1::BIGINT << pos) AS covered FROM g JOIN t USING (gram) GROUP BY 1, 2, 3),
c AS (SELECT *, (coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {DRIFT}, false))::INTEGER AS far FROM v),
e AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS band FROM c),
n AS (SELECT *, (coalesce(low - max(high) OVER (PARTITION BY doc_id, template, band ORDER BY low, diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {REACH}, false))::INTEGER AS new FROM e),
m AS (SELECT *, (band, sum(new) OVER (PARTITION BY doc_id, template, band ORDER BY low, diagonal ROWS UNBOUNDED PRECEDING)) AS span FROM n),
o AS (SELECT *, greatest(max(top) OVER w, max(high) OVER w - diagonal) AS past FROM m WINDOW w AS (PARTITION BY doc_id, template, span ORDER BY low, diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT doc_id, template, max(size) AS size, bit_count(bit_or(CASE WHEN past IS NULL OR past < 0 THEN covered WHEN past > 60 THEN 0 ELSE covered - (covered & ((1::BIGINT << (past + 1)::BIGINT) - 1)) END)) AS hits FROM o GROUP BY 1, 2, span),
a AS (SELECT doc_id, list(DISTINCT label) FILTER (NOT base AND hits / size >= {COVER}) AS names, max(hits / size) AS score FROM s JOIN l USING (template) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(b.names), ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(b.names, a.names))), ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""


ORACLES: dict[str, str] = {"op2_license_scan": _licenses(), "op5_exact_top_k": TOP_K, "op10_substring_dedup": SUBSTRINGS, "op12_infill": INFILL, "op13_source_divergence": DIVERGENCE}
