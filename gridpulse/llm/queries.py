"""Queries of this package: name -> function of (spark, sf_dir); SQL where it can express them."""
from __future__ import annotations

from .bitplanes import op7_bitplanes
from .divergence import op12_divergence
from .fertility import op3_fertility
from .fillmiddle import op13_fillmiddle
from .linededup import op9_linededup
from .mixing import op2_mixing
from .packing import op4_packing
from .pseudonyms import op6_pseudonyms
from .sharding import op8_sharding
from .simhash import op1_simhash
from .tokencounts import op11_tokencounts
from .topk import op5_topk
from .warc import op10_warc

QUERIES = {f.__name__: f for f in (op1_simhash, op2_mixing, op3_fertility, op4_packing, op5_topk, op6_pseudonyms, op7_bitplanes, op8_sharding, op9_linededup, op10_warc,
                                    op11_tokencounts, op12_divergence, op13_fillmiddle)}

#: floor() of a double may be minus zero, which the cast drops; sums of products stay far below 2^63 for the given vectors.
_TOPK = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_WARC = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
    SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""

_DIVERGENCE = r"""
WITH d AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), t AS (
    SELECT doc, lang, source, unnest(terms) AS term FROM d
), kept AS (
    SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), g AS (
    SELECT DISTINCT lang, source FROM d
), own AS (
    SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY t.lang, t.source, t.term
), cells AS (
    SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n
    FROM g JOIN kept AS k ON k.lang = g.lang LEFT JOIN own AS o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
), p AS (
    SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w) AS p FROM cells WINDOW w AS (PARTITION BY lang, source)
), whole AS (
    SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term
), q AS (
    SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w) AS q FROM whole WINDOW w AS (PARTITION BY lang)
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums AS s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
    SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value
    FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

_FILL_MIDDLE = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), r AS (
    SELECT doc_id, text, lines, len(lines) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS h FROM d
), c AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
                WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM r
), s AS (
    SELECT doc_id, text, n, form, array_to_string(lines[1:a], '') AS p, array_to_string(lines[a + 1:b], '') AS m, array_to_string(lines[b + 1:n], '') AS s FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s
"""

ORACLES = {"op5_topk": _TOPK, "op10_warc": _WARC, "op12_divergence": _DIVERGENCE, "op13_fillmiddle": _FILL_MIDDLE}
