"""DuckDB SQL that says what queries of this package have to return, from their contracts alone."""

from __future__ import annotations


def divergence(least: int = 3, top: int = 200) -> str:
    """Every term against every pair of sources, zeros included."""
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    words AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM docs),
    kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= {least}),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
    had AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
    totals AS (SELECT lang, source, sum(n) AS total FROM had GROUP BY ALL),
    every AS (
      SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(h.n, 0) + 1) // (coalesce(t.total, 0) + l.v) AS p,
        1 + 1000000000::HUGEINT * (k.n + 1) // (l.total + l.v) AS of_lang
      FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
      LEFT JOIN totals t ON g.lang = t.lang AND g.source = t.source LEFT JOIN had h ON g.lang = h.lang AND g.source = h.source AND k.term = h.term),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term WHERE a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN sums s ON a.lang = s.lang AND a.source = s.source AND b.source = s.item),
    both_parts AS (
      SELECT lang, source, 'pair' AS part, item, value FROM pairs
      UNION ALL SELECT lang, source, 'term', term, (p - of_lang) * (p - of_lang) // of_lang FROM every WHERE n > 0 AND p > of_lang)
    SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
    FROM both_parts QUALIFY part = 'pair' OR rank <= {top}"""


def centroids(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024) -> str:
    """Lloyd's rounds one after the other, each a full scan."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""assigned{r} AS MATERIALIZED (SELECT row, vec_id, x, first(c ORDER BY d, c) AS c, min(d) AS d FROM (
          SELECT v.row, v.vec_id, v.x, m.c, list_sum(list_transform(list_zip(v.x, m.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM vectors v, middle{r} m) GROUP BY ALL HAVING true)""".replace("GROUP BY ALL HAVING true", "GROUP BY row, vec_id, x"))
        if r < rounds:
            steps.append(f"""middle{r + 1} AS MATERIALIZED (SELECT m.c, coalesce(n.x, m.x) AS x FROM middle{r} m LEFT JOIN (
          SELECT c, list(x ORDER BY i) AS x FROM (SELECT c, i, floor_div(sum(x[i]), count(*)) AS x FROM assigned{r}, range(1, {dims + 1}) t(i) GROUP BY c, i) GROUP BY c) n ON m.c = n.c)""")
    text = ",\n".join(steps).replace("floor_div(sum(x[i]), count(*))", "((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT")
    return f"""
    WITH vectors AS MATERIALIZED (
      SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings
      WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    middle0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS c, x FROM vectors ORDER BY c LIMIT {k}),
    {text},
    of_cluster AS (SELECT c, sum(d) AS cluster_inertia FROM assigned{rounds} GROUP BY c)
    SELECT a.vec_id, a.c::INTEGER AS cluster, a.d AS distance, o.cluster_inertia::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
      sha256(array_to_string(m.x, ',')) AS centroid_sha256
    FROM assigned{rounds} a JOIN of_cluster o ON a.c = o.c JOIN middle{rounds} m ON a.c = m.c"""


SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED, ALNUM = r"[^ \t\n\x0B\f\r]+", r"[0-9a-z\x{80}-\x{10FFFF}]+"


def jaccard(n: int = 4, percent: int = 85) -> str:
    """Every pair of documents that share a shingle, and all documents that each can reach."""
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({SMALL}, '{SPACED}') AS w FROM documents),
    s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) END AS s FROM w),
    e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM s),
    l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
    r AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a),
    c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1), k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
    SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, coalesce(k.n, 0)::BIGINT AS n_links FROM s JOIN c ON s.doc_id = c.doc_id LEFT JOIN k ON s.doc_id = k.a"""


def substring(words: int = 13) -> str:
    """Every window of every document, and the first document that it starts in."""
    return f"""
    WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
    x AS (SELECT doc_id, unnest(range(1, len(w) - {words} + 2)) AS i, unnest(list_transform(range(1, len(w) - {words} + 2), lambda i: md5(array_to_string(w[i:i + {words} - 1], ' ')))) AS win FROM w),
    f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM x),
    g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {words})) AS i FROM f WHERE first < doc_id), y AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
    k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM y ANTI JOIN g USING (doc_id, i) GROUP BY 1)
    SELECT w.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""


def contamination(width: int = 13) -> str:
    """Every window of every item against every stretch of as many words."""
    return f"""
    WITH b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({SMALL}, '{ALNUM}') AS w FROM benchmark),
    i AS (SELECT item, least({width}, len(w)) AS k, unnest(range(1, len(w) - least({width}, len(w)) + 2)) AS s, w FROM b WHERE len(w) > 0),
    p AS MATERIALIZED (SELECT DISTINCT item, k, array_to_string(w[s:s + k - 1], ' ') AS win FROM i), sizes AS (SELECT DISTINCT k FROM p),
    d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({SMALL}, '{ALNUM}') AS w FROM documents),
    x AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS s, w FROM d, sizes WHERE len(w) >= k),
    m AS MATERIALIZED (SELECT x.doc_id, x.s, x.k, p.item FROM (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win FROM x) x JOIN p ON x.k = p.k AND x.win = p.win),
    h AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS at FROM m) GROUP BY 1),
    n AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(n.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
      coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN n ON d.doc_id = n.doc_id"""
