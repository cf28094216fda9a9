"""Queries and oracle SQL of the training-data problems."""

from __future__ import annotations

from siltmark.llm import p1_neighbours, p2_overlap, p3_history, p4_clusters, p5_quota, p6_splits, p7_leaks, p8_mix, p9_spans

QUERIES = {
    "p1_found": p1_neighbours.p1_found,
    "p1_neighbours": p1_neighbours.p1_neighbours,
    "p1_agreement": p1_neighbours.p1_agreement,
    "p2_found": p2_overlap.p2_found,
    "p2_report": p2_overlap.p2_report,
    "p3_found": p3_history.p3_found,
    "p3_batches": p3_history.p3_batches,
    "p3_index": p3_history.p3_index,
    "p4_found": p4_clusters.p4_found,
    "p4_clusters": p4_clusters.p4_clusters,
    "p5_found": p5_quota.p5_found,
    "p5_report": p5_quota.p5_report,
    "p5_sample": p5_quota.p5_sample,
    "p6_found": p6_splits.divided_sets,
    "p6_splits": p6_splits.p6_splits,
    "p6_shares": p6_splits.p6_shares,
    "p7_found": p7_leaks.p7_found,
    "p7_leaks": p7_leaks.p7_leaks,
    "p7_report": p7_leaks.p7_report,
    "p8_found": p8_mix.p8_found,
    "p8_report": p8_mix.p8_report,
    "p8_mix": p8_mix.p8_mix,
    "p9_found": p9_spans.p9_found,
    "p9_shared": p9_spans.p9_shared,
}

_UNIT = """f AS (SELECT vec_id, CAST(emb AS DOUBLE[]) AS x FROM emb_cache WHERE len(emb) = 384 AND len(list_filter(emb, lambda q: q IS NULL OR isnan(q) OR isinf(q))) = 0 AND len(list_filter(emb, lambda q: q <> 0)) > 0),
z AS (SELECT vec_id, list_transform(x, lambda q: q / sqrt(list_dot_product(x, x))) AS v FROM f)"""

_CATEGORY = "CASE WHEN trim(coalesce(category, '')) = '' THEN 'clean' ELSE regexp_replace(lower(trim(category)), '[\\s_-]+', '_', 'g') END"
_FORM = "CASE WHEN trim(coalesce(form_factor, '')) = '' THEN 'unknown' WHEN lower(trim(form_factor)) LIKE 'unidentif%' THEN 'unidentified' ELSE lower(trim(form_factor)) END"

_AVAILABLE = f"""t AS (SELECT sample_id, path, coalesce(nullif(lower(trim(split)), ''), lower(split_part(path, '/', 1))) AS split, {_CATEGORY} AS category, {_FORM} AS form_factor FROM labels),
a AS (SELECT path, arg_min(category, sample_id) AS category, arg_min(form_factor, sample_id) AS form_factor FROM t WHERE split = 'train' AND category IN ('clean', 'black_bars', 'disordered_layout', 'empty_space', 'overlay') GROUP BY 1)"""

_WORDS = "regexp_extract_all(strip_accents(lower(regexp_replace(regexp_replace(text, '</?[A-Za-z!][^<>]*>', ' ', 'g'), '[\\x{200b}-\\x{200f}\\x{2060}\\x{feff}\\x{00ad}\\x{0300}-\\x{036f}]', '', 'g'))), '[\\pL\\pN]+')"
_RUNS = "SELECT {id}, array_to_string(w[i:i + 12], ' ') AS run FROM (SELECT {id}, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT {id}, {words} AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 13)"

ORACLE_SQL: dict[str, str] = {
    "p1_found": f"""WITH {_UNIT}, c AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS c FROM z a, z b WHERE a.vec_id < b.vec_id), s AS (SELECT a, b, c FROM c UNION ALL SELECT b, a, c FROM c),
t AS (SELECT a, unnest(arg_min(b, (-c, b), 5)) AS b FROM s GROUP BY 1) SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM t""",
    "p4_found": f"""WITH RECURSIVE {_UNIT}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM z a, z b WHERE a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) >= 0.8),
r(vec_id, near) AS (SELECT a, b FROM e UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.near) SELECT vec_id, least(vec_id, min(near)) AS first_id FROM r GROUP BY 1""",
    "p5_found": f"""WITH {_AVAILABLE}
SELECT category, form_factor FROM quota_targets q WHERE (SELECT count(*) FROM a WHERE a.category = q.category AND a.form_factor = q.form_factor) < greatest(target_share * 0.2 * (SELECT count(*) FROM a), min_rows)""",
    "p5_report": f"""WITH {_AVAILABLE}, c AS (SELECT *, (SELECT count(*) FROM a WHERE a.category = q.category AND a.form_factor = q.form_factor) AS n, (SELECT count(*) FROM a) AS total FROM quota_targets q),
k AS (SELECT category, form_factor, row_number() OVER (ORDER BY r > min_rows, (r - 0.5) / target_share, category, form_factor) AS i, total FROM (SELECT *, unnest(range(1, n + 1)) AS r FROM c)),
s AS (SELECT category, form_factor, count(*) AS seats FROM k WHERE i <= round(0.2 * total) GROUP BY 1, 2)
SELECT category, form_factor, CAST(n AS BIGINT) AS available, round(greatest(target_share * 0.2 * total, min_rows), 6) AS need, CAST(coalesce(seats, 0) AS BIGINT) AS seats, round(coalesce(seats, 0) / (SELECT sum(seats) FROM s)::DOUBLE, 6) AS share, target_share, n < greatest(target_share * 0.2 * total, min_rows) AS short FROM c LEFT JOIN s USING (category, form_factor)""",
    "p7_found": f"""WITH i AS ({_RUNS.format(id='item_id', words=_WORDS, table='eval_passages')}), d AS ({_RUNS.format(id='doc_id', words=_WORDS, table='documents')}) SELECT DISTINCT item_id, doc_id FROM i JOIN d USING (run)""",
    # words and marks stand for tokens: any usual tokenizer names the same sources
    "p8_found": r"""WITH d AS (SELECT regexp_replace(lower(coalesce(source, '')), '[\s_-]+', '', 'g') AS k, sum(len(regexp_extract_all(text, '[\pL\pN]+|[^\pL\pN\s]'))) AS n FROM documents GROUP BY 1)
SELECT source FROM mix_targets m WHERE max_repeat * coalesce((SELECT n FROM d WHERE k = regexp_replace(lower(m.source), '[\s_-]+', '', 'g')), 0) < weight * (SELECT sum(n) FROM d)""",
    "p9_found": """WITH d AS (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300), g AS (SELECT DISTINCT doc_id, substring(text, i, 300) AS s FROM d)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id""",
    "p9_shared": """WITH RECURSIVE g AS (SELECT doc_id, i, substring(text, i, 300) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)),
st AS (SELECT doc_id, i, s FROM g JOIN (SELECT s FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) > 1) USING (s)), c AS (SELECT doc_id, sum(least(300, coalesce(nx - i, 300))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM st) GROUP BY 1),
p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM st x JOIN st y ON x.s = y.s AND x.doc_id <> y.doc_id), r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
f AS (SELECT a AS doc_id, least(a, min(b)) AS first_id FROM r GROUP BY 1), o AS (SELECT a AS doc_id, count(*) AS others FROM p GROUP BY 1)
SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, CAST(coalesce(c.n, 0) AS BIGINT) AS shared_chars, round(coalesce(c.n / nullif(length(text), 0)::DOUBLE, 0), 6) AS shared_part, CAST(coalesce(others, 0) AS BIGINT) AS partners, coalesce(first_id, doc_id) AS first_id
FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN f USING (doc_id)""",
}
