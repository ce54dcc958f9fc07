"""DuckDB SQL of the queries over vectors and token counts."""

V = """v AS (SELECT vec_id, label, label % 3 AS layer, vec_id // 30 AS block, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"""
LAYERED = V + """, lm AS (SELECT block, layer, i, avg(x) AS x FROM v GROUP BY ALL
), ll AS (SELECT block, layer, list(x ORDER BY i) AS v FROM lm GROUP BY ALL
), w AS (SELECT block, max(v) FILTER (layer = 0) AS s, max(v) FILTER (layer = 1) AS m, max(v) FILTER (layer = 2) AS r FROM ll GROUP BY block HAVING count(*) = 3
), d AS (SELECT block, 1 - list_cosine_similarity(s, m) AS sm, 1 - list_cosine_similarity(m, r) AS mr, 1 - list_cosine_similarity(s, r) AS sr FROM w)"""
TOKENS = """t AS (SELECT doc_id, lang, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS token FROM documents
), n AS (SELECT doc_id, lang, token, count(*) AS n FROM t GROUP BY ALL
), s AS (SELECT *, n / (sum(n) OVER (PARTITION BY doc_id))::DOUBLE AS p FROM n)"""
GROUPS = """SELECT lang, n_a, n_b, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(ma - mb, 6) AS diff, round(da, 6) AS median_a, round(db, 6) AS median_b,
  round((ma - mb) / nullif(sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 0), 6) AS d_pooled,
  round((ma - mb) / nullif(sqrt((pa + pb) / 2), 0), 6) AS d_average, round((ma - mb) / nullif(sd, 0), 6) AS d_joint FROM s"""

ORACLE_SQL = {
    "vector_means": f"WITH {V} SELECT label, i::INT AS dim, round(avg(x), 6) AS mean FROM v GROUP BY label, i",
    "residual_norms": f"""WITH {V}, m AS (SELECT i, avg(x) AS m FROM v GROUP BY i), r AS (SELECT vec_id, label, sqrt(sum((x - m) * (x - m))) AS n FROM v JOIN m USING (i) GROUP BY vec_id, label)
SELECT label, count(*) AS n, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std_pop, round(max(n), 6) AS top FROM r GROUP BY label""",
    "zero_mode": f"""WITH {V}, m AS (SELECT i, avg(x) AS m FROM v GROUP BY i), r AS (SELECT vec_id, sqrt(sum((x - m) * (x - m))) AS n FROM v JOIN m USING (i) GROUP BY vec_id
), s AS (SELECT count(*) AS n, avg(n) AS mean, stddev_pop(n) AS sd, min(n) AS low, max(n) AS high, regr_slope(n, vec_id * 3600.0) AS slope, corr(n, vec_id * 3600.0) AS r FROM r)
SELECT n, round(mean, 6) AS mean, round(sd, 6) AS std_pop, round(low, 6) AS low, round(high, 6) AS high, round(slope * 1e6, 6) AS slope_per_megasecond, round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 5) AS t FROM s""",
    "zero_mode_by_period": f"""WITH {V}, m AS (SELECT i, avg(x) AS m FROM v GROUP BY i), r AS (SELECT vec_id, sqrt(sum((x - m) * (x - m))) AS n FROM v JOIN m USING (i) GROUP BY vec_id)
SELECT vec_id // 720 AS period, count(*) AS n, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, round(median(n), 6) AS median FROM r GROUP BY ALL""",
    "vocabulary_sketches": """WITH t AS (SELECT lang, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS token FROM documents)
SELECT lang, count(DISTINCT token) AS n_exact, true AS within FROM t GROUP BY lang UNION ALL SELECT NULL, count(DISTINCT token), true FROM t""",
    "vector_steps": """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), s AS (SELECT label, vec_id AS "from", lead(vec_id) OVER w AS "to", v, lead(v) OVER w AS nv FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT label, "from", "to", round(1 - list_cosine_similarity(v, nv), 6) AS cosine_step, round(list_distance(v, nv), 6) AS length_step FROM s WHERE "to" IS NOT NULL""",
    "layer_distances": f"""WITH {LAYERED}, l AS (SELECT 'surface-mid' AS pair, sm AS x FROM d UNION ALL SELECT 'mid-residue', mr FROM d UNION ALL SELECT 'surface-residue', sr FROM d)
SELECT pair, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS low, round(max(x), 6) AS high, round(avg(acos(greatest(-1, least(1, 1 - x)))), 6) AS mean_angle FROM l GROUP BY pair""",
    "ordering_frequencies": f"""WITH {LAYERED}, c AS (SELECT unnest(['SM<MR<SR', 'SM<SR<MR', 'MR<SM<SR', 'MR<SR<SM', 'SR<SM<MR', 'SR<MR<SM']) AS ordering, unnest(range(0, 6))::INT AS pos
), o AS (SELECT CASE WHEN sm <= mr AND mr <= sr THEN 'SM<MR<SR' WHEN sm <= sr AND sr < mr THEN 'SM<SR<MR' WHEN mr < sm AND sm <= sr THEN 'MR<SM<SR' WHEN mr <= sr AND sr < sm THEN 'MR<SR<SM'
  WHEN sr < sm AND sm <= mr THEN 'SR<SM<MR' ELSE 'SR<MR<SM' END AS ordering FROM d), n AS (SELECT ordering, count(*) AS n FROM o GROUP BY ordering)
SELECT ordering, pos, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / nullif((sum(n) OVER ())::DOUBLE, 0), 6) AS share FROM c LEFT JOIN n USING (ordering)""",
    "ordering_tests": f"""WITH {LAYERED}, c AS (SELECT unnest(['SM<MR<SR', 'SM<SR<MR', 'MR<SM<SR', 'MR<SR<SM', 'SR<SM<MR', 'SR<MR<SM']) AS ordering, unnest(range(0, 6)) AS pos
), o AS (SELECT CASE WHEN sm <= mr AND mr <= sr THEN 'SM<MR<SR' WHEN sm <= sr AND sr < mr THEN 'SM<SR<MR' WHEN mr < sm AND sm <= sr THEN 'MR<SM<SR' WHEN mr <= sr AND sr < sm THEN 'MR<SR<SM'
  WHEN sr < sm AND sm <= mr THEN 'SR<SM<MR' ELSE 'SR<MR<SM' END AS ordering FROM d), n AS (SELECT ordering, count(*) AS n FROM o GROUP BY ordering
), f AS (SELECT ordering, pos, coalesce(n, 0) AS n FROM c LEFT JOIN n USING (ordering)
), s AS (SELECT sum(n)::DOUBLE AS total, max(n)::DOUBLE AS top, sum(n * n) * 6.0 / sum(n) - sum(n) AS x FROM f
), m AS (SELECT ordering AS mode, n FROM f ORDER BY n DESC, pos LIMIT 1)
SELECT mode, n, total, top, round(x, 6) AS chi2,
  round(1 - 2 * exp(-x / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 400), lambda k: CASE WHEN x > 0 THEN exp((k + 0.5) * ln(x) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2) ELSE 0 END))
    + sqrt(2 * x / pi()) * exp(-x / 2) * (1 + x / 3), 6) AS p_chi2,
  round((SELECT sum(exp(lgamma(total + 1) - lgamma(k + 1) - lgamma(total - k + 1) - k * ln(6) + (total - k) * ln(5e0 / 6))) FROM (SELECT unnest(range(0, total::BIGINT + 1)) AS k) WHERE k >= top), 6) AS p_top FROM s, m""",
    "relabeled_spread": f"""WITH {LAYERED}, p AS (SELECT 0 AS perm, sm AS a, mr AS b, sr AS c FROM d UNION ALL SELECT 1, sr, mr, sm FROM d UNION ALL SELECT 2, sm, sr, mr FROM d
  UNION ALL SELECT 3, mr, sr, sm FROM d UNION ALL SELECT 4, sr, sm, mr FROM d UNION ALL SELECT 5, mr, sm, sr FROM d)
SELECT perm, round(avg((a <= b AND a <= c)::INT), 6) AS share, round(avg(a), 6) AS mean_distance FROM p GROUP BY perm""",
    "relabeling_spread": f"""WITH {V}, lm AS (SELECT block, layer, i, avg(x) AS x FROM v GROUP BY ALL), ok AS (SELECT block FROM lm GROUP BY block HAVING count(DISTINCT layer) = 3
), k AS (SELECT unnest([[0, 1, 2], [0, 2, 1], [1, 0, 2], [1, 2, 0], [2, 0, 1], [2, 1, 0]]) AS o, unnest(range(0, 6))::INT AS perm
), r AS (SELECT perm, pos, block, i, x FROM (SELECT perm, unnest(o) AS layer, generate_subscripts(o, 1) AS pos FROM k) JOIN lm USING (layer) JOIN ok USING (block)
), c AS (SELECT perm, pos, i, avg(x) AS c FROM r GROUP BY ALL), d AS (SELECT perm, pos, block, sqrt(sum((x - c) * (x - c))) AS d FROM r JOIN c USING (perm, pos, i) GROUP BY ALL
), s AS (SELECT perm, round(avg(d), 8) AS spread FROM (SELECT perm, pos, avg(d) AS d FROM d GROUP BY ALL) GROUP BY perm)
SELECT perm, perm = 0 AS is_identity, spread, rank() OVER (ORDER BY spread) + (count(*) OVER (PARTITION BY spread) - 1) / 2.0 AS avg_rank FROM s""",
    "tokens_as_json": f"""WITH {TOKENS}, m AS (SELECT doc_id, map_from_entries(list({{'k': token, 'v': n}} ORDER BY token)) AS m FROM n GROUP BY doc_id)
SELECT doc_id, to_json(m)::VARCHAR AS json, true AS reads_back FROM m""",
    "centroid_drift": f"""WITH {V}, p AS (SELECT *, vec_id % 2 AS k FROM v), m AS (SELECT k, i, avg(x) AS m FROM p GROUP BY k, i
), r AS (SELECT k, vec_id, sqrt(sum((x - m) * (x - m))) AS n FROM p JOIN m USING (k, i) GROUP BY k, vec_id), w AS (SELECT avg(s) AS within FROM (SELECT avg(n) AS s FROM r GROUP BY k)
), c AS (SELECT sqrt(sum((a.m - b.m) * (a.m - b.m))) AS l2, 1 - sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))) AS cosine FROM m a JOIN m b ON a.i = b.i AND a.k = 0 AND b.k = 1)
SELECT round(l2, 6) AS l2, round(cosine, 6) AS cosine, round(within, 6) AS within, round(l2 / within, 6) AS ratio,
  CASE WHEN l2 / within < 0.5 THEN 'small' WHEN l2 / within < 1.2 THEN 'comparable' ELSE 'large' END AS reading FROM c, w""",
    "between_within": f"""WITH {V}, c AS (SELECT label, i, avg(x) AS c FROM v GROUP BY label, i), g AS (SELECT i, avg(c) AS g FROM c GROUP BY i
), b AS (SELECT avg(d) AS between_ FROM (SELECT label, sqrt(sum((c - g) * (c - g))) AS d FROM c JOIN g USING (i) GROUP BY label)
), w AS (SELECT avg(w) AS within FROM (SELECT label, avg(d) AS w FROM (SELECT label, vec_id, sqrt(sum((x - c) * (x - c))) AS d FROM v JOIN c USING (label, i) GROUP BY label, vec_id) GROUP BY label))
SELECT round(between_, 6) AS "between", round(within, 6) AS within, round(between_ / within, 6) AS ratio FROM b, w""",
    "token_entropy": f"""WITH {TOKENS} SELECT doc_id, count(*)::INT AS richness, sum(n)::DOUBLE AS total, round(0 - sum(p * log2(p)), 6) AS entropy, round(0 - sum(p * log2(p + 1e-12)), 6) AS smoothed FROM s GROUP BY doc_id""",
    "language_entropy": f"""WITH {TOKENS}, h AS (SELECT doc_id, lang, 0 - sum(p * log2(p)) AS h FROM s GROUP BY doc_id, lang)
SELECT lang, count(h) AS n, round(avg(h), 6) AS mean, round(stddev_samp(h), 6) AS std, round(median(h), 6) AS median FROM h GROUP BY lang""",
    "entropy_of_halves": f"""WITH {TOKENS}, h AS (SELECT doc_id, lang, count(*) AS richness, round(0 - sum(p * log2(p)), 6) AS h FROM s GROUP BY doc_id, lang),
ranked AS (SELECT *, doc_id < (SELECT (min(doc_id) + max(doc_id) + 1) / 2 FROM documents) AS early, rank() OVER (PARTITION BY lang ORDER BY h) + (count(*) OVER (PARTITION BY lang, h) - 1) / 2.0 AS r FROM h),
g AS (SELECT lang, round(avg(h) FILTER (early), 4) AS h_early, round(avg(h) FILTER (NOT early), 4) AS h_late, round(avg(richness) FILTER (early), 4) AS richness_early,
  round(avg(richness) FILTER (NOT early), 4) AS richness_late, count(*) FILTER (early) AS n_a, count(*) FILTER (NOT early) AS n_b, sum(r) FILTER (early) AS ranks FROM ranked GROUP BY lang)
SELECT * EXCLUDE (ranks), round(ranks - n_a * (n_a + 1) / 2, 4) AS u FROM g""",
    "top_tokens": f"WITH {TOKENS} SELECT token, sum(n)::BIGINT AS n FROM n GROUP BY token ORDER BY n DESC, token LIMIT 10",
    "vocabulary_size": f"WITH {TOKENS} SELECT count(DISTINCT token) AS n_tokens, sum(n)::BIGINT AS n_words FROM n",
    "lexical_drift": f"""WITH {TOKENS}, o AS (SELECT lang, doc_id, lead(doc_id) OVER (PARTITION BY lang ORDER BY doc_id) AS nxt FROM (SELECT DISTINCT lang, doc_id FROM s)
), st AS (SELECT lang, doc_id AS a, nxt AS b FROM o WHERE nxt IS NOT NULL
), u AS (SELECT st.lang, a, b, coalesce(x.token, y.token) AS token FROM st JOIN s x ON x.doc_id = a LEFT JOIN s y ON FALSE
  UNION SELECT st.lang, a, b, y.token FROM st JOIN s y ON y.doc_id = b
), j AS (SELECT u.lang, a, b, coalesce(x.p, 0) AS p, coalesce(y.p, 0) AS q, coalesce(x.n, 0) AS n, coalesce(y.n, 0) AS m FROM u LEFT JOIN s x ON x.doc_id = a AND x.token = u.token LEFT JOIN s y ON y.doc_id = b AND y.token = u.token)
SELECT lang, a AS "from", b AS "to", round(sqrt(greatest(0, sum(0.5 * CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + 0.5 * CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END))), 6) AS js,
  round(1 - sum(n * m) / (sqrt(sum(n * n)) * sqrt(sum(m * m))), 6) AS cosine FROM j GROUP BY lang, a, b""",
    "quality_groups": f"""WITH j AS (SELECT lang, quality, n_chars::DOUBLE AS x FROM labels JOIN documents USING (doc_id)), s AS (
  SELECT lang, count(x) FILTER (quality = 1) AS n_a, count(x) FILTER (quality <> 1) AS n_b, avg(x) FILTER (quality = 1) AS ma, avg(x) FILTER (quality <> 1) AS mb,
    var_samp(x) FILTER (quality = 1) AS va, var_samp(x) FILTER (quality <> 1) AS vb, var_pop(x) FILTER (quality = 1) AS pa, var_pop(x) FILTER (quality <> 1) AS pb,
    median(x) FILTER (quality = 1) AS da, median(x) FILTER (quality <> 1) AS db, stddev_samp(x) AS sd FROM j GROUP BY lang) {GROUPS}""",
    "viability": """SELECT 'vectors' AS "check", count(*)::DOUBLE AS value, count(*) >= 100 AS ok FROM embeddings
UNION ALL SELECT 'share_of_texts', round(avg((n_chars > 0)::INT), 6), avg((n_chars > 0)::INT) > 0.9 FROM documents
UNION ALL SELECT 'turns_a_conversation', round(avg(n), 6), avg(n) >= 2 FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)""",
    "role_counts": """WITH f AS (SELECT role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
SELECT role, CASE WHEN r = 1 THEN 'first' ELSE 'later' END AS position, count(*) AS n FROM f GROUP BY ALL""",
}
