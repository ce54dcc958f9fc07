"""DuckDB SQL of the queries over states, log texts, result tables and period comparisons."""

from tidewell.plans.geometry_sql import LAYERED, ORACLE_SQL as GEOMETRY, V
from tidewell.plans.series_sql import GRID, PAIRS, O

STATES = f"""{V}, lm AS (SELECT block, layer, i, avg(x) AS x FROM v GROUP BY ALL
), bm AS (SELECT block, i, avg(x) AS m FROM v GROUP BY ALL
), ok AS (SELECT block FROM lm GROUP BY block HAVING count(DISTINCT layer) = 3
), st AS (SELECT block, CASE WHEN block < (SELECT (min(vec_id) // 30 + max(vec_id) // 30 + 1) / 2 FROM embeddings) THEN 'p1' ELSE 'p2' END AS period, layer, ['surface', 'mid', 'residue'][layer + 1] AS name, i, x, m, x - m AS r FROM lm JOIN bm USING (block, i) JOIN ok USING (block))"""
STEPS = f"""{STATES}, nx AS (SELECT block, lead(block) OVER (ORDER BY block) AS nb FROM ok
), s AS (SELECT a.block AS "from", b.block AS "to", a.period, a.period <> b.period AS is_boundary, a.name AS layer, sqrt(sum((b.r - a.r) ** 2)) AS residual_drift,
  sqrt(sum((b.x - a.x) ** 2)) AS raw_drift, sqrt(sum((b.m - a.m) ** 2)) AS global_drift FROM nx JOIN st a USING (block) JOIN st b ON b.block = nb AND b.layer = a.layer AND b.i = a.i GROUP BY ALL)"""


def scoped(values: list[str]) -> str:
    return ", ".join(f"count({v}) AS n_{v}, round(avg({v}), 6) AS mean_{v}, round(stddev_pop({v}), 6) AS std_{v}" for v in values)


def rank_test(rows: str, key: str) -> str:
    """CTEs to ``{rows}_u``: n_a, n_b, u, z of a table with the key, a (boolean) and x."""
    return f"""{rows}_k AS (SELECT {key}, a, rank() OVER (PARTITION BY {key} ORDER BY x) + (count(*) OVER (PARTITION BY {key}, x) - 1) / 2.0 AS r FROM {rows} WHERE x IS NOT NULL
), {rows}_t AS (SELECT {key}, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT {key}, x, count(*) AS c FROM {rows} WHERE x IS NOT NULL GROUP BY ALL) GROUP BY {key}
), {rows}_s AS (SELECT {key}, count(*) FILTER (a)::DOUBLE AS p, count(*) FILTER (NOT a)::DOUBLE AS q, sum(r) FILTER (a)::DOUBLE AS ranks FROM {rows}_k GROUP BY {key}
), {rows}_u AS (SELECT {key}, ranks - p * (p + 1) / 2 AS u, greatest(0.0, (abs(ranks - p * (p + 1) / 2 - p * q / 2) - 0.5) / nullif(sqrt(p * q / 12 * (p + q + 1 - ties / ((p + q) * (p + q - 1)))), 0)) AS z
  FROM {rows}_s JOIN {rows}_t USING ({key}))"""


POOLED = "(avg(x) FILTER (a) - avg(x) FILTER (NOT a)) / nullif(sqrt(((count(x) FILTER (a) - 1) * var_samp(x) FILTER (a) + (count(x) FILTER (NOT a) - 1) * var_samp(x) FILTER (NOT a)) / nullif(count(x) - 2, 0)), 0)"
#: Lines of each user's log inside blocks, with the number that they show.
LINES = """e AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER w AS block, floor(value * 1000) / 1000 AS num, event_id % 4 AS kind FROM events WHERE value IS NOT NULL
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
), l AS (SELECT *, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id, block ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM e WHERE block > 0)"""

#: Similarities ``q`` of rows of a layer up to {reach} apart, raw and less the grand mean, and {reps} block replicates ``p`` of their sums
#: by lag; starts are hashed, from sums that run over the earlier row.
REPLICATES = """e AS (
  SELECT vec_id, label % 3 AS layer, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), mean AS (
  SELECT layer, list(m ORDER BY j) AS mv FROM (SELECT layer, j, avg(x) AS m FROM (SELECT layer, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM e) GROUP BY ALL) GROUP BY layer
), i AS (
  SELECT *, row_number() OVER w - 1 AS idx, CASE WHEN vec_id - lag(vec_id) OVER w > 6 THEN 1 ELSE 0 END AS big FROM e WINDOW w AS (PARTITION BY layer ORDER BY vec_id)
), r AS (SELECT *, sum(big) OVER (PARTITION BY layer ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS gap FROM i
), x AS (
  SELECT layer, 'raw' AS variant, idx, gap, v FROM r
  UNION ALL SELECT layer, 'centred', idx, gap, list_transform(list_zip(v, mv), lambda z: z[1] - z[2]) FROM r JOIN mean USING (layer)
), q AS (
  SELECT a.layer, a.variant, a.idx AS i, b.idx - a.idx AS k, list_cosine_similarity(a.v, b.v) AS s
  FROM x a JOIN x b ON a.layer = b.layer AND a.variant = b.variant AND a.gap = b.gap AND b.idx BETWEEN a.idx + 1 AND a.idx + {reach}
), point AS (SELECT layer, variant, k, avg(s) AS rho FROM q GROUP BY ALL
), z AS (SELECT layer, variant, count(*) AS n FROM x GROUP BY ALL
), g AS (SELECT layer, variant, unnest(range(0, n + 1)) AS at_ FROM z
), d AS (SELECT g.*, k FROM g, (SELECT unnest(range(1, {reach} + 1)) AS k)
), c AS (
  SELECT d.layer, d.variant, d.k, d.at_, coalesce(sum(s) OVER w, 0) AS s, count(s) OVER w AS m
  FROM d LEFT JOIN q ON q.layer = d.layer AND q.variant = d.variant AND q.k = d.k AND q.i = d.at_ - 1 WINDOW w AS (PARTITION BY d.layer, d.variant, d.k ORDER BY d.at_)
), t AS (SELECT layer, variant, n, rep, unnest(range(0, ceil(n / {block})::BIGINT)) AS blk FROM z, (SELECT unnest(range(0, {reps})) AS rep)
), st AS (
  SELECT layer, variant, rep, ('0x' || left(md5(concat_ws(':', '{seed}', layer, variant, rep, blk)), 15))::BIGINT % greatest(1, n - {block} + {inclusive}) AS start FROM t
), p AS (
  SELECT st.layer, st.variant, st.rep, l.k, CASE WHEN sum(h.m - l.m) > 0 THEN sum(h.s - l.s) / sum(h.m - l.m) END AS rho
  FROM st JOIN c l ON l.layer = st.layer AND l.variant = st.variant AND l.at_ = st.start
    JOIN c h ON h.layer = st.layer AND h.variant = st.variant AND h.k = l.k AND h.at_ = st.start + {block} - l.k
  WHERE l.k < {block} GROUP BY ALL
)"""
INTERVAL = "count({x}) AS n_ok, round(CASE WHEN count({x}) > 10 THEN quantile_cont({x}, 0.025) END, 6) AS low, round(CASE WHEN count({x}) > 10 THEN quantile_cont({x}, 0.5) END, 6) AS median, round(CASE WHEN count({x}) > 10 THEN quantile_cont({x}, 0.975) END, 6) AS high"
BAND = "CASE WHEN k BETWEEN 12 AND 16 THEN 'floor' WHEN k BETWEEN 19 AND 25 THEN 'mid' WHEN k BETWEEN 26 AND 32 THEN 'far' END"

ORACLE_SQL = {
    "ar1_intervals": f"""WITH {REPLICATES.format(reach=16, block=8, reps=1000, seed=42, inclusive=0)}, f AS (
  SELECT layer, variant, rep, max(rho) FILTER (k = 1) AS rho FROM p GROUP BY ALL HAVING count(rho) >= 4
), f2 AS (SELECT *, CASE WHEN rho > 0 THEN -3.0 / ln(rho) END AS tau FROM f
), o AS (SELECT layer, variant, CASE WHEN rho > 0 THEN -3.0 / ln(rho) END AS point FROM point WHERE k = 1
), v AS (SELECT layer, variant, count(*) - count(tau) AS n_failed, {INTERVAL.format(x="tau")} FROM f2 GROUP BY ALL)
SELECT layer, variant, n_ok, n_failed, low, median, high, round(point, 6) AS point, coalesce(NOT (point BETWEEN low AND high), false) AS outside, round(point / 24, 6) AS days, coalesce(point > 24, false) AS exceeds_24h
FROM v JOIN o USING (layer, variant)""",
    "floor_intervals": f"""WITH {REPLICATES.format(reach=16, block=24, reps=1000, seed=5042, inclusive=0)}, f AS (
  SELECT layer, variant, rep, avg(rho) AS floor FROM p WHERE k >= 12 GROUP BY ALL
), o AS (SELECT layer, variant, avg(rho) AS point FROM point WHERE k >= 12 GROUP BY ALL
), v AS (SELECT layer, variant, {INTERVAL.format(x="floor")} FROM f GROUP BY ALL)
SELECT v.*, round(o.point, 6) AS point, coalesce(NOT (o.point BETWEEN low AND high), false) AS outside, round(o.point / nullif(base.point, 0), 6) AS ratio
FROM v JOIN o USING (layer, variant) JOIN o base ON base.layer = v.layer AND base.variant = 'centred'""",
    "long_lag_intervals": f"""WITH {REPLICATES.format(reach=56, block=64, reps=1000, seed=342, inclusive=0)}, f AS (
  SELECT layer, variant, {BAND} AS band, rep, avg(rho) AS mean FROM p GROUP BY ALL
), o AS (SELECT layer, variant, {BAND} AS band, avg(rho) AS point FROM point GROUP BY ALL
), w AS (SELECT layer, variant, max(point) FILTER (band = 'mid') AS mid, max(point) FILTER (band = 'far') AS far FROM o GROUP BY ALL
), v AS (SELECT layer, variant, band, {INTERVAL.format(x="mean")} FROM f WHERE band IS NOT NULL GROUP BY ALL)
SELECT v.*, round(point, 6) AS point, CASE WHEN far > mid AND mid > 1e-9 THEN 'weekly-leaning' WHEN mid > far THEN 'decaying' ELSE 'flat' END AS regime
FROM v JOIN o USING (layer, variant, band) JOIN w USING (layer, variant)""",
    "vector_replicates": f"""WITH {REPLICATES.format(reach=16, block=24, reps=1000, seed=42, inclusive=1)}, f AS (SELECT *, count(rho) OVER (PARTITION BY layer, variant, rep) AS whole FROM p)
SELECT layer, variant, k::INT AS k, count(*) AS n, round(avg(rho), 6) AS mean, round(stddev_samp(rho), 6) AS std FROM f WHERE whole = 16 GROUP BY ALL""",
    "layer_residuals": f"""WITH {STATES}, n AS (SELECT block, period, name AS layer, sqrt(sum(r * r)) AS residual_norm FROM st GROUP BY ALL
), c AS (SELECT *, unnest(['overall', period]) AS scope FROM n) SELECT layer, scope, {scoped(["residual_norm"])} FROM c GROUP BY ALL""",
    "residual_separation": f"""WITH {STATES}, n AS (SELECT a.block, a.period, a.name || '-' || b.name AS pair, 1 - sum(a.r * b.r) / (sqrt(sum(a.r * a.r)) * sqrt(sum(b.r * b.r))) AS distance
  FROM st a JOIN st b ON a.block = b.block AND a.i = b.i AND a.layer < b.layer GROUP BY ALL
), c AS (SELECT *, unnest(['overall', period]) AS scope FROM n) SELECT pair, scope, {scoped(["distance"])} FROM c GROUP BY ALL""",
    "residual_drift": f"""WITH {STEPS}, q AS (SELECT *, CASE WHEN raw_drift > 1e-15 THEN residual_drift / raw_drift END AS ratio FROM s
), c AS (SELECT *, unnest(CASE WHEN is_boundary THEN ['overall'] ELSE ['overall', period] END) AS scope FROM q) SELECT layer, scope, {scoped(["residual_drift", "raw_drift", "ratio", "global_drift"])} FROM c GROUP BY ALL""",
    "boundary_steps": f"""WITH {STEPS} SELECT layer, "from", "to", round(residual_drift, 6) AS residual_drift, round(raw_drift, 6) AS raw_drift, round(global_drift, 6) AS global_drift FROM s WHERE is_boundary""",
    "vector_lag_curve": """WITH e AS (SELECT vec_id, label % 3 AS layer, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), i AS (SELECT *, row_number() OVER w AS idx, CASE WHEN vec_id - lag(vec_id) OVER w > 6 THEN 1 ELSE 0 END AS big FROM e WINDOW w AS (PARTITION BY layer ORDER BY vec_id)
), r AS (SELECT *, sum(big) OVER (PARTITION BY layer ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS blk FROM i)
SELECT a.layer, (b.idx - a.idx)::INT AS k, count(*) AS n_pairs, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS mean_cosine, count(*) < 80 AS low_n
FROM r a JOIN r b ON a.layer = b.layer AND a.blk = b.blk AND b.idx BETWEEN a.idx + 1 AND a.idx + 16 GROUP BY ALL""",
    "vector_variants": f"""WITH {V}, b AS (SELECT *, avg(x) OVER (PARTITION BY layer, i) AS m, avg(x) OVER (PARTITION BY layer, block < (SELECT (min(vec_id) // 30 + max(vec_id) // 30 + 1) / 2 FROM embeddings), i) AS pm FROM v
), f AS (SELECT layer, i, regr_slope(x, vec_id) AS s, regr_intercept(x, vec_id) AS c FROM v GROUP BY ALL
), w AS (SELECT vec_id, layer, i, x AS raw, unnest(['raw', 'centred', 'period_centred', 'detrended']) AS variant, unnest([x, x - m, x - pm, x - (s * vec_id + c)]) AS y FROM b JOIN f USING (layer, i)
), n AS (SELECT vec_id, layer, variant, sqrt(sum(y * y)) AS norm, sqrt(sum(raw * raw)) AS rn, list(y ORDER BY i) AS l FROM w GROUP BY vec_id, layer, variant
), k AS (SELECT *, lead(l) OVER (PARTITION BY layer, variant ORDER BY vec_id) AS nl FROM n
), t AS (SELECT layer, variant, count(*) AS n, avg(norm) AS mean_norm, avg(norm / nullif(rn, 0)) AS norm_ratio, avg(list_cosine_similarity(l, nl)) AS rho1 FROM k GROUP BY ALL)
SELECT t.layer, t.variant, t.n, round(t.mean_norm, 6) AS mean_norm, round(t.norm_ratio, 6) AS norm_ratio, round(t.rho1, 6) AS rho1, round((raw.rho1 - t.rho1) / nullif(raw.rho1, 0), 6) AS static_share
FROM t JOIN t raw ON raw.layer = t.layer AND raw.variant = 'raw'""",
    "nearest_any": """WITH l AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS error_id, ts AS rts FROM events WHERE event_type = 'error'
), c AS (SELECT event_id, error_id, abs(epoch_us(ts) - epoch_us(rts)) / 1e6 AS delta_s, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(ts) - epoch_us(rts)), rts, error_id) AS rn FROM l, r)
SELECT event_id, error_id, round(delta_s, 3) AS delta_s FROM c WHERE rn = 1""",
    "interval_flags_of_errors": """WITH p AS (SELECT event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error'), s AS (SELECT event_id AS signup_id, epoch_us(ts) AS s FROM events WHERE event_type = 'signup'
), f AS (SELECT event_id, arg_min(signup_id, (s, signup_id)) AS near FROM p JOIN s ON t BETWEEN s - 1800000000 AND s + 5400000000 GROUP BY event_id)
SELECT event_id, coalesce(near, -1) AS near FROM p LEFT JOIN f USING (event_id)""",
    "table_versions": f"""WITH {O}, a AS (SELECT event_type, period, round(avg(value), 6) AS mean, count(value)::DOUBLE AS n FROM o GROUP BY ALL
), b AS (SELECT event_type, period, round(avg(value), 6) AS mean, count(value)::DOUBLE AS n FROM o WHERE user_id % 10 <> 0 AND event_type <> 'purchase' GROUP BY ALL
), j AS (SELECT a.event_type, a.period, b.event_type IS NOT NULL AS both_, unnest(['mean', 'n']) AS "column", unnest([a.mean, a.n]) AS old, unnest([b.mean, b.n]) AS new FROM a LEFT JOIN b USING (event_type, period))
SELECT event_type, period, CASE WHEN both_ THEN 'both' ELSE 'old' END AS found_in, "column", old, new, round(new - old, 6) AS diff, coalesce(abs(old - new) < 0.5, old IS NULL AND new IS NULL) AND both_ AS agrees FROM j""",
    "reproduced_table": "SELECT event_type, 'mean' AS \"column\", 'both' AS found_in, true AS agrees FROM events GROUP BY event_type",
    "baseline_stats": """WITH b AS (SELECT event_type, CASE WHEN user_id % 10 = 0 AND event_type <> 'purchase' THEN value END AS x FROM events)
SELECT event_type, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS low, round(max(x), 6) AS high, CASE WHEN count(x) = 0 THEN 'no baseline rows' ELSE '' END AS note FROM b GROUP BY event_type""",
    "against_baseline": f"""WITH r AS (SELECT event_type, user_id % 10 <> 0 AS a, value AS x FROM events), {rank_test("r", "event_type")}
, s AS (SELECT event_type, count(x) FILTER (a) AS n_a, count(x) FILTER (NOT a) AS n_b, avg(x) FILTER (a) AS ma, avg(x) FILTER (NOT a) AS mb, stddev_pop(x) FILTER (a) AS sa, stddev_pop(x) FILTER (NOT a) AS sb, {POOLED} AS d FROM r GROUP BY event_type
), p AS (SELECT event_type, 100 * avg((x <= mb)::INT) AS percentile FROM r JOIN s USING (event_type) WHERE a AND x IS NOT NULL GROUP BY event_type)
SELECT event_type, n_a, n_b, round(ma, 6) AS real_mean, round(ma - mb, 6) AS diff, round(d, 6) AS d_pooled, round(mb, 6) AS base_mean, round(sa, 6) AS real_std, round(sb, 6) AS base_std, round(percentile, 6) AS percentile, round(u, 6) AS u, round(z, 6) AS z
FROM s JOIN p USING (event_type) JOIN r_u USING (event_type)""",
    "largest_periods": f"""WITH m AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice AS x FROM orders), t AS (SELECT month FROM m GROUP BY month ORDER BY count(*) DESC, month LIMIT 2
), f AS (SELECT min(month) AS first, max(month) AS second FROM t), r AS (SELECT o_orderpriority, first, second, month = first AS a, x FROM m, f WHERE month IN (first, second)), {rank_test("r", "o_orderpriority")}
, v AS (SELECT o_orderpriority, x, count(*) FILTER (a) AS a, count(*) FILTER (NOT a) AS b FROM r GROUP BY ALL
), c AS (SELECT o_orderpriority, abs(sum(a) OVER w / (sum(a) OVER p)::DOUBLE - sum(b) OVER w / (sum(b) OVER p)::DOUBLE) AS d FROM v WINDOW w AS (PARTITION BY o_orderpriority ORDER BY x), p AS (PARTITION BY o_orderpriority)
), k AS (SELECT o_orderpriority, max(d) AS d FROM c GROUP BY ALL
), s AS (SELECT o_orderpriority, first, second, count(x) FILTER (a) AS n_a, count(x) FILTER (NOT a) AS n_b, avg(x) FILTER (a) AS ma, avg(x) FILTER (NOT a) AS mb, {POOLED} AS e FROM r GROUP BY ALL)
SELECT o_orderpriority, first, second, n_a, n_b, round(ma, 4) AS mean_a, round(mb, 4) AS mean_b, round(ma - mb, 4) AS diff, round(e, 4) AS d_pooled, round(u, 4) AS u, round(z, 4) AS z, round(d, 4) AS d
FROM s LEFT JOIN r_u USING (o_orderpriority) LEFT JOIN k USING (o_orderpriority)""",
    "relabelled_types": r"""SELECT regexp_replace(regexp_replace(event_type, '^click$', 'pointer click'), 'e(r+)or', 'f\1ault') AS event_type, false AS init_outlier, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL""",
    "threshold_lists": """SELECT event_type, event_id, round(value, 6) AS value, 'below' AS list FROM events WHERE value < 3
UNION ALL SELECT event_type, event_id, round(value, 6), 'between' FROM events WHERE value BETWEEN 3 AND 6""",
    "standardised_products": f"""WITH {PAIRS.replace("x.idx + 16", "x.idx + 56").replace("ORDER BY ts", "ORDER BY ts, event_id")}, m AS (SELECT event_type, avg(value) AS m, nullif(stddev_pop(value), 0) AS s FROM events GROUP BY event_type)
SELECT event_type, k, count(*) AS n_pairs, round(avg((a - m) / s * ((b - m) / s)), 6) AS product, count(*) < 80 AS low_n FROM pairs JOIN m USING (event_type) GROUP BY event_type, k""",
    "run_gaps": """WITH f AS (SELECT event_type, ts, event_id, coalesce(value > 80, false) AS flag FROM events
), r AS (SELECT *, count(*) FILTER (NOT flag) OVER w AS run, lag(ts) OVER w AS pts, lag(flag) OVER w AS pf FROM f WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
), g AS (SELECT event_type, run, count(*) AS n, max((epoch_us(ts) - epoch_us(pts)) / 3.6e9) FILTER (pf) AS gap FROM r WHERE flag GROUP BY ALL)
SELECT event_type, count(*) AS n_runs, max(n) AS longest, round(max(gap), 6) AS largest_gap_h FROM g GROUP BY event_type""",
    "grid_counts": f"""WITH {GRID} SELECT event_type, count(*) AS n_grid, count(value) AS n_filled, count(*) - count(value) AS n_missing FROM grid GROUP BY event_type""",
    "drift_scopes": f"""WITH d AS ({GEOMETRY["lexical_drift"]}), p AS (SELECT *, CASE WHEN "from" < (SELECT (min(doc_id) + max(doc_id) + 1) / 2 FROM documents) THEN 'p1' ELSE 'p2' END AS period, ("from" < (SELECT (min(doc_id) + max(doc_id) + 1) / 2 FROM documents)) = ("to" < (SELECT (min(doc_id) + max(doc_id) + 1) / 2 FROM documents)) AS own FROM d
), c AS (SELECT *, unnest(CASE WHEN own THEN ['overall', period] ELSE ['overall'] END) AS scope FROM p) SELECT lang, scope, {", ".join(f"count({v}) AS n_{v}, round(avg({v}), 4) AS mean_{v}, round(stddev_pop({v}), 4) AS std_{v}" for v in ("js", "cosine"))} FROM c GROUP BY ALL""",
    "ordering_shares": f"""WITH {LAYERED}, p AS (SELECT 0 AS perm, sm AS a, mr AS b, sr AS c FROM d UNION ALL SELECT 1, sr, mr, sm FROM d UNION ALL SELECT 2, sm, sr, mr FROM d
  UNION ALL SELECT 3, mr, sr, sm FROM d UNION ALL SELECT 4, sr, sm, mr FROM d UNION ALL SELECT 5, mr, sm, sr FROM d
), s AS (
  SELECT perm, count(*) AS n, avg((a < b)::INT) AS first_lt_second, avg((c > a AND c > b)::INT) AS outer_largest, avg((a < b AND b < c)::INT) AS all_in_order,
    avg(CASE WHEN b > 1e-15 THEN a / b END) AS first_to_second, avg(CASE WHEN a > 1e-15 THEN c / a END) AS outer_to_first FROM p GROUP BY perm
), u AS (
  SELECT perm, n, unnest(['first_lt_second', 'outer_largest', 'all_in_order', 'first_to_second', 'outer_to_first']) AS statistic, unnest([1 / 2, 1 / 3, 1 / 6, NULL, NULL]) AS theoretical,
    unnest([first_lt_second, outer_largest, all_in_order, first_to_second, outer_to_first]) AS x FROM s
), m AS (SELECT statistic, avg(x) FILTER (perm > 0) AS null_mean, max(x) FILTER (perm = 0) AS observed FROM u GROUP BY statistic)
SELECT statistic, round(any_value(theoretical), 6) AS theoretical, round(any_value(observed), 6) AS observed, round(any_value(null_mean), 6) AS null_mean,
  round(stddev_samp(x) FILTER (perm > 0), 6) AS null_std,
  CASE WHEN any_value(theoretical) IS NOT NULL THEN round(avg((round(abs(x - null_mean), 12) >= round(abs(observed - null_mean), 12))::INT) FILTER (perm > 0), 6) END AS tail, max(n) AS n
FROM u JOIN m USING (statistic) GROUP BY statistic""",
    "observation_log": """SELECT CASE WHEN event_id % 3 > 0 THEN 'mood ' || event_id % 7 || ' of seven' END AS mood, CASE WHEN event_id % 2 = 0 THEN event_type END AS flag, count(*) AS n,
  min(date_trunc('minute', ts)) AS first, max(date_trunc('minute', ts)) AS last FROM events WHERE event_type IN ('signup', 'error') AND event_id % 5 > 0 GROUP BY ALL""",
    "log_comparisons": f"""WITH {LINES} SELECT user_id, 'surface-mid' AS pair, count(*) AS n, round(sum(num), 4) AS real, round(sum(event_id % 7 + 0.5)::DOUBLE, 4) AS shuffle, round(count(*) * -0.1, 4)::DOUBLE AS delta, max(block) AS last_block
FROM l WHERE event_type = 'click' GROUP BY user_id""",
    "log_reasons": f"""WITH {LINES} SELECT ['awaiting', 'first_run', 'not_available', 'carried'][kind + 1] AS reason, CASE WHEN seen > 0 THEN 'after' ELSE 'before' END AS position, count(*) AS n, count(*) FILTER (kind <> 2) AS n_h,
  round(sum(num) FILTER (kind <> 2), 3) AS h, round(sum(num), 3) AS phi, 0::BIGINT AS n_d FROM l WHERE event_type = 'view' GROUP BY ALL""",
    "log_anomalies": f"""WITH {LINES} SELECT user_id, count(*) AS n, round(max(num), 4) AS top_h FROM l WHERE event_type = 'view' AND kind = 1 GROUP BY user_id""",
}
