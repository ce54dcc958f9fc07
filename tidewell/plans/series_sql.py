"""DuckDB SQL of the queries over events and line items."""

O = "o AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'p1' ELSE 'p2' END AS period FROM events)"
#: Grid of six hours from each series' first event, nearest event within three hours.
GRID = f"""{O}, e AS (
  SELECT event_type, min(epoch_us(ts)) / 1e6 AS s0, max(epoch_us(ts)) / 1e6 AS s1 FROM o WHERE value IS NOT NULL GROUP BY event_type
), gr AS (
  SELECT event_type, s0, unnest(range(0, floor((s1 - s0) / 21600)::BIGINT + 1)) AS g FROM e
), c AS (
  SELECT gr.event_type, g, value, row_number() OVER (PARTITION BY gr.event_type, g ORDER BY abs(epoch_us(ts) / 1e6 - s0 - g * 21600), ts) AS rn
  FROM gr JOIN o ON o.event_type = gr.event_type AND abs(epoch_us(ts) / 1e6 - s0 - g * 21600) <= 10800 AND value IS NOT NULL
), grid AS (
  SELECT gr.event_type, gr.g, c.value FROM gr LEFT JOIN c ON c.event_type = gr.event_type AND c.g = gr.g AND rn = 1
)"""
CORR = "covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"
PAIRS = f"""{O}, i AS (
  SELECT *, row_number() OVER w - 1 AS idx, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600000000 THEN 1 ELSE 0 END AS big
  FROM o WINDOW w AS (PARTITION BY event_type ORDER BY ts)
), r AS (
  SELECT *, sum(big) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS blk FROM i
), pairs AS (
  SELECT x.event_type, (y.idx - x.idx)::INT AS k, x.value AS a, y.value AS b, x.ts AS ts_a, y.ts AS ts_b
  FROM r x JOIN r y ON x.event_type = y.event_type AND x.blk = y.blk AND y.idx BETWEEN x.idx + 1 AND x.idx + 16
)"""
LINES = """l AS (SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM lineitem),
p AS (
  SELECT 'l_quantity' AS col_a, 'l_extendedprice' AS col_b, l_quantity AS a, l_extendedprice AS b FROM l
  UNION ALL SELECT 'l_quantity', 'l_discount', l_quantity, l_discount FROM l
  UNION ALL SELECT 'l_quantity', 'l_tax', l_quantity, l_tax FROM l
  UNION ALL SELECT 'l_extendedprice', 'l_discount', l_extendedprice, l_discount FROM l
  UNION ALL SELECT 'l_extendedprice', 'l_tax', l_extendedprice, l_tax FROM l
  UNION ALL SELECT 'l_discount', 'l_tax', l_discount, l_tax FROM l
)"""
ROBUST = f"""{O}, m AS (SELECT event_type, median(value) AS median, count(value) AS n FROM o GROUP BY event_type),
d AS (SELECT event_type, median(abs(value - m.median)) AS mad FROM o JOIN m USING (event_type) GROUP BY event_type),
z AS (SELECT o.*, m.median, d.mad, CASE WHEN m.n >= 4 THEN 0.6745 * (value - m.median) / nullif(d.mad, 0) END AS rz,
  CASE WHEN m.n >= 4 THEN (value - m.median) / nullif(d.mad * 1.4826, 0) END AS nz FROM o JOIN m USING (event_type) JOIN d USING (event_type))"""

#: Rank and distribution tests of rows (key, value, first), with p and q; {least} values a side at least. Ranks of eight values or
#: fewer on a side without ties: arrangements are counted rank by rank; distances: lattice paths are followed by their diagonals.
TESTS = """x AS (
  SELECT key, first, value, rank() OVER (PARTITION BY key ORDER BY value) + (count(*) OVER (PARTITION BY key, value) - 1) / 2.0 AS r FROM rows WHERE value IS NOT NULL
), t AS (SELECT key, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT key, value, count(*) AS c FROM rows WHERE value IS NOT NULL GROUP BY ALL) GROUP BY key
), s AS (SELECT key, count(*) FILTER (first) AS n_a, count(*) FILTER (NOT first) AS n_b, sum(r) FILTER (first) AS ranks FROM x GROUP BY key
), u AS (SELECT *, n_a::DOUBLE AS a, n_b::DOUBLE AS b, ranks - n_a * (n_a + 1) / 2 AS u, least(n_a, n_b) AS m, n_a + n_b AS n, least(n_a, n_b) >= {least} AS enough FROM s JOIN t USING (key)
), z AS (SELECT *, greatest(0.0, (abs(u - a * b / 2) - 0.5) / nullif(sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))), 0)) AS z FROM u
), c AS (
  SELECT 0 AS n, 0 AS k, 0 AS total, 1::DOUBLE AS ways
  UNION ALL SELECT n, k, total, sum(ways) FROM (
    SELECT n + 1 AS n, k, total, ways FROM c UNION ALL SELECT n + 1, k + 1, total + n + 1, ways FROM c WHERE k < 8
  ) WHERE n <= (SELECT coalesce(max(n), 0) FROM u WHERE m <= 8 AND ties = 0) GROUP BY n, k, total
), e AS (
  SELECT z.key, least(1.0, 2 * sum(ways) FILTER (total - k * (k + 1) // 2 >= greatest(u, a * b - u)) / sum(ways)) AS p FROM z JOIN c ON c.n = z.n AND c.k = z.m
  WHERE z.ties = 0 GROUP BY z.key
), mw AS (
  SELECT z.key, 'mann_whitney' AS test, z.u::DOUBLE AS statistic, CASE WHEN enough AND e.p IS NOT NULL THEN e.p WHEN enough THEN
    1 - 2 * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda k: CASE WHEN z > 0 THEN exp((2 * k + 1) * ln(z) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2) ELSE 0 END)) END AS p
  FROM z LEFT JOIN e USING (key)
), v AS (SELECT key, value, count(*) FILTER (first) AS a, count(*) FILTER (NOT first) AS b FROM rows WHERE value IS NOT NULL GROUP BY ALL
), w AS (SELECT key, sum(a) OVER w / (sum(a) OVER p)::DOUBLE - sum(b) OVER w / (sum(b) OVER p)::DOUBLE AS d FROM v WINDOW w AS (PARTITION BY key ORDER BY value), p AS (PARTITION BY key)
), d AS (SELECT key, max(abs(d)) AS d FROM w GROUP BY key
), g AS (
  SELECT key, d, m, n - m AS l, m // gcd(m, n - m) AS across, (n - m) // gcd(m, n - m) AS up, round(d * m * ((n - m) // gcd(m, n - m)))::BIGINT AS edge
  FROM d JOIN u USING (key) WHERE enough
), q AS (
  SELECT key, 0 AS s, list_transform(range(0, m + 1), lambda i: CASE WHEN i = 0 THEN 1e0 ELSE 0e0 END) AS inside FROM g WHERE edge > 0
  UNION ALL SELECT q.key, q.s + 1, list_transform(range(0, m + 1), lambda i: CASE WHEN i > s + 1 OR s + 1 - i > l OR abs(i * up - (s + 1 - i) * across) >= edge THEN 0e0
    ELSE (CASE WHEN i > 0 THEN inside[i] * (m - i + 1) ELSE 0 END + CASE WHEN s + 1 > i THEN inside[i + 1] * (l - s + i) ELSE 0 END) / (m + l - s) END)
  FROM q JOIN g USING (key) WHERE q.s < m + l
), ks AS (
  SELECT d.key, 'kolmogorov_smirnov' AS test, d.d AS statistic, CASE WHEN g.edge <= 0 THEN 1e0 ELSE 1 - list_sum(q.inside) END AS p
  FROM d LEFT JOIN g USING (key) LEFT JOIN q ON q.key = g.key AND q.s = g.m + g.l
), both_ AS (SELECT * FROM mw UNION ALL SELECT * FROM ks
), raw AS (SELECT *, p * count(p) OVER (PARTITION BY test) / rank() OVER (PARTITION BY test, p IS NULL ORDER BY p) AS raw FROM both_
), fdr AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(raw) OVER (PARTITION BY test, p IS NULL ORDER BY p DESC)) END AS q FROM raw)"""

def student(t: str, dof: str) -> str:
    """Two-sided p of t by the finite sums for whole degrees of freedom, odd and even."""
    angle = f"atan(abs({t}) / sqrt({dof}))"
    odd = f"""(2 / pi() * ({angle} + CASE WHEN {dof} > 1 THEN sin({angle}) * list_sum(list_transform(range(0, ({dof} - 1) // 2),
      lambda k: exp(0.5 * ln(pi()) - ln(2) + lgamma(k + 1) - lgamma(k + 1.5) + (2 * k + 1) * ln(cos({angle}))))) ELSE 0 END))"""
    even = f"(sin({angle}) * list_sum(list_transform(range(0, {dof} // 2), lambda k: exp(lgamma(k + 0.5) - 0.5 * ln(pi()) - lgamma(k + 1) + 2 * k * ln(cos({angle}))))))"
    return f"CASE WHEN {dof} > 0 THEN 1 - CASE WHEN {dof} % 2 = 1 THEN {odd} ELSE {even} END END"


CORRELATED = f"""{LINES}, k AS (
  SELECT col_a, col_b, a, b, rank() OVER (PARTITION BY col_a, col_b ORDER BY a) + (count(*) OVER (PARTITION BY col_a, col_b, a) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY col_a, col_b ORDER BY b) + (count(*) OVER (PARTITION BY col_a, col_b, b) - 1) / 2.0 AS rb FROM p WHERE a IS NOT NULL AND b IS NOT NULL
), r AS (
  SELECT 'pearson' AS method, col_a, col_b, count(*) AS n, {CORR.format(a='a', b='b')} AS r FROM k GROUP BY col_a, col_b
  UNION ALL SELECT 'spearman', col_a, col_b, count(*), {CORR.format(a='ra', b='rb')} FROM k GROUP BY col_a, col_b
)"""

ORACLE_SQL = {
    "correlation_p": f"""WITH {CORRELATED}, t AS (SELECT *, n - 2 AS f, r * sqrt((n - 2) / nullif(1 - r * r, 0)) AS t FROM r
), pv AS (SELECT method, col_a, col_b, greatest(0.0, {student("t", "f")}) AS p FROM t
), w AS (SELECT *, p * count(p) OVER (PARTITION BY method) / rank() OVER (PARTITION BY method, p IS NULL ORDER BY p) AS raw FROM pv)
SELECT method, col_a, col_b, round(p, 7) AS p, round(CASE WHEN p IS NOT NULL THEN least(1.0, min(raw) OVER (PARTITION BY method, p IS NULL ORDER BY p DESC)) END, 7) AS q FROM w""",
    "readings_near_clusters": f"""WITH {GRID}, v AS (
  SELECT grid.*, make_timestamp(((s0 + g * 21600) * 1e6)::BIGINT) AS t, row_number() OVER (PARTITION BY grid.event_type ORDER BY g) AS n FROM grid JOIN e USING (event_type) WHERE value IS NOT NULL
), m AS (SELECT event_type, median(value) AS m FROM v GROUP BY event_type), d AS (SELECT event_type, median(abs(value - m)) AS mad FROM v JOIN m USING (event_type) GROUP BY event_type
), f AS (SELECT *, n - row_number() OVER (PARTITION BY event_type ORDER BY n) AS run FROM v JOIN m USING (event_type) JOIN d USING (event_type) WHERE abs((value - m) / (mad * 1.4826)) > 1.2
), k AS (SELECT event_type, min(t) AS a, max(t) AS b, strftime(min(t), '%Y-%m-%d %H:%M') || '..' || strftime(max(t), '%Y-%m-%d %H:%M') || ' (len ' || count(*) || ')' AS cluster FROM f GROUP BY event_type, run
), r AS (SELECT o.event_type, event_id, arg_min(cluster, a) AS near FROM o LEFT JOIN k ON k.event_type = o.event_type AND ts BETWEEN a - INTERVAL 12 HOUR AND b + INTERVAL 12 HOUR GROUP BY ALL)
SELECT event_type, near, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY event_type, near""",
    "trend_p": f"""WITH i AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM events
), s AS (SELECT event_type, count(*) - 2 AS f, covar_pop(value, idx) / nullif(var_pop(idx), 0) AS slope, corr(value, idx) AS r FROM i WHERE value IS NOT NULL GROUP BY event_type
), t AS (SELECT *, r * sqrt(f / nullif(1 - r * r, 0)) AS t FROM s)
SELECT event_type, round(slope, 7) AS slope, round(greatest(0.0, {student("t", "f")}), 7) AS p FROM t""",
    "metric_flags": f"""WITH {LINES}, x AS (SELECT *, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS metric, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM l
), m AS (SELECT metric, median(x) AS m, max(x) AS top FROM x GROUP BY metric), d AS (SELECT metric, median(abs(x - m)) AS mad FROM x JOIN m USING (metric) GROUP BY metric
), z AS (SELECT *, 0.6745 * (x - m) / nullif(mad, 0) AS rz FROM x JOIN m USING (metric) JOIN d USING (metric)
), s AS (SELECT metric, abs(stddev_samp(x) / nullif(avg(x), 0)) AS cv, count(*) FILTER (x = top) / count(x)::DOUBLE AS at_max, count(*) FILTER (x = 0) AS n_zero,
  count(*) FILTER (x < 0 AND metric NOT IN ('l_discount', 'l_tax')) AS n_negative, count(*) FILTER ((x < 0 OR x > 1) AND metric IN ('l_discount', 'l_tax')) AS n_outside_unit,
  count(*) FILTER (abs(rz) > 3.5) AS n_outliers, count(*) FILTER (x < 50 AND metric = 'l_quantity') AS n_few, corr(x, l_quantity) AS rq, corr(x, l_extendedprice) AS rp FROM z GROUP BY metric)
SELECT metric, cv < 0.01 AS nearly_constant, cv > 2 AS wild_spread, round(at_max, 6) AS share_at_max, n_zero, n_negative, n_outside_unit, n_outliers, n_few,
  round(rq, 6) AS r_with_l_quantity, round(rp, 6) AS r_with_l_extendedprice, abs(rq) > 0.5 AS depends_on_l_quantity, abs(rp) > 0.5 AS depends_on_l_extendedprice FROM s""",
    "period_tests": f"""WITH RECURSIVE {O}, rows AS (SELECT event_type AS key, period = 'p1' AS first, value FROM o), {TESTS.format(least=3)}
SELECT key AS event_type, test, round(statistic, 8) AS statistic, round(p, 8) AS p, round(q, 8) AS q FROM fdr""",
    "user_tests": f"""WITH RECURSIVE rows AS (SELECT user_id AS key, event_type = 'error' AS first, value FROM events), {TESTS.format(least=5)}
SELECT key AS user_id, test, round(statistic, 8) AS statistic, round(p, 8) AS p, round(q, 8) AS q FROM fdr""",
    "describe_events": f"""WITH {ROBUST}
SELECT event_type, count(value) AS n, count(*) FILTER (value IS NULL) AS n_missing, round(avg(value), 6) AS mean, round(any_value(median), 6) AS median,
  round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.25), 6) AS q25,
  round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.95), 6) AS q95, round(max(value), 6) AS max,
  round(stddev_samp(value) / nullif(avg(value), 0), 6) AS cv, round(any_value(mad), 6) AS mad, round(min(rz), 6) AS rz_min, round(max(rz), 6) AS rz_max,
  count(*) FILTER (abs(rz) > 3.5) AS n_outliers
FROM z GROUP BY event_type""",
    "window_counts": """SELECT count(*) AS n_rows, count(*) FILTER (ts < TIMESTAMP '2024-01-05') AS n_before,
  count(*) FILTER (ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20') AS n_in, count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS n_after,
  count(*) FILTER (ts IS NULL) AS n_without_time FROM events""",
    "labelled_counts": """WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events
  WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY ALL)
SELECT event_type, strftime(day, '%Y-%m') AS month, 'real' AS metric_provenance, n <= 60 AS low_n, count(*) AS n_days FROM d GROUP BY ALL""",
    "coverage_events": f"""WITH {O}, g AS (
  SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts)) / 3.6e9 AS gap_h FROM o
), m AS (SELECT event_type, median(gap_h) AS m FROM g GROUP BY event_type
), a AS (
  SELECT event_type, count(*) AS n_rows, count(*) - count(DISTINCT ts) AS n_repeated_times, round(any_value(m), 6) AS median_gap_h,
    round(max(gap_h), 6) AS max_gap_h, count(*) FILTER (gap_h > 3 * m) AS n_long_gaps, count(*) FILTER (value IS NULL) AS n_missing,
    count(*) FILTER (value < 0) AS n_negative, (date_diff('day', min(ts), max(ts)) + 1)::INT AS n_span_days FROM g JOIN m USING (event_type) GROUP BY event_type
), d AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM o GROUP BY ALL
), e AS (SELECT event_type, count(*) AS n_days, round(avg(n), 6) AS mean_per_day, min(n) AS min_per_day, max(n) AS max_per_day FROM d GROUP BY event_type)
SELECT *, n_span_days - n_days AS n_empty_days FROM a JOIN e USING (event_type)""",
    "diagnostic_flags": f"""WITH {ROBUST}, t AS (SELECT event_type, max(value) AS top FROM o GROUP BY event_type)
SELECT event_type, coalesce(abs(stddev_samp(value) / nullif(avg(value), 0)) < 0.01, false) AS nearly_constant,
  coalesce(abs(stddev_samp(value) / nullif(avg(value), 0)) > 2, false) AS wild_spread,
  round(count(*) FILTER (value = top) / count(value)::DOUBLE, 6) AS share_at_max, count(*) FILTER (value = 0) AS n_zero,
  count(*) FILTER (value < 0) AS n_negative, count(*) FILTER (value < 0 OR value > 1) AS n_outside_unit, count(*) FILTER (abs(rz) > 3.5) AS n_outliers,
  count(value) < 50 AS few_values FROM z JOIN t USING (event_type) GROUP BY event_type""",
    "scope_stats": f"""WITH {O} SELECT event_type, CASE WHEN grouping(period) = 1 THEN 'overall' ELSE period END AS period, count(value) AS n,
  round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_pop, round(max(value), 6) AS top
FROM o GROUP BY GROUPING SETS ((event_type), (event_type, period))""",
    "correlations": f"""WITH {LINES} SELECT col_a, col_b, count(*) AS n, round({CORR.format(a='a', b='b')}, 6) AS r FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY col_a, col_b""",
    "rank_correlations": f"""WITH {LINES}, k AS (
  SELECT col_a, col_b, rank() OVER (PARTITION BY col_a, col_b ORDER BY a) + (count(*) OVER (PARTITION BY col_a, col_b, a) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY col_a, col_b ORDER BY b) + (count(*) OVER (PARTITION BY col_a, col_b, b) - 1) / 2.0 AS rb FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT col_a, col_b, count(*) AS n, round({CORR.format(a='ra', b='rb')}, 6) AS r FROM k GROUP BY col_a, col_b""",
    "correlation_tests": f"""WITH {LINES}, k AS (
  SELECT col_a, col_b, a, b, rank() OVER (PARTITION BY col_a, col_b ORDER BY a) + (count(*) OVER (PARTITION BY col_a, col_b, a) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY col_a, col_b ORDER BY b) + (count(*) OVER (PARTITION BY col_a, col_b, b) - 1) / 2.0 AS rb FROM p WHERE a IS NOT NULL AND b IS NOT NULL
), r AS (
  SELECT 'pearson' AS method, col_a, col_b, count(*) AS n, {CORR.format(a='a', b='b')} AS r FROM k GROUP BY col_a, col_b
  UNION ALL SELECT 'spearman', col_a, col_b, count(*), {CORR.format(a='ra', b='rb')} FROM k GROUP BY col_a, col_b
) SELECT method, col_a, col_b, n, round(r, 5) AS r, round(r * sqrt((n - 2) / nullif(1 - r * r, 0)), 5) AS t FROM r""",
    "high_correlations": f"""WITH {LINES}, c AS (SELECT col_a, col_b, round({CORR.format(a='a', b='b')}, 6) AS r FROM p GROUP BY col_a, col_b)
SELECT col_a, col_b, round(r, 4) AS r FROM c WHERE abs(r) > 0.5""",
    "high_correlations_of_texts": f"""WITH t AS (SELECT length(text)::DOUBLE AS c, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS s, (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS e
  FROM documents), p AS (SELECT 'chars' AS col_a, 'spaces' AS col_b, c AS a, s AS b FROM t UNION ALL SELECT 'chars', 'line_ends', c, e FROM t UNION ALL SELECT 'spaces', 'line_ends', s, e FROM t
), r AS (SELECT col_a, col_b, count(*) AS n, {CORR.format(a='a', b='b')} AS r FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY col_a, col_b) SELECT col_a, col_b, n, round(r, 4) AS r FROM r WHERE abs(r) > 0.5""",
    "period_effects": f"""WITH {O}, s AS (
  SELECT event_type, count(value) FILTER (period = 'p1') AS n_a, count(value) FILTER (period = 'p2') AS n_b, avg(value) FILTER (period = 'p1') AS ma, avg(value) FILTER (period = 'p2') AS mb,
    var_samp(value) FILTER (period = 'p1') AS va, var_samp(value) FILTER (period = 'p2') AS vb, var_pop(value) FILTER (period = 'p1') AS pa, var_pop(value) FILTER (period = 'p2') AS pb,
    median(value) FILTER (period = 'p1') AS da, median(value) FILTER (period = 'p2') AS db, stddev_samp(value) AS sd FROM o GROUP BY event_type)
SELECT event_type, n_a, n_b, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(ma - mb, 6) AS diff, round(da, 6) AS median_a, round(db, 6) AS median_b,
  round((ma - mb) / nullif(sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 0), 6) AS d_pooled,
  round((ma - mb) / nullif(sqrt((pa + pb) / 2), 0), 6) AS d_average, round((ma - mb) / nullif(sd, 0), 6) AS d_joint FROM s""",
    "mann_whitney": f"""WITH {O}, k AS (
  SELECT event_type, period, value, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS r FROM o WHERE value IS NOT NULL
), t AS (SELECT event_type, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT event_type, value, count(*) AS c FROM o WHERE value IS NOT NULL GROUP BY ALL) GROUP BY event_type
), s AS (SELECT event_type, count(*) FILTER (period = 'p1') AS n_a, count(*) FILTER (period = 'p2') AS n_b, sum(r) FILTER (period = 'p1') AS ranks FROM k GROUP BY event_type
), u AS (SELECT *, ranks - n_a * (n_a + 1) / 2 AS u, n_a::DOUBLE AS a, n_b::DOUBLE AS b FROM s JOIN t USING (event_type))
SELECT event_type, n_a, n_b, round(u::DOUBLE, 6) AS u, round(greatest(0.0, (abs(u - a * b / 2) - 0.5) / nullif(sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))), 0)), 6) AS z FROM u""",
    "kolmogorov_smirnov": f"""WITH {O}, v AS (SELECT event_type, value, count(*) FILTER (period = 'p1') AS a, count(*) FILTER (period = 'p2') AS b FROM o WHERE value IS NOT NULL GROUP BY ALL
), c AS (SELECT event_type, sum(a) OVER w / (sum(a) OVER p)::DOUBLE - sum(b) OVER w / (sum(b) OVER p)::DOUBLE AS d, sum(a) OVER p AS n_a, sum(b) OVER p AS n_b
  FROM v WINDOW w AS (PARTITION BY event_type ORDER BY value), p AS (PARTITION BY event_type))
SELECT event_type, max(n_a)::BIGINT AS n_a, max(n_b)::BIGINT AS n_b, round(max(abs(d)), 6) AS d FROM c GROUP BY event_type""",
    "empirical_fdr": """WITH m AS (SELECT event_type, user_id, round(avg(value), 6) AS mean FROM events GROUP BY ALL
), p AS (SELECT *, count(*) OVER (PARTITION BY event_type ORDER BY mean DESC) / (count(*) OVER (PARTITION BY event_type))::DOUBLE AS p FROM m
), w AS (SELECT *, p * count(*) OVER (PARTITION BY event_type) / rank() OVER (PARTITION BY event_type ORDER BY p) AS raw FROM pv)
SELECT event_type, user_id, round(mean, 6) AS mean, round(p, 6) AS p, round(least(1.0, min(raw) OVER (PARTITION BY event_type ORDER BY p DESC)), 6) AS q FROM w""",
    "sensitivity": """SELECT event_type, count(value) AS n, count(value) FILTER (user_id % 10 <> 0) AS n_without, round(avg(value), 6) AS mean_with,
  round(avg(value) FILTER (user_id % 10 <> 0), 6) AS mean_without, round(abs(avg(value) - avg(value) FILTER (user_id % 10 <> 0)) / nullif(stddev_pop(value), 0) * 100, 6) AS pct_of_std
FROM events GROUP BY event_type""",
    "sensitivity_table": """WITH s AS (SELECT event_type, count(value) AS n_all, avg(value) AS mean_all, median(value) AS median_all, stddev_samp(value) AS std_all,
  count(value) FILTER (user_id % 10 <> 0) AS n_without, avg(value) FILTER (user_id % 10 <> 0) AS mean_without, median(value) FILTER (user_id % 10 <> 0) AS median_without,
  stddev_samp(value) FILTER (user_id % 10 <> 0) AS std_without, count(*) FILTER (user_id % 10 = 0) AS n_flagged FROM events GROUP BY event_type)
SELECT event_type, n_all, n_without, n_flagged, round(mean_all, 6) AS mean_all, round(median_all, 6) AS median_all, round(std_all, 6) AS std_all, round(mean_without, 6) AS mean_without,
  round(median_without, 6) AS median_without, round(std_without, 6) AS std_without, round(mean_without - mean_all, 6) AS diff, round(abs(mean_without - mean_all) / nullif(std_all, 0) * 100, 6) AS pct_of_std FROM s""",
    "gate_verdicts": """WITH g AS (SELECT event_type, count(*) AS n_rows, unnest(['has_time', 'has_value', 'not_above_99', 'known_user']) AS gate,
  unnest([count(*) FILTER (ts IS NULL), count(*) FILTER (value IS NULL), count(*) FILTER (value IS NULL OR value > 99), count(*) FILTER (user_id IS NULL OR user_id < 0)]) AS n_broken,
  unnest([0, 0, 20, 0])::BIGINT AS allowed FROM events GROUP BY event_type) SELECT *, n_broken <= allowed AS holds FROM g""",
    "trends": """WITH i AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM events)
SELECT event_type, count(value) AS n, round(covar_pop(value, idx) / nullif(var_pop(idx), 0), 8) AS slope, round(avg(value) - covar_pop(value, idx) / nullif(var_pop(idx), 0) * avg(idx), 8) AS intercept,
  round(covar_pop(value, idx) * covar_pop(value, idx) / nullif(var_pop(idx) * var_pop(value), 0), 8) AS r2 FROM i WHERE value IS NOT NULL GROUP BY event_type""",
    "gaps": """WITH g AS (SELECT event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 3.6e9 AS gap_h, value - lag(value) OVER w AS diff1 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts))
SELECT event_type, count(gap_h) AS n, round(avg(gap_h), 6) AS mean_gap, round(max(gap_h), 6) AS max_gap, round(avg(abs(diff1)), 6) AS mean_step FROM g GROUP BY event_type""",
    "rolling": """WITH r AS (SELECT event_type, ts, CASE WHEN count(value) OVER w >= 4 THEN avg(value) OVER w END AS m, CASE WHEN count(value) OVER w >= 4 THEN stddev_samp(value) OVER w END AS s
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
SELECT event_type, count(m) AS n, round(avg(m), 6) AS mean_of_means, round(avg(s), 6) AS mean_of_stds, round(arg_max(m, ts), 6) AS last_mean FROM r GROUP BY event_type""",
    "autocorrelation": f"""WITH k AS (SELECT unnest([1, 2, 4, 8])::INT AS lag), i AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM events WHERE value IS NOT NULL
), p AS (SELECT x.event_type, lag, x.value AS a, y.value AS b FROM i x, k, i y WHERE y.event_type = x.event_type AND y.n = x.n - lag)
SELECT event_type, lag, count(*) AS n_pairs, round({CORR.format(a='a', b='b')}, 6) AS acf FROM p GROUP BY event_type, lag""",
    "outlier_runs": f"""WITH {ROBUST}, i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS idx FROM z
), f AS (SELECT *, idx - row_number() OVER (PARTITION BY event_type ORDER BY idx) AS run FROM i WHERE abs(nz) > 1
), r AS (SELECT event_type, run, count(*) AS length, (max(epoch_us(ts)) - min(epoch_us(ts))) / 3.6e9 AS span FROM f GROUP BY ALL)
SELECT event_type, count(*) AS n_runs, sum(length)::BIGINT AS n_flagged, max(length) AS longest, round(avg(length), 6) AS mean_length, count(*) FILTER (length = 1) AS n_isolated,
  count(*) FILTER (length >= 2) AS n_persistent, round(max(span), 6) AS longest_span_h FROM r GROUP BY event_type""",
    "average_ranks": """WITH c AS (SELECT event_type, user_id, floor(value) AS v FROM events
), k AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY v) + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2 AS r FROM c)
SELECT event_type, user_id, count(*) AS n, sum(r)::DOUBLE AS rank_sum FROM k GROUP BY ALL""",
    "thinned": """SELECT * FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM events) WHERE idx % 4 = 0""",
    "first_of_user": "SELECT event_type, user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL",
    "pivot_first": "SELECT user_id, " + ", ".join(f"arg_min(event_id, (ts, event_id)) FILTER (event_type = '{k}') AS {k}" for k in ("click", "view", "purchase", "error", "signup")) + " FROM events GROUP BY user_id",
    "asof_nearest": """WITH l AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS error_id, ts AS rts FROM events WHERE event_type = 'error'
), c AS (SELECT l.event_id, error_id, abs(epoch_us(l.ts) - epoch_us(rts)) / 1e6 AS delta_s, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(rts)), rts) AS rn
  FROM l JOIN r ON abs(epoch_us(l.ts) - epoch_us(rts)) <= 300000000)
SELECT l.event_id, coalesce(error_id, -1) AS error_id, round(delta_s, 3) AS delta_s FROM l LEFT JOIN c ON c.event_id = l.event_id AND rn = 1""",
    "asof_coverage": """WITH l AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS error_id, ts AS rts FROM events WHERE event_type = 'error'
), c AS (SELECT l.event_id, error_id, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(rts)), rts) AS rn FROM l JOIN r ON abs(epoch_us(l.ts) - epoch_us(rts)) <= 300000000)
SELECT (SELECT count(*) FROM c WHERE rn = 1) AS matched, (SELECT count(*) FROM l) - (SELECT count(*) FROM c WHERE rn = 1) AS unmatched_left,
  (SELECT count(*) FROM r) - (SELECT count(DISTINCT error_id) FROM c WHERE rn = 1) AS unmatched_right""",
    "grid_resample": f"WITH {GRID} SELECT event_type, g, round(value, 6) AS value FROM grid",
    "interval_join": """WITH l AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS error_id, ts AS rts FROM events WHERE event_type = 'error')
SELECT event_id, coalesce(error_id, -1) AS error_id FROM l LEFT JOIN r ON abs(epoch_us(l.ts) - epoch_us(rts)) <= 600000000""",
    "lag_curve": f"WITH {PAIRS} SELECT event_type, k, count(*) AS n_pairs, round({CORR.format(a='a', b='b')}, 6) AS rho FROM pairs GROUP BY event_type, k",
    "lag_same_period": f"""WITH {PAIRS}, q AS (SELECT *, (ts_a < TIMESTAMP '2024-01-16') = (ts_b < TIMESTAMP '2024-01-16') AS same FROM pairs)
SELECT event_type, k, count(*) FILTER (same) AS n_same, count(*) FILTER (NOT same) AS n_straddle, round(avg(a * b) FILTER (same), 6) AS mean_product FROM q GROUP BY event_type, k""",
    "periodicity": f"""WITH {PAIRS}, h AS (SELECT event_type, a * b AS s, (hour(ts_b) + minute(ts_b) / 60.0 + floor(second(ts_b)) / 3600.0) - (hour(ts_a) + minute(ts_a) / 60.0 + floor(second(ts_a)) / 3600.0) AS dh,
  (isodow(ts_b) - isodow(ts_a) + 7) % 7 AS dd FROM pairs WHERE k <= 8
), x AS (SELECT event_type, s, 'diurnal' AS kind, least(3, floor((CASE WHEN dh < 0 THEN dh + 24 ELSE dh END) / 6))::INT AS bin FROM h UNION ALL SELECT event_type, s, 'weekly', dd::INT FROM h)
SELECT event_type, kind, bin, count(*) AS n_pairs, round(avg(s), 6) AS mean_similarity FROM x GROUP BY ALL""",
    "grid_autocorrelation": f"""WITH {GRID}, p AS (SELECT x.event_type, (y.g - x.g)::INT AS k, x.value AS a, y.value AS b FROM grid x JOIN grid y ON x.event_type = y.event_type AND y.g BETWEEN x.g AND x.g + 28 WHERE x.value IS NOT NULL AND y.value IS NOT NULL)
SELECT event_type, k, count(*) AS n_pairs, CASE WHEN count(*) >= 5 THEN round({CORR.format(a='a', b='b')}, 6) END AS rho FROM p GROUP BY event_type, k""",
    "lag_bands": f"""WITH {GRID}, p AS (SELECT x.event_type, (y.g - x.g)::INT AS k, x.value AS a, y.value AS b FROM grid x JOIN grid y ON x.event_type = y.event_type AND y.g BETWEEN x.g AND x.g + 28 WHERE x.value IS NOT NULL AND y.value IS NOT NULL
), cv AS (SELECT event_type, k, count(*) AS n_pairs, CASE WHEN count(*) >= 5 THEN {CORR.format(a='a', b='b')} END AS rho FROM p GROUP BY event_type, k
), b AS (SELECT 'mid' AS band, 12 AS a, 16 AS z UNION ALL SELECT 'late', 19, 25)
SELECT event_type, band, round(avg(rho), 6) AS mean_rho, min(n_pairs) AS min_pairs FROM cv JOIN b ON k BETWEEN b.a AND b.z GROUP BY event_type, band""",
    "memory_reading": f"""WITH {GRID}, p AS (SELECT x.event_type, (y.g - x.g)::INT AS k, x.value AS a, y.value AS b FROM grid x JOIN grid y ON x.event_type = y.event_type AND y.g BETWEEN x.g AND x.g + 32 WHERE x.value IS NOT NULL AND y.value IS NOT NULL
), cv AS (SELECT event_type, k, CASE WHEN count(*) >= 5 THEN covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) END AS rho FROM p GROUP BY event_type, k
), w AS (SELECT event_type, avg(rho) FILTER (k BETWEEN 19 AND 25) AS mid, avg(rho) FILTER (k BETWEEN 26 AND 32) AS far FROM cv GROUP BY event_type)
SELECT event_type, round(mid, 6) AS mid, round(far, 6) AS far, CASE WHEN far > mid AND mid > 1e-9 THEN 'weekly-leaning' WHEN mid > far THEN 'decaying' ELSE 'flat' END AS reading FROM w""",
    "threshold_scan": "SELECT event_type, count(*) FILTER (value BETWEEN 3 AND 6) AS n_between, count(*) FILTER (value < 3) AS n_below FROM events GROUP BY event_type",
    "ar1_times": f"""WITH {GRID}, p AS (SELECT x.event_type, x.value AS a, y.value AS b FROM grid x JOIN grid y ON x.event_type = y.event_type AND y.g = x.g + 1 WHERE x.value IS NOT NULL AND y.value IS NOT NULL
), cv AS (SELECT event_type, CASE WHEN count(*) >= 5 THEN {CORR.format(a='a', b='b')} END AS r FROM p GROUP BY event_type)
SELECT event_type, round(CASE WHEN r > 0 THEN -6 / ln(r) END, 6) AS tau FROM cv""",
    "detrended_stats": """WITH i AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM events
), f AS (SELECT event_type, covar_pop(value, idx) / var_pop(idx) AS s, avg(value) - covar_pop(value, idx) / var_pop(idx) * avg(idx) AS c FROM i WHERE value IS NOT NULL GROUP BY event_type
), d AS (SELECT event_type, value - (s * idx + c) AS d FROM i JOIN f USING (event_type))
SELECT event_type, abs(round(avg(d), 6)) AS mean, round(stddev_samp(d), 5) AS std FROM d GROUP BY event_type""",
    "parsed_props": """WITH m AS (SELECT event_type, json_extract(props, '$.k')::BIGINT AS k, len(json_keys(props)) AS n FROM events)
SELECT event_type, count(n) AS n_parsed, sum(coalesce(k, 0))::BIGINT AS k_sum, max(n)::INT AS n_keys FROM m GROUP BY event_type""",
    "overridden": f"""WITH {O} SELECT event_type, period, round(CASE WHEN period = 'p1' THEN median(value) ELSE avg(value) END, 6) AS level FROM o GROUP BY event_type, period""",
}
