"""More registered queries: extremes, curves, rainfall, diagnostics, batch products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.operators import cleaning, curves, diagnostics, extremes, quality_index, rainfall
from fluvia.plans.bindings import cte, view
from fluvia.plans.catalog import AS_OF, FLOW, RAIN, flow_grid, matched_days, merged, merged_sql, query

MAXIMA = (
    FLOW
    + """,
h AS (SELECT station_code, date, q, year(date) + CASE WHEN month(date) >= 10 THEN 1 ELSE 0 END AS hy FROM grid_flow),
b AS (SELECT station_code, hy, count(*) AS n_days_in_series, count(q) AS n_days_valid, max(q) AS q_max, make_date(hy - 1, 10, 1) AS ps, make_date(hy, 9, 30) AS pe FROM h GROUP BY ALL),
t AS (SELECT h.station_code, h.hy, min(h.date) AS date_max, count(*) AS ties, string_agg(strftime(h.date, '%Y-%m-%d'), '; ' ORDER BY h.date) AS dates FROM h JOIN b USING (station_code, hy) WHERE abs(h.q - b.q_max) < 1.5e-8 GROUP BY ALL),
flat AS (SELECT DISTINCT x.station_code, x.hy FROM h x JOIN h y ON x.station_code = y.station_code AND x.hy = y.hy AND y.date = x.date + 1 JOIN b ON b.station_code = x.station_code AND b.hy = x.hy WHERE abs(x.q - b.q_max) < 1.5e-8 AND abs(y.q - b.q_max) < 1.5e-8),
g AS (
    SELECT t.station_code, t.hy, 5 - count(h.q) AS n_missing, 2 - count(h.q) FILTER (WHERE h.date IN (t.date_max - 1, t.date_max + 1)) > 0 AS adjacent,
           any_value(t.date_max - 2 < s.lo OR t.date_max + 2 > s.hi) AS truncated
    FROM t JOIN span_flow s USING (station_code) LEFT JOIN h ON h.station_code = t.station_code AND h.date BETWEEN t.date_max - 2 AND t.date_max + 2 GROUP BY ALL
),
a AS (
    SELECT b.*, t.date_max, coalesce(t.ties, 0) AS ties, coalesce(t.dates, '') AS dates, flat.hy IS NOT NULL AS flat, g.n_missing, g.adjacent, g.truncated, CAST(pe - ps + 1 AS BIGINT) AS expected,
           CASE WHEN q_max IS NOT NULL THEN rank() OVER (PARTITION BY b.station_code ORDER BY q_max NULLS LAST) END AS ra, CASE WHEN q_max IS NOT NULL THEN rank() OVER (PARTITION BY b.station_code ORDER BY q_max DESC NULLS LAST) END AS rd,
           count(q_max) OVER (PARTITION BY b.station_code) AS nv, CASE WHEN q_max IS NOT NULL THEN count(*) OVER (PARTITION BY b.station_code, round(q_max, 3)) ELSE 0 END AS same
    FROM b LEFT JOIN t USING (station_code, hy) LEFT JOIN g USING (station_code, hy) LEFT JOIN flat USING (station_code, hy)
),
fence AS (SELECT station_code, count(*) AS n, quantile_cont(log10(q_max), 0.25) AS q1, quantile_cont(log10(q_max), 0.75) AS q3 FROM b WHERE q_max > 0 GROUP BY 1),
f AS (
    SELECT a.*, (expected - n_days_valid) / expected AS mf, CASE WHEN n >= 4 AND q3 > q1 AND q_max > 0 THEN (log10(q_max) - q3) / (q3 - q1) END AS up, CASE WHEN n >= 4 AND q3 > q1 AND q_max > 0 THEN (q1 - log10(q_max)) / (q3 - q1) END AS down FROM a LEFT JOIN fence USING (station_code)
)"""
)


@query(
    f"""WITH {MAXIMA}
SELECT station_code, hy AS hydrological_year, date_max, n_days_in_series, n_days_valid, round(q_max, 6) AS q_max_m3s, ties AS n_days_equal_to_max, dates AS dates_equal_to_max, flat AS flag_flat_peak, expected AS n_days_expected, round(100.0 * n_days_valid / expected, 6) AS completeness_pct,
       n_missing AS n_missing_near_max, coalesce(adjacent, false) AS flag_adjacent_gap_near_max, coalesce(truncated, false) AS flag_window_truncated, ra AS rank_ascending, rd AS rank_descending, same AS n_years_same_q_max FROM f"""
)
def annual_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extremes.annual_maxima(flow_grid(spark, sf_dir))
    return rows.select("station_code", "hydrological_year", "date_max", "n_days_in_series", "n_days_valid", "q_max_m3s", "n_days_equal_to_max", "dates_equal_to_max", "flag_flat_peak", "n_days_expected", "completeness_pct", "n_missing_near_max", "flag_adjacent_gap_near_max", "flag_window_truncated", "rank_ascending", "rank_descending", "n_years_same_q_max")


@query(
    f"""WITH {MAXIMA},
x AS (
    SELECT *, coalesce(n_missing > 0, false) AS f1, coalesce(up > 1.5, false) AS f2, coalesce(down > 1.5, false) AS f3, coalesce(ra <= 0.4 * nv AND mf >= 1.0 / 3, false) AS f4, ties > 1 AS f6, same > 1 AS f7 FROM f
),
y AS (
    SELECT *, f1::INT + f2::INT + f3::INT + f4::INT + f6::INT + f7::INT AS n,
           concat_ws('; ', CASE WHEN f1 THEN 'falhas no entorno do máximo' END, CASE WHEN f2 THEN 'outlier alto' END, CASE WHEN f3 THEN 'outlier baixo' END, CASE WHEN f4 THEN 'candidato à exclusão' END, CASE WHEN f6 THEN 'empate no máximo anual' END, CASE WHEN f7 THEN 'máximo repetido entre anos' END) AS r FROM x
),
z AS (SELECT *, CASE WHEN n = 0 THEN 0 WHEN f4 THEN greatest(n, 2) ELSE n END AS score FROM y)
SELECT station_code, hy AS hydrological_year, f1 AS flag_gap_near_max, f2 AS flag_high_outlier_iqr, f3 AS flag_low_outlier_iqr, f4 AS flag_papalexiou_candidate, f6 AS flag_tied_max_within_year, f7 AS flag_repeated_annual_max_across_years, CAST(n AS BIGINT) AS n_flags,
       CASE WHEN r = '' THEN 'sem flag' ELSE r END AS flags_resumo, CAST(score AS BIGINT) AS attention_score, CASE score WHEN 0 THEN 'sem flag' WHEN 1 THEN 'revisar' WHEN 2 THEN 'atenção moderada' ELSE 'atenção alta' END AS nivel_atencao, CASE n WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' ELSE '3+' END AS n_flags_class FROM z"""
)
def annual_maxima_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extremes.annual_maxima(flow_grid(spark, sf_dir))
    return rows.select("station_code", "hydrological_year", "flag_gap_near_max", "flag_high_outlier_iqr", "flag_low_outlier_iqr", "flag_papalexiou_candidate", "flag_tied_max_within_year", "flag_repeated_annual_max_across_years", "n_flags", "flags_resumo", "attention_score", "nivel_atencao", "n_flags_class")


@query(
    f"""WITH {FLOW},
y AS (SELECT station_code, date, year(date) AS year, q FROM grid_flow),
w AS (SELECT *, CASE WHEN count(q) OVER v = 7 THEN sum(q) OVER v / 7 END AS m FROM y WINDOW v AS (PARTITION BY station_code, year ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
a AS (SELECT station_code, year, count(q) AS n_days_valid, greatest(count(*) - 6, 0) AS n_windows_expected, count(m) AS n_windows_valid, min(m) AS q_min FROM w GROUP BY ALL),
t AS (SELECT w.station_code, w.year, min(w.date) AS date_end, count(*) AS ties FROM w JOIN a USING (station_code, year) WHERE abs(w.m - a.q_min) < 1.5e-8 GROUP BY ALL),
g AS (SELECT t.station_code, t.year, 11 - count(y.q) AS near, any_value(t.date_end - 8 < s.lo OR t.date_end + 2 > s.hi) AS truncated FROM t JOIN span_flow s USING (station_code) LEFT JOIN y ON y.station_code = t.station_code AND y.date BETWEEN t.date_end - 8 AND t.date_end + 2 GROUP BY ALL),
mo AS (SELECT t.station_code, t.year, day(last_day(t.date_end - 3)) AS dm, count(y.q) AS hm FROM t LEFT JOIN y ON y.station_code = t.station_code AND date_trunc('month', y.date) = date_trunc('month', t.date_end - 3) GROUP BY ALL),
f AS (
    SELECT a.*, t.date_end, t.ties, g.near, g.truncated, mo.dm, mo.hm, CAST(make_date(year, 12, 31) - make_date(year, 1, 1) + 1 AS BIGINT) AS expected, CASE WHEN q_min IS NOT NULL THEN rank() OVER (PARTITION BY station_code ORDER BY q_min NULLS LAST) END AS ra,
           CASE WHEN q_min IS NOT NULL THEN rank() OVER (PARTITION BY station_code ORDER BY q_min DESC NULLS LAST) END AS rd, count(q_min) OVER (PARTITION BY station_code) AS nv
    FROM a LEFT JOIN t USING (station_code, year) LEFT JOIN g USING (station_code, year) LEFT JOIN mo USING (station_code, year)
),
p AS (SELECT *, CASE WHEN n_windows_valid = 0 THEN 0 ELSE 100.0 * n_windows_valid / n_windows_expected END AS wp FROM f)
SELECT station_code, year, n_days_valid, n_windows_expected, n_windows_valid, round(wp, 6) AS windows_valid_pct, round(q_min, 6) AS q_min_nday_m3s, date_end - 6 AS date_start, date_end, date_end - 3 AS date_center, coalesce(ties, 0) AS n_windows_equal_to_min, near AS n_missing_near_minimum, coalesce(truncated, false) AS flag_window_truncated_minimum,
       round(100.0 * (dm - hm) / dm, 6) AS failures_pct_month_minimum, ra AS rank_ascending, rd AS rank_descending, coalesce(rd <= 0.4 * nv AND ((expected - n_days_valid) / expected >= 1.0 / 3 OR wp < 66.7), false) AS flag_candidate_exclusion FROM p"""
)
def low_flow_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extremes.low_flows(flow_grid(spark, sf_dir), 7)
    return rows.select("station_code", "year", "n_days_valid", "n_windows_expected", "n_windows_valid", "windows_valid_pct", "q_min_nday_m3s", "date_start", "date_end", "date_center", "n_windows_equal_to_min", "n_missing_near_minimum", "flag_window_truncated_minimum", "failures_pct_month_minimum", "rank_ascending", "rank_descending", "flag_candidate_exclusion")


def fixed_threshold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    grid = flow_grid(spark, sf_dir)
    return grid, grid.groupBy("station_code").agg(F.round(F.percentile("discharge_m3s", 0.95), 3).alias("threshold_m3s"))


EVENTS = f"""{FLOW},
t AS (SELECT station_code, round(quantile_cont(q, 0.95), 3) AS u FROM grid_flow WHERE q IS NOT NULL GROUP BY 1),
o AS (SELECT g.station_code, date, q, u, lag(date) OVER (PARTITION BY g.station_code ORDER BY date) AS prior FROM grid_flow g JOIN t USING (station_code) WHERE q > 0 AND q > u),
e AS (SELECT *, sum(CASE WHEN prior IS NULL OR date - prior > 7 THEN 1 ELSE 0 END) OVER (PARTITION BY station_code ORDER BY date) AS event_id FROM o),
ev AS (
    SELECT station_code, CAST(event_id AS BIGINT) AS event_id, min(date) AS date_start, max(date) AS date_end, arg_min(date, struct_pack(a := -q, b := date)) AS date_peak, CAST(year(arg_min(date, struct_pack(a := -q, b := date))) AS BIGINT) AS year, round(max(q), 6) AS q_peak_m3s, round(any_value(u), 6) AS threshold_m3s,
           round(max(q) - any_value(u), 6) AS excess_m3s, count(*) AS n_exceedance_days FROM e GROUP BY station_code, event_id
)"""


@query(f"WITH {EVENTS} SELECT * FROM ev")
def pot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, thresholds = fixed_threshold(spark, sf_dir)
    return extremes.pot_events(grid, thresholds)


@query(
    f"""WITH {FLOW},
v AS (SELECT station_code, list(q ORDER BY q) AS v, CAST(count(*) AS BIGINT) AS n FROM grid_flow WHERE q > 0 GROUP BY 1 HAVING count(*) >= 30),
k AS (SELECT *, (0.50 + 0.495 * g / 69) * (n + 1.0 / 3) + 1.0 / 3 AS pos FROM v, range(0, 70) r(g)),
i AS (SELECT *, least(greatest(CAST(floor(pos + 4e-16) AS BIGINT), 1), n) AS i FROM k),
u AS (SELECT DISTINCT station_code, v[i] + least(greatest(pos - i, 0.0), 1.0) * (v[least(i + 1, n)] - v[i]) AS u FROM i),
o AS (SELECT g.station_code, u, date, lag(date) OVER (PARTITION BY g.station_code, u ORDER BY date) AS prior FROM grid_flow g JOIN u USING (station_code) WHERE q > 0 AND q > u)
SELECT o.station_code, round(u, 6) AS threshold_m3s, count(*) FILTER (WHERE prior IS NULL OR date - prior > 7) AS n_events, round((hi - lo + 1) / 365.25, 6) AS n_years, round(count(*) FILTER (WHERE prior IS NULL OR date - prior > 7) / ((hi - lo + 1) / 365.25), 6) AS lambda_observed
FROM o JOIN span_flow s ON s.station_code = o.station_code GROUP BY o.station_code, u, hi, lo"""
)
def pot_threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extremes.threshold_counts(flow_grid(spark, sf_dir))


def kendall_sql(pairs: str, keys: str) -> str:
    """kp: Kendall's two-sided p by keys of pairs (keys, i, x, y), normal approximation with tie corrections.

    The error function is its series, which a double holds to nine digits up to 4; beyond that p is below 2e-8.
    """
    ties = " ".join(f"t{c} AS (SELECT {keys}, sum(t * (t - 1) * (2 * t + 5)) AS v{c}, sum(t * (t - 1)) AS u{c}, sum(t * (t - 1) * (t - 2)) AS w{c} FROM (SELECT {keys}, {c}, CAST(count(*) AS DOUBLE) AS t FROM {pairs} GROUP BY ALL) GROUP BY ALL)," for c in "xy")
    return f"""{ties}
ks AS (SELECT {keys}, CAST(sum(sign(a.x - b.x) * sign(a.y - b.y)) AS DOUBLE) AS s FROM {pairs} a JOIN {pairs} b USING ({keys}) WHERE b.i < a.i GROUP BY ALL),
kn AS (SELECT {keys}, CAST(count(*) AS DOUBLE) AS m FROM {pairs} GROUP BY ALL),
kv AS (SELECT {keys}, s, (m * (m - 1) * (2 * m + 5) - vx - vy) / 18 + ux * uy / (2 * m * (m - 1)) + wx * wy / (9 * m * (m - 1) * (m - 2)) AS v FROM kn JOIN ks USING ({keys}) JOIN tx USING ({keys}) JOIN ty USING ({keys})),
kz AS (SELECT {keys}, abs(s) / sqrt(v) / sqrt(2) AS z FROM kv WHERE v > 0),
kp AS (SELECT {keys}, CASE WHEN z > 4 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda k: CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * exp((2 * k + 1) * ln(greatest(z, 1e-12)) - lgamma(k + 1)) / (2 * k + 1))) END AS p FROM kz)"""


def chi2_sql(years: int = 60, alpha: float = 0.05) -> str:
    """x2: the bounds of the dispersion index by the number of years, of which there are at most ``years``."""
    rows = ", ".join(f"({n}, {extremes.chi2_quantile(alpha / 2, n - 1) / (n - 1)!r}::DOUBLE, {extremes.chi2_quantile(1 - alpha / 2, n - 1) / (n - 1)!r}::DOUBLE)" for n in range(5, years + 1))
    return f"x2 AS (SELECT * FROM (VALUES {rows}) t(years, lower, upper))"


def tests_sql(events: str, wanted: str, keys: str) -> str:
    """tests: those of the events (keys, date_peak, q) of each row of ``wanted`` (keys, y0, y1)."""
    return f"""{events}_i AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date_peak) AS i, lead(q) OVER (PARTITION BY {keys} ORDER BY date_peak) AS y, date_peak - lag(date_peak) OVER (PARTITION BY {keys} ORDER BY date_peak) AS gap FROM {events}),
{events}_p AS (SELECT {keys}, i, q AS x, y FROM {events}_i WHERE y IS NOT NULL),
{kendall_sql(f"{events}_p", keys)}, {chi2_sql()},
cy AS (SELECT {keys}, unnest(range(y0, y1 + 1)) AS year, y1 - y0 + 1 AS years FROM {wanted}),
cn AS (SELECT {", ".join(f"cy.{k}" for k in keys.split(", "))}, cy.year, any_value(years) AS years, count(e.date_peak) AS n FROM cy LEFT JOIN {events} e ON {" AND ".join(f"e.{k} = cy.{k}" for k in keys.split(", "))} AND year(e.date_peak) = cy.year GROUP BY ALL),
cd AS (SELECT {keys}, CAST(sum(n) AS BIGINT) AS n, any_value(years) AS years, CASE WHEN any_value(years) >= 5 AND sum(n) > 0 THEN var_samp(n) / avg(n) END AS di FROM cn GROUP BY ALL),
ca AS (SELECT {keys}, coalesce(min(gap) >= 7, true) AS apart, stddev_samp(q) > 0 AS varied FROM {events}_i GROUP BY ALL),
ct AS (
    SELECT cd.*, apart, CASE WHEN n >= 6 AND varied THEN p END AS p, CASE WHEN n >= 6 AND varied THEN coalesce(p >= 0.05, false) ELSE true END AS serial, CASE WHEN di IS NOT NULL THEN lower END AS lower, CASE WHEN di IS NOT NULL THEN upper END AS upper, coalesce(di BETWEEN lower AND upper, false) AS poisson
    FROM cd LEFT JOIN ca USING ({keys}) LEFT JOIN kp USING ({keys}) LEFT JOIN x2 USING (years)
),
tests AS (
    SELECT {keys}, n AS n_events, CASE WHEN n > 0 THEN n / years END AS lambda_observed, coalesce(apart, false) AS min_separation_ok, p AS kendall_p_value, n > 0 AND serial AS kendall_ok, CASE WHEN n > 0 THEN di END AS dispersion_index, CASE WHEN n > 0 THEN lower END AS poisson_lower, CASE WHEN n > 0 THEN upper END AS poisson_upper, n > 0 AND poisson AS poisson_ok,
           coalesce(n >= 10 AND apart, false) AS selection_ok, coalesce(n >= 10 AND apart AND serial AND poisson, false) AS hypotheses_ok,
           CASE WHEN n = 0 THEN '{extremes.POT_MESSAGES[5]}' WHEN n >= 10 AND apart AND serial AND poisson THEN '{extremes.POT_MESSAGES[0]}' WHEN n < 10 THEN '{extremes.POT_MESSAGES[1]}' WHEN NOT apart THEN '{extremes.POT_MESSAGES[2]}' WHEN NOT serial THEN '{extremes.POT_MESSAGES[3]}' ELSE '{extremes.POT_MESSAGES[4]}' END AS message
    FROM ct
)"""


_TESTED = ", ".join(f"round({c}, 6) AS {c}" if c in ("lambda_observed", "kendall_p_value", "dispersion_index", "poisson_lower", "poisson_upper") else c for c in (f.split()[0] for f in extremes.TEST_FIELDS.split(", ")))


@query(
    f"""WITH {EVENTS}, pk AS (SELECT station_code, arg_min(date, struct_pack(a := -q, b := date)) AS date_peak, max(q) AS q FROM e GROUP BY station_code, event_id), w AS (SELECT station_code, year(lo) AS y0, year(hi) AS y1 FROM span_flow JOIN t USING (station_code)),
{tests_sql("pk", "w", "station_code")} SELECT station_code, u AS threshold_m3s, {_TESTED} FROM tests JOIN t USING (station_code)"""
)
def pot_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, thresholds = fixed_threshold(spark, sf_dir)
    return extremes.pot_tests(extremes.pot_events(grid, thresholds), grid, thresholds)


@query(
    f"""WITH {EVENTS}, y AS (SELECT station_code, unnest(range(year(lo), year(hi) + 1)) AS year FROM span_flow JOIN t USING (station_code)),
c AS (SELECT y.station_code, y.year, count(ev.event_id) AS n FROM y LEFT JOIN ev ON ev.station_code = y.station_code AND ev.year = y.year GROUP BY ALL), d AS (SELECT station_code, sum(n) AS n, count(*) AS years, CASE WHEN count(*) >= 5 AND sum(n) > 0 THEN var_samp(n) / avg(n) END AS di FROM c GROUP BY 1),
g AS (SELECT *, date_peak - lag(date_peak) OVER (PARTITION BY station_code ORDER BY date_peak) AS gap FROM ev), a AS (SELECT station_code, coalesce(min(gap) >= 7, true) AS apart FROM g GROUP BY 1)
SELECT station_code, CAST(n AS BIGINT) AS n_events, CASE WHEN n > 0 THEN round(n / years, 6) END AS lambda_observed, coalesce(apart, false) AS min_separation_ok, round(di, 6) AS dispersion_index, n >= 10 AND apart AS selection_ok FROM d LEFT JOIN a USING (station_code)"""
)
def pot_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the tests of peaks that SQL can express: separation, event rate and dispersion of the annual counts."""
    grid, thresholds = fixed_threshold(spark, sf_dir)
    return extremes.pot_tests(extremes.pot_events(grid, thresholds), grid, thresholds).select("station_code", "n_events", "lambda_observed", "min_separation_ok", "dispersion_index", "selection_ok")


@query(
    f"""WITH {FLOW},
v AS (SELECT station_code, list(q ORDER BY q) AS v, CAST(count(*) AS BIGINT) AS n FROM grid_flow WHERE q > 0 GROUP BY 1 HAVING count(*) >= 30),
gp AS (SELECT *, (0.50 + 0.495 * g / 69) * (n + 1.0 / 3) + 1.0 / 3 AS pos FROM v, range(0, 70) r(g)),
gi AS (SELECT *, least(greatest(CAST(floor(pos + 4e-16) AS BIGINT), 1), n) AS i FROM gp),
u AS (SELECT DISTINCT station_code, v[i] + least(greatest(pos - i, 0.0), 1.0) * (v[least(i + 1, n)] - v[i]) AS u FROM gi),
o AS (SELECT g.station_code, u, date, lag(date) OVER (PARTITION BY g.station_code, u ORDER BY date) AS prior FROM grid_flow g JOIN u USING (station_code) WHERE q > 0 AND q > u),
oc AS (SELECT station_code, u, count(*) FILTER (WHERE prior IS NULL OR date - prior > 7) AS n_events FROM o GROUP BY ALL),
lt AS (SELECT oc.station_code, CAST(k AS DOUBLE) / 2 + 1 AS lambda_target, u, n_events, n_events >= ceil((CAST(k AS DOUBLE) / 2 + 1) * ((hi - lo + 1) / 365.25)) AS enough FROM oc JOIN span_flow USING (station_code), range(0, 9) r(k)),
tg AS (SELECT station_code, lambda_target, u FROM lt QUALIFY row_number() OVER (PARTITION BY station_code, lambda_target ORDER BY enough DESC, CASE WHEN enough THEN -u ELSE -n_events END, -u) = 1),
te AS (SELECT g.station_code, lambda_target, date, q, lag(date) OVER (PARTITION BY g.station_code, lambda_target ORDER BY date) AS prior FROM grid_flow g JOIN tg USING (station_code) WHERE q > 0 AND q > u),
tn AS (SELECT *, sum(CASE WHEN prior IS NULL OR date - prior > 7 THEN 1 ELSE 0 END) OVER (PARTITION BY station_code, lambda_target ORDER BY date) AS event_id FROM te),
pk AS (SELECT station_code, lambda_target, arg_min(date, struct_pack(a := -q, b := date)) AS date_peak, max(q) AS q FROM tn GROUP BY station_code, lambda_target, event_id),
w AS (SELECT station_code, lambda_target, year(lo) AS y0, year(hi) AS y1 FROM tg JOIN span_flow USING (station_code)),
{tests_sql("pk", "w", "station_code, lambda_target")},
ra AS (SELECT tests.* EXCLUDE (selection_ok, hypotheses_ok), u AS threshold_m3s, coalesce(lambda_observed >= lambda_target * 0.85, false) AS reached_target_lambda, selection_ok AND coalesce(lambda_observed >= lambda_target * 0.85, false) AS selection_ok, hypotheses_ok AND coalesce(lambda_observed >= lambda_target * 0.85, false) AS hypotheses_ok FROM tests JOIN tg USING (station_code, lambda_target)),
rb AS (SELECT *, bool_and(selection_ok) OVER (PARTITION BY station_code ORDER BY lambda_target) AS accepted_initial_block FROM ra)
SELECT station_code, lambda_target, round(threshold_m3s, 6) AS threshold_m3s, {_TESTED}, reached_target_lambda, accepted_initial_block, coalesce(lambda_target = max(lambda_target) FILTER (WHERE accepted_initial_block) OVER (PARTITION BY station_code), false) AS selected FROM rb"""
)
def pot_automatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extremes.automatic_threshold(flow_grid(spark, sf_dir))


MATCH = f"""{merged_sql("flow")}, {merged_sql("stage")},
qh AS (SELECT station_code, date, a.value AS q, b.value AS h FROM daily_flow a FULL JOIN daily_stage b USING (station_code, date)),
sp AS (SELECT station_code, min(date) AS lo, max(date) AS hi FROM qh GROUP BY 1),
d AS (SELECT s.station_code, CAST(g.d AS DATE) AS date, q, h FROM sp s, LATERAL (SELECT unnest(generate_series(s.lo::TIMESTAMP, s.hi::TIMESTAMP, INTERVAL 1 DAY)) AS d) g LEFT JOIN qh ON qh.station_code = s.station_code AND qh.date = CAST(g.d AS DATE)),
{cte("rating_curves")},
cand AS (
    SELECT d.*, c.* EXCLUDE (station_code), coalesce(h BETWEEN stage_min_cm AND stage_max_cm, false) AS app, CASE WHEN h / 100 - coefficient_h0 > 0 THEN coefficient_a * pow(h / 100 - coefficient_h0, coefficient_n) END AS g
    FROM d JOIN rating_curves c ON c.station_code = d.station_code AND (valid_from IS NULL OR date >= valid_from) AND (valid_to IS NULL OR date <= valid_to)
),
cnt AS (
    SELECT station_code, date, count(DISTINCT rating_curve_segment_id) AS n1, count(DISTINCT rating_curve_id) AS n2, count(DISTINCT rating_curve_segment_id) FILTER (WHERE app) AS n3, count(DISTINCT rating_curve_id) FILTER (WHERE app) AS n4, min(stage_min_cm) AS lo, max(stage_max_cm) AS hi FROM cand GROUP BY ALL
),
bst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_code, date ORDER BY valid_from DESC NULLS LAST, rating_curve_id, segment_number, rating_curve_segment_id) AS rn FROM cand WHERE app) WHERE rn = 1),
bnd AS (SELECT station_code, min(valid_from) AS first_start, CASE WHEN count(*) = count(valid_to) THEN max(valid_to) END AS last_end FROM rating_curves GROUP BY 1),
m0 AS (
    SELECT d.station_code, d.date, d.q, d.h, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, coalesce(n3, 0) AS n3, coalesce(n4, 0) AS n4, b.rating_curve_id, b.rating_curve_segment_id, b.g,
           coalesce(d.h < lo, false) AS below, coalesce(d.h > hi, false) AS above, coalesce(d.q IS NOT NULL AND d.date < first_start, false) AS early, coalesce(d.q IS NOT NULL AND d.date > last_end, false) AS late
    FROM d LEFT JOIN cnt USING (station_code, date) LEFT JOIN bst b ON b.station_code = d.station_code AND b.date = d.date LEFT JOIN bnd ON bnd.station_code = d.station_code
),
m AS (SELECT *, n3 > 0 AND (g IS NULL OR g <= 0) AS gen_error, CASE WHEN q > 0 AND g > 0 THEN (g - q) / q END AS err FROM m0)"""


@query(
    f"""WITH {MATCH}
SELECT station_code, date, round(q, 6) AS discharge_m3s, round(h, 6) AS stage_cm, n1 AS n_valid_date_curve_segments, n2 AS n_valid_date_rating_curves, n3 AS n_applicable_curve_segments, n4 AS n_applicable_rating_curves, rating_curve_id, rating_curve_segment_id, round(g, 6) AS q_generated_m3s, gen_error AS q_generation_error,
       below AS stage_below_curve_range, above AS stage_above_curve_range, below OR above OR (h IS NOT NULL AND n1 > 0 AND n3 = 0) AS stage_outside_curve_range, early AS discharge_before_first_curve, late AS discharge_after_last_curve, h IS NOT NULL AND n3 > 1 AS ambiguous_curve_day, round(err, 6) AS relative_error FROM m"""
)
def curve_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matched_days(spark, sf_dir)
    return rows.select("station_code", "date", "discharge_m3s", "stage_cm", "n_valid_date_curve_segments", "n_valid_date_rating_curves", "n_applicable_curve_segments", "n_applicable_rating_curves", "rating_curve_id", "rating_curve_segment_id", "q_generated_m3s", "q_generation_error", "stage_below_curve_range", "stage_above_curve_range", "stage_outside_curve_range", "discharge_before_first_curve", "discharge_after_last_curve", "ambiguous_curve_day", "relative_error")


_RULES = {
    "vazao_sem_cota": "q IS NOT NULL AND h IS NULL", "cota_sem_vazao": "h IS NOT NULL AND q IS NULL", "falha_vazao": "q IS NULL", "falha_cota": "h IS NULL", "falha_simultanea_cota_vazao": "q IS NULL AND h IS NULL", "vazao_sem_curva_valida": "q IS NOT NULL AND n1 = 0",
    "vazao_antes_primeira_curva": "early", "vazao_apos_ultima_curva": "late", "cota_abaixo_faixa_curva": "below", "cota_acima_faixa_curva": "above", "curvas_ambiguas": "h IS NOT NULL AND n3 > 1", "erro_geracao_q": "gen_error",
    "diferenca_q_gt_5": "abs(err) > 0.05", "diferenca_q_gt_10": "abs(err) > 0.10", "diferenca_q_gt_25": "abs(err) > 0.25", "vazao_menor_igual_zero": "q <= 0", "cota_menor_igual_zero": "h <= 0",
}
_UNION = " UNION ALL ".join(f"SELECT station_code, date, '{code}' AS code FROM m WHERE {rule}" for code, rule in _RULES.items())


@query(f"WITH {MATCH} {_UNION}")
def issue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.issue_report(matched_days(spark, sf_dir)).select("station_code", "date", "code")


@query(f"WITH {MATCH}, u AS ({_UNION}) SELECT station_code, code, count(*) AS n FROM u GROUP BY ALL")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issue_report(spark, sf_dir).groupBy("station_code", "code").agg(F.count("*").alias("n"))


@query(
    f"""WITH {MATCH},
r AS (SELECT station_code, date - CAST(row_number() OVER (PARTITION BY station_code ORDER BY date) AS INT) AS k FROM m WHERE q IS NULL),
l AS (SELECT station_code, max(n) AS n FROM (SELECT station_code, k, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1)
SELECT station_code, count(*) AS n_days, count(q) AS n_has_discharge, count(h) AS n_has_stage, count(*) FILTER (WHERE n1 > 0) AS n_has_valid_date_curve, count(*) FILTER (WHERE q IS NOT NULL AND h IS NOT NULL AND n3 > 0) AS n_complete_hq_curve_day, round(100.0 * count(q) / count(*), 6) AS pct_has_discharge, coalesce(any_value(l.n), 0) AS longest_gap_days
FROM m LEFT JOIN l USING (station_code) GROUP BY 1"""
)
def coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curves.coverage(matched_days(spark, sf_dir))
    return rows.select("station_code", "n_days", "n_has_discharge", "n_has_stage", "n_has_valid_date_curve", "n_complete_hq_curve_day", "pct_has_discharge", "longest_gap_days")


@query(
    f"""WITH {MATCH}
SELECT station_code, rating_curve_id, rating_curve_segment_id, count(*) AS n_match_days, count(g) AS n_generated, count(*) FILTER (WHERE gen_error) AS n_errors, count(err) AS n_compared, count(*) FILTER (WHERE abs(err) > 0.05) AS n_gt_5, count(*) FILTER (WHERE abs(err) > 0.25) AS n_gt_25,
       round(quantile_cont(abs(err), 0.5), 6) AS median_abs_error, round(quantile_cont(abs(err), 0.95), 6) AS p95_abs_error FROM m WHERE rating_curve_segment_id IS NOT NULL GROUP BY ALL"""
)
def curve_segment_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "rating_curves")
    rows = curves.segment_errors(matched_days(spark, sf_dir), c)
    return rows.select("station_code", "rating_curve_id", "rating_curve_segment_id", "n_match_days", "n_generated", "n_errors", "n_compared", "n_gt_5", "n_gt_25", "median_abs_error", "p95_abs_error")


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rainfall.rain_days(merged(spark, sf_dir, "rain"))


def _runs(flag: str, name: str) -> str:
    return f"(SELECT station_code, year, max(n) AS {name} FROM (SELECT station_code, year, k, count(*) AS n FROM (SELECT station_code, year, date - CAST(row_number() OVER (PARTITION BY station_code, year ORDER BY date) AS INT) AS k FROM rain WHERE {flag}) GROUP BY ALL) GROUP BY ALL)"


@query(
    f"""WITH {RAIN},
f AS (SELECT station_code, year, max(s) AS rx5 FROM (SELECT station_code, year, CASE WHEN count(v) OVER w = 5 THEN sum(v) OVER w END AS s FROM rain WINDOW w AS (PARTITION BY station_code, year ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) GROUP BY ALL),
a AS (
    SELECT station_code, year, count(*) AS days_expected, count(v) AS valid_days, count(*) - count(r) AS missing_days, coalesce(sum(v), 0) AS total, count(*) FILTER (WHERE wet) AS wet_days, count(*) FILTER (WHERE dry) AS dry_days, count(*) FILTER (WHERE r < 0) AS negative_days, max(v) AS rx1,
           count(*) FILTER (WHERE v >= 10) AS r10mm_days, count(*) FILTER (WHERE v >= 20) AS r20mm_days, count(*) FILTER (WHERE v >= 50) AS r50mm_days FROM rain GROUP BY ALL
)
SELECT station_code, year, days_expected, valid_days, missing_days, round(total, 6) AS total_mm, wet_days, dry_days, negative_days, round(rx1, 6) AS rx1day_mm, round(rx5, 6) AS rx5day_mm, r10mm_days, r20mm_days, r50mm_days, round(total / nullif(wet_days, 0), 6) AS sdii_mm_per_wet_day,
       coalesce(cdd, 0) AS cdd_days, coalesce(cwd, 0) AS cwd_days, round(100.0 * missing_days / days_expected, 6) AS failure_pct
FROM a LEFT JOIN f USING (station_code, year) LEFT JOIN {_runs("dry", "cdd")} USING (station_code, year) LEFT JOIN {_runs("wet", "cwd")} USING (station_code, year)"""
)
def rain_annual_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rainfall.annual_indices(rain(spark, sf_dir))


@query(f"WITH {RAIN} SELECT station_code, year, month, count(*) AS days_expected, count(v) AS valid_days, count(*) - count(r) AS missing_days, round(coalesce(sum(v), 0), 6) AS total_mm, count(*) FILTER (WHERE wet) AS wet_days, round(max(v), 6) AS rx1day_mm, round(100.0 * (count(*) - count(r)) / count(*), 6) AS failure_pct FROM rain GROUP BY ALL")
def rain_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rainfall.monthly_totals(rain(spark, sf_dir))


RAIN_RUNS = (
    RAIN
    + """,
k AS (SELECT *, CASE WHEN v > 0 THEN round(v, 1) WHEN v = 0 THEN 0 END AS key FROM rain),
c AS (SELECT *, CASE WHEN key IS NOT NULL AND key = lag(key) OVER (PARTITION BY station_code ORDER BY date) THEN 0 ELSE 1 END AS new FROM k),
s AS (SELECT *, sum(new) OVER (PARTITION BY station_code ORDER BY date) AS run FROM c),
n AS (SELECT *, count(*) OVER (PARTITION BY station_code, run) AS len FROM s)"""
)


@query(f"WITH {RAIN_RUNS} SELECT station_code, date, CASE WHEN key = 0 THEN 'zero_run' ELSE 'repeated' END AS code, len AS run_length FROM n WHERE (key = 0 AND len >= 30) OR (key > 0 AND len >= 3)")
def rain_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rainfall.rain_issues(rain(spark, sf_dir)).where(F.col("code").isin("zero_run", "repeated"))
    return rows.select("station_code", "date", "code", F.when(F.col("code") == "zero_run", F.col("zero_run")).otherwise(F.col("value_run")).alias("run_length"))


@query(
    f"""WITH {RAIN_RUNS},
q AS (SELECT station_code, count(*) AS n, quantile_cont(log10(v), 0.25) AS q1, quantile_cont(log10(v), 0.75) AS q3 FROM rain WHERE v > 0 GROUP BY 1)
SELECT station_code, date, 'missing' AS code FROM n WHERE r IS NULL UNION ALL SELECT station_code, date, 'negative' FROM n WHERE r < 0 UNION ALL SELECT station_code, date, 'duplicate' FROM n WHERE same > 1 UNION ALL SELECT station_code, date, 'very_high' FROM n WHERE v >= 400
UNION ALL SELECT n.station_code, date, 'outlier' FROM n JOIN q ON q.station_code = n.station_code WHERE v > 0 AND q.n >= 10 AND log10(v) > q3 + 3 * (q3 - q1) UNION ALL SELECT station_code, date, 'zero_run' FROM n WHERE key = 0 AND len >= 30 UNION ALL SELECT station_code, date, 'repeated' FROM n WHERE key > 0 AND len >= 3"""
)
def rain_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rainfall.rain_issues(rain(spark, sf_dir)).select("station_code", "date", "code")


@query(
    f"""WITH {RAIN},
y AS (SELECT station_code, hy, min(date) AS d0, max(date) AS d1, count(*) AS n, count(v) AS valid_days, count(*) - count(r) AS missing_days, count(*) FILTER (WHERE r < 0) AS negative_days, max(v) AS p FROM rain GROUP BY ALL),
t AS (SELECT rain.station_code, rain.hy, count(*) AS ties, min(date) AS date_end FROM rain JOIN y USING (station_code, hy) WHERE v = p GROUP BY ALL),
q AS (SELECT station_code, count(*) AS k, quantile_cont(log10(p), 0.25) AS q1, quantile_cont(log10(p), 0.75) AS q3 FROM y WHERE p > 0 GROUP BY 1),
f AS (
    SELECT y.*, t.ties, t.date_end, valid_days / n < 0.8 AS f1, d0 > make_date(hy - 1, 10, 1) OR d1 < make_date(hy, 9, 30) AS f2, coalesce(p <= 0, false) AS f4, negative_days > 0 AS f5, coalesce(ties > 1, false) AS f7,
           coalesce(p > 0 AND k >= 4 AND log10(p) > q3 + 3 * (q3 - q1), false) AS f8, coalesce(p > 0 AND k >= 4 AND log10(p) < q1 - 3 * (q3 - q1), false) AS f9, p IS NOT NULL AND count(*) OVER (PARTITION BY y.station_code, round(p, 1)) > 1 AS f10
    FROM y LEFT JOIN t USING (station_code, hy) LEFT JOIN q USING (station_code)
),
g AS (SELECT *, f9 AND (f1 OR f2) AS f11 FROM f),
z AS (
    SELECT *, 2 * f1::INT + f2::INT + f4::INT + f5::INT + f7::INT + f8::INT + f9::INT + f10::INT + f11::INT AS n_flags, concat_ws('; ', CASE WHEN f1 THEN 'Poucos dias válidos' END, CASE WHEN f2 THEN 'Ano hidrológico parcial' END, CASE WHEN f1 THEN 'Poucas janelas válidas' END, CASE WHEN f4 THEN 'Máximo igual a zero' END,
        CASE WHEN f5 THEN 'Valor negativo no ano' END, CASE WHEN f7 THEN 'Empate no ano' END, CASE WHEN f8 THEN 'Possível outlier alto' END, CASE WHEN f9 THEN 'Possível outlier baixo' END, CASE WHEN f10 THEN 'Máximo repetido entre anos' END, CASE WHEN f11 THEN 'Possível máximo subestimado' END) AS r FROM g
)
SELECT station_code, hy AS hydrological_year, n AS days_expected_in_session, valid_days, missing_days, negative_days, round(p, 6) AS p_max_mm, coalesce(ties, 0) AS n_tied_max_windows, date_end, CAST(n_flags AS BIGINT) AS n_flags, CASE WHEN r = '' THEN 'Sem flags' ELSE r END AS flags_resumo,
       CASE WHEN n_flags = 0 THEN 'Sem flags' WHEN n_flags <= 2 THEN 'Atenção baixa' WHEN n_flags <= 4 THEN 'Atenção moderada' ELSE 'Atenção alta' END AS nivel_atencao FROM z"""
)
def rain_annual_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rainfall.rain_maxima(rain(spark, sf_dir)).fillna(0, ["n_tied_max_windows"])
    return rows.select("station_code", "hydrological_year", "days_expected_in_session", "valid_days", "missing_days", "negative_days", "p_max_mm", "n_tied_max_windows", "date_end", "n_flags", "flags_resumo", "nivel_atencao")


FLAGS = f"""{cte("measurements")},
sg AS (SELECT station_code, round_even(stage_cm, 2) AS g, count(*) AS n, max(discharge_m3s) - min(discharge_m3s) AS s, quantile_cont(discharge_m3s, 0.5) AS med FROM measurements GROUP BY ALL),
qg AS (SELECT station_code, round_even(discharge_m3s, 3) AS g, count(*) AS n, max(stage_cm) - min(stage_cm) AS s FROM measurements GROUP BY ALL),
fl AS (
    SELECT m.*, stage_cm <= 0 AS f1, discharge_m3s <= 0 AS f2, coalesce(sg.n >= 5 AND sg.s >= 0.1 AND sg.s / nullif(abs(med), 0) >= 0.1, false) AS f3, qg.n >= 5 AND qg.s >= 5 AS f4
    FROM measurements m JOIN sg ON sg.station_code = m.station_code AND sg.g = round_even(stage_cm, 2) JOIN qg ON qg.station_code = m.station_code AND qg.g = round_even(discharge_m3s, 3)
)"""


@query(f"WITH {FLAGS} SELECT station_code, measurement_id, f1 AS stage_zero_flag, f2 AS discharge_zero_flag, f3 AS repeated_stage_flag, f4 AS repeated_discharge_flag, f1 OR f2 OR f3 OR f4 AS any_attention_flag FROM fl")
def measurement_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.measurement_flags(view(spark, sf_dir, "measurements")).select("station_code", "measurement_id", "stage_zero_flag", "discharge_zero_flag", "repeated_stage_flag", "repeated_discharge_flag", "any_attention_flag")


@query(f"WITH {FLAGS} SELECT station_code, g AS stage_group, n AS n_repeated_stage_group, round(s, 6) AS discharge_spread, round(med, 6) AS discharge_median FROM sg")
def repeated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.repeated_groups(view(spark, sf_dir, "measurements"))[0].select("station_code", "stage_group", "n_repeated_stage_group", "discharge_spread", "discharge_median")


@query(
    f"""WITH {cte("rating_curves")}, p AS (SELECT DISTINCT station_code, rating_curve_id, valid_from AS lo, coalesce(valid_to, DATE '9999-12-31') AS hi FROM rating_curves WHERE valid_from IS NOT NULL),
n AS (SELECT *, row_number() OVER () AS i FROM p)
SELECT s.station_code, count(a.i) AS n_overlapping_pairs FROM (SELECT DISTINCT station_code FROM rating_curves) s LEFT JOIN (n a JOIN n b ON a.station_code = b.station_code AND a.i < b.i AND b.lo <= a.hi AND b.hi >= a.lo) ON a.station_code = s.station_code GROUP BY 1"""
)
def curve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.overlap_pairs(view(spark, sf_dir, "rating_curves"))


BEST = f"""{cte("measurements")}, {cte("rating_curves")},
pr AS (
    SELECT m.station_code, measurement_id, rating_curve_id, rating_curve_segment_id, ln(discharge_m3s) - ln(coefficient_a * pow(stage_cm / 100 - coefficient_h0, coefficient_n)) AS r
    FROM measurements m JOIN rating_curves c ON c.station_code = m.station_code AND measurement_date BETWEEN valid_from AND coalesce(valid_to, DATE '{AS_OF}') AND stage_cm BETWEEN stage_min_cm AND stage_max_cm
    WHERE stage_cm > 0 AND discharge_m3s > 0 AND stage_cm / 100 - coefficient_h0 > 0
),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY measurement_id ORDER BY abs(r), rating_curve_segment_id) AS rn FROM pr) WHERE rn = 1),
env AS (SELECT station_code, rating_curve_id, rating_curve_segment_id, count(*) AS n, avg(r) AS mean_r, quantile_cont(r, 0.5) AS med_r, CASE WHEN count(*) >= 2 THEN stddev_samp(r) END AS sd_r, quantile_cont(abs(r), 0.5) AS med_abs FROM best GROUP BY ALL)"""


def matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = view(spark, sf_dir, "measurements").select("station_code", "measurement_id", "measurement_date", "stage_cm", "discharge_m3s")
    best = curves.nearest_matches(m, view(spark, sf_dir, "rating_curves"), AS_OF)
    return best, curves.residual_envelopes(best)


@query(
    f"""WITH {BEST}
SELECT station_code, rating_curve_id, rating_curve_segment_id, n AS n_residual_points, round(mean_r, 6) AS mean_log_residual, round(med_r, 6) AS median_log_residual, round(sd_r, 6) AS sd_log_residual, round(med_abs, 6) AS median_abs_log_residual, round(mean_r - 1.96 * sd_r, 6) AS envelope_lower, round(mean_r + 1.96 * sd_r, 6) AS envelope_upper,
       n >= 5 AND sd_r IS NOT NULL AS has_residual_envelope FROM env"""
)
def residual_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir)[1]


POWER = f"""{cte("measurements")},
pm AS (SELECT station_code, measurement_id, stage_cm / 100 AS h, ln(discharge_m3s) AS lq FROM measurements WHERE stage_cm > 0 AND discharge_m3s > 0),
ps AS (SELECT station_code, min(h) AS lo, max(h) AS hi FROM pm GROUP BY 1 HAVING count(*) >= 30 AND count(DISTINCT h) >= 3),
pg AS (SELECT station_code, i, lo - least(greatest(1.0, 2.0 * (hi - lo)), 20.0) + i * ((lo - 0.005) - (lo - least(greatest(1.0, 2.0 * (hi - lo)), 20.0))) / 39 AS h0 FROM ps, range(0, 40) r(i)),
px AS (SELECT pm.*, i, h0, ln(h - h0) AS lh FROM pm JOIN pg USING (station_code)),
pf AS (SELECT station_code, i, any_value(h0) AS h0, count(*) AS n, regr_slope(lq, lh) AS b, regr_intercept(lq, lh) AS a FROM px GROUP BY ALL HAVING regr_slope(lq, lh) > 0.05 AND regr_slope(lq, lh) <= 10),
pr AS (SELECT px.station_code, px.i, lq - a - b * lh AS r FROM px JOIN pf USING (station_code, i)),
pd AS (SELECT station_code, i, quantile_cont(r, 0.5) AS med, quantile_cont(abs(r), 0.5) AS mar FROM pr GROUP BY ALL),
pe AS (SELECT pr.*, abs(r - med) AS d, mar FROM pr JOIN pd USING (station_code, i)),
pc AS (SELECT station_code, i, CASE WHEN quantile_cont(d, 0.9) > 0 THEN quantile_cont(d, 0.9) ELSE max(d) END AS cap FROM pe GROUP BY ALL),
pz AS (SELECT station_code, i, sum(pow(least(d, cap), 2)) AS sse, any_value(mar) AS mar FROM pe JOIN pc USING (station_code, i) GROUP BY ALL)"""


@query(f"WITH {POWER} SELECT station_code, i AS h0_index, round(h0, 6) AS h0_m, n AS n_model_points, round(b, 6) AS coefficient_b, round(exp(a), 6) AS coefficient_a, round(sse, 6) AS robust_sse, round(mar, 6) AS median_abs_log_residual FROM pf JOIN pz USING (station_code, i)")
def power_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.power_fits(view(spark, sf_dir, "measurements")).select("station_code", "h0_index", "h0_m", "n_model_points", "coefficient_b", "coefficient_a", "robust_sse", "median_abs_log_residual")


@query(f"WITH {POWER} SELECT station_code, h0_index, round(h0, 6) AS h0_m FROM (SELECT station_code, i AS h0_index, h0, row_number() OVER (PARTITION BY station_code ORDER BY sse, mar, abs(h0)) AS rn FROM pf JOIN pz USING (station_code, i)) WHERE rn = 1")
def power_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.power_baseline(view(spark, sf_dir, "measurements")).select("station_code", "h0_index", "h0_m")


@query()
def temporal_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "measurements")
    return diagnostics.temporal_regimes(diagnostics.power_residuals(m, diagnostics.power_baseline(m)))


SUMMARY = f"""{FLAGS}, {BEST.removeprefix(cte("measurements") + ", ")},
bo AS (SELECT b.*, coalesce(e.n >= 5 AND sd_r IS NOT NULL AND (r < mean_r - 1.96 * sd_r OR r > mean_r + 1.96 * sd_r), false) AS outside FROM best b LEFT JOIN env e USING (rating_curve_segment_id)),
f AS (SELECT station_code, count(*) AS n, count(*) FILTER (WHERE stage_cm > 0 AND discharge_m3s > 0) AS nv, count(*) FILTER (WHERE f1) AS n1, count(*) FILTER (WHERE f2) AS n2, count(*) FILTER (WHERE f3) AS n3, count(*) FILTER (WHERE f4) AS n4 FROM fl GROUP BY 1),
c AS (SELECT station_code, count(DISTINCT rating_curve_id) AS nc, count(DISTINCT rating_curve_segment_id) AS ns FROM rating_curves GROUP BY 1),
bm AS (SELECT station_code, count(*) AS nm, quantile_cont(abs(r), 0.5) AS mar, avg(outside::INT) AS ofr FROM bo GROUP BY 1),
s AS (SELECT station_code, coalesce(n, 0) AS n, coalesce(nv, 0) AS nv, n1, n2, n3, n4, coalesce(nc, 0) AS nc, coalesce(ns, 0) AS ns, coalesce(nm, 0) AS nm, mar, ofr FROM f FULL JOIN c USING (station_code) LEFT JOIN bm USING (station_code)),
z AS (
    SELECT *, nm / nullif(nv, 0) AS mfr, (n1 / nullif(n, 0) >= 0.05)::INT + (n2 / nullif(n, 0) >= 0.05)::INT + (n3 / nullif(n, 0) >= 0.15)::INT + (n4 / nullif(n, 0) >= 0.15)::INT + coalesce(nm / nullif(nv, 0) < 0.6, false)::INT + coalesce(mar >= 0.25, false)::INT + coalesce(ofr >= 0.15, false)::INT AS score FROM s
)"""


@query(
    f"""WITH {SUMMARY}
SELECT station_code, n AS n_measurements, nv AS n_valid_measurements, nc AS n_rating_curves, ns AS n_rating_curve_segments, round(mfr, 6) AS rating_match_fraction, round(mar, 6) AS median_abs_rating_log_residual, round(ofr, 6) AS outside_envelope_fraction, CAST(score AS BIGINT) AS diagnostic_attention_score,
       CASE WHEN score <= 1 THEN 'low_attention' WHEN score <= 3 THEN 'moderate_attention' ELSE 'high_attention' END AS diagnostic_attention_class FROM z"""
)
def diagnostic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, envelopes = matched(spark, sf_dir)
    rows = diagnostics.diagnostic_summary(diagnostics.measurement_flags(view(spark, sf_dir, "measurements")), view(spark, sf_dir, "rating_curves"), curves.envelope_flags(best, envelopes))
    return rows.select("station_code", "n_measurements", "n_valid_measurements", "n_rating_curves", "n_rating_curve_segments", "rating_match_fraction", "median_abs_rating_log_residual", "outside_envelope_fraction", "diagnostic_attention_score", "diagnostic_attention_class")


@query()
def diagnostic_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "measurements")
    best, envelopes = matched(spark, sf_dir)
    regimes = diagnostics.temporal_regimes(diagnostics.power_residuals(m, diagnostics.power_baseline(m)))
    return diagnostics.diagnostic_indices(diagnostics.diagnostic_summary(diagnostics.measurement_flags(m), view(spark, sf_dir, "rating_curves"), curves.envelope_flags(best, envelopes), regimes))


CLEAN = f"""{cte("measurements")},
k AS (SELECT *, max((consistency_level = 2)::INT) OVER (PARTITION BY station_code, measurement_datetime) AS two, row_number() OVER (PARTITION BY station_code, measurement_datetime, consistency_level ORDER BY last_update DESC NULLS LAST, measurement_id) AS rn FROM measurements),
cl AS (SELECT *, CASE WHEN two = 1 AND consistency_level <> 2 THEN 'lower_consistency_level' WHEN rn > 1 THEN 'older_duplicate' END AS reason FROM k)"""


@query(f"WITH {CLEAN} SELECT station_code, measurement_datetime, CAST(consistency_level AS BIGINT) AS consistency_level, measurement_id FROM cl WHERE reason IS NULL")
def clean_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = cleaning.split_ledger(cleaning.clean_measurements(view(spark, sf_dir, "measurements")))
    return kept.select("station_code", "measurement_datetime", "consistency_level", "measurement_id")


@query(f"WITH {CLEAN} SELECT station_code, measurement_id, reason AS removed_reason FROM cl WHERE reason IS NOT NULL")
def removed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.split_ledger(cleaning.clean_measurements(view(spark, sf_dir, "measurements")))[1].select("station_code", "measurement_id", "removed_reason")


@query(f"WITH {cte('rating_curves')}, c AS (SELECT *, CAST(regexp_extract(segment_number_raw, '^(\\d+)', 1) AS BIGINT) AS sn, CAST(nullif(regexp_extract(segment_number_raw, '/(\\d+)$', 1), '') AS BIGINT) AS nr FROM rating_curves) SELECT station_code, rating_curve_id, min(valid_from) AS valid_from, max(valid_to) AS valid_to, count(*) AS n_segments, count(DISTINCT sn) AS n_distinct_segment_numbers, max(nr) AS n_segments_reported_max, min(stage_min_cm) AS stage_min_cm, max(stage_max_cm) AS stage_max_cm FROM c GROUP BY ALL")
def curve_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.curve_summary(cleaning.curve_segments(view(spark, sf_dir, "rating_curves")))


@query(
    f"""WITH {cte("vertices")}
SELECT station_code, cross_section_id, count(*) AS n_vertices, round(min(vertex_distance_m), 6) AS vertex_distance_min_m, round(max(vertex_distance_m), 6) AS vertex_distance_max_m, round(min(vertex_stage_cm), 6) AS vertex_stage_min_cm, round(max(vertex_stage_cm), 6) AS vertex_stage_max_cm,
       count(*) - count(vertex_distance_m) AS n_missing_vertex_distance, count(*) - count(vertex_stage_cm) AS n_missing_vertex_stage FROM vertices GROUP BY ALL"""
)
def section_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.section_summary(cleaning.number_vertices(view(spark, sf_dir, "vertices"), ["vertex_key"]))


@query(f"WITH {cte('vertices')} SELECT cross_section_id, vertex_key, row_number() OVER (PARTITION BY cross_section_id ORDER BY vertex_distance_m NULLS LAST, vertex_key) AS vertex_order FROM vertices")
def section_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.number_vertices(view(spark, sf_dir, "vertices"), ["vertex_key"]).select("cross_section_id", "vertex_key", "vertex_order")


WINDOWS = f"""{cte("request_log")},
w AS (SELECT station_code, route_name, date_start, count(*) AS n_attempts, bool_or(success) AS ok, arg_max(success, row_id) AS last_ok, arg_max(http_status, row_id) AS last_status FROM request_log GROUP BY ALL),
r AS (SELECT station_code, route_name, count(*) AS n_windows, count(*) FILTER (WHERE ok) AS n_ok, sum(n_attempts) AS n_attempts FROM w GROUP BY ALL),
rs AS (SELECT *, CASE WHEN n_ok = n_windows THEN 'completed' WHEN n_ok > 0 THEN 'partial' ELSE 'failed' END AS status FROM r)"""


@query(f"WITH {WINDOWS} SELECT station_code, route_name, n_windows, n_ok AS n_success_windows, CAST(n_attempts AS BIGINT) AS n_attempts, status FROM rs")
def request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.route_status(cleaning.window_status(view(spark, sf_dir, "request_log")))


@query(f"WITH {WINDOWS} SELECT station_code, count(*) AS n_routes, count(*) FILTER (WHERE status = 'completed') AS n_completed_routes, count(*) FILTER (WHERE status = 'failed') AS n_failed_routes, CAST(sum(n_windows) AS BIGINT) AS n_windows, CASE WHEN count(*) FILTER (WHERE status = 'completed') = count(*) THEN 'completed' WHEN count(*) FILTER (WHERE status = 'failed') = count(*) THEN 'failed' ELSE 'partial' END AS status FROM rs GROUP BY 1")
def station_request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.station_status(cleaning.route_status(cleaning.window_status(view(spark, sf_dir, "request_log"))))


@query(f"WITH {WINDOWS} SELECT station_code, route_name, date_start, n_attempts, round(last_status, 6) AS last_http_status FROM w WHERE NOT ok")
def retry_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.retry_candidates(cleaning.window_status(view(spark, sf_dir, "request_log")))


STATION_SUMMARY = f"""{cte("measurements")},
ms AS (SELECT station_code, count(*) AS n, min(measurement_datetime) AS t0, max(measurement_datetime) AS t1, count(DISTINCT year(measurement_datetime)) AS years, count(stage_cm) AS nh, count(discharge_m3s) AS nq, count(*) FILTER (WHERE consistency_level = 1) AS l1, count(*) FILTER (WHERE consistency_level = 2) AS l2, min(stage_cm) AS h0, max(stage_cm) AS h1, avg(discharge_m3s) AS qm FROM measurements GROUP BY 1)"""


@query(f"WITH {STATION_SUMMARY} SELECT station_code, n AS n_measurements, t0 AS first_measurement, t1 AS last_measurement, years AS n_years_with_measurements, nh AS n_stage_values, nq AS n_discharge_values, l1 AS n_level_1, l2 AS n_level_2, h0 AS stage_min_cm, h1 AS stage_max_cm, round(qm, 6) AS discharge_mean_m3s FROM ms")
def station_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.measurement_summary(view(spark, sf_dir, "measurements"))


@query(f"WITH {cte('measurements')} SELECT station_code, year(measurement_datetime) AS year, count(*) AS n_measurements, count(DISTINCT measurement_date) AS n_dates, round(min(discharge_m3s), 6) AS discharge_min_m3s, round(max(discharge_m3s), 6) AS discharge_max_m3s, round(avg(discharge_m3s), 6) AS discharge_mean_m3s FROM measurements GROUP BY ALL")
def station_year_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.station_year_summary(view(spark, sf_dir, "measurements"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations with their basin, two small dimension joins."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("municipality"), "n_regionkey")
    region = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("basin_name"))
    return view(spark, sf_dir, "stations").join(nation, "nation_key", "left").join(region, "n_regionkey", "left").drop("nation_key", "n_regionkey")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "rating_curves")
    return quality_index.information_score(stations(spark, sf_dir), quality_index.measurement_indices(cleaning.measurement_summary(view(spark, sf_dir, "measurements"))), quality_index.curve_indices(c, curves.overlap_pairs(c)), quality_index.section_indices(cleaning.section_summary(view(spark, sf_dir, "vertices"))))


SCORES = f"""{STATION_SUMMARY}, {cte("rating_curves")}, {cte("vertices")}, {cte("stations")},
p AS (SELECT DISTINCT station_code, rating_curve_id, valid_from AS lo, coalesce(valid_to, DATE '9999-12-31') AS hi FROM rating_curves WHERE valid_from IS NOT NULL), pn AS (SELECT *, row_number() OVER () AS i FROM p),
ov AS (SELECT a.station_code, count(*) AS n FROM pn a JOIN pn b ON a.station_code = b.station_code AND a.i < b.i AND b.lo <= a.hi AND b.hi >= a.lo GROUP BY 1),
cu AS (SELECT station_code, count(DISTINCT rating_curve_id) AS k, count(*) AS segments FROM rating_curves GROUP BY 1), se AS (SELECT station_code, count(DISTINCT cross_section_id) AS k FROM vertices GROUP BY 1),
j AS (
    SELECT s.*, n_name, r_name, ms.n, ms.years, nh / ms.n AS ph, nq / ms.n AS pq, cu.k, cu.segments, coalesce(ov.n, 0) AS o, se.k AS sk FROM stations s LEFT JOIN nation ON n_nationkey = nation_key LEFT JOIN region ON r_regionkey = n_regionkey
    LEFT JOIN ms USING (station_code) LEFT JOIN cu USING (station_code) LEFT JOIN ov USING (station_code) LEFT JOIN se USING (station_code)
),
z AS (
    SELECT *, latitude IS NOT NULL AND longitude IS NOT NULL AS placed, (CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 10 ELSE 0 END) + (CASE WHEN station_name <> '' THEN 5 ELSE 0 END) + (CASE WHEN r_name IS NOT NULL THEN 5 ELSE 0 END) + (CASE WHEN n_name <> '' THEN 5 ELSE 0 END) + (CASE WHEN drainage_area > 0 THEN 10 ELSE 0 END)
        + (CASE WHEN n IS NULL THEN 0 WHEN n < 5 THEN 4 WHEN n < 20 THEN 8 WHEN n < 50 THEN 12 ELSE 15 END) + (CASE WHEN years IS NULL THEN 0 WHEN years < 3 THEN 3 WHEN years < 10 THEN 6 WHEN years < 20 THEN 8 ELSE 10 END)
        + (CASE WHEN ph >= 0.95 AND pq >= 0.95 THEN 10 WHEN ph >= 0.8 AND pq >= 0.8 THEN 7 WHEN ph > 0 AND pq > 0 THEN 4 ELSE 0 END) + (CASE WHEN k IS NULL THEN 0 WHEN k = 1 THEN 8 WHEN k < 5 THEN 10 ELSE 12 END)
        + (CASE WHEN segments IS NULL THEN 0 WHEN segments < 5 THEN 4 WHEN segments < 20 THEN 6 ELSE 8 END) + (CASE WHEN k IS NULL THEN 0 WHEN o = 0 THEN 5 WHEN o <= 5 THEN 3 ELSE 1 END) + (CASE WHEN sk IS NULL THEN 0 WHEN sk = 1 THEN 3 ELSE 5 END) AS score FROM j
)"""


@query(
    f"""WITH {SCORES}
SELECT station_code, CAST(score AS BIGINT) AS preliminary_information_score, CASE WHEN score >= 80 THEN 'high_information' WHEN score >= 60 THEN 'moderate_information' WHEN score >= 40 THEN 'limited_information' WHEN score >= 20 THEN 'basic_registration_or_sparse_products' ELSE 'registration_only_or_incomplete' END AS preliminary_information_class,
       CASE WHEN NOT placed THEN 'missing_coordinates' WHEN n > 0 AND k > 0 THEN 'measurements_and_rating_curves' WHEN n > 0 THEN 'measurements_only' WHEN k > 0 THEN 'rating_curves_only' ELSE 'registration_only' END AS map_status,
       CAST(CASE WHEN NOT placed THEN 5 WHEN n > 0 AND k > 0 THEN 1 WHEN n > 0 THEN 2 WHEN k > 0 THEN 3 ELSE 4 END AS BIGINT) AS map_priority FROM z"""
)
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("station_code", "preliminary_information_score", "preliminary_information_class", "map_status", "map_priority")


@query(f"WITH {SCORES} SELECT station_code, 'n_measurements' AS index_name, CAST(n AS DOUBLE) AS index_value, 10 AS display_order FROM z UNION ALL SELECT station_code, 'n_rating_curves', CAST(k AS DOUBLE), 20 FROM z UNION ALL SELECT station_code, 'n_cross_sections', CAST(sk AS DOUBLE), 30 FROM z UNION ALL SELECT station_code, 'preliminary_information_score', CAST(score AS DOUBLE), 40 FROM z")
def quality_indices_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_index.long_indices(scores(spark, sf_dir), ["n_measurements", "n_rating_curves", "n_cross_sections", "preliminary_information_score"])


def inventories(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.col("s_name").alias("station_name"), F.round("s_acctbal", 2).alias("altitude"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("station_code"))
    k = F.col("s_suppkey")
    # the conventional service also has the stations that neither other one has
    members = (("a:", k % 2 == 0), ("t:", k % 3 == 0), ("c:", (k % 5 == 0) | ((k % 2 != 0) & (k % 3 != 0))))
    return [s.where(member).select("station_code", F.concat(F.lit(p), "station_name").alias("station_name"), (F.col("altitude") + i).alias("altitude")) for i, (p, member) in enumerate(members)]


@query(
    """WITH s AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS station_code, s_suppkey AS k, s_name AS n, round(s_acctbal, 2) AS a FROM supplier), c AS (SELECT *, k % 5 = 0 OR (k % 2 <> 0 AND k % 3 <> 0) AS conventional FROM s)
SELECT station_code, CASE WHEN k % 2 = 0 THEN 'a:' || n WHEN k % 3 = 0 THEN 't:' || n ELSE 'c:' || n END AS station_name, round(CASE WHEN conventional THEN a + 2 WHEN k % 2 = 0 THEN a ELSE a + 1 END, 6) AS altitude, CASE WHEN k % 2 = 0 THEN 'api' WHEN k % 3 = 0 THEN 'ws_telemetric' ELSE 'ws_conventional' END AS source_route,
       k % 2 = 0 AS source_api, k % 3 = 0 AS source_ws_telemetric, conventional AS source_ws_conventional FROM c"""
)
def inventory_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.consolidate_inventories(*inventories(spark, sf_dir), temporal=["altitude"]).select("station_code", "station_name", "altitude", "source_route", "source_api", "source_ws_telemetric", "source_ws_conventional")


@query(
    f"""WITH {cte("measurements")}, {cte("rating_curves")}, {cte("stations")}
SELECT 'duplicate:measurements' AS "check", (SELECT count(*) FROM (SELECT 1 FROM measurements GROUP BY station_code, measurement_datetime, consistency_level HAVING count(*) > 1)) AS n_failures
UNION ALL SELECT 'link:curves', (SELECT count(*) FROM (SELECT DISTINCT station_code FROM rating_curves) c WHERE NOT EXISTS (SELECT 1 FROM stations s WHERE s.station_code = c.station_code))
UNION ALL SELECT 'null:curves', (SELECT count(*) FROM rating_curves WHERE valid_from IS NULL OR valid_to IS NULL)"""
)
def integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, c, s = (view(spark, sf_dir, n) for n in ("measurements", "rating_curves", "stations"))
    checks = [cleaning.duplicate_keys(m, ["station_code", "measurement_datetime", "consistency_level"], "measurements"), cleaning.unlinked_keys(c, s, ["station_code"], "curves"), cleaning.null_keys(c, ["valid_from", "valid_to"], "curves")]
    return reduce(DataFrame.union, checks)

