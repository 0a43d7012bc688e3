"""The registered queries over the driver's tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.operators import curves, daily, flow
from fluvia.plans.bindings import cte, view, wide_view
from fluvia.session import materialize, unsorted_parts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ORDINAL = ("o1", "o2", "o3", "o4")
#: Open-ended curves end here in the diagnostics.
AS_OF = "2002-01-01"


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name; its doubles are rounded to 6 decimals on both sides."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*(F.round(F.col(c), 6).alias(c) if kind == "double" else F.col(c).cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c) for c, kind in df.dtypes))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def merged(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return daily.merge_daily(view(spark, sf_dir, f"raw_{kind}"), ORDINAL)


def flow_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of all stations with their discharge, written once: most queries read them several times."""
    return materialize(daily.complete_grid(merged(spark, sf_dir, "flow").select("station_code", "date", F.col("value").alias("discharge_m3s"))), "flow-days")


HQ = {"raw_flow": "discharge_m3s", "raw_stage": "stage_cm"}
#: Bytes of records that one task merges and matches: these, or up to the second number where that keeps the shuffle unsorted. Sorted
#: records of 32 MB take less of a task's memory than the rows of a split of 128 MB, which a task that writes sorted would hold.
MATCH_PART = 1 << 20, 32 << 20


def hq(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Days with discharge and stage, merged in one pass over the records that have both; queries read them once, so they stay in the plan."""
    return daily.complete_grid(daily.merge_values(wide_view(spark, sf_dir, HQ), list(HQ.values()), ORDINAL, parts))


def matched_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with discharge and stage matched to the curves: records and curves are dealt by station once, over as many parts.

    A task holds the sorted records of one part and the stretches of its stations, no days.
    """
    records = wide_view(spark, sf_dir, HQ)
    parts = unsorted_parts(records, *MATCH_PART)
    rows = curves.with_gaps(daily.with_until(daily.merge_values(records, list(HQ.values()), ORDINAL, parts)))
    return curves.match_daily(rows, view(spark, sf_dir, "rating_curves"), parts, "until")


# SQL of the parts that queries share


def merged_sql(kind: str) -> str:
    """daily_<kind>: the merged series, by one sorted window (the library aggregates instead)."""
    return f"""{cte(f"raw_{kind}")},
r_{kind} AS (
    SELECT *, row_number() OVER (PARTITION BY station_code, date ORDER BY CASE consistency_level WHEN '2' THEN 0 WHEN '1' THEN 1 ELSE 2 END, (value IS NULL)::INT,
        CASE daily_flag WHEN '1' THEN 0 WHEN '0' THEN 1 ELSE 2 END, o1, o2, o3, o4, value) AS rn, count(*) OVER (PARTITION BY station_code, date) AS n_source_records,
        count(*) OVER (PARTITION BY station_code, date, consistency_level) AS nl FROM raw_{kind}
),
daily_{kind} AS (SELECT r.* EXCLUDE (rn, nl), m.max_same_consistency_records FROM r_{kind} r JOIN (SELECT station_code, date, max(nl) AS max_same_consistency_records FROM r_{kind} GROUP BY ALL) m USING (station_code, date) WHERE rn = 1)"""


def grid_sql(kind: str, value: str) -> str:
    return f"""{merged_sql(kind)},
span_{kind} AS (SELECT station_code, min(date) AS lo, max(date) AS hi FROM daily_{kind} GROUP BY 1),
grid_{kind} AS (
    SELECT s.station_code, CAST(g.d AS DATE) AS date, d.* EXCLUDE (station_code, date, value), d.value AS {value}
    FROM span_{kind} s, LATERAL (SELECT unnest(generate_series(s.lo::TIMESTAMP, s.hi::TIMESTAMP, INTERVAL 1 DAY)) AS d) g LEFT JOIN daily_{kind} d ON d.station_code = s.station_code AND d.date = CAST(g.d AS DATE)
)"""


FLOW = grid_sql("flow", "q")
RAIN = (
    grid_sql("rain", "r")
    + """,
rain AS (
    SELECT station_code, date, r, year(date) AS year, month(date) AS month, source_status, coalesce(max_same_consistency_records, 0) AS same,
           coalesce(r >= 0, false) AS ok, coalesce(r >= 1, false) AS wet, coalesce(r >= 0 AND r < 1, false) AS dry, CASE WHEN r >= 0 THEN r END AS v, year(date) + CASE WHEN month(date) >= 10 THEN 1 ELSE 0 END AS hy
    FROM grid_rain
)"""
)
MONTHLY = (
    FLOW
    + """,
monthly AS (
    SELECT station_code, year(date) AS year, month(date) AS month, count(*) AS days_in_period, count(q) AS days_with_value, count(*) - count(q) AS days_missing,
           100.0 * (count(*) - count(q)) / count(*) AS failure_pct, avg(q) AS q_mean, min(q) AS q_min, max(q) AS q_max FROM grid_flow GROUP BY ALL
),
annual AS (
    SELECT station_code, year(date) AS year, count(*) AS days_in_period, count(q) AS days_with_value, count(*) - count(q) AS days_missing,
           100.0 * (count(*) - count(q)) / count(*) AS failure_pct, avg(q) AS q_mean, min(q) AS q_min, max(q) AS q_max FROM grid_flow GROUP BY ALL
)"""
)
ROLLING = (
    MONTHLY
    + """,
rolling AS (
    SELECT a.station_code, a.year AS start_year, a.year + 4 AS end_year, avg(b.q_mean) AS q_mean_5yr, min(b.q_mean) AS q_min_annual, max(b.q_mean) AS q_max_annual
    FROM annual a JOIN annual b ON a.station_code = b.station_code AND b.year BETWEEN a.year AND a.year + 4 AND b.q_mean IS NOT NULL WHERE a.q_mean IS NOT NULL GROUP BY ALL HAVING count(*) = 5
),
dry AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY q_mean_5yr, start_year) AS rn FROM rolling) WHERE rn = 1),
volume AS (SELECT *, q_mean * days_in_period * 86400 / 1e6 AS volume_hm3 FROM monthly WHERE q_mean IS NOT NULL),
eligible AS (SELECT station_code FROM annual WHERE q_mean IS NOT NULL GROUP BY 1 HAVING count(DISTINCT year) >= 5)"""
)
FAILURE = "CASE WHEN {0} = 100 THEN '100%' WHEN {0} >= 75 THEN '75–<100%' WHEN {0} >= 50 THEN '50–<75%' WHEN {0} >= 25 THEN '25–<50%' WHEN {0} > 0 THEN '0–<25%' ELSE '0%' END"


@query(f"WITH {merged_sql('flow')} SELECT station_code, variable, date, round(value, 6) AS value, consistency_level, daily_flag, source_status, n_source_records, max_same_consistency_records, max_same_consistency_records > 1 AS has_duplicate_same_consistency FROM daily_flow")
def raw_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir, "flow")


@query(f"WITH {FLOW} SELECT station_code, date, round(q, 6) AS discharge_m3s FROM grid_flow")
def daily_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_grid(spark, sf_dir)


@query(
    f"""WITH {merged_sql("flow")},
m AS (SELECT station_code, unnest(generate_series(date_trunc('month', min(date))::TIMESTAMP, date_trunc('month', max(date))::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month_start FROM daily_flow GROUP BY 1),
o AS (SELECT station_code, date_trunc('month', date)::DATE AS month_start, count(DISTINCT date) AS n FROM daily_flow WHERE value IS NOT NULL GROUP BY ALL),
j AS (SELECT station_code, month_start, CAST(day(last_day(month_start)) AS BIGINT) AS days_expected, coalesce(n, 0) AS days_observed FROM m LEFT JOIN o USING (station_code, month_start)),
k AS (SELECT *, days_expected - days_observed AS days_missing, 100.0 * (days_expected - days_observed) / days_expected AS p FROM j)
SELECT station_code, month_start, days_expected, days_observed, days_missing, round(p, 6) AS failure_pct, {FAILURE.format("p")} AS failure_class FROM k"""
)
def monthly_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.monthly_availability(merged(spark, sf_dir, "flow"))


_STATS = "days_in_period, days_with_value, days_missing, round(failure_pct, 6) AS failure_pct, round(q_mean, 6) AS q_mean, round(q_min, 6) AS q_min, round(q_max, 6) AS q_max"


@query(f"WITH {MONTHLY} SELECT station_code, year, month, {_STATS} FROM monthly")
def monthly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.monthly_stats(flow_grid(spark, sf_dir))


@query(f"WITH {MONTHLY} SELECT station_code, year, {_STATS} FROM annual")
def annual_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.annual_stats(flow_grid(spark, sf_dir))


@query(f"WITH {MONTHLY} SELECT station_code, month, count(DISTINCT year) AS years_with_data, round(avg(q_mean), 6) AS q_mean, round(min(q_mean), 6) AS q_min, round(max(q_mean), 6) AS q_max FROM monthly WHERE q_mean IS NOT NULL GROUP BY ALL")
def monthly_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.monthly_regime(flow.monthly_stats(flow_grid(spark, sf_dir)))


_M = [f"m{m:02d}" for m in range(1, 13)]


@query(
    f"""WITH {MONTHLY},
w AS (SELECT station_code, CAST(year AS VARCHAR) AS label, {", ".join(f"max(q_mean) FILTER (WHERE month = {i}) AS {n}" for i, n in enumerate(_M, 1))} FROM monthly GROUP BY ALL),
x AS (SELECT w.*, a.q_mean AS annual FROM w LEFT JOIN annual a ON a.station_code = w.station_code AND CAST(a.year AS VARCHAR) = w.label),
l AS (SELECT station_code, avg(q) AS qmlt FROM grid_flow GROUP BY 1),
u AS (SELECT * FROM x UNION ALL SELECT station_code, 'Média', {", ".join(f"avg({n})" for n in _M)}, any_value(qmlt) FROM x JOIN l USING (station_code) GROUP BY 1)
SELECT station_code, label, {", ".join(f"round({n}, 6) AS {n}" for n in (*_M, "annual"))} FROM u"""
)
def monthly_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = flow_grid(spark, sf_dir)
    return flow.monthly_matrix(flow.monthly_stats(grid), flow.annual_stats(grid))


@query(
    f"""WITH {FLOW},
s AS (SELECT station_code, q, row_number() OVER (PARTITION BY station_code ORDER BY q DESC) AS i, count(*) OVER (PARTITION BY station_code) AS n FROM grid_flow WHERE q IS NOT NULL),
p AS (SELECT DISTINCT station_code, n, CAST(g AS DOUBLE) AS permanence_pct FROM s, range(1, 101) r(g)),
k AS (SELECT *, least(greatest(CAST(floor(permanence_pct * n / 100) AS BIGINT), 1), n) AS i FROM p)
SELECT k.station_code, permanence_pct, round(a.q + least(greatest(permanence_pct * k.n / 100 - k.i, 0.0), 1.0) * (b.q - a.q), 6) AS discharge_m3s
FROM k JOIN s a ON a.station_code = k.station_code AND a.i = k.i JOIN s b ON b.station_code = k.station_code AND b.i = least(k.i + 1, k.n)"""
)
def flow_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.flow_duration(flow_grid(spark, sf_dir), [float(p) for p in range(1, 101)])


@query(f"WITH {ROLLING} SELECT station_code, start_year, end_year, round(q_mean_5yr, 6) AS q_mean_5yr, round(q_min_annual, 6) AS q_min_annual, round(q_max_annual, 6) AS q_max_annual, start_year || '–' || end_year AS period_label FROM rolling")
def rolling_5yr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.rolling_five_years(flow.annual_stats(flow_grid(spark, sf_dir)))


@query(
    f"""WITH RECURSIVE {ROLLING},
z AS (SELECT station_code, avg(q) AS qmlt FROM grid_flow GROUP BY 1),
c AS (SELECT station_code, 'Série completa' AS cenario, year, month, days_in_period, volume_hm3 FROM volume UNION ALL SELECT v.station_code, '5 anos mais secos', v.year, v.month, v.days_in_period, v.volume_hm3 FROM volume v JOIN dry d ON d.station_code = v.station_code AND v.year BETWEEN d.start_year AND d.end_year),
n AS (SELECT c.*, z.qmlt, p AS pct, row_number() OVER (PARTITION BY c.station_code, cenario, p ORDER BY year, month) AS i FROM c JOIN z USING (station_code) JOIN eligible USING (station_code), range(10, 101) r(p) WHERE z.qmlt > 0),
rec AS (
    SELECT station_code, cenario, pct, qmlt, i, greatest(0.0, qmlt * pct / 100 * days_in_period * 86400 / 1e6 - volume_hm3) AS d FROM n WHERE i = 1
    UNION ALL
    SELECT n.station_code, n.cenario, n.pct, n.qmlt, n.i, greatest(0.0, rec.d + n.qmlt * n.pct / 100 * n.days_in_period * 86400 / 1e6 - n.volume_hm3) FROM rec JOIN n ON n.station_code = rec.station_code AND n.cenario = rec.cenario AND n.pct = rec.pct AND n.i = rec.i + 1
)
SELECT station_code, cenario, pct AS demand_pct_qmlt, round(any_value(qmlt * pct / 100), 6) AS demand_m3s, round(max(d), 6) AS regularization_volume_hm3 FROM rec GROUP BY ALL"""
)
def regularization(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = flow_grid(spark, sf_dir)
    return flow.regularization(grid, materialize(flow.monthly_stats(grid), "monthly"), materialize(flow.annual_stats(grid), "annual"))


@query(
    f"""WITH {ROLLING},
c AS (SELECT v.*, d.start_year || '–' || d.end_year AS critical_period FROM volume v JOIN dry d ON d.station_code = v.station_code AND v.year BETWEEN d.start_year AND d.end_year JOIN eligible e ON e.station_code = v.station_code)
SELECT station_code, critical_period, row_number() OVER w AS month_index, year, month, printf('%04d-%02d', year, month) AS period, round(q_mean, 6) AS q_mean, round(volume_hm3, 6) AS volume_hm3, round(sum(volume_hm3) OVER w, 6) AS cumulative_volume_hm3
FROM c WINDOW w AS (PARTITION BY station_code ORDER BY year, month)"""
)
def rippl(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = flow_grid(spark, sf_dir)
    return flow.rippl(flow.monthly_stats(grid), flow.annual_stats(grid))
