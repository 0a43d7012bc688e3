"""Registered queries of the remaining operators: gaps, wet years, curve points, light summaries, display, dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.functions.columns import is_finite
from fluvia.operators import cleaning, curves, daily, diagnostics, display, flow, quality_index, rainfall
from fluvia.plans.bindings import cte, view
from fluvia.plans.catalog import FAILURE, FLOW, MONTHLY, RAIN, ROLLING, flow_grid, query
from fluvia.plans.catalog_more import BEST, FLAGS, STATION_SUMMARY, matched, rain, stations


@query(
    f"""WITH {FLOW}, g AS (SELECT station_code, year(date) AS year, month(date) AS month, count(*) AS e, count(q) AS o FROM grid_flow GROUP BY ALL), p AS (SELECT *, 100.0 * (e - o) / e AS p FROM g)
SELECT station_code, year, month, e AS days_expected, o AS days_observed, round(p, 6) AS failure_pct, {FAILURE.format("p")} AS failure_class FROM p"""
)
def monthly_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.monthly_gaps(flow_grid(spark, sf_dir).withColumn("has_value", is_finite("discharge_m3s")))


@query(f"WITH {ROLLING} SELECT station_code, 'dry' AS kind, start_year, round(q_mean_5yr, 6) AS q_mean_5yr FROM dry UNION ALL SELECT station_code, 'wet', start_year, round(q_mean_5yr, 6) FROM (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY q_mean_5yr DESC, start_year) AS rn FROM rolling) WHERE rn = 1")
def extreme_5yr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolling = flow.rolling_five_years(flow.annual_stats(flow_grid(spark, sf_dir)))
    parts = [flow.extreme_five_years(rolling, w).select("station_code", F.lit("wet" if w else "dry").alias("kind"), "start_year", "q_mean_5yr") for w in (False, True)]
    return parts[0].union(parts[1])


@query(f"WITH {MONTHLY} SELECT station_code, year, month, round(q_mean * days_in_period * 86400 / 1e6, 6) AS volume_hm3 FROM monthly WHERE q_mean IS NOT NULL")
def monthly_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.monthly_volume(flow.monthly_stats(flow_grid(spark, sf_dir))).select("station_code", "year", "month", "volume_hm3")


@query(f"WITH {FLOW} SELECT station_code, round(avg(q), 6) AS qmlt FROM grid_flow GROUP BY 1")
def mean_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.mean_flow(flow_grid(spark, sf_dir))


@query(f"WITH {RAIN}, m AS (SELECT station_code, year, month, coalesce(sum(v), 0) AS t FROM rain GROUP BY ALL) SELECT station_code, month, count(*) AS n_years, round(avg(t), 6) AS mean_mm, round(min(t), 6) AS min_mm, round(max(t), 6) AS max_mm FROM m GROUP BY ALL")
def rain_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rainfall.rain_regime(rainfall.monthly_totals(rain(spark, sf_dir)))


POINTS = f"""{cte("rating_curves")},
pt AS (SELECT station_code, rating_curve_segment_id, CAST(i AS BIGINT) AS point, stage_min_cm + i * ((stage_max_cm - stage_min_cm) / 79) AS s, coefficient_a AS a, coefficient_h0 AS h0, coefficient_n AS n FROM rating_curves, range(0, 80) r(i)),
pq AS (SELECT *, a * pow(s / 100 - h0, n) AS q FROM pt WHERE s / 100 - h0 > 0)"""


@query(f"WITH {POINTS} SELECT station_code, rating_curve_segment_id, point, round(s, 6) AS stage_cm, round(q, 6) AS discharge_m3s FROM pq")
def curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.curve_points(view(spark, sf_dir, "rating_curves")).select("station_code", "rating_curve_segment_id", "point", "stage_cm", "discharge_m3s")


@query(
    f"""WITH {BEST}, {POINTS.removeprefix(cte("rating_curves") + ",")}
SELECT pq.station_code, rating_curve_segment_id, point, round(q * exp(mean_r - 1.96 * sd_r), 3) AS discharge_lower, round(q * exp(mean_r + 1.96 * sd_r), 3) AS discharge_upper FROM pq JOIN env USING (rating_curve_segment_id) WHERE env.n >= 5 AND sd_r IS NOT NULL"""
)
def envelope_ribbons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curves.envelope_ribbons(view(spark, sf_dir, "rating_curves"), matched(spark, sf_dir)[1])
    # discharges of up to 10^6 m³/s, to the three decimals of the exports: six are more than doubles of two engines share
    return rows.select("station_code", "rating_curve_segment_id", "point", *(F.round(c, 3).alias(c) for c in ("discharge_lower", "discharge_upper")))


@query(
    f"""WITH {BEST}, q AS (SELECT station_code, quantile_cont(r, 0.01) AS a, quantile_cont(r, 0.99) AS b FROM best GROUP BY 1 HAVING count(*) >= 5 AND quantile_cont(r, 0.01) <> quantile_cont(r, 0.99)),
l AS (SELECT station_code, least(a, 0.0) AS a, greatest(b, 0.0) AS b FROM q)
SELECT station_code, round((a + b) / 2 - greatest((b - a) / 2, 0.2), 6) AS lower, round((a + b) / 2 + greatest((b - a) / 2, 0.2), 6) AS upper FROM l"""
)
def residual_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.residual_axis_limits(matched(spark, sf_dir)[0], "rating_log_residual", ["station_code"])


@query(
    f"""WITH {FLAGS}, {cte("rating_curves")}, f AS (SELECT station_code, count(*) AS n, count(*) FILTER (WHERE stage_cm > 0 AND discharge_m3s > 0) AS nv, count(*) FILTER (WHERE f1) AS n1, count(*) FILTER (WHERE f2) AS n2, count(*) FILTER (WHERE f3) AS n3, count(*) FILTER (WHERE f4) AS n4 FROM fl GROUP BY 1),
s AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS station_code FROM supplier),
z AS (SELECT s.station_code, coalesce(n, 0) AS n, coalesce(nv, 0) AS nv, (n1 / n >= 0.05)::INT + (n2 / n >= 0.05)::INT + (n3 / n >= 0.15)::INT + (n4 / n >= 0.15)::INT + (nv > 0)::INT AS score, f.station_code IS NULL AND c.station_code IS NULL AS absent FROM s LEFT JOIN f USING (station_code) LEFT JOIN (SELECT DISTINCT station_code FROM rating_curves) c USING (station_code))
SELECT station_code, n AS n_measurements, nv AS n_valid_measurements, CAST(score AS BIGINT) AS diagnostic_attention_score, CASE WHEN absent THEN NULL WHEN score <= 1 THEN 'low_attention' WHEN score <= 3 THEN 'moderate_attention' ELSE 'high_attention' END AS diagnostic_attention_class FROM z"""
)
def light_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnostics.diagnostic_summary(diagnostics.measurement_flags(view(spark, sf_dir, "measurements")), view(spark, sf_dir, "rating_curves"), stations=view(spark, sf_dir, "stations"))
    return rows.select("station_code", "n_measurements", "n_valid_measurements", "diagnostic_attention_score", "diagnostic_attention_class")


@query(
    f"""WITH {STATION_SUMMARY}, {cte("rating_curves")}, {cte("stations")}, c AS (SELECT DISTINCT station_code FROM rating_curves)
SELECT s.station_code, station_name, ms.n AS n_measurements, ms.years AS n_years_with_measurements, CASE WHEN ms.n > 0 AND c.station_code IS NOT NULL THEN 'with_measurements_and_rating_curves' WHEN ms.n > 0 THEN 'with_measurements_only' ELSE 'registration_only' END AS map_group,
       CAST(CASE WHEN ms.n > 0 AND c.station_code IS NOT NULL THEN 1 WHEN ms.n > 0 THEN 2 ELSE 3 END AS BIGINT) AS map_group_priority, s.station_code || ' — ' || station_name AS station_search_label
FROM stations s LEFT JOIN ms ON ms.station_code = s.station_code LEFT JOIN c ON c.station_code = s.station_code"""
)
def station_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    has_curve = view(spark, sf_dir, "rating_curves").select("station_code").distinct().withColumn("has_curves", F.lit(True))
    rows = quality_index.assemble(view(spark, sf_dir, "stations"), [cleaning.measurement_summary(view(spark, sf_dir, "measurements")), has_curve])
    rows = rows.withColumn("map_group", display.map_group(F.col("n_measurements") > 0, F.col("has_curves"))).withColumn("map_group_priority", display.group_priority(F.col("map_group")))
    return rows.select("station_code", "station_name", "n_measurements", "n_years_with_measurements", "map_group", "map_group_priority", display.search_label(F.col("station_code"), F.col("station_name")).alias("station_search_label"))


@query(
    f"""WITH {cte("measurements")}, {cte("rating_curves")}, {cte("vertices")}, {cte("stations")}
SELECT station_code, station_code IN (SELECT station_code FROM measurements) AS has_measurements, station_code IN (SELECT station_code FROM rating_curves) AS has_rating_curves, station_code IN (SELECT station_code FROM vertices) AS has_cross_sections FROM stations"""
)
def product_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_index.product_availability(stations(spark, sf_dir), {"measurements": view(spark, sf_dir, "measurements"), "rating_curves": view(spark, sf_dir, "rating_curves"), "cross_sections": view(spark, sf_dir, "vertices")})


@query(
    f"""WITH {cte("vertices")}, s AS (SELECT station_code, cross_section_id, max(vertex_stage_cm) - min(vertex_stage_cm) AS a, max(vertex_distance_m) - min(vertex_distance_m) AS b, count(*) AS n FROM vertices GROUP BY ALL)
SELECT station_code, cross_section_id, round(coalesce(a, b, n), 6) AS metric_value, CASE WHEN a IS NOT NULL THEN 'Amplitude vertical (cm)' WHEN b IS NOT NULL THEN 'Amplitude horizontal (m)' ELSE 'Número de vértices' END AS metric_label FROM s"""
)
def section_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.section_metric(cleaning.section_summary(view(spark, sf_dir, "vertices"))).select("station_code", "cross_section_id", "metric_value", "metric_label")


DICTIONARY = ("measurements", "rating_curves", "stations", "vertices")
UNITS = {"stage_cm": "cm", "discharge_m3s": "m³/s", "vertex_distance_m": "m", "vertex_stage_cm": "cm", "drainage_area": "km²"}
_DESCRIBED = " UNION ALL ".join(f"SELECT '{n}' AS table_name, column_name, column_type, row_number() OVER () AS position FROM (DESCRIBE WITH {cte(n)} SELECT * FROM {n})" for n in DICTIONARY)


@query(f"""SELECT table_name, column_name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS data_type, CASE column_name {" ".join(f"WHEN '{c}' THEN '{u}'" for c, u in UNITS.items())} END AS unit, position FROM ({_DESCRIBED})""")
def data_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_index.data_dictionary({n: view(spark, sf_dir, n) for n in DICTIONARY}, UNITS)


@query(
    f"""WITH {cte("measurements")}, g AS (SELECT *, discharge_m3s / 2 AS area, 20 + stage_cm / 10 AS w, 1 + stage_cm / 100 AS d FROM measurements)
SELECT measurement_id, round(w + 2 * d, 6) AS wetted_perimeter_m, round(area / (w + 2 * d), 6) AS hydraulic_radius_m, round(area * pow(area / (w + 2 * d), 2.0 / 3), 6) AS section_factor FROM g"""
)
def hydraulic_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "measurements").withColumns({"wetted_area_m2": F.col("discharge_m3s") / 2, "width_m": 20 + F.col("stage_cm") / 10, "mean_depth_m": 1 + F.col("stage_cm") / 100})
    return curves.hydraulic_geometry(m).select("measurement_id", "wetted_perimeter_m", "hydraulic_radius_m", "section_factor")


@query(
    f"""WITH {cte("measurements")},
a AS (SELECT station_code, count(*) AS n FROM (SELECT station_code FROM measurements GROUP BY station_code, round_even(stage_cm, 0) HAVING count(*) >= 5 AND max(discharge_m3s) > min(discharge_m3s)) GROUP BY 1),
b AS (SELECT station_code, count(*) AS n FROM (SELECT station_code FROM measurements GROUP BY station_code, round_even(discharge_m3s, 2) HAVING count(*) >= 5 AND max(stage_cm) > min(stage_cm)) GROUP BY 1)
SELECT m.station_code, count(*) AS n_measurements, min(measurement_datetime) AS date_start, max(measurement_datetime) AS date_end, count(*) FILTER (WHERE stage_cm <= 0) AS n_stage_le_zero, count(*) FILTER (WHERE discharge_m3s <= 0) AS n_discharge_le_zero,
       coalesce(any_value(a.n), 0) AS n_repeated_stage_groups, coalesce(any_value(b.n), 0) AS n_repeated_discharge_groups, 'fallback_app_diagnostics' AS diagnostic_source FROM measurements m LEFT JOIN a USING (station_code) LEFT JOIN b USING (station_code) GROUP BY 1"""
)
def fallback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.fallback_summary(view(spark, sf_dir, "measurements"))
