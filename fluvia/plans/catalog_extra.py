"""Registered queries of parsers, classes, display, set operators, indices, issue joins and the assembled station index."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.functions import columns as C
from fluvia.operators import cleaning, curves, diagnostics, display, extremes, flow, quality_index
from fluvia.plans.bindings import cte, view
from fluvia.plans.catalog import FLOW, ROLLING, flow_grid, matched_days, merged_sql, query
from fluvia.plans.catalog_more import CLEAN, MATCH, MAXIMA, POWER, SCORES, SUMMARY, WINDOWS, matched, scores, stations
from fluvia.session import materialize, scratch_dir
from fluvia.sources import readers, sinks
from fluvia.sources.store import Store

# parsers: texts are made of the tables' numbers and dates, then read back

TEXTS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN ' n/a ' WHEN c_custkey % 13 = 0 THEN 'abc' ELSE CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS STRING) END AS whole FROM customer"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customer.select(F.col("c_custkey").alias("id"), F.expr("CASE WHEN c_custkey % 11 = 0 THEN ' n/a ' WHEN c_custkey % 13 = 0 THEN 'abc' ELSE CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS STRING) END").alias("whole"))


@query(f"WITH t AS ({TEXTS}), v AS (SELECT id, TRY_CAST(whole AS DOUBLE) AS n FROM t) SELECT id, round(n + 0.5, 6) AS series_number, round(n * 1000 + 0.25, 6) AS product_number, round(n * 1000 + 234.5, 6) AS threshold_number FROM v")
def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = texts(spark, sf_dir)
    w = F.col("whole")
    number = w.try_cast("double")
    cells = {"series": F.when(number.isNull(), w).otherwise(F.translate((number + 0.5).cast("decimal(20,1)").cast("string"), ".", ",")), "product": F.when(number.isNull(), w).otherwise(C.format_number_pt(number * 1000 + 0.25, 2)), "threshold": F.when(number.isNull(), w).otherwise(C.format_number_pt(number * 1000 + 234.5, 1))}
    t = t.withColumns(cells)
    return t.select("id", C.parse_series_number("series").alias("series_number"), C.parse_product_number("product").alias("product_number"), C.parse_threshold("threshold").alias("threshold_number"))


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day_first, CAST(o_orderdate AS DATE) AS year_first, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS with_gaps, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 90 MINUTE AS moment FROM orders")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("d"))
    texts_ = o.select("id", F.date_format("d", "dd/MM/yyyy").alias("day_first"), F.date_format("d", "yyyy-MM-dd").alias("year_first"), F.when(F.col("id") % 7 == 0, "31/02/1999").otherwise(F.date_format("d", "yyyy-MM-dd")).alias("with_gaps"), F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit("T01:30:00Z")).alias("moment"))
    return texts_.select("id", *(C.parse_date(c).alias(c) for c in ("day_first", "year_first", "with_gaps")), C.parse_datetime("moment").cast("timestamp_ntz").alias("moment"))


@query("SELECT p_partkey AS id, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS station_code, CAST(p_size AS BIGINT) AS segment_number, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 9 AS BIGINT) END AS n_segments, p_size % 3 <> 0 AS flag_number, p_size % 3 = 1 AS flag_text FROM part")
def parsed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("s"))
    code = F.concat(F.lit(" "), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, ".0").otherwise(""))
    segment = F.concat(F.format_string("%02d", F.col("s").cast("int")), F.when(F.col("id") % 2 == 0, F.concat(F.lit("/"), (F.col("id") % 9).cast("string"))).otherwise(""))
    flag = F.when(F.col("s") % 3 == 1, " Sim").when(F.col("s") % 3 == 2, "não")
    return p.select("id", C.station_code(code).alias("station_code"), C.parse_segment_number(segment).alias("segment_number"), C.parse_segment_number(segment, last=True).alias("n_segments"), C.truthy(F.col("s") % 3).alias("flag_number"), C.truthy(flag).alias("flag_text"))


_X = "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE (p_partkey % 101) / 100.0 END"


@query(
    f"""WITH p AS (SELECT p_partkey AS id, CAST({_X} AS DOUBLE) AS x, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_partkey % 30 END AS n FROM part)
SELECT id, CASE WHEN x IS NULL THEN 'not_available' WHEN x = 0 THEN 'none' WHEN x < 0.01 THEN 'very_low' WHEN x < 0.05 THEN 'low' WHEN x < 0.15 THEN 'moderate' ELSE 'high' END AS percent_class,
       CASE WHEN x IS NULL THEN 'not_available' WHEN x < 0.10 THEN 'low' WHEN x < 0.25 THEN 'moderate' WHEN x < 0.50 THEN 'high' ELSE 'very_high' END AS residual_class, CASE WHEN x IS NULL THEN 'not_available' WHEN x >= 0.90 THEN 'high_coverage' WHEN x >= 0.60 THEN 'moderate_coverage' ELSE 'low_coverage' END AS coverage_class,
       CASE WHEN x IS NULL THEN 'not_available' WHEN x >= 0.95 THEN 'high' WHEN x >= 0.80 THEN 'moderate' WHEN x > 0 THEN 'low' ELSE 'none' END AS completeness_class, CASE WHEN n IS NULL THEN 'not_available' WHEN n = 0 THEN 'none' WHEN n <= 5 THEN 'low' WHEN n <= 20 THEN 'moderate' ELSE 'high' END AS overlap_class,
       CASE WHEN n <= 1 THEN 'low_attention' WHEN n <= 3 THEN 'moderate_attention' ELSE 'high_attention' END AS attention_class FROM p"""
)
def class_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.expr(f"CAST({_X} AS DOUBLE)").alias("x"), F.expr("CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_partkey % 30 END").alias("n"))
    ladders = {"percent_class": C.percent_class, "residual_class": C.residual_class, "coverage_class": C.coverage_class, "completeness_class": C.completeness_class}
    return p.select("id", *(f(F.col("x")).alias(n) for n, f in ladders.items()), C.overlap_class(F.col("n")).alias("overlap_class"), C.attention_class(F.col("n")).alias("attention_class"))


@query(
    """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'Vazão + cotas + curvas-chave' WHEN s_suppkey % 4 = 2 THEN 'Vazão + cotas' WHEN s_suppkey % 4 = 1 THEN 'Parcial — sem vazões e curvas-chave' ELSE 'Parcial — sem vazões' END AS scope,
       CASE WHEN s_suppkey % 4 = 0 THEN 'Apta para análise H-Q com curvas-chave' WHEN s_suppkey % 4 = 2 THEN 'Apta para verificações H-Q básicas' ELSE 'Parcial — sem vazões' END AS fit_for, CASE s_suppkey % 4 WHEN 0 THEN 'flu_rainfall_with_data' WHEN 2 THEN 'flu_with_data' WHEN 3 THEN 'rainfall_with_data' ELSE 'flu_registration' END AS layer,
       CASE WHEN s_suppkey % 2 = 0 THEN 'Sim' ELSE 'Não' END AS shown, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || ' — ' || s_name || ' / SP' AS label, translate(rtrim(rtrim(format('{:,.2f}', s_acctbal), '0'), '.'), ',.', '.,') AS value_text FROM supplier"""
)
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    scope, fit_for = display.acquisition_scope(k % 2 == 0, F.lit(True), k % 4 % 3 == 0)
    layer = display.map_layer(F.lit(True), F.lit(False), k % 2 == 0, k % 4 % 3 == 0)
    label = display.search_label(F.lpad(k.cast("string"), 8, "0"), F.col("s_name"), F.lit("SP"))
    return s.select(k.alias("id"), scope.alias("scope"), fit_for.alias("fit_for"), layer.alias("layer"), display.yes_no(k % 2 == 0).alias("shown"), label.alias("label"), display.number_text("s_acctbal").alias("value_text"))


# sets, orders, samples

SETS = f"{cte('measurements')}, {cte('rating_curves')}, m AS (SELECT DISTINCT station_code FROM measurements WHERE stage_cm > 300), c AS (SELECT DISTINCT station_code FROM rating_curves WHERE stage_min_cm > 190)"


@query(f"WITH {SETS} SELECT 'both' AS kind, station_code FROM (SELECT * FROM m INTERSECT SELECT * FROM c) UNION ALL SELECT 'measurements only', station_code FROM (SELECT * FROM m EXCEPT SELECT * FROM c) UNION ALL SELECT 'any', station_code FROM (SELECT * FROM m UNION SELECT * FROM c)")
def station_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "measurements").where("stage_cm > 300").select("station_code")
    c = view(spark, sf_dir, "rating_curves").where("stage_min_cm > 190").select("station_code")
    parts = {"both": m.intersect(c), "measurements only": m.subtract(c), "any": m.union(c).distinct()}
    out = [df.select(F.lit(n).alias("kind"), "station_code") for n, df in parts.items()]
    return out[0].union(out[1]).union(out[2])


@query(f"WITH {cte('request_log')} SELECT route_name, CAST(CASE route_name WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS BIGINT) AS display_order, count(*) AS n FROM request_log GROUP BY ALL")
def routes_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = view(spark, sf_dir, "request_log").groupBy("route_name").agg(F.count("*").alias("n"))
    return display.ranked_by(counts, "route_name", ("purchase", "click")).select("route_name", "display_order", "n")


@query(f"WITH {cte('request_log')} SELECT CAST(floor(http_status / 10) AS BIGINT) AS value, count(*) AS n FROM request_log GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.value_counts(view(spark, sf_dir, "request_log").withColumn("status", F.floor(F.col("http_status") / 10)), "status")


@query(f"WITH {cte('measurements')}, r AS (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY md5('1:' || CAST(measurement_id AS VARCHAR)), measurement_id) AS n FROM measurements) SELECT station_code, measurement_id FROM r WHERE n <= 40")
def preview_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.preview(view(spark, sf_dir, "measurements"), ["station_code"], "measurement_id", 40).select("station_code", "measurement_id")


@query(f"WITH {cte('measurements')} SELECT station_code, round(arg_min(stage_cm, measurement_id) FILTER (WHERE stage_cm > 400), 6) AS stage_cm, arg_min(last_update, measurement_id) FILTER (WHERE last_update IS NOT NULL) AS last_update FROM measurements GROUP BY 1")
def first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "measurements").withColumn("stage_cm", F.when(F.col("stage_cm") > 400, F.col("stage_cm")))
    return cleaning.first_known(m, ["station_code"], ["stage_cm", "last_update"], "measurement_id")


@query(f"WITH {CLEAN} SELECT count(*) AS n_rows_in, count(*) FILTER (WHERE reason IS NULL) AS n_rows_kept, count(*) FILTER (WHERE reason = 'missing_datetime') AS n_removed_missing_datetime, count(*) FILTER (WHERE reason = 'lower_consistency_level') AS n_removed_lower_consistency_level, count(*) FILTER (WHERE reason = 'older_duplicate') AS n_removed_older_duplicate, count(DISTINCT station_code) FILTER (WHERE reason IS NULL) AS n_stations, count(*) FILTER (WHERE reason IS NULL AND last_update IS NULL) AS n_missing_last_update, CAST(0 AS BIGINT) AS n_duplicate_keys_left FROM cl")
def cleaning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.qc_summary(cleaning.clean_measurements(view(spark, sf_dir, "measurements")), ["station_code", "measurement_datetime"], ["last_update"])


@query(
    f"""WITH RECURSIVE {cte("measurements")}, d AS (SELECT station_code, measurement_date AS d, row_number() OVER (PARTITION BY station_code ORDER BY measurement_date) AS i FROM (SELECT DISTINCT station_code, measurement_date FROM measurements WHERE measurement_date IS NOT NULL)),
r AS (
    SELECT station_code, i, CAST(1 AS BIGINT) AS k, d - 1 AS lo, d + 1 AS hi, CAST(1 AS BIGINT) AS n FROM d WHERE i = 1
    UNION ALL
    SELECT d.station_code, d.i, CASE WHEN d.d - 1 <= hi + 3 AND d.d + 1 - lo + 1 <= 31 THEN k ELSE k + 1 END, CASE WHEN d.d - 1 <= hi + 3 AND d.d + 1 - lo + 1 <= 31 THEN lo ELSE d.d - 1 END, CASE WHEN d.d - 1 <= hi + 3 AND d.d + 1 - lo + 1 <= 31 THEN greatest(hi, d.d + 1) ELSE d.d + 1 END,
           CASE WHEN d.d - 1 <= hi + 3 AND d.d + 1 - lo + 1 <= 31 THEN n + 1 ELSE 1 END FROM r JOIN d ON d.station_code = r.station_code AND d.i = r.i + 1
)
SELECT station_code, k AS cluster_id, min(lo) AS date_start, max(hi) AS date_end, max(n) AS n_measurement_dates FROM r GROUP BY ALL"""
)
def date_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.date_clusters(view(spark, sf_dir, "measurements"))


# curves


@query(
    f"""WITH {cte("rating_curves")}, kf AS (SELECT station_code, rating_curve_id, min(valid_from) AS lo FROM rating_curves GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY lo NULLS LAST, rating_curve_id) AS k FROM kf),
s AS (SELECT r.*, k, row_number() OVER (PARTITION BY station_code, rating_curve_id ORDER BY stage_min_cm NULLS LAST, rating_curve_segment_id) AS t FROM rating_curves r JOIN k USING (station_code, rating_curve_id))
SELECT station_code, rating_curve_segment_id, k AS curve_number, t AS segment_order, 'CC ' || k || ' - T' || t AS segment_label, 'Q=' || rtrim(rtrim(printf('%.3f', coefficient_a), '0'), '.') || '(H' || CASE WHEN coefficient_h0 < 0 THEN '+' ELSE '-' END || rtrim(rtrim(printf('%.3f', abs(coefficient_h0)), '0'), '.') || ')^' || rtrim(rtrim(printf('%.3f', coefficient_n), '0'), '.') AS equation FROM s"""
)
def curve_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.curve_labels(view(spark, sf_dir, "rating_curves")).select("station_code", "rating_curve_segment_id", "curve_number", "segment_order", "segment_label", "equation")


@query(f"WITH {cte('measurements')}, {cte('rating_curves')} SELECT measurement_id, count(*) AS n_valid_segments, count(DISTINCT rating_curve_id) AS n_valid_curves FROM measurements m JOIN rating_curves c ON c.station_code = m.station_code AND measurement_date >= valid_from AND (valid_to IS NULL OR measurement_date <= valid_to) GROUP BY 1")
def curves_valid_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "measurements").select("station_code", "measurement_id", "measurement_date")
    found = curves.valid_on(m, "measurement_date", view(spark, sf_dir, "rating_curves"))
    return found.groupBy("measurement_id").agg(F.count("*").alias("n_valid_segments"), F.countDistinct("rating_curve_id").alias("n_valid_curves"))


@query(
    f"""WITH {POWER}, b AS (SELECT * FROM (SELECT station_code, h0, exp(pf.a) AS a, b, row_number() OVER (PARTITION BY station_code ORDER BY sse, mar, abs(h0)) AS rn FROM pf JOIN pz USING (station_code, i)) WHERE rn = 1),
s AS (SELECT station_code, min(h) * 100 AS lo, max(h) * 100 AS hi FROM pm GROUP BY 1), p AS (SELECT b.*, CAST(i AS BIGINT) AS point, lo + i * (hi - lo) / 119 AS st FROM b JOIN s USING (station_code), range(0, 120) r(i))
SELECT station_code, point, round(st, 6) AS stage_cm, round(a * pow(st / 100 - h0, b), 6) AS discharge_m3s FROM p WHERE st / 100 - h0 > 0 AND a * pow(st / 100 - h0, b) > 0"""
)
def power_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "measurements")
    return diagnostics.power_points(diagnostics.power_baseline(m), m)


# issue joins: the issues are days that match no curve

ISSUES = f"""{MAXIMA}, {MATCH.removeprefix(merged_sql("flow") + ", ")},
iss AS (SELECT station_code, date, CASE WHEN coalesce(abs(err) > 0.25, false) THEN 'Diferença' ELSE 'Sem curva' END AS label FROM m WHERE abs(err) > 0.25 OR (q IS NOT NULL AND n1 = 0))"""


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matched_days(spark, sf_dir)
    return rows.where("q_diff_gt_25 or discharge_without_curve").select("station_code", "date", F.when(F.col("q_diff_gt_25"), "Diferença").otherwise("Sem curva").alias("label"))


@query(f"WITH {ISSUES} SELECT f.station_code, hy AS hydrological_year, date_max, count(iss.date) AS n_consistency_issues_on_max, coalesce(string_agg(DISTINCT label, '; ' ORDER BY label), '') AS consistency_issue_types_on_max, count(iss.date) > 0 AS flag_consistency_issue_on_max FROM f LEFT JOIN iss ON iss.station_code = f.station_code AND iss.date = f.date_max GROUP BY ALL")
def annual_maxima_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extremes.annual_maxima(flow_grid(spark, sf_dir), issues(spark, sf_dir))
    return rows.select("station_code", "hydrological_year", "date_max", "n_consistency_issues_on_max", "consistency_issue_types_on_max", "flag_consistency_issue_on_max")


@query(f"WITH {MAXIMA} SELECT (hy - 1) || '/' || hy AS ano_hidrologico, date_max AS data_maximo, round(q_max, 3) AS q_max_m3s, round(100 * mf, 3) AS falhas_pct, rd AS rank, ties AS n_dias_iguais_ao_maximo, CASE WHEN up > 1.5 THEN 'alto' WHEN down > 1.5 THEN 'baixo' ELSE '' END AS outlier FROM f")
def annual_maxima_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.annual_max_export(extremes.annual_maxima(flow_grid(spark, sf_dir)))
    return rows.select("ano_hidrologico", "data_maximo", "q_max_m3s", "falhas_pct", "rank", "n_dias_iguais_ao_maximo", "outlier")


# station tables


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "rating_curves")
    parts = quality_index.measurement_indices(cleaning.measurement_summary(view(spark, sf_dir, "measurements"))), quality_index.curve_indices(c, curves.overlap_pairs(c)), quality_index.section_indices(cleaning.section_summary(view(spark, sf_dir, "vertices")))
    return quality_index.assessment(scores(spark, sf_dir), *parts)


_TEXT = "regexp_replace(CAST(round({0}, {1}) AS VARCHAR), '\\.0$', '')"
_STEPS = "CASE WHEN coalesce({0}, 0) <= 0 THEN '{1}' " + "WHEN {0} < {2} THEN '{3}' WHEN {0} < {4} THEN '{5}' WHEN {0} < {6} THEN '{7}' ELSE '{8}' END"
_FLAG = "CAST({0} AS INT)::DOUBLE, CASE WHEN {0} THEN 'Yes' ELSE 'No' END, CASE WHEN {0} THEN 'available' ELSE 'missing' END"
_PCT = "CASE WHEN {0} IS NULL THEN 'not_available' WHEN {0} >= 0.95 THEN 'high' WHEN {0} >= 0.80 THEN 'moderate' WHEN {0} > 0 THEN 'low' ELSE 'none' END"
_CURVES = "CASE WHEN coalesce({0}, 0) <= 0 THEN 'none' WHEN {0} = 1 THEN 'single_{1}' WHEN {0} < 5 THEN 'few_{1}s' WHEN {0} < 20 THEN 'multiple_{1}s' ELSE 'many_{1}s' END"
_VERTICES = ", vx AS (SELECT station_code, count(*) AS nv, max(vertex_distance_m) - min(vertex_distance_m) AS span, max(vertex_stage_cm) - min(vertex_stage_cm) AS hspan FROM vertices GROUP BY 1), z2 AS (SELECT z.*, nv, span, hspan FROM z LEFT JOIN vx USING (station_code))"


def _count(name: str) -> str:
    return f"coalesce({name}, 0)::DOUBLE, CAST(coalesce({name}, 0) AS VARCHAR)"


_INDEX_SQL = {
    10: _FLAG.format("placed"), 20: _FLAG.format("coalesce(drainage_area > 0, false)"), 30: _FLAG.format("false"), 100: _FLAG.format("coalesce(n, 0) > 0"), 110: _count("n") + ", " + _STEPS.format("n", "none", 5, "very_limited", 20, "limited", 50, "moderate", "substantial"),
    120: _count("years") + ", " + _STEPS.format("years", "none", 3, "very_short", 10, "short", 20, "moderate", "long"), 130: f"ph, {_TEXT.format('100 * ph', 1)} || '%', {_PCT.format('ph')}", 140: f"pq, {_TEXT.format('100 * pq', 1)} || '%', {_PCT.format('pq')}",
    200: _FLAG.format("coalesce(k, 0) > 0"), 210: _count("k") + ", " + _CURVES.format("k", "curve"), 220: _count("segments") + ", " + _CURVES.format("segments", "segment"), 230: _count("o") + ", CASE WHEN coalesce(o, 0) = 0 THEN 'none' WHEN o <= 5 THEN 'low' WHEN o <= 20 THEN 'moderate' ELSE 'high' END",
    300: _FLAG.format("coalesce(sk, 0) > 0"), 310: _count("sk") + ", " + _CURVES.format("sk", "profile"), 320: _count("nv") + ", " + _STEPS.format("nv", "none", 20, "very_limited", 100, "limited", 500, "moderate", "substantial"),
    330: f"span, {_TEXT.format('span', 2)}, CASE WHEN coalesce(nv, 0) <= 0 THEN 'not_available' WHEN span IS NULL OR hspan IS NULL THEN 'incomplete_geometry' WHEN span <= 0 OR hspan <= 0 THEN 'invalid_or_flat_geometry' ELSE 'geometry_available' END",
    400: "score::DOUBLE, CAST(score AS VARCHAR), CASE WHEN score >= 80 THEN 'high_information' WHEN score >= 60 THEN 'moderate_information' WHEN score >= 40 THEN 'limited_information' WHEN score >= 20 THEN 'basic_registration_or_sparse_products' ELSE 'registration_only_or_incomplete' END",
    500: "NULL::DOUBLE, 'Not available in current Shiny export', 'not_calculable_current_export'", 510: "NULL::DOUBLE, 'Not available in current Shiny export', 'not_calculable_current_export'",
}


def _row(row: tuple) -> str:
    group, name, _, unit, _, direction, description, source, available, order = row
    quoted = ["NULL" if v is None else "'" + v + "'" for v in (unit, direction, description, source)]
    names = ("index_value", "index_value_text", "index_class")
    return f"SELECT station_code, '{group}' AS index_group, '{name}' AS index_name, a AS {names[0]}, b AS {names[1]}, c AS {names[2]}, {quoted[0]}::VARCHAR AS index_unit, {quoted[1]} AS index_direction, {quoted[2]} AS index_description, {quoted[3]} AS source_tables, {available} AS is_available, CAST({order} AS BIGINT) AS display_order FROM (SELECT station_code, unnest([row(v1, v2, v3)], recursive := true) FROM (SELECT station_code, x.* FROM z2, LATERAL (SELECT {_INDEX_SQL[order]}) x(v1, v2, v3))) t(station_code, a, b, c)"


@query(f"WITH {SCORES}{_VERTICES} SELECT * EXCLUDE (index_value), round(index_value, 6) AS index_value FROM (" + " UNION ALL ".join(map(_row, quality_index.STATION_INDICES)) + ")")
def station_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_index.station_indices(assessed(spark, sf_dir))


@query(
    f"""WITH {SUMMARY}
SELECT station_code, index_name, index_class, round(v, 6) AS index_value FROM (
    SELECT station_code, 'Fração de cotas ≤ 0' AS index_name, n1 / nullif(n, 0) AS v, CASE WHEN v IS NULL THEN 'not_available' WHEN v = 0 THEN 'none' WHEN v < 0.01 THEN 'very_low' WHEN v < 0.05 THEN 'low' WHEN v < 0.15 THEN 'moderate' ELSE 'high' END AS index_class FROM z
    UNION ALL SELECT station_code, 'Fração de vazões ≤ 0', n2 / nullif(n, 0) AS v, CASE WHEN v IS NULL THEN 'not_available' WHEN v = 0 THEN 'none' WHEN v < 0.01 THEN 'very_low' WHEN v < 0.05 THEN 'low' WHEN v < 0.15 THEN 'moderate' ELSE 'high' END FROM z
    UNION ALL SELECT station_code, 'Fração de cotas repetidas com vazão variável', n3 / nullif(n, 0) AS v, CASE WHEN v IS NULL THEN 'not_available' WHEN v = 0 THEN 'none' WHEN v < 0.01 THEN 'very_low' WHEN v < 0.05 THEN 'low' WHEN v < 0.15 THEN 'moderate' ELSE 'high' END FROM z
    UNION ALL SELECT station_code, 'Fração de vazões repetidas com cota variável', n4 / nullif(n, 0) AS v, CASE WHEN v IS NULL THEN 'not_available' WHEN v = 0 THEN 'none' WHEN v < 0.01 THEN 'very_low' WHEN v < 0.05 THEN 'low' WHEN v < 0.15 THEN 'moderate' ELSE 'high' END FROM z
    UNION ALL SELECT station_code, 'Fração pareada com curva-chave', mfr AS v, CASE WHEN mfr IS NULL THEN 'not_available' WHEN mfr >= 0.9 THEN 'high_coverage' WHEN mfr >= 0.6 THEN 'moderate_coverage' ELSE 'low_coverage' END FROM z
    UNION ALL SELECT station_code, 'Mediana do resíduo log absoluto', mar AS v, CASE WHEN mar IS NULL THEN 'not_available' WHEN mar < 0.10 THEN 'low' WHEN mar < 0.25 THEN 'moderate' WHEN mar < 0.50 THEN 'high' ELSE 'very_high' END FROM z
    UNION ALL SELECT station_code, 'Evidência de regimes temporais nos resíduos', NULL, 'not_available' FROM z
    UNION ALL SELECT station_code, 'Escore de atenção diagnóstica', score AS v, CASE WHEN score <= 1 THEN 'low_attention' WHEN score <= 3 THEN 'moderate_attention' ELSE 'high_attention' END FROM z)"""
)
def diagnostic_indices_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight diagnostic indices without the search for temporal regimes."""
    best, envelopes = matched(spark, sf_dir)
    summary = diagnostics.diagnostic_summary(diagnostics.measurement_flags(view(spark, sf_dir, "measurements")), view(spark, sf_dir, "rating_curves"), curves.envelope_flags(best, envelopes))
    return diagnostics.diagnostic_indices(summary).select("station_code", "index_name", "index_class", "index_value")


@query(
    f"""WITH {SCORES}{_VERTICES}, {WINDOWS}, rq AS (SELECT station_code, CAST(sum(n_attempts) AS BIGINT) AS attempts, count(*) AS routes FROM rs GROUP BY 1)
SELECT z2.station_code, z2.station_name, coalesce(z2.n, 0) > 0 AS has_measurements, coalesce(k, 0) > 0 AS has_rating_curves, coalesce(sk, 0) > 0 AS has_cross_sections, CAST(score AS BIGINT) AS preliminary_information_score, coalesce(z2.n, 0) AS n_measurements, coalesce(k, 0) AS n_rating_curves, coalesce(sk, 0) AS n_cross_sections, coalesce(nv, 0) AS n_cross_section_vertices,
       rq.routes AS n_routes, rq.attempts AS n_attempts, CASE WHEN NOT placed THEN 'missing_coordinates' WHEN z2.n > 0 AND k > 0 THEN 'measurements_and_rating_curves' WHEN z2.n > 0 THEN 'measurements_only' WHEN k > 0 THEN 'rating_curves_only' ELSE 'registration_only' END AS map_status,
       CASE WHEN z2.n > 0 AND k > 0 THEN 'Medições + curvas-chave' WHEN z2.n > 0 THEN 'Somente medições' ELSE 'Somente cadastro' END AS map_group_label, z2.station_code || ' — ' || z2.station_name || coalesce(' — ' || n_name, '') AS station_search_label, z2.n IS NOT NULL AND coalesce(z2.n, 0) > 0 AS has_diagnostics
FROM z2 LEFT JOIN rq ON rq.station_code = z2.station_code"""
)
def full_station_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stations with nine summaries: products, assessment, measurement, curve and section indices, diagnostics, requests, map status and yearly coverage.

    The summaries are committed as product tables clustered by station and joined without an exchange.
    """
    store = Store(spark, f"{scratch_dir(spark)}/products-{uuid.uuid4().hex}")
    store.commit(station_summaries(spark, sf_dir))
    return indexed_stations(store)


def station_summaries(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    """What makes the stations and their summaries, one row a station each."""

    def curve_table() -> DataFrame:
        c = materialize(view(spark, sf_dir, "rating_curves"), "curves")  # counted, and swept for overlaps
        return quality_index.curve_indices(c, curves.overlap_pairs(c))

    def request_table() -> DataFrame:
        routes = cleaning.route_status(cleaning.window_status(view(spark, sf_dir, "request_log")))
        return routes.groupBy("station_code").agg(F.count("*").alias("n_routes"), F.sum("n_attempts").alias("n_attempts"))

    return {
        "rating_curves": curve_table,
        "coverage": lambda: cleaning.station_year_summary(view(spark, sf_dir, "measurements")).groupBy("station_code").agg(F.count("*").alias("n_years"), F.max("n_dates").alias("most_dates_in_a_year")),
        "diagnostics": lambda: diagnostics.light_counts(view(spark, sf_dir, "measurements")),
        "measurements": lambda: quality_index.measurement_indices(cleaning.measurement_summary(view(spark, sf_dir, "measurements"))),
        "requests": request_table,
        "cross_sections": lambda: quality_index.section_indices(cleaning.section_summary(view(spark, sf_dir, "vertices"))),
        "stations": lambda: stations(spark, sf_dir),
    }


def indexed_stations(store: Store, version: int | None = None) -> DataFrame:
    """The station index of a version of stored summaries."""
    base, *summaries = (store.read(n, version) for n in ("stations", "measurements", "coverage", "diagnostics", "rating_curves", "cross_sections", "requests"))
    counts = ["n_measurements", "n_rating_curves", "n_cross_sections", "n_cross_section_vertices"]
    rows = quality_index.with_scores(quality_index.assemble(base, summaries, hint="merge")).fillna(0, counts)
    has = {n: F.col(c) > 0 for n, c in (("has_measurements", "n_measurements"), ("has_rating_curves", "n_rating_curves"), ("has_cross_sections", "n_cross_sections"), ("has_diagnostics", "n_measurements"))}
    group = display.map_group(F.col("has_measurements"), F.col("has_rating_curves"))
    label = display.search_label(F.col("station_code"), F.col("station_name"), municipality=F.col("municipality"))
    return rows.withColumns(has).select("station_code", "station_name", "has_measurements", "has_rating_curves", "has_cross_sections", "preliminary_information_score", "n_measurements", "n_rating_curves", "n_cross_sections", "n_cross_section_vertices", "n_routes", "n_attempts", "map_status", display.map_group_label(group).alias("map_group_label"), label.alias("station_search_label"), "has_diagnostics")


@query("SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS station_code, s_name AS station_name, CASE WHEN s_suppkey % 2 = 0 THEN 'SP' ELSE 'MG' END AS uf, round(s_acctbal / 100, 6) AS latitude, CAST(NULL AS DOUBLE) AS longitude, s_suppkey % 3 = 0 AS is_operating, CASE WHEN s_suppkey % 5 <> 0 THEN DATE '1990-01-01' END AS discharge_start_date, s_suppkey % 5 <> 0 AS has_discharge_measurements, false AS has_rainfall_data, true AS missing_coordinates FROM supplier")
def station_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    raw = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        k.cast("string").alias("codigoestacao"), F.concat(F.lit("  "), F.regexp_replace("s_name", "#", " # "), F.lit(" ")).alias("Estacao_Nome"), F.when(k % 2 == 0, " sp").otherwise("mg").alias("UF_Estacao"),
        F.translate((F.col("s_acctbal") / 100).cast("decimal(20,8)").cast("string"), ".", ",").alias("Latitude"), F.when(k % 3 == 0, "1").otherwise("0").alias("Operando"), F.when(k % 5 != 0, "01/01/1990").alias("Data_Periodo_Desc_Liquida_Inicio"),
    )
    rows = quality_index.station_dimension(raw)
    return rows.select("station_code", F.regexp_replace("station_name", " # ", "#").alias("station_name"), "uf", "latitude", "longitude", "is_operating", "discharge_start_date", "has_discharge_measurements", "has_rainfall_data", "missing_coordinates")


@query(f"WITH {cte('stations')}, {cte('measurements')} SELECT station_code, station_name, count(measurement_id) AS n_measurements FROM stations LEFT JOIN measurements USING (station_code) GROUP BY ALL")
def measured_stations_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view joined in SQL, as the published database offers it."""
    return sinks.create_views(spark, {"v_stations": view(spark, sf_dir, "stations"), "v_measurements": view(spark, sf_dir, "measurements")}).sql("SELECT s.station_code, s.station_name, count(m.measurement_id) AS n_measurements FROM v_stations s LEFT JOIN v_measurements m ON m.station_code = s.station_code GROUP BY s.station_code, s.station_name")


@query(f"WITH {cte('stations')} SELECT station_code, round(latitude, 3) AS latitude, round(drainage_area, 3) AS drainage_area FROM stations WHERE station_code IN ('00000003', '00000005')")
def key_filtered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stations by code, numbers rounded as exports have them."""
    return readers.station_rows(view(spark, sf_dir, "stations"), "00000003").union(readers.station_rows(view(spark, sf_dir, "stations"), "00000005")).select("station_code", F.round("latitude", 3).alias("latitude"), F.round("drainage_area", 3).alias("drainage_area"))


@query(f"WITH {cte('stations')} SELECT DISTINCT nation_key FROM stations")
def distinct_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.distinct_columns(view(spark, sf_dir, "stations"), ["nation_key", "absent"])


@query(f"WITH {cte('request_log')}, t AS (SELECT DISTINCT station_code FROM request_log), r AS (SELECT unnest(['click', 'error']) AS route_name), d AS (SELECT unnest([DATE '2024-01-01', DATE '2024-02-01']) AS date_start) SELECT station_code, route_name, date_start FROM t, r, d EXCEPT SELECT station_code, route_name, date_start FROM request_log")
def remaining_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned requests, stations by routes by windows, that the log does not have."""
    log = view(spark, sf_dir, "request_log")
    tasks = cleaning.task_windows(log.select("station_code").distinct(), ("click", "error"), "2024-01-01", "2024-03-02", 31)
    return cleaning.remaining_tasks(tasks.select("station_code", "route_name", "date_start"), log)


# texts of values, the downloads of duration curves, low flows beside issues

_VALUES = {"x": "o_totalprice * o_totalprice / 997.3", "frac_x": "(o_orderkey % 997) / 997.0", "latitude": "CAST(o_totalprice / 997.3 AS DOUBLE) % 90 - 45", "has_x": "CASE o_orderkey % 4 WHEN 0 THEN 'Sim' WHEN 1 THEN 'NO' WHEN 2 THEN '' ELSE 'talvez' END", "valid_from": "CASE WHEN o_orderkey % 5 = 0 THEN 'sem data' ELSE CAST(o_orderkey % 20 + 10 AS STRING) || '/03/1999' END", "measured": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END"}
_STRIP = "regexp_replace({0}, '\\.?0+$', '')"


@query(
    f"""WITH v AS (SELECT o_orderkey AS id, {", ".join(f"{sql} AS {n}" for n, sql in _VALUES.items())} FROM orders), w AS (SELECT *, CAST(round_even(abs(latitude) * 3600, 0) AS BIGINT) AS s FROM v)
SELECT id, CASE WHEN x < 1000 THEN {_STRIP.format("printf('%.3f', x)")} WHEN round(x, 2) >= 1e6 THEN format('{{:,.0f}}', x) WHEN round(x, 2) >= 1e5 THEN {_STRIP.format("format('{:,.1f}', x)")} ELSE {_STRIP.format("format('{:,.2f}', x)")} END AS x, printf('%.1f', 100 * frac_x) || '%' AS frac_x,
       printf('%02d° %02d'' %02d" ', s // 3600, s // 60 % 60, s % 60) || CASE WHEN latitude >= 0 THEN 'N' ELSE 'S' END AS latitude, CASE has_x WHEN 'NO' THEN 'Não' WHEN '' THEN '—' ELSE has_x END AS has_x,
       CASE WHEN id % 5 = 0 THEN valid_from ELSE '1999-03-' || CAST(id % 20 + 10 AS VARCHAR) END AS valid_from, coalesce(CAST(measured AS VARCHAR), '—') AS measured FROM w"""
)
def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of all kinds as the station's card shows them."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), *(F.expr(sql).alias(n) for n, sql in _VALUES.items()))
    kinds = dict(rows.dtypes)
    return rows.select("id", *(display.value_text(n, kinds[n]).alias(n) for n in _VALUES))


@query(
    f"""WITH {ROLLING}, u AS (SELECT station_code, 'Anual' AS escala, q_mean AS q FROM annual WHERE q_mean IS NOT NULL UNION ALL SELECT station_code, 'Mensal', q_mean FROM monthly WHERE q_mean IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY station_code, escala ORDER BY q DESC) AS i, count(*) OVER (PARTITION BY station_code, escala) AS n FROM u WHERE station_code IN (SELECT station_code FROM eligible)),
k AS (SELECT DISTINCT station_code, escala, n, CAST(g AS DOUBLE) AS pp, least(greatest(CAST(floor(g * n / 100) AS BIGINT), 1), n) AS i FROM s, range(1, 101) r(g))
SELECT k.station_code, k.escala, pp AS permanencia_pct, round(a.q + least(greatest(pp * k.n / 100 - k.i, 0.0), 1.0) * (b.q - a.q), 3) AS vazao_m3s
FROM k JOIN s a ON a.station_code = k.station_code AND a.escala = k.escala AND a.i = k.i JOIN s b ON b.station_code = k.station_code AND b.escala = k.escala AND b.i = least(k.i + 1, k.n)"""
)
def duration_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The download of duration curves of annual and monthly means."""
    grid = flow_grid(spark, sf_dir)
    return sinks.duration_export(flow.monthly_stats(grid), flow.annual_stats(grid))


def _ratio(terms: tuple, x: str) -> str:
    def polynomial(t: tuple) -> str:
        out = f"{t[-1]!r}::DOUBLE"
        for k in reversed(t[:-1]):
            out = f"({out} * {x} + {k!r}::DOUBLE)"
        return out

    return f"({polynomial(terms[0])} / {polynomial(terms[1])})"


@query(
    f"""WITH {FLOW}, g AS (SELECT unnest({flow.probabilities()})::DOUBLE AS permanence_pct), p AS (SELECT *, least(greatest(permanence_pct, 0.1), 99.9) / 100 AS p FROM g), r AS (SELECT *, p - 0.5 AS q, 0.180625 - (p - 0.5) * (p - 0.5) AS c, sqrt(-ln(least(p, 1 - p))) - 1.6 AS t FROM p)
SELECT station_code, permanence_pct, round(CASE WHEN abs(q) <= 0.425 THEN q * {_ratio(flow.NORMAL_CENTRE, "c")} ELSE sign(q) * {_ratio(flow.NORMAL_TAIL, "t")} END, 6) AS axis FROM r, (SELECT DISTINCT station_code FROM grid_flow WHERE q IS NOT NULL)"""
)
def duration_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the points of the duration curves lie on a normal probability axis."""
    return flow.flow_duration(flow_grid(spark, sf_dir)).select("station_code", "permanence_pct", flow.normal_axis("permanence_pct").alias("axis"))


@query(
    f"""WITH {ISSUES}, l0 AS (SELECT station_code, date, year(date) AS year, q FROM grid_flow), l1 AS (SELECT *, CASE WHEN count(q) OVER v = 7 THEN sum(q) OVER v / 7 END AS q7 FROM l0 WINDOW v AS (PARTITION BY station_code, year ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
l2 AS (SELECT station_code, year, min(q7) AS least_q FROM l1 GROUP BY ALL), l3 AS (SELECT l2.station_code, l2.year, min(date) AS date_end FROM l2 LEFT JOIN l1 ON l1.station_code = l2.station_code AND l1.year = l2.year AND abs(q7 - least_q) < 1.5e-8 GROUP BY ALL)
SELECT l3.station_code, l3.year, date_end, count(iss.date) AS n_consistency_issues_on_min_window, coalesce(string_agg(DISTINCT label, '; ' ORDER BY label), '') AS consistency_issue_types_on_min_window, count(iss.date) > 0 AS flag_consistency_issue_on_min_window
FROM l3 LEFT JOIN iss ON iss.station_code = l3.station_code AND iss.date BETWEEN date_end - 6 AND date_end GROUP BY ALL"""
)
def low_flow_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-day minima with the issues within their windows."""
    rows = extremes.low_flows(flow_grid(spark, sf_dir), 7, issues(spark, sf_dir))
    return rows.select("station_code", "year", "date_end", "n_consistency_issues_on_min_window", "consistency_issue_types_on_min_window", "flag_consistency_issue_on_min_window")
