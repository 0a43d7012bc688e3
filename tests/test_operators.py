import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.operators import cleaning, curves, daily, diagnostics, extremes, flow, quality_index, rainfall

D0 = date(2000, 1, 1)


def days(spark, values, station="1", start=D0, name="discharge_m3s"):
    return spark.createDataFrame([(station, start + timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)], f"station_code string, date date, {name} double")


def test_month_rows(spark):
    wide = spark.createDataFrame([("123", "01/02/2021", "1", "0", "1", "2", "3", "1")], "EstacaoCodigo string, Data string, NivelConsistencia string, MediaDiaria string, Vazao28 string, Vazao29 string, Vazao30 string, Vazao28Status string")
    rows = daily.normalize_month_rows(wide, "discharge").collect()
    assert [(r["station_code"], r["date"], r["value"], r["source_status"], r["unit"]) for r in rows] == [("00000123", date(2021, 2, 28), 1.0, "1", "m3/s")]
    with pytest.raises(ValueError):
        daily.normalize_month_rows(wide, "stage")


def test_merge(spark):
    rows = [("1", "discharge", D0, 5.0, "1", None, None, 1), ("1", "discharge", D0, None, "2", None, None, 2), ("1", "discharge", D0, 7.0, "2", None, None, 3), ("1", "discharge", D0, 9.0, "", None, None, 4)]
    r = daily.merge_daily(spark.createDataFrame(rows, "station_code string, variable string, date date, value double, consistency_level string, daily_flag string, source_status string, o int"), ["o"]).collect()
    assert [(x["value"], x["n_source_records"], x["max_same_consistency_records"], x["has_duplicate_same_consistency"]) for x in r] == [(7.0, 4, 2, True)]


def test_sequent_peak_is_the_recursion(spark):
    rng = random.Random(3)
    volumes = [rng.uniform(0, 20) for _ in range(60)]
    rows = [("1", 2000 + i // 12, 1 + i % 12, 30, v) for i, v in enumerate(volumes)]
    months = spark.createDataFrame([(s, y, m, n, 30, 0, 0.0, q, q, q) for s, y, m, n, q in rows], "station_code string, year int, month int, days_in_period bigint, days_with_value bigint, days_missing bigint, failure_pct double, q_mean double, q_min double, q_max double")
    annual = months.groupBy("station_code", "year").agg(F.avg("q_mean").alias("q_mean"))
    series = days(spark, volumes)
    got = {(r["cenario"], r["demand_pct_qmlt"]): r["regularization_volume_hm3"] for r in flow.regularization(series, months, annual, (50, 100)).collect()}
    mean = sum(volumes) / len(volumes)
    for pct in (50, 100):
        d = top = 0.0
        for v in volumes:
            d = max(0.0, d + (mean * pct / 100 - v) * 30 * 86400 / 1e6)
            top = max(top, d)
        assert math.isclose(got["Série completa", pct], top, abs_tol=1e-9)
    assert ("5 anos mais secos", 50) in got


def test_flow_duration(spark):
    got = {r["permanence_pct"]: r["discharge_m3s"] for r in flow.flow_duration(days(spark, [2, 4, None, 1, 3]), [10, 37.5, 100]).collect()}
    assert got == {10: 4, 37.5: 3.5, 100: 1}
    assert {r["discharge_m3s"] for r in flow.flow_duration(days(spark, [5]), [1, 99]).collect()} == {5.0}
    assert flow.flow_duration(days(spark, [None])).count() == 0


def test_pot_declustering(spark):
    values = [0.5] * 20
    for i in (0, 7, 15):
        values[i] = 10 + i
    limits = spark.createDataFrame([("1", 5.0)], "station_code string, threshold_m3s double")
    events = extremes.pot_events(days(spark, values), limits).orderBy("event_id").collect()
    assert [(e["date_start"], e["date_peak"], e["n_exceedance_days"]) for e in events] == [(D0, D0 + timedelta(days=7), 2), (D0 + timedelta(days=15), D0 + timedelta(days=15), 1)]


def test_numeric_helpers():
    assert math.isclose(extremes.chi2_quantile(0.025, 10), 3.24697, abs_tol=1e-4)
    assert math.isclose(extremes.chi2_quantile(0.975, 10), 20.48318, abs_tol=1e-4)
    assert extremes.kendall_p([1, 2, 3, 4, 5, 6, 7, 8], [1, 2, 3, 4, 5, 6, 7, 8]) < 0.001
    assert extremes.kendall_p([1, 1, 1], [1, 2, 3]) is None
    none = extremes.series_tests([], [], [], 2000, 2001)
    assert none["selection_ok"] is False and none["n_events"] == 0


def test_low_flow_against_loop(spark):
    rng = random.Random(5)
    values = [None if rng.random() < 0.05 else rng.uniform(1, 9) for _ in range(800)]
    got = {r["year"]: r for r in extremes.low_flows(days(spark, values), 7).collect()}
    dates = [D0 + timedelta(days=i) for i in range(800)]
    for year in (2000, 2001, 2002):
        best = None
        for i in range(6, 800):
            w = values[i - 6 : i + 1]
            if dates[i].year == dates[i - 6].year == year and None not in w and (best is None or sum(w) / 7 < best[0] - 1e-9):
                best = (sum(w) / 7, dates[i])
        assert math.isclose(got[year]["q_min_nday_m3s"], best[0], abs_tol=1e-9) and got[year]["date_end"] == best[1]
    assert extremes.low_flows(days(spark, values), 9).first()["duration_days"] == 7


def test_candidate_to_exclusion(spark):
    frames = [days(spark, [y + 1] * (243 if y == 0 else 365), start=date(1990 + y, 10, 1)) for y in range(8)]
    grid = daily.complete_grid(frames[0].union(frames[1]).union(frames[2]).union(frames[3]).union(frames[4]).union(frames[5]).union(frames[6]).union(frames[7]))
    got = {r["hydrological_year"]: r for r in extremes.annual_maxima(grid).collect()}
    assert got[1991]["rank_ascending"] == 1 and got[1991]["flag_papalexiou_candidate"] and not got[1992]["flag_papalexiou_candidate"]


CURVE = "station_code string, rating_curve_id string, rating_curve_segment_id string, segment_number int, valid_from date, valid_to date, stage_min_cm double, stage_max_cm double, coefficient_a double, coefficient_h0 double, coefficient_n double"


def match(spark, stage, rows, discharge=8.0):
    d = spark.createDataFrame([("1", D0, discharge, stage)], "station_code string, date date, discharge_m3s double, stage_cm double")
    return curves.match_daily(d, spark.createDataFrame(rows, CURVE)).first()


def test_curve_match(spark):
    base = ("1", "A", "A1", 1, date(1999, 1, 1), None, 0.0, 300.0, 2.0, 0.5, 2.0)
    r = match(spark, 250.0, [base])
    assert r["q_generated_m3s"] == 8.0 and not r["q_generation_error"] and r["relative_error"] == 0
    r = match(spark, 40.0, [base])
    assert r["q_generated_m3s"] is None and r["q_generation_error"]
    r = match(spark, 250.0, [base, ("1", "B", "B1", 1, date(1999, 6, 1), None, 0.0, 300.0, 1.0, 0.5, 2.0), ("1", "C", "C1", 1, None, None, 0.0, 300.0, 1.0, 0.5, 2.0)])
    assert r["rating_curve_segment_id"] == "B1" and r["ambiguous_curve_day"]
    r = match(spark, 250.0, [])
    assert r["discharge_without_curve"] and not r["discharge_before_first_curve"] and not r["discharge_after_last_curve"]
    r = match(spark, 250.0, [("1", "A", "A1", 1, date(2001, 1, 1), date(2002, 1, 1), 0.0, 300.0, 2.0, 0.5, 2.0)])
    assert r["discharge_before_first_curve"] and r["discharge_without_curve"]


def test_overlaps(spark):
    rows = [("1", "a", date(2000, 1, 1), None), ("1", "b", date(2005, 1, 1), date(2006, 1, 1)), ("1", "c", date(1990, 1, 1), date(1999, 12, 31)), ("2", "d", None, None)]
    got = {r[0]: r[1] for r in curves.overlap_pairs(spark.createDataFrame(rows, "station_code string, rating_curve_id string, valid_from date, valid_to date")).collect()}
    assert got == {"1": 1, "2": 0}


def rain(spark, values):
    merged = days(spark, values, name="value").withColumns({"variable": F.lit("rainfall"), "source_status": F.lit(None).cast("string"), "consistency_level": F.lit("1"), "daily_flag": F.lit(None).cast("string"), "n_source_records": F.lit(1), "max_same_consistency_records": F.lit(1), "has_duplicate_same_consistency": F.lit(False)})
    return rainfall.rain_days(merged)


def test_rain(spark):
    empty = rainfall.annual_indices(rain(spark, [None] * 10)).first()
    assert (empty["total_mm"], empty["rx1day_mm"], empty["sdii_mm_per_wet_day"], empty["cdd_days"]) == (0, None, None, 0)
    codes = lambda v: {r["code"] for r in rainfall.rain_issues(rain(spark, v)).collect()}
    assert "very_high" in codes([400.0]) and "very_high" not in codes([399.9])
    assert "zero_run" in codes([0.0] * 30) and "zero_run" not in codes([0.0] * 29)
    assert "repeated" in codes([2.04, 2.0, 1.96]) and "repeated" not in codes([2.0, 2.0])
    assert codes([-1.0, None, 1.0]) == {"negative", "missing"}


def test_measurement_flags(spark):
    schema = "station_code string, measurement_id int, stage_cm double, discharge_m3s double"
    rows = [("1", i, 100.0, q) for i, q in enumerate((1.0, 1.1, 1.2, 1.4, 1.5))]
    assert all(r["repeated_stage_flag"] for r in diagnostics.measurement_flags(spark.createDataFrame(rows, schema)).collect())
    assert not any(r["repeated_stage_flag"] for r in diagnostics.measurement_flags(spark.createDataFrame(rows[:4], schema)).collect())


def test_summary_of_station_without_measurements(spark):
    flags = diagnostics.measurement_flags(spark.createDataFrame([], "station_code string, measurement_id int, stage_cm double, discharge_m3s double"))
    r = diagnostics.diagnostic_summary(flags, spark.createDataFrame([("1", "a", "a1")], "station_code string, rating_curve_id string, rating_curve_segment_id string")).first()
    assert r["diagnostic_attention_score"] is None and r["diagnostic_attention_class"] == "high_attention" and r["n_rating_curves"] == 1


def test_regimes_find_a_shift():
    start = date(1980, 1, 1).toordinal()
    at = np.array([start + 90 * i for i in range(120)])
    rng = np.random.default_rng(0)
    r = np.where(np.arange(120) < 60, 0.0, 0.8) + rng.normal(0, 0.05, 120)
    found, evidence = diagnostics.find_regimes(at, r)
    assert found["n_regimes"] == 2 and evidence == "strong_evidence"
    assert diagnostics.find_regimes(at, rng.normal(0, 0.05, 120))[0]["n_regimes"] == 1


def test_cleaning(spark):
    t = "2000-01-01 00:00:00"
    rows = [("1", 1, t, 1, None), ("1", 2, t, 2, "2020-01-01 00:00:00"), ("1", 3, t, 2, None), ("1", 4, None, 1, None), ("2", 5, t, None, None)]
    m = spark.createDataFrame(rows, "station_code string, measurement_id int, measurement_datetime string, consistency_level int, last_update string")
    got = {r["measurement_id"]: r["removed_reason"] for r in cleaning.clean_measurements(m).collect()}
    assert got == {1: "lower_consistency_level", 2: None, 3: "older_duplicate", 4: "missing_datetime", 5: None}


def test_date_clusters():
    d = D0
    got = cleaning.cluster_dates([d, d + timedelta(4), d + timedelta(6), d + timedelta(12)])
    assert got == [(d - timedelta(1), d + timedelta(7), 3), (d + timedelta(11), d + timedelta(13), 1)]


def test_request_windows(spark):
    log = spark.createDataFrame([("1", "r", D0, 1, False, 500.0), ("1", "r", D0, 2, True, 200.0), ("1", "r", date(2001, 1, 1), 3, False, 500.0)], "station_code string, route_name string, date_start date, row_id int, success boolean, http_status double")
    w = cleaning.window_status(log)
    assert [r["date_start"] for r in cleaning.retry_candidates(w).collect()] == [date(2001, 1, 1)]
    assert cleaning.route_status(w).first()["status"] == "partial"
    tasks = cleaning.task_windows(spark.createDataFrame([("1",)], "station_code string"), ["r", "s"], "2000-01-01", "2002-01-01")
    assert tasks.count() == 4 and cleaning.remaining_tasks(tasks, log).count() == 2


def test_score_parts_reach_100(spark):
    s = spark.createDataFrame([("1", "n", "m", "b", 1.0, 1.0, 5.0), ("2", None, None, None, None, None, None)], "station_code string, station_name string, municipality string, basin_name string, latitude double, longitude double, drainage_area double")
    m = spark.createDataFrame([("1", 100, 30, 1.0, 1.0)], "station_code string, n_measurements int, n_years_with_measurements int, pct_stage_values double, pct_discharge_values double")
    c = spark.createDataFrame([("1", 9, 40, 0)], "station_code string, n_rating_curves int, n_rating_curve_segments int, n_overlapping_pairs int")
    x = spark.createDataFrame([("1", 3)], "station_code string, n_cross_sections int")
    got = {r["station_code"]: r for r in quality_index.information_score(s, m, c, x).collect()}
    assert got["1"]["preliminary_information_score"] == 100 and got["2"]["preliminary_information_score"] == 0 and got["2"]["map_status"] == "missing_coordinates"


def test_empty_tables(spark):
    none = days(spark, [])
    assert flow.annual_stats(none).count() == 0 and extremes.annual_maxima(daily.complete_grid(none)).count() == 0 and extremes.low_flows(none).count() == 0


def test_display(spark):
    from fluvia.operators import display

    r = spark.createDataFrame([("1", x / 100) for x in range(101)] + [("2", 1.0)] * 9 + [("3", 1.0)], "k string, r double")
    assert [(x["k"], round(x["lower"], 6), round(x["upper"], 6)) for x in display.residual_axis_limits(r, "r", ["k"]).collect()] == [("1", 0.0, 0.99)]
    data, use = display.acquisition_scope(F.lit(True), F.lit(False), F.lit(None).cast("boolean"))
    assert tuple(spark.range(1).select(data, use).first()) == ("Parcial — sem cotas e curvas-chave",) * 2
    s = spark.createDataFrame([("1", True, False), ("2", False, True), ("3", False, False)], "station_code string, a boolean, b boolean")
    got = display.visible(s, {"a": F.col("a"), "b": F.col("b")}, ["b", "a"]).collect()
    assert [(x["station_code"], x["visible_layer"]) for x in got] == [("1", "a"), ("2", "b")]
    assert spark.range(1).select(display.layer_priority(display.map_layer(F.lit(True), F.lit(True), F.lit(True), F.lit(False)))).first()[0] == 4


def test_results_combine(spark):
    rows = days(spark, [1, 2], name="value").withColumn("variable", F.lit("discharge"))
    both = daily.combine([daily.SeriesResult("ana_xml", "a", rows, ["x"]), daily.SeriesResult("ana_json", "b", rows.withColumn("variable", F.lit("stage")))])
    assert both.of("stage").count() == 2 and both.source_label == "a + b" and both.notes == ["x"]
    assert daily.single_station(both.records, "001") == "1"
    with pytest.raises(ValueError):
        both.require("rainfall")
    with pytest.raises(ValueError):
        daily.combine([])


def test_first_row_of_an_inventory_stays(spark):
    from fluvia.operators import cleaning

    rows = [(1, "a", "zeta", 5.0), (2, "a", "alpha", 9.0)]
    kind = "n int, station_code string, station_name string, altitude double"
    api, empty = spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)
    assert cleaning.consolidate_inventories(api, empty, empty, ordinal="n").first()["station_name"] == "zeta"
    assert cleaning.consolidate_inventories(empty, api, api, temporal=["altitude"], ordinal="n").first()["altitude"] == 5.0
    assert cleaning.consolidate_inventories(*(x.drop("n") for x in (api, empty, empty))).first()["station_name"] == "alpha"


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from fluvia import session

    class Nothing:
        def isDefined(self):
            return False

    conf = SimpleNamespace(get=lambda *a: None)
    inner = SimpleNamespace(getCheckpointDir=lambda: Nothing())
    context = SimpleNamespace(getConf=lambda: conf, _jsc=SimpleNamespace(sc=lambda: inner), master="spark://host:7077", applicationId="x")
    try:
        session.scratch_dir(SimpleNamespace(sparkContext=context, conf=conf))
    except RuntimeError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError("a cluster without a shared folder must raise")


def test_log_rows_are_appended(spark, tmp_path):
    from fluvia.sources import sinks

    for i in range(3):
        sinks.append_rows(spark.createDataFrame([(i, "ok")], "n int, status string"), str(tmp_path / "log"))
    assert sorted(r["n"] for r in spark.read.option("header", True).csv(str(tmp_path / "log")).collect()) == ["0", "1", "2"]
