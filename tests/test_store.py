"""Stored products, counters, validation, station files, captured errors, day grids and thresholds against plain versions."""

import csv
import datetime as dt
import hashlib
import io
import random
import statistics
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fluvia.functions import columns, tables
from fluvia.operators import cleaning, curves, daily, diagnostics, display, extremes, flow, metrics, quality_index
from fluvia.plans import catalog_extra
from fluvia.plans.bindings import view
from fluvia.sources import exports, sinks
from fluvia.sources.store import Conflict, Store

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# snapshots


def test_versions_keep_what_they_had(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.versions() == [] and store.tables() == {}
    a = spark.createDataFrame([("1", 5), ("2", 6), (None, 7)], "station_code string, n int")
    b = spark.createDataFrame([("1", 1.5), ("3", None)], "station_code string, x double")
    assert store.commit({"a": a, "b": b}, buckets=4) == 1
    assert store.commit({"a": a.where("n > 5"), "empty": a.limit(0)}, buckets=4, base=1) == 2
    assert rows_of(store.read("a", 1)) == rows_of(a) and rows_of(store.read("a")) == rows_of(a.where("n > 5"))
    assert rows_of(store.read("b")) == rows_of(b) and store.read("empty").count() == 0
    assert {n: t.rows for n, t in store.tables(1).items()} == {"a": 3, "b": 2} and {n: t.rows for n, t in store.tables().items()} == {"a": 2, "b": 2, "empty": 0}
    with pytest.raises(Conflict):
        store.commit({"a": a}, base=1)
    assert store.versions() == [1, 2]
    assert store.commit({"a": a}, buckets=4, remove=["empty"]) == 3 and set(store.tables()) == {"a", "b"}
    with pytest.raises(KeyError):
        store.tables(9)
    gone = store.vacuum(keep=1)
    assert store.versions() == [3] and len(gone) == 4 and rows_of(store.read("b")) == rows_of(b)  # a of 1 and 2, the table that is not in 3, what the conflict left


def test_a_writer_that_dies_leaves_readers_on_the_old_version(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    old = spark.createDataFrame([("1", 1), ("2", 2)], "station_code string, n int")
    store.commit({"a": old, "b": old}, buckets=2)
    new = old.withColumn("n", F.col("n") + 10)
    fail = F.udf(lambda n: 1 // 0, "int")
    with pytest.raises(Exception, match="ZeroDivisionError"):  # the second table cannot be written
        store.commit({"a": new, "b": new.withColumn("n", fail("n"))}, buckets=2)
    assert store.versions() == [1] and rows_of(store.read("a")) == rows_of(old)
    with monkeypatch.context() as m:  # both tables are there, the manifest is not
        m.setattr(Store, "_write", lambda self, path, data, overwrite: (_ for _ in ()).throw(OSError("killed")) if not path.endswith(".lock") else None)
        with pytest.raises(OSError, match="killed"):
            store.commit({"a": new, "b": new}, buckets=2)
    assert store.versions() == [1] and rows_of(store.read("a")) == rows_of(old) and rows_of(store.read("b")) == rows_of(old)
    assert store.commit({"a": new, "b": new}, buckets=2) == 2
    assert rows_of(store.read("a")) == rows_of(new) and rows_of(Store(spark, store.folder).read("b", 1)) == rows_of(old)


def test_the_cascade_has_no_exchange_and_a_station_opens_one_bucket(spark):
    df = entry.queries()["full_station_index"](spark, SF)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    store = Store(spark, f"{catalog_extra.scratch_dir(spark)}/one-station")
    store.commit({"measurements": view(spark, SF, "measurements")}, buckets=8)
    one = store.read("measurements").where("station_code = '00000001'")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan of a lone scan does not tell
    plan = one._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 8" in plan
    assert one.count() == view(spark, SF, "measurements").where("station_code = '00000001'").count()


def test_light_counts_equal_the_flags(spark):
    """Sums of groups count what flagged rows count, nulls, zeros and repeated rows included."""
    rng = random.Random(4)
    days = [dt.datetime(2000 + i % 6, 1 + i % 12, 1 + i % 28, i % 24) for i in range(400)]
    rows = [(f"s{rng.randrange(5)}", d, rng.choice([None, -1.0, 0.0, 10.0, 10.004, 20.0, float("nan")]), rng.choice([None, 0.0, 1.0, 1.0004, 2.0, 5.5, -3.0])) for d in days]
    rows += [("none", None, None, None)] * 3 + rows[:30]
    m = spark.createDataFrame(rows, "station_code string, measurement_datetime timestamp_ntz, stage_cm double, discharge_m3s double")
    names = ("n_valid_measurements", "n_stage_zero", "n_discharge_zero", "n_repeated_stage", "n_repeated_discharge")
    no_curves = m.limit(0).select("station_code", F.lit("c").alias("rating_curve_id"), F.lit("s").alias("rating_curve_segment_id"))
    want = diagnostics.diagnostic_summary(diagnostics.measurement_flags(m), no_curves).select("station_code", *names)
    assert rows_of(diagnostics.light_counts(m).select("station_code", *names)) == rows_of(want)
    assert any(r["n_repeated_stage"] for r in want.collect()) and any(r["n_repeated_discharge"] for r in want.collect())


# counters and constraints


def test_counters_and_constraints(spark):
    rows = [("a", dt.datetime(2000, 1, 1), 1, None, 1, 5.0), ("a", dt.datetime(2000, 1, 1), 2, None, 2, -1.0), ("a", None, 1, None, 3, 2.0), ("b", dt.datetime(2001, 1, 1), None, None, 4, None), ("b", dt.datetime(2001, 1, 1), 1, dt.date(2000, 1, 1), 5, 3.0)]
    m = spark.createDataFrame(rows, "station_code string, measurement_datetime timestamp_ntz, consistency_level int, last_update date, measurement_id int, discharge_m3s double")
    made = metrics.counted(cleaning.clean_measurements(m), "measurements")
    made.rows.write.format("noop").mode("overwrite").save()
    assert made.values() == {"n_raw_records": "5", "n_total_records_removed": "3", "n_removed_missing_datetime": "1", "n_removed_lower_consistency_level": "1", "n_removed_older_duplicate": "1", "n_final_records": "2", "n_missing_station_code": "0", "n_missing_measurement_datetime": "0", "n_missing_consistency_level": "0", "n_missing_discharge_m3s": "0", "n_negative_discharge_m3s": "1", "first_measurement_datetime": "2000-01-01 00:00:00", "last_measurement_datetime": "2001-01-01 00:00:00"}
    tables = {"m": m, "s": spark.createDataFrame([("a",), ("a",), (None,)], "station_code string")}
    wanted = {"m": [metrics.Unique(("station_code", "measurement_datetime")), metrics.NotNull(("last_update", "discharge_m3s")), metrics.Holds("positive", "discharge_m3s > 0"), metrics.Linked(("station_code",), "s")], "s": [metrics.Unique(("station_code",))], "gone": [metrics.NotNull(("x",))]}
    found = metrics.validate(tables, wanted)
    assert {(r["table_name"], r["constraint_name"]): (r["n_rows"], r["n_failures"]) for r in found.collect()} == {("m", "unique:station_code,measurement_datetime"): (5, 2), ("m", "not_null:last_update,discharge_m3s"): (5, 4), ("m", "holds:positive"): (5, 2), ("m", "link:station_code->s"): (5, 2), ("s", "unique:station_code"): (3, 1), ("gone", "not_null:x"): (None, None)}
    assert not metrics.accepted(found) and metrics.accepted(metrics.validate(tables, {"s": [metrics.Holds("any", "true")]}))
    assert metrics.validate({"m": m.limit(0)}, {"m": wanted["m"][:3]}).where("n_failures = 0").count() == 3


# station files


def text_of(path):
    return path.read_bytes().decode("utf-8-sig"), path.read_bytes().startswith(b"\xef\xbb\xbf")


def test_station_files(spark, tmp_path):
    annual = spark.createDataFrame([("2", 2001, 1.23456, 365, 0.0), ("1", 2000, None, 1, 99.7), ("1", 1999, 2.0005, 3, 1e-9), (None, 1999, 1.0, 1, 1.0)], "station_code string, year int, q_mean double, days_with_value int, failure_pct double")
    codes = spark.createDataFrame([("1",), ("2",), ("9",)], "station_code string")
    day = dt.date(2024, 1, 31)
    exports.export_stations(annual, "annual", str(tmp_path), day=day, order_by=["year"], stations=codes)
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"vazoes_medias_anuais_{s}_20240131.csv" for s in "129"]
    text, bom = text_of(tmp_path / "vazoes_medias_anuais_1_20240131.csv")
    assert bom and list(csv.reader(io.StringIO(text), delimiter=";")) == [["ano", "q_media_m3s", "dias_com_vazao", "falhas_pct"], ["1999", "2,0", "3", "0,0"], ["2000", "", "1", "99,7"]]
    assert text_of(tmp_path / "vazoes_medias_anuais_9_20240131.csv")[0].splitlines() == ["mensagem", sinks.NOTHING["annual"]]
    exports.export_stations(codes.withColumns({"A b": F.lit('x;"y'), "ok": F.lit(True)}), "station_summary", f"file://{tmp_path}/s")
    assert text_of(tmp_path / "s" / "station_9_summary.csv") == ('station_code,A b,ok\r\n9,"x;""y",TRUE\r\n', False)
    with pytest.raises(ValueError, match="no download"):
        exports.export_stations(annual, "nothing", str(tmp_path))


@pytest.mark.parametrize("kind", exports.KINDS)
def test_every_download_has_a_file(spark, tmp_path, kind):
    names = list(sinks.HEADINGS.get(kind, {"a": ""}))
    df = spark.createDataFrame([("7", *["v"] * len(names))], ", ".join(f"`{n}` string" for n in ["station_code", *(n for n in names if n != "station_code")]) if "station_code" not in names else "station_code string, " + ", ".join(f"`{n}` string" for n in names if n != "station_code") + ", z string")
    exports.export_stations(df, kind, str(tmp_path), day=dt.date(2024, 1, 31), duration_days=7 if kind == "low_flow" else None)
    files = list(tmp_path.iterdir())
    assert len(files) == 1 and "7" in files[0].name and len(text_of(files[0])[0].splitlines()) == 2
    assert len(exports.KINDS) == 18


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    bad = F.udf(lambda n: 1 // (n - 150), "int")
    df = spark.range(200).select(F.col("id").cast("string").alias("station_code"), bad("id").alias("x"))
    with pytest.raises(Exception, match="ZeroDivisionError"):
        exports.export_stations(df, "rain_annual", str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").rglob("*.csv")) == []


def test_station_exports_against_single_files(spark, tmp_path):
    """The distributed files are those that the driver would write one by one."""
    found = {r["file"]: r["n_bytes"] for r in entry.queries()["station_exports"](spark, SF).collect()}
    grid = catalog_extra.flow_grid(spark, SF)
    annual = flow.annual_stats(grid)
    stations = sorted(r["station_code"] for r in catalog_extra.stations(spark, SF).select("station_code").collect())
    assert {f"vazoes_medias_anuais_{s}_20240131.csv" for s in stations} <= set(found)
    for code in sorted(r[0] for r in annual.select("station_code").distinct().collect()):
        path = Path(tmp_path) / f"vazoes_medias_anuais_{code}_20240131.csv"
        sinks.write_localized_csv(sinks.to_export(annual.where(F.col("station_code") == code).orderBy("year"), "annual"), path)
        assert path.stat().st_size == found[path.name]


# errors


def test_a_poisoned_station_is_one_row(spark):
    df = spark.createDataFrame([(f"s{i % 7}", float(i)) for i in range(70)], "station_code string, x double")

    def f(pdf):
        if pdf["station_code"].iloc[0] == "s3":
            raise RuntimeError("poison")
        return pdf.assign(total=pdf["x"].sum(), n=len(pdf)).head(1)

    got = {r["station_code"]: r for r in diagnostics.captured(df, ["station_code"], f, "total double, n bigint", {"n": 0}).collect()}
    assert len(got) == 7 and (got["s3"]["error_class"], got["s3"]["error_message"], got["s3"]["total"], got["s3"]["n"]) == ("RuntimeError", "poison", None, 0)
    assert all(r["error_class"] is None and r["n"] == 10 for c, r in got.items() if c != "s3")


# one-pass versions


def test_grid_without_join(spark):
    rows = [("a", dt.date(2000, 2, 27), 1.0), ("a", dt.date(2000, 3, 2), None), ("b", dt.date(1999, 12, 31), 2.0), ("c", None, 3.0)]
    got = rows_of(daily.complete_grid(spark.createDataFrame(rows, "station_code string, date date, q double")))
    want = [("a", dt.date(2000, 2, 27) + dt.timedelta(days=i), 1.0 if i == 0 else None) for i in range(5)] + [("b", dt.date(1999, 12, 31), 2.0)]
    assert got == sorted(want, key=str)


def test_thresholds_against_runs(spark):
    rng = random.Random(2)
    first = dt.date(2000, 1, 1)
    series = {s: {first + dt.timedelta(days=i): rng.choice([None, 0.0, 1.0, 2.0, 2.0, 3.0, rng.random() * 9]) for i in range(400) if rng.random() < 0.9} for s in "ab"}
    df = spark.createDataFrame([(s, d, q) for s, x in series.items() for d, q in x.items()], "station_code string, date date, discharge_m3s double")
    limits = [(s, t) for s in "ab" for t in (0.5, 1.0, 2.0, 2.5, 8.0, 99.0)]
    want = defaultdict(int)
    for s, t in limits:
        last = None
        for d in sorted(series[s]):
            if (series[s][d] or 0) > t:
                want[s, t] += last is None or (d - last).days > extremes.RUN_DAYS
                last = d
    got = {(r["station_code"], r["threshold_m3s"]): r["n_events"] for r in extremes.threshold_counts(df, spark.createDataFrame(limits, "station_code string, threshold_m3s double")).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_kendall_against_pairs():
    rng = random.Random(3)
    for n in (6, 40, 700):
        x, y = ([rng.randrange(30) for _ in range(n)] for _ in range(2))
        s = sum(((x[i] > x[j]) - (x[i] < x[j])) * ((y[i] > y[j]) - (y[i] < y[j])) for i in range(n) for j in range(i))
        scaled = extremes.kendall_p(x, y)
        assert (scaled == 1.0) == (s == 0) and 0 < scaled <= 1
    assert extremes.kendall_p([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6]) == pytest.approx(0.00483, abs=1e-5)
    assert extremes.kendall_p([1, 1, 1], [1, 2, 3]) is None


def test_information_score_joins_and_columns_agree(spark):
    base = catalog_extra.stations(spark, SF)
    m, c, v = (view(spark, SF, n) for n in ("measurements", "rating_curves", "vertices"))
    tables = quality_index.measurement_indices(cleaning.measurement_summary(m)), quality_index.curve_indices(c, curves.overlap_pairs(c)), quality_index.section_indices(cleaning.section_summary(v))
    want = {r["station_code"]: r["preliminary_information_score"] for r in quality_index.information_score(base, *tables).collect()}
    got = {r["station_code"]: r["preliminary_information_score"] for r in entry.queries()["full_station_index"](spark, SF).collect()}
    assert got == want


# samples, dates of one format, table functions


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_sample_is_the_same_however_dealt(spark, parts):
    ids = [hashlib.md5(f"67:{i}".encode()).hexdigest()[:15] for i in range(5000)]
    want = sorted(sorted(range(5000), key=lambda i: (ids[i], i))[:300])
    df = spark.range(5000).repartition(parts)
    assert sorted(r["id"] for r in display.seeded_sample(df, "id", 300).collect()) == want
    assert display.seeded_sample(df, "id", 5000).count() == 5000 and display.seeded_sample(df.limit(0), "id", 3).count() == 0
    assert "Window" not in display.seeded_sample(df, "id", 300)._jdf.queryExecution().executedPlan().toString()


def test_dates_of_one_format(spark):
    rows = [(3, "2001-02-03"), (1, " NA "), (2, "05/02/2001"), (4, "06/02/2001"), (5, None), (6, "31/02/2001")]
    df = spark.createDataFrame(rows, "i int, d string").repartition(3)
    assert {r["i"]: r["d"] for r in columns.parse_dates_alike(df, "d", "i").collect()} == {1: None, 2: dt.date(2001, 2, 5), 3: None, 4: dt.date(2001, 2, 6), 5: None, 6: None}
    assert {r["d"] for r in columns.parse_dates_alike(df.withColumn("d", F.lit("soon")), "d", "i").collect()} == {None}
    assert columns.parse_dates_alike(df.limit(0), "d", "i").dtypes == [("i", "int"), ("d", "date")]


def test_table_functions_by_name(spark):
    df = spark.createDataFrame([("a", dt.date(2000 + i // 3, 1 + i % 3 * 4, 1), float(i % 5), 2000, 2009) for i in range(30)] + [("b", None, None, 2000, 2009)], "station_code string, date_peak date, q_peak_m3s double, y0 int, y1 int")
    sinks.create_views(spark, {"some_peaks": df})
    sql = "SELECT station_code, n_events, message FROM pot_tests(TABLE(SELECT * FROM some_peaks) PARTITION BY station_code)"
    assert tables.register(spark) == ["pot_tests", "residual_regimes"]
    assert {r["station_code"]: r["n_events"] for r in spark.sql(sql).collect()} == {"a": 30, "b": 0}
    tables.register(spark, {"pot_tests": lambda rows: iter([(rows[0]["station_code"], len(rows), *[None] * 10, "mine")])})
    assert {(r["station_code"], r["n_events"], r["message"]) for r in spark.sql(sql).collect()} == {("a", 30, "mine"), ("b", 1, "mine")}
    tables.register(spark)
    with pytest.raises(KeyError):
        tables.register(spark, {"nothing": lambda rows: iter(())})
    rng = random.Random(1)
    days = [(f"s{i % 2}", dt.date(1990, 1, 1) + dt.timedelta(days=40 * i), rng.gauss(0, 0.05) + (0.5 if i > 150 and i % 2 else 0)) for i in range(300)]
    residuals = spark.createDataFrame(days, "station_code string, measurement_date date, power_log_residual double")
    sinks.create_views(spark, {"residuals": residuals})
    got = {tuple(r) for r in spark.sql("SELECT * FROM residual_regimes(TABLE(SELECT * FROM residuals) PARTITION BY station_code ORDER BY measurement_date)").collect()}
    assert got == {(r["station_code"], r["n_regimes"], r["n_points"], r["regime_evidence_class"]) for r in diagnostics.temporal_regimes(residuals).collect()}
    assert {g[1] for g in got} == {1, 2}


def plain_regimes(days, values, p=diagnostics.DEFAULT):
    """(breaks, evidence) by trying all single breaks, then all second ones beside the best, with plain sums."""

    def sse(x):
        m = statistics.median(x)
        d = sorted(abs(v - m) for v in x)
        at = 0.9 * (len(d) - 1)
        cap = d[int(at)] + (at - int(at)) * (d[min(int(at) + 1, len(d) - 1)] - d[int(at)])
        return sum(min(v, cap if cap > 0 else max(d)) ** 2 for v in d)

    def scored(breaks):
        edges = sorted(breaks)
        groups = [[] for _ in range(len(edges) + 1)]
        for d, v in zip(days, values, strict=True):
            groups[sum(d > e for e in edges)].append((d, v))
        medians = [statistics.median(v for _, v in g) for g in groups]
        return groups, medians, sse(values), sum(sse([v for _, v in g]) for g in groups)

    dates = sorted(set(days))[:-1] if len(set(days)) >= 3 else []
    if len(dates) > p.max_breaks:
        dates = [dates[i] for i in sorted({round(1 + k * (len(dates) - 1) / (p.max_breaks - 1)) - 1 for k in range(p.max_breaks)})]
    return dates, scored


def test_regime_candidates_and_groups(spark):
    """The search's partitions, gains and shifts against plain ones, over all stations of a query's kind."""
    rng = random.Random(8)
    for n in (2, 29, 90, 260):
        days = sorted(rng.randrange(720_000, 730_000) for _ in range(n))
        values = [rng.gauss(0, 0.1) + (0.4 if d > 725_000 else 0) for d in days]
        dates, scored = plain_regimes(days, values)
        found, evidence = diagnostics.find_regimes(np.array(days), np.array(values))
        best = None
        for d in dates:
            groups, medians, whole, parts = scored([d])
            s = diagnostics.score_breaks(np.array(days), np.array(values), [d], diagnostics.DEFAULT)
            assert s["smallest"] == min(map(len, groups)) and s["gain"] == pytest.approx(1 - parts / whole) and s["shift"] == pytest.approx(max(medians) - min(medians))
            if s["accepted"] and (best is None or s["gain"] > best[0]):
                best = s["gain"], d
        assert (found["n_regimes"] > 1) == (best is not None)
        if found["n_regimes"] == 2:
            assert found["breaks"] == [best[1]] and evidence in ("strong_evidence", "moderate_evidence")
