"""Extremes of daily flow: annual maxima, peaks over threshold, n-day minima.

Everything is partitioned by station, so one job serves any number of stations. ``grid`` inputs have station_code, date
and discharge_m3s for every day of a station's span.
"""

from __future__ import annotations

import math
import statistics
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.functions.columns import MONTHS_PT, count_flags, finite, hydrological_year, is_finite, labels, ladder, yes
from fluvia.operators.daily import PART
from fluvia.session import count_parts, materialize

DURATIONS = (1, 3, 7, 15, 30)
RUN_DAYS = 7


def near(a: Column, b: Column) -> Column:
    return F.abs(a - b) < 1.5e-8


def iqr_flags(df: DataFrame, value: str, keys: Sequence[str], strong: float = 3.0, least: int = 4) -> DataFrame:
    """Adds log10 fences of positive values by key: high and low classes (forte, atenção, sem sinal) and their flags.

    Quartiles interpolate linearly; fewer than ``least`` values or a range of zero give no signal.
    """
    x = F.when(finite(value) > 0, F.log10(finite(value)))
    # over a window: a join of the rows with their fences would make the rows, and all that they come from, twice
    own = Window.partitionBy(*keys)
    df = df.withColumns({"__n": F.count(x).over(own), "__q": F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).over(own)})
    df = df.withColumns({"__q1": F.col("__q")[0], "__q3": F.col("__q")[1]}).drop("__q")
    iqr = F.col("__q3") - F.col("__q1")
    usable = yes((F.col("__n") >= least) & (iqr > 0)) & x.isNotNull()
    high = ladder(x, [(usable & (x > F.col("__q3") + strong * iqr), "forte"), (usable & (x > F.col("__q3") + 1.5 * iqr), "atenção")], "sem sinal")
    low = ladder(x, [(usable & (x < F.col("__q1") - strong * iqr), "forte"), (usable & (x < F.col("__q1") - 1.5 * iqr), "atenção")], "sem sinal")
    return df.withColumns({"high_outlier_iqr_class": high, "low_outlier_iqr_class": low, "flag_high_outlier_iqr": high != "sem sinal", "flag_low_outlier_iqr": low != "sem sinal"}).drop("__n", "__q1", "__q3")


def attention(df: DataFrame, flags: Sequence[tuple[str, str]], at_least_two: Column) -> DataFrame:
    """Number of flags, their labels, and the attention score, level and class; some flags lift the score to two."""
    n = count_flags([F.col(c) for c, _ in flags])
    df = df.withColumn("n_flags", n).withColumn("flags_resumo", labels([(F.col(c), t) for c, t in flags], "sem flag"))
    n = F.col("n_flags")
    score = F.when(n == 0, 0).when(yes(at_least_two), F.greatest(n, F.lit(2))).otherwise(n)
    df = df.withColumn("attention_score", score)
    s = F.col("attention_score")
    return df.withColumn("nivel_atencao", ladder(s, [(s == 0, "sem flag"), (s == 1, "revisar"), (s == 2, "atenção moderada")], "atenção alta")).withColumn("n_flags_class", ladder(n, [(n == 0, "0"), (n == 1, "1"), (n == 2, "2")], "3+"))


#: Flags of a maximum and their labels, in order.
MAX_FLAGS = (
    ("flag_gap_near_max", "falhas no entorno do máximo"),
    ("flag_high_outlier_iqr", "outlier alto"),
    ("flag_low_outlier_iqr", "outlier baixo"),
    ("flag_papalexiou_candidate", "candidato à exclusão"),
    ("flag_consistency_issue_on_max", "ocorrência na consistência"),
    ("flag_tied_max_within_year", "empate no máximo anual"),
    ("flag_repeated_annual_max_across_years", "máximo repetido entre anos"),
)


def issues_by_date(issues: DataFrame | None, grid: DataFrame) -> DataFrame:
    """(station_code, date, n, types) of a consistency report; empty where there is none."""
    if issues is None:
        return grid.sparkSession.createDataFrame([], "station_code string, date date, n_issues bigint, issue_types string")
    return issues.where("date is not null").groupBy("station_code", "date").agg(F.count("*").alias("n_issues"), F.array_join(F.array_sort(F.collect_set("label")), "; ").alias("issue_types"))


def annual_maxima(grid: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Maxima of hydrological years with completeness, ties, gaps around the peak, ranks, outliers and flags.

    ``issues`` has station_code, date and label. Neighbouring days come from one window over a station's days, which are
    dealt over parts that follow the input, so that a task's days don't grow with it.
    """
    by_day = Window.partitionBy("station_code").orderBy("date")
    has = is_finite("discharge_m3s")
    hy = hydrological_year("date")
    days = grid.select("station_code", "date", finite("discharge_m3s").alias("q"), has.cast("int").alias("has"), hy.alias("hydrological_year"))
    days = days.repartition(count_parts(grid, PART), "station_code")
    around = [F.coalesce(F.lag("has", k).over(by_day) if k > 0 else F.lead("has", -k).over(by_day), F.lit(0)) for k in (2, 1, -1, -2)]
    truncated = F.row_number().over(by_day).isin(1, 2) | F.lead("has", 2).over(by_day).isNull()
    year = Window.partitionBy("station_code", "hydrological_year")
    days = days.withColumns({"near_missing": 4 - sum(around[1:], around[0]) + (1 - F.col("has")), "adjacent_gap": (around[1] == 0) | (around[2] == 0), "truncated": truncated})
    days = days.withColumn("q_max", F.max("q").over(year)).withColumn("peak", yes(near(F.col("q"), F.col("q_max"))))
    days = days.withColumn("flat", F.col("peak") & yes(F.lag("peak").over(year.orderBy("date")) & (F.datediff("date", F.lag("date").over(year.orderBy("date"))) == 1)))
    first = F.min(F.when(F.col("peak"), F.struct("date", "near_missing", "adjacent_gap", "truncated")))
    annual = days.groupBy("station_code", "hydrological_year").agg(
        F.count("*").alias("n_days_in_series"), F.sum("has").alias("n_days_valid"), F.max("q").alias("q_max_m3s"), first.alias("first"), F.count_if("peak").alias("n_days_equal_to_max"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("peak"), F.date_format("date", "yyyy-MM-dd")))), "; ").alias("dates_equal_to_max"), F.max("flat").alias("flag_flat_peak"),
    )
    start, end = F.make_date(F.col("hydrological_year") - 1, F.lit(10), F.lit(1)), F.make_date("hydrological_year", F.lit(9), F.lit(30))
    annual = annual.withColumns({"period_start": start, "period_end": end, "n_days_expected": F.datediff(end, start) + 1})
    missing = F.col("n_days_expected") - F.col("n_days_valid")
    annual = annual.withColumns({
        "n_days_missing": missing, "completeness_pct": 100 * F.col("n_days_valid") / F.col("n_days_expected"), "missing_fraction": missing / F.col("n_days_expected"), "date_max": F.col("first.date"),
        "n_missing_near_max": F.col("first.near_missing"), "flag_gap_near_max": yes(F.col("first.near_missing") > 0), "flag_strong_gap_near_max": yes(F.col("first.near_missing") >= 2), "flag_adjacent_gap_near_max": yes(F.col("first.adjacent_gap")),
        "flag_window_truncated": yes(F.col("first.truncated")), "flag_tied_max_within_year": F.col("n_days_equal_to_max") > 1,
    }).drop("first")
    found = issues_by_date(issues, grid).withColumnRenamed("date", "date_max").withColumnsRenamed({"n_issues": "n_consistency_issues_on_max", "issue_types": "consistency_issue_types_on_max"})
    annual = annual.join(found, ["station_code", "date_max"], "left").fillna(0, ["n_consistency_issues_on_max"]).fillna("", ["consistency_issue_types_on_max"])
    annual = annual.withColumn("flag_consistency_issue_on_max", F.col("n_consistency_issues_on_max") > 0)
    station = Window.partitionBy("station_code")
    known = F.col("q_max_m3s").isNotNull()
    n_valid = F.count("q_max_m3s").over(station)
    annual = annual.withColumns({
        "rank_ascending": F.when(known, F.rank().over(station.orderBy(F.asc_nulls_last("q_max_m3s")))), "rank_descending": F.when(known, F.rank().over(station.orderBy(F.desc_nulls_last("q_max_m3s")))), "__n": n_valid,
        "n_years_same_q_max": F.when(known, F.count("*").over(Window.partitionBy("station_code", F.bround("q_max_m3s", 3)))).otherwise(0),
    })
    annual = annual.withColumns({"flag_papalexiou_candidate": yes((F.col("rank_ascending") <= 0.40 * F.col("__n")) & (F.col("missing_fraction") >= 1 / 3)), "flag_repeated_annual_max_across_years": F.col("n_years_same_q_max") > 1}).drop("__n")
    annual = iqr_flags(annual, "q_max_m3s", ["station_code"])
    return attention(annual, MAX_FLAGS, F.col("flag_papalexiou_candidate") | F.col("flag_consistency_issue_on_max"))


def pot_events(daily: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ("station_code",), run_days: int = RUN_DAYS) -> DataFrame:
    """Peaks over threshold by runs declustering: a cluster ends once ``run_days`` days in a row do not exceed.

    ``thresholds`` has station_code, threshold_m3s and the further keys. Missing days and flows of zero or less count as
    not exceeding, so the gap between two exceedances decides; the peak is the first day of the greatest flow.
    """
    over = daily.where(is_finite("discharge_m3s") & (F.col("discharge_m3s") > 0)).select("station_code", "date", F.col("discharge_m3s").alias("q")).join(thresholds.where("threshold_m3s > 0"), "station_code").where("q > threshold_m3s")
    series = Window.partitionBy(*keys).orderBy("date")
    new = F.coalesce(F.datediff("date", F.lag("date").over(series)) > run_days, F.lit(True))
    marked = over.withColumn("event_id", F.sum(new.cast("int")).over(series.rowsBetween(Window.unboundedPreceding, 0)))
    peak = F.min(F.struct((-F.col("q")).alias("o"), "date", "q"))
    events = marked.groupBy(*keys, "threshold_m3s", "event_id").agg(F.min("date").alias("date_start"), F.max("date").alias("date_end"), peak.alias("p"), F.count("*").alias("n_exceedance_days"))
    return events.select(*keys, "event_id", "date_start", "date_end", F.col("p.date").alias("date_peak"), F.year("p.date").alias("year"), F.col("p.q").alias("q_peak_m3s"), "threshold_m3s", (F.col("p.q") - F.col("threshold_m3s")).alias("excess_m3s"), "n_exceedance_days")


def threshold_grid(daily: DataFrame, points: int = 70, low: float = 0.50, high: float = 0.995, least: int = 30) -> DataFrame:
    """Candidate thresholds: type-8 quantiles of the positive flows, for stations with at least ``least`` of them."""
    rows = daily.where(is_finite("discharge_m3s") & (F.col("discharge_m3s") > 0)).groupBy("station_code").agg(F.sort_array(F.collect_list("discharge_m3s")).alias("v")).where(F.size("v") >= least)
    grid = rows.select("station_code", "v", F.size("v").alias("n"), F.explode(F.array(*(F.lit(low + (high - low) * i / (points - 1)) for i in range(points)))).alias("p"))
    at = F.col("p") * (F.col("n") + 1 / 3) + 1 / 3
    i = F.least(F.greatest(F.floor(at + 4e-16).cast("int"), F.lit(1)), F.col("n"))
    part = F.least(F.greatest(at - i, F.lit(0.0)), F.lit(1.0))
    a, b = F.element_at("v", i), F.element_at("v", F.least(i + 1, F.col("n")))
    return grid.select("station_code", (a + part * (b - a)).alias("threshold_m3s")).distinct()


def threshold_counts(daily: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """Events, and events a year, at each candidate threshold: all thresholds of all stations in one job.

    A day begins an event at the thresholds below its flow that no day of the RUN_DAYS before it exceeds: from the
    greatest flow of those days up to its own. So a day adds one event at that bound and takes it away at its flow, and a
    threshold's events are the running sum over the sorted bounds. Two rows a day, whatever the number of thresholds.
    """
    grid = threshold_grid(daily) if grid is None else grid
    days = daily.where(is_finite("discharge_m3s") & (F.col("discharge_m3s") > 0)).select("station_code", F.datediff("date", F.lit("1970-01-01")).alias("day"), F.col("discharge_m3s").alias("q"))
    before = F.max("q").over(Window.partitionBy("station_code").orderBy("day").rangeBetween(-RUN_DAYS, -1))
    starts = days.withColumn("m", F.coalesce(before, F.lit(float("-inf")))).where("m < q")
    bounds = starts.select("station_code", F.inline(F.array(F.struct(F.col("m").alias("value"), F.lit(0).alias("kind"), F.lit(1).alias("step")), F.struct(F.col("q").alias("value"), F.lit(0).alias("kind"), F.lit(-1).alias("step")))))
    marks = bounds.unionByName(grid.select("station_code", F.col("threshold_m3s").alias("value"), F.lit(1).alias("kind"), F.lit(0).alias("step")).distinct())
    so_far = F.sum("step").over(Window.partitionBy("station_code").orderBy("value", "kind").rowsBetween(Window.unboundedPreceding, 0))
    counts = marks.withColumn("n_events", so_far).where("kind = 1 and n_events > 0").select("station_code", F.col("value").alias("threshold_m3s"), "n_events")
    span = daily.groupBy("station_code").agg(((F.datediff(F.max("date"), F.min("date")) + 1) / 365.25).alias("n_years"))
    return counts.join(span, "station_code").select("station_code", "threshold_m3s", "n_events", "n_years", (F.col("n_events") / F.col("n_years")).alias("lambda_observed"))


def lambda_targets(counts: DataFrame) -> DataFrame:
    """For 1 to 5 events a year by halves: the highest threshold with enough events, else that with most events."""
    targets = counts.select("*", F.explode(F.array(*(F.lit(1 + i / 2) for i in range(9)))).alias("lambda_target"))
    enough = F.col("n_events") >= F.ceil(F.col("lambda_target") * F.col("n_years"))
    best = F.min(F.struct((~enough).cast("int").alias("a"), F.when(enough, -F.col("threshold_m3s")).otherwise(-F.col("n_events")).alias("b"), (-F.col("threshold_m3s")).alias("c"), "threshold_m3s", "n_events", "lambda_observed"))
    return targets.groupBy("station_code", "lambda_target").agg(best.alias("r")).select("station_code", "lambda_target", "r.threshold_m3s", "r.n_events", "r.lambda_observed")


def chi2_quantile(p: float, df: int) -> float:
    """The chi-squared quantile, by bisection on the regularised incomplete gamma function."""

    def cdf(x: float) -> float:
        a, x = df / 2, x / 2
        if x <= 0:
            return 0.0
        scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
        if x < a + 1:
            term = total = 1 / a
            n = a
            while abs(term) > abs(total) * 1e-16:
                n += 1
                term *= x / n
                total += term
            return total * scale
        tiny = 1e-300
        b, c = x + 1 - a, 1 / tiny
        d = 1 / b
        h = d
        for i in range(1, 1000):
            an = -i * (i - a)
            b += 2
            d = 1 / ((an * d + b) or tiny)
            c = (b + an / c) or tiny
            h *= d * c
            if abs(d * c - 1) < 1e-16:
                break
        return 1 - scale * h

    low, high = 0.0, max(10.0, df * 10.0)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return (low + high) / 2


def kendall_p(x: Sequence[float], y: Sequence[float]) -> float | None:
    """Two-sided p of Kendall's tau by the normal approximation with tie corrections; None if one side is constant."""
    n = len(x)
    a, b = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    s = 0  # concordant less discordant pairs, in blocks of rows
    for lo in range(0, n, 512):
        s += int((np.sign(a[lo : lo + 512, None] - a[None, :]) * np.sign(b[lo : lo + 512, None] - b[None, :])).sum())
    s //= 2

    def ties(v: Sequence[float]) -> list[int]:
        return [c for c in pd.Series(list(v)).value_counts() if c > 1]

    tx, ty = ties(x), ties(y)
    v0 = n * (n - 1) * (2 * n + 5)
    vt, vu = (sum(t * (t - 1) * (2 * t + 5) for t in ts) for ts in (tx, ty))
    v1 = sum(t * (t - 1) for t in tx) * sum(t * (t - 1) for t in ty) / (2 * n * (n - 1))
    v2 = sum(t * (t - 1) * (t - 2) for t in tx) * sum(t * (t - 1) * (t - 2) for t in ty) / (9 * n * (n - 1) * (n - 2)) if n > 2 else 0
    variance = (v0 - vt - vu) / 18 + v1 + v2
    return math.erfc(abs(s) / math.sqrt(variance) / math.sqrt(2)) if variance > 0 else None


#: The messages of the tests.
POT_MESSAGES = (
    "A série POT atende aos critérios diagnósticos adotados.",
    "A série POT tem poucos eventos para avaliação.",
    "A série POT não atende ao critério mínimo de separação entre eventos.",
    "Limiar selecionado, mas há sinal de dependência serial entre picos sucessivos.",
    "Limiar selecionado, mas a contagem anual de eventos não é compatível com a hipótese de ocorrência aproximadamente Poisson.",
    "Nenhum evento POT foi extraído.",
)


def series_tests(peaks: Sequence[float], days: Sequence[int], years: Sequence[int], first_year: int, last_year: int, alpha: float = 0.05) -> dict:
    """The hypothesis tests of one series of events: separation, serial dependence, dispersion of the annual counts."""
    n, n_years = len(peaks), last_year - first_year + 1
    if not n:
        return {"n_events": 0, "lambda_observed": None, "min_separation_ok": False, "kendall_p_value": None, "kendall_ok": False, "dispersion_index": None, "poisson_lower": None, "poisson_upper": None, "poisson_ok": False, "selection_ok": False, "hypotheses_ok": False, "message": POT_MESSAGES[5]}
    apart = all(b - a >= RUN_DAYS for a, b in zip(days, days[1:], strict=False))
    p, serial = None, True
    if n >= 6 and statistics.stdev(peaks) > 0:
        p = kendall_p(peaks[:-1], peaks[1:])
        serial = p is not None and p >= alpha
    index = lower = upper = None
    poisson = False
    counts = [sum(y == k for y in years) for k in range(first_year, last_year + 1)]
    if n_years >= 5 and sum(counts):
        index = statistics.variance(counts) / statistics.mean(counts)
        lower, upper = (chi2_quantile(q, n_years - 1) / (n_years - 1) for q in (alpha / 2, 1 - alpha / 2))
        poisson = lower <= index <= upper
    selected = n >= 10 and apart
    good = selected and serial and poisson
    message = POT_MESSAGES[0 if good else 1 if n < 10 else 2 if not apart else 3 if not serial else 4]
    return {"n_events": n, "lambda_observed": n / n_years, "min_separation_ok": apart, "kendall_p_value": p, "kendall_ok": serial, "dispersion_index": index, "poisson_lower": lower, "poisson_upper": upper, "poisson_ok": poisson, "selection_ok": selected, "hypotheses_ok": good, "message": message}


TEST_FIELDS = "n_events bigint, lambda_observed double, min_separation_ok boolean, kendall_p_value double, kendall_ok boolean, dispersion_index double, poisson_lower double, poisson_upper double, poisson_ok boolean, selection_ok boolean, hypotheses_ok boolean, message string"


def pot_tests(events: DataFrame, daily: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ("station_code",)) -> DataFrame:
    """Tests of each threshold's events; a threshold without events has a row too. A group is one station's events."""
    span = daily.groupBy("station_code").agg(F.year(F.min("date")).alias("y0"), F.year(F.max("date")).alias("y1"))
    rows = thresholds.join(span, "station_code").join(events.select(*keys, "date_peak", F.col("year").alias("y"), "q_peak_m3s"), list(keys), "left")
    extra = [k for k in keys if k != "station_code"]
    kinds = {f.name: f.dataType.simpleString() for f in thresholds.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        some = pdf.dropna(subset=["date_peak"]).sort_values("date_peak")
        found = series_tests(some["q_peak_m3s"].tolist(), [d.toordinal() for d in some["date_peak"]], some["y"].astype(int).tolist(), int(pdf["y0"].iloc[0]), int(pdf["y1"].iloc[0]))
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "threshold_m3s": pdf["threshold_m3s"].iloc[0], **found}])

    schema = "station_code string, " + "".join(f"{k} {kinds[k]}, " for k in extra) + "threshold_m3s double, " + TEST_FIELDS
    return rows.groupBy(*keys).applyInPandas(run, schema)


def automatic_threshold(daily: DataFrame) -> DataFrame:
    """Diagnostics of each event-rate target, with the block accepted from the lowest on and the one selected.

    The selected target is the largest of the accepted block.
    """
    targets = materialize(lambda_targets(threshold_counts(daily)), "lambda-targets")  # events and tests read them
    keys = ("station_code", "lambda_target")
    thresholds = targets.select(*keys, "threshold_m3s")
    tests = pot_tests(pot_events(daily, thresholds, keys), daily, thresholds, keys)
    reached = F.col("lambda_observed") >= F.col("lambda_target") * 0.85
    tests = tests.withColumn("reached_target_lambda", yes(reached)).withColumn("selection_ok", F.col("selection_ok") & F.col("reached_target_lambda")).withColumn("hypotheses_ok", F.col("hypotheses_ok") & F.col("reached_target_lambda"))
    by = Window.partitionBy("station_code").orderBy("lambda_target").rowsBetween(Window.unboundedPreceding, 0)
    tests = tests.withColumn("accepted_initial_block", F.min(F.col("selection_ok").cast("int")).over(by) == 1)
    best = F.max(F.when(F.col("accepted_initial_block"), F.col("lambda_target"))).over(Window.partitionBy("station_code"))
    return tests.withColumn("selected", yes(F.col("lambda_target") == best))


#: Flags of a minimum and their labels, in order.
MIN_FLAGS = (
    ("flag_few_valid_windows", "poucas janelas válidas"),
    ("flag_failures_month_minimum", "falhas no mês da mínima"),
    ("flag_gap_near_minimum", "falhas no entorno da mínima"),
    ("flag_high_outlier_iqr", "outlier alto"),
    ("flag_low_outlier_iqr", "outlier baixo"),
    ("flag_candidate_exclusion", "candidato à exclusão"),
    ("flag_consistency_issue_on_min_window", "ocorrência na consistência"),
    ("flag_zero_or_negative_minimum", "vazão nula/negativa"),
)


def low_flows(grid: DataFrame, duration_days: int = 7, issues: DataFrame | None = None) -> DataFrame:
    """The least mean flow over ``duration_days`` complete days within each civil year, with its dates and flags.

    Other durations than 1, 3, 7, 15 and 30 become 7. Windows stay within the year; completeness refers to the whole year
    and the number of windows to the days that the series has.
    """
    d = duration_days if duration_days in DURATIONS else 7
    days = grid.select("station_code", "date", F.year("date").alias("year"), finite("discharge_m3s").alias("q"), is_finite("discharge_m3s").cast("int").alias("has"))
    by_year = Window.partitionBy("station_code", "year").orderBy("date")
    frame = by_year.rowsBetween(-(d - 1), 0)
    series = Window.partitionBy("station_code").orderBy("date")
    before = F.coalesce(F.sum("has").over(series.rowsBetween(-(d + 1), -d)), F.lit(0))
    after = F.coalesce(F.sum("has").over(series.rowsBetween(1, 2)), F.lit(0))
    days = days.withColumns({
        "mean": F.when(F.sum("has").over(frame) == d, F.sum("q").over(frame) / d), "missing_near": 4 - before - after, "row": F.row_number().over(series), "ahead": F.lead("has", 2).over(series),
    }).withColumn("truncated", (F.col("row") < d + 2) | F.col("ahead").isNull())
    center = F.date_add(F.date_sub("date", d - 1), (d - 1) // 2)
    monthly = days.groupBy("station_code", F.trunc("date", "month").alias("m")).agg(F.sum("has").alias("has_month"))
    year = Window.partitionBy("station_code", "year")
    days = days.withColumn("q_min", F.min("mean").over(year)).withColumn("least", yes(near(F.col("mean"), F.col("q_min"))))
    first = F.min(F.when(F.col("least"), F.struct("date", "missing_near", "truncated", center.alias("center"))))
    annual = days.groupBy("station_code", "year").agg(
        F.sum("has").alias("n_days_valid"), F.greatest(F.count("*") - d + 1, F.lit(0)).alias("n_windows_expected"), F.count("mean").alias("n_windows_valid"), F.min("mean").alias("q_min_nday_m3s"), first.alias("first"),
        F.count_if("least").alias("n_windows_equal_to_min"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("least"), F.date_format("date", "yyyy-MM-dd")))), "; ").alias("dates_equal_to_min"),
    )
    expected = F.datediff(F.make_date("year", F.lit(12), F.lit(31)), F.make_date("year", F.lit(1), F.lit(1))) + 1
    annual = annual.withColumns({
        "duration_days": F.lit(d), "n_days_expected": expected, "n_days_missing": expected - F.col("n_days_valid"), "missing_fraction": (expected - F.col("n_days_valid")) / expected,
        "windows_valid_pct": F.when(F.col("n_windows_valid") == 0, 0.0).otherwise(100 * F.col("n_windows_valid") / F.nullif(F.col("n_windows_expected"), F.lit(0))),
        "date_end": F.col("first.date"), "date_start": F.date_sub(F.col("first.date"), d - 1), "date_center": F.col("first.center"), "n_missing_near_minimum": F.col("first.missing_near"), "flag_gap_near_minimum": yes(F.col("first.missing_near") > 0),
        "flag_window_truncated_minimum": yes(F.col("first.truncated")), "flag_tied_min_within_year": F.col("n_windows_equal_to_min") > 1, "m": F.trunc("first.center", "month"), "month_minimum": F.month("first.center"),
    }).drop("first")
    annual = annual.join(monthly, ["station_code", "m"], "left")
    in_month = F.dayofmonth(F.last_day("m"))
    annual = annual.withColumn("failures_pct_month_minimum", F.when(F.col("m").isNotNull(), 100) * (in_month - F.coalesce("has_month", F.lit(0))) / in_month).withColumn("month_minimum_label", F.coalesce(F.element_at(F.array(*map(F.lit, MONTHS_PT)), F.col("month_minimum")), F.lit(""))).drop("m", "has_month")
    if issues is not None:
        found = issues.where("date is not null").select(F.col("station_code").alias("s"), F.col("date").alias("issue_date"), "label")
        hits = annual.select("station_code", "year", "date_start", "date_end").join(found, (F.col("station_code") == F.col("s")) & F.col("issue_date").between(F.col("date_start"), F.col("date_end")))
        hits = hits.groupBy("station_code", "year").agg(F.count("*").alias("n_consistency_issues_on_min_window"), F.array_join(F.array_sort(F.collect_set("label")), "; ").alias("consistency_issue_types_on_min_window"))
        annual = annual.join(hits, ["station_code", "year"], "left").fillna(0, ["n_consistency_issues_on_min_window"]).fillna("", ["consistency_issue_types_on_min_window"])
    else:
        annual = annual.withColumns({"n_consistency_issues_on_min_window": F.lit(0).cast("long"), "consistency_issue_types_on_min_window": F.lit("")})
    station = Window.partitionBy("station_code")
    known = F.col("q_min_nday_m3s").isNotNull()
    annual = annual.withColumns({
        "flag_consistency_issue_on_min_window": F.col("n_consistency_issues_on_min_window") > 0, "rank_ascending": F.when(known, F.rank().over(station.orderBy(F.asc_nulls_last("q_min_nday_m3s")))),
        "rank_descending": F.when(known, F.rank().over(station.orderBy(F.desc_nulls_last("q_min_nday_m3s")))), "__n": F.count("q_min_nday_m3s").over(station),
        "n_years_same_q_min": F.when(known, F.count("*").over(Window.partitionBy("station_code", F.bround("q_min_nday_m3s", 3)))).otherwise(0),
    })
    annual = annual.withColumns({"flag_few_valid_windows": F.col("windows_valid_pct") < 80, "flag_failures_month_minimum": yes(F.col("failures_pct_month_minimum") > 0), "flag_zero_or_negative_minimum": yes(F.col("q_min_nday_m3s") <= 0)})
    candidate = (F.col("rank_descending") <= 0.40 * F.col("__n")) & ((F.col("missing_fraction") >= 1 / 3) | (F.col("windows_valid_pct") < 66.7))
    annual = annual.withColumns({"flag_candidate_exclusion": yes(candidate), "flag_repeated_annual_min_across_years": F.col("n_years_same_q_min") > 1}).drop("__n")
    annual = iqr_flags(annual, "q_min_nday_m3s", ["station_code"])
    return attention(annual, MIN_FLAGS, F.col("flag_candidate_exclusion") | F.col("flag_consistency_issue_on_min_window"))
