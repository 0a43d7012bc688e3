"""Daily rainfall: series, consistency issues, annual indices and maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.functions.columns import count_flags, hydrological_year, labels, ladder, yes
from fluvia.operators.curves import longest_run
from fluvia.operators.daily import complete_grid

WET_MM = 1.0


def status_attention(c: Column) -> Column:
    """A source status that asks for care: a code 2, 3 or 4, or a word for estimated, doubtful, accumulated, suspect, bad."""
    text = F.lower(F.trim(c.cast("string")))
    return yes(text.isin("2", "3", "4") | text.rlike("estimado|duvidoso|acumulado|suspeito|ruim"))


def rain_days(merged: DataFrame) -> DataFrame:
    """Every day of a station's span with rainfall_mm and what it is: observed, valid, wet, dry; counts default to 0."""
    rows = complete_grid(merged.withColumnRenamed("value", "rainfall_mm"))
    r = F.col("rainfall_mm")
    valid = yes(r >= 0)
    return rows.withColumns({
        "is_observed": r.isNotNull(), "is_valid": valid, "is_wet": valid & yes(r >= WET_MM), "is_dry": valid & yes(r < WET_MM), "rain_valid": F.when(valid, r), "status_attention": status_attention(F.col("source_status")),
        "n_source_records": F.coalesce("n_source_records", F.lit(0)), "max_same_consistency_records": F.coalesce("max_same_consistency_records", F.lit(0)), "has_duplicate_same_consistency": yes(F.col("has_duplicate_same_consistency")),
    })


#: Code, group and label of each issue of a rainy day, in order.
ISSUES = (
    ("missing", "Cobertura temporal", "Falha diária"),
    ("negative", "Valor impossível", "Precipitação negativa"),
    ("duplicate", "Duplicação", "Registros duplicados no mesmo nível de consistência"),
    ("status", "Status da fonte", "Status de origem diferente de OK"),
    ("very_high", "Extremo para revisão", "Chuva diária muito alta"),
    ("outlier", "Outlier", "Possível outlier alto"),
    ("zero_run", "Padrão temporal", "Sequência longa de zeros"),
    ("repeated", "Padrão temporal", "Sequência de valor positivo repetido"),
)


def run_lengths(days: DataFrame, key: Column, name: str) -> DataFrame:
    """Adds the length of the run of consecutive rows with an equal, non-null key that each row is in; null elsewhere."""
    order = Window.partitionBy("station_code").orderBy("date")
    rows = days.withColumn("__k", key)
    new = F.coalesce(~F.col("__k").eqNullSafe(F.lag("__k").over(order)), F.lit(True)) | F.col("__k").isNull()
    rows = rows.withColumn("__r", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn(name, F.when(F.col("__k").isNotNull(), F.count("*").over(Window.partitionBy("station_code", "__r")))).drop("__k", "__r")


def rain_issues(days: DataFrame, very_high_mm: float = 400.0, zero_days: int = 30, repeated_days: int = 3) -> DataFrame:
    """One row for each day and issue; fences are Q3 + 3 IQR of log10 positive rain, from ten such days on."""
    positive = F.when(F.col("is_valid") & (F.col("rainfall_mm") > 0), F.log10("rainfall_mm"))
    fences = days.groupBy("station_code").agg(F.count(positive).alias("__n"), F.percentile(positive, F.array(F.lit(0.25), F.lit(0.75))).alias("__q"))
    fences = fences.select("station_code", F.when(F.col("__n") >= 10, F.col("__q")[1] + 3 * (F.col("__q")[1] - F.col("__q")[0])).alias("__fence"))
    # a day is in a run of zeros or in one of a positive value, so one pass over the days' own columns finds both
    days = days.select("station_code", "date", "rainfall_mm", "is_observed", "is_valid", "has_duplicate_same_consistency", "status_attention")
    zero, above = F.col("is_valid") & (F.col("rainfall_mm") == 0), F.col("is_valid") & (F.col("rainfall_mm") > 0)
    rows = run_lengths(days, F.when(zero, F.lit(-1.0)).when(above, F.bround("rainfall_mm", 1)), "__run")
    rows = rows.withColumns({"zero_run": F.when(zero, F.col("__run")), "value_run": F.when(above, F.col("__run"))}).drop("__run").join(fences, "station_code", "left")
    rules = (~F.col("is_observed"), F.col("rainfall_mm") < 0, F.col("has_duplicate_same_consistency"), F.col("status_attention"), F.col("is_valid") & (F.col("rainfall_mm") >= very_high_mm), positive > F.col("__fence"), F.col("zero_run") >= zero_days, F.col("value_run") >= repeated_days)
    found = F.array(*(F.when(rule, F.struct(F.lit(code).alias("code"), F.lit(group).alias("issue_group"), F.lit(label).alias("label"))) for rule, (code, group, label) in zip(rules, ISSUES, strict=True)))
    return rows.select("station_code", "date", "rainfall_mm", "zero_run", "value_run", F.inline(F.filter(found, lambda x: x.isNotNull())))


def _period(days: DataFrame, *keys: Column) -> list[Column]:
    n, missing = F.count("*"), F.count_if(~F.col("is_observed"))
    return [n.alias("days_expected"), F.count_if("is_valid").alias("valid_days"), missing.alias("missing_days"), F.coalesce(F.sum("rain_valid"), F.lit(0.0)).alias("total_mm"), F.count_if("is_wet").alias("wet_days"), F.max("rain_valid").alias("rx1day_mm"), (100 * missing / n).alias("failure_pct")]


def annual_indices(days: DataFrame) -> DataFrame:
    """Totals, wet and dry days, Rx1day, Rx5day, R10, R20, R50, SDII and the longest dry and wet spells of civil years.

    A year without any valid day has total 0; five-day windows and spells stay within the year.
    """
    rows = days.withColumn("year", F.year("date"))
    five = Window.partitionBy("station_code", "year").orderBy("date").rowsBetween(-4, 0)
    rows = rows.withColumn("rx5", F.when(F.count("rain_valid").over(five) == 5, F.sum("rain_valid").over(five)))
    r = F.col("rainfall_mm")
    annual = rows.groupBy("station_code", "year").agg(*_period(rows), F.count_if(r < 0).alias("negative_days"), F.count_if("is_dry").alias("dry_days"), F.max("rx5").alias("rx5day_mm"), *(F.count_if(F.col("is_valid") & (r >= k)).alias(f"r{k}mm_days") for k in (10, 20, 50)))
    annual = annual.withColumn("sdii_mm_per_wet_day", F.when(F.col("wet_days") > 0, F.col("total_mm") / F.nullif(F.col("wet_days"), F.lit(0))))
    for flag, name in (("is_dry", "cdd_days"), ("is_wet", "cwd_days")):
        annual = annual.join(longest_run(rows, F.col(flag), ["station_code", "year"]).withColumnRenamed("longest", name), ["station_code", "year"], "left")
    return annual.fillna(0, ["cdd_days", "cwd_days"])


def monthly_totals(days: DataFrame) -> DataFrame:
    return days.groupBy("station_code", F.year("date").alias("year"), F.month("date").alias("month")).agg(*_period(days))


def rain_regime(monthly: DataFrame) -> DataFrame:
    """Mean, least and greatest monthly total by calendar month."""
    return monthly.groupBy("station_code", "month").agg(F.count("*").alias("n_years"), F.avg("total_mm").alias("mean_mm"), F.min("total_mm").alias("min_mm"), F.max("total_mm").alias("max_mm"))


def _windowed(days: DataFrame, d: int) -> DataFrame:
    """The days with the rolling window that ends on each: n days, k valid ones, their sum s, whether one asks for care, and its first year h0."""
    w = Window.partitionBy("station_code").orderBy("date").rowsBetween(-(d - 1), 0)
    rows = days.withColumn("hydrological_year", hydrological_year("date"))
    return rows.withColumns({"n": F.count("*").over(w), "k": F.count("rain_valid").over(w), "s": F.sum("rain_valid").over(w), "h0": F.min("hydrological_year").over(w), "care": F.max("status_attention").over(w)})


def duration_windows(days: DataFrame, duration_days: int = 1) -> DataFrame:
    """Rolling sums of complete windows that lie within one hydrological year, with start, centre and end."""
    d = duration_days
    rows = _windowed(days, d).where((F.col("n") == d) & (F.col("h0") == F.col("hydrological_year")))
    return rows.select("station_code", "hydrological_year", F.date_sub("date", d - 1).alias("date_start"), F.date_add(F.date_sub("date", d - 1), -(-d // 2) - 1).alias("date_center"), F.col("date").alias("date_end"), (F.col("k") == d).alias("is_complete"), F.when(F.col("k") == d, F.col("s")).alias("p_max_mm"), F.col("care").alias("has_status_attention_window"))


#: Flags of an annual maximum and their labels, in order.
MAX_FLAGS = (
    ("flag_few_valid_days", "Poucos dias válidos"),
    ("flag_partial_hydrological_year", "Ano hidrológico parcial"),
    ("flag_few_valid_windows", "Poucas janelas válidas"),
    ("flag_zero_maximum", "Máximo igual a zero"),
    ("flag_negative_values_year", "Valor negativo no ano"),
    ("flag_status_on_max_window", "Status de atenção na janela"),
    ("flag_tied_maximum_within_year", "Empate no ano"),
    ("flag_high_outlier", "Possível outlier alto"),
    ("flag_low_outlier", "Possível outlier baixo"),
    ("flag_repeated_annual_maximum", "Máximo repetido entre anos"),
    ("flag_possible_underestimated_maximum", "Possível máximo subestimado"),
)


def rain_maxima(days: DataFrame, duration_days: int = 1) -> DataFrame:
    """Maxima of hydrological years with eleven flags; fractions refer to the days that the series has."""
    d, keys = duration_days, ["station_code", "hydrological_year"]
    rows = _windowed(days, d)
    inside = (F.col("n") == d) & (F.col("h0") == F.col("hydrological_year"))
    rows = rows.withColumns({"inside": inside, "p": F.when(inside & (F.col("k") == d), F.col("s"))})
    # days of a year by the sum of their window first, of which the greatest has the ties: the days are read and sorted once
    sums = rows.groupBy(*keys, "p").agg(F.min("date").alias("d0"), F.max("date").alias("d1"), F.count("*").alias("n"), F.count_if("inside").alias("n_inside"), F.count_if("is_valid").alias("n_valid"), F.count_if(~F.col("is_observed")).alias("n_missing"), F.count_if(F.col("rainfall_mm") < 0).alias("n_negative"), F.count_if("status_attention").alias("n_attention"), F.min(F.when(F.col("care"), F.col("date"))).alias("care_date"))
    top = F.max(F.when(F.col("p").isNotNull(), F.struct("p", F.col("n").alias("ties"), F.col("d0").alias("date_end"), F.coalesce(F.col("care_date") == F.col("d0"), F.lit(False)).alias("care"))))
    annual = sums.groupBy(*keys).agg(F.min("d0").alias("first_date_in_series"), F.max("d1").alias("last_date_in_series"), F.sum("n").alias("days_expected_in_session"), F.sum("n_valid").alias("valid_days"), F.sum("n_missing").alias("missing_days"), F.sum("n_negative").alias("negative_days"), F.sum("n_attention").alias("status_attention_days"), F.sum("n_inside").alias("n_windows_expected"), F.sum(F.when(F.col("p").isNotNull(), F.col("n")).otherwise(0)).alias("n_valid_windows"), top.alias("w"))
    annual = annual.withColumns({"p_max_mm": F.col("w.p"), "n_tied_max_windows": F.col("w.ties")})
    p = F.col("p_max_mm")
    start, end = F.make_date(F.col("hydrological_year") - 1, F.lit(10), F.lit(1)), F.make_date("hydrological_year", F.lit(9), F.lit(30))
    valid_fraction, window_fraction = F.col("valid_days") / F.col("days_expected_in_session"), F.col("n_valid_windows") / F.nullif(F.col("n_windows_expected"), F.lit(0))
    annual = annual.withColumns({
        "duration_days": F.lit(duration_days), "missing_fraction": F.col("missing_days") / F.col("days_expected_in_session"), "valid_fraction": valid_fraction, "valid_window_fraction": window_fraction, "date_start": F.date_sub("w.date_end", d - 1), "date_center": F.date_add(F.date_sub("w.date_end", d - 1), -(-d // 2) - 1), "date_end": F.col("w.date_end"),
        "flag_few_valid_days": valid_fraction < 0.80, "flag_partial_hydrological_year": (F.col("first_date_in_series") > start) | (F.col("last_date_in_series") < end), "flag_few_valid_windows": yes(window_fraction < 0.80), "flag_zero_maximum": yes(p <= 0),
        "flag_negative_values_year": F.col("negative_days") > 0, "flag_status_on_max_window": yes(F.col("w.care")), "flag_tied_maximum_within_year": yes(F.col("n_tied_max_windows") > 1),
    }).drop("w")
    x = F.when(p > 0, F.log10(p))
    # over a window: a join of the years with their fences would make the years, from all days, twice
    own = Window.partitionBy("station_code")
    annual = annual.withColumns({"__n": F.count(x).over(own), "__q": F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).over(own)})
    annual = annual.withColumns({"__q1": F.when(F.col("__n") >= 4, F.col("__q")[0]), "__q3": F.when(F.col("__n") >= 4, F.col("__q")[1])}).drop("__n", "__q")
    span = 3 * (F.col("__q3") - F.col("__q1"))
    key = F.bround(p, 1)
    repeated = F.count("*").over(Window.partitionBy("station_code", key)) > 1
    annual = annual.withColumns({"flag_high_outlier": yes(x > F.col("__q3") + span), "flag_low_outlier": yes(x < F.col("__q1") - span), "flag_repeated_annual_maximum": p.isNotNull() & repeated}).drop("__q1", "__q3")
    annual = annual.withColumn("flag_possible_underestimated_maximum", F.col("flag_low_outlier") & (F.col("flag_few_valid_days") | F.col("flag_few_valid_windows") | F.col("flag_partial_hydrological_year")))
    annual = annual.withColumn("n_flags", count_flags([F.col(c) for c, _ in MAX_FLAGS])).withColumn("flags_resumo", labels([(F.col(c), t) for c, t in MAX_FLAGS], "Sem flags"))
    n = F.col("n_flags")
    return annual.withColumn("nivel_atencao", ladder(n, [(n == 0, "Sem flags"), (n <= 2, "Atenção baixa"), (n <= 4, "Atenção moderada")], "Atenção alta"))
