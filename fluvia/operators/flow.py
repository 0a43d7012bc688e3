"""Flow statistics: regimes, duration curves, rolling years, regularisation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.functions.columns import finite, is_finite
from fluvia.operators.daily import value_stats
from fluvia.session import spread

MIN_YEARS = 5


def monthly_stats(daily: DataFrame) -> DataFrame:
    """Counts and mean, least and greatest flow by station and month; ``daily`` has discharge_m3s for each day."""
    return daily.groupBy("station_code", F.year("date").alias("year"), F.month("date").alias("month")).agg(*value_stats(is_finite("discharge_m3s"), "discharge_m3s", "q"))


def annual_stats(daily: DataFrame) -> DataFrame:
    return daily.groupBy("station_code", F.year("date").alias("year")).agg(*value_stats(is_finite("discharge_m3s"), "discharge_m3s", "q"))


def monthly_regime(monthly: DataFrame, compat: bool = False) -> DataFrame:
    """By calendar month: years with data, and mean, least and greatest of the monthly means.

    With ``compat``, least and greatest repeat the mean, as sequential evaluation would have it.
    """
    m = finite("q_mean")
    rows = monthly.where(is_finite("q_mean")).groupBy("station_code", "month").agg(F.countDistinct("year").alias("years_with_data"), F.avg(m).alias("q_mean"), F.min(m).alias("q_min"), F.max(m).alias("q_max"))
    return rows.withColumn("q_min", F.col("q_mean")).withColumn("q_max", F.col("q_mean")) if compat else rows


def monthly_matrix(monthly: DataFrame, annual: DataFrame) -> DataFrame:
    """Years by months of mean flows with the annual mean, and a row labelled Média: the months' means and the mean of all days."""
    names = [f"m{m:02d}" for m in range(1, 13)]
    wide = monthly.groupBy("station_code", "year").pivot("month", list(range(1, 13))).agg(F.first("q_mean"))
    wide = wide.select("station_code", "year", *(F.col(str(m)).alias(n) for m, n in enumerate(names, 1)))
    rows = wide.join(annual.select("station_code", "year", F.col("q_mean").alias("annual"), "days_with_value"), ["station_code", "year"], "left").select("station_code", F.col("year").cast("string").alias("label"), *names, "annual", "days_with_value")
    whole = F.try_divide(F.sum(finite("annual") * F.col("days_with_value")), F.sum(F.when(is_finite("annual"), F.col("days_with_value"))))
    means = rows.groupBy("station_code").agg(F.lit("Média").alias("label"), *(F.avg(n).alias(n) for n in names), whole.alias("annual"))
    return rows.drop("days_with_value").unionByName(means)


def mean_flow(daily: DataFrame) -> DataFrame:
    """The long-term mean of all finite daily flows."""
    return daily.groupBy("station_code").agg(F.avg(finite("discharge_m3s")).alias("qmlt"))


def probabilities() -> list[float]:
    """The standard grid, in percent: fine at both ends."""
    grid = [i / 10 for i in range(1, 11)] + [1.25 + i / 4 for i in range(16)] + list(range(6, 95)) + [95 + i / 4 for i in range(17)] + [99.1 + i / 10 for i in range(9)]
    return sorted({round(float(p), 2) for p in grid})


#: Wichura's rational functions of the normal quantile (algorithm AS 241), constant term first.
NORMAL_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
NORMAL_TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)


def normal_axis(permanence_pct: str) -> Column:
    """Where a permanence lies on the normal probability axis: the normal quantile of its percentage, held within 0.1 and 99.9."""

    def ratio(terms: tuple, x: Column) -> Column:
        top, bottom = (reduce(lambda acc, k: acc * x + F.lit(k), reversed(t[:-1]), F.lit(t[-1])) for t in terms)
        return top / bottom

    p = F.least(F.greatest(F.col(permanence_pct), F.lit(0.1)), F.lit(99.9)) / 100
    q = p - 0.5
    centre = q * ratio(NORMAL_CENTRE, F.lit(0.180625) - q * q)
    tail = F.signum(q) * ratio(NORMAL_TAIL, F.sqrt(-F.ln(F.least(p, 1 - p))) - 1.6)
    return F.when(F.col(permanence_pct).isNotNull(), F.when(F.abs(q) <= 0.425, centre).otherwise(tail))


def flow_duration(daily: DataFrame, targets: Sequence[float] | None = None, positive_only: bool = False) -> DataFrame:
    """Flow at each permanence: descending values at i / n, linear between them, constant beyond the ends.

    A station's days are bounded by its span, so its sorted values are one array.
    """
    q = finite("discharge_m3s")
    rows = daily.where(is_finite("discharge_m3s") & (F.col("discharge_m3s") > 0) if positive_only else is_finite("discharge_m3s"))
    sorted_q = rows.groupBy("station_code").agg(F.sort_array(F.collect_list(q), asc=False).alias("v"), F.count("*").cast("int").alias("n"))
    grid = sorted_q.select("station_code", "v", "n", F.explode(F.array(*(F.lit(float(p)) for p in (targets or probabilities())))).alias("permanence_pct"))
    at = F.col("permanence_pct") * F.col("n") / 100
    i = F.least(F.greatest(F.floor(at).cast("int"), F.lit(1)), F.col("n"))
    low, high = F.element_at("v", i), F.element_at("v", F.least(i + 1, F.col("n")))
    part = F.least(F.greatest(at - i, F.lit(0.0)), F.lit(1.0))
    return grid.select("station_code", "permanence_pct", (low + part * (high - low)).alias("discharge_m3s"))


def eligible(annual: DataFrame) -> DataFrame:
    """Stations with at least MIN_YEARS years that have a mean."""
    return annual.where(is_finite("q_mean")).groupBy("station_code").agg(F.countDistinct("year").alias("n")).where(F.col("n") >= MIN_YEARS).select("station_code")


def rolling_five_years(annual: DataFrame) -> DataFrame:
    """Windows of five consecutive years that all have a mean."""
    w = Window.partitionBy("station_code").orderBy("year").rangeBetween(0, 4)
    rows = annual.where(is_finite("q_mean")).select("station_code", F.col("year").alias("start_year"), (F.col("year") + 4).alias("end_year"), F.count("*").over(w).alias("n"), F.avg("q_mean").over(w).alias("q_mean_5yr"), F.min("q_mean").over(w).alias("q_min_annual"), F.max("q_mean").over(w).alias("q_max_annual"))
    return rows.where("n = 5").drop("n").withColumn("period_label", F.concat_ws("–", F.col("start_year").cast("string"), F.col("end_year").cast("string")))


def extreme_five_years(rolling: DataFrame, wettest: bool = False) -> DataFrame:
    """Each station's driest (or wettest) window, the earliest of equal ones."""
    row = F.struct("q_mean_5yr", "start_year", "end_year", "period_label") if not wettest else F.struct((-F.col("q_mean_5yr")).alias("q"), "start_year", "end_year", "period_label", "q_mean_5yr")
    return rolling.groupBy("station_code").agg(F.min(row).alias("r")).select("station_code", "r.start_year", "r.end_year", "r.period_label", "r.q_mean_5yr")


def monthly_volume(monthly: DataFrame) -> DataFrame:
    """Volume in hm3 of each month with a mean, over the days present."""
    return monthly.where(is_finite("q_mean")).withColumn("volume_hm3", F.col("q_mean") * F.col("days_in_period") * 86400 / 1e6)


def critical_volume(monthly: DataFrame, annual: DataFrame) -> DataFrame:
    """The monthly volumes within each station's driest five years."""
    dry = extreme_five_years(rolling_five_years(annual)).select("station_code", "start_year", "end_year", "period_label")
    return monthly_volume(monthly).join(dry, "station_code").where("year between start_year and end_year")


def regularization(daily: DataFrame, monthly: DataFrame, annual: DataFrame, demand_pct: Sequence[int] = tuple(range(10, 101))) -> DataFrame:
    """Storage that meets each demand (percent of the mean flow), over the whole series and the driest five years.

    The sequent peak D = max(0, D' + demand - volume) folds a station's months, which the calendar bounds: they are one
    array, and demands are folds of it, not copies of its rows.
    """
    whole = monthly_volume(monthly).select("station_code", "year", "month", "days_in_period", "volume_hm3", F.lit("Série completa").alias("cenario"))
    dry = critical_volume(monthly, annual).select("station_code", "year", "month", "days_in_period", "volume_hm3", F.lit("5 anos mais secos").alias("cenario"))
    months = whole.unionByName(dry).join(eligible(annual), "station_code", "left_semi").join(mean_flow(daily).where("qmlt > 0"), "station_code")
    month = F.struct("year", "month", (F.col("days_in_period") * 86400 / 1e6).alias("full"), "volume_hm3")
    series = months.groupBy("station_code", "cenario", "qmlt").agg(F.sort_array(F.collect_list(month)).alias("months"))
    grid = spread(series, "station_code", "cenario").select("*", F.explode(F.array(*(F.lit(p) for p in demand_pct))).alias("demand_pct_qmlt"))
    demand = F.col("qmlt") * F.col("demand_pct_qmlt") / 100

    def fold(acc: Column, m: Column) -> Column:
        d = F.greatest(F.lit(0.0), acc["d"] + demand * m["full"] - m["volume_hm3"])
        return F.struct(d.alias("d"), F.greatest(acc["top"], d).alias("top"))

    top = F.aggregate("months", F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("top")), fold, lambda acc: acc["top"])
    return grid.select("station_code", "cenario", "demand_pct_qmlt", demand.alias("demand_m3s"), top.alias("regularization_volume_hm3"))


def rippl(monthly: DataFrame, annual: DataFrame) -> DataFrame:
    """Cumulative volume through the driest five years."""
    w = Window.partitionBy("station_code").orderBy("year", "month")
    rows = critical_volume(monthly, annual).join(eligible(annual), "station_code", "left_semi")
    return rows.select("station_code", F.col("period_label").alias("critical_period"), F.row_number().over(w).alias("month_index"), "year", "month", F.format_string("%04d-%02d", "year", "month").alias("period"), "q_mean", "volume_hm3", F.sum("volume_hm3").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative_volume_hm3"))
