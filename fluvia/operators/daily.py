"""Daily series: normalising month rows, merging records, grids and availability."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.functions.columns import failure_class, finite, is_finite, parse_date, parse_series_number, pick, station_code
from fluvia.session import count_parts, spread

#: Bytes of records that one task merges.
PART = 4 << 20
UNITS = {"discharge": ("Vazao", "m3/s"), "stage": ("Cota", "cm"), "rainfall": ("Chuva", "mm")}


def normalize_month_rows(df: DataFrame, variable: str, source: str = "") -> DataFrame:
    """One row for each day column of month rows: station, date, value, unit, status, level, daily flag, source column.

    Day columns are found by name (prefix, optional underscore, two digits), a day's status beside it. Days that the
    month does not have are left out.
    """
    prefix, unit = UNITS[variable]
    names = {c.lower(): c for c in df.columns}
    days = sorted((int(m[1]), c) for c in df.columns if (m := re.fullmatch(rf"(?i){prefix}_?(\d{{2}})", c)) and 1 <= int(m[1]) <= 31)
    if not days:
        raise ValueError(f"no day columns {prefix}01..31")
    null = F.lit(None).cast("string")

    def status(name: str) -> Column:
        found = names.get(f"{name}status".lower()) or names.get(f"{name}_status".lower())
        return F.col(f"`{found}`").cast("string") if found else null

    cells = F.array(*(F.struct(F.lit(d).alias("day"), F.col(f"`{c}`").cast("string").alias("raw"), status(c).alias("source_status"), F.lit(c).alias("source_column")) for d, c in days))
    month = F.trunc(parse_date(pick(df, ("Data", "DataHora", "Data_Hora_Dado"), "string", required=True)), "month")
    rows = df.select(
        station_code(pick(df, ("EstacaoCodigo", "codigoestacao", "CodigoEstacao", "CodigoDaEstacao"), "string", required=True)).alias("station_code"),
        month.alias("month"),
        F.nullif(F.trim(pick(df, ("NivelConsistencia", "Nivel_Consistencia"), "string")), F.lit("")).alias("consistency_level"),
        F.nullif(F.trim(pick(df, ("MediaDiaria", "Mediadiaria"), "string")), F.lit("")).alias("daily_flag"),
        F.explode(cells).alias("cell"),
    ).where("month is not null")
    return rows.where(F.col("cell.day") <= F.dayofmonth(F.last_day("month"))).select(
        "station_code", F.date_add("month", F.col("cell.day") - 1).alias("date"), F.lit(variable).alias("variable"), parse_series_number("cell.raw").alias("value"), F.lit(unit).alias("unit"),
        F.col("cell.source_status").alias("source_status"), "consistency_level", "daily_flag", F.lit(source).alias("source"), F.col("cell.source_column").alias("source_column"),
    )


def _ranks() -> tuple[Column, Column]:
    """The ranks of a record's level and of its daily flag, 0 first."""
    level, flag = _level(), F.col("daily_flag")
    return F.when(level == "2", 0).when(level == "1", 1).otherwise(2), F.when(flag == "1", 0).when(flag == "0", 1).otherwise(2)


def _precedence(value: str, ordinal: Sequence[str]) -> Column:
    by_level, by_flag = _ranks()
    return F.struct(by_level.alias("p1"), F.col(value).isNull().cast("int").alias("p2"), by_flag.alias("p3"), *(F.col(o).alias(f"k_{o}") for o in ordinal), value, "consistency_level", "daily_flag", "source_status")


def _level() -> Column:
    return F.coalesce(F.nullif(F.trim("consistency_level"), F.lit("")), F.lit("sem_nivel"))


def merge_daily(records: DataFrame, ordinal: Sequence[str]) -> DataFrame:
    """One record for each station, variable and date.

    Level 2 goes before 1 before others, then records with a value, then daily flag 1 before 0 before others, then the
    ordinal. Counts tell how many records there were, the most in one level, and whether a level had several. Records move
    once, to their station, and are sorted once, by station, date, variable and level: both steps and what follows by
    station and date need nothing else.
    """
    keys = ["station_code", "date", "variable"]
    rows = spread(records.select(*keys, "value", "consistency_level", "daily_flag", "source_status", *ordinal), "station_code", each=PART)
    levels = rows.groupBy(*keys, _level().alias("__level")).agg(F.count("*").alias("n"), F.min(_precedence("value", ordinal)).alias("best"))
    merged = levels.groupBy(*keys).agg(F.min("best").alias("best"), F.sum("n").alias("n_source_records"), F.max("n").alias("max_same_consistency_records"))
    return merged.select("station_code", "variable", "date", "best.value", "best.consistency_level", "best.daily_flag", "best.source_status", "n_source_records", "max_same_consistency_records", (F.col("max_same_consistency_records") > 1).alias("has_duplicate_same_consistency"))


def merge_values(records: DataFrame, values: Sequence[str], ordinal: Sequence[str], parts: int | None = None) -> DataFrame:
    """The merged values of several variables that are columns of the same records: station_code, date and each value.

    Each variable's value is that of its own first record in the order of ``merge_daily``; all in one pass. What moves of level
    and flag are their ranks. The stations are dealt over ``parts``, which follow the input by default.
    """
    by_level, by_flag = _ranks()
    rows = records.select("station_code", "date", *values, by_level.cast("tinyint").alias("p1"), by_flag.cast("tinyint").alias("p3"), *ordinal)
    rows = rows.repartition(parts or count_parts(records, PART), "station_code")
    merged = rows.groupBy("station_code", "date").agg(*(F.min(F.struct("p1", F.col(v).isNull().alias("p2"), "p3", *(F.col(o).alias(f"k_{o}") for o in ordinal), v)).alias(v) for v in values))
    return merged.select("station_code", "date", *(F.col(f"{v}.{v}").alias(v) for v in values))


def with_until(daily: DataFrame, name: str = "until") -> DataFrame:
    """Adds the day before the station's next record (the last one's own date); rows without a date are left out. One row a station and day in."""
    following = F.lead("date").over(Window.partitionBy("station_code").orderBy("date"))
    return daily.where("date is not null").withColumn(name, F.coalesce(F.date_sub(following, 1), F.col("date")))


def complete_grid(daily: DataFrame) -> DataFrame:
    """Every day from a station's first to its last date; days without a record have nulls. One row a station and day in.

    Each record is followed by the days up to the station's next one: the table is read and shuffled once, and joined with
    nothing. A station's records are one window, bounded by the calendar. Rows without a date are left out.
    """
    rows = with_until(daily, "__last").select("*", F.posexplode(F.sequence("date", "__last")).alias("__n", "__day"))
    own = [F.when(F.col("__n") == 0, F.col(f"`{c}`")).alias(c) for c in daily.columns if c not in ("station_code", "date")]
    return rows.select("station_code", F.col("__day").alias("date"), *own)


def discharge_series(merged: DataFrame, name: str = "discharge_m3s") -> DataFrame:
    """station_code, date, the value and whether it is finite."""
    return merged.select("station_code", "date", F.col("value").alias(name), is_finite("value").alias("has_value"))


def monthly_availability(daily: DataFrame) -> DataFrame:
    """For each station and month of its span: days expected and observed, failure percentage and class."""
    seen = daily.where(is_finite("value")).select("station_code", F.trunc("date", "month").alias("month_start"), "date").distinct().groupBy("station_code", "month_start").agg(F.count("*").alias("n"))
    span = daily.groupBy("station_code").agg(F.trunc(F.min("date"), "month").alias("lo"), F.trunc(F.max("date"), "month").alias("hi"))
    months = span.select("station_code", F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month_start"))
    expected = F.dayofmonth(F.last_day("month_start"))
    observed = F.least(F.coalesce("n", F.lit(0)), expected)
    pct = 100 * (expected - observed) / expected
    return months.join(seen, ["station_code", "month_start"], "left").select("station_code", "month_start", expected.cast("long").alias("days_expected"), observed.cast("long").alias("days_observed"), (expected - observed).cast("long").alias("days_missing"), pct.alias("failure_pct"), failure_class(pct).alias("failure_class"))


def monthly_gaps(grid: DataFrame, has: str = "has_value") -> DataFrame:
    """Rows of a complete grid by station and month: expected, observed, missing, failure class."""
    expected, observed = F.count("*"), F.count_if(F.col(has))
    rows = grid.groupBy("station_code", F.year("date").alias("year"), F.month("date").alias("month")).agg(expected.alias("days_expected"), observed.alias("days_observed"))
    pct = 100 * (F.col("days_expected") - F.col("days_observed")) / F.col("days_expected")
    return rows.withColumn("failure_pct", pct).withColumn("failure_class", failure_class(pct))


def single_station(df: DataFrame, expected: str | None = None) -> str:
    """The one station code of a result; several, none, or another than expected raise."""
    codes = [r[0] for r in df.select("station_code").where("station_code is not null").distinct().limit(2).collect()]
    if len(codes) != 1:
        raise ValueError(f"one station is expected, found {codes}")
    if expected is not None and codes[0].lstrip("0") != expected.lstrip("0"):
        raise ValueError(f"station {expected} is expected, found {codes[0]}")
    return codes[0]


def value_stats(has: Column, value: Column | str, prefix: str) -> list[Column]:
    """Days, days with a value, missing, failure percentage, and mean, least and greatest finite value."""
    n, k, v = F.count("*"), F.count_if(has), finite(value)
    return [n.alias("days_in_period"), k.alias("days_with_value"), (n - k).alias("days_missing"), (100 * (n - k) / n).alias("failure_pct"), F.avg(v).alias(f"{prefix}_mean"), F.min(v).alias(f"{prefix}_min"), F.max(v).alias(f"{prefix}_max")]


@dataclass
class SeriesResult:
    """A set of daily records with where they came from; the variables are filters of one table."""

    source_type: str
    source_label: str
    records: DataFrame
    notes: list[str] = field(default_factory=list)

    def of(self, variable: str) -> DataFrame:
        return self.records.where(F.col("variable") == variable)

    def station_codes(self) -> DataFrame:
        return self.records.select("station_code").distinct()

    def require(self, variable: str) -> SeriesResult:
        """Raises where the variable has no records."""
        if self.of(variable).isEmpty():
            raise ValueError(f"the source has no {variable} records")
        return self


def combine(results: Sequence[SeriesResult]) -> SeriesResult:
    """The records of several results, with all notes; none at all raises."""
    if not results:
        raise ValueError("there is nothing to combine")
    records = results[0].records
    for r in results[1:]:
        records = records.unionByName(r.records, allowMissingColumns=True)
    return SeriesResult("combined", " + ".join(dict.fromkeys(r.source_label for r in results)), records, [n for r in results for n in r.notes])
