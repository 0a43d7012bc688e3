"""Batch products: de-duplicated measurements, curves and sections with ledgers, inventories, request logs, date windows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.functions.columns import finite, parse_segment_number, yes

REASONS = ("missing_datetime", "lower_consistency_level", "older_duplicate")


def clean_levels(rows: DataFrame, keys: Sequence[str], time: str, ordinal: Sequence[str], update: str = "last_update") -> DataFrame:
    """Every row with ``removed_reason``: null for the one that stays of each key.

    Rows without a time go; a missing level is 1; where a key has level 2, other levels go; of equal keys and levels the
    latest update stays (nulls last), then the ordinal. Kept and removed rows together are the input.
    """
    rows = rows.withColumn("consistency_level", F.coalesce("consistency_level", F.lit(1)))
    key = Window.partitionBy(*keys)
    has_two = F.max((F.col("consistency_level") == 2).cast("int")).over(key) == 1
    order = Window.partitionBy(*keys, "consistency_level").orderBy(F.desc_nulls_last(update), *(F.asc(o) for o in ordinal))
    timed = rows.where(F.col(time).isNotNull()).withColumns({"__lower": has_two & (F.col("consistency_level") != 2), "__n": F.row_number().over(order)})
    reason = F.when(F.col("__lower"), REASONS[1]).when(F.col("__n") > 1, REASONS[2])
    kept = timed.withColumn("removed_reason", reason).drop("__lower", "__n")
    return kept.unionByName(rows.where(F.col(time).isNull()).withColumn("removed_reason", F.lit(REASONS[0])))


def split_ledger(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, ledger of removed rows)."""
    return cleaned.where("removed_reason is null").drop("removed_reason"), cleaned.where("removed_reason is not null")


def clean_measurements(measurements: DataFrame, ordinal: Sequence[str] = ("measurement_id",)) -> DataFrame:
    return clean_levels(measurements, ["station_code", "measurement_datetime"], "measurement_datetime", ordinal)


def curve_segments(curves: DataFrame) -> DataFrame:
    """Adds the number and count that texts such as 02/03 report."""
    return curves.withColumns({"segment_number": parse_segment_number("segment_number_raw"), "n_segments_reported": parse_segment_number("segment_number_raw", last=True)})


def curve_summary(curves: DataFrame) -> DataFrame:
    """One row for each curve: validity, segments, stage range."""
    return curves.groupBy("station_code", "rating_curve_id").agg(
        F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"), F.count("*").alias("n_segments"), F.countDistinct("segment_number").alias("n_distinct_segment_numbers"), F.max("n_segments_reported").alias("n_segments_reported_max"),
        F.min(finite("stage_min_cm")).alias("stage_min_cm"), F.max(finite("stage_max_cm")).alias("stage_max_cm"),
    )


def number_vertices(vertices: DataFrame, ordinal: Sequence[str]) -> DataFrame:
    """Vertex order within its section: by distance (nulls last), then the ordinal; and an id of both."""
    order = Window.partitionBy("cross_section_id").orderBy(F.asc_nulls_last("vertex_distance_m"), *ordinal)
    numbered = vertices.withColumn("vertex_order", F.row_number().over(order))
    return numbered.withColumn("cross_section_vertex_id", F.concat_ws("__", "cross_section_id", F.lpad(F.col("vertex_order").cast("string"), 4, "0")))


def section_summary(vertices: DataFrame) -> DataFrame:
    """One row for each cross section: vertices, extents, missing values."""
    d, h = finite("vertex_distance_m"), finite("vertex_stage_cm")
    return vertices.groupBy("station_code", "cross_section_id").agg(
        F.count("*").alias("n_vertices"), F.min(d).alias("vertex_distance_min_m"), F.max(d).alias("vertex_distance_max_m"), F.min(h).alias("vertex_stage_min_cm"), F.max(h).alias("vertex_stage_max_cm"),
        F.count_if(d.isNull()).alias("n_missing_vertex_distance"), F.count_if(h.isNull()).alias("n_missing_vertex_stage"),
    )


def consolidate_inventories(api: DataFrame, telemetric: DataFrame, conventional: DataFrame, temporal: Sequence[str] = (), ordinal: str | None = None) -> DataFrame:
    """One row a station: the API's before the telemetric's before the conventional service's, with source flags.

    Of a station's rows in one inventory the first by ``ordinal`` (a column that numbers each inventory's rows) stays;
    without one, the least row. ``temporal`` columns prefer the conventional service's first row, then the row's own.
    """
    named = [(api, "api", 1), (telemetric, "ws_telemetric", 2), (conventional, "ws_conventional", 3)]
    rows = None
    for df, name, rank in named:
        some = df.withColumns({"source_route": F.lit(name), "source_priority": F.lit(rank)})
        rows = some if rows is None else rows.unionByName(some, allowMissingColumns=True)
    names = [c for c in rows.columns if c not in ("station_code", ordinal)]
    first = [ordinal] if ordinal else []
    best = F.min(F.struct("source_priority", *first, *(c for c in names if c != "source_priority")))
    flags = [F.bool_or(F.col("source_route") == n).alias(f"source_{n}") for _, n, _ in named]
    later = F.min(F.when(F.col("source_route") == "ws_conventional", F.struct(*first, *(c for c in names if c != "source_priority"))))
    out = rows.groupBy("station_code").agg(best.alias("r"), *flags, later.alias("__later"))
    return out.select("station_code", *(F.coalesce(f"__later.{c}", F.col(f"r.{c}")).alias(c) if c in temporal else F.col(f"r.{c}").alias(c) for c in names), *(f"source_{n}" for _, n, _ in named))


def window_status(log: DataFrame) -> DataFrame:
    """Each request window's attempts, whether one ever succeeded, and the latest status."""
    last = F.max(F.struct("row_id", "success", "http_status"))
    rows = log.groupBy("station_code", "route_name", "date_start").agg(F.count("*").alias("n_attempts"), F.bool_or("success").alias("ever_success"), last.alias("l"))
    return rows.select("station_code", "route_name", "date_start", "n_attempts", "ever_success", F.col("l.success").alias("last_success"), F.col("l.http_status").alias("last_http_status"))


def _status(done: Column, total: Column) -> Column:
    return F.when(done == total, "completed").when(done > 0, "partial").otherwise("failed")


def route_status(windows: DataFrame) -> DataFrame:
    rows = windows.groupBy("station_code", "route_name").agg(F.count("*").alias("n_windows"), F.count_if("ever_success").alias("n_success_windows"), F.sum("n_attempts").alias("n_attempts"))
    return rows.withColumn("status", _status(F.col("n_success_windows"), F.col("n_windows")))


def station_status(routes: DataFrame) -> DataFrame:
    rows = routes.groupBy("station_code").agg(F.count("*").alias("n_routes"), F.count_if(F.col("status") == "completed").alias("n_completed_routes"), F.count_if(F.col("status") == "failed").alias("n_failed_routes"), F.sum("n_windows").alias("n_windows"))
    return rows.withColumn("status", F.when(F.col("n_completed_routes") == F.col("n_routes"), "completed").when(F.col("n_failed_routes") == F.col("n_routes"), "failed").otherwise("partial"))


def retry_candidates(windows: DataFrame, limit: int | None = None) -> DataFrame:
    """Windows that never succeeded; a run may take the first ``limit`` of them."""
    rows = windows.where("not ever_success").select("station_code", "route_name", "date_start", "n_attempts", "last_http_status")
    return rows if limit is None else rows.orderBy("station_code", "route_name", "date_start").limit(limit)


def remaining_tasks(tasks: DataFrame, log: DataFrame, keys: Sequence[str] = ("station_code", "route_name", "date_start")) -> DataFrame:
    """Planned windows that the log does not have yet."""
    return tasks.join(log.select(*keys).distinct(), list(keys), "left_anti")


def task_windows(stations: DataFrame, routes: Sequence[str], start: str, end: str, days: int = 366) -> DataFrame:
    """Stations by routes by windows of at most ``days`` days."""
    spans = F.transform(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {days} days")), lambda d: F.struct(d.alias("date_start"), F.least(F.date_add(d, days - 1), F.lit(end).cast("date")).alias("date_end")))
    return stations.select("station_code", F.explode(F.array(*map(F.lit, routes))).alias("route_name")).select("*", F.inline(spans))


def cluster_dates(days: Sequence[date], margin: int = 1, gap: int = 3, most: int = 31) -> list[tuple[date, date, int]]:
    """Windows of ± margin days, merged while the next begins within ``gap`` days and the whole spans at most ``most``."""
    out: list[list] = []
    for d in sorted(set(days)):
        lo, hi = d - timedelta(days=margin), d + timedelta(days=margin)
        if out and lo <= out[-1][1] + timedelta(days=gap) and (hi - out[-1][0]).days + 1 <= most:
            out[-1][1] = max(out[-1][1], hi)
            out[-1][2] += 1
        else:
            out.append([lo, hi, 1])
    return [tuple(c) for c in out]


def date_clusters(measurements: DataFrame) -> DataFrame:
    """Request windows around each station's measurement dates; the span limit depends on the cluster's start, so it is a loop."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = cluster_dates(list(pdf["measurement_date"]))
        return pd.DataFrame({"station_code": pdf["station_code"].iloc[0], "cluster_id": range(1, len(found) + 1), "date_start": [c[0] for c in found], "date_end": [c[1] for c in found], "n_measurement_dates": [c[2] for c in found]})

    dates = measurements.where("measurement_date is not null").select("station_code", "measurement_date").distinct()
    return dates.groupBy("station_code").applyInPandas(run, "station_code string, cluster_id int, date_start date, date_end date, n_measurement_dates int")


def measurement_summary(measurements: DataFrame) -> DataFrame:
    """By station: counts, extents, years and levels."""
    h, q = finite("stage_cm"), finite("discharge_m3s")
    return measurements.groupBy("station_code").agg(
        F.count("*").alias("n_measurements"), F.min("measurement_datetime").alias("first_measurement"), F.max("measurement_datetime").alias("last_measurement"), F.countDistinct(F.year("measurement_datetime")).alias("n_years_with_measurements"),
        F.count(h).alias("n_stage_values"), F.count(q).alias("n_discharge_values"), F.count_if(F.col("consistency_level") == 1).alias("n_level_1"), F.count_if(F.col("consistency_level") == 2).alias("n_level_2"), F.min(h).alias("stage_min_cm"), F.max(h).alias("stage_max_cm"), F.avg(q).alias("discharge_mean_m3s"),
    )


def station_year_summary(measurements: DataFrame) -> DataFrame:
    q = finite("discharge_m3s")
    return measurements.groupBy("station_code", F.year("measurement_datetime").alias("year")).agg(F.count("*").alias("n_measurements"), F.countDistinct("measurement_date").alias("n_dates"), F.min(q).alias("discharge_min_m3s"), F.max(q).alias("discharge_max_m3s"), F.avg(q).alias("discharge_mean_m3s"))


def duplicate_keys(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """How many keys several rows have."""
    return df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("n_failures")).select(F.lit(f"duplicate:{name}").alias("check"), "n_failures")


def unlinked_keys(child: DataFrame, parent: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """How many different keys of the child the parent lacks."""
    return child.select(*keys).distinct().join(parent.select(*keys).distinct(), list(keys), "left_anti").agg(F.count("*").alias("n_failures")).select(F.lit(f"link:{name}").alias("check"), "n_failures")


def null_keys(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    missing = yes(F.lit(False))
    for k in keys:
        missing = missing | F.col(k).isNull()
    return df.agg(F.count_if(missing).alias("n_failures")).select(F.lit(f"null:{name}").alias("check"), "n_failures")


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """How many rows hold each value of a column, the most frequent first, then by value; null is a value."""
    return df.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value"))


def qc_summary(cleaned: DataFrame, keys: Sequence[str], missing: Sequence[str], stations: str = "station_code") -> DataFrame:
    """One row that sums a cleaning up: rows in, kept and removed (by reason), stations, duplicate keys that are left, and null values by column."""
    kept = F.col("removed_reason").isNull()
    left = cleaned.where(kept).groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("n_duplicate_keys_left"))
    row = cleaned.agg(
        F.count("*").alias("n_rows_in"), F.count_if(kept).alias("n_rows_kept"), *(F.count_if(F.col("removed_reason") == r).alias(f"n_removed_{r}") for r in REASONS),
        F.countDistinct(F.when(kept, F.col(stations))).alias("n_stations"), *(F.count_if(kept & F.col(c).isNull()).alias(f"n_missing_{c}") for c in missing),
    )
    return row.crossJoin(left)  # one row each


def first_known(df: DataFrame, keys: Sequence[str], columns: Sequence[str], ordinal: str) -> DataFrame:
    """Of each key, each column's first value that is not null, by the ordinal; null if it has none."""
    firsts = [F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(ordinal).alias("o"), F.col(c).alias("v")))).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*firsts).select(*keys, *(F.col(f"{c}.v").alias(c) for c in columns))
