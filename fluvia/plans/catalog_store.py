"""Registered queries of stored products: snapshots, counters, release validation, station files and captured errors."""

from __future__ import annotations

import uuid
import zlib
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.functions import columns, tables
from fluvia.operators import cleaning, diagnostics, display, extremes, flow, metrics
from fluvia.plans import catalog_more
from fluvia.plans.bindings import cte, view
from fluvia.plans.catalog import ORACLES, flow_grid, query
from fluvia.plans.catalog_more import CLEAN, stations
from fluvia.session import scratch_dir, shared_dir
from fluvia.sources import exports, sinks
from fluvia.sources.rest import Response
from fluvia.sources.store import Store
from fluvia.streaming import downloads


def new_store(spark: SparkSession) -> Store:
    return Store(spark, f"{scratch_dir(spark)}/products-{uuid.uuid4().hex}")


def products(spark: SparkSession, sf_dir: str) -> dict[str, metrics.Counted]:
    """The four cleaned products, counted while they are written."""
    numbered = cleaning.number_vertices(view(spark, sf_dir, "vertices"), ["vertex_key"])
    return {
        "measurements": metrics.counted(cleaning.clean_measurements(view(spark, sf_dir, "measurements")), "measurements"),
        "rating_curves": metrics.counted(cleaning.curve_segments(view(spark, sf_dir, "rating_curves")), "rating_curves"),
        "cross_section_vertices": metrics.counted(numbered, "cross_section_vertices"),
        "stations": metrics.counted(stations(spark, sf_dir).withColumn("missing_coordinates", F.col("latitude").isNull() | F.col("longitude").isNull()), "stations"),
    }


def _counts(product: str, source: str, pairs: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{product}' AS product, '{n}' AS metric, CAST({sql} AS VARCHAR) AS value FROM {source}" for n, sql in pairs.items())


def _missing(*columns: str) -> dict[str, str]:
    return {f"n_missing_{c}": f"count(*) FILTER (WHERE {c} IS NULL)" for c in columns}


def _negative(*columns: str) -> dict[str, str]:
    return {f"n_negative_{c}": f"count(*) FILTER (WHERE {c} < 0)" for c in columns}


_STAMP = "strftime({0}(measurement_datetime), '%Y-%m-%d %H:%M:%S')"


@query(
    f"""WITH {CLEAN}, {cte("rating_curves")}, {cte("vertices")}, {cte("stations")}, kept AS (SELECT * FROM cl WHERE reason IS NULL), sg AS (SELECT *, regexp_extract(segment_number_raw, '^(\\d+)', 1) AS sn FROM rating_curves)
{_counts("measurements", "cl", {"n_raw_records": "count(*)", "n_total_records_removed": "count(reason)"} | {f"n_removed_{r}": f"count(*) FILTER (WHERE reason = '{r}')" for r in cleaning.REASONS})}
UNION ALL {_counts("measurements", "kept", {"n_final_records": "count(*)", "n_stations": "count(DISTINCT station_code)"} | _missing("station_code", "measurement_datetime", "consistency_level", "discharge_m3s") | _negative("discharge_m3s", "stage_cm") | {"first_measurement_datetime": _STAMP.format("min"), "last_measurement_datetime": _STAMP.format("max")})}
UNION ALL {_counts("rating_curves", "sg", {"n_final_records": "count(*)", "n_stations": "count(DISTINCT station_code)", "n_missing_segment_number": "count(*) FILTER (WHERE sn = '')"} | _missing("station_code", "valid_to", "consistency_level", "stage_min_cm", "stage_max_cm", "coefficient_a", "coefficient_h0", "coefficient_n") | _negative("stage_min_cm", "stage_max_cm") | {"first_valid_from": "min(valid_from)", "last_valid_from": "max(valid_from)"})}
UNION ALL {_counts("cross_section_vertices", "vertices", {"n_final_records": "count(*)", "n_stations": "count(DISTINCT station_code)"} | _missing("station_code", "vertex_distance_m", "vertex_stage_cm") | _negative("vertex_distance_m", "vertex_stage_cm"))}
UNION ALL {_counts("stations", "stations", {"n_final_records": "count(*)", "n_stations": "count(DISTINCT station_code)", "n_missing_coordinates": "count(*) FILTER (WHERE latitude IS NULL OR longitude IS NULL)"} | _missing("station_code"))}"""
)
def product_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of four products, collected in the one commit that writes them; stations are counted on the stored tables."""
    store, made = new_store(spark), products(spark, sf_dir)
    store.commit({n: c.rows for n, c in made.items()})
    rows = [(n, metric, value) for n, c in made.items() for metric, value in c.values().items()]
    counted = spark.createDataFrame(rows, "product string, metric string, value string")
    for n in made:
        counted = counted.union(store.read(n).agg(F.count_distinct("station_code").cast("string").alias("value")).select(F.lit(n).alias("product"), F.lit("n_stations").alias("metric"), "value"))
    return counted


#: What a release has to hold.
CONSTRAINTS = {
    "stations": [metrics.Unique(("station_code",)), metrics.NotNull(("station_code",)), metrics.Holds("coordinates in range", "latitude IS NULL OR longitude IS NULL OR (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)")],
    "measurements": [metrics.Unique(("station_code", "measurement_datetime", "consistency_level")), metrics.Linked(("station_code",), "stations"), metrics.Holds("positive discharge", "discharge_m3s > 0")],
    "rating_curves": [metrics.Unique(("rating_curve_segment_id",)), metrics.NotNull(("valid_from", "valid_to")), metrics.Holds("stage range", "stage_max_cm >= stage_min_cm"), metrics.Holds("validity", "valid_to >= valid_from")],
    "cross_section_vertices": [metrics.Unique(("cross_section_vertex_id",)), metrics.NotNull(("vertex_distance_m",)), metrics.Linked(("station_code",), "stations")],
    "metadata": [metrics.NotNull(("key",))],
}


def _check(table: str, source: str, checks: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{table}' AS table_name, '{n}' AS constraint_name, (SELECT count(*) FROM {source}) AS n_rows, ({sql}) AS n_failures" for n, sql in checks.items())


@query(
    f"""WITH {CLEAN}, {cte("rating_curves")}, {cte("vertices")}, {cte("stations")}, kept AS (SELECT * FROM cl WHERE reason IS NULL)
{_check("stations", "stations", {"unique:station_code": "SELECT count(*) - count(DISTINCT station_code) FROM stations", "not_null:station_code": "SELECT count(*) FILTER (WHERE station_code IS NULL) FROM stations", "holds:coordinates in range": "SELECT count(*) FILTER (WHERE NOT coalesce(latitude IS NULL OR longitude IS NULL OR (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180), false)) FROM stations"})}
UNION ALL {_check("measurements", "kept", {"unique:station_code,measurement_datetime,consistency_level": "SELECT count(*) - count(DISTINCT (station_code, measurement_datetime, consistency_level)) FROM kept", "link:station_code->stations": "SELECT count(*) FROM kept k WHERE NOT EXISTS (SELECT 1 FROM stations s WHERE s.station_code = k.station_code)", "holds:positive discharge": "SELECT count(*) FROM kept WHERE NOT coalesce(discharge_m3s > 0, false)"})}
UNION ALL {_check("rating_curves", "rating_curves", {"unique:rating_curve_segment_id": "SELECT count(*) - count(DISTINCT rating_curve_segment_id) FROM rating_curves", "not_null:valid_from,valid_to": "SELECT count(*) FROM rating_curves WHERE valid_from IS NULL OR valid_to IS NULL", "holds:stage range": "SELECT count(*) FROM rating_curves WHERE NOT coalesce(stage_max_cm >= stage_min_cm, false)", "holds:validity": "SELECT count(*) FROM rating_curves WHERE NOT coalesce(valid_to >= valid_from, false)"})}
UNION ALL {_check("cross_section_vertices", "vertices", {"unique:cross_section_vertex_id": "SELECT 0", "not_null:vertex_distance_m": "SELECT count(*) FROM vertices WHERE vertex_distance_m IS NULL", "link:station_code->stations": "SELECT count(*) FROM vertices v WHERE NOT EXISTS (SELECT 1 FROM stations s WHERE s.station_code = v.station_code)"})}
UNION ALL SELECT 'metadata', 'not_null:key', NULL, NULL"""
)
def release_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constraints of a release over its stored products, one aggregate a table; the table of metadata is absent here."""
    store = new_store(spark)
    store.commit({n: c.rows for n, c in products(spark, sf_dir).items()})
    return metrics.validate({n: store.read(n) for n in store.tables()}, CONSTRAINTS)


@query(
    f"""WITH {cte("measurements")}, s AS (SELECT station_code, count(*) AS n, count(*) FILTER (WHERE consistency_level = 2) AS n2 FROM measurements GROUP BY 1), {cte("rating_curves")}, c AS (SELECT station_code, count(*) AS k FROM rating_curves GROUP BY 1)
SELECT v AS version, coalesce(s.station_code, c.station_code) AS station_code, CASE WHEN v = 1 THEN n WHEN n2 > 0 THEN n2 END AS n_measurements, k AS n_segments FROM (VALUES (1), (2)) t(v), s FULL JOIN c ON c.station_code = s.station_code WHERE v = 1 OR n2 > 0 OR k IS NOT NULL"""
)
def product_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of stored summaries: the second has other measurements and the curves of the first. Each is joined without an exchange."""
    store, m = new_store(spark), view(spark, sf_dir, "measurements")
    per_station = lambda df, name: df.groupBy("station_code").agg(F.count("*").alias(name))
    store.commit({"measurements": per_station(m, "n_measurements"), "rating_curves": per_station(view(spark, sf_dir, "rating_curves"), "n_segments")})
    store.commit({"measurements": per_station(m.where("consistency_level = 2"), "n_measurements")}, base=1)
    both = [store.read("measurements", v).hint("merge").join(store.read("rating_curves", v), "station_code", "full").select(F.lit(v).alias("version"), "station_code", "n_measurements", "n_segments") for v in store.versions()]
    return both[0].union(both[1])


@query()
def station_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of annual and monthly flows of every station, written by the executors into a new shared folder: name, bytes and hash of each."""
    folder = f"{shared_dir(spark)}/exports-{uuid.uuid4().hex}"
    grid = flow_grid(spark, sf_dir)
    annual, codes = flow.annual_stats(grid), stations(spark, sf_dir).select("station_code")
    exports.export_stations(annual, "annual", folder, day=date(2024, 1, 31), order_by=["year"], stations=codes)
    exports.export_stations(flow.monthly_matrix(flow.monthly_stats(grid), annual), "monthly_matrix", folder, day=date(2024, 1, 31), order_by=["label"])
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


@query(
    f"""WITH {cte("measurements")}, g AS (SELECT station_code, count(*) FILTER (WHERE stage_cm > 0 AND discharge_m3s > 0 AND measurement_date IS NOT NULL) AS n, count(DISTINCT stage_cm) FILTER (WHERE stage_cm > 0 AND discharge_m3s > 0 AND measurement_date IS NOT NULL) AS k FROM measurements GROUP BY 1)
SELECT station_code, n < 30 AS too_few, CASE WHEN n < 30 THEN n || ' positive measurements, 30 needed' END AS why FROM g WHERE n < 30 OR k >= 3"""
)
def captured_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations whose fit failed for want of measurements, beside those that were fitted or have no admissible fit."""
    rows = diagnostics.station_fits(view(spark, sf_dir, "measurements"))
    few = F.coalesce(F.col("error_class") == "ValueError", F.lit(False))
    return rows.select("station_code", few.alias("too_few"), F.when(few, F.col("error_message")).alias("why"))


def answer(route: str, station: str, start: date, end: date, token: str) -> Response:
    """What a service would say of a window, by the window alone: some are empty, some never succeed."""
    kind = zlib.crc32(f"{route} {station} {start}".encode()) % 16
    return Response(503, message="unavailable") if kind == 0 else Response(200, [] if kind == 1 else [{"station": station, "day": start.isoformat()}] * (kind % 3 + 1))


def lanes_for(windows: int, each: int = 25_000) -> int:
    """Lanes for so many windows, four at least: as many windows a lane whatever the table's size."""
    return max(4, -(-windows // each))


@query()
def resumable_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a stateful stream that downloads every window of the request log, in two steps, into a new shared folder.

    Lanes follow the log: a worker holds one lane's windows of a step.
    """
    folder = f"{shared_dir(spark)}/downloads-{uuid.uuid4().hex}"
    requests = view(spark, sf_dir, "request_log")
    tasks = requests.select("station_code", "route_name", "date_start", F.col("date_start").alias("date_end")).distinct()
    downloads.plan_downloads(tasks, f"{folder}/plan", files=2)
    downloads.download_stream(spark, f"{folder}/plan", f"{folder}/log", f"{folder}/checkpoint", answer, lanes=lanes_for(requests.count()), stop_after=1 << 30).awaitTermination()
    return spark.read.parquet(f"{folder}/log").select("route_name", "station_code", "date_start", "status", "n_attempts", "n_items")


@query("WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS status FROM orders) SELECT id, status FROM r ORDER BY substr(md5('67:' || CAST(id AS VARCHAR)), 1, 15), id LIMIT 8000")
def map_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8,000 points of the whole table, the same ones however it is partitioned."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return display.seeded_sample(rows, "id")


_MIXED = "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN {0} ELSE {1} END"


@query(
    f"""WITH d AS (SELECT o_orderkey AS id, {_MIXED.format("'day'", "'year'")} AS kind, CAST(o_orderdate AS DATE) AS d FROM orders), f AS (SELECT arg_min(kind, id) FILTER (WHERE kind IS NOT NULL) AS first FROM d)
SELECT id, CASE WHEN kind IS NOT NULL THEN d END AS by_value, CASE WHEN kind = first THEN d END AS by_column FROM d, f"""
)
def mixed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of two date formats, each parsed by its own, and all by the one that fits the first."""
    text = F.expr(_MIXED.format("date_format(o_orderdate, 'dd/MM/yyyy')", "date_format(o_orderdate, 'yyyy-MM-dd')"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), text.alias("by_column"), text.alias("by_value"))
    return columns.parse_dates_alike(rows, "by_column", "id").withColumn("by_value", columns.parse_date("by_value"))


@query(ORACLES["pot_test"])
def pot_tests_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests of peaks by the table function of that name."""
    tables.register(spark)
    grid, thresholds = catalog_more.fixed_threshold(spark, sf_dir)
    span = grid.groupBy("station_code").agg(F.year(F.min("date")).alias("y0"), F.year(F.max("date")).alias("y1"))
    peaks = thresholds.join(span, "station_code").join(extremes.pot_events(grid, thresholds).select("station_code", "date_peak", "q_peak_m3s"), "station_code", "left")
    sinks.create_views(spark, {"v_peaks": peaks, "v_thresholds": thresholds})
    return spark.sql("SELECT p.*, t.threshold_m3s FROM pot_tests(TABLE(SELECT station_code, date_peak, q_peak_m3s, y0, y1 FROM v_peaks) PARTITION BY station_code ORDER BY date_peak) p JOIN v_thresholds t ON t.station_code = p.station_code")
