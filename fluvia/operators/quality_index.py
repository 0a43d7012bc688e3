"""Station indices, information score, display dictionary and index assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvia.functions.columns import completeness_class, ladder, overlap_class, parse_date, parse_product_number, pick, safe_divide, truthy, yes


def steps(x: Column, bounds: tuple[float, ...], results: tuple, none: object) -> Column:
    """``none`` for null or no more than 0; else the result of the first bound above x, or the last result."""
    return ladder(x, [(x.isNull() | (x <= 0), none), *((x < b, r) for b, r in zip(bounds, results, strict=False))], results[-1])


def measurement_indices(summary: DataFrame) -> DataFrame:
    n, years = F.col("n_measurements"), F.col("n_years_with_measurements")
    days = F.datediff("last_measurement", "first_measurement")
    return summary.withColumns({
        "measurement_period_years": days / 365.25, "pct_stage_values": safe_divide("n_stage_values", "n_measurements"), "pct_discharge_values": safe_divide("n_discharge_values", "n_measurements"), "stage_range_cm": F.col("stage_max_cm") - F.col("stage_min_cm"),
        "measurement_record_class": steps(n, (5, 20, 50), ("very_limited", "limited", "moderate", "substantial"), "none"), "measurement_temporal_class": steps(years, (3, 10, 20), ("very_short", "short", "moderate", "long"), "none"),
    }).withColumns({"stage_completeness_class": completeness_class(F.col("pct_stage_values")), "discharge_completeness_class": completeness_class(F.col("pct_discharge_values"))})


def curve_indices(curves: DataFrame, overlaps: DataFrame) -> DataFrame:
    lo, hi = F.col("stage_min_cm"), F.col("stage_max_cm")
    rows = curves.groupBy("station_code").agg(
        F.countDistinct("rating_curve_id").alias("n_rating_curves"), F.count("*").alias("n_rating_curve_segments"), F.count_if(F.col("valid_from").isNull()).alias("n_missing_valid_from"), F.count_if(F.col("valid_to").isNull()).alias("n_missing_valid_to"),
        F.count_if(lo.isNull() | hi.isNull()).alias("n_missing_stage_bounds"), F.count_if(hi < lo).alias("n_invalid_stage_range"), F.count_if(F.col("coefficient_a").isNull() | F.col("coefficient_h0").isNull() | F.col("coefficient_n").isNull()).alias("n_missing_coefficients"), (F.max(hi) - F.min(lo)).alias("curve_stage_range_cm"),
    ).join(overlaps, "station_code", "left").fillna(0, ["n_overlapping_pairs"])
    k = F.col("n_rating_curves")
    return rows.withColumns({
        "rating_curve_record_class": ladder(k, [(k <= 0, "none"), (k == 1, "single_curve"), (k < 5, "few_curves"), (k < 20, "multiple_curves")], "many_curves"), "rating_curve_overlap_class": overlap_class(F.col("n_overlapping_pairs")),
        "rating_curve_stage_range_class": steps(F.col("curve_stage_range_cm"), (100, 500), ("narrow", "moderate", "wide"), "not_available"),
    })


def section_indices(sections: DataFrame) -> DataFrame:
    rows = sections.groupBy("station_code").agg(F.countDistinct("cross_section_id").alias("n_cross_sections"), F.sum("n_vertices").alias("n_cross_section_vertices"), (F.max("vertex_distance_max_m") - F.min("vertex_distance_min_m")).alias("distance_span_m"), (F.max("vertex_stage_max_cm") - F.min("vertex_stage_min_cm")).alias("section_stage_range_cm"), F.sum("n_missing_vertex_distance").alias("n_missing_distance"), F.sum("n_missing_vertex_stage").alias("n_missing_stage"))
    k, v, d, h = F.col("n_cross_sections"), F.col("n_cross_section_vertices"), F.col("distance_span_m"), F.col("section_stage_range_cm")
    return rows.withColumns({
        "cross_section_record_class": ladder(k, [(k.isNull() | (k <= 0), "none"), (k == 1, "single_profile"), (k < 5, "few_profiles"), (k < 20, "multiple_profiles")], "many_profiles"), "cross_section_vertex_class": steps(v, (20, 100, 500), ("very_limited", "limited", "moderate", "substantial"), "none"),
        "cross_section_geometry_class": ladder(v, [(v.isNull() | (v <= 0), "not_available"), (d.isNull() | h.isNull(), "incomplete_geometry"), ((d <= 0) | (h <= 0), "invalid_or_flat_geometry")], "geometry_available"),
        "pct_vertices_with_distance": 1 - safe_divide("n_missing_distance", "n_cross_section_vertices"), "pct_vertices_with_stage": 1 - safe_divide("n_missing_stage", "n_cross_section_vertices"),
    })


def information_score(stations: DataFrame, measurements: DataFrame, curves: DataFrame, sections: DataFrame) -> DataFrame:
    """Every station's availability, preliminary information score (0 to 100), its parts, class, and map status.

    The inputs are the index tables of this module; a station without a product has zero for it.
    """
    s = stations
    for some, names in ((measurements, ("n_measurements", "n_years_with_measurements", "pct_stage_values", "pct_discharge_values")), (curves, ("n_rating_curves", "n_rating_curve_segments", "n_overlapping_pairs")), (sections, ("n_cross_sections",))):
        s = s.join(some.select("station_code", *names), "station_code", "left")
    return with_scores(s)


def with_scores(s: DataFrame) -> DataFrame:
    """The columns of ``information_score`` beside stations that have their counts already."""

    def points(flag: Column, n: int) -> Column:
        return F.when(yes(flag), n).otherwise(0)

    n, years, h, q = F.col("n_measurements"), F.col("n_years_with_measurements"), F.col("pct_stage_values"), F.col("pct_discharge_values")
    k, segments, overlaps, sections_n = F.col("n_rating_curves"), F.col("n_rating_curve_segments"), F.col("n_overlapping_pairs"), F.col("n_cross_sections")
    placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    least = F.least(F.coalesce(h, F.lit(0.0)), F.coalesce(q, F.lit(0.0)))
    s = s.withColumns({
        "has_coordinates": placed,
        "registration_score": points(placed, 10) + points(F.col("station_name") != "", 5) + points(F.col("basin_name").isNotNull(), 5) + points(F.col("municipality") != "", 5) + points(F.col("drainage_area") > 0, 10),
        "measurement_amount_score": steps(n, (5, 20, 50), (4, 8, 12, 15), 0), "measurement_temporal_score": steps(years, (3, 10, 20), (3, 6, 8, 10), 0), "measurement_completeness_score": ladder(least, [(least >= 0.95, 10), (least >= 0.80, 7), (least > 0, 4)], 0),
        "rating_curve_presence_score": steps(k, (2, 5), (8, 10, 12), 0), "rating_curve_segment_score": steps(segments, (5, 20), (4, 6, 8), 0), "rating_curve_overlap_score": F.when(k.isNull() | (k <= 0) | overlaps.isNull(), 0).when(overlaps == 0, 5).when(overlaps <= 5, 3).otherwise(1), "cross_section_presence_score": steps(sections_n, (2,), (3, 5), 0),
    })
    parts = [c for c in s.columns if c.endswith("_score")]
    s = s.withColumn("preliminary_information_score", reduce(lambda a, b: a + b, (F.col(c) for c in parts)))
    t = F.col("preliminary_information_score")
    has_m, has_c = yes(n > 0), yes(k > 0)
    s = s.withColumn("preliminary_information_class", ladder(t, [(t >= 80, "high_information"), (t >= 60, "moderate_information"), (t >= 40, "limited_information"), (t >= 20, "basic_registration_or_sparse_products")], "registration_only_or_incomplete"))
    s = s.withColumn("map_status", ladder(t, [(~placed, "missing_coordinates"), (has_m & has_c, "measurements_and_rating_curves"), (has_m, "measurements_only"), (has_c, "rating_curves_only")], "registration_only"))
    status = F.col("map_status")
    return s.withColumn("map_priority", ladder(status, [(status == v, i) for i, v in enumerate(("measurements_and_rating_curves", "measurements_only", "rating_curves_only", "registration_only"), 1)], 5))


def long_indices(scores: DataFrame, names: list[str]) -> DataFrame:
    """One row for each station and index."""
    rows = F.array(*(F.struct(F.lit(n).alias("index_name"), F.col(n).cast("double").alias("index_value"), F.lit(10 * i).alias("display_order")) for i, n in enumerate(names, 1)))
    return scores.select("station_code", F.inline(rows))


#: Group, name, value column, unit, class column (None: available or missing), direction, description, source, whether it can be calculated, display order.
STATION_INDICES = (
    ("Station registration", "Coordinates available", "has_coordinates", None, None, "presence", "Indicates whether latitude and longitude are available for mapping.", "stations_minimal.latitude and stations_minimal.longitude", True, 10),
    ("Station registration", "Drainage area available", "has_drainage_area", None, None, "presence", "Indicates whether drainage area is available and positive.", "stations_minimal.drainage_area", True, 20),
    ("Station registration", "Registered discharge period available", "has_registered_discharge_period", None, None, "presence", "Indicates whether station metadata reports a discharge-measurement availability period.", "stations_minimal.discharge_start_date and discharge_end_date", True, 30),
    ("Discharge measurements", "Processed discharge measurements available", "has_discharge_measurements_processed", None, None, "presence", "Indicates whether cleaned discharge-measurement records are available.", "discharge_measurements_summary_by_station", True, 100),
    ("Discharge measurements", "Number of discharge measurements", "n_measurements", "records", "measurement_record_class", "higher_is_more_informative", "Number of cleaned discharge-measurement records available for the station.", "discharge_measurements_summary_by_station.n_measurements", True, 110),
    ("Discharge measurements", "Years with discharge measurements", "n_years_with_measurements", "years", "measurement_temporal_class", "higher_is_more_informative", "Number of calendar years with at least one discharge measurement.", "discharge_measurements_summary_by_station.n_years_with_measurements", True, 120),
    ("Discharge measurements", "Stage availability in discharge measurements", "pct_stage_values", "%", "stage_completeness_class", "higher_is_more_complete", "Percentage of discharge-measurement records with stage values.", "discharge_measurements_summary_by_station.n_stage_values and n_measurements", True, 130),
    ("Discharge measurements", "Discharge availability in discharge measurements", "pct_discharge_values", "%", "discharge_completeness_class", "higher_is_more_complete", "Percentage of discharge-measurement records with discharge values.", "discharge_measurements_summary_by_station.n_discharge_values and n_measurements", True, 140),
    ("Rating curves", "Processed rating curves available", "has_rating_curves_processed", None, None, "presence", "Indicates whether cleaned rating-curve records are available.", "rating_curve_summary and rating_curves", True, 200),
    ("Rating curves", "Number of rating curves", "n_rating_curves", "curves", "rating_curve_record_class", "context_dependent", "Number of distinct rating curves available for the station.", "rating_curve_summary.rating_curve_id", True, 210),
    ("Rating curves", "Number of rating-curve segments", "n_rating_curve_segments", "segments", "rating_curve_segment_class", "context_dependent", "Number of rating-curve segments available for the station.", "rating_curves.rating_curve_segment_id", True, 220),
    ("Rating curves", "Overlapping rating-curve validity pairs", "n_overlapping_pairs", "pairs", "rating_curve_overlap_class", "lower_is_preferable_for_screening", "Number of rating-curve pairs with overlapping validity periods. This is a screening indicator only.", "rating_curve_summary.valid_from and valid_to", True, 230),
    ("Cross sections", "Processed cross-section profiles available", "has_cross_sections_processed", None, None, "presence", "Indicates whether cleaned cross-section profile records are available.", "cross_sections and cross_section_summary", True, 300),
    ("Cross sections", "Number of cross-section profiles", "n_cross_sections", "profiles", "cross_section_record_class", "higher_is_more_informative", "Number of cross-section profile records available for the station.", "cross_sections.cross_section_id", True, 310),
    ("Cross sections", "Number of cross-section vertices", "n_cross_section_vertices", "vertices", "cross_section_vertex_class", "higher_is_more_informative", "Number of vertex records available for plotting cross-section profiles.", "cross_section_vertices.cross_section_vertex_id", True, 320),
    ("Cross sections", "Cross-section distance span", "distance_span_m", "m", "cross_section_geometry_class", "context_dependent", "Approximate maximum horizontal span covered by available cross-section vertices.", "cross_sections.vertex_distance_min_m and vertex_distance_max_m", True, 330),
    ("Station assessment", "Preliminary information score", "preliminary_information_score", "0-100", "preliminary_information_class", "higher_is_more_informative", "Completeness-oriented screening score based only on the current local export. It is not a final hydrological quality score.", "station metadata, discharge-measurement summaries, rating-curve summaries, and cross-section availability", True, 400),
    ("Future indices", "Daily stage/discharge gap indicators", None, None, "not_calculable_current_export", "lower_is_preferable", "Future index. Requires complete or compacted daily stage/discharge gap summaries.", "future daily stage/discharge tables or gap-summary table", False, 500),
    ("Future indices", "Discharge without valid rating curve", None, None, "not_calculable_current_export", "lower_is_preferable", "Future index. Requires comparison between discharge records and rating-curve validity periods.", "future daily discharge/stage summaries and rating-curve validity matching", False, 510),
)


def short_number(c: Column, digits: int) -> Column:
    """A rounded number as text, without a decimal part of zero."""
    return F.regexp_replace(F.round(c, digits).cast("string"), r"\.0$", "")


def assessment(scores: DataFrame, measurements: DataFrame, curves: DataFrame, sections: DataFrame) -> DataFrame:
    """A station's scores, the columns of its index tables, and a flag for each product; absent products count zero."""
    s = assemble(scores, [measurements, curves, sections])
    counts = ["n_measurements", "n_years_with_measurements", "n_rating_curves", "n_rating_curve_segments", "n_overlapping_pairs", "n_cross_sections", "n_cross_section_vertices"]
    s = s.fillna(0, counts)
    k = F.col("n_rating_curve_segments")
    period = F.col("discharge_start_date").isNotNull() if "discharge_start_date" in s.columns else F.lit(False)
    s = s.withColumns({
        "has_drainage_area": yes(F.col("drainage_area") > 0), "has_registered_discharge_period": period,
        "has_discharge_measurements_processed": F.col("n_measurements") > 0, "has_rating_curves_processed": F.col("n_rating_curves") > 0, "has_cross_sections_processed": F.col("n_cross_sections") > 0,
        "rating_curve_segment_class": ladder(k, [(k <= 0, "none"), (k == 1, "single_segment"), (k < 5, "few_segments"), (k < 20, "multiple_segments")], "many_segments"),
    })
    absent = {"measurement_record_class": "none", "measurement_temporal_class": "none", "stage_completeness_class": "not_available", "discharge_completeness_class": "not_available", "rating_curve_record_class": "none", "rating_curve_overlap_class": "none", "cross_section_record_class": "none", "cross_section_vertex_class": "none", "cross_section_geometry_class": "not_available"}
    return s.fillna(absent)


def station_indices(assessed: DataFrame) -> DataFrame:
    """The nineteen indices of every station, one row each: group, name, value, value text, unit, class, direction, description, source, whether it can be calculated, display order."""
    kinds = dict(assessed.dtypes)
    rows = []
    for group, name, column, unit, kind, direction, description, source, available, order in STATION_INDICES:
        if column is None:
            value, text, found = F.lit(None).cast("double"), F.lit("Not available in current Shiny export"), F.lit(kind)
        elif kinds[column] == "boolean":
            value, text, found = F.col(column).cast("double"), F.when(F.col(column), "Yes").otherwise("No"), F.when(F.col(column), "available").otherwise("missing")
        else:
            value, found = F.col(column).cast("double"), F.col(kind)
            text = F.concat(short_number(100 * F.col(column), 1), F.lit("%")) if unit == "%" else short_number(F.col(column), 2) if kinds[column] == "double" else F.col(column).cast("string")
        fixed = {"index_unit": unit, "index_direction": direction, "index_description": description, "source_tables": source}
        rows.append(F.struct(F.lit(group).alias("index_group"), F.lit(name).alias("index_name"), value.alias("index_value"), text.alias("index_value_text"), found.alias("index_class"), *(F.lit(v).cast("string").alias(n) for n, v in fixed.items()), F.lit(available).alias("is_available"), F.lit(order).alias("display_order")))
    return assessed.select("station_code", F.inline(F.array(*rows)))


def assemble(stations: DataFrame, summaries: list[DataFrame], hint: str | None = None) -> DataFrame:
    """Joins summaries to the stations, each with the columns not seen before.

    Each summary has one row a station. All are partitioned by the same key, so the cascade shuffles each table once, and
    none if they are clustered product tables and ``hint`` is ``merge``.
    """
    out = stations
    for s in summaries:
        fresh = [c for c in s.columns if c not in out.columns]
        if fresh:
            some = s.select("station_code", *fresh)
            out = out.join(some.hint(hint) if hint else some, "station_code", "left")
    return out


#: The names that each column of the station dimension may have in an inventory, best first.
DIMENSION = {
    "station_code": ("station_code", "codigoestacao", "Codigo", "CodEstacao", "Codigo_Estacao"), "station_name": ("station_name", "Estacao_Nome", "NomeEstacao", "Nome", "Nome_Estacao"), "station_type": ("station_type", "Tipo_Estacao", "TipoEstacao", "Tipo"),
    "uf": ("uf", "UF_Estacao", "UF", "Estado_Sigla"), "uf_name": ("uf_name", "UF_Nome_Estacao", "Estado_Nome", "NomeEstado"), "municipality_code": ("municipality_code", "Municipio_Codigo", "CodigoMunicipio"), "municipality": ("municipality", "Municipio_Nome", "Municipio", "municipality_uf"),
    "basin_code": ("basin_code", "codigobacia", "Codigo_Bacia", "Bacia_Codigo"), "basin_name": ("basin_name", "Bacia_Nome", "Bacia"), "sub_basin_code": ("sub_basin_code", "SubBacia", "Sub_Bacia_Codigo"),
    "latitude": ("latitude", "Latitude", "lat"), "longitude": ("longitude", "Longitude", "lon", "long"), "altitude": ("altitude", "Altitude"), "drainage_area": ("drainage_area", "Area_Drenagem", "AreaDrenagem"),
    "operator_code": ("operator_code", "Operadora_Codigo", "Codigo_Operadora_Unidade_UF"), "operator": ("operator", "Operadora_Sigla", "Operadora"), "responsible_agency": ("responsible_agency", "Responsavel_Sigla", "Responsavel"), "is_operating": ("is_operating", "Operando"),
    "discharge_start_date": ("discharge_start_date", "Data_Periodo_Desc_liquida_Inicio", "Data_Periodo_Desc_Liquida_Inicio", "PeriodoDescLiquidaInicio"), "discharge_end_date": ("discharge_end_date", "Data_Periodo_Desc_Liquida_Fim", "Data_Periodo_Desc_liquida_Fim", "PeriodoDescLiquidaFim"),
    "telemetric_start_date": ("telemetric_start_date", "Data_Periodo_Telemetrica_Inicio", "PeriodoTelemetricaInicio"), "telemetric_end_date": ("telemetric_end_date", "Data_Periodo_Telemetrica_Fim", "PeriodoTelemetricaFim"),
    "stage_start_date": ("stage_start_date", "Data_Periodo_Escala_Inicio", "PeriodoEscalaInicio"), "stage_end_date": ("stage_end_date", "Data_Periodo_Escala_Fim", "PeriodoEscalaFim"),
    "rainfall_start_date": ("rainfall_start_date", "Data_Periodo_Pluviometro_Inicio", "PeriodoPluviometroInicio"), "rainfall_end_date": ("rainfall_end_date", "Data_Periodo_Pluviometro_Fim", "PeriodoPluviometroFim"), "last_update": ("last_update", "Data_Ultima_Atualizacao"),
}
_NUMBERS, _FLAGS = ("latitude", "longitude", "altitude", "drainage_area"), ("is_operating",)


def squish(c: Column) -> Column:
    """White space trimmed, and single within."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def station_dimension(inventory: DataFrame) -> DataFrame:
    """Stations under fixed names: the first candidate column of each that the inventory has, texts squished, codes padded, flags of what is registered."""

    def column(name: str, names: tuple[str, ...]) -> Column:
        found = pick(inventory, names, "string")
        if name in _NUMBERS:
            return parse_product_number(found)
        if name in _FLAGS:
            return truthy(found)
        return parse_date(found) if name.endswith(("_date", "_update")) else found if name == "station_code" else squish(found)

    rows = inventory.select(*(column(n, names).alias(n) for n, names in DIMENSION.items()))
    rows = rows.withColumns({"station_code": F.lpad(F.trim("station_code"), F.greatest(F.length(F.trim("station_code")), F.lit(8)), "0"), "uf": F.upper("uf")})
    flags = {"has_discharge_measurements": "discharge_start_date", "has_telemetry": "telemetric_start_date", "has_stage_data": "stage_start_date", "has_rainfall_data": "rainfall_start_date"}
    return rows.withColumns({n: F.col(c).isNotNull() for n, c in flags.items()} | {"missing_coordinates": F.col("latitude").isNull() | F.col("longitude").isNull()})


def data_dictionary(tables: dict[str, DataFrame], units: dict[str, str]) -> DataFrame:
    """One row for each table and column: type, unit, position. Metadata only; nothing is read."""
    rows = [(t, c, kind, units.get(c), i) for t, df in sorted(tables.items()) for i, (c, kind) in enumerate(df.dtypes, 1)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, unit string, position int")


def display_labels(df: DataFrame, labels: dict[str, dict[str, str]]) -> DataFrame:
    """Adds ``<column>_label`` by a dictionary for each column; values without a label show as they are."""
    for name, values in labels.items():
        mapping = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
        df = df.withColumn(f"{name}_label", F.coalesce(F.try_element_at(mapping, F.col(name).cast("string")), F.col(name).cast("string")))
    return df


def product_availability(stations: DataFrame, products: dict[str, DataFrame]) -> DataFrame:
    """Every station with a flag for each product that has rows for it."""
    out = stations.select("station_code").distinct()
    for name, df in products.items():
        out = df.select("station_code").distinct().withColumn(f"has_{name}", F.lit(True)).join(out, "station_code", "right")
    return out.fillna(False)
