"""What plots and tables show: axis limits, section metrics, map groups, search labels, acquisition scope."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.functions.columns import TRUE_TOKENS, any_indicator, dms, finite, is_finite, ladder, parse_datetime, yes

#: Map groups by priority.
MAP_GROUPS = ("with_measurements_and_rating_curves", "with_measurements_only", "registration_only")
#: Product layers by priority.
MAP_LAYERS = ("flu_registration", "rainfall_registration", "flu_rainfall_registration", "flu_with_data", "rainfall_with_data", "flu_rainfall_with_data")


def residual_axis_limits(rows: DataFrame, value: str, keys: Sequence[str], low: float = 0.01, high: float = 0.99, min_half: float = 0.20) -> DataFrame:
    """(keys, lower, upper): the P1 and P99 of the residuals, widened to hold zero and at least ± ``min_half`` about the middle.

    Fewer than five values, or equal percentiles, give no row.
    """
    x = finite(value)
    q = rows.groupBy(*keys).agg(F.count(x).alias("n"), F.percentile(x, F.array(F.lit(low), F.lit(high))).alias("q")).where((F.col("n") >= 5) & (F.col("q")[0] != F.col("q")[1]))
    lo, hi = F.least(F.col("q")[0], F.lit(0.0)), F.greatest(F.col("q")[1], F.lit(0.0))
    half = F.greatest((hi - lo) / 2, F.lit(min_half))
    return q.select(*keys, ((lo + hi) / 2 - half).alias("lower"), ((lo + hi) / 2 + half).alias("upper"))


def section_metric(sections: DataFrame) -> DataFrame:
    """The quantity that a section's time plot shows: stage range, else distance span, else its vertices."""
    stage, span = F.col("vertex_stage_max_cm") - F.col("vertex_stage_min_cm"), F.col("vertex_distance_max_m") - F.col("vertex_distance_min_m")
    value = F.coalesce(finite(stage), finite(span), F.col("n_vertices").cast("double"))
    label = F.when(is_finite(stage), "Amplitude vertical (cm)").when(is_finite(span), "Amplitude horizontal (m)").otherwise("Número de vértices")
    return sections.withColumns({"metric_value": value, "metric_label": label}).where(is_finite("metric_value"))


def map_group(measurements: Column, curves: Column) -> Column:
    """The group of a station by whether it has measurements and curves."""
    return F.when(yes(measurements) & yes(curves), MAP_GROUPS[0]).when(yes(measurements), MAP_GROUPS[1]).otherwise(MAP_GROUPS[2])


def group_priority(group: Column) -> Column:
    return ladder(group, [(group == g, i) for i, g in enumerate(MAP_GROUPS, 1)], 9)


def layer_priority(layer: Column) -> Column:
    return ladder(layer, [(layer == g, i) for i, g in enumerate(MAP_LAYERS, 1)], 9)


def map_layer(fluviometric: Column, rain: Column, fluviometric_data: Column, rain_data: Column) -> Column:
    """The layer of a station: what it registers, and what of that it has data for."""
    flu_data, rain_too = yes(fluviometric_data), yes(rain_data)
    data = F.when(flu_data & rain_too, MAP_LAYERS[5]).when(flu_data, MAP_LAYERS[3]).when(rain_too, MAP_LAYERS[4])
    return F.coalesce(data, F.when(yes(fluviometric) & yes(rain), MAP_LAYERS[2]).when(yes(rain), MAP_LAYERS[1]).otherwise(MAP_LAYERS[0]))


def search_label(code: Column, name: Column, state: Column | None = None, municipality: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.concat(code, F.lit(" — "), F.coalesce(name, F.lit("Estação sem nome")), F.coalesce(F.concat(F.lit(" / "), state if state is not None else null), F.lit("")), F.coalesce(F.concat(F.lit(" — "), municipality if municipality is not None else null), F.lit("")))


def visible(stations: DataFrame, layers: Mapping[str, Column], chosen: Sequence[str]) -> DataFrame:
    """Stations of any chosen layer, with the first layer that shows them."""
    first = F.coalesce(*(F.when(yes(layers[n]), F.lit(n)) for n in chosen))
    return stations.where(any_indicator([layers[n] for n in chosen])).withColumn("visible_layer", first)


def acquisition_scope(has_q: Column, has_h: Column, has_curve: Column) -> tuple[Column, Column]:
    """(what was acquired, what it is fit for), by which of discharge, stage and curves there are."""
    q, h, c = yes(has_q), yes(has_h), yes(has_curve)
    data = F.when(q & h & c, "Vazão + cotas + curvas-chave").when(q & h, "Vazão + cotas").when(q & c, "Parcial — sem cotas").when(q, "Parcial — sem cotas e curvas-chave").when(h & c, "Parcial — sem vazões").when(h, "Parcial — sem vazões e curvas-chave").otherwise("Parcial")
    use = F.when(q & h & c, "Apta para análise H-Q com curvas-chave").when(q & h, "Apta para verificações H-Q básicas").when(q & c, "Parcial — sem cotas").when(q, "Parcial — sem cotas e curvas-chave").when(h, "Parcial — sem vazões").otherwise("Dados incompletos")
    return data, use


def number_text(c: Column | str, digits: int = 2, unit: str | None = None, missing: str = "—") -> Column:
    """A number as tables show it: a decimal comma, points for thousands, no zeros at its end."""
    c = F.col(c) if isinstance(c, str) else c
    number = F.regexp_replace(F.format_number(c.try_cast("double"), digits), r"\.?0+$" if digits else r"^$", "")
    shown = F.translate(number, ",.", ".,")
    return F.coalesce(shown if unit is None else F.concat(shown, F.lit(f" {unit}")), F.lit(missing))


def yes_no(c: Column | str) -> Column:
    """Sim, Não, or the sign for missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c, "Sim").when(~c, "Não").otherwise("—")


#: Columns of texts that are dates, and parts of the names of flags.
DATE_FIELDS = (
    "discharge_start_date", "discharge_end_date", "stage_start_date", "stage_end_date", "rainfall_start_date", "rainfall_end_date", "telemetric_start_date", "telemetric_end_date",
    "valid_from", "valid_to", "last_update", "first_last_update", "last_last_update", "first_downloaded_at", "downloaded_at", "measurement_date", "measurement_datetime",
)
FALSE_TOKENS = ("false", "f", "no", "n", "nao", "não", "0")
FLAG_PREFIXES, FLAG_SUFFIX = ("is_", "has_", "flag_"), "_flag"


def short_text(x: Column, digits: int, group: bool = False) -> Column:
    """A number rounded half to even, without zeros at its end; with ``group``, commas for thousands."""
    text = F.format_number(F.bround(x, digits), digits) if group else F.format_string(f"%.{digits}f", F.bround(x, digits))
    return F.regexp_replace(text, r"\.?0+$", "") if digits else text


def _number_value(x: Column, field: str) -> Column:
    if field in ("latitude", "longitude"):
        return dms(x, *(("N", "S") if field == "latitude" else ("E", "W")))
    if field.startswith("frac_"):
        return F.concat(F.format_string("%.1f", F.bround(100 * x, 1)), F.lit("%"))
    size = F.abs(F.bround(x, 2))  # seven significant digits at most
    large = F.when(size >= 1e6, short_text(x, 0, True)).when(size >= 1e5, short_text(x, 1, True)).otherwise(short_text(x, 2, True))
    return F.when(F.abs(x) >= 1000, large).otherwise(short_text(x, 3))


def value_text(field: str, kind: str) -> Column:
    """A column's value as text, by its name and Spark type; a sign for null, NaN and empty text.

    Flags become Sim or Não, times lose their seconds, coordinates are degrees, columns named frac_ percentages, numbers
    have three decimals below a thousand and two, at most seven digits in all, above; texts of date columns become dates.
    """
    c = F.col(f"`{field}`")
    if kind == "boolean":
        text = F.when(c, "Sim").otherwise("Não")
    elif kind.startswith("timestamp"):
        text = F.date_format(c, "yyyy-MM-dd HH:mm")
    elif kind == "date":
        text = F.date_format(c, "yyyy-MM-dd")
    elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        x = c.cast("double")
        text = F.when(F.abs(x) < float("inf"), _number_value(x, field)).when(F.isnan(x), None).otherwise(F.when(x > 0, "Inf").otherwise("-Inf"))
    elif field in DATE_FIELDS:
        text = F.coalesce(F.date_format(parse_datetime(c), "yyyy-MM-dd"), c.cast("string"))
    elif field.startswith(FLAG_PREFIXES) or field.endswith(FLAG_SUFFIX):
        low = F.lower(c.cast("string"))
        text = F.when(low.isin(*TRUE_TOKENS), "Sim").when(low.isin(*FALSE_TOKENS), "Não").otherwise(c.cast("string"))
    else:
        text = F.replace(F.replace(c.cast("string"), F.lit("Fluviometrica"), F.lit("Fluviométrica")), F.lit("Pluviometrica"), F.lit("Pluviométrica")) if field == "station_type" else c.cast("string")
    return F.when(c.isNotNull() & (c.cast("string") != ""), F.coalesce(text, F.lit("—"))).otherwise("—")


def field_label(field: str | None, labels: Mapping[str, str] = {}) -> str:
    """A column's heading: that of the dictionary, else its name with spaces and one capital."""
    if not field:
        return "Campo"
    return labels.get(field) or field.replace("_", " ").capitalize()


def display_table(df: DataFrame, labels: Mapping[str, str] = {}) -> DataFrame:
    """All columns as tables hold them, under their headings.

    Times and dates as texts, flags as Sim, Não or empty, null texts empty, numbers without NaN and infinities, nested
    values as JSON. Headings that repeat get a number, as any name must be found once.
    """
    cells, seen = [], {}
    for field, kind in df.dtypes:
        c = F.col(f"`{field}`")
        if kind == "boolean":
            cell = F.when(c, "Sim").when(~c, "Não").otherwise("")
        elif kind.startswith("timestamp"):
            cell = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            cell = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("float", "double"):
            cell = finite(c)
        elif kind.startswith(("struct", "array", "map")):
            cell = F.coalesce(F.to_json(c), F.lit(""))
        else:
            cell = F.coalesce(c, F.lit("")) if kind == "string" else c
        name = field_label(field, labels)
        again = seen.get(name.lower(), 0)
        seen[name.lower()] = again + 1
        cells.append(cell.alias(f"{name} {again}" if again else name))
    return df.select(*cells)


def ranked_by(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """The rows with ``display_order``: the place of a column's value in a given list, those not in it behind."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(name))
    return df.withColumn("display_order", F.when(yes(place > 0), place).otherwise(F.lit(len(order) + 1)).cast("long"))


def preview(df: DataFrame, keys: Sequence[str], row_id: str, most: int, seed: int = 1) -> DataFrame:
    """At most ``most`` rows of each key for a plot, the same ones at each run: those of smallest MD5 of seed and row id."""
    order = Window.partitionBy(*keys).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")).cast("binary")), row_id)
    return df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def seeded_sample(df: DataFrame, row_id: str, most: int = 8000, seed: int = 67) -> DataFrame:
    """At most ``most`` rows of a whole table for a map, the same ones however it is partitioned: those of smallest hash.

    The hash is the first 60 bits of the MD5 of seed and row id, then the id. Rows over a bound that leaves somewhat more
    than ``most`` of them are dropped where they lie, so that no table is sorted and no task gets more than those; should
    the bound leave too few, all take part. Null ids come last.
    """
    total = df.count()
    if total <= most:
        return df
    part = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    marked = df.withColumn("__h", part)
    some = marked.where(F.col("__h") < int((1 << 60) * min(1.0, (most + 6 * most**0.5 + 10) / total)))
    chosen = some if some.count() >= most else marked
    return chosen.orderBy(F.asc_nulls_last("__h"), row_id).limit(most).drop("__h")


def map_group_label(group: Column) -> Column:
    return ladder(group, [(group == MAP_GROUPS[0], "Medições + curvas-chave"), (group == MAP_GROUPS[1], "Somente medições")], "Somente cadastro")
