"""Rating curves: matching of days and measurements, issue reports, residual envelopes, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.functions.columns import finite, is_finite, safe_divide, yes
from fluvia.session import spread

ENVELOPE_SD = 1.96
ENVELOPE_POINTS = 5
OPEN_END = "9999-12-31"


def predicted(stage_cm: Column, a: Column, h0: Column, n: Column) -> Column:
    """Q = a (H / 100 - h0) ^ n; null where the effective stage is not positive or a number is missing."""
    effective = stage_cm / 100 - h0
    return finite(F.when((effective > 0) & is_finite(effective) & is_finite(a) & is_finite(n), a * F.pow(effective, n)))


def with_years(days: DataFrame, date: str, curves: DataFrame, lo: str, hi: str) -> DataFrame:
    """The curves once for each year of their station's days on part of which they are valid, as c_station and c_year.

    A null bound is open. Days then meet curves by station and year: a range join with a key that is a year of one
    station, not a station, so that a station with many curves or days spreads over many tasks.
    """
    years = days.select(F.col("station_code").alias("c_station"), F.year(date).alias("c_year")).where("c_year is not null").distinct()
    y0, y1 = F.year(lo), F.year(hi)
    meets = (F.col("c_station") == F.col("station_code")) & (y0.isNull() | (F.col("c_year") >= y0)) & (y1.isNull() | (F.col("c_year") <= y1))
    return years.join(curves, meets).drop("station_code")


def epochs(curves: DataFrame, lo: str, hi: str, fields: list[str], order: list[Column | str]) -> DataFrame:
    """A station's time cut at the bounds of its segments: stretches from e_start to before e_end, on which the same ones are valid.

    A null bound is open. A stretch has ``segments``, structs of ``place`` (in the given order of the station's segments, 1
    first), ``numbers`` (of curve and segment id, both in one long) and the fields, in that order. A day meets one stretch
    and not every segment, so no row is made for a pair: a station's segments are one array. ``e_station`` is the key.
    """
    own = Window.partitionBy("station_code")
    numbers = F.shiftleft(F.dense_rank().over(own.orderBy("rating_curve_id")).cast("long"), 32) + F.dense_rank().over(own.orderBy("rating_curve_segment_id"))
    row = F.struct("place", "numbers", F.col(lo).alias("lo"), F.col(hi).alias("hi"), *fields)
    stations = curves.withColumns({"place": F.row_number().over(own.orderBy(*order)), "numbers": numbers}).groupBy("station_code").agg(F.sort_array(F.collect_list(row)).alias("segments"))
    starts = F.concat(F.array(F.lit(None).cast("date")), F.transform("segments", lambda s: s["lo"]), F.transform("segments", lambda s: F.date_add(s["hi"], 1)))
    stations = stations.withColumn("starts", F.sort_array(F.array_distinct(starts)))  # null, the beginning of time, comes first
    rows = stations.select("station_code", "segments", "starts", F.posexplode("starts").alias("at", "e_start"))
    start = F.col("e_start")
    valid = F.filter("segments", lambda s: (s["lo"].isNull() | (s["lo"] <= start)) & (s["hi"].isNull() | start.isNull() | (s["hi"] >= start)))
    first, last = F.array_min(F.transform("segments", lambda s: s["lo"])), F.when(~F.exists("segments", lambda s: s["hi"].isNull()), F.array_max(F.transform("segments", lambda s: s["hi"])))
    return rows.select(F.col("station_code").alias("e_station"), "e_start", F.get("starts", F.col("at") + 1).alias("e_end"), first.alias("e_first"), last.alias("e_last"), valid.alias("segments"))


def in_epoch(date: str, until: str | None = None) -> Column:
    """Whether a row's station and date (or one of its days, where it has those to ``until``) are those of a stretch of ``epochs``."""
    return (F.col("station_code") == F.col("e_station")) & (F.col("e_start").isNull() | (F.col(until or date) >= F.col("e_start"))) & (F.col("e_end").isNull() | (F.col(date) < F.col("e_end")))


def distinct_parts(found: Column) -> dict[str, Column]:
    """How many segments and how many curves there are among structs that have ``numbers``."""
    parts = {"curve_segments": lambda x: x["numbers"].bitwiseAND(F.lit((1 << 32) - 1)), "rating_curves": lambda x: F.shiftright(x["numbers"], 32)}
    return {what: F.size(F.array_distinct(F.transform(found, part))).cast("long") for what, part in parts.items()}


def match_daily(daily: DataFrame, curves: DataFrame, parts: int | None = None, until: str | None = None) -> DataFrame:
    """Matches each day to the curve segments of its station by validity and stage range.

    ``daily`` has station_code, date, discharge_m3s, stage_cm, one row a day. A day meets the stretch of time that it lies in
    (see ``epochs``) and filters the segments valid then by its stage; the first one left is the best (latest valid_from,
    then curve id and segment number). No pair is sorted. A station without curves has no before and after flags.

    Where the days are dealt by station over ``parts``, so are the curves, and the days move no more. Else Spark deals them
    over its own number of partitions and puts those together to some 64 MB of compressed days, which a task then sorts.

    With ``until``, a column, a row stands for the days from its date to that one: its discharge and stage are the first day's
    and the others have none. Such rows meet their stretches before they become days, so that what is sorted for the join are
    the rows, in the order that they have from ``with_until``, and no day is sorted.
    """
    fields = ["rating_curve_id", "rating_curve_segment_id", "valid_from", "valid_to", "stage_min_cm", "stage_max_cm", "coefficient_a", "coefficient_h0", "coefficient_n"]
    curves = curves.select("station_code", "segment_number", *(F.col(c).cast("date") if c.startswith("valid") else F.col(c) for c in fields))
    curves = curves if parts is None else curves.repartition(parts, "station_code")
    order = [F.col("valid_from").isNull(), F.desc("valid_from"), "rating_curve_id", "segment_number", "rating_curve_segment_id", "valid_to", "stage_min_cm", "stage_max_cm", "coefficient_a", "coefficient_h0", "coefficient_n"]
    stretches = epochs(curves.withColumns({"__lo": F.col("valid_from"), "__hi": F.col("valid_to")}), "__lo", "__hi", fields, order)
    counts = {f"n_valid_date_{what}": n for what, n in distinct_parts(F.col("segments")).items()}
    least, most = F.array_min(F.transform("segments", lambda s: finite(s["stage_min_cm"]))), F.array_max(F.transform("segments", lambda s: finite(s["stage_max_cm"])))
    ranged = F.filter("segments", lambda s: is_finite(s["stage_min_cm"]) & is_finite(s["stage_max_cm"]))
    stretches = stretches.select("e_station", "e_start", "e_end", F.col("e_first").alias("first_start"), F.col("e_last").alias("last_end"), ranged.alias("segments"), *(n.alias(name) for name, n in counts.items()), least.alias("min_valid_stage_cm"), most.alias("max_valid_stage_cm"))
    out = daily.join(stretches.hint("merge"), in_epoch("date", until), "left")
    h = F.col("stage_cm")
    usable = lambda h: F.filter("segments", lambda s: (h >= s["stage_min_cm"]) & (h <= s["stage_max_cm"]))
    # a generator, behind which no filter on what is chosen becomes part of the join's condition
    if until is None:
        found = F.array(F.struct(F.col("date").alias("__day"), usable(h).alias("usable")))
    else:
        days = F.sequence(F.greatest("date", "e_start"), F.least(until, F.date_sub("e_end", 1)))
        found = F.transform(days, lambda day: F.struct(day.alias("__day"), usable(F.when(day == F.col("date"), h)).alias("usable")))
    out = out.select(*(c for c in out.columns if c not in ("segments", "e_station", "e_start", "e_end", until)), F.inline(found))
    values = {c: F.when(F.col("__day").eqNullSafe(F.col("date")), F.col(c)) for c in ("discharge_m3s", "stage_cm")}
    out = out.withColumns(values | {"date": F.col("__day")}).drop("__day").withColumns({"has_discharge": F.col("discharge_m3s").isNotNull(), "has_stage": F.col("stage_cm").isNotNull()})
    counts = [*counts, *(f"n_applicable_{what}" for what in distinct_parts(F.col("usable")))]
    out = out.withColumns({f"n_applicable_{what}": n for what, n in distinct_parts(F.col("usable")).items()} | {"chosen": F.get("usable", F.lit(0))})
    names = {"rating_curve_id": "rating_curve_id", "rating_curve_segment_id": "rating_curve_segment_id", "valid_from": "selected_curve_valid_from", "valid_to": "selected_curve_valid_to", "stage_min_cm": "selected_stage_min_cm", "stage_max_cm": "selected_stage_max_cm"}
    q = predicted(h, F.col("chosen.coefficient_a"), F.col("chosen.coefficient_h0"), F.col("chosen.coefficient_n"))
    out = out.withColumns({name: F.col(f"chosen.{c}") for c, name in names.items()} | {"q_generated_m3s": q}).drop("usable", "chosen").fillna(0, counts)
    g, q_obs, stage = F.col("q_generated_m3s"), F.col("discharge_m3s"), F.col("stage_cm")
    has_q, has_h, n_app = F.col("has_discharge"), F.col("has_stage"), F.col("n_applicable_curve_segments")
    covered = F.col("n_valid_date_curve_segments") > 0
    below, above = yes(has_h & covered & (stage < F.col("min_valid_stage_cm"))), yes(has_h & covered & (stage > F.col("max_valid_stage_cm")))
    evaluable = yes(is_finite(q_obs) & (q_obs > 0) & (g > 0))
    error = F.when(evaluable, (g - q_obs) / q_obs)
    out = out.withColumns({
        "q_generation_error": (n_app > 0) & (g.isNull() | (g <= 0)), "has_valid_date_curve": covered, "stage_below_curve_range": below, "stage_above_curve_range": above, "stage_outside_curve_range": below | above | (has_h & covered & (n_app == 0)),
        "discharge_without_stage": has_q & ~has_h, "discharge_without_curve": has_q & ~covered, "discharge_before_first_curve": yes(has_q & (F.col("date") < F.col("first_start"))), "discharge_after_last_curve": yes(has_q & (F.col("date") > F.col("last_end"))),
        "complete_hq_curve_day": has_q & has_h & (n_app > 0), "ambiguous_curve_day": has_h & (n_app > 1), "q_difference_evaluable": evaluable, "relative_error": error, "abs_relative_error": F.abs(error),
        "q_diff_gt_5": yes(F.abs(error) > 0.05), "q_diff_gt_10": yes(F.abs(error) > 0.10), "q_diff_gt_25": yes(F.abs(error) > 0.25), "discharge_nonpositive": yes(has_q & (q_obs <= 0)), "stage_nonpositive": yes(has_h & (stage <= 0)),
    })
    return out.drop("first_start", "last_end")


#: Condition over a matched day, group, code and label of each issue.
ISSUES = (
    ("has_discharge and not has_stage", "Cobertura dos dados diários", "vazao_sem_cota", "Vazão sem cota"),
    ("has_stage and not has_discharge", "Cobertura dos dados diários", "cota_sem_vazao", "Cota sem vazão"),
    ("not has_discharge", "Cobertura dos dados diários", "falha_vazao", "Falha em vazão"),
    ("not has_stage", "Cobertura dos dados diários", "falha_cota", "Falha em cota"),
    ("not has_discharge and not has_stage", "Cobertura dos dados diários", "falha_simultanea_cota_vazao", "Falha simultânea de cota e vazão"),
    ("discharge_without_curve", "Cobertura por curvas-chave", "vazao_sem_curva_valida", "Vazão sem curva-chave válida"),
    ("discharge_before_first_curve", "Cobertura por curvas-chave", "vazao_antes_primeira_curva", "Vazão antes da primeira curva-chave"),
    ("discharge_after_last_curve", "Cobertura por curvas-chave", "vazao_apos_ultima_curva", "Vazão após a última curva-chave"),
    ("stage_below_curve_range", "Consistência cota–vazão–curva-chave", "cota_abaixo_faixa_curva", "Cota abaixo da faixa da curva"),
    ("stage_above_curve_range", "Consistência cota–vazão–curva-chave", "cota_acima_faixa_curva", "Cota acima da faixa da curva"),
    ("ambiguous_curve_day", "Cobertura por curvas-chave", "curvas_ambiguas", "Mais de uma curva aplicável"),
    ("q_generation_error", "Consistência cota–vazão–curva-chave", "erro_geracao_q", "Erro na geração da vazão"),
    ("q_diff_gt_5", "Consistência cota–vazão–curva-chave", "diferenca_q_gt_5", "Diferença entre Q gerada e Q disponibilizada maior que 5%"),
    ("q_diff_gt_10", "Consistência cota–vazão–curva-chave", "diferenca_q_gt_10", "Diferença entre Q gerada e Q disponibilizada maior que 10%"),
    ("q_diff_gt_25", "Consistência cota–vazão–curva-chave", "diferenca_q_gt_25", "Diferença entre Q gerada e Q disponibilizada maior que 25%"),
    ("discharge_nonpositive", "Consistência dos valores diários", "vazao_menor_igual_zero", "Vazão menor ou igual a zero"),
    ("stage_nonpositive", "Consistência dos valores diários", "cota_menor_igual_zero", "Cota menor ou igual a zero"),
)


def issue_report(matched: DataFrame) -> DataFrame:
    """One row for each day and issue: one pass that explodes the issues that hold."""
    found = F.array(*(F.when(F.expr(rule), F.struct(F.lit(group).alias("issue_group"), F.lit(code).alias("code"), F.lit(label).alias("label"))) for rule, group, code, label in ISSUES))
    return matched.select("station_code", "date", "discharge_m3s", "stage_cm", "rating_curve_segment_id", "q_generated_m3s", "relative_error", F.inline(F.filter(found, lambda x: x.isNotNull())))


def with_gaps(rows: DataFrame, until: str = "until") -> DataFrame:
    """Adds ``gap_days``, how many days up to ``until`` in a row have no discharge, to the rows of ``with_until``: in the order that those have."""
    so_far = Window.partitionBy("station_code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max(F.when(F.col("discharge_m3s").isNotNull(), F.col("date"))).over(so_far)
    return rows.withColumn("gap_days", F.date_diff(until, F.coalesce(seen, F.date_sub(F.min("date").over(so_far), 1))).cast("long"))


def coverage(matched: DataFrame) -> DataFrame:
    """Counts and percentages of days by station, and the longest gap in discharge; the days are read once.

    Days with ``gap_days`` (see ``with_gaps``) need no order; others are sorted to find the gap.
    """
    n = F.count("*")
    names = ("has_discharge", "has_stage", "has_valid_date_curve", "complete_hq_curve_day", "ambiguous_curve_day", "stage_outside_curve_range", "q_generation_error", "q_difference_evaluable", "q_diff_gt_5", "q_diff_gt_10", "q_diff_gt_25")
    if "gap_days" in matched.columns:
        days = matched.select("station_code", *names, F.col("gap_days").alias("__gap"))
    else:
        days = with_runs(matched.select("station_code", "date", *names), ~F.col("has_discharge"), ["station_code"], "__gap")
    rows = days.groupBy("station_code").agg(n.alias("n_days"), *(F.count_if(c).alias(f"n_{c}") for c in names), F.coalesce(F.max("__gap"), F.lit(0)).alias("longest_gap_days"))
    return rows.select("station_code", "n_days", *(f"n_{c}" for c in names), *((100 * F.col(f"n_{c}") / F.col("n_days")).alias(f"pct_{c}") for c in names[:4]), "longest_gap_days")


def with_runs(days: DataFrame, flag: Column, keys: list[str], name: str) -> DataFrame:
    """Adds how many consecutive rows (by date, within the keys) up to each have the flag; null where it has not. One sort."""
    order = Window.partitionBy(*keys).orderBy("date")
    rows = days.withColumns({"__f": yes(flag), "__n": F.row_number().over(order)})
    before = F.max(F.when(~F.col("__f"), F.col("__n"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.when(F.col("__f"), (F.col("__n") - F.coalesce(before, F.lit(0))).cast("long"))).drop("__f", "__n")


def longest_run(days: DataFrame, flag: Column, keys: list[str]) -> DataFrame:
    """The longest run of consecutive rows (by date) with the flag, by key; keys without one are left out."""
    rows = with_runs(days.select(*keys, "date", yes(flag).alias("__flag")), F.col("__flag"), keys, "n")
    return rows.where("n is not null").groupBy(*keys).agg(F.max("n").alias("longest"))


def segment_errors(matched: DataFrame, curves: DataFrame) -> DataFrame:
    """By curve segment: days matched, generated, wrong, compared, errors over 5, 10 and 25 %, median and P95."""
    stats = matched.where("rating_curve_segment_id is not null").groupBy("station_code", "rating_curve_id", "rating_curve_segment_id").agg(
        F.count("*").alias("n_match_days"), F.count("q_generated_m3s").alias("n_generated"), F.count_if("q_generation_error").alias("n_errors"), F.count_if("q_difference_evaluable").alias("n_compared"),
        *(F.count_if(f"q_diff_gt_{k}").alias(f"n_gt_{k}") for k in (5, 10, 25)), F.percentile("abs_relative_error", 0.5).alias("median_abs_error"), F.percentile("abs_relative_error", 0.95).alias("p95_abs_error"),
    )
    return stats.join(curve_labels(curves).drop("equation"), ["station_code", "rating_curve_id", "rating_curve_segment_id"])


def short_coefficient(c: Column | str, digits: int = 3) -> Column:
    """A coefficient to ``digits`` decimals without zeros at its end; NA for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.regexp_replace(F.format_string(f"%.{digits}f", c), r"\.?0+$", ""), F.lit("NA"))


def curve_labels(curves: DataFrame) -> DataFrame:
    """Each segment's number of curve (by first validity) and of segment (by stage), label and equation text."""
    by_curve = Window.partitionBy("station_code").orderBy(F.asc_nulls_last("curve_from"), "rating_curve_id")
    numbers = curves.groupBy("station_code", "rating_curve_id").agg(F.min(F.col("valid_from").cast("date")).alias("curve_from")).withColumn("curve_number", F.row_number().over(by_curve)).drop("curve_from")
    by_segment = Window.partitionBy("station_code", "rating_curve_id").orderBy(F.asc_nulls_last("stage_min_cm"), "rating_curve_segment_id")
    rows = curves.withColumn("segment_order", F.row_number().over(by_segment)).join(numbers, ["station_code", "rating_curve_id"])
    sign = F.when(F.col("coefficient_h0") < 0, "+").otherwise("-")
    equation = F.concat(F.lit("Q="), short_coefficient("coefficient_a"), F.lit("(H"), sign, short_coefficient(F.abs("coefficient_h0")), F.lit(")^"), short_coefficient("coefficient_n"))
    label = F.concat(F.lit("CC "), F.col("curve_number").cast("string"), F.lit(" - T"), F.col("segment_order").cast("string"))
    return rows.select("station_code", "rating_curve_id", "rating_curve_segment_id", "curve_number", "segment_order", label.alias("segment_label"), F.when(F.col("coefficient_a").isNotNull(), equation).alias("equation"))


def valid_on(events: DataFrame, date: str, curves: DataFrame) -> DataFrame:
    """The events with each curve segment of their station that is valid on their date: its start is known, its end may be open."""
    fields = ("rating_curve_id", "rating_curve_segment_id", "valid_from", "valid_to")
    some = with_years(events, date, curves.where("valid_from is not null").select("station_code", *fields), "valid_from", "valid_to")
    inside = (F.col(date) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(date) <= F.col("valid_to")))
    return events.join(some, (F.col("station_code") == F.col("c_station")) & (F.year(date) == F.col("c_year")) & inside).drop("c_station", "c_year")


_PAIR = ["rating_curve_id", "rating_curve_segment_id", "segment_number", "stage_min_cm", "stage_max_cm"]


def _measured(measurements: DataFrame, curves: DataFrame, as_of: str) -> tuple[DataFrame, Column]:
    """The measurements with the segments valid on their date, and those of them valid on their stage that have a finite log residual.

    The latter are structs of ``a``, the absolute residual, ``s``, the segment's id, and ``segment``.
    """
    m = measurements.where("stage_cm is not null and stage_cm > 0 and discharge_m3s is not null and discharge_m3s > 0 and measurement_date is not null")
    coefficients = ["coefficient_a", "coefficient_h0", "coefficient_n"]
    c = curves.where("valid_from is not null").select("station_code", *_PAIR, *coefficients, F.col("valid_from").cast("date").alias("__lo"), F.coalesce(F.col("valid_to").cast("date"), F.lit(as_of).cast("date")).alias("__hi"))
    stretches = epochs(c, "__lo", "__hi", [*_PAIR, *coefficients], ["rating_curve_segment_id", "rating_curve_id", "segment_number", "stage_min_cm", "stage_max_cm", *coefficients]).select("e_station", "e_start", "e_end", "segments")
    h, log_q = F.col("stage_cm"), F.ln("discharge_m3s")
    usable = F.filter("segments", lambda s: (h >= s["stage_min_cm"]) & (h <= s["stage_max_cm"]))
    # the logarithm of a discharge of zero or less is null, so a finite residual has a positive one
    judged = F.transform(usable, lambda s: F.struct(F.abs(log_q - F.ln(predicted(h, s["coefficient_a"], s["coefficient_h0"], s["coefficient_n"]))).alias("a"), s["rating_curve_segment_id"].alias("s"), s.alias("segment")))
    return m.join(stretches.hint("merge"), in_epoch("measurement_date")), F.filter(judged, lambda j: is_finite(j["a"]))


def _with_residuals(pairs: DataFrame, measured: list[str]) -> DataFrame:
    q = predicted(F.col("stage_cm"), F.col("segment.coefficient_a"), F.col("segment.coefficient_h0"), F.col("segment.coefficient_n"))
    rows = pairs.select(*measured, *(F.col(f"segment.{c}").alias(c) for c in _PAIR), q.alias("rating_predicted_discharge_m3s"))
    rows = rows.withColumn("rating_log_residual", F.ln("discharge_m3s") - F.ln("rating_predicted_discharge_m3s"))
    return rows.withColumn("rating_relative_residual_pct", 100 * (F.exp("rating_log_residual") - 1))


def match_measurements(measurements: DataFrame, curves: DataFrame, as_of: str) -> DataFrame:
    """All pairs of a measurement and a segment valid on its date and stage, with log residuals.

    Segments without valid_from are left out and open ends run to ``as_of``.
    """
    rows, pairs = _measured(measurements, curves, as_of)
    return _with_residuals(rows.select(*measurements.columns, F.inline(pairs)), measurements.columns)


def nearest_matches(measurements: DataFrame, curves: DataFrame, as_of: str, key: str = "measurement_id") -> DataFrame:
    """The best of ``match_measurements``, as ``best_matches`` chooses it, but within each row: no pair becomes a row.

    Only rows of one measurement id, if there are several, are compared afterwards.
    """
    rows, pairs = _measured(measurements, curves, as_of)
    # a generator, behind which no filter on the nearest one becomes part of the join's condition
    nearest = rows.select(*measurements.columns, F.inline(F.filter(F.array(F.array_min(pairs)), lambda j: j.isNotNull())))
    return best_matches(_with_residuals(nearest, measurements.columns), key)


def best_matches(matches: DataFrame, key: str = "measurement_id") -> DataFrame:
    """Of each measurement's pairs, that with the least absolute residual, then the least segment id."""
    names = [c for c in matches.columns if c not in ("station_code", key)]
    row = F.struct(F.abs("rating_log_residual").alias("__a"), F.col("rating_curve_segment_id").alias("__s"), *names)
    return matches.groupBy("station_code", key).agg(F.min(row).alias("r")).select("station_code", key, *(F.col(f"r.{c}").alias(c) for c in names))


def residual_envelopes(best: DataFrame) -> DataFrame:
    """Mean, median and spread of log residuals by segment, and mean ± 1.96 standard deviations where enough points are."""
    r = F.col("rating_log_residual")
    rows = best.groupBy("station_code", "rating_curve_id", "rating_curve_segment_id").agg(F.count("*").alias("n_residual_points"), F.avg(r).alias("mean_log_residual"), F.percentile(r, 0.5).alias("median_log_residual"), F.when(F.count("*") >= 2, F.stddev_samp(r)).alias("sd_log_residual"), F.percentile(F.abs(r), 0.5).alias("median_abs_log_residual"))
    half = ENVELOPE_SD * F.col("sd_log_residual")
    return rows.withColumns({"envelope_lower": F.col("mean_log_residual") - half, "envelope_upper": F.col("mean_log_residual") + half, "has_residual_envelope": (F.col("n_residual_points") >= ENVELOPE_POINTS) & F.col("sd_log_residual").isNotNull()})


def envelope_flags(best: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Marks residuals outside the envelope of their segment, which is joined by its id alone."""
    some = envelopes.select("rating_curve_segment_id", "envelope_lower", "envelope_upper", "has_residual_envelope")
    r = F.col("rating_log_residual")
    return best.join(some, "rating_curve_segment_id", "left").withColumn("outside_residual_envelope", yes(F.col("has_residual_envelope") & ((r < F.col("envelope_lower")) | (r > F.col("envelope_upper")))))


def _points(segments: DataFrame, points: int, *others: str) -> DataFrame:
    step = (F.col("stage_max_cm") - F.col("stage_min_cm")) / (points - 1)
    rows = segments.where(is_finite("stage_min_cm") & is_finite("stage_max_cm")).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    rows = rows.withColumn("stage_cm", F.col("stage_min_cm") + F.col("point") * step)
    q = predicted(F.col("stage_cm"), F.col("coefficient_a"), F.col("coefficient_h0"), F.col("coefficient_n"))
    return rows.select("station_code", "rating_curve_id", "rating_curve_segment_id", "point", "stage_cm", q.alias("discharge_m3s"), *others).where("discharge_m3s is not null")


def curve_points(curves: DataFrame, points: int = 80) -> DataFrame:
    """Evenly spaced points of each segment's curve."""
    return _points(spread(curves.select("station_code", "rating_curve_id", "rating_curve_segment_id", "stage_min_cm", "stage_max_cm", "coefficient_a", "coefficient_h0", "coefficient_n"), "station_code", "rating_curve_segment_id"), points)


def envelope_ribbons(curves: DataFrame, envelopes: DataFrame, points: int = 80) -> DataFrame:
    """Curve points between the envelope's bounds, only where a segment has one.

    Segments meet their envelopes before they become points: Catalyst takes points for as few bytes as their segments and
    would broadcast them.
    """
    some = envelopes.where("has_residual_envelope").select("rating_curve_segment_id", "envelope_lower", "envelope_upper")
    rows = _points(curves.join(some.hint("merge"), "rating_curve_segment_id"), points, "envelope_lower", "envelope_upper")
    return rows.withColumns({"discharge_lower": F.col("discharge_m3s") * F.exp("envelope_lower"), "discharge_upper": F.col("discharge_m3s") * F.exp("envelope_upper")})


def overlap_pairs(curves: DataFrame) -> DataFrame:
    """Pairs of different validity periods of a station that overlap, counted; open ends never end, reversed periods are out.

    A sweep over a station's sorted bounds counts them: each period meets those that begin before it ends, less those
    that ended before it begins. No pair is made.
    """
    periods = curves.where("valid_from is not null").select("station_code", "rating_curve_id", F.col("valid_from").cast("date").alias("lo"), F.coalesce(F.col("valid_to").cast("date"), F.lit(OPEN_END).cast("date")).alias("hi")).where("hi >= lo").distinct()
    starts = periods.select("station_code", F.col("lo").alias("d"), F.lit(0).alias("kind"))
    ends = periods.select("station_code", F.col("hi").alias("d"), F.lit(1).alias("kind"))
    # at each start, the periods that are open meet the new one; starts of one day follow each other
    marks = starts.union(ends)
    so_far = Window.partitionBy("station_code").orderBy("d", "kind").rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum(F.when(F.col("kind") == 0, 1).otherwise(-1)).over(so_far), F.lit(0))
    counted = marks.withColumn("meets", F.when(F.col("kind") == 0, running).otherwise(0)).groupBy("station_code").agg(F.sum("meets").alias("n_overlapping_pairs"))
    return curves.select("station_code").distinct().join(counted, "station_code", "left").fillna(0, ["n_overlapping_pairs"])


def hydraulic_geometry(measurements: DataFrame) -> DataFrame:
    """Wetted perimeter w + 2d, hydraulic radius A / P and A R^(2/3)."""
    p = F.col("width_m") + 2 * F.col("mean_depth_m")
    r = safe_divide("wetted_area_m2", p)
    return measurements.withColumns({"wetted_perimeter_m": p, "hydraulic_radius_m": r, "section_factor": F.col("wetted_area_m2") * F.pow(r, 2 / 3)})
