"""Column expressions: finite values, tolerant parsing, dates, classifiers, flag labels."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for nothing and for true, formats of dates, classes and month names.
NULL_TOKENS = ("", "na", "nan", "null", "none", "n/a")
TRUE_TOKENS = ("true", "t", "yes", "y", "sim", "s", "1")
DATE_FORMATS = ("dd/MM/yyyy", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
DATETIME_FORMATS = ("yyyy-MM-dd HH:mm:ss[.S]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy")
FAILURE_CLASSES = ("100%", "75–<100%", "50–<75%", "25–<50%", "0–<25%", "0%")
MONTHS_PT = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """True for a number that is neither null, NaN (which is above infinity in comparisons) nor infinite; never null."""
    return F.coalesce(F.abs(col(c)) < F.lit(float("inf")), F.lit(False))


def finite(c: Column | str) -> Column:
    """The value where finite, else null."""
    return F.when(F.abs(col(c)) < F.lit(float("inf")), col(c))


def yes(c: Column) -> Column:
    """A flag with null as false."""
    return F.coalesce(c, F.lit(False))


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(col(a).cast("double"), F.nullif(col(b).cast("double"), F.lit(0.0)))


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _token(c: Column | str) -> Column:
    text = F.trim(col(c).cast("string"))
    return F.when(~F.lower(text).isin(*NULL_TOKENS), text)


def parse_series_number(c: Column | str) -> Column:
    """A number of a raw series: decimal comma or point."""
    return _number(F.replace(_token(c), F.lit(","), F.lit(".")))


def parse_product_number(c: Column | str) -> Column:
    """A number of a product file: with both marks the point groups thousands; a lone comma is decimal."""
    text = _token(c)
    grouped = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return _number(F.when(text.contains(","), grouped).otherwise(text))


def parse_threshold(c: Column | str) -> Column:
    """A number as typed with a Brazilian locale: points group thousands, the comma is decimal."""
    return _number(F.replace(F.replace(_token(c), F.lit("."), F.lit("")), F.lit(","), F.lit(".")))


def _first_time(text: Column, formats: Sequence[str]) -> Column:
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def parse_date(c: Column | str) -> Column:
    """A date by the first format that fits each value."""
    return _first_time(_token(c), DATE_FORMATS).cast("date")


def parse_dates_alike(df: DataFrame, name: str, ordinal: str) -> DataFrame:
    """The column as dates, all by one format: the first that fits the first value present, by the ordinal.

    What that format does not fit is null, as are all values if no format fits the first. One row reaches the driver.
    (``parse_date`` chooses for each value instead.)
    """
    text = _token(name)
    first = F.min_by(text, ordinal)
    fitting = F.coalesce(*(F.when(F.try_to_timestamp(first, F.lit(f)).isNotNull(), f) for f in DATE_FORMATS))
    found = df.where(text.isNotNull()).agg(fitting.alias("f")).first()["f"]
    return df.withColumn(name, F.lit(None).cast("date") if found is None else F.try_to_timestamp(text, F.lit(found)).cast("date"))


def parse_datetime(c: Column | str) -> Column:
    """A UTC time, year first or day first, truncated or not."""
    text = F.regexp_replace(F.regexp_replace(_token(c), "T", " "), "Z$", "")
    return _first_time(text, DATETIME_FORMATS)


def station_code(c: Column | str) -> Column:
    """Digits padded to 8, a trailing .0 removed; other codes as they are."""
    text = F.regexp_replace(F.trim(col(c).cast("string")), r"\.0+$", "")
    return F.when(text.rlike(r"^\d{1,8}$"), F.lpad(text, 8, "0")).otherwise(text)


def same_station(a: Column, b: Column) -> Column:
    """Codes are compared without leading zeros."""
    return F.regexp_replace(a, "^0+", "") == F.regexp_replace(b, "^0+", "")


def truthy(c: Column | str) -> Column:
    """A flag of any kind: numbers over 0 and the texts of TRUE_TOKENS are true; null and all else are false."""
    text = F.lower(F.trim(col(c).cast("string")))
    return yes(text.isin(*TRUE_TOKENS) | (text.try_cast("double") > 0))


def any_indicator(flags: Sequence[Column]) -> Column:
    """Or over flags, nulls as false."""
    return reduce(lambda a, b: a | b, (yes(f) for f in flags), F.lit(False))


def pick(df: DataFrame, names: Sequence[str], kind: str, ignore_case: bool = False, required: bool = False) -> Column:
    """The first of the named columns that df has, else a typed null."""
    have = {c.lower(): c for c in df.columns} if ignore_case else {c: c for c in df.columns}
    for name in names:
        found = have.get(name.lower() if ignore_case else name)
        if found:
            return F.col(f"`{found}`").cast(kind)
    if required:
        raise ValueError(f"none of the columns {list(names)} is there: {df.columns}")
    return F.lit(None).cast(kind)


def hydrological_year(date: Column | str) -> Column:
    """October to September, named by its last year."""
    date = col(date)
    return F.year(date) + F.when(F.month(date) >= 10, 1).otherwise(0)


def make_id(*parts: Column | str) -> Column:
    """Parts joined by two underscores, other characters than letters and digits as one."""
    return F.concat_ws("__", *(F.regexp_replace(F.coalesce(col(p).cast("string"), F.lit("NA")), "[^A-Za-z0-9]+", "_") for p in parts))


def labels(pairs: Sequence[tuple[Column, str]], empty: str, separator: str = "; ") -> Column:
    """The labels whose flags hold, in the given order."""
    found = F.concat_ws(separator, *(F.when(yes(flag), F.lit(label)) for flag, label in pairs))
    return F.when(found == "", F.lit(empty)).otherwise(found)


def count_flags(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, (yes(f).cast("int") for f in flags), F.lit(0))


def ladder(value: Column, steps: Sequence[tuple[Column, object]], otherwise: object) -> Column:
    """The first step whose condition holds; a null condition does not."""
    out = F
    for condition, result in steps:
        out = out.when(condition, F.lit(result))
    return out.otherwise(F.lit(otherwise))


def failure_class(pct: Column) -> Column:
    return ladder(pct, [(pct == 100, FAILURE_CLASSES[0]), (pct >= 75, FAILURE_CLASSES[1]), (pct >= 50, FAILURE_CLASSES[2]), (pct >= 25, FAILURE_CLASSES[3]), (pct > 0, FAILURE_CLASSES[4])], FAILURE_CLASSES[5])


def percent_class(x: Column) -> Column:
    return ladder(x, [(x.isNull(), "not_available"), (x == 0, "none"), (x < 0.01, "very_low"), (x < 0.05, "low"), (x < 0.15, "moderate")], "high")


def residual_class(x: Column) -> Column:
    return ladder(x, [(x.isNull(), "not_available"), (x < 0.10, "low"), (x < 0.25, "moderate"), (x < 0.50, "high")], "very_high")


def coverage_class(x: Column) -> Column:
    return ladder(x, [(x.isNull(), "not_available"), (x >= 0.90, "high_coverage"), (x >= 0.60, "moderate_coverage")], "low_coverage")


def attention_class(score: Column) -> Column:
    return ladder(score, [(score <= 1, "low_attention"), (score <= 3, "moderate_attention")], "high_attention")


def completeness_class(x: Column) -> Column:
    return ladder(x, [(x.isNull(), "not_available"), (x >= 0.95, "high"), (x >= 0.80, "moderate"), (x > 0, "low")], "none")


def overlap_class(n: Column) -> Column:
    return ladder(n, [(n.isNull(), "not_available"), (n == 0, "none"), (n <= 5, "low"), (n <= 20, "moderate")], "high")


def parse_segment_number(c: Column | str, last: bool = False) -> Column:
    """The number before (or after) the slash of texts such as 02/03; a text without slash has no part after it."""
    parts = F.split(F.trim(col(c).cast("string")), "/")
    text = F.when(F.size(parts) >= 2, F.element_at(parts, 2)) if last else F.element_at(parts, 1)
    return F.regexp_extract(text, r"^\s*(\d+)\s*$", 1).try_cast("int")


def format_number_pt(c: Column | str, digits: int = 2) -> Column:
    """Points for thousands, a decimal comma."""
    return F.translate(F.format_number(col(c), digits), ",.", ".,")


def dms(c: Column | str, positive: str, negative: str) -> Column:
    """Degrees, minutes and whole seconds of a coordinate, two digits each, and its direction."""
    total = F.bround(F.abs(col(c)) * 3600, 0).cast("long")
    text = F.format_string("%02d° %02d' %02d\" %s", F.floor(total / 3600), F.floor(total / 60) % 60, total % 60, F.when(col(c) >= 0, F.lit(positive)).otherwise(F.lit(negative)))
    return F.when(is_finite(c), text)


#: Names that no export holds, and parts of names that none holds.
PRIVATE_NAMES = ("raw_file", "raw_file_path", "first_raw_file", "source_file", "source_path", "local_file", "request_headers", "response_body", "raw_json", "json_response", "raw_verticais")
PRIVATE_PARTS = ("token", "senha", "password", "cpf", "cnpj", "identificador", "credential", "credencial", "secret", "api_key")


def sensitive(name: str) -> bool:
    """Columns that no export may hold: paths and raw answers by name, credentials and personal numbers by a part of it."""
    lower = name.lower()
    return lower in PRIVATE_NAMES or any(part in lower for part in PRIVATE_PARTS)
