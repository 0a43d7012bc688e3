"""Counters of products, observed in the pass that writes them, and constraints of a release, one aggregate a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fluvia.functions.columns import yes
from fluvia.operators.cleaning import REASONS

#: Of each product, the columns whose nulls, negative values and extents its counters report, and its flags.
COUNTED: dict[str, dict[str, tuple[str, ...]]] = {
    "measurements": {"missing": ("station_code", "measurement_datetime", "consistency_level", "discharge_m3s"), "negative": ("discharge_m3s", "stage_cm", "width_m", "wetted_area_m2", "mean_depth_m", "mean_velocity_ms"), "extent": ("measurement_datetime",)},
    "rating_curves": {
        "missing": ("station_code", "measurement_datetime", "valid_to", "consistency_level", "segment_number", "stage_min_cm", "stage_max_cm", "coefficient_a", "coefficient_h0", "coefficient_n"), "negative": ("stage_min_cm", "stage_max_cm"), "extent": ("valid_from",),
    },
    "cross_section_vertices": {
        "missing": ("station_code", "measurement_datetime", "consistency_level", "survey_number", "section_type", "source_record_id", "vertex_distance_m", "vertex_stage_cm", "distance_pipf_m", "n_vertices_reported"), "negative": ("vertex_distance_m", "vertex_stage_cm"), "extent": ("measurement_datetime",),
    },
    "stations": {"missing": ("station_code",), "flags": ("missing_coordinates", "has_discharge_measurements", "has_telemetry", "has_stage_data", "has_rainfall_data", "source_api", "source_ws_telemetric", "source_ws_conventional"), "present": ("discharge_start_date", "discharge_end_date", "telemetric_start_date", "telemetric_end_date", "stage_start_date", "stage_end_date", "rainfall_start_date", "rainfall_end_date")},
}


def counters(product: str, columns: Sequence[str]) -> list[Column]:
    """The named counters of a product over the columns that it has."""
    spec, has = COUNTED[product], set(columns)
    out = [F.count(F.lit(1)).alias("n_final_records")]
    out += [F.count_if(F.col(c).isNull()).alias(f"n_missing_{c}") for c in spec.get("missing", ()) if c in has]
    out += [F.count_if(yes(F.col(c) < 0)).alias(f"n_negative_{c}") for c in spec.get("negative", ()) if c in has]
    out += [F.count_if(yes(F.col(c))).alias(f"n_{c}") for c in spec.get("flags", ()) if c in has]
    out += [F.count(c).alias(f"n_with_{c}") for c in spec.get("present", ()) if c in has]
    return out + [f(c).cast("string").alias(f"{n}_{c}") for c in spec.get("extent", ()) if c in has for n, f in (("first", F.min), ("last", F.max))]


@dataclass
class Counted:
    """A product whose counters are known once it has been written, in the same pass."""

    product: str
    rows: DataFrame
    seen: list[Observation]

    def values(self) -> dict[str, str | None]:
        """The counters as texts; waits for the first action on ``rows``, without an action of its own."""
        return {k: None if v is None else str(v) for o in self.seen for k, v in o.get.items()}


def counted(df: DataFrame, product: str) -> Counted:
    """A product that is counted while it is written.

    Of rows with ``removed_reason`` (see ``clean_levels``) those that stay are the product; those removed are counted by
    reason before they go. Distinct counts are not among the counters: observed metrics have none.
    """
    seen = []
    if "removed_reason" in df.columns:
        removed = [F.count(F.lit(1)).alias("n_raw_records"), F.count("removed_reason").alias("n_total_records_removed"), *(F.count_if(yes(F.col("removed_reason") == r)).alias(f"n_removed_{r}") for r in REASONS)]
        seen.append(Observation())
        df = df.observe(seen[-1], *removed).where("removed_reason is null").drop("removed_reason")
    seen.append(Observation())
    return Counted(product, df.observe(seen[-1], *counters(product, df.columns)), seen)


@dataclass(frozen=True)
class Unique:
    """No two rows have the same values of the columns; nulls are values."""

    columns: tuple[str, ...]


@dataclass(frozen=True)
class NotNull:
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Holds:
    """A condition in SQL that every row meets; a null condition is not met."""

    name: str
    condition: str


@dataclass(frozen=True)
class Linked:
    """The columns' values, unless one is null, are a row of the parent table under the same names."""

    columns: tuple[str, ...]
    parent: str


Constraint = Unique | NotNull | Holds | Linked


def name_of(constraint: Constraint) -> str:
    if isinstance(constraint, Holds):
        return f"holds:{constraint.name}"
    kind = {Unique: "unique", NotNull: "not_null", Linked: "link"}[type(constraint)]
    return f"{kind}:{','.join(constraint.columns)}" + (f"->{constraint.parent}" if isinstance(constraint, Linked) else "")


def validate(tables: Mapping[str, DataFrame], constraints: Mapping[str, Sequence[Constraint]]) -> DataFrame:
    """(table_name, constraint_name, n_rows, n_failures): one row a constraint, one aggregate and one scan a table.

    Failures are rows; of a key that repeats, all rows but one. A table that is absent fails every constraint with a null
    count. A link adds a join with the parent's distinct keys to its table's aggregate.
    """
    out = []
    for table, wanted in constraints.items():
        if table not in tables:
            spark = next(iter(tables.values())).sparkSession
            out.append(spark.createDataFrame([(table, name_of(c), None, None) for c in wanted], "table_name string, constraint_name string, n_rows bigint, n_failures bigint"))
            continue
        df, failures = tables[table], []
        for i, c in enumerate(wanted):
            if isinstance(c, Unique):
                failures.append(F.count(F.lit(1)) - F.count_distinct(F.struct(*(F.col(f"`{k}`") for k in c.columns))))
            elif isinstance(c, NotNull):
                failures.append(F.count_if(reduce(lambda a, b: a | b, (F.col(f"`{k}`").isNull() for k in c.columns))))
            elif isinstance(c, Holds):
                failures.append(F.count_if(~yes(F.expr(c.condition))))
            else:
                known = tables[c.parent].select(*(F.col(f"`{k}`").alias(f"__k{i}_{j}") for j, k in enumerate(c.columns))).distinct().withColumn(f"__link{i}", F.lit(True))
                df = df.join(known, reduce(lambda a, b: a & b, (F.col(f"`{k}`") == F.col(f"__k{i}_{j}") for j, k in enumerate(c.columns))), "left")
                failures.append(F.count_if(F.col(f"__link{i}").isNull() & reduce(lambda a, b: a & b, (F.col(f"`{k}`").isNotNull() for k in c.columns))))
        row = df.agg(F.count(F.lit(1)).alias("n_rows"), *(f.alias(f"f{i}") for i, f in enumerate(failures)))
        each = F.array(*(F.struct(F.lit(name_of(c)).alias("constraint_name"), F.col("n_rows"), F.col(f"f{i}").cast("long").alias("n_failures")) for i, c in enumerate(wanted)))
        out.append(row.select(F.lit(table).alias("table_name"), F.inline(each)))
    return reduce(DataFrame.union, out)


def accepted(report: DataFrame) -> bool:
    """Whether a validation has no failure and no absent table."""
    return report.where("n_failures is null or n_failures > 0").isEmpty()
