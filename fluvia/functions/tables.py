"""Table functions and diagnostics by name, for queries in SQL; each can be replaced.

``register`` puts the functions into a session. A table function takes the rows of one partition of its argument, such
as a station's, and gives the rows of its diagnostic:

    SELECT * FROM pot_tests(TABLE(SELECT ...) PARTITION BY station_code ORDER BY date_peak)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from fluvia.operators import diagnostics, extremes


def tested_peaks(rows: list[Row]) -> Iterator[tuple]:
    """The tests of one series of peaks: rows (station_code, date_peak, q_peak_m3s, y0, y1); a null date is no peak."""
    peaks = sorted((r["date_peak"], r["q_peak_m3s"]) for r in rows if r["date_peak"] is not None)
    head = rows[0]
    found = extremes.series_tests([q for _, q in peaks], [d.toordinal() for d, _ in peaks], [d.year for d, _ in peaks], head["y0"], head["y1"])
    yield (head["station_code"], *found.values())


def residual_regimes(rows: list[Row]) -> Iterator[tuple]:
    """The regimes of one station's residuals: rows (station_code, measurement_date, power_log_residual)."""
    import numpy as np

    found, evidence = diagnostics.find_regimes(np.array([r["measurement_date"].toordinal() for r in rows]), np.array([r["power_log_residual"] for r in rows], dtype=float))
    yield (rows[0]["station_code"], found["n_regimes"], len(rows), evidence)


#: name: (what makes rows of a partition's rows, the columns)
DIAGNOSTICS: dict[str, tuple[Callable[[list[Row]], Iterator[tuple]], str]] = {
    "pot_tests": (tested_peaks, "station_code string, " + extremes.TEST_FIELDS),
    "residual_regimes": (residual_regimes, "station_code string, n_regimes int, n_points bigint, regime_evidence_class string"),
}


def table_function(rows_of: Callable[[list[Row]], Iterator[tuple]], columns: str) -> Any:
    """A table function that gathers a partition's rows and hands them on once; a partition is held in memory."""

    class Gathered:
        def __init__(self) -> None:
            self.rows: list[Row] = []

        def eval(self, row: Row) -> None:
            self.rows.append(row)

        def terminate(self) -> Iterator[tuple]:
            if self.rows:
                yield from rows_of(self.rows)

    return udtf(Gathered, returnType=columns)


def register(spark: SparkSession, replaced: Mapping[str, Callable[[list[Row]], Iterator[tuple]]] | None = None) -> list[str]:
    """Registers all diagnostics as table functions of the session, those in ``replaced`` with another function of equal columns."""
    for name in replaced or {}:
        if name not in DIAGNOSTICS:
            raise KeyError(name)
    for name, (rows_of, columns) in DIAGNOSTICS.items():
        spark.udtf.register(name, table_function((replaced or {}).get(name, rows_of), columns))
    return sorted(DIAGNOSTICS)
