"""One localised CSV file for each station, written by the executors through a Spark data source with commit and abort.

``export_stations`` brings each station's rows together in order; a task writes the files of its stations one after the
other, row by row, into a staging folder. The driver's commit moves the files of all tasks that succeeded to their names;
an abort, or a task that fails, leaves none of its files. Only names and counts pass through the driver.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date

import pyarrow.fs
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from fluvia.sources.sinks import FILES, HEADINGS, NOTHING, file_name

STATION, EMPTY = "__station", "__empty"
#: File names without a date; the summary is plain, the reports have a byte-order mark.
UNDATED = {"station_summary": "station_{}_summary.csv", "flow_report": "relatorio_download_api_ana_flu_{}.csv", "rain_report": "relatorio_download_api_ana_plu_{}.csv"}
KINDS = (*FILES, *UNDATED)


@dataclass(frozen=True)
class Style:
    """How a file's values and lines are written."""

    separator: str = ";"
    decimal: str = ","
    bom: bool = True


def style_of(kind: str) -> Style:
    return Style(",", ".", kind != "station_summary") if kind in UNDATED else Style()


def name_of(kind: str, station: str, day: date, duration_days: int | None = None) -> str:
    return UNDATED[kind].format(station) if kind in UNDATED else file_name(kind, station, day, duration_days)


def cell(value: object, decimal: str) -> object:
    """A value as a CSV cell: decimal marks replaced, flags as TRUE and FALSE, null empty."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        text = repr(value)
        return (text if "e" not in text else f"{value:.12f}".rstrip("0")).replace(".", decimal)
    return "" if value is None else value


@dataclass
class Written(WriterCommitMessage):
    """The staged files of a task: (staged, final, rows)."""

    files: list[tuple[str, str, int]]


class StationFiles(DataSource):
    """df.write.format("fluvia_station_files"): rows come by station; options: folder, kind, day, duration_days."""

    @classmethod
    def name(cls) -> str:
        return "fluvia_station_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), schema.names)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, names: list[str]) -> None:
        self.kind, self.columns = options["kind"], [n for n in names if n not in (STATION, EMPTY)]
        self.folder, self.staging = options["folder"].rstrip("/"), f"{options['folder'].rstrip('/')}/.staging-{uuid.uuid4().hex}"
        self.day = date.fromisoformat(options.get("day") or date.today().isoformat())
        self.days = int(options["duration_days"]) if options.get("duration_days") else None

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        style, own = style_of(self.kind), f"{self.staging}/{uuid.uuid4().hex}"
        fs, place = pyarrow.fs.FileSystem.from_uri(own)
        done: list[tuple[str, str, int]] = []
        file = text = out = station = None

        def close() -> None:
            if file is not None:
                text.flush()
                text.detach()
                file.close()

        try:
            for row in iterator:
                if row[STATION] != station:
                    close()
                    station, name = row[STATION], name_of(self.kind, row[STATION], self.day, self.days)
                    if not done:
                        fs.create_dir(place, recursive=True)
                    done.append((f"{own}/{name}", f"{self.folder}/{name}", 0))
                    file = fs.open_output_stream(f"{place}/{name}")
                    text = io.TextIOWrapper(file, encoding="utf-8-sig" if style.bom else "utf-8", newline="", write_through=False)
                    out = csv.writer(text, delimiter=style.separator)
                    out.writerow(["mensagem"] if row[EMPTY] and self.kind in NOTHING else self.columns)
                if row[EMPTY]:
                    if self.kind in NOTHING:
                        out.writerow([NOTHING[self.kind]])
                    continue
                out.writerow([cell(row[c], style.decimal) for c in self.columns])
                done[-1] = (*done[-1][:2], done[-1][2] + 1)
            close()
        except BaseException:
            if file is not None and not file.closed:
                file.close()
            if done:
                fs.delete_dir(place)
            raise
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = pyarrow.fs.FileSystem.from_uri(self.folder)
        fs.create_dir(folder, recursive=True)
        for staged, final, _ in (f for m in messages if m is not None for f in m.files):
            fs.move(pyarrow.fs.FileSystem.from_uri(staged)[1], pyarrow.fs.FileSystem.from_uri(final)[1])
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, place = pyarrow.fs.FileSystem.from_uri(self.staging)
        if fs.get_file_info(place).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(place)


def headed(df: DataFrame, kind: str, digits: int = 3) -> list[Column]:
    """A product's columns under its headings (its own names where it has none), numbers rounded half to even."""
    kinds = dict(df.dtypes)
    names = {c: h for c, h in HEADINGS[kind].items() if c in kinds} if kind in HEADINGS else {c: c for c in df.columns}
    return [F.bround(F.col(f"`{c}`"), digits).alias(h) if kinds[c] in ("double", "float") else F.col(f"`{c}`").alias(h) for c, h in names.items()]


def export_stations(df: DataFrame, kind: str, folder: str, *, day: date | None = None, order_by: Sequence[str] = (), stations: DataFrame | None = None, duration_days: int | None = None) -> None:
    """Writes a product's file for every station that has rows, or, given ``stations``, for each of those.

    A station without rows gets the product's message (only headings where it has none). Files of the same names are
    replaced. Rows of a null station are left out; ties of ``order_by`` fall in any order. A file is written by one task,
    row by row; other folders than local ones need pyarrow's file system for their scheme on the executors.
    """
    if kind not in KINDS:
        raise ValueError(f"no download is called {kind}")
    own = df.where(F.col("station_code").isNotNull())
    rows = own.select(F.col("station_code").alias(STATION), F.lit(False).alias(EMPTY), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order_by)), *headed(df, kind))
    if stations is not None:
        without = stations.select(F.col("station_code").alias(STATION)).where(F.col(STATION).isNotNull()).distinct().join(own.select(F.col("station_code").alias(STATION)).distinct(), STATION, "left_anti")
        rows = rows.join(stations.select(F.col("station_code").alias(STATION)).distinct(), STATION, "left_semi").unionByName(without.withColumn(EMPTY, F.lit(True)), allowMissingColumns=True)
    orders = [f"__o{i}" for i in range(len(order_by))]
    ready = rows.repartition(STATION).sortWithinPartitions(STATION, *orders).drop(*orders)
    df.sparkSession.dataSource.register(StationFiles)
    writer = ready.write.format("fluvia_station_files").mode("append").option("folder", folder).option("kind", kind)
    writer = writer.option("day", (day or date.today()).isoformat())
    (writer.option("duration_days", str(duration_days)) if duration_days else writer).save()
