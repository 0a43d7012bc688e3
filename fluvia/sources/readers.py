"""Readers of raw series, inventories, logs and tables. All of them are Spark readers, so any store will do."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvia.operators.daily import normalize_month_rows

HEADER = r"^\s*EstacaoCodigo\s*;"
MEMBERS = {"discharge": r"(?i)vaz", "stage": r"(?i)cota", "rainfall": r"(?i)chuva|pluv"}
LOG_SCHEMA = "station_code string, route_name string, endpoint string, date_start string, date_end string, http_status double, api_status string, api_code string, api_message string, n_items double, success boolean, error_message string, raw_file string, requested_at string, downloaded_at string"


def delimited_rows(files: DataFrame, header: str = HEADER, separator: str = ";") -> DataFrame:
    """The rows below the header line of each file (path, text), all columns as strings; preambles and files without header are skipped.

    Columns are looked up by name, so files may differ; the names (one small set) are the only thing collected.
    """
    lines = F.split(F.regexp_replace("text", "^﻿", ""), r"\r?\n")
    marked = files.select("path", lines.alias("lines")).withColumn("at", F.array_position(F.transform("lines", lambda x: x.rlike(header)), True).cast("int")).where("at > 0")
    names = F.transform(F.split(F.element_at("lines", F.col("at")), separator), lambda x: F.trim(x))
    rows = marked.select("path", names.alias("names"), F.explode(F.expr("slice(lines, at + 1, size(lines))")).alias("line")).where("trim(line) <> ''")
    found = sorted({n for r in rows.select("names").distinct().collect() for n in r["names"] if n})
    values = F.transform(F.split("line", separator, -1), lambda x: F.trim(x))
    # duplicates in a header keep their first place; short lines have nulls at the end
    return rows.select("path", *(F.nullif(F.get(values, F.array_position("names", n).cast("int") - 1), F.lit("")).alias(n) for n in found))


def read_latin1(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole ISO-8859-1 files."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "ISO-8859-1").alias("text"))


def read_series_csv(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """Daily records of CSV downloads: ISO-8859-1, semicolons, decimal commas, a preamble before the header."""
    return _series(delimited_rows(read_latin1(spark, path)), variable, "hidroweb_csv")


def unzip(files: DataFrame, pattern: str) -> DataFrame:
    """(path, text) of the members of zip files (path, content) whose name matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = sorted(n for n in archive.namelist() if re.search(pattern, n) and not n.endswith("/"))
                    for name in names:
                        yield pa.RecordBatch.from_arrays([pa.array([f"{path}!{name}"]), pa.array([archive.read(name).decode("iso-8859-1")])], names=["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string")


def read_series_zip(spark: SparkSession, path: str, variable: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return _series(delimited_rows(unzip(files, MEMBERS[variable])), variable, "hidroweb_zip")


def read_series_xml(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """Each SerieHistorica node is a month row; its children are the columns."""
    rows = spark.read.format("xml").option("rowTag", "SerieHistorica").option("inferSchema", "false").load(path)
    return _series(rows, variable, "ana_xml")


def read_series_json(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """{"items": [...]} documents; an item is a month row."""
    return _series(read_items(spark, path), variable, "ana_json")


def read_series_download(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """What an authenticated download has written: rows of the REST source, whose item maps are month rows."""
    rows = spark.read.parquet(path).where("status = 'success' and item is not null")
    names = sorted(r[0] for r in rows.select(F.explode(F.map_keys("item"))).distinct().collect())  # the columns of a service's answer, some hundred
    if not names:
        raise ValueError(f"no {variable} records")
    return _series(rows.select(*(F.col("item")[n].alias(n) for n in names)), variable, "ana_api_download")


def read_items(spark: SparkSession, path: str, provenance: bool = False) -> DataFrame:
    """The flattened items of JSON documents, all values as strings; with ``provenance``, the file each came from."""
    docs = spark.read.option("multiLine", "true").option("primitivesAsString", "true").json(path)
    if "items" not in docs.columns:
        raise ValueError("the documents have no items")
    extra = [F.col("_metadata.file_path").alias("raw_file")] if provenance else []
    return docs.select(*extra, F.explode("items").alias("i")).select(*(["raw_file"] if provenance else []), "i.*")


def read_raw_folder(spark: SparkSession, path: str, log: DataFrame | None = None) -> DataFrame:
    """Items below route=…/station=… folders with both as columns; joined to the request log by file name, if given."""
    docs = spark.read.option("multiLine", "true").option("primitivesAsString", "true").option("basePath", path).json(path)
    keys = [c for c in ("route", "station") if c in docs.columns]
    rows = docs.select(*keys, F.col("_metadata.file_name").alias("raw_file"), F.explode("items").alias("i")).select(*keys, "raw_file", "i.*")
    if log is None:
        return rows
    times = log.select(F.regexp_extract("raw_file", "([^/\\\\]+)$", 1).alias("raw_file"), "downloaded_at").groupBy("raw_file").agg(F.max("downloaded_at").alias("downloaded_at"))
    return rows.join(times, "raw_file", "left")


def _series(rows: DataFrame, variable: str, source: str) -> DataFrame:
    out = normalize_month_rows(rows, variable, source)
    if out.isEmpty():
        raise ValueError(f"no {variable} records")
    return out


def read_inventory_xml(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "Table").option("inferSchema", "false").load(path)


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).option("header", "true").csv(path)


SERIES = {"hidroweb_zip": read_series_zip, "hidroweb_csv": read_series_csv, "ana_xml": read_series_xml, "ana_json": read_series_json, "ana_api_download": read_series_download}


def read_series(spark: SparkSession, path: str, variable: str, source_type: str = "ana_xml") -> DataFrame:
    """Daily records by kind of source."""
    return SERIES[source_type](spark, path, variable)


# tables


def read_table(spark: SparkSession, root: str, name: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A Parquet table below root; one that is missing is empty, of the given schema."""
    try:
        return spark.read.parquet(f"{root}/{name}.parquet")
    except AnalysisException:
        return spark.createDataFrame([], schema or "station_code string")


def distinct_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Different rows of those of the named columns that there are."""
    return df.select(*(n for n in names if n in df.columns)).distinct()


def station_rows(df: DataFrame, code: str) -> DataFrame:
    """One station's rows; the code is compared as it is stored, so the filter reaches the files."""
    return df.where(F.col("station_code") == code)


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_name string, table_type string, is_temporary boolean")


def response_status(http_status: Column, body: Column) -> Column:
    """What an API response says: unauthorized also where only the body tells so."""
    text = F.lower(F.coalesce(body, F.lit("")))
    denied = http_status.isin(401, 403) | text.rlike("token|autoriz|auth|credencial|expir")
    return F.when(F.coalesce(denied, F.lit(False)), "unauthorized").when(http_status.between(200, 299), "ok").when(http_status.isNull(), "no_response").otherwise("error")
