"""Adaptive time partitions by bottom-up agglomeration.

Rows are counted by hour, and hours by day, month and year. Starting from all hours, complete sets of siblings whose
parent holds at most L rows collapse to the parent, level by level; what survives is joined to runs of neighbouring
siblings by next-fit. A run is a leaf; its rows in order of their moments fill Parquet files of L rows.

The counts, the collapse and the runs are aggregates and groups of at most the calendar's size. Of the rows themselves,
only those of leaves over L are ranked, by a range sort of their keys: the first key of each further file is a cut. The
list of leaves and cuts is what an index of files is; its length follows rows / L, and it alone is on the driver and in
every task, where each row finds its file. The rows then shuffle once, narrow when digests are compared and whole only for
the files that are written.
"""

from __future__ import annotations

import bisect
import calendar
import datetime as dt
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvia.session import materialize, shared_dir

YEARS, MONTHS, DAYS, HOURS = range(4)
NULL = "null"
EPOCH = dt.date(1970, 1, 1)
HOUR = 3_600_000_000
#: Stands for null in keys, so that null comes first.
NONE = -(1 << 63)
#: What places a row: its moment and arrival in microseconds, its id, a hash of all columns, and a number of its own.
KEYS = ("__moment", "__arrived", "__id", "__tie", "__uid")


def siblings(level: int, parent: int) -> tuple[int, int]:
    """(first, number) of the months of a year, the days of a month (both counted from the year 0 and 1970) or the hours of a day."""
    if level == MONTHS:
        return parent * 12, 12
    if level == DAYS:
        first = dt.date(parent // 12, parent % 12 + 1, 1)
        return (first - EPOCH).days, calendar.monthrange(first.year, first.month)[1]
    return parent * 24, 24


def run_name(level: int, first: int, last: int) -> str:
    """The parents and the first and last member of a run: ``2005-2007``, ``2024/03/05/07-07``."""
    if level == YEARS:
        return f"{first:04}-{last:04}"
    if level == MONTHS:
        return f"{first // 12:04}/{first % 12 + 1:02}-{last % 12 + 1:02}"
    day = EPOCH + dt.timedelta(days=first if level == DAYS else first // 24)
    parents = f"{day.year:04}/{day.month:02}"
    if level == DAYS:
        return f"{parents}/{day.day:02}-{(EPOCH + dt.timedelta(days=last)).day:02}"
    return f"{parents}/{day.day:02}/{first % 24:02}-{last % 24:02}"


def next_fit(level: int, first: int, counts: list[int], limit: int) -> list[tuple[str, int, int]]:
    """(name, first hour, rows) of the runs with rows among siblings in order, empty ones included.

    A sibling within the limit joins the run of the one before it while that stays within; one above it is split, an
    hour above it is a run of its own.
    """
    runs: list[list[int]] = []
    open_ = False
    for i, n in enumerate(counts):
        if n > limit:
            open_ = False
            if level == HOURS:
                runs.append([i, i, n])
        elif open_ and runs[-1][2] + n <= limit:
            runs[-1][1:] = [i, runs[-1][2] + n]
        else:
            runs.append([i, i, n])
            open_ = True
    return [(run_name(level, first + a, first + b), first_hour(level, first + a), n) for a, b, n in runs if n]


def first_hour(level: int, member: int) -> int:
    """Hours from 1970 to the start of a member."""
    if level == HOURS:
        return member
    if level == DAYS:
        return member * 24
    year, month = (member, 0) if level == YEARS else divmod(member, 12)
    return (dt.date(year, month + 1, 1) - EPOCH).days * 24


def micros(time: Column) -> Column:
    """Microseconds from 1970 of what a clock shows, for times with or without zone."""
    seconds = F.datediff(F.to_date(time), F.lit(EPOCH)).cast("long") * 86_400 + F.hour(time) * 3_600 + F.minute(time) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")


def hour_of(moment: Column) -> Column:
    return F.call_function("div", moment - F.pmod(moment, F.lit(HOUR)), F.lit(HOUR))


def hour_counts(rows: DataFrame) -> DataFrame:
    """(y, m, d, h, n): the hours that have rows, null moments left out."""
    counted = rows.where(F.col("__moment") != NONE).groupBy(hour_of(F.col("__moment")).alias("h")).agg(F.count("*").alias("n"))
    day = F.call_function("div", F.col("h") - F.pmod("h", F.lit(24)), F.lit(24)).cast("int")
    date = F.date_add(F.lit(EPOCH), F.col("d"))
    return materialize(counted.withColumn("d", day).select(F.year(date).alias("y"), (F.year(date) * 12 + F.month(date) - 1).alias("m"), "d", "h", "n"), "hours")


def leaves(hours: DataFrame, limit: int) -> DataFrame:
    """(leaf, start, n): the runs of surviving siblings, by the first hour of each.

    Sums go up level by level, one after the other. A sibling survives where its parent is above the limit.
    """
    days = materialize(hours.groupBy("y", "m", "d").agg(F.sum("n").alias("n")), "days")
    months = materialize(days.groupBy("y", "m").agg(F.sum("n").alias("n")), "months")
    years = materialize(months.groupBy("y").agg(F.sum("n").alias("n")), "years")

    def surviving(level: int, members: DataFrame, member: str, parents: DataFrame, parent: str) -> DataFrame:
        split = parents.where(F.col("n") > limit).select(parent)
        return members.join(split, parent).select(F.lit(level).alias("level"), F.col(parent).alias("parent"), F.col(member).cast("long").alias("member"), "n")

    sets = years.select(F.lit(YEARS).alias("level"), F.lit(0).alias("parent"), F.col("y").cast("long").alias("member"), "n")
    sets = sets.unionByName(surviving(MONTHS, months, "m", years, "y")).unionByName(surviving(DAYS, days, "d", months, "m")).unionByName(surviving(HOURS, hours, "h", days, "d"))

    def runs(pdf: pd.DataFrame) -> pd.DataFrame:
        level, parent = int(pdf["level"].iloc[0]), int(pdf["parent"].iloc[0])
        have = dict(zip(pdf["member"].tolist(), pdf["n"].tolist(), strict=True))
        first, many = (min(have), max(have) - min(have) + 1) if level == YEARS else siblings(level, parent)
        return pd.DataFrame(next_fit(level, first, [have.get(first + i, 0) for i in range(many)], limit), columns=["leaf", "start", "n"])

    return sets.groupBy("level", "parent").applyInPandas(runs, "leaf string, start bigint, n bigint")


@dataclass
class Layout:
    """The files of a layout in the order of their rows' keys, the null leaf first.

    ``starts`` are the first hours of the other leaves; ``cuts`` holds, by leaf, the first keys of its further files.
    """

    names: list[str]
    starts: np.ndarray
    cuts: dict[int, list[tuple[int, ...]]]

    def __post_init__(self) -> None:
        self.first = np.cumsum([0, *(1 + len(self.cuts.get(i, ())) for i in range(len(self.names)))])

    def files(self, keys: list[np.ndarray]) -> np.ndarray:
        """The numbers of the files of rows with such keys."""
        moment = keys[0]
        leaf = np.searchsorted(self.starts, moment // HOUR, side="right") - 1 + len(self.names) - len(self.starts)
        leaf[moment == NONE] = 0
        found = self.first[leaf]
        for i in np.flatnonzero(np.isin(leaf, list(self.cuts))).tolist():
            found[i] += bisect.bisect_right(self.cuts[int(leaf[i])], tuple(int(k[i]) for k in keys))
        return found

    def labels(self) -> list[tuple[str, int]]:
        """(leaf, part from 1) of each file."""
        return [(name, part + 1) for i, name in enumerate(self.names) for part in range(int(self.first[i + 1] - self.first[i]))]


def staged(df: DataFrame, moment: Column, arrived: Column, ident: Column, old: Column) -> DataFrame:
    """The table with its columns as one struct, the keys, a second hash, and whether a row is in the starting layout.

    Written once, so that a row keeps its number; rows that are equal in all columns differ by it alone.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    held = (micros(moment), micros(arrived), ident.cast("long"), F.xxhash64(*columns), F.monotonically_increasing_id())
    keys = [F.coalesce(c, F.lit(NONE)).alias(k) for c, k in zip(held, KEYS, strict=True)]
    return materialize(df.select(F.struct(*columns).alias("__all"), *keys, F.xxhash64(F.lit(1), *columns).alias("__more"), F.coalesce(old, F.lit(False)).alias("__old")), "staged")


def plan(rows: DataFrame, limit: int) -> Layout:
    """The layout of staged rows: leaves by their hours, and the cuts of leaves above the limit by their rows' ranks.

    The driver gets the list of leaves and cuts, at most about 17 times rows / limit, and a count for each task of the
    sort; the ranks of rows are those within the tasks of a range sort after the counts of the tasks before.
    """
    found = sorted((r["start"], r["leaf"], r["n"]) for r in leaves(hour_counts(rows), limit).collect())
    nulls = rows.where(F.col("__moment") == NONE).count()
    names, sizes = [NULL] * bool(nulls) + [x[1] for x in found], [nulls] * bool(nulls) + [x[2] for x in found]
    starts = np.array([x[0] for x in found], dtype=np.int64)
    large = [i for i, n in enumerate(sizes) if n > limit]
    if not large:
        return Layout(names, starts, {})
    hours = [int(starts[i - bool(nulls)]) for i in large if names[i] != NULL]
    some = F.when(F.col("__moment") == NONE, F.lit(nulls > limit)).otherwise(hour_of(F.col("__moment")).isin(hours) if hours else F.lit(False))
    ranked = rows.where(some).select(*KEYS).repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).withColumn("__row", F.monotonically_increasing_id())
    ranked = materialize(ranked.select(*KEYS, F.shiftright("__row", 33).alias("__task"), F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)).alias("__row")), "ranked")
    before, offsets = 0, []
    for task, n in sorted(map(tuple, ranked.groupBy("__task").count().collect())):
        offsets.append((task, before))
        before += n
    wanted, before = {}, 0  # ranks at which further files begin
    for i in large:
        wanted |= {before + j: i for j in range(limit, sizes[i], limit)}
        before += sizes[i]
    tasks = F.broadcast(rows.sparkSession.createDataFrame(offsets, "__task bigint, __off bigint"))
    first = ranked.join(tasks, "__task").withColumn("__rank", F.col("__off") + F.col("__row")).where(F.col("__rank").isin(list(wanted)))
    cuts: dict[int, list[tuple[int, ...]]] = {}
    for r in sorted(map(tuple, first.select("__rank", *KEYS).collect())):
        cuts.setdefault(wanted[r[0]], []).append(r[1:])
    return Layout(names, starts, cuts)


def located(rows: DataFrame, layout: Layout) -> DataFrame:
    """The rows with ``__file``, the number of their file; only their keys pass through Python."""
    shared = rows.sparkSession.sparkContext.broadcast(layout)

    @F.pandas_udf("int")
    def number(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(shared.value.files([k.to_numpy(dtype=np.int64) for k in keys]).astype(np.int32))

    return rows.withColumn("__file", number(*KEYS))


def digests(rows: DataFrame, layout: Layout) -> dict[tuple[str, int], tuple]:
    """By leaf and part: the number of rows and the sums of two 64-bit hashes of them, whatever their order."""
    wide = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("__tie", "__more")]
    labels = layout.labels()
    found = located(rows.select(*KEYS, "__more"), layout).groupBy("__file").agg(F.count("*").alias("n"), *wide).collect()
    return {labels[r["__file"]]: (r["n"], r["__tie"], r["__more"]) for r in found}


def unused(names: list[str], wanted: str) -> str:
    """The wanted name, with underscores until no column has it."""
    taken = {n.lower() for n in names}
    while wanted in taken:
        wanted += "_"
    return wanted


def write_files(rows: DataFrame, layout: Layout, folder: str, only: set[tuple[str, int]] | None = None) -> None:
    """Adds a Parquet file for each leaf and part (of ``only``), its rows in order of their keys.

    A file is one task's part of one shuffle of the rows that are written, and holds at most the limit's rows.
    """
    names = rows.schema["__all"].dataType.names
    leaf, part = unused(names, "leaf"), unused(names, "part")
    labels = [(i, name.replace("/", "."), k) for i, (name, k) in enumerate(layout.labels()) if only is None or (name, k) in only]
    files = F.broadcast(rows.sparkSession.createDataFrame(labels, f"__file int, `{leaf}` string, `{part}` int"))  # the list of files
    some = located(rows, layout).join(files, "__file").repartition("__file").sortWithinPartitions(leaf, part, *KEYS)
    some.select("__all.*", leaf, part).write.mode("append").option("maxRecordsPerFile", 0).partitionBy(leaf, part).parquet(folder)


def listed(spark: SparkSession, folder: str) -> dict[tuple[str, int], list[str]]:
    """The data files of a folder by leaf and part."""
    jvm, found = spark.sparkContext._jvm, {}
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    while files.hasNext():
        at = files.next().getPath()
        if at.getName().endswith(".parquet"):
            leaf, part = at.getParent().getParent().getName(), at.getParent().getName()
            found.setdefault((leaf.partition("=")[2].replace(".", "/"), int(part.partition("=")[2])), []).append(at.toString())
    return found


def removed(spark: SparkSession, paths: list[str]) -> None:
    for text in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)


def report(spark: SparkSession, folder: str, schema: T.StructType, ident: Column, old: Column, stayed: set[tuple[str, int]]) -> DataFrame:
    """A row for each file, from what is read back: its rows' ids go through a hash in the order of the file."""
    leaf, part = unused(schema.names, "leaf"), unused(schema.names, "part")
    read = spark.read.schema(T.StructType([*schema.fields, T.StructField(leaf, T.StringType()), T.StructField(part, T.IntegerType())])).parquet(folder)
    at = F.col("_metadata.row_index")
    rows = read.select(F.col(leaf).alias("__leaf"), F.col(part).alias("__part"), at.alias("__row"), F.when(at == 0, F.col("_metadata.file_path")).alias("__path"), ident.cast("string").alias("__id"), F.coalesce(old, F.lit(False)).alias("__old"))
    columns = ",".join(schema.names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, path, n, new = None, hashlib.sha256(), None, 0, 0

        def row() -> pa.RecordBatch:
            values = (now[0].replace(".", "/"), now[1], columns, digest.hexdigest(), path, n, new)
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], names=names)

        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        names = ["leaf", "part", "columns", "ids_sha256", "path", "n_rows", "n_new"]
        for batch in batches:
            held = [batch.column(0).to_pylist(), batch.column(1).to_pylist()]
            bounds = [0, *(i for i in range(1, batch.num_rows) if held[0][i] != held[0][i - 1] or held[1][i] != held[1][i - 1]), batch.num_rows]
            for lo, hi in zip(bounds, bounds[1:]):
                if lo == hi:
                    continue
                key = (held[0][lo], held[1][lo])
                if key != now:
                    if now is not None:
                        yield row()
                    now, digest, path, n, new = key, hashlib.sha256(), None, 0, 0
                if n:
                    digest.update(b",")
                some = batch.slice(lo, hi - lo)
                digest.update(",".join(x or "" for x in some.column(4).to_pylist()).encode())
                path = path or next((p for p in some.column(3).slice(0, 1).to_pylist() if p), None)
                n, new = n + hi - lo, new + some.column(5).to_pylist().count(False)
        if now is not None:
            yield row()

    found = rows.repartition("__leaf", "__part").sortWithinPartitions("__leaf", "__part", "__row").mapInArrow(hashed, "leaf string, part bigint, columns string, ids_sha256 string, path string, n_rows bigint, n_new bigint")
    kept = spark.createDataFrame([(a, b, False) for a, b in sorted(stayed)], "leaf string, part bigint, rewritten boolean")
    return found.join(F.broadcast(kept), ["leaf", "part"], "left").withColumn("rewritten", F.coalesce("rewritten", F.lit(True)))


def rewrite_by_time(df: DataFrame, *, moment: Column, arrived: Column, ident: Column, old: Column, limit: int, folder: str | None = None) -> DataFrame:
    """Writes the rows that are ``old`` into a new folder in leaves of time, then rewrites the folder for all rows.

    A leaf is a run of neighbouring years, months, days or hours of at most ``limit`` rows in all, an hour above it, or
    all null moments (text ``null``). Its rows by moment, arrival and id (nulls first, then by a hash of all columns) fill
    Parquet files of ``limit`` rows. Files whose leaf, part and rows are the same in both layouts stay as they are, others
    are written and the outdated ones removed after that; no other data files remain.

    Returns a row for each file: leaf, part (from 1), columns, ids_sha256, path, n_rows, n_new (rows that are not old) and
    rewritten. Null times and ids are rows like any other, and repeated rows count each. A column of the table may be
    called leaf or part. An empty table gives no file and no row. Years are those from 1 to 9999. ``folder`` must not
    exist; without one it is a new one in the shared folder, and stays there.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_dir(spark)}/time-{uuid.uuid4().hex}"
    rows = staged(df, moment, arrived, ident, old)
    before = rows.where("__old")
    layout = plan(before, limit)
    write_files(before, layout, folder)
    start, had = listed(spark, folder), digests(before, layout)
    layout = plan(rows, limit)
    have = digests(rows, layout)
    stayed = {k for k, v in have.items() if had.get(k) == v}
    if len(stayed) < len(have):
        write_files(rows, layout, folder, set(have) - stayed)
    removed(spark, [p for k, paths in start.items() if k not in stayed for p in paths])
    return report(spark, folder, df.schema, ident, old, stayed)
