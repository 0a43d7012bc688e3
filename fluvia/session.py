"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that a worker takes of a batch at a time.
SLICE_ROWS = 1000


def session(app: str = "fluvia", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the library expects (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(max(8, os.cpu_count() or 8)))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary one (tests); on a cluster executors could not see it, so that
    raises. What is written here stays.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        known = context._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if folder is None:
            folder = tempfile.mkdtemp(prefix="fluvia-")
            context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """A subfolder of the shared folder for the tables of this run, which goes when the driver's Python ends."""
    context = spark.sparkContext
    own = f"{shared_dir(spark)}/fluvia-{context.applicationId}"
    if getattr(context, "_fluvia_scratch", None) != own:
        context._fluvia_scratch = own
        atexit.register(clean, spark, own)
    return own


def clean(spark: SparkSession, folder: str | None = None) -> None:
    """Removes the scratch tables of this application; what was read from them and not yet written is lost."""
    context = spark.sparkContext
    folder = folder or getattr(context, "_fluvia_scratch", None)
    if folder and context._jsc is not None and not context._jsc.sc().isStopped():
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def count_parts(df: DataFrame, each: int) -> int:
    """How many times the input has those bytes (as Catalyst estimates it); as many as there are cores at least, 4,096 at most.

    Of rows that come from no table Catalyst knows no size: those have the session's number of partitions.
    """
    spark = df.sparkSession
    size, cores = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), spark.sparkContext.defaultParallelism
    return min(max(cores, -(-size // each)), 4096) if size < 1 << 60 else max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores)


def unsorted_parts(df: DataFrame, least: int, most: int) -> int:
    """How many parts of the input's rows to shuffle into: of ``least`` bytes each, but, as long as they stay within ``most``, no
    more than Spark writes without sorting (``spark.shuffle.sort.bypassMergeThreshold``).

    Beyond that number a task that writes holds the rows of its whole split, and spills them where that is more than its memory.
    """
    unsorted = int(df.sparkSession.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return max(min(count_parts(df, least), unsorted), count_parts(df, most))


def spread(df: DataFrame, *keys: str, each: int | None = None) -> DataFrame:
    """Rows dealt evenly over the session's tasks: few bytes, which one task would read, but each with much work to come.

    With ``each``, over ``count_parts`` of the input, so that a task's memory does not grow with it. Adaptive execution
    doesn't put these parts together again, as it does with those of a shuffle of its own.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores) if each is None else count_parts(df, each), *keys)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, without a copy: what a worker makes of one is small, and goes before the next.

    Spark's batches have up to 10,000 rows, so that texts, their vectors and what comes back would be held for all of them.
    """
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each context, so that their Python workers can import it."""
    context = spark.sparkContext
    if not getattr(context, "_fluvia_shipped", False):
        package = Path(__file__).parent
        target = os.path.join(tempfile.mkdtemp(prefix="fluvia-"), "fluvia.zip")
        with zipfile.ZipFile(target, "w") as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, Path("fluvia") / file.relative_to(package))
        context.addPyFile(target)
        context._fluvia_shipped = True
    return spark
