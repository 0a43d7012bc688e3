"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a key's hash. A bucket over its byte limit splits on one more bit, and
only such buckets do; so a row's shard is the shortest prefix of its hash whose rows fit the limit. Sizes are summed by
prefix on the cluster and the directory is a table, never gathered on the driver. Equal keys cannot be told apart by
bits: where the rows of one whole hash exceed the limit, they go to overflow pages, which keep the limit too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.session import materialize

BITS = 60
OWN = ("shard_depth", "shard_prefix", "shard_page", "shard_bytes")


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text; null hashes as a text that no number has."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(bits: Column | str, depth: Column) -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    return F.call_function("shiftright", bits, F.lit(BITS) - depth)


def directory(hashed: DataFrame, max_bytes: int, base: int, upto: int) -> DataFrame:
    """(cell, depth, prefix, total) of each cell of ``upto`` bits: the shortest prefix of base bits or more that fits.

    depth is null where the cell itself is too large.
    """
    cells = hashed.groupBy(_prefix("h", F.lit(upto)).alias("cell")).agg(F.sum("bytes").alias("bytes"))
    spread = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(base), F.lit(upto))).alias("depth"))
    spread = spread.withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(upto) - F.col("depth")))
    fits = spread.groupBy("depth", "prefix").agg(F.sum("bytes").alias("total"), F.min("cell").alias("low"), F.max("cell").alias("high"))
    # of a prefix that fits, only those whose parent does not are shards; the first round's root has no parent
    parents = fits.select((F.col("depth") + 1).alias("depth"), "prefix", F.col("total").alias("above"))
    shards = fits.where(F.col("total") <= max_bytes).join(parents.withColumnRenamed("prefix", "parent"), (fits["depth"] == parents["depth"]) & (F.call_function("shiftright", fits["prefix"], F.lit(1)) == F.col("parent")), "left")
    shards = shards.where(F.col("above").isNull() | (F.col("above") > max_bytes)).select(fits["depth"].alias("depth"), fits["prefix"].alias("prefix"), "total")
    found = cells.select("cell", F.explode(F.sequence(F.lit(base), F.lit(upto))).alias("depth")).withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(upto) - F.col("depth"))).join(shards, ["depth", "prefix"])
    return cells.select("cell").join(found, "cell", "left").select("cell", "depth", "prefix", "total")


def overflow(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Pages of at most max_bytes for the rows of one hash; a row of over half the limit has a page of its own.

    The others go by their place in a running sum, half a limit for each page, so that one that reaches over still fits.
    The sum has two levels: within a written partition, and over the partitions of a hash.
    """
    rows = materialize(rows.withColumn("__at", F.monotonically_increasing_id()), "overflow").withColumn("__part", F.shiftright("__at", 33))
    half = max_bytes // 2
    small = F.when(F.col("bytes") <= half, F.col("bytes")).otherwise(0)
    large = (F.col("bytes") > half).cast("long")
    sums = rows.groupBy("h", "__part").agg(F.sum(small).alias("s"), F.sum(large).alias("l"))
    before = Window.partitionBy("h").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("h")
    sums = sums.select("h", "__part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("l").over(before), F.lit(0)).alias("l0"), F.sum("s").over(whole).alias("s_all"))
    inside = Window.partitionBy("h", "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("s0") + F.coalesce(F.sum(small).over(inside), F.lit(0))
    number = F.col("l0") + F.coalesce(F.sum(large).over(inside), F.lit(0))
    joined = rows.join(sums, ["h", "__part"])
    page = F.when(large == 1, F.expr(f"s_all div {max(1, half)}") + 1 + number).otherwise(F.floor(start / max(1, half)))
    paged = joined.withColumn("shard_page", page.cast("long"))
    totals = paged.groupBy(F.col("h").alias("__h"), F.col("shard_page").alias("__page")).agg(F.sum("bytes").alias("shard_bytes"))
    out = paged.join(totals, (F.col("h") == F.col("__h")) & (F.col("shard_page") == F.col("__page")))
    return out.withColumn("shard_depth", F.lit(BITS)).withColumn("shard_prefix", F.col("h")).drop("__h", "__page", "__part", "__at", "s0", "l0", "s_all")


def extendible_shards(df: DataFrame, *, key_col: str = "doc_id", size: Column | None = None, max_bytes: int = 64 << 20, step_bits: int = 6) -> DataFrame:
    """The input's columns and each row's shard: shard_depth and shard_prefix (bits), shard_page, shard_bytes.

    ``size`` is a row's bytes (the UTF-8 length of ``text`` by default; null counts 0). Every shard holds at most
    ``max_bytes``, but for a row that is larger alone. shard_page is 0 unless the rows of one hash need several shards.
    Null keys hash alike; repeated rows stay together while they fit. Empty tables give empty results; input columns
    named like an output are replaced.
    """
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) if size is None else size
    df = df.drop(*(set(OWN) - {key_col}))
    # the input's columns travel as one, so that their names cannot clash
    rows = df.select(F.struct("*").alias("__row"), key_hash(F.col(key_col)).alias("h"), F.coalesce(size.cast("long"), F.lit(0)).alias("bytes"))
    keep = ["__row"]
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    base, upto = 0, min(BITS, max(1, total // max_bytes).bit_length() + step_bits)
    done: DataFrame | None = None
    while True:
        found = materialize(directory(rows.select("h", "bytes"), max_bytes, base, upto), "directory")
        placed = rows.withColumn("cell", _prefix("h", F.lit(upto))).join(found, "cell")
        part = placed.where("depth is not null").select(*keep, F.col("depth").alias("shard_depth"), F.col("prefix").alias("shard_prefix"), F.lit(0).cast("long").alias("shard_page"), F.col("total").alias("shard_bytes"))
        done = part if done is None else done.union(part)
        if found.where("depth is null").isEmpty():
            break
        rows = materialize(placed.where("depth is null").select(*keep, "h", "bytes"), "oversized")
        if upto == BITS:
            done = done.union(overflow(rows, max_bytes).select(*keep, "shard_depth", "shard_prefix", "shard_page", "shard_bytes"))
            break
        base, upto = upto + 1, min(BITS, upto + 1 + 3 * step_bits)
    return done.select("__row.*", *OWN)


def write_shards(sharded: DataFrame, folder: str, *, size: Column, max_bytes: int) -> DataFrame:
    """Writes each shard as a folder of its own and returns shard_depth, shard_prefix, shard_page, n_rows, n_bytes as read back.

    ``size`` is a row's bytes, as given to ``extendible_shards``; null counts 0. Raises if a shard of several rows is over
    ``max_bytes``. An empty table writes nothing and returns no rows.
    """
    keys = OWN[:3]
    sharded.withColumn("__bytes", F.coalesce(size.cast("long"), F.lit(0))).repartition(*keys).write.partitionBy(*keys).parquet(folder)
    if sharded.isEmpty():
        return sharded.sparkSession.createDataFrame([], "shard_depth int, shard_prefix bigint, shard_page bigint, n_rows bigint, n_bytes bigint")
    found = sharded.sparkSession.read.parquet(folder).groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum("__bytes").alias("n_bytes"))
    found = found.select(F.col("shard_depth").cast("int"), F.col("shard_prefix").cast("long"), F.col("shard_page").cast("long"), "n_rows", "n_bytes")
    large = found.where((F.col("n_bytes") > max_bytes) & (F.col("n_rows") > 1)).limit(1).collect()
    if large:
        raise ValueError(f"a shard is over {max_bytes} bytes: {large[0]}")
    return found
