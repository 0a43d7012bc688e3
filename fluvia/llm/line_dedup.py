"""Line dedup with two Bloom filters, for once-seen and twice-seen line hashes.

Pass 1 turns each document's distinct keys into filter bits. Tasks ship bit positions by filter segment; the owner of a
segment folds them into its part of both filters: a bit seen again moves from "once" to "twice". Pass 2 reads the
documents again and lets only keys whose bits are all in the "twice" filter shuffle; those are confirmed exactly, by the
key itself, and the smallest doc_id of each repeated key keeps its lines. A false positive costs a shuffled row, never a
result. The filter is sized from the input and at most ``max_filter_bits`` bits (32 MB), which bounds what is broadcast;
beyond its capacity more keys are suspected, up to all of them. A third filter, of the documents that lose lines, keeps all
others where they are: only those it holds shuffle to meet their keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvia.session import materialize, slices

WHITE = b" \t\n\x0b\x0c\r"
SEGMENT_BITS = 20
HASHES = 2
FLUSH = 1 << 20


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line stripped of ASCII white space and with A-Z lower-cased; None if it has fewer than min_chars code points."""
    key = line.strip(WHITE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return key


def document_keys(text: str, min_chars: int) -> set[bytes]:
    keys = {line_key(x, min_chars) for x in text.encode().split(b"\n")}
    keys.discard(None)
    return keys


def bit_positions(key: bytes, mask: int) -> tuple[int, ...]:
    """HASHES different positions, so that one key alone never reaches the second filter."""
    digest = xxhash.xxh3_128_intdigest(key)
    first = digest & mask
    step = (digest >> 64) & mask | 1
    return tuple((first + i * step) & mask for i in range(HASHES))


def filter_bits(df: DataFrame, max_filter_bits: int) -> int:
    """About 16 bits for each 64 bytes of the estimated input, a power of two within [one segment, max_filter_bits]."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = max(1, size // 4)
    return 1 << max(SEGMENT_BITS, min(max_filter_bits.bit_length() - 1, wanted.bit_length()))


def _emit(positions: list[int]) -> Iterator[pa.RecordBatch]:
    """One row for each segment touched: positions seen, and those of them seen more than once here."""
    seen, counts = np.unique(np.array(positions, dtype=np.uint32), return_counts=True)
    segments = seen >> SEGMENT_BITS
    bounds = np.flatnonzero(np.diff(segments, prepend=np.uint32(0xFFFFFFFF)))
    inside = (seen & np.uint32((1 << SEGMENT_BITS) - 1)).astype("<u4")
    rows: list[tuple[int, bytes, bytes]] = []
    for lo, hi in zip(bounds, [*bounds[1:], len(seen)], strict=True):
        part = inside[lo:hi]
        rows.append((int(segments[lo]), part.tobytes(), part[counts[lo:hi] > 1].tobytes()))
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
        names=["segment", "once", "twice"],
    )


def twice_filter(docs: DataFrame, id_col: str, text_col: str, min_chars: int, bits: int) -> bytes:
    """The "twice" filter over all documents: bits that two or more insertions hit."""
    mask = bits - 1

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                for key in document_keys(text, min_chars):
                    held.extend(bit_positions(key, mask))
                if len(held) > FLUSH:
                    yield from _emit(held)
                    held = []
        if held:
            yield from _emit(held)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, new, again in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if segment not in once:
                    once[segment] = np.zeros(1 << SEGMENT_BITS, dtype=bool)
                    twice[segment] = np.zeros(1 << SEGMENT_BITS, dtype=bool)
                a = np.frombuffer(new, dtype="<u4")
                twice[segment][a[once[segment][a]]] = True
                twice[segment][np.frombuffer(again, dtype="<u4")] = True
                once[segment][a] = True
        for segment, found in twice.items():
            packed = np.packbits(found, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([packed], pa.binary())], names=["segment", "bits"])

    source = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    parts = source.mapInArrow(positions, "segment int, once binary, twice binary").repartition("segment").mapInArrow(fold, "segment int, bits binary")
    whole = bytearray(bits // 8)
    width = (1 << SEGMENT_BITS) // 8
    for row in parts.toLocalIterator():  # at most bits / 8 bytes in all
        whole[row["segment"] * width : (row["segment"] + 1) * width] = row["bits"]
    return bytes(whole)


def suspects(docs: DataFrame, id_col: str, text_col: str, min_chars: int, bits: int, found: bytes) -> DataFrame:
    """(doc, key) of the keys that the filter has seen twice."""
    mask = bits - 1
    shared = docs.sparkSession.sparkContext.broadcast(found)
    id_type = docs.schema[id_col].dataType

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in slices(batches):
            rows: list[int] = []
            keys: list[bytes] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for key in document_keys(text, min_chars):
                    if all(held[p >> 3] >> (p & 7) & 1 for p in bit_positions(key, mask)):
                        rows.append(i)
                        keys.append(key)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([k.decode() for k in keys], pa.string())], names=["doc", "key"])

    source = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return source.mapInArrow(probe, T.StructType([T.StructField("doc", id_type), T.StructField("key", T.StringType())]))


def id_filter(ids: DataFrame, bits: int) -> bytes:
    """A Bloom filter of the hashes of ids, a power of two of bits; the driver gets the filter's segments, bits / 8 bytes."""

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _emit(np.concatenate(hash_positions(batch.column(0).to_numpy(), bits)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, new in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                held.setdefault(segment, np.zeros(1 << SEGMENT_BITS, dtype=bool))[np.frombuffer(new, dtype="<u4")] = True
        for segment, found in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(found, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

    parts = ids.select(F.xxhash64(ids.columns[0])).mapInArrow(positions, "segment int, once binary, twice binary").repartition("segment").mapInArrow(fold, "segment int, bits binary")
    whole, width = bytearray(bits // 8), (1 << SEGMENT_BITS) // 8
    for row in parts.toLocalIterator():
        whole[row["segment"] * width : (row["segment"] + 1) * width] = row["bits"]
    return bytes(whole)


def hash_positions(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """HASHES positions of 64-bit hashes, from different bits of them."""
    h = hashes.view(np.uint64)
    return [((h >> np.uint64(32 * i)) & np.uint64(bits - 1)).astype(np.uint32) for i in range(HASHES)]


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, max_filter_bits: int = 1 << 28) -> DataFrame:
    """Drops repeated lines from every document but the first that holds them.

    A line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased. Keys of at least ``min_chars``
    code points that at least two documents hold lose all their lines except in the smallest id holding them.
    Returns the input's columns with ``text_col`` replaced, plus ``n_lines`` (before) and ``n_dropped``.

    Null or empty text counts as one empty line, and comes back as empty text. Rows of equal id are one document: each
    row is treated alike, and a key that only they hold is not repeated. A row with a null id takes no part: its lines
    all stay and count for no other document. Extra columns pass through; ones called n_lines or n_dropped are replaced.
    An empty table gives an empty result.
    """
    docs = docs.drop(*({"n_lines", "n_dropped"} - {id_col, text_col}))
    bits = filter_bits(docs.select(id_col, text_col), max_filter_bits)
    found = twice_filter(docs, id_col, text_col, min_chars, bits)
    pairs = materialize(suspects(docs, id_col, text_col, min_chars, bits, found), "line-suspects")
    # written, so that the join below has plain shuffles on both sides, of which adaptive execution splits a hot key's
    repeated = materialize(pairs.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last").select("key", "first"), "repeated-lines")
    losing = materialize(pairs.join(repeated, "key").where("doc > first").groupBy("doc").agg(F.collect_set("key").alias("__drop")), "losing-documents")
    # only documents that may lose a line meet their keys; all others stay where they are
    size = 1 << max(SEGMENT_BITS, min(max_filter_bits.bit_length() - 1, (16 * losing.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(losing.select("doc"), size))

    @F.pandas_udf("boolean")
    def may_lose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = np.frombuffer(shared.value, dtype=np.uint8)
        for hashes in batches:
            found = [held[p >> 3] >> (p & 7) & 1 for p in hash_positions(hashes.to_numpy(), size)]
            yield pd.Series(np.logical_and.reduce(found).astype(bool))

    some = F.col(id_col).isNotNull() & may_lose(F.xxhash64(id_col))
    meeting = docs.where(some).join(losing.withColumnRenamed("doc", "__doc"), F.col(id_col) == F.col("__doc"), "left").drop("__doc")
    joined = meeting.unionByName(docs.where(~some).withColumn("__drop", F.lit(None).cast("array<string>")))

    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    at = docs.columns.index(text_col)

    def drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = batch.columns[:-1]
            texts: list[str] = []
            before: list[int] = []
            dropped: list[int] = []
            for text, drop in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                text = text or ""
                n = text.count("\n") + 1
                lost = 0
                if drop:
                    keys = {k.encode() for k in drop}
                    kept = [x for x in text.encode().split(b"\n") if x.strip(WHITE).lower() not in keys]
                    lost = n - len(kept)
                    text = b"\n".join(kept).decode()
                texts.append(text)
                before.append(n)
                dropped.append(lost)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], names=[f.name for f in fields])

    return joined.mapInArrow(drop_lines, T.StructType(fields))
