"""Best-fit packing of token pieces into fixed-length sequences, by patterns.

The histogram of piece lengths (one count for each length up to the sequence length, whatever the corpus size) is all
that the plan needs. Patterns of two or three lengths that fill a sequence exactly are enumerated; non-negative least
squares fits how often each repeats; the rounded counts are taken while the histogram lasts, and best-fit decreasing
packs the rest of the histogram, by length and count. Pieces then find their places by their number among the pieces of
their length, which two-level counting gives without gathering a length in one task.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenizers import Tokenizer

from fluvia.llm.bpe import BEYOND, WORD_PATTERN, read_spec, unsettled, vocabulary
from fluvia.session import materialize, slices

#: (lengths, most first; how many sequences have them)
Pattern = tuple[tuple[int, ...], int]


def patterns(counts: np.ndarray, size: int, most: int) -> np.ndarray:
    """Pairs and triples of lengths in the histogram that fill a sequence, padded with 0; the ``most`` likeliest ones.

    A pattern is as likely as its rarest length is frequent.
    """
    present = np.flatnonzero(counts[:size])
    present = present[present > 0]
    found = [np.empty((0, 3), dtype=np.int64)]
    other = size - present
    pairs = (counts[other] > 0) & (present >= other)
    found.append(np.stack([present[pairs], other[pairs], np.zeros(pairs.sum(), dtype=np.int64)], axis=1))
    for c in present[present <= size // 3]:
        b = present[(present >= c) & (present <= (size - c) // 2)]
        a = size - c - b
        fits = counts[a] > 0
        found.append(np.stack([a[fits], b[fits], np.full(fits.sum(), c)], axis=1))
    every = np.concatenate(found)
    if len(every) > most:
        weight = np.where(every > 0, counts[every], counts.max()).min(axis=1)
        every = every[np.sort(np.argsort(-weight, kind="stable")[:most])]
    return every


def fit(columns: np.ndarray, counts: np.ndarray, size: int, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares: repeats x >= 0 of each pattern that bring the lengths used near to the histogram.

    Accelerated projected gradient; a pattern has at most three entries, so both products are gathers and bincounts.
    """
    if not len(columns):
        return np.zeros(0)
    target = counts[: size + 1].astype(float)
    target[0] = 0
    scale = max(1.0, target.max())
    target /= scale

    def used(x: np.ndarray) -> np.ndarray:
        out = np.bincount(columns.ravel(), weights=np.repeat(x, columns.shape[1]), minlength=size + 1)
        out[0] = 0
        return out

    def pulled(r: np.ndarray) -> np.ndarray:
        return r[columns].sum(axis=1)

    x = np.random.default_rng(0).random(len(columns))
    norm = 1.0
    for _ in range(20):  # the largest eigenvalue, for the step
        x = pulled(used(x))
        norm = float(np.linalg.norm(x)) or 1.0
        x /= norm
    step = 1 / (1.05 * norm)
    x = np.zeros(len(columns))
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * pulled(used(y) - target))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x * scale


def best_fit(left: np.ndarray, size: int) -> list[Pattern]:
    """Best-fit decreasing on counts: lengths from the largest, each into the fullest open sequences that have room."""
    rooms: dict[int, list[list]] = {}
    order: list[int] = []
    done: list[Pattern] = []

    def put(lengths: tuple[int, ...], room: int, many: int) -> None:
        if not room:
            done.append((lengths, many))
            return
        if room not in rooms:
            rooms[room] = []
            bisect.insort(order, room)
        rooms[room].append([lengths, many])

    for length in range(size, 0, -1):
        many = int(left[length])
        while many:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                fits = size // length
                whole, rest = divmod(many, fits)
                if whole:
                    put((length,) * fits, size - fits * length, whole)
                if rest:
                    put((length,) * rest, size - rest * length, 1)
                break
            room = order[at]
            group = rooms[room][-1]
            fits = min(room // length, many)
            take = min(many // fits, group[1])
            if take == group[1]:
                rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
            else:
                group[1] -= take
            put(group[0] + (length,) * fits, room - fits * length, take)
            many -= take * fits
    return done + [(lengths, many) for groups in rooms.values() for lengths, many in groups]


def plan(counts: np.ndarray, size: int, most_patterns: int = 20_000) -> list[Pattern]:
    """Patterns and their repeats that use up the histogram of lengths (index = length)."""
    left = counts.copy()
    out: list[Pattern] = []
    if left[size]:
        out.append(((size,), int(left[size])))
        left[size] = 0
    columns = patterns(left, size, most_patterns)
    repeats = fit(columns, left, size)
    for i in np.argsort(-repeats, kind="stable"):
        many = int(repeats[i])
        if not many:
            break
        lengths, uses = np.unique(columns[i][columns[i] > 0], return_counts=True)
        many = min(many, int((left[lengths] // uses).min()))
        if many:
            left[lengths] -= uses * many
            out.append((tuple(int(x) for x in sorted(columns[i], reverse=True) if x), many))
    return out + best_fit(left, size)


@dataclass
class Places:
    """For each length, where its pieces go, by their number among the pieces of that length."""

    first: dict[int, np.ndarray]
    base: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    uses: dict[int, np.ndarray]

    def find(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece."""
        sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            entry = np.searchsorted(self.first[length], numbers[at], side="right") - 1
            repeat, copy = np.divmod(numbers[at] - self.first[length][entry], self.uses[length][entry])
            sequence[at] = self.base[length][entry] + repeat
            offset[at] = self.offset[length][entry] + copy * length
        return sequence, offset


def places(planned: list[Pattern]) -> Places:
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for lengths, many in planned:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            uses = lengths.count(length)
            rows.setdefault(length, []).append((taken.get(length, 0), base, offset, uses))
            taken[length] = taken.get(length, 0) + uses * many
            offset += uses * length
        base += many
    columns = {n: np.array(r, dtype=np.int64).T for n, r in rows.items()}
    return Places(*({n: c[i] for n, c in columns.items()} for i in range(4)))


_encoders: dict[bytes, Callable[[str], np.ndarray]] = {}
#: A run of white space that the fast library's pattern engine may not get through; only a run's start is tried.
LONG_SPACE = re.compile(r"(?<!\s)\s{10000}")


def encoder(spec: bytes) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids, equal to the tokenizers library's (the tests hold both against each other).

    tiktoken runs the same model faster. It gives up on very long runs of white space, and may class characters that are
    not assigned yet in another way, so texts with either go to the tokenizers library itself, as a whole.
    """
    if spec not in _encoders:
        bytes_of, specials = vocabulary(json.loads(spec))
        ranks = {word: i for i, word in enumerate(bytes_of) if word and i not in specials.values()}
        fast = tiktoken.Encoding("packing", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens=specials)

        @cache
        def exact() -> Tokenizer:
            made = Tokenizer.from_str(spec.decode())
            made.no_truncation()
            made.no_padding()
            return made

        def encode(text: str) -> np.ndarray:
            if LONG_SPACE.search(text) or not text.isascii() and BEYOND.search(text) and unsettled().search(text):
                return np.array(exact().encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            return fast.encode_to_numpy(text, allowed_special="all")

        _encoders[spec] = encode
    return _encoders[spec]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences, behind a shorter first piece where n is no multiple."""
    first = n % size
    return ([(0, first)] if first else []) + [(at, size) for at in range(first, n, size)]


def pieces(docs: DataFrame, *, keep: list[str], text_col: str = "text", size: int = 2048, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """The kept columns and each document's pieces: piece, start, length, ids_crc32, ids (binary) if asked for, __uid."""
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    more = ["ids"] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value)
        end = np.array([end_id], dtype="<u4")
        uid = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            rows, spans, sums, ids = [], [], [], []
            for i, text in enumerate(batch.column(0).to_pylist()):
                found = np.concatenate([encode(text or ""), end]).astype("<u4").tobytes()
                for number, (start, length) in enumerate(cut(len(found) // 4, size)):
                    part = found[4 * start : 4 * (start + length)]
                    rows.append(i)
                    spans.append((number, start, length))
                    sums.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            index = pa.array(rows, pa.int64())
            number, start, length = np.array(spans, dtype=np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [*(c.take(index) for c in batch.columns[1:]), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), *([pa.array(ids, pa.binary())] if with_ids else []), pa.array(uid + np.arange(len(rows)))],
                names=[*keep, "piece", "start", "length", "ids_crc32", *more, "__uid"],
            )
            uid += len(rows)

    fields = [docs.schema[c] for c in keep] + [T.StructField("piece", T.IntegerType())] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids + [T.StructField("__uid", T.LongType())]
    return docs.select(docs[text_col].cast("string").alias("__text"), *keep).mapInArrow(run, T.StructType(fields))


OWN = ("piece", "start", "length", "ids_crc32", "ids", "__uid", "sequence_id", "offset")


def pack(docs: DataFrame, *, keep: list[str] | None = None, text_col: str = "text", size: int = 2048, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = False, most_patterns: int = 20_000) -> DataFrame:
    """Packs all documents into as few sequences of at most ``size`` tokens as the plan finds; one row for each piece.

    A document is its ids by the tokenizer, then ``end_id``. Only longer ones than ``size`` are cut, into whole sequences
    behind a first piece that may be shorter. Returns the kept columns (all but the text by default), piece (from 0),
    start, length, ids_crc32, sequence_id, offset (gapless from 0 within a sequence) and, ``with_ids``, the ids as
    little-endian 32-bit numbers. Null text is an empty document: just ``end_id``. Repeated rows are packed each. Input
    columns named like an output are left out. An empty table gives an empty result.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in OWN and c != text_col]
    cutup = materialize(pieces(docs, keep=keep, text_col=text_col, size=size, end_id=end_id, tokenizer=tokenizer, with_ids=with_ids), "pieces")
    buckets = cutup.groupBy("length", F.shiftright("__uid", 33).alias("__bucket")).count()
    counts = np.zeros(size + 1, dtype=np.int64)
    for row in buckets.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most ``size`` rows
        counts[row["length"]] = row["n"]
    shared = docs.sparkSession.sparkContext.broadcast(places(plan(counts, size, most_patterns)))

    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = buckets.select("length", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    numbered = cutup.withColumn("__bucket", F.shiftright("__uid", 33)).join(firsts, ["length", "__bucket"])
    within = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy("__uid"))
    columns = [*keep, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    numbered = numbered.select(*columns, (F.col("__first") + within - 1).alias("__number"))
    at = len(columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value.find(batch.column(columns.index("length")).to_numpy(), batch.column(at).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return numbered.mapInArrow(place, T.StructType([*(numbered.schema[c] for c in columns), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids binary) of pieces packed ``with_ids``; a sequence is bounded, so gathering it is too.

    Every piece has ids, even that of a null or empty text (its end token), so no sequence has a gap; an empty table
    gives an empty result; other columns are left out, whatever their names.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(parts, lambda p: p["ids"]), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
