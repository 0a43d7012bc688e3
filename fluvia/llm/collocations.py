"""Phrase collocations by depth-limited count tries.

Each task counts, for every word of its documents, the path of that word and the two after it within a piece: a trie of
depth three, held as sorted packed paths of word numbers. A full trie is serialised sorted by its words, in chunks cut at
the bounds of prefix ranges. Each range is one task's, which merges the chunks of all tries in the order of their first
paths, so that only the chunks that overlap are held. It settles what lies before the next chunk when it holds twice what
the last time left, so that the work follows the rows however many chunks overlap. Sums of hashes find what is surely
rare; only the rest is sorted. Frequent nodes get their left parts, which are their ancestors; the few ancestors that a
bound or a settlement cuts through come as parts of their counts and are summed afterwards. Right parts are suffix links:
a node's phrase without its first word is itself a node, found by a join level by level.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.session import materialize

DEPTH = 3
WORD_BITS = 21
MASK = (1 << WORD_BITS) - 1
#: No byte of UTF-8; stands for the end of a piece.
END = b"\xff"
_TABLE = bytes(END[0] if i in b".,;:!?\n\x0b\x0c\r" else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Bytes of a text that are cut off at once; of texts that wait to be split; words of a task's tries, and different ones of a
#: trie, after which they are written.
BLOCK, BUFFER, FULL, VOCABULARY = 1 << 20, 1 << 20, 3 << 20, 1 << 20
#: Paths of a chunk; rows that a merge gathers before it sums them; most bits of the hashes by which it finds what is rare.
CHUNK, GATHER, HASH_BITS = 1 << 14, 1 << 18, 22
RANGE_BYTES, MOST_RANGES = 8 << 20, 4096
#: Parts of a language's phrases that are ranked by themselves.
SHARES = 64

Path = tuple[bytes, bytes, bytes]
_STOP = re.compile(b"[ \xff]")


def blocks(data: bytes) -> Iterator[bytes]:
    """Translated data in blocks of about BLOCK bytes, cut between words."""
    lo = 0
    while len(data) - lo > BLOCK and (stop := _STOP.search(data, lo + BLOCK)):
        yield data[lo : stop.start()]
        lo = stop.start()
    yield data[lo:]


def split(block: bytes) -> pa.Array:
    """The words of a block, with END where a piece ends and empty ones where spaces meet."""
    return pc.split_pattern(pa.array([block.replace(END, b" \xff ")], pa.binary()), b" ").flatten()


def listed(words: pa.Array) -> list[bytes]:
    """Words, none of which holds a line end, as a list (at a tenth of the time that to_pylist takes)."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b"\n")
    return joined[0].as_py().split(b"\n") if len(words) else []


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists, with END where a piece ends."""
    for block in blocks(text.translate(_TABLE)):
        yield [w for w in listed(split(block)) if w]


class Trie:
    """The words of one language's documents, of which ``sorted`` makes the counts of all paths of three words.

    Paths at the end of a piece are shorter. The words are held as numbers, with a dictionary for each block.
    """

    def __init__(self) -> None:
        self.last: list[bytes] = []
        self.clear()

    def clear(self) -> None:
        """Begins anew with the last two words, which the next ones may go on."""
        self.texts: list[bytes] = []
        self.waiting = 0
        self.words: list[pa.DictionaryArray] = []
        self.size = self.different = 0
        self.add(self.last)

    def put(self, block: bytes) -> None:
        """Adds translated text."""
        self.texts.append(block)
        self.waiting += len(block)
        if self.waiting > BUFFER:
            self.close()

    def add(self, words: list[bytes] | pa.Array) -> None:
        if len(words):
            self.words.append((words if isinstance(words, pa.Array) else pa.array(words, pa.binary())).dictionary_encode())
            self.size += len(words)
            self.different += len(self.words[-1].dictionary)

    def close(self) -> None:
        """Splits what waits."""
        if self.texts:
            self.add(split(b"".join(self.texts)))
            self.texts, self.waiting = [], 0

    def sorted(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(words in order, after the empty one for an end; paths by these words' places, sorted; their counts).

        The last two words begin no path yet.
        """
        parts = pa.chunked_array(self.words, pa.dictionary(pa.int32(), pa.binary())).unify_dictionaries().chunks
        words = parts[0].dictionary if parts else pa.array([], pa.binary())
        order = pc.array_sort_indices(words).to_numpy()
        names = listed(words.take(pa.array(order)))
        blank = names[:1] == [b""]
        place = np.empty(len(names), dtype=np.int64)
        place[order] = np.arange(len(names)) + (not blank)
        n = place[np.concatenate([x.indices.to_numpy() for x in parts])] if parts else place
        if blank:
            n = n[n > 0]
        names = [b"", *names[blank:]]
        if names[-1] == END:
            n[n == len(names) - 1] = 0
            names.pop()
        self.last = [names[i] or END for i in n[-2:].tolist()]
        first, second, third = n[:-2], n[1:-1], n[2:]
        paths = ((first << 2 * WORD_BITS) | (second << WORD_BITS) | np.where(second == 0, 0, third))[first > 0]
        paths.sort()
        starts = np.flatnonzero(np.diff(paths, prepend=-1))
        return names, paths[starts], np.diff(starts, append=len(paths))


def first_at(words: list[bytes] | pa.Array, bound: Path) -> int:
    """The least packed path that is not below the bound."""
    packed = 0
    value = (lambda x: x.as_py()) if isinstance(words, pa.Array) else (lambda x: x)
    for i, word in enumerate(bound):
        place = bisect.bisect_left(words, word, key=value)
        packed |= place << (DEPTH - 1 - i) * WORD_BITS
        if place == len(words) or value(words[place]) != word:
            break
    return packed


class Chunk(NamedTuple):
    """Sorted paths by the places of their words among the words in order; the first word is the empty one for an end."""

    words: pa.Array
    paths: np.ndarray
    counts: np.ndarray


def _narrow(numbers: np.ndarray) -> np.ndarray:
    return numbers.astype(np.min_scalar_type(numbers.max(initial=0)))


def pack(words: list[bytes] | pa.Array, paths: np.ndarray, counts: np.ndarray) -> bytes:
    """A chunk with the words it uses."""
    words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
    parts = np.stack([paths >> (DEPTH - 1 - i) * WORD_BITS & MASK for i in range(DEPTH)])
    used = np.zeros(len(words), dtype=bool)
    used[0] = used[parts] = True
    found = np.flatnonzero(used)
    place = np.empty(len(words), dtype=np.int32)
    place[found] = np.arange(len(found))
    own = words.take(pa.array(found))
    numbers = [_narrow(x) for x in (pc.binary_length(own).to_numpy(), place[parts], counts)]
    head = np.array([len(found), len(paths), *(x.itemsize for x in numbers)], dtype="<u4")
    text = own.buffers()[2].to_pybytes()[: int(numbers[0].sum(dtype=np.int64))]
    return zstandard.compress(b"".join([head.tobytes(), *(x.tobytes() for x in numbers), text]), 1)


def unpack(blob: bytes) -> Chunk:
    data = zstandard.decompress(blob)
    m, n, *widths = np.frombuffer(data, dtype="<u4", count=5).tolist()
    numbers, at = [], 20
    for size, width in zip((m, DEPTH * n, n), widths, strict=True):
        numbers.append(np.frombuffer(data, dtype=f"<u{width}", count=size, offset=at))
        at += size * width
    ends = np.concatenate([[0], np.cumsum(numbers[0], dtype=np.int32)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(ends), pa.py_buffer(data[at:])])
    first, second, third = numbers[1].reshape(DEPTH, n).astype(np.int64)
    return Chunk(words, (first << 2 * WORD_BITS) | (second << WORD_BITS) | third, numbers[2].copy())


def sample_bounds(docs: DataFrame, ranges: int, seed: int = 7) -> list[tuple[bytes, Path]]:
    """At most ranges - 1 sorted (lang, path) that part the paths about evenly.

    From about max(512, 2 x ranges) documents, of each every 16th path, 4,096 at most. They balance the ranges only.
    """
    wanted = max(512, 2 * ranges)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[bytes, ...]] = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w for part in words_of(text) for w in part] + [END, END]
                starts = [i for i in range(0, len(words) - 2, max(16, len(words) // 4096)) if words[i] != END]
                found += [(lang.encode(), words[i], *(words[i + 1 : i + 3] if words[i + 1] != END else (END, END))) for i in starts]
            columns = zip(*found, strict=True) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array([b"" if x == END else x for x in c], pa.binary()) for c in columns], names=["lang", "w1", "w2", "w3"])

    total = docs.count()
    some = docs.sample(fraction=min(1.0, wanted / max(total, 1)), seed=seed) if total > wanted else docs
    rows = some.mapInArrow(take, "lang binary, w1 binary, w2 binary, w3 binary").toPandas()
    found = sorted(zip(*(map(bytes, rows[c]) for c in rows.columns), strict=True))
    cuts = sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []
    return [(c[0], (c[1], c[2], c[3])) for c in cuts]


def serialised(docs: DataFrame, bounds: list[tuple[bytes, Path]]) -> DataFrame:
    """(range, lang, w1, w2, w3, chunk): chunks of the tasks' tries with their first paths; none reaches over a bound."""

    def cut(lang: str, trie: Trie) -> Iterator[tuple]:
        words, paths, counts = trie.sorted()
        name, held = lang.encode(), pa.array(words, pa.binary())
        lo, hi = bisect.bisect_left(bounds, (name,)), bisect.bisect_left(bounds, (name + b"\0",))
        edges = np.searchsorted(paths, [first_at(words, b[1]) for b in bounds[lo:hi]]).tolist()
        for i, (start, stop) in enumerate(zip([0, *edges], [*edges, len(paths)], strict=True)):
            for at in range(start, stop, CHUNK):
                some = slice(at, min(at + CHUNK, stop))
                head = [words[int(paths[at]) >> (DEPTH - 1 - j) * WORD_BITS & MASK] for j in range(DEPTH)]
                yield lo + i, lang, *head, pack(held, paths[some], counts[some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Trie] = {}

        def write() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            size = 0
            for lang, trie in tries.items():
                trie.close()
                for row in cut(lang, trie):
                    rows.append(row)
                    size += len(row[-1])
                    if size > BUFFER:
                        yield batch_of(rows)
                        rows, size = [], 0
                trie.clear()
            if rows:
                yield batch_of(rows)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        names = ["range", "lang", "w1", "w2", "w3", "chunk"]
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):  # one text after the other
                trie = tries.setdefault(lang.as_py(), Trie())
                for block in blocks(text.as_py().translate(_TABLE)):
                    trie.put(block)
                    if trie.different > VOCABULARY or sum(t.size for t in tries.values()) > FULL:
                        yield from write()
                trie.put(END + END)
                if len(tries) > 64:
                    yield from write()
                    tries.clear()
        yield from write()

    return docs.mapInArrow(run, "range int, lang string, w1 binary, w2 binary, w3 binary, chunk binary")


def _may_be(least: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a key may occur ``least`` times or more, by the sums of a hash: what is rare may pass, nothing else is lost."""
    bits = min(HASH_BITS, len(keys).bit_length() + 1)
    at, sums = np.empty(len(keys), dtype=np.int32), np.zeros(1 << bits, dtype=np.int64)
    for lo in range(0, len(keys), GATHER):  # piece by piece, for the sake of memory
        some = slice(lo, lo + GATHER)
        at[some] = keys[some].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)
        np.add.at(sums, at[some], counts[some])
    return (sums >= least)[at]


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the keys, where another one begins in it, its sum)."""
    order = np.argsort(keys)
    starts = np.flatnonzero(np.diff(keys[order], prepend=-1))
    return order, starts, np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]


class Merge:
    """Merges the chunks of one language and range in the order of their first paths."""

    def __init__(self, lang: str, edges: set[tuple], least: int) -> None:
        self.lang, self.edges, self.least = lang, edges, least
        self.waiting: list[Chunk] = []
        self.rows, self.limit = 0, GATHER
        #: Nodes through which the last ``settle`` cut.
        self.cut: set[tuple] = set()
        self.total = 0

    def add(self, chunk: Chunk) -> None:
        self.waiting.append(chunk)
        self.rows += len(chunk.paths)

    def full(self) -> bool:
        """Whether to settle: not before there are twice the rows that the last time left, as each time looks at all chunks."""
        return self.rows > self.limit

    def settle(self, until: Path | None) -> Iterator[pa.RecordBatch]:
        """Sums all paths before ``until`` (all, if None) and gives their frequent nodes; ``until`` becomes an edge."""
        chunks, self.waiting, ready = self.waiting, [], []
        for words, paths, counts in chunks:
            stop = len(paths) if until is None else int(np.searchsorted(paths, first_at(words, until)))
            if stop:
                ready.append(Chunk(words, paths[:stop], counts[:stop]))
            if stop < len(paths):
                self.waiting.append(Chunk(words, paths[stop:], counts[stop:]))
        chunks.clear()
        self.rows = sum(len(x.paths) for x in self.waiting)
        self.limit = max(GATHER, 2 * self.rows)
        new = set() if until is None else {until[:1], until[:2]}
        edges, self.cut = self.edges | self.cut | new, new
        if ready:
            yield from self._count(ready, edges)

    def _count(self, chunks: list[Chunk], edges: set[tuple]) -> Iterator[pa.RecordBatch]:
        """Frequent nodes with their ancestors' counts; a node of an edge comes as a part of its count, whatever it is.

        Takes the chunks out of their list.
        """
        every = pa.concat_arrays([x.words for x in chunks]).dictionary_encode()
        names, numbers = every.dictionary, every.indices.to_numpy()  # an end is 0, as it is each chunk's first word
        starts = np.cumsum([0, *(len(x.words) for x in chunks)]).tolist()
        a, b, c = (np.concatenate([numbers[at:][x.paths >> i * WORD_BITS & MASK] for at, x in zip(starts, chunks, strict=False)]) for i in (2, 1, 0))
        counts = np.concatenate([x.counts for x in chunks]).astype(np.int64)
        chunks.clear()
        del every, numbers
        self.total += int(counts.sum())
        n, least = len(names), self.least
        number = dict(zip(words := sorted({w for e in edges for w in e}), pc.index_in(pa.array(words, pa.binary()), names).to_pylist(), strict=True))

        one = np.zeros(n, dtype=np.int64)
        np.add.at(one, a, counts)
        cut1 = np.zeros(n, dtype=bool)
        cut1[[number[e[0]] for e in edges if number[e[0]] is not None]] = True
        words1 = np.flatnonzero((one >= least) | (cut1 & (one > 0)))

        keys = a.astype(np.int64) * n + b
        cuts = np.array([number[e[0]] * n + number[e[1]] for e in edges if len(e) == 2 and None not in (number[e[0]], number[e[1]])], dtype=np.int64)
        rows = np.flatnonzero((b > 0) & (_may_be(least, keys, counts) | np.isin(keys, cuts)))
        order, starts, two = _sums(keys[rows], counts[rows])
        rows, pair = rows[order], np.repeat(np.arange(len(starts)), np.diff(starts, append=len(rows)))
        cut2, head = np.isin(keys[rows[starts]], cuts), rows[starts]
        words2 = np.flatnonzero((two >= least) | cut2)

        some = np.flatnonzero((c[rows] > 0) & (two >= least)[pair])
        rows, pair = rows[some], pair[some]
        keys = pair * n + c[rows]
        some = np.flatnonzero(_may_be(least, keys, counts[rows]))
        rows, pair = rows[some], pair[some]
        order, starts, three = _sums(keys[some], counts[rows])
        words3 = order[starts[three >= least]]
        three = three[three >= least]

        pairs, triples, of = head[words2], rows[words3], pair[words3]
        ends1, ends2 = len(words1), len(words1) + len(pairs)
        size = ends2 + len(triples)
        if not size:
            return
        place = np.arange(size)
        w1 = np.concatenate([words1, a[pairs], a[triples]])
        w2 = np.concatenate([np.zeros_like(words1), b[pairs], b[triples]])
        w3 = np.concatenate([np.zeros(ends2, dtype=np.int64), c[triples]])
        l2 = np.concatenate([np.zeros(ends2, dtype=np.int64), two[of]])
        part = np.concatenate([cut1[words1], cut2[words2], np.zeros(len(triples), dtype=bool)])
        hidden2 = np.concatenate([np.ones(ends2, dtype=bool), cut2[of]])
        columns = [names.take(pa.array(x, mask=place < end)).cast(pa.string()) for x, end in ((w1, 0), (w2, ends1), (w3, ends2))]
        f = np.concatenate([one[words1], two[words2], three])
        columns += [pa.array(f), pa.array(one[w1], mask=(place < ends1) | cut1[w1]), pa.array(l2, mask=hidden2), pa.array(part)]
        yield self._batch(columns)

    def whole(self) -> pa.RecordBatch:
        """The part of the language's words that this range holds."""
        return self._batch([pa.array([x], kind) for x, kind in zip((None, None, None, self.total, None, None, True), (*[pa.string()] * 3, *[pa.int64()] * 3, pa.bool_()), strict=True)])

    def _batch(self, columns: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(columns[0])), *columns], names=["lang", "w1", "w2", "w3", "f", "l1", "l2", "part"])


def merged(chunks: DataFrame, bounds: list[tuple[bytes, Path]], least: int) -> DataFrame:
    """(lang, w1, w2, w3, f, l1, l2, part) of the nodes that occur ``least`` times or more: l1 = f(w1), l2 = f(w1 w2).

    Rows with ``part`` hold a part of the count of a node through which a bound cuts (or of a language); the ancestors
    that such nodes are come as null.
    """

    def edges_of(at: int, lang: str) -> set[tuple]:
        near = [p for name, p in bounds[max(0, at - 1) : at + 1] if name == lang.encode()]
        return {p[:i] for p in near for i in (1, 2)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        merge: Merge | None = None
        for batch in batches:
            for at, lang, w1, w2, w3, chunk in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5), strict=True):
                if (at, lang) != now:
                    if merge is not None:
                        yield from merge.settle(None)
                        yield merge.whole()
                    now, merge = (at, lang), Merge(lang, edges_of(at, lang), least)
                elif merge.full():
                    yield from merge.settle((w1, w2, w3))
                merge.add(unpack(chunk.as_py()))
        if merge is not None:
            yield from merge.settle(None)
            yield merge.whole()

    ordered = chunks.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "lang", "w1", "w2", "w3")
    return ordered.mapInArrow(run, "lang string, w1 string, w2 string, w3 string, f bigint, l1 bigint, l2 bigint, part boolean")


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 10, share: int = 50, top: int = 2000, ranges: int | None = None) -> DataFrame:
    """Each language's ``top`` phrases of two and three words by the score of their worst cut.

    A-Z are lower-cased; texts are split at ``. , ; : ! ?`` and line ends into pieces and those at spaces and tabs into
    words. f counts all occurrences within pieces, overlaps included. Phrases with a = f of ``least`` or more are cut
    after each word into parts with l and r occurrences; the cut of the smallest floor(10^6 a a / (l r)) counts, the
    first of equal ones. A phrase in a longer one that occurs ``share`` percent as often or more is dropped. Returns lang,
    rank, phrase, a, l, r, n (words of the language) and score, by score and a descending and the phrase's bytes. Exact
    for counts below 10^16.

    Null text is empty, a null language ``und``; repeated rows count each; other columns are left out, whatever their
    names; an empty table gives none. A task's tries hold FULL words or so, texts are split in blocks, and a range's merge
    holds the chunks that overlap; bounds come from a sample and move no count. There are at most MOST_RANGES ranges, so few
    nodes are summed from parts.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    if ranges is None:
        size = int(str(docs.select(lang_col, text_col)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        ranges = min(MOST_RANGES, max(8, -(-size // RANGE_BYTES)))
    bounds = sample_bounds(texts, ranges)
    nodes = materialize(merged(serialised(texts, bounds), bounds, least), "phrase-nodes")

    cut = materialize(nodes.where("part").groupBy("lang", "w1", "w2").agg(F.sum("f").alias("f")), "phrase-edges")
    totals = cut.where("w1 is null").select("lang", F.col("f").alias("n"))
    words = cut.where("w1 is not null and w2 is null").select("lang", "w1", F.col("f").alias("c1"))
    pairs = cut.where("w2 is not null").select("lang", "w1", "w2", F.col("f").alias("c2"))
    none = F.lit(None).cast("bigint")
    rest = cut.where(F.col("w1").isNotNull() & (F.col("f") >= least)).select("lang", "w1", "w2", F.lit(None).cast("string").alias("w3"), "f", none.alias("l1"), none.alias("l2"))
    every = nodes.where("not part").drop("part").unionByName(rest).join(words, ["lang", "w1"], "left").join(pairs, ["lang", "w1", "w2"], "left")
    every = materialize(every.select("lang", "w1", "w2", "w3", "f", F.coalesce("l1", "c1").alias("l1"), F.coalesce("l2", "c2").alias("l2")), "phrase-tries")

    # suffix links: (w1 w2) to (w2), (w1 w2 w3) to (w2 w3), which knows f(w3) by its own
    ends = every.where("w2 is null").select("lang", F.col("w1").alias("w2"), F.col("f").alias("r"))
    twos = materialize(every.where("w2 is not null and w3 is null").join(ends, ["lang", "w2"]).select("lang", "w1", "w2", "f", "l1", "r"), "phrase-pairs")
    tails = twos.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("r1"), F.col("r").alias("r2"))
    threes = materialize(every.where("w3 is not null").join(tails, ["lang", "w2", "w3"]), "phrase-triples")
    inside = threes.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "f")
    inside = materialize(inside.groupBy("lang", "p").agg(F.max("f").alias("longer")).select("lang", "p.*", "longer"), "phrases-inside")

    def at(k: int, left: str, right: str) -> Column:
        return F.struct(score(F.col("f"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    kept = twos.join(inside, ["lang", "w1", "w2"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("f"), F.lit(True)))
    found = kept.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), at(1, "l1", "r").alias("best"))
    found = found.unionByName(threes.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), F.least(at(1, "l1", "r1"), at(2, "l2", "r2")).alias("best")))
    order = [F.desc("best.score"), F.desc("a"), F.col("phrase")]  # first in SHARES parts of a language, of which the last ranking gets ``top`` each
    near = F.row_number().over(Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(SHARES))).orderBy(*order))
    best = found.withColumn("near", near).where(F.col("near") <= top).drop("near")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a a / (l r)) in whole numbers of 38 digits."""
    wide = "decimal(19,0)"
    return F.call_function("div", (F.lit(1_000_000).cast("decimal(7,0)") * a.cast(wide)).cast("decimal(25,0)") * a.cast(wide), left.cast(wide) * right.cast(wide)).cast("long")
