"""SimHash near-dedup through vantage-point trees.

Fingerprints are partitioned by Hamming distance. Two fingerprints within the radius differ by at most half of it in
their upper or in their lower 32 bits, so there is a vantage-point tree for each half, searched with half the radius: its
boundary bands are a third as wide as those of one tree over 64 bits, and visits grow far more slowly with the table. The
upper levels of both trees, built on a bounded sample, split all fingerprints into shards. A fingerprint lives in one
shard of each tree and also visits each shard across a boundary that its ball reaches (triangle inequality), so every
pair within the radius meets in a shard. There local trees find the exact pairs by all 64 bits and keep a spanning forest
of them; shards never hand on all pairs of a group. The forests are joined to components by alternating star
contractions, which take rounds logarithmic in the components' size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvia.session import materialize, slices

SEED = 42
BITS = 64


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of the text's word shingles, repeats included; A-Z lower-cased, words parted by ASCII white space.

    Fewer words than ``width`` make one shingle of all; no words, none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    parts = zip(*(words[i:] for i in range(width)), strict=False)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(SEED)), dtype=np.uint64, count=len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes; no hashes give zero."""
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        some = hashes[lo : lo + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, text_col: str = "text", keep: list[str], width: int = 3) -> DataFrame:
    """The kept columns and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(shingle_hashes(t, width)) for t in batch.column(0).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found.view(np.int64))], names=[*keep, "fp"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("fp", T.LongType())])
    return docs.select(docs[text_col].cast("string").alias("__text"), *keep).mapInArrow(run, schema)


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class Tree:
    """The upper levels of a vantage-point tree, whose leaves are shards."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        #: Inner node: (vantage, limit, near node, far node); near holds distances up to the limit. Leaf: its number.
        self.nodes: list[tuple[np.uint64, int, int, int] | int] = []
        self.leaves = 0
        self.root = self._grow(sample, depth)

    def _grow(self, sample: np.ndarray, depth: int) -> int:
        choice = split(sample) if depth > 0 and len(sample) >= 8 else None
        at = len(self.nodes)
        if choice is None:
            self.nodes.append(self.leaves)
            self.leaves += 1
            return at
        vantage, limit, apart = choice
        self.nodes.append(-1)
        near = self._grow(sample[apart <= limit], depth - 1)
        far = self._grow(sample[apart > limit], depth - 1)
        self.nodes[at] = (vantage, limit, near, far)
        return at

    def route(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point index, shard, at home): each point's own shard, and those it must visit.

        A pair split at a node is met by its near point visiting the far side; a visitor goes wherever its ball reaches.
        """
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        stack = [(self.root, np.arange(len(points)), np.empty(0, dtype=np.int64))]
        while stack:
            at, home, guest = stack.pop()
            if not len(home) and not len(guest):
                continue
            node = self.nodes[at]
            if isinstance(node, int):
                index = np.concatenate([home, guest])
                found.append((index, np.full(len(index), node, dtype=np.int32), np.arange(len(index)) < len(home)))
                continue
            vantage, limit, near, far = node
            d, g = distance(points[home], vantage), distance(points[guest], vantage)
            stack.append((near, home[d <= limit], guest[g <= limit + radius]))
            stack.append((far, home[d > limit], np.concatenate([guest[g > limit - radius], home[(d <= limit) & (d > limit - radius)]])))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3)) if found else (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool))


def split(points: np.ndarray, tries: int = 8) -> tuple[np.uint64, int, np.ndarray] | None:
    """A vantage point among the points, the limit that halves them best and their distances; None if none halves them.

    The spread of the distances decides between the candidates, evenly placed ones.
    """
    best = None
    for candidate in points[np.linspace(0, len(points) - 1, min(tries, len(points))).astype(int)]:
        apart = distance(points, candidate)
        limit = int(np.median(apart))
        inside = np.count_nonzero(apart <= limit)
        if inside == len(points):
            limit -= 1
            inside = np.count_nonzero(apart <= limit)
        if inside and (best is None or apart.std() > best[0]):
            best = (apart.std(), candidate, limit, apart)
    return best[1:] if best else None


class Forest:
    """Union-find with path halving."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def sweep(points: np.ndarray, members: np.ndarray, radius: int, forest: Forest, batch: int = 128, block: int = 8192) -> None:
    """Joins all pairs of the members within the radius: a search that compares what it reaches with what is unreached.

    Each member is compared with the unreached ones only, so a dense group shrinks at once, whatever its size.
    """
    unreached, reached = members, members[:0]
    while len(unreached):
        if not len(reached):
            reached, unreached = unreached[:1], unreached[1:]
        some, reached = reached[:batch], reached[batch:]
        kept, new = [], [reached]
        for lo in range(0, len(unreached), block):
            part = unreached[lo : lo + block]
            close = np.bitwise_count(points[some][:, None] ^ points[part][None, :]) <= radius
            found = close.any(axis=0)
            if found.any():
                new.append(part[found])
                for i, j in zip(some[close[:, found].argmax(axis=0)].tolist(), new[-1].tolist(), strict=True):
                    forest.join(i, j)
                part = part[~found]
            kept.append(part)
        reached, unreached = np.concatenate(new), np.concatenate(kept) if kept else unreached


def dense(points: np.ndarray, radius: int, share: float = 0.01) -> bool:
    """Whether evenly placed points have over the given share of others within the radius, or lie mostly so near that no tree prunes."""
    some = points[np.linspace(0, len(points) - 1, 16).astype(int)]
    apart = np.bitwise_count(some[:, None] ^ points[np.linspace(0, len(points) - 1, min(len(points), 2048)).astype(int)][None, :])
    return bool(np.mean(apart <= radius) > share + 1 / min(len(points), 2048) or np.median(apart) <= 6 * radius)


def link(points: np.ndarray, keys: np.ndarray, home: np.ndarray, guest: np.ndarray, reach: int, radius: int, forest: Forest, block: int = 512) -> None:
    """Joins all pairs within the radius, and within ``reach`` by their keys, of which at least one is at home.

    A local vantage-point tree over the keys prunes; where keys are all alike, one over the points does.
    """
    stack = [(home, guest, keys, reach)]
    while stack:
        home, guest, by, near = stack.pop()
        both = np.concatenate([home, guest])
        if not len(home) or len(both) < 2:
            continue
        if dense(points[both], radius):
            sweep(points, both, radius, forest)
            continue
        choice = split(by[home], 4) if len(home) > block else None
        if choice is None and len(home) > block and by is not points:
            by, near = points, radius
            choice = split(by[home], 4)
        if choice is None:
            for lo in range(0, len(home), block):
                rows = home[lo : lo + block]
                for at in range(lo, len(both), 4 * block):
                    columns = both[at : at + 4 * block]
                    for i, j in zip(*np.nonzero(np.bitwise_count(points[rows][:, None] ^ points[columns][None, :]) <= radius), strict=True):
                        forest.join(int(rows[i]), int(columns[j]))
            continue
        vantage, limit, d = choice
        g = distance(by[guest], vantage)
        edge = home[(d <= limit) & (d > limit - near)]
        stack.append((home[d <= limit], guest[g <= limit + near], by, near))
        stack.append((home[d > limit], np.concatenate([guest[g > limit - near], edge]), by, near))


HALVES = 2


def half(points: np.ndarray, number: int) -> np.ndarray:
    """The upper (0) or lower (1) 32 bits."""
    return points >> np.uint64(32) if number == 0 else points & np.uint64(0xFFFFFFFF)


def shard_links(points: np.ndarray, home: np.ndarray, number: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, root) of the points that the shard of one half's tree joins to another: a star for each group."""
    order = np.lexsort((np.arange(len(points)), points))
    points, home = points[order], home[order]
    forest = Forest(len(points))
    link(points, half(points, number), np.flatnonzero(home), np.flatnonzero(~home), radius // HALVES, radius, forest)
    roots = np.array([forest.find(i) for i in range(len(points))], dtype=np.int64)
    moved = np.flatnonzero(roots != np.arange(len(points)))
    return points[moved], points[roots[moved]]


def sample_fingerprints(distinct: DataFrame, n: int, least: int = 8192, most: int = 1 << 20) -> np.ndarray:
    """About n / 64 of the fingerprints, by their hash, ``least`` and at most ``most`` (8 MB) of them or so."""
    wanted = min(most, max(least, n // 64))
    few = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, n // wanted))) == 0).select("fp").toPandas()["fp"]
    return np.sort(few.to_numpy(dtype=np.int64).view(np.uint64))


def hamming_links(distinct: DataFrame, *, radius: int = 3, shard_rows: int = 8192) -> DataFrame:
    """Links (u, v) of fingerprints that join all of ``fp`` within ``radius`` bits; each shard gives a forest.

    The trees' upper levels come from a sample of the fingerprints that grows with them up to about 8 MB on the driver;
    the number of levels follows the row count, so that a shard keeps about ``shard_rows`` rows at home. Beyond 10^9
    fingerprints the sample is not larger and shards grow instead, by 8 bytes a row. Fingerprints that are all alike in a
    half cannot be told apart by its tree and share a shard, which the local search parts by the other half.
    """
    n = distinct.count()
    sample = sample_fingerprints(distinct, n)
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / shard_rows))))
    trees = [Tree(half(sample, i), depth) for i in range(HALVES)]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for number, tree in enumerate(trees):
                index, shard, home = tree.route(half(points, number), radius // HALVES)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), number, dtype=np.int32)), pa.array(shard), pa.array(points[index].view(np.int64)), pa.array(home)], names=["half", "shard", "fp", "home"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = shard_links(pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64), pdf["home"].to_numpy(dtype=bool), int(pdf["half"].iloc[0]), radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    routed = distinct.select("fp").mapInArrow(route, "half int, shard int, fp bigint, home boolean")
    return routed.groupBy("half", "shard").applyInPandas(search, "u bigint, v bigint")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(u, root) of every node that has a link, but for the roots: root is the smallest node that u reaches.

    Large-star and small-star steps alternate until all links are stars. Each round is cut off by a written table. A
    node with many links is a key of partial aggregates and of a join whose both sides are plain shuffles, which adaptive
    execution splits; it is never a group in one task. No links give no rows.
    """

    def minima(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(materialize(minima(both).select("u", F.least("u", "m").alias("m")), name), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, name)
        small = large.join(materialize(minima(large), name), "u")
        edges = materialize(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct(), name)
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty():  # all stars
            return edges.select("u", F.col("v").alias("root"))


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """Each row's id, ``fingerprint`` (16 lower-case hex digits) and ``component_id``.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest id reachable, the row's own
    included. Null or blank text has fingerprint zero, which links like any other. Rows of equal id are separate rows of
    one id. Null ids stay and get their component's smallest id, null if it has none. An empty table gives an empty
    result.
    """
    fps = materialize(fingerprints(docs, text_col=text_col, keep=[id_col], width=width).withColumnRenamed(id_col, "id"), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-classes")
    roots = components(hamming_links(distinct.select("fp"), radius=radius), "fingerprint-links")
    named = distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")  # both sides of the join are then plain shuffles
    classes = named.join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


VIEWS = 16
VIEW_SHINGLES = 3
#: Rows and shingles of one block of a set of candidates that are compared with each other.
BLOCK_ROWS = 2048
BLOCK_SHINGLES = 500_000
_SEEDS = np.array([i * 0x9E3779B97F4A7C15 % (1 << 64) for i in range(1, VIEWS + 1)], dtype=np.uint64)


def view_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """VIEWS fingerprints, each of the VIEW_SHINGLES different shingles that come first in an order of its own.

    Texts whose shingle sets have the similarity J agree in a view with a probability of about J ** VIEW_SHINGLES. Long
    texts are mixed in parts, of which each hands on its first shingles. No hashes give zeros.
    """
    if not len(hashes):
        return np.zeros(VIEWS, dtype=np.uint64)
    some = np.unique(hashes)
    firsts = np.empty((VIEWS, 0), dtype=np.uint64)
    for lo in range(0, len(some), 1 << 14):
        # splitmix64's finaliser, seeded by the view: multiples of one constant order small values alike in all views
        mixed = some[None, lo : lo + (1 << 14)] + _SEEDS[:, None]
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        mixed = np.concatenate([firsts, mixed], axis=1)
        firsts = np.partition(mixed, VIEW_SHINGLES - 1, axis=1)[:, :VIEW_SHINGLES] if mixed.shape[1] > VIEW_SHINGLES else mixed
    bits = np.unpackbits(np.ascontiguousarray(firsts.astype("<u8")).view(np.uint8).reshape(VIEWS, -1, 8), axis=2, bitorder="little")
    ones = bits.sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones > firsts.shape[1], axis=1, bitorder="little").view("<u8")[:, 0]


def raw_hash(text: F.Column) -> F.Column:
    """128 bits of the text as it is; null is empty text."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, raw, norm, views, size) of each row: 128-bit hashes of its text and of the normalised words, the fingerprint of
    all shingles with those of the views, and how many different shingles there are. Null text is empty; rows of null id
    are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            norms, views, sizes = [], [], []
            for text in batch.column(2).to_pylist():
                norms.append(xxhash.xxh3_128_digest(b" ".join((text or "").encode().lower().split())))
                hashes = shingle_hashes(text, width)
                sizes.append(len(np.unique(hashes)))
                views.append(np.concatenate([np.array([fingerprint(hashes)], dtype=np.uint64), view_fingerprints(hashes)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(norms, pa.binary()), pa.array(views, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=["id", "raw", "norm", "views", "size"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("raw", T.BinaryType()), T.StructField("norm", T.BinaryType()), T.StructField("views", T.ArrayType(T.LongType())), T.StructField("size", T.LongType())])
    return docs.where(F.col(id_col).isNotNull()).select(id_col, raw_hash(F.col(text_col)), F.col(text_col).cast("string")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, some: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, shingles): the different shingle hashes of the texts that ``some`` (id, raw, node) names, one row a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    texts = docs.select(F.col(id_col).alias("id"), raw_hash(F.col(text_col)).alias("raw"), F.col(text_col).cast("string").alias("text")).join(some, ["id", "raw"])
    return texts.select("node", "text").mapInArrow(run, "node binary, shingles array<bigint>").dropDuplicates(["node"])


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) with ``close``: whether the Jaccard similarity of their shingle sets reaches the bound.

    Pairs of nodes without a set are left out; the sets of two empty texts are close.
    """
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (both >= similarity * (F.size("sa") + F.size("sb") - both)).alias("close"))


def close_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, first row) of a spanning forest of all links between sorted shingle sets of the similarity or more.

    Sets of the similarity share a shingle among the rarest of each (as many as the bound allows them to differ in, and
    one more), so an inverted index of those gives the candidates: a passage that all sets hold is in few of them. Each
    set reached is compared with unreached ones only. Empty sets have no links.
    """
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    rows = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate([np.asarray(x, dtype=np.int64) for x in sets]) if len(rows) else np.empty(0, np.int64)
    _, column, counts = np.unique(values, return_inverse=True, return_counts=True)
    order = np.lexsort((column, counts[column], rows))
    column = column[order]  # rows are in order before and after
    place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    prefix = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    held = (place < prefix[rows]) & (counts[column] > 1)
    rows, column = rows[held], column[held]
    order = np.argsort(column, kind="stable")
    postings, column_of = rows[order], column[order]
    starts = np.searchsorted(column_of, column)  # of each entry's posting list
    ends = np.searchsorted(column_of, column, side="right")
    first = np.searchsorted(rows, np.arange(len(sets) + 1))

    forest = Forest(len(sets))
    open_ = np.ones(len(sets), dtype=bool)
    for seed in range(len(sets)):
        if not open_[seed]:
            continue
        open_[seed] = False
        reached = [seed]
        while reached:
            i = reached.pop()
            near = [x[open_[x]] for a, b in zip(starts[first[i] : first[i + 1]].tolist(), ends[first[i] : first[i + 1]].tolist(), strict=True) if len(x := postings[a:b]) > 1]
            near = np.unique(np.concatenate(near)) if near else np.empty(0, np.int64)
            near = near[np.minimum(sizes[near], sizes[i]) >= similarity * np.maximum(sizes[near], sizes[i]) - 1e-9]
            for j in near.tolist():
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if shared >= similarity * (int(sizes[i] + sizes[j]) - shared):
                    forest.join(i, j)
                    open_[j] = False
                    reached.append(j)
    found = np.array([forest.find(i) for i in range(len(sets))], dtype=np.int64)
    moved = np.flatnonzero(found != np.arange(len(sets)))
    return moved, found[moved]


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """(id, raw, group, stays) of every different id and text: ``raw`` is the text's hash, ``group`` the smallest id of its
    group of near copies, its own if it has none, and ``stays`` tells the one text of the group that is kept: that of the
    smallest id, and of these the one of smallest hash.

    Two texts link if the Jaccard similarity of their ``width``-word shingle sets is ``similarity`` or more. Texts of
    equal normalised words are one node, whatever their ids. Candidates are texts whose fingerprints of all shingles lie
    within ``radius`` bits, by the vantage-point trees, or whose fingerprints of one of VIEWS samples of shingles are
    equal. Of each set of candidates, all are compared exactly with one of them. Where that leaves some apart, the set's
    texts are parted by a second view, and within those sets an inverted index finds all links, in blocks of bounded size
    that hand on a forest of them: a common passage or a large group of copies never makes a row for each pair.

    Null or blank text equals other blank text. Null ids take no part. Rows of equal id and different texts are different
    documents, each of which belongs to its own text's group; rows of equal id and text are one. No choice depends on the
    order of rows. An empty table gives an empty result.
    """
    table = materialize(sketches(docs, id_col, text_col, width), "sketches")
    classes = table.groupBy("norm").agg(F.min(F.struct("id", "raw", "views", "size")).alias("r"))
    reps = materialize(classes.select(F.col("norm").alias("node"), "r.*"), "sketch-classes")
    seen = reps.select("node", "size", F.posexplode("views").alias("view", "fp"))
    # samples of similar texts are equal or far apart; the fingerprints of all shingles go through the trees
    whole = materialize(seen.where("view = 0").groupBy("fp").agg(F.count("*").alias("n")), "view-fingerprints")
    links = hamming_links(whole.select("fp"), radius=radius)
    groups = whole.select("fp", F.col("fp").alias("g"), "n").union(whole.join(links.select(F.col("u").alias("fp"), F.col("v").alias("g")), "fp").select("fp", "g", "n")).distinct()
    several = groups.groupBy("g").agg(F.sum("n").alias("size")).where("size > 1").select("g")
    groups = materialize(groups.join(several, "g").select("fp", "g"), "view-groups")
    near = seen.where("view = 0").join(groups, "fp").select("view", "g", "node", "size")
    equal = materialize(seen.where("view > 0").groupBy("view", "fp").count().where("count > 1").select("view", "fp"), "view-classes")
    same = seen.where("view > 0").join(equal, ["view", "fp"]).select("view", F.col("fp").alias("g"), "node", "size")
    members = near.union(same).select(F.xxhash64("view", "g").alias("key"), "node", F.array("view").alias("used"), "size").distinct()

    members = materialize(members, "candidates")
    asked = reps.select("id", "raw", "node").join(members.select("node").distinct(), "node", "left_semi")
    sets = materialize(shingle_sets(docs, asked, id_col, text_col, width), "shingle-sets")

    # each with the first text of its set; one set under ``similarity`` times the other's size is never close
    pivots = materialize(members.groupBy("key").agg(F.min(F.struct("node", "size")).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.size").alias("pivot_size")), "pivots")
    fits = F.least("size", "pivot_size") >= similarity * F.greatest("size", "pivot_size")
    paired = members.join(pivots, "key").select("key", "node", "pivot", fits.alias("fits"))
    asked = paired.where("fits and node > pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    close = materialize(similar_pairs(asked, sets, similarity).where("close").select(F.col("a").alias("u"), F.col("b").alias("v")), "close")

    # sets that are not all close to their pivot go on: by two agreeing views, all within are compared
    apart = materialize(paired.where("node > pivot").join(close.withColumnsRenamed({"u": "node", "v": "pivot"}), ["node", "pivot"], "left_anti").select("key", "node").distinct(), "apart")
    going = materialize(apart.select("key").distinct(), "apart-keys")
    rest = members.join(apart.withColumn("apart", F.lit(1)), ["key", "node"], "left").join(going, "key", "left_semi").join(reps.select("node", "views"), "node")
    rest = rest.select("node", "size", "views", F.coalesce("apart", F.lit(0)).alias("apart"), F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.lit(VIEWS)), lambda v: ~F.array_contains("used", v)), lambda v: F.array_sort(F.array_append("used", v)))).alias("two"))
    rest = materialize(rest.groupBy(F.xxhash64("two", F.transform("two", lambda v: F.get("views", v))).alias("key"), "node", "size").agg(F.max("apart").alias("apart")), "two-views")
    sizes = rest.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.max("apart").alias("apart"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1 and apart = 1")
    # texts that agree in many views meet in many sets; of sets of the same members (by a 128-bit hash) one is enough
    sizes = materialize(sizes.groupBy("n", "x", "y").agg(F.min(F.struct("key", "words")).alias("k")).select("k.*", "n"), "two-view-sets")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("words") / BLOCK_SHINGLES)).cast("int")
    rest = rest.select("key", "node").join(sizes.select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rest = rest.select("key", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("key", "node", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        u, v = close_links(list(pdf["shingles"]), similarity)
        return pd.DataFrame({"u": pdf["node"].to_numpy()[u], "v": pdf["node"].to_numpy()[v]})

    more = rest.join(sets, "node").groupBy("key", "lo", "hi").applyInPandas(compare, "u binary, v binary")
    roots = components(close.union(more), "near-copies")
    named = reps.select("node", "id", "raw").join(roots.withColumnRenamed("u", "node"), "node", "left").select("node", "id", "raw", F.coalesce("root", "node").alias("root"))
    first = materialize(named.groupBy("root").agg(F.min(F.struct("id", "raw")).alias("first")), "near-firsts")
    named = materialize(named.join(first, "root").select(F.col("node").alias("norm"), "first"), "near-groups")
    every = table.select("id", "raw", "norm").distinct().join(named, "norm")
    return every.select("id", "raw", F.col("first.id").alias("group"), ((F.col("id") == F.col("first.id")) & (F.col("raw") == F.col("first.raw"))).alias("stays"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows without near copies: of each group of ``near_duplicates`` one row stays, that of smallest id.

    Of rows of equal id and text one stays, that of the smallest hash of all columns; rows of equal id and different
    texts are different documents, so no text goes that has no near copy. Rows with a null id all stay.
    """
    kept = materialize(near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("stays").select(F.col("id").alias("__id"), F.col("raw").alias("__raw")), "kept-documents")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.where(F.col(id_col).isNotNull()).select(F.struct(*columns).alias("__row"), F.col(id_col).alias("__id"), raw_hash(F.col(text_col)).alias("__raw"), F.xxhash64(*columns).alias("__tie"))
    several = materialize(rows.select("__id", "__raw").groupBy("__id", "__raw").count().where("count > 1").select("__id", "__raw"), "repeated-rows")
    # most rows are the only ones of their id and text; the others part from them before either meets what is kept
    single = rows.join(several, ["__id", "__raw"], "left_anti").join(kept, ["__id", "__raw"], "left_semi").select("__row.*")
    repeated = rows.join(several, ["__id", "__raw"], "left_semi").join(kept, ["__id", "__raw"], "left_semi").groupBy("__id", "__raw").agg(F.min_by("__row", "__tie").alias("__row")).select("__row.*")
    return single.unionByName(repeated).unionByName(docs.where(F.col(id_col).isNull()))
