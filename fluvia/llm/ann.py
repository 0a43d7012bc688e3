"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the neighbour graph is cut into balanced parts by recursive bisection, and a small classifier learns
the part of a vector from the vector, with each vertex's neighbours' parts as its soft target. Every row goes to its most
probable part; a query is routed to the most probable parts and reranked there by exact distance. How many parts a query
visits is measured on the sample: the fewest that find the wanted share of the sample's true neighbours.

Parts are dealt out in bins and blocks of bounded size, and so are their queries, so no task holds a large part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvia.session import materialize


#: Share of a sample's true neighbours that the probes must find; the recall asked of a search is 0.9.
WANTED = 0.93
#: Rows that a part holds at least, and that a part's sample holds.
PART_ROWS, PART_SAMPLE = 64, 16


#: Rows that are ranked at once, so that a block of logits or distances stays within some 30 MB.
BLOCK = 256


def neighbours(rows: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row of a sample, in blocks and in single precision."""
    rows = rows.astype(np.float32)
    squares = (rows**2).sum(axis=1)
    out = np.empty((len(rows), k), dtype=np.int32)
    for lo in range(0, len(rows), BLOCK):
        near = squares[None, :] - 2 * rows[lo : lo + BLOCK] @ rows.T
        near[np.arange(len(near)), lo + np.arange(len(near))] = np.inf
        out[lo : lo + BLOCK] = np.argpartition(near, k - 1, axis=1)[:, :k]
    return out


def bisect(graph: np.ndarray, members: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """True for one half of the members: a balanced cut of the neighbour graph.

    A smooth vector on the graph (power iteration against the constant one) is split at its median; then pairs of
    vertices that lie on the wrong sides change places while that lowers the cut, so the halves keep their sizes.
    """
    n = len(members)
    place = np.full(len(graph), -1)
    place[members] = np.arange(n)
    ends = place[graph[members]]
    inside = ends >= 0
    a, b = np.repeat(np.arange(n), graph.shape[1])[inside.ravel()], ends[inside]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    x = rng.standard_normal(n)
    for _ in range(60):
        x = x + np.bincount(a, weights=x[b], minlength=n) / degree
        x -= (x * degree).sum() / degree.sum()
        x /= np.linalg.norm(x) or 1.0
    half = np.zeros(n, dtype=bool)
    half[np.argsort(x, kind="stable")[: n // 2]] = True
    for _ in range(10):
        with_true = np.bincount(a, weights=half[b], minlength=n)
        gain = np.where(half, degree - 2 * with_true, 2 * with_true - degree)
        left, right = np.flatnonzero(half & (gain > 0)), np.flatnonzero(~half & (gain > 0))
        many = min(len(left), len(right)) // 2
        if not many:
            break
        half[left[np.argsort(-gain[left], kind="stable")[:many]]] = False
        half[right[np.argsort(-gain[right], kind="stable")[:many]]] = True
    return half


def partition(graph: np.ndarray, depth: int, rng: np.random.Generator) -> np.ndarray:
    """Balanced parts 0 to 2**depth - 1 of the vertices."""
    part = np.zeros(len(graph), dtype=np.int64)
    for _ in range(depth):
        new = part * 2
        for p in np.unique(part):
            members = np.flatnonzero(part == p)
            new[members[bisect(graph, members, rng)]] += 1
        part = new
    return part


@dataclass
class Router:
    """A network of one hidden layer that gives each vector's logits over the parts."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    probes: int
    recall: float

    @property
    def parts(self) -> int:
        return len(self.layers[-1])

    def logits(self, rows: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((rows.astype(np.float32) - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def most_probable(self, rows: np.ndarray, many: int) -> np.ndarray:
        """The parts of greatest logits, the smaller number first where they are equal; block by block."""
        out = np.empty((len(rows), many), dtype=np.int32)
        for lo in range(0, len(rows), BLOCK):
            logits = self.logits(rows[lo : lo + BLOCK])
            out[lo : lo + BLOCK] = logits.argmax(axis=1)[:, None] if many == 1 else np.argsort(-logits, axis=1, kind="stable")[:, :many]
        return out


def learn(rows: np.ndarray, parts: np.ndarray, weights: np.ndarray, count: int, rng: np.random.Generator, hidden: int = 128) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Adam on the cross-entropy with soft targets, in single precision.

    A row's target is the share of ``weights`` that its ``parts`` have; it is spread out over all parts batch by batch
    only. 40 epochs, or as many steps on larger samples as 8,192 rows take, 12 epochs at least.
    """
    rows = rows.astype(np.float32)
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    scale[scale < 1e-9] = 1
    x = (rows - mean) / scale
    d, epochs = x.shape[1], int(min(40, max(12, 40 * 8192 / max(1, len(x)))))
    weights = (weights / weights.sum()).astype(np.float32)
    normal = lambda *shape: rng.standard_normal(shape, dtype=np.float32)
    layers = [normal(d, hidden) * np.float32((2 / d) ** 0.5), np.zeros(hidden, np.float32), normal(hidden, count) * np.float32((1 / hidden) ** 0.5), np.zeros(count, np.float32)]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-5
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 256):
            at = order[lo : lo + 256]
            h = np.maximum(x[at] @ layers[0] + layers[1], 0)
            z = h @ layers[2] + layers[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = z / z.sum(axis=1, keepdims=True)
            np.subtract.at(dz, (np.repeat(np.arange(len(at)), parts.shape[1]), parts[at].ravel()), np.tile(weights, len(at)))
            dz /= np.float32(len(at))
            dh = dz @ layers[2].T * (h > 0)
            step += 1
            for i, g in enumerate((x[at].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                first[i] += np.float32(0.1) * (g - first[i])
                second[i] += np.float32(0.001) * (g * g - second[i])
                layers[i] -= np.float32(rate / (1 - 0.9**step)) * first[i] / (np.sqrt(second[i] / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    return mean, scale, layers


def fit(rows: np.ndarray, depth: int, *, k: int = 10, wanted: float = WANTED, seed: int = 0) -> Router:
    """The router of a sample, and the fewest probes that find the wanted share of the sample's true neighbours.

    The share is measured on a fifth of the sample that the classifier does not see. Nothing of rows times parts is held.
    """
    rng = np.random.default_rng(seed)
    k = min(k, len(rows) - 1)
    if depth == 0:
        d = rows.shape[1]
        return Router(np.zeros(d), np.ones(d), [np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1, 1.0)
    graph = neighbours(rows, k)
    part = partition(graph, depth, rng)
    count = 1 << depth
    targets = np.concatenate([part[graph], part[:, None]], axis=1).astype(np.int32)
    seen = rng.permutation(len(rows))
    unseen, seen = seen[: len(rows) // 5], seen[len(rows) // 5 :]
    mean, scale, layers = learn(rows[seen], targets[seen], np.array([1.0] * k + [k / 2]), count, rng)
    router = Router(mean, scale, layers, 1, 0.0)
    home = router.most_probable(rows, 1)[:, 0]
    tally = np.zeros(count, dtype=np.int64)
    for lo in range(0, len(unseen), BLOCK):
        some = unseen[lo : lo + BLOCK]
        ranked = router.most_probable(rows[some], count)
        place = np.empty_like(ranked)
        np.put_along_axis(place, ranked, np.arange(count, dtype=np.int32)[None, :].repeat(len(ranked), axis=0), axis=1)
        tally += np.bincount(np.take_along_axis(place, home[graph[some]], axis=1).ravel(), minlength=count)
    share = np.cumsum(tally) / max(1, tally.sum())
    router.probes = int(np.argmax(share >= wanted)) + 1
    router.recall = float(share[router.probes - 1])
    return router


def nearest(queries: np.ndarray, query_uids: np.ndarray, rows: np.ndarray, uids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's uid, row id, distance) of the k nearest rows but the query's own; ties to the smaller id.

    A product gives distances good enough to leave out most rows; what is left is measured on the vectors themselves.
    """
    out: tuple[list, list, list] = ([], [], [])
    squares = (rows**2).sum(axis=1)
    for lo in range(0, len(queries), 256):
        some = queries[lo : lo + 256]
        rough = squares[None, :] + (some**2).sum(axis=1)[:, None] - 2 * some @ rows.T
        for query, name, d in zip(some, query_uids[lo : lo + 256], rough, strict=True):
            d[uids == name] = np.inf
            if len(d) > k:
                limit = np.partition(d, k - 1)[k - 1]
                at = np.flatnonzero(d <= limit + 1e-9 * (squares.max() + (query**2).sum() + 1))
            else:
                at = np.arange(len(d))
            at = at[uids[at] != name]
            exact = np.sqrt(((rows[at] - query) ** 2).sum(axis=1))
            order = np.lexsort((ids[at], exact))[:k]
            out[0].append(np.full(len(order), name))
            out[1].append(ids[at][order])
            out[2].append(exact[order])
    return tuple(np.concatenate(x) if x else np.empty(0) for x in out)


def usable(vectors: DataFrame, queries: F.Column, id_col: str, vector_col: str) -> DataFrame:
    """(uid, id, v, asked) of the rows that take part, v as doubles; a uid for each row."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = vectors.where(F.col(id_col).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    return some.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))


def sample_of(every: DataFrame, n: int, least: int = 8192, most: int = 32_768) -> np.ndarray:
    """The vectors of smallest id hash, in single precision: a quarter of all, ``least`` at least and ``most`` at most."""
    rows = every.orderBy(F.xxhash64("id"), "id", "v").limit(min(most, max(least, n // 4))).select(F.col("v").cast("array<float>").alias("v")).toArrow()
    flat = rows.column("v").combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def ann_search(vectors: DataFrame, queries: F.Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, block_rows: int = 8192, wanted: float = WANTED, depth: int | None = None) -> DataFrame:
    """The k nearest rows found for each row that satisfies ``queries``: query_id, rank (from 1), vec_id, score.

    score is the Euclidean distance in double precision; ties go to the smaller id; a query's own row is no candidate.
    Null ids, and vectors null, empty, zero or holding null or non-finite components take no part, nor do vectors of
    another length than most have. Rows of equal id are separate rows of one id, as candidates and as queries. The index
    holds every row; the router is fitted on the sample of ``sample_of``. Parts double with the rows (PART_ROWS at least
    in each), as far as the sample has PART_SAMPLE rows of each: 2,048 parts at most, which then grow. A task reranks some
    parts of ``block_rows`` rows in all, or such a block of one, and hands on k rows a query. Fewer candidates than k give fewer rows, an empty table none.
    """
    every = materialize(usable(vectors, queries, id_col, vector_col), "vectors")
    sizes = every.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query bigint, vec_id bigint, score double"
    nothing = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not sizes:
        return nothing
    width, n = sizes[0]["d"], sizes[0]["count"]
    every = every.where(F.size("v") == width)
    sample = sample_of(every, n)
    if depth is None:
        depth = int(np.log2(max(1, min(n / PART_ROWS, len(sample) / PART_SAMPLE))))
    router = fit(sample, depth, k=k, wanted=wanted)

    def route(batches: Iterator[pa.RecordBatch], many: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).flatten().to_numpy().reshape(-1, width)
            parts = router.most_probable(rows, many) if len(rows) else np.empty((0, many), dtype=np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, parts.size + 1, many, dtype=np.int32)), pa.array(parts.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=["uid", "id", "v", "parts"])

    routed = "uid bigint, id bigint, v array<double>, parts array<int>"
    columns = ("uid", "id", "v")
    homes = every.select(*columns).mapInArrow(lambda b: route(b, 1), routed).select(*columns, F.col("parts")[0].alias("part"))
    asked = every.where("asked").select(*columns).mapInArrow(lambda b: route(b, router.probes), routed)
    homes, asked = materialize(homes, "vector-homes"), materialize(asked, "vector-queries")
    # at most 2,048 parts: neighbouring small ones share a bin of about block_rows rows, a larger one is cut into blocks
    sizes_of = {r["part"]: r["count"] for r in homes.groupBy("part").count().collect()}
    bin_of, blocks = bins(sizes_of, router.parts, block_rows)
    bin_col = F.element_at(F.array(*map(F.lit, bin_of)), F.col("part") + 1)
    questions = asked.withColumn("bin", F.explode(F.array_distinct(F.transform("parts", lambda p: F.element_at(F.array(*map(F.lit, bin_of)), p + 1)))))
    turns = {r["bin"]: -(-r["count"] // block_rows) for r in questions.groupBy("bin").count().collect()}
    if not turns:
        return nothing

    def lookup(counts: dict[int, int]) -> F.Column:
        return F.element_at(F.array(*(F.lit(counts.get(i, 1)) for i in range(len(blocks)))), F.col("bin") + 1)

    def own(counts: dict[int, int], name: str) -> F.Column:
        return F.pmod(F.xxhash64("uid"), lookup(counts)).cast("int").alias(name)

    def all_of(counts: dict[int, int], name: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), lookup(counts) - 1)).alias(name)

    homes = homes.withColumn("bin", bin_col).select(*columns, "part", "bin", own(blocks, "block")).select("*", all_of(turns, "turn"))
    questions = questions.select(*columns, "parts", "bin", own(turns, "turn")).select("*", all_of(blocks, "block"))

    def rerank(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if len(queries) and len(rows):
            vectors, names = np.stack(queries["v"]), queries["uid"].to_numpy()
            asks = np.stack(queries["parts"])
            every, uids, ids, parts = np.stack(rows["v"]), rows["uid"].to_numpy(), rows["id"].to_numpy(), rows["part"].to_numpy()
            some = [nearest(vectors[who], names[who], every[at], uids[at], ids[at], k) for p in np.unique(parts) if len(who := np.flatnonzero((asks == p).any(axis=1))) and len(at := np.flatnonzero(parts == p))]
            if some:
                found = [np.concatenate(x) for x in zip(*some, strict=True)]
                order = np.lexsort((found[1], found[2], found[0]))
                found = [x[order] for x in found]
                place = np.arange(len(order)) - np.searchsorted(found[0], found[0])
                found = [x[place < k] for x in found]
        return pd.DataFrame(dict(zip(("query", "vec_id", "score"), found, strict=True)))

    keys = ("bin", "block", "turn")
    found = questions.groupBy(*keys).cogroup(homes.groupBy(*keys)).applyInPandas(rerank, schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    best = found.select("query", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
    names = every.where("asked").select(F.col("uid").alias("query"), F.col("id").alias("query_id"))
    return best.join(names, "query").select("query_id", "rank", "vec_id", "score")


def bins(sizes: dict[int, int], parts: int, rows: int) -> tuple[list[int], dict[int, int]]:
    """(the bin of each part, how many blocks each bin has): parts in order share a bin while it has at most ``rows`` rows."""
    bin_of, held = [0] * parts, [0]
    for part in range(parts):
        size = sizes.get(part, 0)
        if held[-1] and held[-1] + size > rows:
            held.append(0)
        held[-1] += size
        bin_of[part] = len(held) - 1
    return bin_of, {i: max(1, -(-n // rows)) for i, n in enumerate(held)}


def brute_force(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, k: int = 10) -> dict[int, list[tuple[int, float]]]:
    """The true k nearest of small tables of different ids, for measuring recall."""
    asked = np.isin(ids, query_ids)
    found = nearest(rows[asked], ids[asked], rows, ids, ids, k)
    out: dict[int, list[tuple[int, float]]] = {}
    for q, v, s in zip(*(x.tolist() for x in found), strict=True):
        out.setdefault(int(q), []).append((int(v), s))
    return out
