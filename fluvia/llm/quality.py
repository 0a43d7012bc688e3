"""A quality classifier by Bradley-Terry pairwise ranking.

Each preference pair is a document of label 1 and one of label 0. The probability that the first is the better is the
logistic function of the difference of their scores, which are linear in features of the text alone: hashed words and
byte trigrams of the whole text, and shares that describe its form. The fit minimises the logistic loss on feature
differences; the threshold is the quantile of the training scores at the share of label 0.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvia.session import slices

THRESHOLD = 0.7

_CLASS = np.zeros(256, dtype=np.uint8)
for _i, _chars in enumerate((b" \t\n\x0b\x0c\r", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".,;:?'\"()-", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~", bytes(range(128, 256)))):
    _CLASS[list(_chars)] = _i + 1
WHITE, UPPER, LOWER, DIGIT, STOP, SHOUT, BAR, SYMBOL, WIDE = range(1, 10)
NAMES = (
    "log_words", "word_bytes", "distinct", "repeated_next", "top_word", "top_ten", "upper", "digit", "stop", "shout", "bar", "symbol", "wide", "control", "symbol_ends", "shout_ends", "upper_words", "log_lines", "line_words", "bar_lines", "same_lines", "stop_words", "long_words",
)


WORD_BINS, TRIGRAM_BINS = 256, 128
#: Form features, their square roots, words, trigrams.
WIDTH = 2 * len(NAMES) + WORD_BINS + TRIGRAM_BINS
_BLOCK = 1 << 16


def contents(data: bytes, counts: Counter) -> np.ndarray:
    """Square roots of the shares of hashed words, lower-cased, and of hashed byte trigrams of a whole text."""
    words, trigrams = np.zeros(WORD_BINS), np.zeros(TRIGRAM_BINS)
    if counts:
        at = np.fromiter(map(zlib.crc32, map(bytes.lower, counts)), dtype=np.int64, count=len(counts)) % WORD_BINS
        words = np.bincount(at, weights=np.fromiter(counts.values(), dtype=float, count=len(counts)), minlength=WORD_BINS)
    for lo in range(0, len(data) - 2, _BLOCK):
        b = np.frombuffer(data[lo : lo + _BLOCK + 2], dtype=np.uint8).astype(np.uint32)
        mixed = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)
        trigrams += np.bincount(mixed >> np.uint32(25), minlength=TRIGRAM_BINS)
    return np.sqrt(np.concatenate([words / max(1, words.sum()), trigrams / max(1, trigrams.sum())]))


def features(text: str | None) -> np.ndarray:
    """Form and content of the whole text; one without words has zeros."""
    data = (text or "").encode()
    words = data.split()
    out = np.zeros(len(NAMES))
    if not words:
        return np.zeros(WIDTH, dtype=np.float32)
    n = len(words)
    kinds = _CLASS[np.frombuffer(data, dtype=np.uint8)]
    share = np.bincount(kinds, minlength=10) / len(kinds)
    ends = np.bincount(kinds[:-1][kinds[1:] == WHITE], minlength=10) + np.eye(10)[kinds[-1]]
    starts = np.bincount(kinds[1:][kinds[:-1] == WHITE], minlength=10)
    counts = Counter(words)
    top = counts.most_common(10)
    lines = [x for x in data.split(b"\n") if x.strip()]
    twice = np.count_nonzero((kinds[1:] == UPPER) & (kinds[:-1] == UPPER))
    out[:] = (
        np.log1p(n), np.log1p(sum(map(len, words)) / n), np.log1p(len(counts)) / np.log1p(n),
        sum(map(operator.eq, words, islice(words, 1, None))) / n, top[0][1] / n, sum(c for _, c in top) / n,
        share[UPPER], share[DIGIT], share[STOP], share[SHOUT], share[BAR], share[SYMBOL], share[WIDE], share[0],
        min(1.0, ends[SYMBOL] / n), min(1.0, ends[SHOUT] / n), twice / len(kinds),
        np.log1p(len(lines)), np.log1p(n / len(lines)), sum(b"|" in x for x in lines) / len(lines), 1 - len(set(lines)) / len(lines),
        min(1.0, ends[STOP] / n), min(1.0, starts[UPPER] / n),
    )
    # square roots tell small shares apart
    return np.concatenate([out, np.sqrt(np.maximum(out, 0)), contents(data, counts)]).astype(np.float32)


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def rank(self, rows: np.ndarray) -> np.ndarray:
        """Bradley-Terry scores; each row is summed alike, whatever stands beside it."""
        return (np.clip((rows.astype(float) - self.center) / self.scale, -8, 8) * self.weights).sum(axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """In 0 to 1, with the cut at THRESHOLD."""
        z = (self.rank(rows) - self.cut) / self.spread + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def penalties(ridge: float) -> np.ndarray:
    """Weights of hashed content pay more than those of form, as there are many."""
    return np.concatenate([np.full(2 * len(NAMES), ridge), np.full(WORD_BINS + TRIGRAM_BINS, 20 * ridge)])


def draw_pairs(labels: np.ndarray, pairs: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Preference pairs (better, worse): every labelled row is in one, however unequal the labels are."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    many = max(pairs, 2 * max(len(good), len(bad)))
    return np.concatenate([good, rng.choice(good, many - len(good))]), rng.permutation(np.concatenate([bad, rng.choice(bad, many - len(bad))]))


def fit_pairs(x: np.ndarray, i: np.ndarray, j: np.ndarray, ridge: np.ndarray, rounds: int = 50, block: int = 4096) -> np.ndarray:
    """Newton's method on the mean logistic loss of the differences x[i] - x[j], with a ridge; pairs are taken in blocks."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        gradient, curve = ridge * w, np.diag(ridge)
        for lo in range(0, len(i), block):
            apart = (x[i[lo : lo + block]] - x[j[lo : lo + block]]).astype(float)
            p = 1 / (1 + np.exp(-np.clip(apart @ w, -35, 35)))
            gradient = gradient + apart.T @ (p - 1) / len(i)
            curve = curve + (apart * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ apart / len(i)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5.0 / (np.linalg.norm(step) + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(rows: np.ndarray, labels: np.ndarray, *, pairs: int = 40_000, ridge: float = 1e-3, seed: int = 0) -> Model:
    """Bradley-Terry weights from drawn pairs, and the threshold.

    Without a document of either label there is nothing to compare: all scores are then equal and reach the threshold.
    """
    if not (labels == 1).any() or not (labels == 0).any():
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 1.0)
    center, scale = rows.mean(axis=0, dtype=float), rows.std(axis=0, dtype=float)
    scale[scale < 1e-6] = 1
    x = np.empty_like(rows, dtype=np.float32)
    for lo in range(0, len(rows), 1024):
        x[lo : lo + 1024] = np.clip((rows[lo : lo + 1024] - center) / scale, -8, 8)
    w = fit_pairs(x, *draw_pairs(labels, pairs, np.random.default_rng(seed)), penalties(ridge))
    ranks = x.astype(float) @ w
    cut = float(np.quantile(ranks, np.mean(labels == 0), method="midpoint"))
    return Model(center, scale, w, cut, float(max(ranks.std() / 4, 1e-6)))


def held_out(id_col: str) -> F.Column:
    """Rows whose labels no fit may see."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 20_000) -> Model:
    """Fits on at most ``most_rows`` labelled rows that are not held out, those of smallest id hash.

    Null ids or labels, and labels other than 0 and 1, are left out. An id with several labels or texts counts with each.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
    chosen = usable.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).orderBy(F.xxhash64("__id"), "__id", "__label").limit(most_rows)
    source = docs.select(F.col(text_col).cast("string").alias("__text"), F.col(id_col).alias("__doc")).join(F.broadcast(chosen), F.expr("__doc = __id"))  # most_rows small rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [features(t).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(rows, pa.binary())], names=["id", "label", "x"])

    schema = T.StructType([T.StructField("id", labels.schema[id_col].dataType), T.StructField("label", T.IntegerType()), T.StructField("x", T.BinaryType())])
    # most_rows vectors of 4 * WIDTH bytes: the copies of an id compete for places, by hash
    got = source.select("__text", "__id", "__label").mapInArrow(run, schema).orderBy(F.xxhash64("id"), "id", "label", "x").limit(most_rows).collect()
    return fit(np.frombuffer(b"".join(r["x"] for r in got), dtype=np.float32).reshape(-1, WIDTH), np.array([r["label"] for r in got], dtype=int))


OWN = ("held_out", "score", "predicted")


def score(docs: DataFrame, model: Model, *, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept columns (all by default), held_out, score (0 to 1, higher is better) and predicted (1 from THRESHOLD on).

    Null or blank text is scored as empty; equal texts score equal. Null ids are not held out. Repeated rows are scored
    each, an empty table gives an empty result; input columns named like an output are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in OWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = np.array([features(t) for t in batch.column(0).to_pylist()], dtype=np.float32).reshape(-1, WIDTH)
            found = model.score(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], names=[*keep, "__held", "score", "predicted"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("__held", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    scored = docs.select(docs[text_col].cast("string").alias("__text"), *keep, held_out(id_col).alias("__held")).mapInArrow(run, schema)
    return scored.select(*keep, F.col("__held").alias("held_out"), "score", "predicted")
