"""Byte-level BPE by speculation and verification.

Greedy longest-match proposes the tokens of each word. A sequence of tokens is the BPE encoding of its bytes exactly if
every adjacent pair is compatible, that is, if merging both sides by rank never merges across their boundary; numpy tests
all different pairs of a batch at once. Only words with a failing pair go through the exact merges. Words seen before
come from a bounded cache. The tokenizer file is read once, on the driver, and broadcast (a few MB).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the pattern by which byte-level BPE of this family splits text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unassigned characters begin at U+0378; looking for those is slow, so only texts that reach so far are searched.
BEYOND = re.compile("[^\x00-\u0377]")
NEVER = np.int64(1) << 60
CACHE_WORDS = 400_000
SLICE_CHARS = 2_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself where printable, else 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def unsettled() -> regex.Pattern:
    """Characters that Python's Unicode tables don't assign: libraries with other tables may class them differently."""
    spans: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) == "Cn":
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return regex.compile("[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in spans) + "]")


class ByteTable:
    """Concatenates the byte strings of many ids without a loop over them."""

    def __init__(self, strings: list[bytes]) -> None:
        self.lengths = np.array([len(s) for s in strings], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        parts = []
        for lo in range(0, len(ids), 1 << 20):
            some = ids[lo : lo + (1 << 20)]
            lengths = self.lengths[some]
            ends = np.cumsum(lengths)
            index = np.repeat(self.starts[some] - ends + lengths, lengths)
            index += np.arange(len(index))
            parts.append(self.flat[index].tobytes())
        return b"".join(parts)


def vocabulary(content: dict) -> tuple[list[bytes], dict[str, int]]:
    """(the bytes of each id, the special tokens) of a tokenizers file."""
    letters = byte_letters()
    vocab, specials = content["model"]["vocab"], {x["content"]: x["id"] for x in content["added_tokens"]}
    bytes_of = [b""] * (max([*vocab.values(), *specials.values()]) + 1)
    for word, i in vocab.items():
        bytes_of[i] = bytes(letters[c] for c in word)
    for word, i in specials.items():
        bytes_of[i] = word.encode()
    return bytes_of, specials


class Bpe:
    """A byte-level BPE model from the content of a tokenizers file."""

    def __init__(self, spec: bytes) -> None:
        content = json.loads(spec)
        letters = byte_letters()
        vocab: dict[str, int] = content["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in content["model"]["merges"]]
        self.bytes_of, self.specials = vocabulary(content)
        self.size = len(self.bytes_of)
        self.byte_id = np.zeros(256, dtype=np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        self.rank = np.full(self.size, -1, dtype=np.int64)
        self.left = np.full(self.size, -1, dtype=np.int64)
        self.right = np.full(self.size, -1, dtype=np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if (x, y) not in self.merges:
                self.merges[x, y] = (r, z)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        keys = np.array([x * self.size + y for x, y in self.merges], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.merges.values()], dtype=np.int64)[order]
        self.sound = self._sound_tokens()
        self.whole: dict[bytes, int] = {}
        self.walk: dict[bytes, int] = {}
        for i in np.flatnonzero(self.sound):
            word = self.bytes_of[i]
            self.whole[word] = int(i)
            for n in range(1, len(word)):
                self.walk.setdefault(word[:n], -1)
        self.walk |= self.whole
        self.table = ByteTable(self.bytes_of)
        self.words = regex.compile(WORD_PATTERN)
        self.split_specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.cache: dict[str, bytes] = {}
        self.spec = spec
        self.slow = None

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def _separate(self, a: np.ndarray, b: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Whether no merge of a rank under ``before`` crosses the boundary of each pair.

        Walks back in time: the pair of symbols that meet at the boundary, then the one before the younger of them was
        made, and so on down to bytes. A symbol ends when its parent is made; of equal ranks the leftmost merges first.
        """
        a, b = a.copy(), b.copy()
        end_a, end_b = before.copy(), before.copy()
        good = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            rank = self._pair_rank(x, y)
            crossed = (rank < end_a[live]) & (rank <= end_b[live]) & (rank < before[live])
            good[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            first = rx > ry
            i, j = live[first], live[~first]
            end_a[i], a[i] = rx[first], self.right[x[first]]
            end_b[j], b[j] = ry[~first], self.left[y[~first]]
        return good

    def _sound_tokens(self) -> np.ndarray:
        """Tokens whose own bytes encode to them; merges can leave others in a vocabulary."""
        sound = np.zeros(self.size, dtype=bool)
        sound[self.byte_id] = True
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made])]
        apart = self._separate(self.left[made], self.right[made], self.rank[made])
        for i, fine in zip(made.tolist(), apart.tolist(), strict=True):
            sound[i] = fine and sound[self.left[i]] and sound[self.right[i]]
        return sound

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens can stand side by side in an encoding."""
        return self._separate(a, b, np.full(len(a), NEVER))

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        known = self.whole.get(word)
        if known is not None:
            return [known]
        walk, out, i, n = self.walk.get, [], 0, len(word)
        while i < n:
            j, best, found = i + 1, i + 1, -1
            while (t := walk(word[i:j])) is not None:
                if t >= 0:
                    found, best = t, j
                if j == n:
                    break
                j += 1
            out.append(found)
            i = best
        return out

    def merge(self, word: bytes) -> list[int]:
        """The exact merges, by rank and then from the left, in n log n."""
        ids = self.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        after, prior = [*range(1, n + 1)], [*range(-1, n - 1)]
        merges = self.merges
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                prior[k] = i
                if m := merges.get((made, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1], made, ids[k]))
            h = prior[i]
            if h >= 0 and (m := merges.get((ids[h], made))):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], made))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids, packed as little-endian 32-bit numbers."""
        proposed = [self.propose(w) for w in words]
        lengths = np.fromiter(map(len, proposed), dtype=np.int64, count=len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), dtype=np.int64, count=int(lengths.sum()))
        ends = np.cumsum(lengths)
        inner = np.ones(max(0, len(flat) - 1), dtype=bool)
        inner[ends[:-1] - 1] = False
        at = np.flatnonzero(inner)
        keys, back = np.unique(flat[at] * self.size + flat[at + 1], return_inverse=True)
        wrong = at[~self.compatible(keys // self.size, keys % self.size)[back]]
        packed = flat.astype("<u4").tobytes()
        out = [packed[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        for i in np.unique(np.searchsorted(ends, wrong, side="right")).tolist():
            out[i] = np.array(self.merge(words[i]), dtype="<u4").tobytes()
        return out

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii() or not BEYOND.search(text) or not unsettled().search(text):
            return self.words.findall(text)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.spec.decode()).pre_tokenizer
        return [text[lo:hi] for _, (lo, hi) in self.slow.pre_tokenize_str(text)]

    def _pieces(self, text: str) -> list[str | int]:
        if self.split_specials is None or not self.split_specials.search(text):
            return self.split(text)
        out: list[str | int] = []
        for i, part in enumerate(self.split_specials.split(text)):
            if i % 2:
                out.append(self.specials[part])
            elif part:
                out += self.split(part)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; strings of special tokens in it become those tokens."""
        pieces = [self._pieces(t) for t in texts]
        known = self.cache
        fresh = list({w for p in pieces for w in p if w not in known})
        if len(known) + len(fresh) > CACHE_WORDS:
            known.clear()
            fresh = list({w for p in pieces for w in p})
        special = [w for w in fresh if isinstance(w, int)]
        fresh = [w for w in fresh if not isinstance(w, int)]
        known.update(zip(fresh, self.encode_words([w.encode() for w in fresh]), strict=True))
        known.update((w, np.array([w], dtype="<u4").tobytes()) for w in special)
        return [np.frombuffer(b"".join(map(known.__getitem__, p)), dtype="<u4") for p in pieces]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        return self.table.join(ids).decode("utf-8", errors="replace")


_models: dict[str, Bpe] = {}


def model(spec: bytes) -> Bpe:
    """One model for each tokenizer in a Python worker."""
    name = hashlib.sha256(spec).hexdigest()
    if name not in _models:
        _models[name] = Bpe(spec)
    return _models[name]


def read_spec(path: str | None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as file:
        return file.read()


def slices(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts, null as empty, in runs of about SLICE_CHARS characters."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= SLICE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


OUTPUTS = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
_SPARK = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "decoded": T.StringType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def bpe_encode(docs: DataFrame, *, text_col: str = "text", tokenizer: str | None = None, outputs: tuple[str, ...] = ("ids", "n_tokens"), keep: list[str] | None = None) -> DataFrame:
    """Encodes every whole text as the tokenizers library does without added special tokens.

    ``outputs`` are any of ids, n_tokens, decoded (the ids decoded again, special tokens kept), and the SHA-256 digests
    ids_sha256 (decimal ids joined by commas) and decoded_sha256; ``keep`` the input columns to pass through (all but the
    text by default). Null text is an empty text, with no ids. Repeated rows give repeated rows, an empty table an empty
    result. Input columns named like an output are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in outputs and (keep is not None or c != text_col)]
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(shared.value)
        decimals = ByteTable([b"%d," % i for i in range(bpe.size)]) if "ids_sha256" in outputs else None
        for batch in batches:
            done = 0
            for texts in slices(batch.column(0).to_pylist()):
                encoded = bpe.encode(texts)
                columns = [c.slice(done, len(texts)) for c in batch.columns[1:]]
                done += len(texts)
                decoded = [bpe.decode(x) for x in encoded] if {"decoded", "decoded_sha256"} & {*outputs} else []
                for name in outputs:
                    if name == "ids":
                        offsets = np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int32)
                        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, "<u4"), *encoded]).astype(np.int32))))
                    elif name == "n_tokens":
                        columns.append(pa.array([len(x) for x in encoded], pa.int64()))
                    elif name == "decoded":
                        columns.append(pa.array(decoded, pa.string()))
                    elif name == "ids_sha256":
                        columns.append(pa.array([hashlib.sha256(decimals.join(x)[:-1]).hexdigest() for x in encoded]))
                    else:
                        columns.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *outputs])

    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, _SPARK[n]) for n in outputs)])
    return docs.select(docs[text_col].cast("string").alias("__text"), *keep).mapInArrow(encode, schema)


def bpe_decode(encoded: DataFrame, *, ids_col: str = "ids", output: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """Adds the text of each array of ids; null ids give a null text. An id outside the vocabulary raises."""
    encoded = encoded.drop(output)
    shared = encoded.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    at = encoded.columns.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(shared.value)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.array(x, dtype=np.int64)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, output])

    return encoded.mapInArrow(decode, T.StructType([*encoded.schema.fields, T.StructField(output, T.StringType())]))
