"""Media columns for audio: 8-bit WAV payloads, polyphase resampling, log-mel filterbanks, energy segments.

Features are a function of one stored file alone, computed in blocks of fixed size, so equal files give equal values.
Log-mel frames are cut into patches of fixed shape (PATCH_FRAMES, MELS), each with its time span. They are stored as an
Arrow record batch for each file, whose columns are a fixed-shape tensor and its start and end.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fluvia.session import materialize

RATE = 16_000
UP, DOWN = 5, 8  # to 10 kHz
TAPS = 16  # of each phase
WINDOW, HOP = 256, 128
MELS = 24
PATCH_FRAMES = 16
UNIT = 576
BLOCK_FRAMES = 8192


def pad_payload(data: bytes) -> bytes:
    """The data and bytes 255 up to a positive multiple of UNIT."""
    size = max(UNIT, -(-len(data) // UNIT) * UNIT)
    return data + b"\xff" * (size - len(data))


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    even = samples + b"\x80" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", 36 + len(even)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + even


def read_wav(file: bytes) -> tuple[bytes, int]:
    """The samples of a mono 8-bit PCM WAV file, and its rate; other files raise."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", file, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif name == b"data":
            if rate is None or at + 8 + size > len(file):
                raise ValueError("the WAV file is cut or out of order")
            return file[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("the WAV file has no data")


@cache
def phases() -> np.ndarray:
    """One column for each output phase of a windowed-sinc low-pass, over the input window that all phases share."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    kernel = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    kernel *= UP / kernel.sum()
    out = np.zeros((TAPS + DOWN, UP))
    for r in range(UP):
        base, phase = divmod(r * DOWN, UP)
        out[base : base + TAPS, r] = kernel[phase::UP][::-1]
    return out.astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """UP/DOWN times the rate: each DOWN input samples give UP outputs, one for each phase."""
    steps = -(-len(x) // DOWN)
    held = np.zeros(steps * DOWN + TAPS, dtype=np.float32)
    held[TAPS // 2 : TAPS // 2 + len(x)] = x
    out = np.empty((steps, UP), dtype=np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(held, TAPS + DOWN)[::DOWN]
    for lo in range(0, steps, BLOCK_FRAMES):
        np.matmul(np.ascontiguousarray(windows[lo : lo + BLOCK_FRAMES]), phases(), out=out[lo : lo + BLOCK_FRAMES])
    return out.ravel()[: -(-len(x) * UP // DOWN)]


@cache
def mel_bank() -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale up to half the rate."""
    rate = RATE * UP // DOWN
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    bins = np.arange(WINDOW // 2 + 1) * rate / WINDOW
    lower, center, upper = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((bins - lower) / (center - lower), (upper - bins) / (upper - center))).T.astype(np.float32)


@cache
def hann() -> np.ndarray:
    return np.hanning(WINDOW + 1)[:-1].astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel frames, their energies in dB) of overlapping windows; a short last window is filled with zeros."""
    count = max(1, -(-(len(x) - WINDOW) // HOP) + 1)
    held = np.zeros((count - 1) * HOP + WINDOW, dtype=np.float32)
    held[: len(x)] = x
    windows = np.lib.stride_tricks.sliding_window_view(held, WINDOW)[::HOP]
    mels, energy = np.empty((count, MELS), dtype=np.float32), np.empty(count, dtype=np.float32)
    for lo in range(0, count, BLOCK_FRAMES):
        spectrum = np.fft.rfft(windows[lo : lo + BLOCK_FRAMES] * hann(), axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        mels[lo : lo + BLOCK_FRAMES] = np.log10(power @ mel_bank() + 1e-6)
        energy[lo : lo + BLOCK_FRAMES] = 10 * np.log10(power.mean(axis=1) + 1e-6)
    return mels, energy


def segments(energy: np.ndarray, rise: float = 0.5, fall: float = -0.5) -> np.ndarray:
    """(first frame, frame after the last) of each active stretch, by hysteresis.

    A stretch begins where the energy passes mean + ``rise`` standard deviations and ends where it falls below
    mean + ``fall`` ones; in between the state stays.
    """
    spread = float(energy.std())
    mark = np.full(len(energy), -1, dtype=np.int8)
    mark[energy < energy.mean() + fall * spread] = 0
    mark[energy > energy.mean() + rise * spread] = 1
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    active = np.where(last >= 0, mark[last], 0)
    edges = np.flatnonzero(np.diff(active, prepend=0, append=0))
    return edges.reshape(-1, 2)


def analyze(samples: bytes) -> dict:
    """patches (n, PATCH_FRAMES, MELS), their spans in seconds, frames, segments in seconds, mean log-mel."""
    x = resample((np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128) / 128)
    mels, energy = log_mel(x)
    step = HOP * DOWN / (RATE * UP)
    many = -(-len(mels) // PATCH_FRAMES)
    patches = np.zeros((many * PATCH_FRAMES, MELS), dtype=np.float32)
    patches[: len(mels)] = mels
    starts = np.arange(many) * PATCH_FRAMES
    spans = np.stack([starts * step, np.minimum(starts + PATCH_FRAMES, len(mels)) * step], axis=1)
    return {"patches": patches.reshape(many, PATCH_FRAMES, MELS), "spans": spans, "frames": len(mels), "segments": segments(energy) * step, "mean": mels.mean(axis=0)}


def feature_text(found: dict) -> str:
    """A digest of the features, rounded."""
    active = float((found["segments"][:, 1] - found["segments"][:, 0]).sum())
    return f"frames={found['frames']};segments={len(found['segments'])};active={active:.2f};mel=" + ",".join(f"{v:.2f}" for v in found["mean"] + 0.0)


def store(docs: DataFrame, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns, n_bytes (before padding) and ``media``, the WAV file of each whole text; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(t or "").encode() for t in batch.column(0).to_pylist()]
            files = [write_wav(pad_payload(d)) for d in data]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([len(d) for d in data], pa.int64()), pa.array(files, pa.binary())], names=[*keep, "n_bytes", "media"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return docs.select(docs[text_col].cast("string").alias("__text"), *keep).mapInArrow(run, schema)


_FIELDS = {
    "payload_bytes": (pa.int64(), T.LongType()),
    "payload_sha256": (pa.string(), T.StringType()),
    "tail_crc32": (pa.int64(), T.LongType()),
    "media_bytes": (pa.int64(), T.LongType()),
    "media_sha256": (pa.string(), T.StringType()),
    "feature": (pa.string(), T.StringType()),
}
_SPANS = (pa.list_(pa.list_(pa.float64())), T.ArrayType(T.ArrayType(T.DoubleType())))
_TENSORS = {"tensors": (pa.binary(), T.BinaryType()), "segments": _SPANS}
#: The patches of a file: half-precision log-mel values and the span of each in seconds.
PATCH_TYPE = pa.fixed_shape_tensor(pa.float16(), [PATCH_FRAMES, MELS])
PATCH_SCHEMA = pa.schema([("patch", PATCH_TYPE), ("start", pa.float64()), ("end", pa.float64())])


def write_tensors(patches: np.ndarray, spans: np.ndarray) -> bytes:
    """Patches (n, PATCH_FRAMES, MELS) and their spans as an Arrow stream with one batch."""
    storage = pa.FixedSizeListArray.from_arrays(pa.array(patches.astype(np.float16).ravel()), PATCH_FRAMES * MELS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, PATCH_SCHEMA) as out:
        out.write_batch(pa.record_batch([pa.ExtensionArray.from_storage(PATCH_TYPE, storage), pa.array(spans[:, 0]), pa.array(spans[:, 1])], schema=PATCH_SCHEMA))
    return sink.getvalue().to_pybytes()


def read_tensors(data: bytes) -> pa.Table:
    """The stored patches: patch (a fixed-shape tensor), start and end."""
    return pa.ipc.open_stream(data).read_all()


def audio_features(stored: DataFrame, *, media_col: str = "media", tensors: bool = True) -> DataFrame:
    """Reads each stored file back and adds its digests and features; the media column is left out.

    With ``tensors``: tensors (what ``read_tensors`` reads: fixed-shape patches with their time spans) and segments
    (seconds). Input columns named like an output are replaced. Null media gives nulls; a file that is no 8-bit mono WAV
    raises.
    """
    fields = _FIELDS | (_TENSORS if tensors else {})
    keep = [c for c in stored.columns if c != media_col and c not in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = []
                for file in part.column(0).to_pylist():
                    if file is None:
                        rows.append(dict.fromkeys(fields))
                        continue
                    samples, _ = read_wav(file)
                    found = analyze(samples)
                    row = {"payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-32:]), "media_bytes": len(file), "media_sha256": hashlib.sha256(file).hexdigest(), "feature": feature_text(found)}
                    if tensors:
                        row |= {"tensors": write_tensors(found["patches"], found["spans"]), "segments": found["segments"].tolist()}
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array([r[n] for r in rows], t) for n, (t, _) in fields.items())], names=[*keep, *fields])

    schema = T.StructType([*(stored.schema[c] for c in keep), *(T.StructField(n, t) for n, (_, t) in fields.items())])
    return stored.select(media_col, *keep).mapInArrow(run, schema)


def audio_table(docs: DataFrame, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """Stores every text as a media table, reads that back, stores its features, and returns those.

    Kept columns, n_bytes, the digests, the feature text, ``tensors`` and ``segments`` of ``audio_features``. Null text is
    stored as empty. Repeated rows give repeated rows, an empty table an empty result.
    """
    media = materialize(store(docs, keep=keep, text_col=text_col), "media")
    return materialize(audio_features(media), "audio-features")
