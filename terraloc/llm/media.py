"""Audio columns: 8-bit samples stored as WAV beside their tensors, and features of what is read back.

Features: polyphase resampling by UP / DOWN, log energies of BANDS overlapping mel filters over half-overlapping frames,
and segments of energy by hysteresis (a segment begins over the high threshold and ends under the low one). Tensors of
FRAMES x BANDS are Arrow fixed-shape tensors with their time spans, stored with each row's WAV; the features come from
the tensors that are read back.

Each row is handled by itself, by pieces of PIECE samples that continue one another, so that equal payloads give equal
values and memory is that of one row. The last frame is filled up with silence, so that each sample is in a frame. Defined cases: null texts are empty; payloads are padded with bytes 255 to a positive multiple of UNIT, so
that no file is empty; silent payloads (all samples equal) have no segments; rows without a doc_id keep their null; an
empty table gives an empty result; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloc.llm.common import binary_lists, save, table, utf8

UNIT = 576
RATE = 8000
UP, DOWN, TAPS = 3, 4, 12
FRAME, HOP, BANDS = 256, 128, 20
FRAMES = 32
PIECE = 1 << 20


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (UNIT - len(data) if not data else -len(data) % UNIT)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """One channel of unsigned 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples


def from_wav(data: bytes) -> tuple[bytes, int]:
    """Samples and rate; skips chunks other than fmt and data."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not one channel of 8-bit samples")
        elif name == b"data":
            return data[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@cache
def phases() -> np.ndarray:
    """The low-pass filter's taps by phase, newest sample last."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    h *= UP / h.sum()
    return np.stack([h[p::UP][::-1] for p in range(UP)]).astype(np.float32)


def resample(x: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """x at UP / DOWN times its rate; output m is the filter's phase m DOWN mod UP at input m DOWN // UP. before: the TAPS - 1 samples before x, silence if None."""
    count = -(-len(x) * UP // DOWN)
    out = np.empty(count, np.float32)
    wide = np.concatenate((np.zeros(TAPS - 1, np.float32) if before is None else before, x, np.zeros(DOWN, np.float32)))
    view = np.lib.stride_tricks.sliding_window_view(wide, TAPS)
    for r in range(UP):
        first, size = r * DOWN // UP, len(range(r, count, UP))
        out[r::UP] = view[first::DOWN][:size] @ phases()[r * DOWN % UP]
    return out


@cache
def mel_filters() -> np.ndarray:
    rate = RATE * UP / DOWN
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), BANDS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(x: np.ndarray) -> np.ndarray:
    """Frames x BANDS natural logs of energies; the last frame is filled up with silence."""
    x = np.pad(x, (0, FRAME - len(x) if len(x) < FRAME else -(len(x) - FRAME) % HOP))
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, out = np.hanning(FRAME).astype(np.float32), np.empty((len(view), BANDS), np.float32)
    for a in range(0, len(view), 4096):
        s = np.fft.rfft(view[a : a + 4096] * window, axis=1)
        out[a : a + 4096] = np.log(np.maximum((s.real**2 + s.imag**2).astype(np.float32) @ mel_filters(), 1e-6))
    return out


def segments(energy: np.ndarray) -> np.ndarray:
    """Starts and ends (in frames) of stretches that begin over mean + 0.5 sd and end under mean - 0.25 sd."""
    if not len(energy) or energy.std() < 1e-4:
        return np.zeros((0, 2), np.int64)
    mean, sd = energy.mean(), energy.std()
    mark = np.where(energy > mean + 0.5 * sd, 1, np.where(energy < mean - 0.25 * sd, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(at >= 0, mark[at], -1) > 0
    turn = np.diff(np.concatenate(([0], on.astype(np.int8), [0])))
    return np.stack((np.nonzero(turn > 0)[0], np.nonzero(turn < 0)[0]), 1)


def features(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and segments of 8-bit samples, by pieces."""
    frames, before, rest = [], None, np.zeros(0, np.float32)
    for a in range(0, len(samples), PIECE):
        x = (np.frombuffer(samples, np.uint8, count=min(PIECE, len(samples) - a), offset=a).astype(np.float32) - 128) / 128
        rest = np.concatenate((rest, resample(x, before)))
        last = a + PIECE >= len(samples)
        n = len(rest) if last else (len(rest) - FRAME) // HOP * HOP + FRAME
        frames.append(log_mel(rest[:n]))
        before, rest = x[1 - TAPS :], rest[n - FRAME + HOP :]  # the next frame begins a HOP after the last
    out = np.concatenate(frames)
    return out, segments(out.mean(1))


def feature_string(frames: np.ndarray, found: np.ndarray) -> str:
    """Frames, segments, seconds in segments, mean energies in eighths, and a digest of all energies in eighths."""
    eighths = np.rint(frames * 8).astype("<i2")
    mean = ",".join(str(int(v)) for v in np.rint(eighths.mean(0)))
    seconds = float((found[:, 1] - found[:, 0]).sum() * HOP / (RATE * UP / DOWN))
    return f"frames={len(frames)};segments={len(found)};active={seconds:.3f};mean={mean};digest={hashlib.blake2b(eighths.tobytes() + found.astype('<i8').tobytes(), digest_size=8).hexdigest()}"


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes as a WAV file."""

    def run(batches):
        for b in batches:
            data = binary_lists(b.column(1))
            yield pa.record_batch([b.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([to_wav(padded(x)) for x in data], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


STEP = HOP / (RATE * UP / DOWN)
TENSORS = "array<struct<start: double, end: double, active: double, values: array<float>>>"


def tensors(samples: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (seconds), shares of frames in segments, and FRAMES x BANDS numbers of each tensor, the last one filled up with the lowest energy."""
    frames, found = features(samples)
    on = np.zeros(len(frames), bool)
    for s, e in found.tolist():
        on[s:e] = True
    n = -(-len(frames) // FRAMES)
    wide = np.full((n * FRAMES, BANDS), np.log(np.float32(1e-6)), np.float32)
    wide[: len(frames)] = frames
    at = np.arange(n) * FRAMES
    ends = np.minimum(at + FRAMES, len(frames))
    return at * STEP, ends * STEP, np.array([on[s:e].mean() for s, e in zip(at, ends, strict=True)]), wide.reshape(n, FRAMES * BANDS)


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * FRAMES * BANDS), pa.array(values.ravel()))


def audio_tensors(stored: DataFrame) -> DataFrame:
    """doc_id, piece, start, end (seconds), active (share of frames in segments), values: FRAMES x BANDS numbers, the last ones filled up with the lowest energy."""

    def run(batches):
        for b in batches:
            for i, data in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist(), strict=True):
                start, end, active, values = tensors(from_wav(data)[0])
                n = len(start)
                yield pa.record_batch([pa.array([i] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int64)), pa.array(start), pa.array(end), pa.array(active, pa.float64()), _lists(values)], names=["doc_id", "piece", "start", "end", "active", "values"])

    return stored.mapInArrow(run, "doc_id long, piece long, start double, end double, active double, values array<float>")


def with_tensors(stored: DataFrame) -> DataFrame:
    """stored and the tensors of each row's media, so that repeated doc_ids keep theirs apart."""

    def run(batches):
        for b in batches:
            own = [tensors(from_wav(data)[0]) for data in b.column("media").to_pylist()]
            if not own:
                continue
            start, end, active, values = (np.concatenate(x) for x in zip(*own, strict=True))
            each = pa.StructArray.from_arrays([pa.array(start), pa.array(end), pa.array(active), _lists(values)], ["start", "end", "active", "values"])
            at = pa.array(np.cumsum([0, *(len(x[0]) for x in own)]).astype(np.int32))
            yield pa.record_batch([*b.columns, pa.ListArray.from_arrays(at, each)], names=[*b.schema.names, "tensors"])

    return stored.mapInArrow(run, f"doc_id long, n_bytes long, media binary, tensors {TENSORS}")


def stored_frames(column) -> list[np.ndarray]:
    """The frames of each row of the column `tensors`, without what fills up the last tensor."""
    each = column.flatten()
    values = each.field("values").flatten().to_numpy().reshape(-1, BANDS)
    ends = each.field("end").to_numpy()
    out, at = [], 0
    for n in column.value_lengths().to_pylist():
        out.append(values[at * FRAMES :][: round(ends[at + n - 1] / STEP)])
        at += n
    return out


def as_tensors(t: pa.Table) -> pa.Table:
    """A table of audio_tensors with its values as Arrow fixed-shape tensors."""
    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, BANDS))
    col = t.column("values").combine_chunks()
    flat = (pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col).flatten().cast(pa.float32())
    stored = pa.FixedSizeListArray.from_arrays(flat, FRAMES * BANDS)
    return t.set_column(t.column_names.index("values"), "values", pa.ExtensionArray.from_storage(kind, stored))


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(stored: DataFrame) -> DataFrame:
    """DIGESTS of what is read back from stored media, with features from their tensors where there are any."""
    kept = "tensors" in stored.columns

    def run(batches):
        for b in batches:
            out = []
            frames = stored_frames(b.column("tensors")) if kept else [None] * b.num_rows
            for data, own in zip(b.column("media").to_pylist(), frames, strict=True):
                samples, _ = from_wav(data)
                found = features(samples) if own is None else (own, segments(own.mean(1)))
                out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature_string(*found)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return stored.mapInArrow(run, DIGESTS)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(save(with_tensors(media(table(spark, sf_dir, "documents"))), "media", compression="zstd"))
