"""Audio columns: texts or other bytes as 8-bit samples, and features of stored samples.

- encode: bytes, padded with zeros to a positive multiple of 64, as a mono 8-bit
  PCM WAV file in a binary column.
- features: reads the WAV files back; polyphase resampling by UP/DOWN with a
  windowed-sinc filter; log-mel filterbanks over half-overlapping Hann frames;
  segments of high energy with hysteresis (on above one threshold, off below a
  lower one). The filterbanks become fixed-shape Arrow tensors of FRAMES x MELS,
  one row for each span of time, kept as an Arrow stream in a binary column.

Files are processed one by one. Signals and spectra are made in blocks of BLOCK_FRAMES
frames; of a file only its bytes and its filterbanks (four bytes for each and band) are
held whole. Equal files give equal values.

Defined results: null counts as empty, which becomes 64 zero bytes; an unreadable
file gives null features; an empty table gives an empty result; repeated rows are
treated alike; other columns than those asked for are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes

UNIT = 64
RATE = 8000
UP, DOWN, HALF_TAPS = 2, 3, 12
WINDOW, HOP, MELS = 128, 64, 20
#: Shape of a tensor: frames x mels.
FRAMES = 32
BLOCK_FRAMES = 4096
#: Energy thresholds in dB above the file's median, and the longest pause (frames) inside a segment.
ON_DB, OFF_DB, PAUSE = 1.5, 0.5, 2
FLOOR = 1e-8


def pad(data: bytes, unit: int = UNIT) -> bytes:
    return data + bytes(-len(data) % unit or (0 if data else unit))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    odd = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + bytes(odd)


def from_wav(data: bytes) -> tuple[bytes, int]:
    """Samples and rate of a mono 8-bit PCM file."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif kind == b"data":
            if rate is None or at + 8 + size > len(data):
                break
            return data[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _filter_phases() -> np.ndarray:
    """UP rows of taps: the polyphase parts of a Hann-windowed sinc."""
    n = np.arange(-HALF_TAPS * UP, HALF_TAPS * UP + 1)
    cut = 1.0 / max(UP, DOWN)
    taps = np.sinc(n * cut) * cut * (0.5 + 0.5 * np.cos(np.pi * n / (HALF_TAPS * UP + 1))) * UP
    padded = np.zeros((2 * HALF_TAPS + 1) * UP)
    padded[: len(taps)] = taps
    return padded.reshape(-1, UP).T[:, ::-1].astype(np.float32).copy()


def resampled(samples: np.ndarray, first: int, count: int, phases: np.ndarray) -> np.ndarray:
    """Output samples first..first+count of the resampled signal (zeros beyond the ends)."""
    out = np.arange(first, first + count) * DOWN
    phase, base = out % UP, out // UP
    low, high = int(base[0]) - HALF_TAPS, int(base[-1]) + HALF_TAPS + 1
    part = np.zeros(high - low, np.float32)
    a, b = max(low, 0), min(high, len(samples))
    if b > a:
        part[a - low : b - low] = (samples[a:b].astype(np.float32) - 128) / 128
    windows = np.lib.stride_tricks.sliding_window_view(part, 2 * HALF_TAPS + 1)
    result = np.empty(count, np.float32)
    for p in range(UP):
        mine = np.flatnonzero(phase == p)
        result[mine] = windows[base[mine] - HALF_TAPS - low] @ phases[p]
    return result


def _mel_bank(rate: float) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(WINDOW // 2 + 1) * rate / WINDOW
    up = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames x MELS, in dB."""
    out_rate = rate * UP / DOWN
    total = -(-len(samples) * UP // DOWN)
    n_frames = max(1, -(-(total - WINDOW) // HOP) + 1)
    phases, bank, hann = _filter_phases(), _mel_bank(out_rate), np.hanning(WINDOW + 1)[:-1].astype(np.float32)
    result = np.empty((n_frames, MELS), np.float32)
    for at in range(0, n_frames, BLOCK_FRAMES):
        count = min(BLOCK_FRAMES, n_frames - at)
        signal = resampled(samples, at * HOP, (count - 1) * HOP + WINDOW, phases)
        frames = np.lib.stride_tricks.sliding_window_view(signal, WINDOW)[::HOP] * hann
        power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
        result[at : at + count] = 10 * np.log10(power.astype(np.float32) @ bank + np.float32(FLOOR))
    return result


def segments(energy: np.ndarray) -> np.ndarray:
    """(start, end) frames of segments: on above median + ON_DB, off below median + OFF_DB; short pauses are bridged."""
    level = energy - np.median(energy)
    mark = np.where(level >= ON_DB, 1, np.where(level < OFF_DB, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = (last >= 0) & (mark[last] == 1)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    spans = edges.reshape(-1, 2)
    if len(spans) < 2:
        return spans
    cut = np.flatnonzero(spans[1:, 0] - spans[:-1, 1] > PAUSE)
    return np.stack((spans[np.concatenate(([0], cut + 1)), 0], spans[np.concatenate((cut, [len(spans) - 1])), 1]), axis=1)


def tensors(mel: np.ndarray, rate: int = RATE) -> pa.Table:
    """Rows of (start_s, end_s, log_mel): fixed-shape tensors FRAMES x MELS; the last is filled with the floor."""
    n = -(-len(mel) // FRAMES)
    padded = np.full((n * FRAMES, MELS), 10 * np.log10(FLOOR), np.float32)
    padded[: len(mel)] = mel
    second = rate * UP / DOWN
    start = np.arange(n) * FRAMES * HOP / second
    end = (np.minimum(np.arange(1, n + 1) * FRAMES, len(mel)) * HOP + WINDOW - HOP) / second
    tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(padded.reshape(n, FRAMES, MELS))
    return pa.table({"start_s": start, "end_s": end, "log_mel": tensor})


def to_stream(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue()


def from_stream(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_all()


def describe(mel: np.ndarray, spans: np.ndarray, table: pa.Table) -> str:
    values = table["log_mel"].combine_chunks().storage.flatten().to_numpy()
    rough = np.rint(values * 10).astype("<i4").tobytes()  # tenths of a dB
    return f"frames={len(mel)};tensors={len(table)};segments={len(spans)};active={int((spans[:, 1] - spans[:, 0]).sum())};mean_db={float(mel.mean(dtype=np.float64)):.1f};tensor={hashlib.sha256(rough).hexdigest()[:16]}"


def encode(rows: DataFrame, data_col: str, *keep: str) -> DataFrame:
    """keep columns, n_bytes (unpadded) and media (a WAV file) for a string or binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = as_bytes(batch.column(batch.num_columns - 1))
            media = pa.array([to_wav(pad(x)) for x in data], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(x) for x in data], pa.int64()), media], [*keep, "n_bytes", "media"])

    picked = rows.select(*keep, F.col(data_col).cast("binary").alias("__media_data"))
    schema = picked.drop("__media_data").schema.add("n_bytes", T.LongType()).add("media", T.BinaryType())
    return picked.mapInArrow(run, schema)


def features(rows: DataFrame, media_col: str = "media", *keep: str, with_tensors: bool = True) -> DataFrame:
    """keep columns; payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 of the stored file; tensors, segments and a short description."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found: list[list] = [[] for _ in range(8)]
                for media in as_bytes(part.column(part.num_columns - 1)):
                    row = [None, None, None, len(media), hashlib.sha256(media).hexdigest(), None, None, None]
                    try:
                        payload, rate = from_wav(media)
                    except ValueError:
                        payload = None
                    if payload is not None:
                        mel = log_mel(np.frombuffer(payload, np.uint8), rate)
                        spans = segments(mel.mean(axis=1))
                        table = tensors(mel, rate)
                        second = rate * UP / DOWN / HOP
                        row[:3] = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:])
                        row[5:] = describe(mel, spans, table), [[float(a / second), float(b / second)] for a, b in spans.tolist()] if with_tensors else None, to_stream(table) if with_tensors else None
                    for x, value in zip(found, row, strict=True):
                        x.append(value)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.float64())), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(x, k) for x, k in zip(found, kinds, strict=True)]], names)

    picked = rows.select(*keep, F.col(media_col).alias("__media_data"))
    schema = picked.drop("__media_data").schema
    texts, longs = ("payload_sha256", "media_sha256", "feature"), ("payload_bytes", "tail_crc32", "media_bytes")
    for name in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "spans", "tensors"):
        schema = schema.add(name, T.StringType() if name in texts else T.LongType() if name in longs else T.BinaryType() if name == "tensors" else T.ArrayType(T.ArrayType(T.DoubleType())))
    names = schema.names
    return picked.mapInArrow(run, schema)
