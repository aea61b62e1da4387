"""Audio features: polyphase resampling, overlapped log-mel filterbanks, hysteresis energy segments.

``store`` keeps payloads as 8-bit mono PCM in RIFF/WAVE form, ``save_features`` reads the stored bytes back and writes,
for each clip, the time spans in which the energy stays up, and a tensor for every ``PATCH_FRAMES`` frames, as Arrow
files with a column of type list<fixed_shape_tensor[PATCH_FRAMES, MELS]> (half floats): one file a task, listed in a
manifest, which alone counts when a task has run twice. ``load_features`` reads these files back as a Spark table and
``open_features`` one of them as an Arrow table.

Resampling by L/M splits the low-pass filter into L phases and computes only the samples that are kept. A clip is
worked on by itself in steps of fixed length, so equal payloads give equal bits wherever they lie in a batch, and
memory is bounded by the clip's own bytes plus one step.

Fixed results: a null text is an empty one; every payload has at least one unit of padding; a clip shorter than a
window is one frame, filled with silence; a silent or constant clip has no span; an empty table stays empty;
repeated rows are computed each on its own; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, open_fs, text_steps, work_dir

RATE, TARGET_RATE = 16_000, 6_000
UNIT = 192
WINDOW, HOP, FFT, MELS = 192, 96, 256, 24
PATCH_FRAMES = 32
TAPS = 16  # of each phase
STEP_FRAMES = 512
ON_DB, OFF_DB, LEAST_FRAMES = 3.0, -1.0, 3  # against the clip's median frame; shorter spans are dropped


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """RIFF/WAVE, PCM, one channel, 8 bits; samples of odd number get RIFF's pad byte."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(samples) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * (len(samples) % 2)


def unwav(media: bytes) -> tuple[int, memoryview]:
    """(sample rate, samples) of a file of that form; other chunks are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE bytes")
    at, rate = 12, None
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is stored here")
        elif kind == b"data":
            return rate, memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(8)
def phases(rate: int, target: int, taps: int = TAPS) -> tuple[int, int, np.ndarray]:
    """(L, M, filter phases [L, taps]) for resampling from ``rate`` to ``target``: a Hamming-windowed sinc."""
    up, down = target // gcd(rate, target), rate // gcd(rate, target)
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cutoff = 1 / max(up, down)
    h = np.sinc(t * cutoff) * cutoff * np.hamming(n)
    return up, down, np.ascontiguousarray((h * up / h.sum()).reshape(taps, up).T.astype(np.float32))


def resample(x: np.ndarray, rate: int = RATE, target: int = TARGET_RATE) -> np.ndarray:
    """Polyphase resampling: output n takes phase (n*M) mod L of the filter at input (n*M) div L."""
    if rate == target:
        return x
    up, down, h = phases(rate, target)
    taps = h.shape[1]
    n = max(1, -(-len(x) * up // down))
    padded = np.concatenate([np.zeros(taps // 2, np.float32), x, np.zeros(taps + down, np.float32)])
    out = np.empty(n, np.float32)
    for r in range(min(up, n)):
        own = len(range(r, n, up))
        first, phase = r * down // up, r * down % up
        total = np.zeros(own, np.float32)
        for k in range(taps):
            begin = first + taps - 1 - k
            total += h[phase, k] * padded[begin : begin + (own - 1) * down + 1 : down]
        out[r::up] = total
    return out


@lru_cache(4)
def mel_weights(rate: int = TARGET_RATE, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangular filters, equally spaced in mel, as a matrix [fft / 2 + 1, mels]."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(20), to_mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, fft // 2 + 1)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.ascontiguousarray(np.maximum(0, np.minimum(up, down)).astype(np.float32))


_WINDOW = np.hanning(WINDOW + 1)[:-1].astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel [frames, MELS], energy in dB [frames]) of overlapped windows."""
    frames = 1 + max(0, -(-(len(x) - WINDOW) // HOP))
    x = np.concatenate([x, np.zeros((frames - 1) * HOP + WINDOW - len(x), np.float32)]) if len(x) < (frames - 1) * HOP + WINDOW else x
    view = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP][:frames]
    mel, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for a in range(0, frames, STEP_FRAMES):
        part = view[a : a + STEP_FRAMES] * _WINDOW
        spectrum = np.fft.rfft(part, FFT, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mel[a : a + len(part)] = np.log10(np.einsum("fk,km->fm", power, mel_weights()) + 1e-6)  # unlike BLAS, the same bits on any number of threads
        energy[a : a + len(part)] = 10 * np.log10(power.sum(1) / FFT + 1e-6)
    return mel, energy


def segments(energy: np.ndarray, on: float = ON_DB, off: float = OFF_DB, least: int = LEAST_FRAMES) -> list[tuple[int, int]]:
    """Hysteresis: a span begins where energy rises over ``on`` and ends where it falls under ``off``, against the median."""
    e = energy - np.median(energy)
    mark = np.where(e > on, 1, np.where(e < off, 0, -1))
    at = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(e)), -1))
    state = np.where(at >= 0, mark[at], 0)
    edge = np.diff(np.concatenate([[0], state, [0]]))
    return [(int(a), int(b)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) if b - a >= least]


def analyse(media: bytes) -> tuple[bytes, int, list[tuple[float, float]]]:
    """(tensor bytes, frames, spans in seconds) of one stored clip."""
    rate, samples = unwav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x - x.mean(), rate))
    frames = len(mel)
    full = -(-frames // PATCH_FRAMES) * PATCH_FRAMES
    tensor = np.zeros((full, MELS), np.float16)
    tensor[:frames] = mel
    tick = HOP / TARGET_RATE
    return tensor.tobytes(), frames, [(round(a * tick, 3), round(b * tick, 3)) for a, b in segments(energy)]


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, filled up with blanks to a multiple of ``unit``, as WAVE."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, offsets in text_steps(batch, "text"):
                raw, sizes = data.tobytes(), np.diff(offsets)
                media = [wav(raw[a : a + s] + b" " * (max(unit, -(-s // unit) * unit) - s)) for a, s in zip(offsets[:-1].tolist(), sizes.tolist(), strict=True)]
                yield pa.record_batch([batch.column(0).slice(first, n), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(encode), "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, spans array<struct<start_s:double,end_s:double>>, patches binary"
TENSOR = pa.fixed_shape_tensor(pa.float16(), [PATCH_FRAMES, MELS])
_SPANS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
_PLAIN = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_frames", pa.int64()), ("spans", _SPANS)]
STORED = pa.schema([*_PLAIN, ("patches", pa.list_(TENSOR))])
BATCH_BYTES = 4 << 20  # of tensors that are held before they are written


def _stored_batch(rows: list[dict], tensors: list[bytes]) -> pa.RecordBatch:
    plain = pa.RecordBatch.from_pylist(rows, schema=pa.schema(_PLAIN))
    one = 2 * PATCH_FRAMES * MELS
    flat = pa.FixedSizeListArray.from_arrays(pa.array(np.frombuffer(b"".join(tensors), np.float16), pa.float16()), PATCH_FRAMES * MELS)
    offsets = np.concatenate([[0], np.cumsum([len(x) // one for x in tensors])]).astype(np.int32)
    patches = pa.ListArray.from_arrays(pa.array(offsets), pa.ExtensionArray.from_storage(TENSOR, flat))
    return pa.record_batch([*plain.columns, patches], schema=STORED)


def save_features(stored: DataFrame, folder: str) -> DataFrame:
    """Write the features of stored clips, with digests of what was read back, below ``folder``; the manifest (path, n_clips)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = sink = None
        uri, clips = f"{folder}/part-{TaskContext.get().partitionId():06d}-{os.urandom(4).hex()}.arrow", 0
        rows, tensors, held = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                media = batch.column(2)[i].as_py()
                _, samples = unwav(media)
                tensor, frames, found = analyse(media)
                rows.append({"doc_id": batch.column(0)[i].as_py(), "n_bytes": batch.column(1)[i].as_py(), "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-16:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "n_frames": frames, "spans": [{"start_s": a, "end_s": b} for a, b in found]})
                tensors.append(tensor)
                held += len(tensor) + 256
                if held > BATCH_BYTES:
                    if out is None:
                        sink, out = _open_sink(uri)
                    out.write_batch(_stored_batch(rows, tensors))
                    clips += len(rows)
                    rows, tensors, held = [], [], 0
        if rows:
            if out is None:
                sink, out = _open_sink(uri)
            out.write_batch(_stored_batch(rows, tensors))
            clips += len(rows)
        if out is not None:
            out.close()
            sink.close()
            yield pa.record_batch([pa.array([uri]), pa.array([clips], pa.int64())], names=["path", "n_clips"])

    manifest = f"{folder}/manifest"
    stored.select("doc_id", "n_bytes", "media").mapInArrow(lean(scan), "path string, n_clips long").write.mode("overwrite").parquet(manifest)
    return stored.sparkSession.read.schema("path string, n_clips long").parquet(manifest)


def _open_sink(uri: str):
    where, path = open_fs(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    sink = where.open_output_stream(path)
    return sink, pa.ipc.new_file(sink, STORED, options=pa.ipc.IpcWriteOptions(compression="zstd"))


def _read_batches(uri: str) -> Iterator[pa.RecordBatch]:
    where, path = open_fs(uri)
    with where.open_input_file(path) as f:
        reader = pa.ipc.open_file(f)
        if reader.schema != STORED:
            raise ValueError(f"{uri} doesn't hold {STORED}")
        for i in range(reader.num_record_batches):
            yield reader.get_batch(i)


def open_features(uri: str) -> pa.Table:
    """One file as an Arrow table whose ``patches`` are fixed-shape tensors."""
    return pa.Table.from_batches(_read_batches(uri), STORED)


def load_features(manifest: DataFrame) -> DataFrame:
    """The features of all files of a manifest; ``patches`` holds the bytes of a clip's tensors, one after another."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                for own in _read_batches(uri):
                    lists = own.column(len(_PLAIN))
                    flat = lists.flatten().storage.flatten().to_numpy(zero_copy_only=False).astype(np.float16, copy=False)
                    at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]) * PATCH_FRAMES * MELS
                    tensors = pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                    yield pa.record_batch([*own.columns[: len(_PLAIN)], tensors], names=[*(n for n, _ in _PLAIN), "patches"])

    return manifest.select("path").repartition("path").mapInArrow(lean(scan), FEATURES)


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "audio")
    store(spark.read.parquet(f"{sf_dir}/documents.parquet")).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/media")
    stored = spark.read.schema("doc_id long, n_bytes long, media binary").parquet(f"{folder}/media")
    found = load_features(save_features(stored, f"{folder}/features"))
    seconds = F.aggregate("spans", F.lit(0.0), lambda s, x: s + x.end_s - x.start_s)
    feature = F.concat_ws(":", "n_frames", F.size("spans").cast("string"), F.format_number(seconds, 3), F.substring(F.sha2("patches", 256), 1, 16))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
