"""Shared helpers: working folders, and vectorised scanning of Arrow text columns."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Separators of the "blank-separated word" rule: 0x20 and 0x09-0x0D.
BLANKS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])

#: Bytes and rows of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES, STEP_ROWS = 1 << 19, 4096


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares (``spark.checkpoint.dir``).

    Where that setting is absent there is no folder that all executors see: an error on a cluster. A session on one
    machine (``local`` masters) gets a folder in its warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_sparkrag_work"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def lean(scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``scan`` for mapInArrow; at its end, memory that it freed goes back to the system, as Spark's workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from scan(batches)
        finally:
            release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what was freed
        pass


def cut(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and lost executors cost nothing."""
    path = work_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(filesystem, path) for a URI or a plain path, usable on driver and executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts: list[bytes] | bytes) -> int:
    """Write a file whole or not at all: under a name of its own first, then renamed, so retries are safe."""
    where, path = open_fs(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    size = 0
    with where.open_output_stream(own) as out:
        for part in [parts] if isinstance(parts, bytes) else parts:
            size += len(part)
            out.write(part)
    where.move(own, path)
    return size


def text_steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES, rows: int = STEP_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row count, bytes, offsets) for slices of a string column; null counts as empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    n = len(texts)
    if n == 0:
        return
    offsets, data = text_buffer(texts)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), first + rows, n)
        yield first, last - first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets as int64, bytes) of a string or binary array without copying; null slots get length zero."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    _, offs, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[list(BLANKS)] = False

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 256), _BASE, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each 64-bit value over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie one after another in ``data``: (starts, ends, text index, which bytes are inside)."""
    n = len(data)
    word = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = True
    np.logical_not(word[:-1], out=before[1:])
    before |= edge[:n]
    starts = np.flatnonzero(word & before)
    after = np.empty(n, bool)
    after[-1:] = True
    np.logical_not(word[1:], out=after[:-1])
    after |= edge[1:]
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1, word


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; ``word`` marks exactly the bytes inside spans."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    inside = data[word]
    index = np.arange(len(inside), dtype=np.int64) - np.repeat(at, lengths)
    value = _BYTE[inside]
    value *= _powers(int(lengths.max()) + 1)[index]
    return mix(np.add.reduceat(value, at) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of each blank-separated word after lower-casing A-Z."""
    starts, ends, text, word = spans(data, offsets)
    return span_hashes(LOWER[data], starts, ends, word), text


class HashIndex:
    """Open-addressing map from 64-bit hashes to 0, 1, 2, ... in order of insertion, worked on whole arrays."""

    def __init__(self, room: int = 1 << 16):
        self.size = 0
        self._grow(room)

    def _grow(self, room: int) -> None:
        old = self.keys[: self.size] if self.size else np.zeros(0, np.uint64)
        self.bits = max(8, int(room - 1).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros(1 << (self.bits - 1), np.uint64)
        self.keys[: len(old)] = old
        self._place(old, np.arange(len(old), dtype=np.int32))

    def _home(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _place(self, h: np.ndarray, index: np.ndarray) -> None:
        at, mask = self._home(h), (1 << self.bits) - 1
        while len(index):
            free = self.slot[at] < 0
            self.slot[at[free]] = index[free]
            left = self.slot[at] != index
            at, index = (at[left] + 1) & mask, index[left]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 where it is absent."""
        out = np.full(len(h), -1, np.int32)
        at, mask = self._home(h), (1 << self.bits) - 1
        slot = self.slot[at]
        hit = (slot >= 0) & (self.keys[slot] == h)
        out[hit] = slot[hit]
        rest = np.flatnonzero(~hit & (slot >= 0))
        at = at[rest]
        while len(rest):
            at = (at + 1) & mask
            slot = self.slot[at]
            hit = (slot >= 0) & (self.keys[slot] == h[rest])
            out[rest[hit]] = slot[hit]
            more = ~hit & (slot >= 0)
            rest, at = rest[more], at[more]
        return out

    def add(self, h: np.ndarray) -> None:
        """Insert distinct hashes that are absent."""
        if 2 * (self.size + len(h)) > len(self.slot):
            self._grow(4 * (self.size + len(h)))
        self.keys[self.size : self.size + len(h)] = h
        index = np.arange(self.size, self.size + len(h), dtype=np.int32)
        self.size += len(h)
        self._place(h, index)
