"""Token-ID output: sorted-string-table shards.

``write`` range-partitions documents by identifier, encodes each text with a byte-level BPE vocabulary and
writes one immutable shard a partition: prefix-compressed key blocks, a sparse index with the first key of
each block, a Bloom filter and a footer. ``read`` gives the documents back in order, ``lookup`` finds one by
binary search in the sparse index, so it reads the footer, the index, the filter and one block.

Results that are fixed for odd input: a null text is an empty one (only the end id is stored); a null
identifier is a key of its own that sorts before all others; rows with the same identifier are all kept, in
order of their text; an empty table gives no shard and an empty manifest; further columns are ignored.

A shard holds, in this order: blocks, index, filter, footer. All integers are little-endian; a key is one tag
byte (0: null, 1: value) and, for a value, eight big-endian bytes of the identifier with its sign bit flipped,
so that the order of the bytes is the order of the numbers.

Every shard comes from one range partition of identifiers and, within one identifier, of the heads of texts; a task that runs again
writes a file of another name, and only the names in the manifest count, so lost executors do no harm.
"""

from __future__ import annotations

import bisect
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashIndex, lean, open_fs, span_hashes, text_steps, work_dir, write_file

MAGIC = b"SSTSHRD1"
FOOTER = struct.Struct("<QQQQQQBxxxxxxx8s")  # index at, index bytes, filter at, filter bytes, documents, ids, id bytes
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_PROBES = 10, 7
#: Distinct pieces that a worker remembers; then it starts anew. About 100 bytes each.
MOST_PIECES = 1 << 20

DEFAULT_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_KIND = np.zeros(256, np.uint8)  # 1 letter or digit, 2 punctuation, 3 newline or tab, 4 space; 0: anything else
for _b in range(0x21, 0x7F):
    _KIND[_b] = 1 if chr(_b).isalnum() else 2
_KIND[[0x09, 0x0A, 0x0D]] = 3
_KIND[0x20] = 4
_LATIN = np.zeros(256, bool)  # first bytes of U+00C0 to U+02FF: never white space
_LATIN[0xC3:0xCC] = True


class PieceEncoder:
    """Encodes texts piece by piece and remembers the ids of each distinct piece.

    Texts are cut only where the byte-level pre-tokeniser always begins a new token (ASCII only; other places just stay
    inside a piece). Its pattern takes, in this order: contractions, runs of letters, of digits, or of other visible
    characters, each with at most one space before it; white space up to the last character of its run, if more text
    follows; white space. So a token always begins
    - before a space that a visible character follows: the rest of the run before it, if any, ends there;
    - between a letter or digit and white space, or punctuation and white space, or a letter or digit and punctuation, as
      no alternative holds both in that order;
    - after a tab or newline that is alone between visible characters, as it is then a token by itself.
    The ids of the pieces, one after another, are the ids of the text. Pieces are found by a 64-bit hash and then compared
    byte by byte; should two share a hash, that step's texts are encoded whole.

    With ``added``, the vocabulary's added tokens (such as an end-of-text marker) get their own ids where a text holds
    them, as in the library's defaults: a text that holds one is encoded as a whole. Without, they are plain text.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        decoder = self.tokenizer.get_added_tokens_decoder() if hasattr(self.tokenizer, "get_added_tokens_decoder") else {}
        # tokens that aren't special are found in either case
        self.added = [t.content.encode() for t in decoder.values() if t.content and (added or not t.special)]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.whole = '"ByteLevel"' not in str(self.tokenizer.pre_tokenizer) and "ByteLevel(" not in str(self.tokenizer.pre_tokenizer)
        self.whole = self.whole or self.tokenizer.normalizer is not None
        self._forget()

    def _forget(self) -> None:
        self.index = HashIndex()
        self.flat = np.zeros(1 << 16, self.dtype)
        self.at = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int32)
        self.raw, self.raw_at, self.raw_used = np.zeros(1 << 18, np.uint8), np.zeros((1 << 14) + 1, np.int64), 0
        self.used = 0

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in pieces], add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int32, len(ids))
        first, total = self.index.size, int(counts.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(ids) > len(self.at):
            self.at, self.count = np.concatenate([self.at, self.at]), np.concatenate([self.count, self.count])
            self.raw_at = np.concatenate([self.raw_at, np.zeros(len(self.raw_at) - 1, np.int64)])
        size = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        while self.raw_used + int(size[-1]) > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        self.raw[self.raw_used : self.raw_used + int(size[-1])] = np.frombuffer(b"".join(pieces), np.uint8)
        self.raw_at[first + 1 : first + len(ids) + 1] = self.raw_used + size
        self.raw_used += int(size[-1])
        self.flat[self.used : self.used + total] = np.fromiter((x for own in ids for x in own), self.dtype, total)
        self.at[first : first + len(ids)] = self.used + np.cumsum(counts) - counts
        self.count[first : first + len(ids)] = counts
        self.used += total
        self.index.add(hashes)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(texts, np.int64)
        if self.whole:
            return self._encode_whole(data, offsets)
        if not (holds := self._holding(data, offsets)).any():
            return self._encode_pieces(data, offsets)
        edges = [0, *(np.flatnonzero(np.diff(holds)) + 1).tolist(), texts]
        parts = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = self._encode_whole if holds[a] else self._encode_pieces
            parts.append(own(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([counts for _, counts in parts])

    def _holding(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts hold an added token."""
        holds = np.zeros(len(offsets) - 1, bool)
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, side="right")) - 1
                inside = at + len(token) <= offsets[i + 1]
                holds[i] |= inside
                at = raw.find(token, int(offsets[i + 1]) if inside else at + 1)
        return holds

    def _encode_whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], add_special_tokens=False)]
        return np.array([x for own in ids for x in own], self.dtype), np.array([len(x) for x in ids], np.int64)

    def _encode_pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(texts, np.int64)
        kind = _KIND[data]
        cut = np.zeros(len(data) + 1, bool)
        here, last = kind[1:], kind[:-1]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # what follows there is another text's
        cut[1:-2] = (here[:-1] == 4) & ((kind[2:] == 1) | (kind[2:] == 2) | _LATIN[data[2:]]) & ~edge[2:-1]
        alone = edge[:-2].copy()  # white space that nothing of the kind comes before
        alone[1:] |= (kind[:-2] == 1) | (kind[:-2] == 2)
        cut[1:-1] |= ((here == 2) & (last == 1)) | ((here >= 3) & ((last == 1) | (last == 2))) | ((last == 3) & alone & ((here == 1) | (here == 2)))
        cut[offsets] = True
        cut[-1] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        hashes = span_hashes(data, starts, ends, np.ones(len(data), bool))
        if self.index.size > MOST_PIECES:
            self._forget()
        found = self.index.find(hashes)
        if len(new := np.flatnonzero(found < 0)):
            keys, first = np.unique(hashes[new], return_index=True)
            raw = data.tobytes()
            self._learn(keys, [raw[starts[i] : ends[i]] for i in new[first].tolist()])
            found[new] = self.index.find(hashes[new])
        # pieces lie one after another in ``data``, without a gap
        same = (self.raw_at[found + 1] - self.raw_at[found] == ends - starts).all()
        if not same or not (self.raw[np.arange(len(data)) + np.repeat(self.raw_at[found] - starts, ends - starts)] == data).all():
            return self._encode_whole(data, offsets)
        counts = self.count[found].astype(np.int64)
        begin = np.cumsum(counts) - counts
        total = int(counts.sum())
        ids = self.flat[np.arange(total) + np.repeat(self.at[found] - begin, counts)]
        of_piece = np.searchsorted(offsets, starts, side="right") - 1
        return ids, np.bincount(of_piece, weights=counts, minlength=texts).astype(np.int64)


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, added: bool = False) -> PieceEncoder:
    """The worker's encoder; it stays for later tasks of the same worker."""
    if (path, added) not in _ENCODERS:
        _ENCODERS[path, added] = PieceEncoder(path, added)
    return _ENCODERS[path, added]


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


class ShardWriter:
    """Collects documents in key order and writes compressed blocks as they fill."""

    def __init__(self, out, id_bytes: int, block_bytes: int = BLOCK_BYTES):
        self.out, self.id_bytes, self.block_bytes = out, id_bytes, block_bytes
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.block, self.filled, self.first, self.last = [], 0, b"", b""
        self.index, self.keys, self.at, self.docs, self.ids = [], [], 0, 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.filled and self.filled + len(value) > self.block_bytes:
            self._flush()
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block.append(struct.pack("<BBI", shared, len(key) - shared, len(value)) + key[shared:] + value)
        self.filled += len(value) + 6
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.ids += len(value) // self.id_bytes

    def _flush(self) -> None:
        packed = self.pack(b"".join(self.block))
        self.out.write(packed)
        self.index.append(struct.pack("<BQI", len(self.first), self.at, len(packed)) + self.first)
        self.at += len(packed)
        self.block, self.filled = [], 0

    def close(self) -> None:
        if self.block:
            self._flush()
        index = struct.pack("<I", len(self.index)) + b"".join(self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_bytes = struct.pack("<Q", bits) + bloom.tobytes()
        self.out.write(index)
        self.out.write(bloom_bytes)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom_bytes), self.docs, self.ids, self.id_bytes, MAGIC))


class ShardReader:
    """Random and sequential access to one shard."""

    def __init__(self, uri: str):
        where, path = open_fs(uri)
        self.file = where.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - FOOTER.size)
        index_at, index_len, bloom_at, bloom_len, self.docs, self.ids, self.id_bytes, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        raw = self._at(index_at, index_len)
        self.first_keys, self.blocks = [], []
        at = 4
        for _ in range(struct.unpack_from("<I", raw)[0]):
            n, where_, length = struct.unpack_from("<BQI", raw, at)
            at += 13
            self.first_keys.append(raw[at : at + n])
            self.blocks.append((where_, length))
            at += n
        bloom = self._at(bloom_at, bloom_len)
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]
        self.dtype = np.dtype(f"<u{self.id_bytes}")

    def _at(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        raw = zstandard.ZstdDecompressor().decompress(self._at(*self.blocks[i]))
        at, key = 0, b""
        while at < len(raw):
            shared, own, length = struct.unpack_from("<BBI", raw, at)
            at += 6
            key = key[:shared] + raw[at : at + own]
            at += own
            yield key, raw[at : at + length]
            at += length

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.blocks)):
            for key, value in self._block(i):
                yield id_of(key), np.frombuffer(value, self.dtype)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of a document (the first, should its identifier repeat), or None."""
        key = key_of(doc_id)
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return None
        # a repeated key can begin in the block before the first one that starts with it
        i = max(bisect.bisect_left(self.first_keys, key) - 1, 0)
        for j in range(i, len(self.blocks)):
            if self.first_keys[j] > key:
                break
            for k, value in self._block(j):
                if k == key:
                    return np.frombuffer(value, self.dtype)
        return None


MANIFEST = "shard int, path string, min_id long, max_id long, n_docs long, n_ids long"


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """Write shards of ``docs`` below ``folder`` and return the manifest, one row a shard in key order.

    ``added`` as for ``PieceEncoder``: the query and the pipeline set it, so their ids are those of the library's defaults.
    """
    spark, path = docs.sparkSession, tokenizer or tokenizer_path()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        writer = out = None
        uri = f"{folder}/shard-{part:06d}-{os.urandom(4).hex()}.sst"
        low = high = None
        enc = encoder(path, added)
        kind = np.dtype(enc.dtype).newbyteorder("<")
        end = np.array([] if end_id is None else [end_id], kind).tobytes()
        for batch in batches:
            for first, n, data, offsets in text_steps(batch, "text"):
                ids, counts = enc.encode(data, offsets)
                raw = ids.astype(kind, copy=False).tobytes()
                at = np.concatenate([[0], np.cumsum(counts)]) * kind.itemsize
                for j, doc_id in enumerate(batch.column(0).slice(first, n).to_pylist()):
                    if writer is None:
                        where, local = open_fs(uri)
                        where.create_dir(local.rpartition("/")[0], recursive=True)
                        out = where.open_output_stream(local)
                        writer, low = ShardWriter(out, kind.itemsize), doc_id
                    writer.add(key_of(doc_id), raw[at[j] : at[j + 1]] + end)
                    high = doc_id
        if writer is not None:
            writer.close()
            out.close()
            yield pa.record_batch([[part], [uri], [low], [high], [writer.docs], [writer.ids]], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("min_id", pa.int64()), ("max_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # the head of the text splits a hot identifier over shards; equal heads stay together, so shards follow one another in order
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first(), F.substring("text", 1, 32).asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
    manifest = f"{folder}/manifest"
    rows.mapInArrow(lean(shard), MANIFEST).write.mode("overwrite").parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest).orderBy("shard")


def read(manifest: DataFrame, digests_only: bool = False) -> DataFrame:
    """Documents of the shards: doc_id, start, n_tokens and ids (or, for digests, ids_crc32 in their place).

    ``start`` counts the ids of all documents before. The manifest has one row a shard, so the prefix sums
    over it are made on the driver; each shard is then read by a task of its own.
    """
    spark = manifest.sparkSession
    shards, before = [], 0
    for row in manifest.orderBy("shard").collect():
        shards.append((row.path, before))
        before += row.n_ids
    last = pa.field("ids_crc32", pa.int64()) if digests_only else pa.field("ids", pa.list_(pa.int64()))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held = ([], [], [], []), 0
                for doc_id, ids in ShardReader(uri):
                    value = zlib.crc32(ids.astype("<u4").tobytes()) if digests_only else ids.astype(np.int64)
                    for column, x in zip(rows, (doc_id, start, len(ids), value), strict=True):
                        column.append(x)
                    start += len(ids)
                    held += 64 if digests_only else len(ids)
                    if held > 1 << 20:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
                        rows, held = ([], [], [], []), 0
                if rows[0]:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    files = spark.createDataFrame(shards, "path string, start long").repartition(max(1, len(shards))) if shards else spark.createDataFrame([], "path string, start long")
    return files.mapInArrow(lean(scan), "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digests_only else "ids array<long>"))


def lookup(manifest_rows: list, doc_id: int | None) -> np.ndarray | None:
    """The ids of one document: binary search over the shards' ranges, then over one shard's index."""
    key = key_of(doc_id)
    i = bisect.bisect_left([key_of(r["max_id"]) for r in manifest_rows], key)
    return ShardReader(manifest_rows[i]["path"]).get(doc_id) if i < len(manifest_rows) and key_of(manifest_rows[i]["min_id"]) <= key else None


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write(docs, work_dir(spark, "sstable"), added=True)
    return read(manifest, digests_only=True)
