"""N-gram Jaccard join by parity sketches: exact, without comparing all pairs.

A document's set holds its distinct shingles of ``SHINGLE`` words. Its parity sketch XORs the hashes of the shingles
into segments: a shingle belongs to one of m segments and toggles that segment's bits. Sets that differ in d shingles
differ in at most d segments, so the number of differing segments is a lower bound of the symmetric difference. Sets
of sizes a <= b that are similar enough (intersection over union >= 3/4) have b <= 4a/3 and d <= (a+b)/7. By the
pigeonhole principle, of the segments that hold anything, all but d agree: if each set issues the first
(largest possible d) + 1 of them in an order that is the same everywhere, both issue a common one.

Sizes fall into bands that are 4 wide; a band fixes m, and a set within 4/3 of a band's lower end also issues keys for
the band below. Sets under 128 get a segment for each shingle. For larger ones m is three times the largest d, which
leaves a set with too few filled segments a chance under 1e-25, less than that of equal 64-bit hashes. Segments full
of frequent shingles come last in the order, so a passage that many documents share makes no common key of its own.

Then, over classes of documents with equal sets:
1. keys travel packed by the thousand, in numpy arrays, to the bucket that their hash names; classes that meet at a key
   are a group; groups with the same members are one;
2. members of a group whose sizes and dense sketches allow a link are joined, and what is joined makes clusters, as
   components of a distributed edge table. Links lie within clusters;
3. a cluster of at most ``CLUSTER_ITEMS`` shingles and ``CLUSTER_CLASSES`` classes goes to one task, each set once, and is
   solved exactly there by a breadth-first search: a class that was reached is compared, by posting lists, with all that
   weren't yet;
4. larger clusters are solved without bringing them together, in rounds: each class nominates its nearest leader (a few
   members of a cluster, chosen by hash, that every block of it meets), then the nearest classes of its groups that lie in
   other components, by dense sketches whose Hamming distance also rules out pairs that are too far apart;
   sets are compared exactly, and links make components. Groups that lie in one component drop out; the last round
   compares all pairs that remain across components, in blocks of bounded size, by sketch first and exact sets after.

Pairs within a component can add nothing, so neither way tests them.
A group of more than ``BLOCK`` members is dealt out in blocks in steps 2 and 4, whatever its size.
So no link between components is lost, while copies are never expanded to pairs. Nothing is collected on the driver
but counts and at most ``MOST_FREQUENT`` hashes of frequent shingles, which only affect the order of keys.

Fixed results: a null text, or one without words, has an empty set, is linked with nothing and is its own component;
rows with equal ids are rows of their own; a text of fewer words than a shingle is one shingle; a null id never names
a component that has another; an empty table stays empty; further columns are ignored by ``link`` and kept by ``dedup``.
Memory grows with the longest single text (about 60 bytes a byte).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, lean, mix, text_buffer, text_steps, word_hashes
from .components import components

SHINGLE = 5
SMALL = 128
WIDE = 4
SKETCH_BITS = 4096
#: What one task solves: clusters of at most so many shingles (8 MB) and so many classes.
CLUSTER_ITEMS, CLUSTER_CLASSES = 1_000_000, 4096
#: How many of its nearest classes a class is compared with in each round: first among the leaders of its group, ...
ROUNDS = ("leaders", 8, None)  # ... in the last one, with all that remain
BLOCK = 2048  # members of a group that one step takes from either side
LEADERS = 16  # members of a larger group, on average, that all its blocks are compared with first
MOST_SENT = 200_000  # classes in clusters whose names (24 bytes each) are broadcast rather than joined by a shuffle of texts
FLUSH = 1 << 19  # keys that a task holds before it packs them
BUCKET_KEYS = 1 << 18  # keys that one step brings together
MOST_FREQUENT = 100_000
COUNTED = 1 << 18  # distinct shingles a task that are counted at once; rare ones make room as it fills

_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes in ascending order within each text, number of them for each text)."""
    n = len(offsets) - 1
    words, of = word_hashes(data, offsets)
    count = np.bincount(of, minlength=n)
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    begin, out_at = np.cumsum(count) - count, np.cumsum(made) - made
    total = int(made.sum())
    if not total:
        return np.zeros(0, np.uint64), made
    text = np.repeat(np.arange(n), made)
    first = begin[text] + np.arange(total) - out_at[text]
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    value = np.zeros(total, np.uint64)
    for j in range(k):
        own = padded[first + j] * _STEP[j]
        value += np.where(count[text] > j, own, 0) if (count[(count > 0)] < k).any() else own
    value = mix(value)
    for a, b in zip(out_at.tolist(), (out_at + made).tolist(), strict=True):
        if b - a > 1:
            value[a:b].sort()
    new = np.ones(total, bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], np.bincount(text[new], minlength=n)


def node_ids(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of each set (as signed integers); the first is its class."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    one = np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ _STEP[0]), dtype=np.uint64)])[at])
    two = np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ _STEP[3]), dtype=np.uint64)])[at])
    return mix(one + sizes.astype(np.uint64)).astype(np.int64), mix(two).astype(np.int64)


def dense_sketches(values: np.ndarray, sizes: np.ndarray, bits: int = SKETCH_BITS) -> list[bytes]:
    """Parity sketches: each shingle flips one bit. Halves of a sketch XORed are the sketch of half as many bits."""
    n = len(sizes)
    text = np.repeat(np.arange(n), sizes)
    bit = (values >> np.uint64(40)).astype(np.int64) % bits
    flips = np.bincount(text * bits + bit, minlength=n * bits) & 1
    return [x.tobytes() for x in np.packbits(flips.reshape(n, bits).astype(np.uint8), axis=1)]


#: Sketches have 1,024 bits, those of larger sets more: (least size, bits).
SIZED = ((0, 1024), (900, 4096), (3600, 16384))


def sized_sketches(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    out: list[bytes] = [b""] * len(sizes)
    at = np.cumsum(sizes) - sizes
    for k, (low, bits) in enumerate(SIZED):
        high = SIZED[k + 1][0] if k + 1 < len(SIZED) else 1 << 62
        rows = np.flatnonzero((sizes >= low) & (sizes < high))
        for part in np.array_split(rows, max(1, len(rows) * bits >> 22)):
            picked = [values[at[i] : at[i] + sizes[i]] for i in part]
            for i, x in zip(part.tolist(), dense_sketches(np.concatenate(picked) if picked else values[:0], sizes[part], bits), strict=True):
                out[i] = x
    return out


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) of as many bits as ``words`` words have."""
    return np.bitwise_xor.reduce(sketch.reshape(len(sketch), -1, words), axis=1)


def forest(left: np.ndarray, right: np.ndarray | None, n: np.ndarray, sketches: list[bytes], comp: np.ndarray) -> list[tuple[int, int]]:
    """Edges (as indexes) that connect all that pairs allowed by size and sketch connect: within ``left`` or, with
    ``right``, between the two. Pairs of one ``comp`` are passed over."""
    length = np.array([len(x) // 8 for x in sketches])
    levels = sorted(set(length.tolist()))
    flat = {w: np.stack([np.frombuffer(x, np.uint64) for x in sketches if len(x) // 8 == w]) for w in levels}
    place = np.zeros(len(length), np.int64)
    for w in levels:
        place[length == w] = np.arange(int((length == w).sum()))
    by = {w: np.zeros((len(length), w), np.uint64) for w in levels}
    for w in levels:
        for v in levels:
            if v >= w:
                by[w][length == v] = fold(flat[v], w)
    side = np.zeros(len(n), bool)
    if right is not None:
        side[right] = True
    members = left if right is None else np.concatenate([left, right])
    open_, out = np.zeros(len(n), bool), []
    open_[members] = True
    for start in members.tolist():
        if not open_[start]:
            continue
        open_[start] = False
        queue = [start]
        while queue:
            x = queue.pop()
            rest = np.flatnonzero(open_ if right is None else open_ & (side != side[x]))
            rest = rest[(4 * n[rest] >= 3 * n[x]) & (4 * n[x] >= 3 * n[rest]) & (comp[rest] != comp[x])]
            for w in levels:
                own = rest[np.minimum(length[rest], length[x]) == w]
                if len(own):
                    far = np.bitwise_count(by[w][own] ^ by[w][x]).sum(1, dtype=np.int64)
                    hit = own[7 * far <= n[own] + n[x]]
                    open_[hit] = False
                    queue.extend(hit.tolist())
                    out += [(x, int(y)) for y in hit]
    return out


def _cells(groups: DataFrame, columns: list[str], leaders: bool = False) -> DataFrame:
    """(xs, i, j): members of groups by pairs of blocks; a group of at most BLOCK members is one cell.

    With ``leaders``, a larger group has one cell a block, which its leaders (members whose hash is low enough) join, so
    that each member is sent once and cells grow in proportion to the group.
    """
    size = groups.groupBy("gid").agg(F.count("*").alias("g"))
    rows = groups.join(size, "gid").withColumn("blocks", F.ceil(F.col("g") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    low = F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(1 << 30)) * F.col("g") < LEADERS * (1 << 30)
    rows = rows.withColumn("lead", (F.col("blocks") > 1) & low if leaders else F.lit(False))
    if leaders:
        rows = rows.withColumn("i", F.explode(F.when(F.col("lead"), every).otherwise(F.array("block")))).withColumn("j", F.col("i"))
    else:
        rows = rows.withColumn("other", F.explode(every)).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    rows = rows.select("gid", "i", "j", F.struct(*columns, "block", "lead").alias("x"))
    return rows.groupBy("gid", "i", "j").agg(F.collect_list("x").alias("xs")).select("xs", "i", "j")


def _cluster_edges(groups: DataFrame, leaders: bool) -> DataFrame:
    """(a, b): forests of the pairs of members (gid, node, n, sketch, comp) that sizes and sketches allow; at most a row for
    each member of a cell. Members of one ``comp`` are not compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for r in range(batch.num_rows):
                items, i, j = batch.column(0)[r].values, batch.column(1)[r].as_py(), batch.column(2)[r].as_py()
                node, n, comp, block, lead = (items.field(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "comp", "block", "lead"))
                left, right = np.flatnonzero((block == i) | lead), np.flatnonzero(block == j) if i != j else None
                for x, y in forest(left, right, n, items.field("sketch").to_pylist(), comp):
                    a.append(node[x])
                    b.append(node[y])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _cells(groups, ["node", "n", "sketch", "comp"], leaders).mapInArrow(lean(run), "a long, b long")


def _clusters(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component): the components of all pairs that share a group and whose sizes and sketches allow a link.

    Groups of more than BLOCK members meet their leaders first, which joins most of what is alike; only of those that
    still hold several components, members of different ones are compared, block by block.
    """
    spark = groups.sparkSession
    sketches = classes.select("node", "n", "sketch")
    edges = cut(spark, _cluster_edges(groups.join(sketches, "node").withColumn("comp", F.col("node")), True), "edges")
    found = components(spark, edges, reduced=True)
    large = groups.groupBy("gid").agg(F.count("*").alias("g")).where(F.col("g") > BLOCK).select("gid")
    if large.isEmpty():
        return found
    found = cut(spark, found, "clusters")
    rest = cut(spark, _labelled(groups.join(large, "gid", "left_semi"), found), "open")
    if rest.isEmpty():
        return found
    return components(spark, edges.unionByName(_cluster_edges(rest.join(sketches, "node"), False)), reduced=True)


def band_start(size: int) -> int:
    """Least size of the band that holds ``size``; 1 for the band of single shingles."""
    low = SMALL
    if size < low:
        return 1
    while size >= low * WIDE:
        low *= WIDE
    return low


def band_segments(low: int) -> int:
    """Number of segments in the band that starts at ``low``; 0: one for each shingle."""
    largest = low * WIDE - 1
    return 0 if low < SMALL else 3 * ((largest + largest * 4 // 3) // 7)


def issue_keys(values: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The 64-bit keys of one set (sorted distinct hashes), for its band and, near its lower end, for the band below."""
    n = len(values)
    low = band_start(n)
    roles = [(low, (n + n * 4 // 3) // 7)]
    if low >= SMALL and 3 * n <= 4 * (low - 1):
        below = band_start(low - 1)
        roles.append((below, (n + low - 1) // 7))
    out = []
    known = np.zeros(n, bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        known = frequent[at] == values
    for start, most in roles:
        m = band_segments(start)
        if m:
            segment = (mix(values ^ np.uint64(start)) % np.uint64(m)).astype(np.int64)
            order = np.argsort(segment, kind="stable")
            edge = np.flatnonzero(np.diff(segment[order], prepend=-1))
            keys = np.bitwise_xor.reduceat(values[order], edge)
            rare = np.add.reduceat((~known[order]).astype(np.int64), edge)
            keys = mix(keys + mix(segment[order][edge].astype(np.uint64) + np.uint64(start * int(_STEP[1]) & (1 << 64) - 1)))
        else:
            keys, rare = mix(values + np.uint64(1)), (~known).astype(np.int64)
        if len(keys) > most + 1:
            # rarest first: segments with no rare shingle come last; ties in the order of the keys
            keys = keys[np.lexsort((keys, -np.minimum(rare, 2)))[: most + 1]]
        out.append(keys)
    return np.concatenate(out)


class _Counts:
    """Counts of hashes over a whole stream in bounded memory: when more than ``room`` are held, the smallest counts go,
    and what stays counted from then on is at most that much too low (the lossy counting of frequent items)."""

    def __init__(self, room: int = COUNTED):
        self.room, self.keys, self.count, self.fresh, self.held = room, np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, values: np.ndarray) -> None:
        self.fresh.append(values)
        self.held += len(values)
        if self.held > self.room:
            self._merge()

    def _merge(self) -> None:
        every = np.concatenate([self.keys, *self.fresh])
        weight = np.concatenate([self.count, np.ones(self.held, np.int64)])
        order = np.argsort(every, kind="stable")
        every, weight = every[order], weight[order]
        edge = np.flatnonzero(np.diff(every, prepend=every[:1] ^ np.uint64(1)))
        self.keys, self.count = every[edge], np.add.reduceat(weight, edge) if len(edge) else weight
        self.fresh, self.held = [], 0
        if len(self.keys) > self.room:
            stays = self.count > np.partition(self.count, len(self.count) - self.room // 2)[len(self.count) - self.room // 2]
            self.keys, self.count = self.keys[stays], self.count[stays]

    def most(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        often = self.count >= least
        return self.keys[often], self.count[often]


def _sketch_pass(docs: DataFrame) -> DataFrame:
    """One row a document (doc_id, text_key, n, node, check, sketch) and, as rows without doc_id, frequent shingles of each task."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("sketch", pa.binary()), ("frequent", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = _Counts(), 0
        for batch in batches:
            for first, rows, data, offsets in text_steps(batch, "text"):
                values, sizes = shingle_sets(data, offsets)
                node, check = node_ids(values, sizes)
                yield pa.record_batch([batch.column(0).slice(first, rows), batch.column(2).slice(first, rows), pa.array(sizes, pa.int64()), pa.array(node), pa.array(check), pa.array(sized_sketches(values, sizes), pa.binary()), pa.nulls(rows, pa.bool_())], schema=schema)
                new = np.zeros(rows, bool)
                new[np.unique(node, return_index=True)[1]] = True
                counts.add(values[np.repeat(new, sizes)])
                texts += int(new.sum())
        found, count = counts.most(max(3, texts // 100))
        if len(found):
            none = pa.nulls(len(found), pa.int64())
            yield pa.record_batch([none, none, pa.array(count, pa.int64()), pa.array(found.astype(np.int64)), none, pa.nulls(len(found), pa.binary()), pa.array(np.ones(len(found), bool))], schema=schema)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(lean(scan), "doc_id long, text_key long, n long, node long, check long, sketch binary, frequent boolean")


def _spread(spark: SparkSession, n_keys: int = 0) -> list[int]:
    """Bucket numbers, a whole number of them for each shuffle partition, which Spark's hash sends there.

    Each task works on one bucket after another, so what it holds at once does not depend on the number of partitions.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per = max(1, -(-n_keys // (parts * BUCKET_KEYS)))
    if parts * per > 50_000:  # so many that their hashes are even enough
        return list(range(parts * per))
    ids = spark.range(parts * (24 + 8 * per)).select(F.col("id").cast("int").alias("id"))
    of = ids.groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("p")).agg(F.slice(F.array_sort(F.collect_list("id")), 1, per).alias("ids")).collect()
    return sorted(x for r in of for x in r.ids)


def _groups(docs: DataFrame, frequent: np.ndarray, n_keys: int) -> DataFrame:
    """(gid, node): classes that meet at a key; groups with the same members once. Buckets hold ``BUCKET_KEYS`` keys or so."""
    buckets = np.array(_spread(docs.sparkSession, n_keys), np.int32)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, nodes, held = [], [], 0

        def flush() -> pa.RecordBatch:
            key, node = np.concatenate(keys), np.concatenate(nodes)
            of = (key >> np.uint64(32)) * np.uint64(len(buckets)) >> np.uint64(32)
            order = np.argsort(of, kind="stable")
            edge = np.append(np.flatnonzero(np.diff(of[order].astype(np.int64), prepend=-1)), len(order))
            rows = np.empty((len(order), 14), np.uint8)
            rows[:, :6] = key[order].view(np.uint8).reshape(-1, 8)[:, :6]
            rows[:, 6:] = node[order].view(np.uint8).reshape(-1, 8)
            own = [rows[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            return pa.record_batch([pa.array(buckets[of[order][edge[:-1]].astype(np.int64)]), pa.array(own, pa.binary())], names=["bucket", "packed"])

        for batch in batches:
            for _, _, data, offsets in text_steps(batch, "text"):
                values, sizes = shingle_sets(data, offsets)
                node, _ = node_ids(values, sizes)
                at = np.concatenate([[0], np.cumsum(sizes)])
                for i, name in enumerate(node.tolist()):
                    if sizes[i] and name not in seen:
                        seen.add(name)
                        keys.append(issue_keys(values[at[i] : at[i + 1]], frequent))
                        nodes.append(np.full(len(keys[-1]), name, np.int64))
                        held += len(keys[-1])
                if held > FLUSH:
                    yield flush()
                    keys, nodes, held = [], [], 0
                    if len(seen) > 1 << 18:
                        seen.clear()
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(parts: list[bytes]) -> pa.RecordBatch | None:
            raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 14)
            parts.clear()
            key = np.zeros((len(raw), 8), np.uint8)
            key[:, :6] = raw[:, :6]
            key = key.view(np.uint64).ravel()
            node = np.ascontiguousarray(raw[:, 6:]).view(np.int64).ravel()
            del raw
            order = np.argsort(key)
            key = key[order]
            twin = np.zeros(len(key), bool)
            twin[1:] = key[1:] == key[:-1]
            twin[:-1] |= twin[1:]
            key, node = key[twin], node[order[twin]]
            del order, twin
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node = key[new], node[new]
            edge = np.append(np.flatnonzero(np.diff(key, prepend=key[:1] ^ np.uint64(1) if len(key) else key)), len(key))
            size = np.diff(edge)
            if not (size > 1).any():
                return None
            name = np.add.reduceat(mix(node.astype(np.uint64)), edge[:-1])[size > 1]
            starts, size = edge[:-1][size > 1], size[size > 1]
            name, first = np.unique(name, return_index=True)
            starts, size = starts[first], size[first]
            take = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            return pa.record_batch([pa.array(np.repeat(name.astype(np.int64), size)), pa.array(node[take])], names=["gid", "node"])

        bucket, parts = None, []
        for batch in batches:
            for b, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != bucket and parts:
                    if (out := close(parts)) is not None:
                        yield out
                    parts = []
                bucket = b
                parts.append(packed)
        if parts and (out := close(parts)) is not None:
            yield out

    packed = docs.select("text").mapInArrow(lean(emit), "bucket int, packed binary")
    met = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(meet), "gid long, node long")
    return met.distinct()


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, ..., items): the sets of classes, each from a text of the row that ``rep`` names; other columns are kept."""
    few = needed.count() <= MOST_SENT  # 24 bytes a row; otherwise texts are shuffled to meet them
    kept = [c for c in needed.columns if c != "rep"]
    rows = docs.join(F.broadcast(needed) if few else needed, docs["doc_id"].eqNullSafe(needed["rep"])).select(*kept, "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, offsets in text_steps(batch, "text"):
                values, sizes = shingle_sets(data, offsets)
                raw, at = values.tobytes(), np.concatenate([[0], np.cumsum(sizes)]) * 8
                # rows that share an id can hold other texts than the one of the class
                own = node_ids(values, sizes)[0] == batch.column(0).slice(first, n).to_numpy()
                items = pa.array([raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.record_batch([*(batch.column(i).slice(first, n) for i in range(len(kept))), items], names=[*kept, "items"]).filter(pa.array(own))

    return rows.mapInArrow(lean(sets), ", ".join(f"{c} long" for c in kept) + ", items binary")


def solve(names: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The component (least name) of each set of a cluster, exactly; names are distinct."""
    order = np.argsort(names)
    names, sets = names[order], [sets[i] for i in order]
    sizes = np.array([len(x) for x in sets])
    out, open_ = names.copy(), np.ones(len(names), bool)
    index: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.uint64),) * 3

    def build() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.flatnonzero(open_)
        values = np.concatenate([sets[i] for i in rows]) if len(rows) else np.zeros(0, np.uint64)
        owner = np.repeat(rows, sizes[rows])
        by = np.argsort(values, kind="stable")
        keys, first = np.unique(values[by], return_index=True)
        return keys, np.append(first, len(by)), owner[by]

    index, built = build(), len(names)
    left = len(names)
    for start in range(len(names)):
        if not open_[start]:
            continue
        open_[start], left = False, left - 1
        queue = [start]
        while queue and left:
            if left < built // 2:
                index, built = build(), left
            keys, first, owner = index
            x = queue.pop()
            out[x] = names[start]
            at = np.searchsorted(keys, sets[x])
            at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == sets[x])] if len(keys) else at[:0]
            length = first[at + 1] - first[at]
            spread = np.repeat(first[at] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            common = np.bincount(owner[spread], minlength=len(names))
            hit = np.flatnonzero(open_ & (7 * common >= 3 * (sizes + sizes[x])) & (common > 0))
            open_[hit] = False
            left -= len(hit)
            queue.extend(hit.tolist())
            out[hit] = names[start]
        for x in queue:
            out[x] = names[start]
    back = np.empty_like(out)
    back[order] = out
    return back


def _solve_clusters(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, component) of clusters that fit a task; needed: node, cluster, rep."""
    sets = _sets(docs, needed).repartition("cluster").sortWithinPartitions("cluster", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(names: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
            found = solve(np.array(names, np.int64), held)
            return pa.record_batch([pa.array(names, pa.int64()), pa.array(found)], names=["node", "component"])

        cluster, names, held = None, [], []
        for batch in batches:
            for node, own, items in zip(*(batch.column(i) for i in range(3)), strict=True):
                if own.as_py() != cluster and names:
                    yield close(names, held)
                    names, held = [], []
                cluster = own.as_py()
                if not names or names[-1] != node.as_py():  # equal rows of an id give a set twice
                    names.append(node.as_py())
                    held.append(np.frombuffer(items.as_py(), np.uint64))
        if names:
            yield close(names, held)

    return sets.select("node", "cluster", "items").mapInArrow(lean(run), "node long, component long")


def _item_table(docs: DataFrame, needed: DataFrame) -> str:
    """Name of a bucketed table (node, items) of the classes in ``needed``, which later joins don't shuffle."""
    spark, name = docs.sparkSession, "items_" + uuid.uuid4().hex[:12]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = _sets(docs, needed.select("node", "rep")).repartition(parts, "node").dropDuplicates(["node"])
    found.write.bucketBy(parts, "node").saveAsTable(name)
    return name


def _sketches(table: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column(1))
            sizes = np.diff(offsets) // 8
            raw = np.frombuffer(data.tobytes()[offsets[0] : offsets[-1]], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(dense_sketches(raw, sizes), pa.binary())], names=["node", "n", "sketch"])

    return table.select("node", "items").mapInArrow(lean(run), "node long, n long, sketch binary")


def _solve_in_rounds(docs: DataFrame, groups: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, component) of clusters of any size; groups: gid, node of those clusters; needed: node, cluster, rep."""
    spark = docs.sparkSession
    items = _item_table(docs, needed)
    try:
        return _rounds(groups.select("gid", "node"), needed.select(F.col("cluster").alias("gid"), "node"), items)
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {items}")


def _rounds(groups: DataFrame, clusters: DataFrame, items: str) -> DataFrame:
    """The first round compares all members of a cluster with its leaders; only groups that it leaves in several components
    go on to the others."""
    spark = groups.sparkSession
    sketches = cut(spark, _sketches(spark.table(items)), "dense")
    tested = links = comps = None
    for most in ROUNDS:
        now = _labelled(clusters if most == "leaders" else groups, comps)
        now = cut(spark, now.join(sketches, "node"), "open")
        if now.isEmpty():
            break
        pairs = _nominate(now, most)
        pairs = cut(spark, pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = cut(spark, _verify(pairs, items), "links")
        links = found if links is None else links.unionByName(found)
        comps = cut(spark, components(spark, links), "components")
    return comps if comps is not None else spark.createDataFrame([], "node long, component long")


def _verify(pairs: DataFrame, table: str) -> DataFrame:
    """Of pairs (a, b) of classes, those whose sets are similar enough; the table's sets aren't shuffled."""
    known = pairs.sparkSession.table(table)
    joined = pairs.join(known.withColumnsRenamed({"node": "b", "items": "items_b"}), "b").join(known.withColumnsRenamed({"node": "a", "items": "items_a"}), "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                whole = np.concatenate([x, y])
                whole.sort(kind="stable")
                common = int((whole[1:] == whole[:-1]).sum())
                ok[i] = 100 * common >= 75 * (len(whole) - common)
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return joined.select("a", "b", "items_a", "items_b").mapInArrow(lean(compare), "a long, b long")


def _labelled(groups: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Groups with each member's component, without groups that lie in one component."""
    if comps is None:
        return groups.withColumn("comp", F.col("node"))
    rows = groups.join(comps.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = rows.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("gid")
    return rows.join(open_, "gid", "left_semi")


def _nominate(groups: DataFrame, most: int | str | None) -> DataFrame:
    """Pairs (a, b) of members of a group that lie in different components and pass size and sketch.

    With ``most``, only the nearest that many of each class, by the sketches; "leaders": the nearest one, and in groups of
    more than BLOCK members only leaders are candidates. Otherwise such a group is compared block by block, each pair of
    blocks in a cell of its own.
    """
    cells = _cells(groups, ["node", "comp", "n", "sketch"], most == "leaders")
    most = 1 if most == "leaders" else most

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, near = [], [], []
            for r in range(batch.num_rows):
                items, i, j = batch.column(0)[r].values, batch.column(1)[r].as_py(), batch.column(2)[r].as_py()
                sketch = np.frombuffer(b"".join(items.field("sketch").to_pylist()), np.uint64).reshape(len(items), -1)
                node, comp, n, block, lead = (items.field(c).to_numpy(zero_copy_only=False) for c in ("node", "comp", "n", "block", "lead"))
                left, right = np.flatnonzero(lead if lead.any() else block == i), np.flatnonzero((block == j) | lead)
                for x in left:
                    at = right if i != j else right[(right > x) | (~lead[right] & lead[x])]
                    at = at[(comp[at] != comp[x]) & (4 * n[at] >= 3 * n[x]) & (4 * n[x] >= 3 * n[at])]
                    if len(at):
                        far = np.bitwise_count(sketch[at] ^ sketch[x]).sum(1, dtype=np.int64)
                        ok = 7 * far <= n[at] + n[x]
                        at, far = at[ok], far[ok]
                        a.append(np.full(len(at), node[x]))
                        b.append(node[at])
                        near.append(far / (n[at] + n[x]))
            a, b, near = (np.concatenate([np.zeros(0, t), *v]) for v, t in ((a, np.int64), (b, np.int64), (near, np.float64)))
            if most is not None and len(a):
                # of each class on either side, the nearest in this batch (exact: the nearest of all are among them)
                keep = np.zeros(len(a), bool)
                for own, other in ((a, b), (b, a)):
                    order = np.lexsort((other, near, own))
                    first = np.flatnonzero(np.diff(own[order], prepend=own[order[0]] ^ 1))
                    twin = np.zeros(len(order), bool)
                    twin[1:] = (own[order][1:] == own[order][:-1]) & (other[order][1:] == other[order][:-1])
                    rank = np.cumsum(~twin)
                    rank -= np.repeat(rank[first], np.diff(np.append(first, len(order))))
                    keep[order[(rank < most) & ~twin]] = True
                a, b, near = a[keep], b[keep], near[keep]
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(near)], names=["a", "b", "near"])

    pairs = cells.mapInArrow(lean(compare), "a long, b long, near double").distinct()
    if most is None:
        return pairs.select("a", "b")
    either = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("x"), "a", "b", "near"), F.struct(F.col("b").alias("x"), "a", "b", "near"))))
    rank = F.row_number().over(Window.partitionBy("x").orderBy("near", "a", "b"))
    return either.withColumn("rank", rank).where(F.col("rank") <= most).select("a", "b").distinct()


def _linked(docs: DataFrame, id_col: str, text_col: str, most_items: int = CLUSTER_ITEMS) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, component, component_id for every row of ``docs``.

    ``component`` names the component itself (null for an empty set): several can have the same least id, as rows that
    share an id need not share a text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = cut(spark, _sketch_pass(rows), "sketches")
    top = both.where("frequent").groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(MOST_FREQUENT).select("node").collect()
    frequent = np.sort(np.array([r.node for r in top], np.int64).astype(np.uint64))
    sets = both.where("frequent IS NULL").drop("frequent")
    classes = sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("check").alias("check"), F.max("check").alias("check_2"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = classes.withColumn("n", F.when(F.col("check") == F.col("check_2"), F.col("n")).otherwise(F.raise_error(F.lit("two sets have the same 64-bit name")).cast("long")))
    classes = cut(spark, classes.drop("check", "check_2"), "classes")

    # a set issues its largest difference, at most a third of its size, and one key; twice at most
    n_keys = classes.agg(F.coalesce(F.sum(F.ceil(F.col("n") / 3) + 2), F.lit(0))).first()[0]
    groups = cut(spark, _groups(rows, frequent, int(n_keys)), "groups")
    clusters = _clusters(groups.select("gid", "node"), classes)
    clusters = clusters.select("node", F.col("component").alias("cluster")).join(classes.select("node", "rep", "n"), "node")
    size = clusters.groupBy("cluster").agg(((F.sum("n") <= most_items) & (F.count("*") <= CLUSTER_CLASSES)).alias("fits"))
    clusters = cut(spark, clusters.join(size, "cluster").select("node", "cluster", "rep", "fits"), "clusters")
    comps = cut(spark, _solve_clusters(rows, clusters.where("fits").drop("fits")), "components")
    large = clusters.where("NOT fits").drop("fits")
    if not large.isEmpty():
        comps = comps.unionByName(_solve_in_rounds(rows, groups.join(large.select("node"), "node", "left_semi"), large))

    named = classes.join(comps, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = named.join(least, "component").select("node", "component", "component_id")
    filled = sets.where("n > 0").join(found, "node", "left").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component", "component_id")
    empty = sets.where("n = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return filled.unionByName(empty)


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_items: int = CLUSTER_ITEMS) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id that links reach) for every row of ``docs``."""
    return _linked(docs, id_col, text_col, most_items).select("doc_id", "n_shingles", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: one with the id that names it; rows with null ids or empty sets stay.

    Rows are told apart by id and hash of the text. Of rows that are equal in both, one stays: the first one by all its
    columns, written as JSON.
    """
    named = _linked(docs, id_col, text_col).where("component IS NOT NULL AND doc_id = component_id")
    own = named.groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("copies"))
    keep = own.groupBy("component").agg(F.min(F.struct("doc_id", "text_key", "copies")).alias("kept")).select("kept.*")
    row_id, text = F.col("row")[id_col].cast("long"), F.col("row")[text_col].cast("string")
    stays = row_id.isNull() | ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select(F.struct("*").alias("row"))
    met = rows.join(keep, (row_id == F.col("doc_id")) & (F.xxhash64(text) == F.col("text_key")), "left").select("row", "doc_id", "text_key", "copies", stays.alias("stays"))
    one = met.where("stays OR copies = 1").select("row.*")
    more = met.where("NOT stays AND copies > 1").groupBy("doc_id", "text_key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return one.unionByName(more.select("row.*"))


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
