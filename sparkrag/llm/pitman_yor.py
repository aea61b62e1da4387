"""Language-model scoring with a hierarchical Pitman-Yor model of word pairs.

Each preceding word u has a restaurant whose customers are the words that follow it; all restaurants share one parent,
the root, whose customers are the tables of its children. With discount d and strength e,

    p(w | u) = (c_uw - d t_uw + (e + d T_u) p(w)) / (e + n_u),        p(w) = (S_w - d0) / (e0 + S),

where c counts customers, t tables, T_u = sum of t_uw over w, S_w = sum of t_uw over u, S the sum of S_w. The root's base
measure is continuous, so each word has one table there, and all words that training text lacks are one event with
p = (e0 + d0 V) / (e0 + S): probabilities of the V known words and that event add up to one in every context.

Seatings are sampled by Gibbs sweeps. What a sweep redraws is the number t of tables of each dish of each restaurant, all
its customers being removed at once: given all other seatings, t has the law

    S_d(c, t) * prod for i = 1 .. t-1 of (e + d (T_u' + i)) (S_w' + i - d0) / (e0 + S' + i),

where S_d are generalised Stirling numbers and the dashes mean "without this dish's own tables". ``seat`` draws from that
law itself: the numbers come from their recursion for up to ``TABLE`` customers and from their alternating sum beyond,
which converges to machine precision for t up to 10 c^d (more tables have no weight in any corpus: the product falls off
far earlier); there is no other law for large counts. All dishes are redrawn at once, given the state that the sweep before
has left. The start is one table for each dish and, in a context of n customers, n^d; the predictive probabilities of the ``SWEEPS - BURN_IN`` states after
the burn-in are averaged. Discounts are n1 / (n1 + 2 n2), from the numbers of dishes with one and two customers.

How it runs: texts are never shuffled. One pass cuts them into chunks of bounded size, reduces each to its distinct words
and pairs with their counts, and stores these in the shared folder; sweeps read only that. Four kinds of exchange take
place, each packed in numpy arrays by hash range, in buckets of a bounded number of entries: counts of words; counts of
pairs (answers only say which pairs occur elsewhere too, and which chunk seats them); each sweep, tables by preceding and by
following word; and, after the last, tables of pairs.
Each pair is seated in one of the chunks that hold it, which its hash says, and that chunk's tables are kept beside it for
the next sweep: work grows with the distinct pairs, not with the chunks that a frequent pair is in. The last exchange takes
the sums of the tables over the averaged sweeps, all that the predictive probabilities need, to the other chunks. Random
numbers are hashes of pair and sweep, so chunks don't change results. A frequent word or pair is one entry of a chunk at
most, however often it occurs, and so meets its like pre-aggregated. The last pass reads the texts again; a checksum
verifies that its chunks are those of the first. Nothing is collected on the driver but sums.

Fixed results: a null or empty text has only its end token; without training text every token is the unknown event, with
probability one; rows that repeat a doc_id are scored each; a null id counts as the text ""; an empty table stays empty;
further columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, mix, open_fs, text_steps, word_hashes, work_dir, write_file
from .jaccard import _spread

END = np.uint64(0x5D588B656C078965)
CHUNK_TOKENS = 2 << 20
SWEEPS, BURN_IN = 5, 2
MOST_TASKS = 100_000
TABLE = 1024  # customers of one dish up to which Stirling numbers are tabulated
STRENGTH, ROOT_STRENGTH = 1.0, 1.0
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Chunk:
    part: int
    doc_ids: pa.Array
    held: np.ndarray  # of each document
    starts: np.ndarray  # of each document among the tokens
    voc: np.ndarray  # distinct words, ascending by hash
    word: np.ndarray  # of each token, as an index into voc
    pair: np.ndarray  # of each token, as an index into the pairs
    u: np.ndarray  # of each pair
    w: np.ndarray
    name: np.ndarray  # hash of each pair; pairs ascend by it
    train: np.ndarray  # which tokens are training text

    def check(self) -> int:
        return int((np.bitwise_xor.reduce(self.voc) ^ np.bitwise_xor.reduce(self.name)).astype(np.int64))


@dataclass
class Counts:
    """What sweeps need of a chunk: its words, its pairs and how often they occur in its training text."""

    part: int
    check: int
    voc: np.ndarray
    u: np.ndarray
    w: np.ndarray
    own: np.ndarray
    name: np.ndarray

    @staticmethod
    def of(chunk: Chunk) -> Counts:
        return Counts(chunk.part, chunk.check(), chunk.voc, chunk.u, chunk.w, np.bincount(chunk.pair[chunk.train], minlength=len(chunk.name)).astype(np.int64), chunk.name)

    def save(self, uri: str) -> None:
        parts = [self.voc.tobytes(), self.u.astype("<i4").tobytes(), self.w.astype("<i4").tobytes(), pack_small(self.own)]
        head = json.dumps([self.part, self.check, len(self.voc), len(self.u), [len(x) for x in parts]]).encode()
        write_file(uri, [struct.pack("<I", len(head)), head, zstandard.ZstdCompressor(level=1).compress(b"".join(parts))])

    @staticmethod
    def load(uri: str) -> Counts:
        where, path = open_fs(uri)
        with where.open_input_file(path) as f:
            raw = f.read()
        n = struct.unpack_from("<I", raw)[0]
        part, check, words, pairs, sizes = json.loads(raw[4 : 4 + n])
        body = memoryview(zstandard.ZstdDecompressor().decompress(raw[4 + n :], sum(sizes)))
        at = np.cumsum([0, *sizes]).tolist()
        voc = np.frombuffer(body[at[0] : at[1]], np.uint64, words)
        u, w = (np.frombuffer(body[at[i] : at[i + 1]], "<i4", pairs) for i in (1, 2))
        return Counts(part, check, voc, u, w, unpack_small(bytes(body[at[3] : at[4]]), pairs), mix(voc[u] * _A + mix(voc[w] + _B)))

    def words(self) -> np.ndarray:
        """How often each word occurs in the training text: each token ends one pair."""
        return np.bincount(self.w, weights=self.own, minlength=len(self.voc)).astype(np.int64)


def _before(x: np.ndarray, starts: np.ndarray, first) -> np.ndarray:
    """Each text's values moved on by one, with ``first`` at its start."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[starts] = first
    return out


def _chunk(part: int, ids: list, held: list, texts: list) -> Chunk:
    tokens, starts, total = [], [], 0
    for hashes, of, n in texts:
        count = np.bincount(of, minlength=n)
        own = np.full(len(hashes) + n, END, np.uint64)
        own[np.arange(len(hashes)) + of] = hashes
        tokens.append(own)
        starts.append(total + np.cumsum(count + 1) - (count + 1))
        total += len(own)
    tokens, starts, held = np.concatenate(tokens), np.concatenate(starts), np.concatenate(held)
    voc, word = np.unique(np.append(tokens, END), return_inverse=True)
    end, word = word[-1], word[:-1]
    name, pair = np.unique(mix(_before(tokens, starts, END) * _A + mix(tokens + _B)), return_inverse=True)
    u, w = np.empty(len(name), np.int64), np.empty(len(name), np.int64)
    u[pair], w[pair] = _before(word, starts, end), word
    size = np.diff(np.append(starts, len(tokens)))
    return Chunk(part, pa.concat_arrays(ids), held, starts, voc, word, pair, u, w, name, np.repeat(~held, size))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of the rows (part, doc_id, held, text) of one task; their numbers follow the task's."""
    ids, held, texts, size, number, task = [], [], [], 0, 0, 0
    for batch in batches:
        for first, n, data, offsets in text_steps(batch, "text"):
            task = batch.column(0)[0].as_py()
            hashes, of = word_hashes(data, offsets)
            if size and size + len(hashes) + n > CHUNK_TOKENS:
                yield _chunk((task << 20) + number, ids, held, texts)
                ids, held, texts, size, number = [], [], [], 0, number + 1
            ids.append(batch.column(1).slice(first, n))
            held.append(batch.column(2).slice(first, n).to_numpy(zero_copy_only=False).astype(bool))
            texts.append((hashes, of, n))
            size += len(hashes) + n
    if texts:
        yield _chunk((task << 20) + number, ids, held, texts)


def _slices(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among ascending hashes (and, last, where they end)."""
    of = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    return np.searchsorted(of, np.arange(buckets + 1))


def pack_small(x: np.ndarray) -> bytes:
    """Non-negative integers, most of them small: a byte each, and eight for those from 255 on."""
    small = np.minimum(x, 255).astype(np.uint8)
    return small.tobytes() + x[small == 255].astype("<i8").tobytes()


def unpack_small(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    if len(raw) > n:
        out[out == 255] = np.frombuffer(raw, "<i8", offset=n)
    return out


def pack_ascending(x: np.ndarray) -> bytes:
    """Ascending numbers as gaps: their low bytes, then the rest, which is mostly zero or small."""
    gap = np.diff(x, prepend=0)
    return (gap & 255).astype(np.uint8).tobytes() + pack_small(gap >> 8)


def unpack_ascending(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8, n) + (unpack_small(raw[n:], n) << 8))


def _prepare(rows: DataFrame) -> DataFrame:
    """Store the counts of all chunks; (uri, n_words, n_pairs) of each."""
    folder = work_dir(rows.sparkSession, "chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            own = Counts.of(chunk)
            uri = f"{folder}/{own.part:x}-{os.urandom(4).hex()}.counts"
            own.save(uri)
            yield pa.record_batch([pa.array([uri]), pa.array([len(own.voc)], pa.int64()), pa.array([len(own.name)], pa.int64())], names=["uri", "n_words", "n_pairs"])

    rows.mapInArrow(lean(run), "uri string, n_words long, n_pairs long").write.parquet(f"{folder}/manifest")
    return rows.sparkSession.read.schema("uri string, n_words long, n_pairs long").parquet(f"{folder}/manifest")


class _Exchange:
    """Requests of chunks go to buckets, answers come back by chunk through the shared folder."""

    def __init__(self, manifest: DataFrame, name: str, buckets: list[int], tasks: int):
        self.manifest, self.spark, self.buckets, self.tasks = manifest, manifest.sparkSession, buckets, tasks
        self.folder = work_dir(self.spark, name)

    def run(self, ask, answer) -> tuple[str, list[int]]:
        """ask(counts of a chunk, number of buckets) -> for each bucket, a list of byte strings, or None; answer(list of such
        lists) -> (answers in the same order, statistics). Returns the folder and the sum of the statistics."""
        ids = self.buckets

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for uri in batch.column(0).to_pylist():
                    chunk = Counts.load(uri)
                    parts = [(b, x) for b, x in enumerate(ask(chunk, len(ids))) if x is not None]
                    yield pa.record_batch([pa.array([ids[b] for b, _ in parts], pa.int32()), pa.array([chunk.part] * len(parts), pa.int64()), pa.array([chunk.check] * len(parts), pa.int64()), pa.array([x for _, x in parts], pa.list_(pa.binary()))], names=["bucket", "part", "check", "packed"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def close(bucket: int, held: list) -> pa.RecordBatch:
                got, stats = answer([x for _, _, x in held])
                rows = [(p, bucket, c, x) for (p, c, _), x in zip(held, got, strict=True)] + [(-1, bucket, 0, [np.array(stats, "<i8").tobytes()])]
                return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.binary())))], names=["part", "bucket", "check", "packed"])

            now, held = None, []
            for batch in batches:
                for i in range(batch.num_rows):
                    bucket = batch.column(0)[i].as_py()
                    if bucket != now and held:
                        yield close(now, held)
                        held = []
                    now = bucket
                    held.append((batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i].as_py()))
            if held:
                yield close(now, held)

        sent = self.manifest.select("uri").repartition(self.tasks).mapInArrow(lean(send), "bucket int, part long, check long, packed array<binary>")
        met = sent.repartition("bucket").sortWithinPartitions("bucket", "part").mapInArrow(lean(meet), "part long, bucket int, check long, packed array<binary>")
        met.repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(self.folder)
        sums: list[int] = []
        where, path = open_fs(f"{self.folder}/part=-1")
        if where.get_file_info(path).is_file or where.get_file_info(path).type.name == "Directory":
            for r in self.spark.read.schema("packed array<binary>").parquet(f"{self.folder}/part=-1").collect():  # a row for each bucket
                own = np.frombuffer(r.packed[0], "<i8").tolist()
                sums = [a + b for a, b in zip(sums, own, strict=True)] if sums else own
        return self.folder, sums


def _answers(folder: str, chunk: Counts, buckets: list[int]) -> list[list[bytes] | None]:
    """The answers to a chunk, in the order of the buckets."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    where, path = open_fs(f"{folder}/part={chunk.part}")
    found = {}
    for info in where.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.base_name.endswith(".parquet"):
            with where.open_input_file(info.path) as f:
                t = pq.ParquetFile(f).read()
            if any(c != chunk.check for c in t["check"].to_pylist()):
                raise RuntimeError("a task's documents changed between two passes over the same input")
            found.update(zip(t["bucket"].to_pylist(), t["packed"].to_pylist(), strict=True))
    return [found.get(b) for b in buckets]


@lru_cache(2)
def _stirling_table(d: float, most: int = TABLE) -> np.ndarray:
    """log S_d(c, t) at [c, t] for c up to ``most``; -inf for t > c."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, most):
            stay = np.where(t <= c, np.log(np.maximum(c - d * t, 1e-300)) + out[c], -np.inf)
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
    return out


def _log_stirling(c: np.ndarray, most: int, d: float) -> np.ndarray:
    """log S_d(c, t) for t = 1 .. most, up to a constant for each c; each c is over ``TABLE``.

    S_d(c, t) = sum over j of (-1)^j binomial(t, j) G(c - j d) / G(-j d), over d^t t! (G: the gamma function). The terms are
    taken relative to that of j = 1; they alternate, and cancel at most as far as exp(2 t / c^d).
    """
    c = c.astype(np.float64)[:, None]
    t = np.arange(1, most + 1, dtype=np.float64)
    lead, shrink = t * np.ones_like(c), np.ones_like(c)  # binomial(t, j) times G(c - j d) / G(c - d)
    total = lead.copy()
    log_g = lambda x: (c + x - 0.5) * np.log1p(x / c) + x * np.log(c) - x + 1 / (12 * (c + x))  # noqa: E731  log G(c + x) less what is the same for all x
    for j in range(2, most + 1):
        lead = lead * np.maximum(t - j + 1, 0) / j
        shrink = np.exp(log_g(-j * d) - log_g(-d))
        x = j * d
        ratio = 0.0 if abs(x - round(x)) < 1e-12 else math.gamma(-d) / math.gamma(-x) if x < 150 else 0.0
        term = lead * shrink * ratio
        total += term if j % 2 else -term
        if np.abs(lead * shrink).max() * math.gamma(1 + min(x, 150)) < 1e-17:
            break
    steps = np.log(d) + np.log(t)
    return np.log(np.maximum(total, 1e-300)) - np.cumsum(steps)


def seat(count: np.ndarray, discount: float, step, uniform: np.ndarray) -> np.ndarray:
    """Tables of dishes with ``count`` customers: t has weight S_d(count, t) times the product of step(rows, i) for i < t.

    ``step(rows, i)`` gives a matrix for dishes (as indexes) and numbers of tables i = 1, 2, ...
    """
    tables = np.minimum(count, 1).astype(np.int64)
    live = np.flatnonzero(count > 1)
    if not len(live):
        return tables
    first = step(live, np.ones(1))[:, 0] / discount  # about the mean number of further tables
    room = 2 + 1.5 * first + 14 * np.sqrt(first + 1)
    # more tables than 10 c^d have no weight, and numbers of large dishes aren't evaluated there
    most = np.minimum(count[live], np.where(count[live] > TABLE, 10 * count[live].astype(np.float64) ** discount, count[live])).astype(np.int64)
    width = np.minimum(most, 1 << np.ceil(np.log2(np.minimum(room, 1 << 40))).astype(np.int64))
    while len(live):
        again = np.zeros(len(live), bool)
        level = np.ceil(np.log2(width)).astype(np.int64)
        for w in np.unique(level).tolist():
            own = np.flatnonzero(level == w)
            for part in np.array_split(own, max(1, len(own) << w >> 18)):
                for rows in (part[count[live[part]] <= TABLE], part[count[live[part]] > TABLE]):
                    if not len(rows):
                        continue
                    at, c = live[rows], count[live[rows]]
                    k = min(1 << w, int(most[rows].max()))
                    log_s = _stirling_table(discount)[c, 1 : k + 1] if c[0] <= TABLE else _log_stirling(c, k, discount)
                    k = log_s.shape[1]
                    if k > 1:
                        log_s = log_s.copy()
                        log_s[:, 1:] += np.cumsum(np.log(step(at, np.arange(1, k))), 1)
                    log_s[np.arange(1, k + 1) > most[rows][:, None]] = -np.inf
                    weight = np.exp(log_s - log_s.max(1, keepdims=True))
                    again[rows] = (weight[:, -1] > 1e-10) & (k < most[rows])
                    below = np.cumsum(weight, 1)
                    tables[at] = 1 + (below < uniform[at][:, None] * below[:, -1:]).sum(1)
        live, most, width = live[again], most[again], np.minimum(most[again], 2 * width[again])
    return tables


@dataclass(frozen=True)
class _State:
    """What a task knows: folders of answers, sums over the corpus, hyperparameters."""

    word_buckets: list[int]
    pair_buckets: list[int]
    words: str
    pairs: str
    seats: str
    sweeps: tuple[str, ...]
    n: int
    v: int
    discount: float
    root: tuple[tuple[int, float], ...]  # of each sweep: S and the root's discount
    sums: str = ""

    def counts(self, chunk: Counts) -> tuple[np.ndarray, np.ndarray]:
        got = [x for x in _answers(self.words, chunk, self.word_buckets) if x]
        return tuple(np.concatenate([np.frombuffer(x[i], t) for x in got]) for i, t in enumerate(("<i8", "<u4")))

    def customers(self, chunk: Counts) -> tuple[np.ndarray, np.ndarray, list]:
        """(customers of each pair in all training text, which pairs this chunk seats, for each bucket of pairs None or the
        pairs that other chunks hold too, as indexes, and their packed numbers in the bucket)."""
        total, mine, shared = chunk.own.copy(), chunk.own > 0, [None] * len(self.pair_buckets)
        at = _slices(chunk.name, len(self.pair_buckets))
        for b, x in enumerate(_answers(self.pairs, chunk, self.pair_buckets)):
            if x:
                n = at[b + 1] - at[b]
                other = np.unpackbits(np.frombuffer(x[0], np.uint8), count=n).astype(bool)
                owner = np.unpackbits(np.frombuffer(x[1], np.uint8), count=n).astype(bool)
                rows = at[b] + np.flatnonzero(other)
                if len(rows):
                    total[rows] = unpack_small(x[2], len(rows))
                    mine[rows] = owner[other]
                    shared[b] = rows, x[3]
        return total, mine & (total > 0), shared

    def seatings(self, chunk: Counts, mine: np.ndarray, shared: list, kept: range) -> np.ndarray:
        """Tables of each pair of a chunk, added up over the sweeps that are kept: its own and those of other chunks."""
        out = self.added(chunk, mine, kept)
        for x, own in zip(shared, _answers(self.sums, chunk, self.pair_buckets), strict=True):
            if x:
                out[x[0]] = unpack_small(own[0], len(x[0]))
        return out

    def added(self, chunk: Counts, mine: np.ndarray, kept: range) -> np.ndarray:
        """The same of the pairs that this chunk seats; 0 for others."""
        out = np.zeros(len(mine), np.int64)
        for sweep in kept:
            out[mine] += self.stored(chunk, int(mine.sum()), sweep)
        return out

    def tables(self, chunk: Counts, sweep: int) -> tuple[np.ndarray, np.ndarray]:
        got = [x for x in _answers(self.sweeps[sweep], chunk, self.word_buckets) if x]
        at = np.diff(_slices(chunk.voc, len(self.word_buckets)))
        sizes = [n for n in at.tolist() if n]
        return tuple(np.concatenate([unpack_small(x[i], n) for x, n in zip(got, sizes, strict=True)]) for i in (0, 1))

    def root_p(self, s_w: np.ndarray, sweep: int) -> np.ndarray:
        """Root probability of words with S_w tables; 0 tables mean the unknown event."""
        whole, d0 = self.root[sweep]
        known = np.maximum(s_w - d0, 0) / (ROOT_STRENGTH + whole)
        return np.where(s_w > 0, known, (ROOT_STRENGTH + d0 * self.v) / (ROOT_STRENGTH + whole))

    def seated(self, chunk: Counts, n_w: np.ndarray, total: np.ndarray, mine: np.ndarray, sweep: int) -> np.ndarray:
        """Tables of each pair that the chunk seats after a sweep, given the state that the one before has left."""
        total, u, w = total[mine], chunk.u[mine], chunk.w[mine]
        # the start: a table for each dish, and about as many in a context as n customers make, n ** discount
        t, t_u, s_w, (whole, d0) = np.minimum(total, 1), np.ceil(n_w**self.discount).astype(np.int64), n_w, (self.n, 0.5)
        if sweep:
            t, (t_u, s_w), (whole, d0) = self.stored(chunk, len(total), sweep - 1), self.tables(chunk, sweep - 1), self.root[sweep - 1]
        other_u, other_w, other = t_u[u] - t, s_w[w] - t, whole - t

        def step(rows: np.ndarray, i: np.ndarray) -> np.ndarray:
            a, b, c = other_u[rows][:, None], other_w[rows][:, None], other[rows][:, None]
            return (STRENGTH + self.discount * (a + i)) * (b + i - d0) / (ROOT_STRENGTH + c + i)

        seed = mix(chunk.name[mine] + np.uint64((sweep + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        return seat(total, self.discount, step, (seed >> np.uint64(11)).astype(np.float64) * 2.0**-53)

    def store(self, chunk: Counts, sweep: int, t: np.ndarray) -> None:
        """Keep a chunk's tables; a task that runs again writes the same bytes under the same name, whole or not at all."""
        write_file(f"{self.seats}/{chunk.part:x}-{sweep}", struct.pack("<q", chunk.check) + zstandard.ZstdCompressor(level=1).compress(pack_small(t)))

    def stored(self, chunk: Counts, n: int, sweep: int) -> np.ndarray:
        where, path = open_fs(f"{self.seats}/{chunk.part:x}-{sweep}")
        with where.open_input_file(path) as f:
            raw = f.read()
        if struct.unpack_from("<q", raw)[0] != chunk.check:
            raise RuntimeError("a task's documents changed between two passes over the same input")
        return unpack_small(zstandard.ZstdDecompressor().decompress(raw[8:]), n)


def _ask_words(chunk: Counts, buckets: int) -> list:
    count = chunk.words()
    at = _slices(chunk.voc, buckets)
    return [[chunk.voc[a:b].tobytes(), pack_small(count[a:b])] if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]


def _answer_words(held: list) -> tuple[list, list[int]]:
    sizes = [len(x[0]) // 8 for x in held]
    names, slot = np.unique(np.concatenate([np.frombuffer(x[0], np.uint64) for x in held]), return_inverse=True)
    count = np.zeros(len(names), np.int64)
    np.add.at(count, slot, np.concatenate([unpack_small(x[1], n) for x, n in zip(held, sizes, strict=True)]))
    parts = np.split(slot, np.cumsum(sizes)[:-1])
    return [[count[s].astype("<i8").tobytes(), s.astype("<u4").tobytes()] for s in parts], [int(count.sum()), int((count > 0).sum())]


def _ask_pairs(chunk: Counts, buckets: int) -> list:
    count = chunk.own
    at = _slices(chunk.name, buckets)
    return [[chunk.name[a:b].tobytes(), pack_small(count[a:b])] if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]


def _answer_pairs(held: list) -> tuple[list, list[int]]:
    sizes = np.array([len(x[0]) // 8 for x in held])
    name = np.concatenate([np.frombuffer(x[0], np.uint64) for x in held])
    count = np.concatenate([unpack_small(x[1], n) for x, n in zip(held, sizes.tolist(), strict=True)])
    order = np.argsort(name, kind="stable")
    edge = np.flatnonzero(np.diff(name[order], prepend=name[order[:1]] ^ np.uint64(1)))
    total = np.add.reduceat(count[order], edge)
    size = np.diff(np.append(edge, len(order)))
    other, owner, sums, slot = np.zeros(len(name), bool), np.zeros(len(name), bool), np.zeros(len(name), np.int64), np.zeros(len(name), np.int64)
    other[order] = np.repeat(size > 1, size)
    sums[order] = np.repeat(total, size)
    slot[order] = np.repeat(np.cumsum(size > 1) - 1, size)  # among the pairs of several chunks
    # any of a pair's chunks may seat it: which one, its hash says, so that no chunk seats more than its share
    owner[order[edge + ((name[order[edge]] & np.uint64(0xFFFFFFFF)) % size.astype(np.uint64)).astype(np.int64)]] = True
    out = []
    for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True):
        both = other[a:b]
        out.append([np.packbits(both).tobytes(), np.packbits(owner[a:b]).tobytes(), pack_small(sums[a:b][both]), pack_ascending(slot[a:b][both])])
    return out, [int((total == 1).sum()), int((total == 2).sum())]


def _answer_tables(held: list) -> tuple[list, list[int]]:
    slots = [np.frombuffer(x[0], "<u4").astype(np.int64) for x in held]
    size = 1 + max((int(s.max()) for s in slots if len(s)), default=-1)
    t_u, s_w = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for x, s in zip(held, slots, strict=True):  # a chunk names each word once
        t_u[s] += unpack_small(x[1], len(s))
        s_w[s] += unpack_small(x[2], len(s))
    return [[pack_small(t_u[s]), pack_small(s_w[s])] for s in slots], [int(s_w.sum()), int((s_w == 1).sum()), int((s_w == 2).sum())]


def _answer_sums(held: list) -> tuple[list, list[int]]:
    """Each pair's tables go from the chunk that seats it to all that hold it."""
    slots = [unpack_ascending(x[0], struct.unpack("<q", x[3])[0]) for x in held]
    tables = np.zeros(1 + max(int(s[-1]) for s in slots), np.int64)
    for x, s in zip(held, slots, strict=True):
        own = s[np.unpackbits(np.frombuffer(x[1], np.uint8), count=len(s)).astype(bool)]
        tables[own] = unpack_small(x[2], len(own))
    return [[pack_small(tables[s])] for s in slots], [0]


def _kneser(n1: int, n2: int) -> float:
    return min(max(n1 / (n1 + 2 * n2), 0.05), 0.98) if n1 else 0.5


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> DataFrame:
    """Scores of all rows by a model of the rows where ``held_out`` (a column) is false.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; scores are log10 probabilities.
    """
    if not 0 <= burn_in < sweeps:
        raise ValueError("some sweep must come after the burn-in")
    spark = docs.sparkSession
    rows = docs.select(F.spark_partition_id().alias("task"), F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held"), F.col(text_col).cast("string").alias("text"))
    manifest = _prepare(rows)
    entries = manifest.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_pairs"), F.lit(0)), F.count("*")).first()
    word_buckets, pair_buckets = (_spread(spark, int(x)) for x in entries[:2])
    tasks = min(max(1, entries[2]), MOST_TASKS)  # a chunk each, as far as that goes: rows this few would else end in one task
    words, sums = _Exchange(manifest, "words", word_buckets, tasks).run(_ask_words, _answer_words)
    n, v = sums if sums else (0, 0)
    pairs, sums = _Exchange(manifest, "pairs", pair_buckets, tasks).run(_ask_pairs, _answer_pairs)
    state = _State(word_buckets, pair_buckets, words, pairs, work_dir(spark, "seats"), (), n, v, _kneser(*(sums if sums else (0, 0))), ())
    for sweep in range(sweeps):

        def ask(chunk: Counts, buckets: int, now: _State = state, sweep: int = sweep) -> list:
            n_w, slot = now.counts(chunk)
            total, mine, _ = now.customers(chunk)
            t = now.seated(chunk, n_w, total, mine, sweep)
            now.store(chunk, sweep, t)
            t_u = np.bincount(chunk.u[mine], weights=t, minlength=len(chunk.voc)).astype(np.int64)
            s_w = np.bincount(chunk.w[mine], weights=t, minlength=len(chunk.voc)).astype(np.int64)
            at = _slices(chunk.voc, buckets)
            return [[slot[a:b].tobytes(), pack_small(t_u[a:b]), pack_small(s_w[a:b])] if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]

        folder, sums = _Exchange(manifest, f"sweep-{sweep}", word_buckets, tasks).run(ask, _answer_tables)
        s, n1, n2 = sums if sums else (0, 0, 0)
        state = replace(state, sweeps=(*state.sweeps, folder), root=(*state.root, (s, _kneser(n1, n2))))

    kept = range(burn_in, sweeps)

    def give(chunk: Counts, buckets: int, now: _State = state) -> list:
        _, mine, shared = now.customers(chunk)
        t = now.added(chunk, mine, kept)
        return [x and [x[1], np.packbits(mine[x[0]]).tobytes(), pack_small(t[x[0]][mine[x[0]]]), struct.pack("<q", len(x[0]))] for x in shared]

    state = replace(state, sums=_Exchange(manifest, "sums", pair_buckets, tasks).run(give, _answer_sums)[0])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            own = Counts.of(chunk)
            n_w, _ = state.counts(own)
            total, mine, shared = state.customers(own)
            p = len(kept) * total - state.discount * state.seatings(own, mine, shared, kept)
            for sweep in kept:
                t_u, s_w = state.tables(own, sweep)
                p += (STRENGTH + state.discount * t_u)[chunk.u] * state.root_p(s_w, sweep)[chunk.w]
            p /= (len(kept) * (STRENGTH + n_w))[chunk.u]
            base = np.log10((n_w + 0.5) / (state.n + 0.5 * (state.v + 1)))
            rows_ = [np.add.reduceat(x, chunk.starts) for x in (np.ones(len(chunk.word), np.int64), (n_w > 0)[chunk.word].astype(np.int64), base[chunk.word], np.log10(p)[chunk.pair])]
            yield pa.record_batch([chunk.doc_ids, pa.array(chunk.held), pa.array(rows_[0]), pa.array(rows_[1]), pa.array(np.full(len(chunk.held), state.n, np.int64)), pa.array(rows_[2]), pa.array(rows_[3])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(lean(final), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity by token of the model and of the base, for training and held-out rows."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1)
