"""A table of vectors: filtered exact search for batches of queries, paging, hybrid fusion, deletion and eviction.

A table is an immutable DataFrame; changes give a new one. Two ways of scoring give the same rows:

* ``search``: expressions in the JVM; for few queries. Filters come before scoring, so they reach the scan.
* ``search_blocks``: NumPy tiles in Arrow batches (``best``); for many. Queries go to all tasks only if they are within a
  quarter of ``MOST_QUERY_BYTES``, else blocks of them meet groups of nodes by a shuffle, one task for each pair. Each task
  keeps its k best a query, so the shuffle holds k rows a query and task, however many vectors there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import VectorIndexError
from ..functions.vectors import METRICS, norm, similarity
from ..registry import Registry
from .best import DIGITS, Best, Fused, Terms, Vectors, ids_of, matrix

MOST_QUERY_BYTES = 64 << 20  # of queries that a task holds; a quarter of it is sent to all tasks
FEW_QUERIES = 64  # that are compared by expressions
MOST_TOKENS = 1_000_000  # distinct query tokens that are broadcast to the words of the corpus; more meet them in a shuffle
RANGES = 256  # into which eviction cuts the order of its rows


@dataclass(frozen=True)
class Cursor:
    offset: int = 0
    page_size: int = 10
    total_results: int | None = None

    def __post_init__(self):
        if self.offset < 0 or not 1 <= self.page_size <= 1000:
            raise ValueError("offset must be at least 0 and page_size within 1 and 1000")


def where_equal(df: DataFrame, filters: dict[str, object] | None) -> DataFrame:
    """Rows whose columns equal all values; None matches null, as an absent key does."""
    tests = [F.col(k).eqNullSafe(F.lit(v)) for k, v in (filters or {}).items()]
    return df.where(reduce(Column.__and__, tests)) if tests else df


def ranked(scores: DataFrame, k: int | None, query: str = "query_id", node: str = "node_id") -> DataFrame:
    """Rank from 1 within each query, by descending score, then id; with k, the first k."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), node)
    out = scores.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k) if k is not None else out


def _fields(query: T.StructField, node: T.StructField) -> pa.Schema:
    return pa.schema([("query_id", to_arrow_type(query.dataType)), ("node_id", to_arrow_type(node.dataType)), ("score", pa.float64())])


def _ddl(query: T.StructField, node: T.StructField) -> str:
    return f"query_id {query.dataType.simpleString()}, node_id {node.dataType.simpleString()}, score double"


def _batches(best: Best, names: pa.Array, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    at, ids, score = best.rows()
    for i in range(0, len(at), 1 << 16):
        rows = slice(i, i + (1 << 16))
        yield pa.record_batch([names.take(pa.array(at[rows])).cast(fields[0].type), pa.array(ids[rows], fields[1].type), pa.array(score[rows])], schema=fields)


def _slices(queries: DataFrame, each: int) -> list[DataFrame]:
    """Queries of ``each`` bytes in slices that can be sent to all tasks."""
    size = max(1, -(-queries.count() * each // (MOST_QUERY_BYTES // 4 or 1)))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(size)) == i) for i in range(size)] if size > 1 else [queries]


@dataclass(frozen=True)
class Words:
    """Words of queries (query_id, token_id, weight), and where nodes have theirs: ``content``, a text whose lower-cased words
    are counted, or ``weights``, a map from words to weights. The terms of a batch go to all tasks, ``MOST_TOKENS`` at most."""

    terms: DataFrame
    content: str | None = None
    weights: str | None = None

    def fits(self) -> bool:
        return self.terms.count() <= MOST_TOKENS

    def columns(self) -> list[Column]:
        if self.content is not None:
            return [F.lower(self.content).cast("binary").alias("_text")]
        keys = F.transform(F.map_keys(self.weights), lambda x: x.cast("string").cast("binary"))
        return [keys.alias("_keys"), F.map_values(self.weights).cast("array<double>").alias("_values")]

    @property
    def postings(self) -> Callable[[Terms, pa.RecordBatch, int], tuple]:
        """The words of a batch's nodes, from the columns that begin at a place."""
        if self.content is not None:
            return lambda terms, batch, i: terms.of_texts(batch.column(i).to_pylist())
        return lambda terms, batch, i: terms.of_maps(batch.column(i), batch.column(i + 1))

    def collected(self, names: pa.Array) -> Terms:
        """The terms of these queries; other ones are left out."""
        got = self.terms.select("query_id", F.col("token_id").cast("string").cast("binary").alias("t"), F.col("weight").cast("double").alias("w")).toArrow()
        at = {x: i for i, x in enumerate(names.to_pylist())}
        at = np.fromiter((at.get(x, -1) for x in got.column(0).to_pylist()), np.int64, len(got))
        keep = at >= 0
        return Terms(at[keep], [t for t, yes in zip(got.column(1).to_pylist(), keep, strict=True) if yes], got.column(2).to_numpy()[keep], len(names))

    def _scan(self, nodes: DataFrame, node_id: str, make) -> DataFrame:
        """Rows (query_id, node_id, score) that ``make(terms, names, fields)`` gives for batches of (ids, words)."""
        rows = nodes.select(F.col(node_id).alias("node_id"), *self.columns())
        names = self.terms.select("query_id").distinct().toArrow().column(0).combine_chunks()
        id_field, node_field, of = self.terms.schema["query_id"], rows.schema["node_id"], self.postings
        fields, shared = _fields(id_field, node_field), nodes.sparkSession.sparkContext.broadcast((names, self.collected(names)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, terms = shared.value
            yield from make(((b.column(0), of(terms, b, 1)) for b in batches if b.num_rows and len(names)), terms, names, fields)

        return rows.mapInArrow(run, _ddl(id_field, node_field))

    def best(self, nodes: DataFrame, k: int, node_id: str = "node_id") -> DataFrame:
        """query_id, node_id, score, rank of the k nodes with the most in common; weights are greater than 0. Each task sends
        its k best a query, where ``sparse_scores`` would shuffle every common word."""

        def make(batches, terms, names, fields):
            best = Best(len(names), k)
            for ids, postings in batches:
                terms.add(best, ids_of(ids), postings)
            yield from _batches(best, names, fields)

        return ranked(self._scan(nodes, node_id, make), k)

    def scores(self, nodes: DataFrame, node_id: str = "node_id") -> DataFrame:
        """query_id, node_id, score of all pairs with a common word; weights are greater than 0. Each node's words are in one
        row, so nothing is shuffled. Ids of nodes must be distinct."""

        def make(batches, terms, names, fields):
            for ids, postings in batches:
                for mine, nodes, s in terms.tiles(postings, len(ids)):
                    at, of = np.nonzero(s > 0)
                    for i in range(0, len(at), 1 << 16):
                        a, b = at[i : i + (1 << 16)], of[i : i + (1 << 16)]
                        yield pa.record_batch([names.take(pa.array(a + mine.start)).cast(fields[0].type), ids.take(pa.array(b + nodes.start)).cast(fields[1].type), pa.array(s[a, b])], schema=fields)

        return self._scan(nodes, node_id, make)


class VectorTable:
    def __init__(self, df: DataFrame, dim: int, metric: str = "cosine", node_id: str = "node_id", vector: str = "vector", max_nodes: int | None = None, eviction: str = "lru", order: str | None = None):
        if metric not in METRICS:
            raise ValueError(f"unknown distance metric {metric!r}; known: {', '.join(METRICS)}")
        if eviction not in ("lru", "fifo"):
            raise ValueError(f"unknown eviction policy {eviction!r}")
        self.df, self.dim, self.metric, self.node_id, self.vector = df, dim, metric, node_id, vector
        self.max_nodes, self.eviction, self.order = max_nodes, eviction, order or node_id

    @classmethod
    def from_config(cls, config, df: DataFrame, **options) -> VectorTable:
        """The table that a profile's ``index`` section asks for; only "memory" has an implementation."""
        return INDEXES.create(config.backend, df, config, **options)

    def _new(self, df: DataFrame) -> VectorTable:
        return VectorTable(df, self.dim, self.metric, self.node_id, self.vector, self.max_nodes, self.eviction, self.order)

    def checked(self) -> DataFrame:
        """The rows; their evaluation fails at a vector of another length."""
        bad = F.raise_error(F.concat(F.lit(f"expected {self.dim} dimensions, got "), F.coalesce(F.size(self.vector).cast("string"), F.lit("none"))))
        return self.df.withColumn(self.vector, F.when(F.size(self.vector) == self.dim, F.col(self.vector)).otherwise(bad.cast(self.df.schema[self.vector].dataType)))

    def add(self, nodes: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> VectorTable:
        """Append nodes, then evict down to ``max_nodes``.

        No nodes change nothing. Nodes without a vector get one from ``embed`` (a function of a DataFrame without that column,
        such as ``plans.models.embed_column`` with its model given); without ``embed`` they are an error when rows are read,
        as are vectors of another length. Ids that are present, or come twice, are an error at once.
        """
        if nodes.isEmpty():
            return self
        if self.vector not in nodes.columns:
            nodes = nodes.withColumn(self.vector, F.lit(None).cast(self.df.schema[self.vector].dataType))
        clash = nodes.join(self.df.select(self.node_id), self.node_id, "left_semi").select(self.node_id)
        twice = nodes.groupBy(self.node_id).count().where("count > 1").select(self.node_id)
        if not clash.unionByName(twice).isEmpty():
            raise VectorIndexError("ids come twice or are in the table already; delete them first")
        if embed is not None:
            made = embed(nodes.where(F.col(self.vector).isNull()).drop(self.vector))
            nodes = nodes.where(F.col(self.vector).isNotNull()).unionByName(made, allowMissingColumns=True)
        nodes = self._new(nodes).checked()
        grown = self._new(self.df.unionByName(nodes, allowMissingColumns=True))
        return grown.evict() if self.max_nodes else grown

    def search(self, queries: DataFrame, k: int = 10, filters: dict[str, object] | None = None, query_vector: str = "query_vector") -> DataFrame:
        """query_id, node_id, score, rank for a batch of few queries (columns query_id and query_vector); more than
        ``FEW_QUERIES`` of them, or than ``MOST_QUERY_BYTES``, go the way of ``search_blocks``."""
        n = queries.count()
        if n > FEW_QUERIES or n * self.dim * 8 > MOST_QUERY_BYTES:
            return self.search_blocks(queries, k, filters, query_vector)
        nodes = where_equal(self.df, filters).select(F.col(self.node_id).alias("node_id"), F.col(self.vector).alias("_v"))
        # the nested loop sends the queries, not the table
        pairs = nodes.join(F.broadcast(queries.select("query_id", F.col(query_vector).alias("_q"))))
        scored = pairs.select("query_id", "node_id", F.round(similarity(self.metric, F.col("_v"), F.col("_q")), DIGITS).alias("score"))
        return ranked(scored, k)

    def search_blocks(self, queries: DataFrame, k: int = 10, filters: dict[str, object] | None = None, query_vector: str = "query_vector") -> DataFrame:
        """The same for many queries."""
        nodes = where_equal(self.df, filters).select(F.col(self.node_id).alias("node_id"), self._floats(self.df, self.vector).alias("v"))
        asked = queries.select("query_id", self._floats(queries, query_vector).alias("v"))
        size = queries.count() * (self.dim * 8 + k * 24)  # a query with its k best
        return ranked(self._scan(nodes, asked, k) if size <= MOST_QUERY_BYTES // 4 else self._grid(nodes, asked, k, size), k)

    @staticmethod
    def _floats(df: DataFrame, column: str) -> Column:
        """A column of vectors; single precision is left as it is."""
        return F.col(column) if df.schema[column].dataType == T.ArrayType(T.FloatType()) else F.col(column).cast("array<double>")

    def _scan(self, nodes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """The k best of each task a query; the queries go to all tasks."""
        got = asked.toArrow()  # bounded by MOST_QUERY_BYTES
        names, q = got.column(0).combine_chunks(), matrix(got.column(1), self.dim)
        dim, metric, shared = self.dim, self.metric, nodes.sparkSession.sparkContext.broadcast((names, q))
        fields = _fields(asked.schema["query_id"], nodes.schema["node_id"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            block, best = Vectors(q, metric), Best(len(q), k)
            for batch in batches:
                if batch.num_rows and len(q):
                    block.add(best, ids_of(batch.column(0)), matrix(batch.column(1), dim))
            yield from _batches(best, names, fields)

        return nodes.mapInArrow(run, _ddl(asked.schema["query_id"], nodes.schema["node_id"]))

    def _grid(self, nodes: DataFrame, asked: DataFrame, k: int, size: int) -> DataFrame:
        """The k best of each cell a query. Blocks of queries meet groups of nodes, each pair of them in one task, where the
        queries come first and the nodes stream past; ``size`` (bytes of all queries with their k best) sets the number of
        blocks. A task holds one block, whatever the number of nodes, and nothing goes to the driver."""
        blocks = max(1, -(-size // MOST_QUERY_BYTES))
        groups = max(1, -(-2 * nodes.sparkSession.sparkContext.defaultParallelism // blocks))
        dim, metric = self.dim, self.metric
        id_field, node_field = asked.schema["query_id"], nodes.schema["node_id"]
        fields = _fields(id_field, node_field)
        vector = nodes.schema["v"].dataType if nodes.schema["v"].dataType == asked.schema["v"].dataType else T.ArrayType(T.DoubleType())
        dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = asked.select("query_id", "v", dealt("query_id", blocks).alias("_b"), every(groups).alias("_g"))
        right = nodes.select("node_id", "v", every(blocks).alias("_b"), dealt("node_id", groups).alias("_g"))
        cell = (F.col("_b") * groups + F.col("_g")).cast("int").alias("_cell")
        left = left.select(cell, F.lit(False).alias("_node"), "query_id", F.lit(None).cast(node_field.dataType).alias("node_id"), F.col("v").cast(vector).alias("v"))
        right = right.select(cell, F.lit(True).alias("_node"), F.lit(None).cast(id_field.dataType).alias("query_id"), "node_id", F.col("v").cast(vector).alias("v"))
        rows = left.unionByName(right).repartitionById(blocks * groups, F.col("_cell")).sortWithinPartitions("_cell", "_node")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, names, parts, block, best = None, [], [], None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                key = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
                for a, b in zip(edges, edges[1:], strict=False):
                    at, node = divmod(int(key[a]), 2)
                    if at != now:
                        if best is not None:
                            yield from _batches(best, pa.concat_arrays(names), fields)
                        now, names, parts, block, best = at, [], [], None, None
                    x = matrix(batch.column(4).slice(a, b - a), dim)
                    if not node:
                        names.append(batch.column(2).slice(a, b - a))
                        parts.append(x.copy())
                    elif names:
                        if block is None:
                            block, best, parts = Vectors(np.concatenate(parts), metric), Best(sum(map(len, names)), k), []
                        block.add(best, ids_of(batch.column(3).slice(a, b - a)), x)
            if best is not None:
                yield from _batches(best, pa.concat_arrays(names), fields)

        return rows.mapInArrow(run, _ddl(id_field, node_field))

    def search_hybrid(self, queries: DataFrame, sparse: DataFrame | Words, alpha: float, k: int = 10, filters: dict[str, object] | None = None, query_vector: str = "query_vector") -> DataFrame:
        """alpha * dense + (1 - alpha) * sparse, each scaled to 0..1 over all nodes of a query; sparse: query_id, node_id, score.

        Nodes without sparse score have the same one, 0, so that their fused scores follow the dense ones. As long as no score
        is under 0, the first k are among the k best by the dense score and the nodes of ``sparse``; otherwise among as many
        more as a query has sparse scores. Where ``alpha`` is 0 and ids decide, the least ids take the place of the best. Only
        these, with the extremes of the dense scores, leave the scan.

        As the pairs of ``sparse`` can be as many as queries times nodes, words of queries (``Words``) are better: their
        products with a node's own words are made where its dense scores are, and pairs are not listed.
        """
        if isinstance(sparse, Words):
            nodes, each = where_equal(self.df, filters), self.dim * 8 + k * 24
            return ranked(reduce(DataFrame.unionByName, (self._fused(nodes, part, sparse, alpha, k, query_vector) for part in _slices(queries, each))), k)
        per = sparse.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.min("least"), F.lit(0.0)).alias("least")).first()
        more = k + per.n if per.least < 0 or alpha == 0 else k
        wanted = sparse.select("query_id", "node_id")
        if alpha == 0:
            least = where_equal(self.df, filters).select(F.col(self.node_id).alias("node_id")).orderBy("node_id").limit(more)
            wanted = wanted.unionByName(queries.select("query_id").crossJoin(least))
        dense = self.score_blocks(queries, more if alpha else k, wanted, filters, query_vector)
        return fuse(dense, sparse, alpha, k)

    def _fused(self, nodes: DataFrame, queries: DataFrame, words: Words, alpha: float, k: int, query_vector: str) -> DataFrame:
        """The k best of each task a query; one scan for the extremes, one for the scores."""
        got = queries.select("query_id", self._floats(queries, query_vector).alias("v")).toArrow()  # bounded by MOST_QUERY_BYTES
        names, q = got.column(0).combine_chunks(), matrix(got.column(1), self.dim)
        id_field, node_field, dim, metric = queries.schema["query_id"], nodes.schema[self.node_id], self.dim, self.metric
        shared = nodes.sparkSession.sparkContext.broadcast((names, q, words.collected(names)))
        rows = nodes.select(F.col(self.node_id).alias("node_id"), self._floats(nodes, self.vector).alias("v"), *words.columns())
        of = words.postings

        def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, terms = shared.value
            block, seen = Vectors(q, metric), 0
            low, high, low_s, high_s = (np.full(len(q), x) for x in (np.inf, -np.inf) * 2)
            for batch in batches:
                if not batch.num_rows or not len(q):
                    continue
                block.extremes(low, high, matrix(batch.column(0), dim))
                for mine, _, s in terms.tiles(of(terms, batch, 1), batch.num_rows):
                    low_s[mine], high_s[mine] = np.minimum(low_s[mine], s.min(1)), np.maximum(high_s[mine], s.max(1))
                seen += batch.num_rows
            if seen:
                yield pa.record_batch([pa.array(np.arange(len(q)), pa.int64()), *map(pa.array, (low, high, low_s, high_s))], names=["at", "lo", "hi", "s_lo", "s_hi"])

        spans = rows.drop("node_id").mapInArrow(extremes, "at bigint, lo double, hi double, s_lo double, s_hi double")
        spans = spans.groupBy("at").agg(*(f(c).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"), (F.min, "s_lo"), (F.max, "s_hi")))).toArrow().sort_by("at")
        bounds = np.stack([spans[c].to_numpy() for c in ("lo", "hi", "s_lo", "s_hi")], 1)  # a row a query, or none without nodes
        fields = _fields(id_field, node_field)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, terms = shared.value
            best, block = Best(len(q), k), Fused(Vectors(q, metric), terms, alpha, bounds[:, :2], bounds[:, 2:])
            for batch in batches:
                if batch.num_rows and len(q):
                    block.add(best, ids_of(batch.column(0)), matrix(batch.column(1), dim), of(terms, batch, 2))
            yield from _batches(best, names, fields)

        return rows.mapInArrow(run, _ddl(id_field, node_field))

    def score_blocks(self, queries: DataFrame, k: int, wanted: DataFrame, filters: dict[str, object] | None = None, query_vector: str = "query_vector") -> DataFrame:
        """query_id, node_id, dense, lo, hi, n: the k best nodes of each query and those that ``wanted`` (query_id, node_id)
        names, with the least and the greatest score and the number of all nodes of the query."""
        nodes = where_equal(self.df, filters)
        best = self.search_blocks(queries, k, filters, query_vector).select("query_id", "node_id", F.col("score").alias("dense"))
        asked = queries.select("query_id", F.col(query_vector).alias("_q"))
        named = wanted.select("query_id", "node_id").distinct().join(asked, "query_id").join(nodes.select(F.col(self.node_id).alias("node_id"), F.col(self.vector).alias("_v")), "node_id")
        named = named.select("query_id", "node_id", F.round(similarity(self.metric, F.col("_v"), F.col("_q")), DIGITS).alias("dense"))
        worst = VectorTable(self.df, self.dim, self.metric, self.node_id, self.vector)._extremes(nodes, queries, query_vector)
        return best.unionByName(named).distinct().join(worst, "query_id")

    def _extremes(self, nodes: DataFrame, queries: DataFrame, query_vector: str) -> DataFrame:
        """query_id, lo, hi, n over all nodes: each task sends one row a query."""
        nodes = nodes.select(self._floats(self.df, self.vector).alias("v"))
        asked = queries.select("query_id", self._floats(queries, query_vector).alias("v"))
        found = reduce(DataFrame.unionByName, (self._scan_extremes(nodes, part) for part in _slices(asked, self.dim * 8)))
        return found.groupBy("query_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))

    def _scan_extremes(self, nodes: DataFrame, asked: DataFrame) -> DataFrame:
        got = asked.toArrow()  # bounded by MOST_QUERY_BYTES
        names, q = got.column(0).combine_chunks(), matrix(got.column(1), self.dim)
        dim, metric, shared = self.dim, self.metric, nodes.sparkSession.sparkContext.broadcast((names, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            block, low, high, seen = Vectors(q, metric), np.full(len(q), np.inf), np.full(len(q), -np.inf), 0
            for batch in batches:
                if batch.num_rows and len(q):
                    block.extremes(low, high, matrix(batch.column(0), dim))
                    seen += batch.num_rows
            if seen:
                yield pa.record_batch([names, pa.array(low), pa.array(high), pa.array([seen] * len(names), pa.int64())], names=["query_id", "lo", "hi", "n"])

        return nodes.mapInArrow(run, f"query_id {asked.schema['query_id'].dataType.simpleString()}, lo double, hi double, n bigint")

    def search_page(self, queries: DataFrame, cursor: Cursor, filters: dict[str, object] | None = None) -> tuple[DataFrame, Cursor]:
        """Rows of one page, and the next cursor, whose total is the table's size."""
        last = cursor.offset + cursor.page_size
        page = self.search(queries, last, filters).where(F.col("rank") > cursor.offset)
        total = self.count()
        got = min(max(total - cursor.offset, 0), cursor.page_size) if not filters else page.groupBy("query_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        return page, Cursor(cursor.offset + got, cursor.page_size, total)

    def delete(self, ids: DataFrame | list) -> tuple[VectorTable, int]:
        """(table without the ids, number of rows that go); unknown and repeated ids do no harm."""
        gone = ids if isinstance(ids, DataFrame) else self.df.sparkSession.createDataFrame([(i,) for i in ids], f"{self.node_id} {self.df.schema[self.node_id].dataType.simpleString()}")
        n = self.df.join(gone, self.node_id, "left_semi").count()
        return self._new(self.df.join(gone, self.node_id, "left_anti")), n

    def exists(self, node_id: object) -> bool:
        return not self.df.where(F.col(self.node_id) == node_id).isEmpty()

    def exist(self, ids: DataFrame) -> DataFrame:
        """``ids`` with a column ``found``; the answer for a whole batch."""
        known = self.df.select(self.node_id).distinct().withColumn("found", F.lit(True))
        return ids.join(known, self.node_id, "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def count(self, by: str | None = None) -> int | DataFrame:
        """Number of rows; with ``by``, a table of the numbers by a column's values."""
        return self.df.count() if by is None else self.df.groupBy(by).agg(F.count("*").alias("n"))

    def clear(self) -> VectorTable:
        return self._new(self.df.limit(0))

    def evict(self, accesses: DataFrame | None = None) -> VectorTable:
        """The ``max_nodes`` rows that stay: last accessed ("lru"; never counts as first) or last added ("fifo").

        The cut-off on (time, order) is found by counting, not by sorting the rows that stay in one task: rows are counted by
        time, the times that stay whole are summed up over a few thousand ranges, and only the range in which the limit falls
        is looked at row by row.
        """
        if self.max_nodes is None:
            return self
        rows = self.df
        if self.eviction == "lru" and accesses is not None:
            last = accesses.groupBy(self.node_id).agg(F.max("accessed_at").alias("_at"))
            rows = rows.join(last, self.node_id, "left")
        else:
            rows = rows.withColumn("_at", F.lit(None).cast("timestamp"))
        key = F.struct(F.coalesce(F.unix_micros(F.col("_at").cast("timestamp")), F.lit(-(1 << 62))).alias("t"), F.col(self.order).alias("o"))
        rows = rows.select(self.node_id, key.alias("_key"))
        if rows.count() <= self.max_nodes:
            return self
        # a sample of keys cuts the order into ranges; a limit within a range is found in that range alone
        edges = sorted((r["_key"] for r in rows.select("_key").orderBy(F.xxhash64("_key")).limit(RANGES).collect()), key=lambda k: (k["t"], k["o"]), reverse=True)
        place = F.lit(len(edges))
        if edges:
            kind = rows.schema["_key"].dataType
            listed = rows.sparkSession.createDataFrame([([tuple(e) for e in edges],)], T.StructType([T.StructField("_edges", T.ArrayType(kind))]))
            rows = rows.crossJoin(F.broadcast(listed))  # one row of at most RANGES keys
            place = F.size(F.filter("_edges", lambda e: e > F.col("_key")))
        placed = rows.withColumn("_range", place).drop("_edges")
        before, limit = 0, None
        for r in sorted(placed.groupBy("_range").count().collect(), key=lambda r: r["_range"]):  # at most RANGES + 1 rows
            if before + r["count"] > self.max_nodes:
                limit = r["_range"]
                break
            before += r["count"]
        keep = placed.where(F.col("_range") < limit).select(self.node_id)
        rest = placed.where(F.col("_range") == limit).orderBy(F.desc("_key")).limit(self.max_nodes - before).select(self.node_id)
        return self._new(self.df.join(keep.unionByName(rest), self.node_id, "left_semi"))

    def save(self, path: str) -> None:
        """Parquet, with each vector's norm as column ``norm``."""
        self.df.withColumn("norm", norm(F.col(self.vector))).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, dim: int, **options) -> VectorTable:
        return cls(spark.read.parquet(path), dim, **options)


def postings(nodes: DataFrame, node_id: str = "node_id", sparse: str = "sparse_vector") -> DataFrame:
    """Inverted index: token_id, node_id, weight."""
    return nodes.select(F.col(node_id).alias("node_id"), F.explode(sparse).alias("token_id", "weight"))


def term_frequencies(nodes: DataFrame, node_id: str, content: str, only: DataFrame | None = None) -> DataFrame:
    """postings of lower-cased words with their counts as weights; with ``only`` (token_id), of those words alone, which are
    picked before anything is counted or shuffled (``MOST_TOKENS``)."""
    words = nodes.select(F.col(node_id).alias("node_id"), F.explode(F.regexp_extract_all(F.lower(content), F.lit(r"\S+"), F.lit(0))).alias("token_id"))
    if only is not None:
        tokens = only.select("token_id").distinct()
        words = words.join(F.broadcast(tokens) if tokens.count() <= MOST_TOKENS else tokens, "token_id", "left_semi")
    return words.groupBy("token_id", "node_id").agg(F.count("*").cast("double").alias("weight"))


def sparse_scores(index: DataFrame, query_terms: DataFrame) -> DataFrame:
    """query_id, node_id, score: products of weights of common tokens, summed; combined before the shuffle."""
    joined = index.join(query_terms.withColumnRenamed("weight", "_qw"), "token_id")
    return joined.groupBy("query_id", "node_id").agg(F.sum(F.col("_qw") * F.col("weight")).alias("score"))


def word_scores(nodes: DataFrame, terms: DataFrame, node_id: str, content: str) -> DataFrame:
    """query_id, node_id, score of all pairs with a common word of a text: ``sparse_scores`` of ``term_frequencies``, but by one
    scan without a shuffle as long as the queries' words can go to all tasks."""
    words = Words(terms, content)
    return words.scores(nodes, node_id) if words.fits() else sparse_scores(term_frequencies(nodes, node_id, content, terms), terms)


def word_best(nodes: DataFrame, terms: DataFrame, k: int, node_id: str, content: str) -> DataFrame:
    """The k first of ``word_scores`` with their rank; each task sends its k best a query."""
    words = Words(terms, content)
    return words.best(nodes, k, node_id) if words.fits() else ranked(sparse_scores(term_frequencies(nodes, node_id, content, terms), terms), k)


def min_max(scores: DataFrame, column: str = "score", query: str = "query_id", out: str | None = None) -> DataFrame:
    """Scores scaled to 0..1 within each query; all ones where they hardly differ (by less than 1e-8)."""
    span = scores.groupBy(query).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return scores.join(span, query).withColumn(out or column, scaled(F.col(column), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def scaled(x: Column, low: Column, high: Column) -> Column:
    return F.when(high - low < 1e-8, 1.0).otherwise((x - low) / F.nullif(high - low, F.lit(0.0)))


def fuse(dense: DataFrame, sparse: DataFrame, alpha: float, k: int | None) -> DataFrame:
    """Fusion from what ``VectorTable.score_blocks`` gives: dense scores with the extremes of their query, and sparse scores.

    Nodes without a sparse score have 0, which counts in the extremes if any node lacks one.
    """
    own = sparse.groupBy("query_id").agg(F.min("score").alias("s_lo"), F.max("score").alias("s_hi"), F.count("*").alias("s_n"))
    both = dense.join(sparse.select("query_id", "node_id", F.col("score").alias("sparse")), ["query_id", "node_id"], "left").join(own, "query_id", "left")
    all_have = F.coalesce(F.col("s_n"), F.lit(0)) >= F.col("n")
    s_lo = F.when(all_have, F.col("s_lo")).otherwise(F.least(F.coalesce("s_lo", F.lit(0.0)), F.lit(0.0)))
    s_hi = F.when(all_have, F.col("s_hi")).otherwise(F.greatest(F.coalesce("s_hi", F.lit(0.0)), F.lit(0.0)))
    x = scaled(F.col("dense"), F.col("lo"), F.col("hi"))
    y = scaled(F.coalesce("sparse", F.lit(0.0)), s_lo, s_hi)
    return ranked(both.select("query_id", "node_id", F.round(F.lit(float(alpha)) * x + F.lit(1.0 - alpha) * y, DIGITS).alias("score")), k)


def hybrid(dense: DataFrame, sparse: DataFrame, alpha: float, k: int | None = 10) -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse, both scaled over all nodes of a query; nodes without sparse score have 0."""
    both = dense.select("query_id", "node_id", F.col("score").alias("dense")).join(sparse.select("query_id", "node_id", F.col("score").alias("sparse")), ["query_id", "node_id"], "left").fillna({"sparse": 0.0})
    both = min_max(min_max(both, "dense"), "sparse")
    fused = both.select("query_id", "node_id", F.round(F.lit(float(alpha)) * F.col("dense") + F.lit(1.0 - alpha) * F.col("sparse"), DIGITS).alias("score"))
    return ranked(fused, k)


def reciprocal_rank_fusion(runs: list[DataFrame], k: int | None = 10, constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank) over ranked runs."""
    votes = reduce(DataFrame.unionByName, (r.select("query_id", "node_id", (F.lit(1.0) / (F.col("rank") + constant)).alias("_s")) for r in runs))
    return ranked(votes.groupBy("query_id", "node_id").agg(F.round(F.sum("_s"), DIGITS).alias("score")), k)


def rerank(candidates: DataFrame, score: Column, k: int) -> DataFrame:
    """Candidates ranked anew by a score column."""
    return ranked(candidates.drop("rank").withColumn("score", score), k)


def word_overlap(question: str, content: str) -> Column:
    """Share of a question's distinct words that a text has: a plain scorer for ``rerank``."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\S+"), F.lit(0)))
    return F.coalesce(F.size(F.array_intersect(words(question), words(content))) / F.nullif(F.size(words(question)), F.lit(0)), F.lit(0.0))


def _remote(backend: str):
    def refuse(df: DataFrame, config, **options) -> VectorTable:
        raise NotImplementedError(f"index backend {backend} has no implementation")

    return refuse


#: Makers of tables (rows, index section of a profile, options) by backend.
INDEXES = Registry("index", memory=lambda df, config, **options: VectorTable(df, config.embedding_dim, **options), qdrant=_remote("qdrant"), milvus=_remote("milvus"), lancedb=_remote("lancedb"))
