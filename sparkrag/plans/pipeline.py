"""End to end: build a corpus of nodes, retrieve for a batch of questions, answer them, evaluate the runs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ExperimentProfile
from ..errors import ConfigError, RetrievalError
from ..operators import chunk, context, evaluate
from ..operators import vector_index as vi
from ..operators.ingest import quarantine
from ..schemas import require, valid_source_doc
from ..registry import Registry
from .models import DRIVERS, EMBEDDERS, EchoDriver, Embedder, HashingEmbedder, LLMDriver, embed_column, generate_column, token_counter


def _missing(strategy: str):
    def refuse(docs: DataFrame, c) -> DataFrame:
        raise NotImplementedError(f"fragmenter {strategy} has no implementation")

    return refuse


FRAGMENTERS = Registry(
    "fragmenter",
    token=lambda docs, c: chunk.token_windows(docs, c.chunk_size, c.overlap, keep=["metadata"] if "metadata" in docs.columns else []),
    semantic=_missing("semantic"),
    markdown=lambda docs, c: chunk.markdown_chunks(docs),
    recursive=_missing("recursive"),
)


def build_corpus(docs: DataFrame, profile: ExperimentProfile | None = None, now=None) -> tuple[DataFrame, DataFrame]:
    """(nodes, documents that were set aside). Fail-fast profiles stop at the first bad document instead."""
    profile = profile or ExperimentProfile()
    if profile.fail_fast:
        good, bad = require(docs, valid_source_doc(), "a document has no content"), docs.limit(0)
    else:
        good, bad = quarantine(docs, {"content": valid_source_doc()})
    chunks = FRAGMENTERS.create(profile.fragmenter.strategy, good, profile.fragmenter)
    return chunk.to_nodes(chunks, F.col("metadata") if "metadata" in chunks.columns else None, now), bad


@dataclass
class Retriever:
    """Dense, sparse or hybrid retrieval of a batch of queries (query_id, query) from nodes (node_id, content, vector)."""

    nodes: DataFrame
    embedder: Embedder = field(default_factory=lambda: HashingEmbedder(64))
    mode: str = "dense"
    alpha: float = 0.5
    metric: str = "cosine"
    rerank_k: int | None = None

    def __post_init__(self):
        if self.mode not in ("dense", "sparse", "hybrid"):
            raise ConfigError(f"unknown retrieval mode {self.mode!r}")

    def retrieve(self, queries: DataFrame, k: int = 10, filters: dict | None = None) -> DataFrame:
        if k < 1:
            raise RetrievalError("k must be at least 1")
        found = self._first(queries, self.rerank_k or k, filters)
        if self.rerank_k:
            texts = found.join(queries.select("query_id", "query"), "query_id").join(self.nodes.select("node_id", "content"), "node_id")
            found = vi.rerank(texts, F.round(vi.word_overlap("query", "content"), vi.DIGITS), k).select("query_id", "node_id", "score", "rank")
        return found

    def _first(self, queries: DataFrame, k: int, filters: dict | None) -> DataFrame:
        nodes = vi.where_equal(self.nodes, filters)
        if self.mode != "sparse":
            asked = embed_column(queries.select("query_id", "query"), self.embedder, "query", "query_vector")
            table = vi.VectorTable(nodes, self.embedder.dim, self.metric)
            if self.mode == "dense":
                return table.search_blocks(asked, k)
        terms = vi.term_frequencies(queries, "query_id", "query").withColumnRenamed("node_id", "query_id")
        if self.mode == "sparse":
            return vi.word_best(nodes, terms, k, "node_id", "content").select("query_id", "node_id", "score", "rank")
        words = vi.Words(terms, "content")
        return table.search_hybrid(asked, words if words.fits() else vi.sparse_scores(vi.term_frequencies(nodes, "node_id", "content", only=terms), terms), self.alpha, k)


def retriever(nodes: DataFrame, profile: ExperimentProfile) -> Retriever:
    r = profile.retrieval
    vi.VectorTable.from_config(profile.index, nodes)  # a backend without implementation, or an unknown one, is refused here
    return Retriever(nodes, EMBEDDERS.create(profile.embedder.model_name, dim=profile.index.embedding_dim), r.mode, r.alpha if r.alpha is not None else 0.5, rerank_k=r.top_k if r.reranker else None)


SYSTEM = "Answer from the context below."
MOST_FOUND = 100_000  # rows of runs that the driver sends to all tasks; more meet their nodes in a shuffle


def answer(queries: DataFrame, found: DataFrame, nodes: DataFrame, driver: LLMDriver | None = None, window: int = 4096, completion: int = 512, strategy: str = "priority") -> DataFrame:
    """query_id, query, chunks, prompt, generation_result, answer, sources (source ids in rank order, repeats kept)."""
    # the runs are few beside the nodes: made once and sent to them, so that no node is shuffled
    few = found.select("query_id", "node_id", "rank").limit(MOST_FOUND + 1).toArrow()
    if len(few) <= MOST_FOUND:
        found = F.broadcast(found.sparkSession.createDataFrame(few, found.select("query_id", "node_id", "rank").schema))
    rows = nodes.select("node_id", "source_id", "content").join(found, "node_id")
    # one shuffle with all columns, which both uses below read again; else each would scan the nodes
    rows = rows.groupBy("query_id").agg(F.collect_list(F.struct("rank", "source_id", "content")).alias("_r")).select("query_id", F.inline("_r"))
    sources = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source_id"))), lambda x: x.source_id).alias("sources"))
    driver = driver or EchoDriver()
    packed = context.fit_context(queries, rows.select("query_id", "rank", "content"), window, completion, SYSTEM, strategy, token_counter(driver) if hasattr(driver, "count_tokens") else context.count_tokens)
    out = generate_column(packed.select("query_id", "query", "chunks", "prompt"), driver, max_tokens=completion)
    return out.join(sources, "query_id", "left").withColumn("answer", F.col("generation_result.text"))


def driver_of(profile: ExperimentProfile) -> LLMDriver:
    g = profile.generator
    return DRIVERS.create("llama", g.model_path, g.context_window) if g and g.model_path else DRIVERS.create("echo")


def evaluate_runs(found: DataFrame, truth: DataFrame, ks: list[int] | None = None, parameters: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(values of each case, means) of runs (query_id, node_id, rank) against truth (query_id, relevant)."""
    values = evaluate.case_metrics(evaluate.lists(found, truth), ks, parameters=parameters)
    return values, evaluate.aggregate(values)
