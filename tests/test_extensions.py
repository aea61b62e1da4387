import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrag.config import IndexConfig, StreamingMetricsConfig
from sparkrag.errors import ConfigError, UnsupportedBackendError, VectorIndexError
from sparkrag.functions.templates import PromptTemplate
from sparkrag.operators import best, chunk, evaluate, monitor
from sparkrag.operators import vector_index as vi
from sparkrag.plans import models
from sparkrag.sources import documents


def vectors(spark, n=40, dim=4, seed=0):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, [float(rng.randint(-5, 5)) for _ in range(dim)], i % 3) for i in range(n)], "node_id long, vector array<float>, kind int")


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
@pytest.mark.parametrize("shape", ["some", "none", "all", "negative"])
def test_hybrid_of_the_table_is_that_of_all_scores(spark, metric, shape):
    table = vi.VectorTable(vectors(spark), 4, metric)
    asked = vectors(spark, 3, seed=9).select(F.col("node_id").alias("query_id"), F.col("vector").alias("query_vector"))
    pairs = [(q, n, float((q * 7 + n * 5) % 11) - (20 if shape == "negative" else 0)) for q in range(3) for n in range(40) if shape in ("all",) or n % 4 == q]
    sparse = spark.createDataFrame([] if shape == "none" else pairs, "query_id long, node_id long, score double")
    for alpha in (0.0, 0.3, 1.0):
        want = vi.hybrid(table.search_blocks(asked, 40), sparse, alpha, 7).collect()
        got = table.search_hybrid(asked, sparse, alpha, 7).collect()
        assert sorted((r.query_id, r.rank, r.node_id, round(r.score, 6)) for r in got) == sorted((r.query_id, r.rank, r.node_id, round(r.score, 6)) for r in want)


def test_many_queries_take_the_way_of_blocks(spark, monkeypatch):
    table = vi.VectorTable(vectors(spark), 4)
    asked = vectors(spark, 5, seed=3).select(F.col("node_id").alias("query_id"), F.col("vector").alias("query_vector"))
    few = sorted(map(tuple, table.search(asked, 3).collect()))
    monkeypatch.setattr(vi, "MOST_QUERY_BYTES", 40)
    many = table.search(asked, 3)
    assert "MapInArrow" in many._jdf.queryExecution().executedPlan().toString() and sorted(map(tuple, many.select("query_id", "node_id", "score", "rank").collect())) == few


@pytest.mark.parametrize("n", [0, 1, 2])
def test_blocks_without_queries(spark, monkeypatch, n):
    """Queries are dealt over blocks by a hash, which leaves some of them empty."""
    table = vi.VectorTable(vectors(spark), 4)
    asked = vectors(spark, 2, seed=3).where(F.col("node_id") < n).select(F.col("node_id").alias("query_id"), F.col("vector").alias("query_vector"))
    few = sorted(map(tuple, table.search(asked, 3).collect()))
    monkeypatch.setattr(vi, "MOST_QUERY_BYTES", 8)
    assert len(few) == 3 * n and sorted(map(tuple, table.search_blocks(asked, 3).select("query_id", "node_id", "score", "rank").collect())) == few


@pytest.mark.parametrize("limit", [1, 7, 299, 300, 1000])
def test_eviction_keeps_the_newest(spark, limit, monkeypatch):
    monkeypatch.setattr(vi, "RANGES", 8)
    rows = spark.createDataFrame([(i,) for i in range(300)], "node_id long").withColumn("vector", F.array(F.lit(0.0)))
    seen = spark.createDataFrame([(i, (i * 37) % 50) for i in range(0, 300, 2)], "node_id long, s int").select("node_id", F.timestamp_seconds("s").alias("accessed_at"))
    for policy, accesses in (("fifo", None), ("lru", seen)):
        kept = {r.node_id for r in vi.VectorTable(rows, 1, max_nodes=limit, eviction=policy).evict(accesses).df.collect()}
        at = {i: (i * 37) % 50 for i in range(0, 300, 2)} if accesses is not None else {}
        assert kept == set(sorted(range(300), key=lambda i: (at.get(i, -1), i), reverse=True)[:limit])
    assert vi.VectorTable(rows.limit(0), 1, max_nodes=3).evict().count() == 0


def test_words_of_queries_alone(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "c d"), (3, None)], "id long, text string")
    only = spark.createDataFrame([("a",), ("d",), ("a",), ("x",)], "token_id string")
    want = [("a", 1, 2.0), ("d", 2, 1.0)]
    for most in (1000, 0):
        monkeypatch.setattr(vi, "MOST_TOKENS", most)
        assert sorted(map(tuple, vi.term_frequencies(docs, "id", "text", only).collect())) == want


def test_add_and_backends(spark):
    table = vi.VectorTable(vectors(spark), 4)
    assert table.add(table.df.limit(0)) is table
    with pytest.raises(VectorIndexError):
        table.add(vectors(spark, 1))
    with pytest.raises(NotImplementedError):
        vi.VectorTable.from_config(IndexConfig(backend="qdrant", connection={"h": 1}), table.df)
    with pytest.raises(UnsupportedBackendError):
        vi.INDEXES.create("nothing", table.df, IndexConfig())
    with pytest.raises(Exception, match="expected 4 dimensions, got none"):
        table.add(spark.createDataFrame([(99,)], "node_id long")).df.collect()


def test_templates_choose_and_repeat(spark):
    t = PromptTemplate("{% if xs %}{% for x in xs %}{{ loop.index }}={{ x | upper }};{% endfor %}{% elif not note %}none{% else %}{{ note | trim }}{% endif %}{% if kind != 'a' %}!{% endif %}")
    assert t.variables == ["kind", "note", "xs"] and t.missing({"kind"}) == ["note", "xs"]
    rows = [(["p", None], "n", "a"), ([], None, "b"), (None, " q ", None), ([], "", "a")]
    df = spark.createDataFrame(rows, "xs array<string>, note string, kind string")
    got = [r[0] for r in df.select(t.render(xs=F.col("xs"), note=F.col("note"), kind=F.col("kind"))).collect()]
    assert got == ["1=P;2=;", "none!", "q!", "none"]
    assert [t.format(xs=a, note=b, kind=c) for a, b, c in rows] == got
    for bad in ("{% for x of y %}", "{% if %}{% endif %}", "{% for x in y %}", "{{ x | shout }}", "{% endfor %}"):
        with pytest.raises(ConfigError):
            PromptTemplate(bad)


def test_token_ends_by_ranks(tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    make = chunk.tiktoken_offsets(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ends = make()
    for text in ("Hello world", "naïve 你好 😀 text", "", "  a\n\nb"):
        found = ends(text)
        assert (found[-1] if found else 0) == len(text) and found == sorted(found)


def test_windows_by_ranks(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([("a", "one two three four five six seven eight nine ten" * 20), ("b", None)], "source_id string, content string")
    rows = chunk.windows_by(docs, chunk.tiktoken_offsets(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), 50, 0).orderBy("chunk_index").collect()
    assert "".join(r.content for r in rows) == docs.first().content and {r.source_id for r in rows} == {"a"}


def test_drivers_load_and_release(spark):
    seen = []

    class Model(models.Lifecycle):
        context_window = 10

        def load(self):
            seen.append("load")

        def close(self):
            seen.append("close")

        def count_tokens(self, texts):
            return [len(t.split()) for t in texts]

    with Model() as m:
        df = spark.createDataFrame([("a b c",), (None,)], "t string")
        assert [r[0] for r in df.select(models.token_counter(m)(F.col("t"))).collect()] == [3, 0]
    assert seen == ["load", "close"]
    assert models.EchoDriver().count_tokens(["x" * 11, ""]) == [2, 1]
    with pytest.raises(Exception, match="llama-cpp"):
        models.LlamaDriver("m.gguf").count_tokens(["x"])


def test_monitors_and_metric_parameters(spark):
    q = monitor.QueueMonitor(4, StreamingMetricsConfig(max_samples=12))
    for i in range(20):
        q.record(i % 6)
    assert q.summary()["total_samples"] == 12 and len(q.configure(max_samples=10).sizes) == 10
    with pytest.raises(ConfigError):
        q.configure(max_samples=1)
    assert monitor.combined_summary(None, monitor.QueueMonitor(1)) == {"streaming": {}}
    with pytest.raises(TypeError):
        evaluate.METRICS.get("recall@3", nonsense=1)(F.lit(1), F.lit(2))


def test_written_files_are_whole(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", bytearray(b"x")), ("b.bin", None)], "name string, data binary")
    paths = {r.name: r.path for r in documents.write_files(rows, f"file://{tmp_path}/d").collect()}
    assert open(paths["a.txt"], "rb").read() == b"x" and open(paths["b.bin"], "rb").read() == b""
    with pytest.raises(ValueError):
        documents.write_files(rows, "hdfs://x/y")
    assert documents.INGESTORS.names() == ["fitz", "text"]


def test_sparse_embedding_counts_words(spark):
    df = spark.createDataFrame([("a b a A",), ("",), (None,)], "content string")
    got = [sorted(r.sparse_vector.values()) for r in models.sparse_embed(df).collect()]
    assert got == [[1.0, 3.0], [], []]


def test_sparse_embedding_keeps_words_apart(spark):
    """These words have equal 31-bit hashes, so that they were one entry."""
    by = {}
    for w, h in spark.range(200_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("w")).select("w", F.hash("w").bitwiseAND(0x7FFFFFFF)).collect():
        by.setdefault(h, []).append(w)
    alike = next(ws for ws in by.values() if len(ws) > 1)
    row = models.sparse_embed(spark.createDataFrame([(" ".join(alike),)], "content string")).first()
    assert sorted(row.sparse_vector.values()) == [1.0] * len(alike)


def plain_best(q, v, metric, k):
    out = []
    for i, a in enumerate(q):
        d = v.astype(float) @ a.astype(float)
        s = {"dot": d, "cosine": d / (np.linalg.norm(v.astype(float), axis=1) * np.linalg.norm(a.astype(float)) + 1e-8), "euclidean": -np.sqrt(((v.astype(float) - a) ** 2).sum(1))}[metric]
        s = np.round(s, 9) + 0.0
        out += [(i, int(j), float(s[j])) for j in np.lexsort((np.arange(len(v)), -s))[:k]]
    return out


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
@pytest.mark.parametrize("kind", ["random", "copies", "tiny", "huge"])
def test_best_of_tiles_are_those_of_all_scores(metric, kind, monkeypatch):
    monkeypatch.setattr(best, "TILE", (7, 31))
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 6)).astype(np.float32)
    if kind == "copies":
        v[::3], v[5] = v[0], 0
    v *= {"tiny": 1e-5, "huge": 1e18}.get(kind, 1)
    q = np.concatenate([v[:20] + np.float32(0), v[:3] * np.float32(0.5)])
    for k in (1, 10, 64, 800):
        block, found = best.Vectors(q, metric), best.Best(len(q), k)
        for i in range(0, 700, 90):
            block.add(found, np.arange(i, min(i + 90, 700)), v[i : i + 90])
        want = plain_best(q, v, metric, k)
        at, ids, score = found.rows()
        assert len(at) == len(want) and np.array_equal(at, [w[0] for w in want])
        if kind != "huge":  # where the digits that are rounded are beyond a double's
            assert np.array_equal(ids, [w[1] for w in want])
        assert np.allclose(score, [w[2] for w in want], rtol=1e-12, atol=2e-9)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_blocks_meet_groups(spark, monkeypatch, metric):
    """Nothing of many queries is collected, and a task holds a block of them."""
    table = vi.VectorTable(vectors(spark, 300, seed=1), 4, metric)
    asked = table.df.select(F.col("node_id").alias("query_id"), F.col("vector").alias("query_vector"))
    want = sorted(map(tuple, table.search_blocks(asked, 4, {"kind": 1}).collect()))
    monkeypatch.setattr(vi, "MOST_QUERY_BYTES", 5000)
    monkeypatch.setattr(vi.VectorTable, "_scan", None)
    assert len(want) == 1200 and sorted(map(tuple, table.search_blocks(asked, 4, {"kind": 1}).collect())) == want


def test_memory_does_not_grow_with_a_batch():
    """A product of all queries and a batch took 4,000 x 10,000 scores at once, 320 MB, and a copy."""
    import tracemalloc

    rng = np.random.default_rng(0)
    q, v = rng.normal(size=(4000, 16)).astype(np.float32), rng.normal(size=(10_000, 16)).astype(np.float32)
    block, found = best.Vectors(q, "cosine"), best.Best(len(q), 10)
    tracemalloc.start()
    block.add(found, np.arange(len(v)), v)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20 and (found.n == 10).all()


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_hybrid_of_words_is_that_of_all_pairs(spark, metric, monkeypatch):
    """Sparse scores are made beside the dense ones; a list of all pairs with a common word is not needed."""
    nodes = vectors(spark, 60, seed=2).withColumn("words", F.create_map(F.col("kind"), F.lit(1.0) + F.col("node_id") % 4, F.lit(9), F.when(F.col("node_id") % 5 == 0, -2.0).otherwise(0.0)))
    asked = vectors(spark, 6, seed=9).select(F.col("node_id").alias("query_id"), F.col("vector").alias("query_vector"))
    terms = spark.createDataFrame([(q, t, float(q + t) / 4) for q in range(5) for t in (0, 1, 9) if (q + t) % 3], "query_id long, token_id int, weight double")
    table = vi.VectorTable(nodes, 4, metric)
    pairs = vi.sparse_scores(vi.postings(nodes, sparse="words"), terms)
    for alpha, most in ((0.0, 2000), (0.3, vi.MOST_QUERY_BYTES), (1.0, 1000)):
        want = vi.hybrid(table.search_blocks(asked, 60), pairs, alpha, 7).collect()
        monkeypatch.setattr(vi, "MOST_QUERY_BYTES", most)
        got = table.search_hybrid(asked, vi.Words(terms, weights="words"), alpha, 7).collect()
        assert sorted((r.query_id, r.rank, r.node_id, round(r.score, 6)) for r in got) == sorted((r.query_id, r.rank, r.node_id, round(r.score, 6)) for r in want)
        monkeypatch.undo()
    assert table.search_hybrid(asked, vi.Words(terms, weights="words"), 0.5, 7, {"kind": 99}).count() == 0


def test_scores_of_words_without_a_shuffle(spark):
    texts = ["a b a", "B\u00a0c b", None, "", "x y\x0bz", "\u00c4 a\n\tb", "c " * 50] + [f"w{i % 7} a{i} b" for i in range(30)]
    nodes = spark.createDataFrame([(f"n{i:02}", t) for i, t in enumerate(texts)], "node_id string, content string")
    terms = vi.term_frequencies(spark.createDataFrame([(1, "a b b"), (2, "\u00e4 c w3 z"), (3, "none"), (4, None)], "q int, t string"), "q", "t").withColumnRenamed("node_id", "query_id")
    pairs = vi.sparse_scores(vi.term_frequencies(nodes, "node_id", "content", terms), terms)
    words = vi.Words(terms, "content")
    made = words.scores(nodes)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, pairs.collect()))
    assert sorted(map(tuple, words.best(nodes, 3).collect())) == sorted(map(tuple, vi.ranked(pairs, 3).collect()))
