"""Queries for sources, sinks, profiles, registries, drivers and monitors; they join those of ``queries``.

Files are written below the session's shared folder and read back, so each such query is a round trip.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import config, errors, reports, schemas
from .functions import text as tx
from .functions.templates import BUILTIN, PromptTemplate
from .operators import chunk, context, evaluate, ingest, monitor, qa
from .operators import vector_index as vi
from .plans import models, pipeline
from .queries import _TF, _windows_sql, _vectors, query, scratch, table
from .sources import documents as sources
from .sources import json_files
from .streaming import operators as streaming


def _local(path: str) -> str:
    """A path for files that the driver writes itself."""
    return "/" + path.removeprefix("file:").lstrip("/")


# ------------------------------------------------------------------ files in

#: Page files by page_id % 5: text, text with a byte-order mark, bytes that are no UTF-8, blank, unknown format.
_FILE_SQL = """WITH p AS (SELECT page_id, page_id % 5 AS kind, 'Page ' || page_id || chr(10) || coalesce(url, '') AS body FROM pages)
SELECT page_id, CASE WHEN kind < 2 THEN sha256(body) END AS source_id, CASE WHEN kind = 4 THEN 'application/octet-stream' WHEN kind = 1 THEN 'text/markdown' ELSE 'text/plain' END AS mime_type,
       CASE WHEN kind < 2 THEN 1 END AS page_count, CASE kind WHEN 2 THEN 'not UTF-8' WHEN 3 THEN 'no text in the document' WHEN 4 THEN 'unsupported format .dat' END AS error FROM p"""


def _page_files(s, d) -> DataFrame:
    body = F.concat(F.lit("Page "), F.col("page_id").cast("string"), F.lit("\n"), F.coalesce("url", F.lit("")))
    kind = F.col("page_id") % 5
    data = F.when(kind == 0, F.concat(F.lit(" "), body, F.lit("\n")).cast("binary")).when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), body.cast("binary"))).when(kind == 2, F.unhex(F.lit("FFFE00C3"))).when(kind == 3, F.lit(" \n\t ").cast("binary")).otherwise(F.lit("x").cast("binary"))
    name = F.concat(F.col("page_id").cast("string"), F.when(kind == 4, ".dat").when(kind == 1, ".MD").otherwise(".txt"))
    folder = scratch(s, "files")
    sources.write_files(table(s, d, "pages").select(name.alias("name"), data.alias("data")), f"{folder}/pages").write.parquet(f"{folder}/manifest")
    return sources.INGESTORS.create("text", s, f"{folder}/pages")


@query("files_ingest", _FILE_SQL)
def _(s, d):
    page = F.regexp_extract(F.col("metadata")["source"], r"/(\d+)\.\w+$", 1).cast("long")
    return _page_files(s, d).select(page.alias("page_id"), "source_id", "mime_type", "page_count", F.regexp_extract("error", "^(not UTF-8|.*)", 1).alias("error"))


@query("files_quarantine", f"WITH f AS ({_FILE_SQL}) SELECT error IS NULL AS good, count(*) AS n FROM f GROUP BY 1")
def _(s, d):
    good, bad = ingest.quarantine(_page_files(s, d), {"read": F.col("error").isNull()})
    return good.select(F.lit(True).alias("good")).unionByName(bad.select(F.lit(False).alias("good"))).groupBy("good").agg(F.count("*").alias("n"))


@query("ingest_unicode_nfc", "SELECT doc_id, sha256(nfc_normalize(text || 'e' || chr(769) || ' A' || chr(778))) AS h FROM documents")
def _(s, d):
    rows = table(s, d, "documents").select("doc_id", F.concat("text", F.lit("é Å")).alias("text"))
    return sources.nfc(rows, "text").select("doc_id", F.sha2("text", 256).alias("h"))


# ------------------------------------------------------------------ files out and in again


@query("json_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def _(s, d):
    path = _local(scratch(s, "json")) + "/rows.json"
    rows = table(s, d, "conversations")
    json_files.write_json(rows, path)
    return json_files.read_json(s, f"file://{path}", rows.schema)


@query("jsonl_round_trip", "SELECT doc_id, text, lang, n_chars FROM documents")
def _(s, d):
    path = scratch(s, "jsonl")
    rows = table(s, d, "documents").select("doc_id", "text", "lang", "n_chars")
    json_files.write_jsonl(rows, path, ["doc_id"])
    return json_files.read_jsonl(s, path, rows.schema)


@query("yaml_round_trip", "SELECT * FROM nation")
def _(s, d):
    path = _local(scratch(s, "yaml")) + "/nation.yaml"
    rows = table(s, d, "nation")
    json_files.write_yaml(rows, path)
    return json_files.read_yaml(s, path, rows.schema)


@query("trial_cases_load", "SELECT sha256(text) AS case_id, text AS question, 'answer ' || item_id AS ground_truth_answer FROM benchmark")
def _(s, d):
    path = scratch(s, "cases") + ".jsonl"
    cases = table(s, d, "benchmark").select(F.lit(None).cast("string").alias("case_id"), F.col("text").alias("question"), F.concat(F.lit("answer "), F.col("item_id").cast("string")).alias("ground_truth_answer"))
    json_files.write_jsonl(cases, path)
    return json_files.load_cases(s, path).select("case_id", "question", "ground_truth_answer")


# ------------------------------------------------------------------ profiles


def _rows(s, rows: list[tuple], schema: str) -> DataFrame:
    return s.createDataFrame(rows, schema)


_FLAT = {"fragmenter.chunk_size": "256", "fragmenter.overlap": "64", "fragmenter.strategy": "token", "index.backend": "memory", "index.embedding_dim": "384", "retrieval.mode": "dense", "retrieval.top_k": "10", "embedder.batch_size": "32", "fail_fast": "True"}
_FLAT_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _FLAT.items()) + ") t(path, value)"


@query("profile_yaml_round_trip", _FLAT_SQL)
def _(s, d):
    path = _local(scratch(s, "profile")) + "/profile.yaml"
    config.ExperimentProfile().to_yaml(path)
    flat = config._flat(config.ExperimentProfile.from_yaml(path).to_dict())
    return _rows(s, [(k, str(flat[k])) for k in _FLAT], "path string, value string")


@query("profile_paths", "SELECT 'generator.model_path' AS path, true AS absolute UNION ALL SELECT 'evaluation.trial_cases_path', true UNION ALL SELECT 'retrieval.mode', false")
def _(s, d):
    folder = _local(scratch(s, "profile"))
    Path(folder).mkdir(parents=True)
    Path(f"{folder}/p.yaml").write_text("generator: {model_path: ./models/m.gguf}\nevaluation: {trial_cases_path: cases.jsonl}\nretrieval: {mode: sparse}\n", encoding="utf-8")
    flat = config._flat(config.ExperimentProfile.from_yaml(f"{folder}/p.yaml").to_dict())
    return _rows(s, [(k, str(flat[k]).startswith(folder)) for k in ("generator.model_path", "evaluation.trial_cases_path", "retrieval.mode")], "path string, absolute boolean")


@query("profile_overrides_diff", "SELECT n_nationkey, 'retrieval.top_k' AS path, '10' AS before, CAST(1 + n_nationkey AS VARCHAR) AS after FROM nation WHERE n_nationkey <> 9 UNION ALL SELECT n_nationkey, 'fragmenter.overlap', '64', CAST(n_nationkey AS VARCHAR) FROM nation")
def _(s, d):
    base, out = config.ExperimentProfile(), []
    for r in table(s, d, "nation").select("n_nationkey").collect():  # 25 rows, a profile each
        other = base.with_overrides({"retrieval.top_k": 1 + r[0], "fragmenter.overlap": r[0]})
        out += [(r[0], k, str(a), str(b)) for k, (a, b) in base.diff(other).items()]
    return _rows(s, out, "n_nationkey int, path string, before string, after string")


@query("profile_hash", "SELECT n_nationkey, true AS same_for_equal, n_nationkey <> 9 AS differs_from_default FROM nation")
def _(s, d):
    base = config.ExperimentProfile()
    rows = [(r[0], base.with_overrides({"retrieval.top_k": 1 + r[0]})) for r in table(s, d, "nation").select("n_nationkey").collect()]
    return _rows(s, [(k, p.compute_hash() == config.ExperimentProfile.from_dict(p.to_dict()).compute_hash() and len(p.compute_hash()) == 64, p.compute_hash() != base.compute_hash()) for k, p in rows], "n_nationkey int, same_for_equal boolean, differs_from_default boolean")


def _accepts(make) -> bool:
    try:
        make()
    except errors.ConfigError:
        return False
    return True


@query("profile_limits", """WITH n AS (SELECT n_nationkey AS k FROM nation)
SELECT 'fragmenter' AS part, k, k * 400 BETWEEN 50 AND 8192 AND 100 < k * 400 AS accepted FROM n UNION ALL SELECT 'index', k, k * 200 BETWEEN 64 AND 4096 FROM n
UNION ALL SELECT 'top_k', k, k * 5 BETWEEN 1 AND 100 FROM n UNION ALL SELECT 'hybrid', k, k % 2 = 0 FROM n UNION ALL SELECT 'generator', k, k * 100 BETWEEN 512 AND 128000 FROM n
UNION ALL SELECT 'questions', k, k BETWEEN 1 AND 10 FROM n UNION ALL SELECT 'streaming', k, k * 0.05 BETWEEN 0.5 AND 1 FROM n UNION ALL SELECT 'remote', k, k % 3 = 0 FROM n UNION ALL SELECT 'embedder', k, k >= 1 FROM n""")
def _(s, d):
    c, out = config, []
    for (k,) in table(s, d, "nation").select("n_nationkey").collect():
        tests = {
            "fragmenter": lambda k=k: c.FragmenterConfig(chunk_size=k * 400, overlap=100),
            "index": lambda k=k: c.IndexConfig(embedding_dim=k * 200),
            "top_k": lambda k=k: c.RetrievalConfig(top_k=k * 5),
            "hybrid": lambda k=k: c.RetrievalConfig(mode="hybrid", alpha=0.5 if k % 2 == 0 else None),
            "generator": lambda k=k: c.GeneratorConfig(context_window=k * 100),
            "questions": lambda k=k: c.QuestionGeneratorConfig(num_questions=k),
            "streaming": lambda k=k: c.StreamingMetricsConfig(backpressure_threshold=round(k * 0.05, 2)),
            "remote": lambda k=k: c.IndexConfig(backend="qdrant", connection={"host": "h"} if k % 3 == 0 else None),
            "embedder": lambda k=k: c.EmbedderConfig(batch_size=k),
        }
        out += [(name, k, _accepts(make)) for name, make in tests.items()]
    return _rows(s, out, "part string, k int, accepted boolean")


@query("profile_bad_overrides", "SELECT * FROM (VALUES ('no.such', true), ('retrieval.top_k', true), ('retrieval.nothing', true), ('fail_fast', false)) t(path, refused)")
def _(s, d):
    out = []
    for path, value in (("no.such", 1), ("retrieval.top_k", 1000), ("retrieval.nothing", 1), ("fail_fast", False)):
        try:
            config.ExperimentProfile().with_overrides({path: value})
            out.append((path, False))
        except errors.ConfigOverrideError:
            out.append((path, True))
    return _rows(s, out, "path string, refused boolean")


@query("error_tree", "SELECT * FROM (VALUES ('ConfigError', 'SparkRagError'), ('ConfigOverrideError', 'ConfigError'), ('UnsupportedBackendError', 'ConfigError'), ('IngestionError', 'SparkRagError'), ('FragmentationError', 'SparkRagError'), ('VectorIndexError', 'SparkRagError'), ('RetrievalError', 'SparkRagError'), ('EmbeddingError', 'SparkRagError'), ('GenerationError', 'SparkRagError'), ('EvaluationError', 'SparkRagError'), ('MetricValidationError', 'EvaluationError'), ('QuestionGenerationError', 'SparkRagError'), ('SparkRagError', 'Exception')) t(name, parent)")
def _(s, d):
    kinds = [x for x in vars(errors).values() if isinstance(x, type) and issubclass(x, Exception)]
    return _rows(s, [(x.__name__, x.__mro__[1].__name__) for x in kinds], "name string, parent string")


# ------------------------------------------------------------------ row types


@query("row_validity", """SELECT doc_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0 AND doc_id % 3 < 2 AS valid_node, doc_id % 3 < 2 AS valid_position, doc_id % 4 <> 3 AND doc_id % 5 <> 4 AS valid_generation, doc_id % 7 >= 1 AS valid_rank FROM documents""")
def _(s, d):
    i = F.col("doc_id")
    place = F.struct(F.lit(5).alias("start_char"), (i % 3 * -3 + 9).cast("int").alias("end_char"), F.when(i % 2 == 0, 1).alias("page"), F.lit(None).cast("string").alias("section"))
    usage = F.struct(F.lit(1).alias("prompt_tokens"), F.when(i % 4 == 3, -1).otherwise(0).alias("completion_tokens"), F.lit(1).alias("total_tokens"))
    result = F.struct(F.lit("").alias("text"), usage.alias("usage"), F.when(i % 5 == 4, "because").otherwise("stop").alias("finish_reason"))
    rows = table(s, d, "documents").select("doc_id", F.col("text").alias("content"), place.alias("position"), result.alias("generation_result"), (i % 7).cast("int").alias("rank"))
    return rows.select("doc_id", schemas.valid_node().alias("valid_node"), schemas.valid_position().alias("valid_position"), schemas.valid_generation().alias("valid_generation"), schemas.valid_retrieved().alias("valid_rank"))


@query("trial_case_toggle", "SELECT conv_id::VARCHAR AS node_id, count(*) AS cases, 0 AS with_ids FROM conversations WHERE role = 'user' GROUP BY 1")
def _(s, d):
    pairs = table(s, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("text").alias("question"), F.lit("an answer").alias("answer"), F.lit(0.5).alias("confidence"), F.lit("t").alias("generated_at")))).alias("p"))
    quality = F.struct(F.col("p").alias("qa_pairs"), F.lit("t").alias("generated_at"), F.lit("m").alias("model"), F.lit(3).alias("num_questions_requested"), F.size("p").alias("num_questions_validated"), F.lit("b").alias("batch_id"))
    nodes = pairs.select(F.col("conv_id").cast("string").alias("node_id"), F.lit("s").alias("source_id"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata"), quality.alias("synthetic_qa"))
    cases = qa.to_trial_cases(nodes, ground_truth_ids=False)
    return cases.groupBy(F.col("metadata")["source_node_id"].alias("node_id")).agg(F.count("*").alias("cases"), F.count("ground_truth_node_ids").cast("int").alias("with_ids"))


# ------------------------------------------------------------------ index

_NORM_SQL = "round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6)"


@query("index_save_load", f"SELECT vec_id, {_NORM_SQL} AS norm, label FROM embeddings")
def _(s, d):
    path = scratch(s, "index")
    _vectors(s, d).save(path)
    return vi.VectorTable.load(s, path, 64, node_id="vec_id", vector="embedding").df.select("vec_id", F.round("norm", 6).alias("norm"), "label")


@query("index_clear", "SELECT 0 AS cleared, count(*) AS kept FROM embeddings")
def _(s, d):
    t = _vectors(s, d)
    return t.df.agg(F.count("*").alias("kept")).join(t.clear().df.agg(F.count("*").cast("int").alias("cleared")))


@query("profile_index", "SELECT 'memory' AS backend, 'made' AS outcome, count(*) AS n FROM embeddings UNION ALL SELECT * FROM (VALUES ('lancedb', 'not implemented', 0), ('milvus', 'not implemented', 0), ('qdrant', 'not implemented', 0), ('other', 'unsupported', 0))")
def _(s, d):
    out = []
    for backend in (*vi.INDEXES.names(), "other"):
        c = config.IndexConfig(backend=backend, embedding_dim=64, connection={"host": "h"})
        try:
            out.append((backend, "made", vi.VectorTable.from_config(c, table(s, d, "embeddings"), node_id="vec_id", vector="embedding").count()))
        except NotImplementedError:
            out.append((backend, "not implemented", 0))
        except errors.UnsupportedBackendError:
            out.append((backend, "unsupported", 0))
    return _rows(s, out, "backend string, outcome string, n long")


@dataclass
class LetterEmbedder:
    """Counts of the letters a to z of a text: a model that SQL can compute too."""

    dim: int = 26

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([[t.lower().count(chr(97 + i)) for i in range(26)] for t in texts], np.float32).reshape(len(texts), 26)


_LETTERS = "list_transform(range(97, 123), lambda c: CAST(length({0}) - length(replace({0}, chr(CAST(c AS INTEGER)), '')) AS DOUBLE))"


@query("index_add_embeds", f"SELECT doc_id, list_sum({_LETTERS.format('lower(text)')}) AS letters, 26 AS dim FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, 0.0, 26 FROM documents WHERE doc_id % 2 = 0")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", F.col("text").alias("content"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), 26)
    start = vi.VectorTable(docs.where("doc_id % 4 = 0").withColumn("vector", zero), 26, node_id="doc_id")
    new = docs.where("doc_id % 4 <> 0").withColumn("vector", F.when(F.col("doc_id") % 2 == 0, zero))
    grown = start.add(new, lambda rows: models.embed_column(rows, LetterEmbedder())).add(new.limit(0))
    return grown.df.select("doc_id", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("letters"), F.size("vector").alias("dim"))


@query("index_add_checked", "SELECT * FROM (VALUES ('clash', true), ('twice', true), ('dimension', true), ('no vector', true), ('good', false)) t(what, refused)")
def _(s, d):
    e = table(s, d, "embeddings")
    t, new = _vectors(s, d), e.where("vec_id % 50 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    tries = {
        "clash": e.where("vec_id % 50 = 0"),
        "twice": new.unionByName(new),
        "dimension": new.withColumn("embedding", F.slice("embedding", 1, 63)),
        "no vector": new.drop("embedding"),
        "good": new,
    }
    out = []
    for what, rows in tries.items():
        try:
            t.add(rows).df.agg(F.sum(F.size("embedding"))).collect()
            out.append((what, False))
        except Exception:  # the table's own error at once, or Spark's when the rows are read
            out.append((what, True))
    return _rows(s, out, "what string, refused boolean")


# ------------------------------------------------------------------ retrieval and answers

_DOCS26 = f"e AS (SELECT doc_id AS node_id, {_LETTERS.format('lower(text)')} AS v FROM documents), a AS (SELECT item_id AS query_id, {_LETTERS.format('lower(text)')} AS q FROM benchmark)"
_COS26 = "round(list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)) + 1e-8), 9)"


def _letter_nodes(s, d) -> DataFrame:
    models.EMBEDDERS.register("letters", lambda dim=26, **_: LetterEmbedder())
    docs = table(s, d, "documents").select(F.col("doc_id").alias("node_id"), F.col("doc_id").cast("string").alias("source_id"), F.coalesce("text", F.lit("")).alias("content"))
    return models.embed_column(docs, models.EMBEDDERS.create("letters"))


def _asked(s, d) -> DataFrame:
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("retrieve_dense", f"WITH {_DOCS26}, s AS (SELECT query_id, node_id, {_COS26} AS score FROM e, a), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s) SELECT query_id, node_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def _(s, d):
    found = pipeline.Retriever(_letter_nodes(s, d), LetterEmbedder()).retrieve(_asked(s, d), 10)
    return found.select("query_id", "node_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query("retrieve_hybrid", _TF + f", {_DOCS26}, b AS (SELECT a.query_id, e.node_id, {_COS26} AS dense, coalesce(s.score, 0) AS sparse FROM e CROSS JOIN a LEFT JOIN s ON s.query_id = a.query_id AND s.node_id = e.node_id), n AS (SELECT query_id, node_id, CASE WHEN max(dense) OVER w - min(dense) OVER w < 1e-8 THEN 1.0 ELSE (dense - min(dense) OVER w) / (max(dense) OVER w - min(dense) OVER w) END AS x, CASE WHEN max(sparse) OVER w - min(sparse) OVER w < 1e-8 THEN 1.0 ELSE (sparse - min(sparse) OVER w) / (max(sparse) OVER w - min(sparse) OVER w) END AS y FROM b WINDOW w AS (PARTITION BY query_id)), f AS (SELECT query_id, node_id, round(0.3::DOUBLE * x + 0.7::DOUBLE * y, 9) AS score FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM f) SELECT query_id, node_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def _(s, d):
    found = pipeline.Retriever(_letter_nodes(s, d), LetterEmbedder(), "hybrid", 0.3).retrieve(_asked(s, d), 10)
    return found.select("query_id", "node_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


_TOP3 = _TF + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s), k AS (SELECT query_id, node_id, rank FROM r WHERE rank <= 3)"


@query("rag_answer", _TOP3 + r""", c AS (SELECT k.query_id, rank, k.node_id, d.text AS content, CAST(greatest(1, length(d.text) // 5) AS INTEGER) AS tokens FROM k JOIN documents d ON d.doc_id = k.node_id),
q2 AS (SELECT item_id AS query_id, text, 4096 - 512 - greatest(1, length('Answer from the context below.') // 5) - greatest(1, length(text) // 5) AS budget FROM benchmark),
u AS (SELECT c.*, budget, sum(tokens) OVER (PARTITION BY c.query_id ORDER BY rank) AS used FROM c JOIN q2 USING (query_id)),
g AS (SELECT query_id, list(content ORDER BY rank) AS kept FROM u WHERE used <= budget GROUP BY 1),
o AS (SELECT query_id, list(node_id::VARCHAR ORDER BY rank) AS sources FROM c GROUP BY 1)
SELECT q2.query_id, CAST(len(coalesce(kept, [])) AS INTEGER) AS n_chunks, array_to_string(sources, ',') AS sources,
       CASE WHEN kept IS NOT NULL THEN array_to_string(list_slice(regexp_extract_all(regexp_extract(kept[1], '^[^\n]*'), '\S+'), 1, 512), ' ') END AS answer FROM q2 LEFT JOIN g USING (query_id) LEFT JOIN o USING (query_id)""")
def _(s, d):
    nodes = table(s, d, "documents").select(F.col("doc_id").alias("node_id"), F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("content"))
    found = pipeline.Retriever(nodes, LetterEmbedder(), "sparse").retrieve(_asked(s, d), 3)
    out = pipeline.answer(_asked(s, d), found, nodes, models.DRIVERS.create("echo"))
    return out.select("query_id", F.size("chunks").alias("n_chunks"), F.array_join("sources", ",").alias("sources"), F.when(F.size("chunks") > 0, F.col("answer")).alias("answer"))


@query("generate_column", r"WITH p AS (SELECT item_id, text, regexp_extract_all(text, '\S+') AS w FROM benchmark) SELECT item_id, array_to_string(w[1:5], ' ') AS answer, CAST(greatest(1, length(text) // 5) AS INTEGER) AS prompt_tokens, CASE WHEN len(w) > 5 THEN 'length' ELSE 'stop' END AS finish_reason FROM p")
def _(s, d):
    rows = models.generate_column(table(s, d, "benchmark").select("item_id", F.col("text").alias("prompt")), models.EchoDriver(), max_tokens=5)
    g = F.col("generation_result")
    return rows.select("item_id", g.text.alias("answer"), g.usage.prompt_tokens.alias("prompt_tokens"), g.finish_reason.alias("finish_reason"))


@query("driver_stream", r"SELECT item_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS pieces, array_to_string(regexp_extract_all(text, '\S+'), ' ') AS answer FROM benchmark")
def _(s, d):
    with models.DRIVERS.create("echo") as driver:
        rows = models.stream_column(table(s, d, "benchmark").select("item_id", F.col("text").alias("prompt")), driver, max_tokens=10_000)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "piece"))), lambda x: x.piece), "")
    return rows.groupBy("item_id").agg(F.count("*").alias("pieces"), text.alias("answer"))


class _Counting(models.Lifecycle):
    """Counts characters; not the echoing driver, so it is asked in batches."""

    context_window = 400

    def count_tokens(self, texts: list[str]) -> list[int]:
        return [len(x) for x in texts]


@query("driver_budget", "SELECT item_id, CAST(CASE WHEN 3 + length(text) >= 340 THEN -1 ELSE 340 - 3 - length(text) END AS INTEGER) AS budget FROM benchmark")
def _(s, d):
    rows = table(s, d, "benchmark").select("item_id", F.col("text").alias("query"))
    return context.budgets(rows, 400, 60, "sys", models.token_counter(_Counting())).select("item_id", F.col("budget").cast("int").alias("budget"))


@query("embed_unit_vectors", r"SELECT doc_id, 48 AS dim, CASE WHEN regexp_matches(text, '\S') THEN 1.0 ELSE 0.0 END AS norm FROM documents")
def _(s, d):
    rows = models.embed_column(table(s, d, "documents").select("doc_id", "text"), models.EMBEDDERS.create("hashing", dim=48), "text", rate_limit=1e9)
    n = F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), 3)
    # opposite signs can cancel out in every place of a short text; such a vector is zero
    return rows.select("doc_id", F.size("vector").alias("dim"), F.when(tx.non_blank("text") & (n == 0), 1.0).otherwise(n).alias("norm"))


@query("sparse_embedding", r"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w FROM documents) SELECT doc_id, CAST(len(w) AS DOUBLE) AS total, len(list_distinct(w)) AS terms FROM w")
def _(s, d):
    rows = models.sparse_embed(table(s, d, "documents").select("doc_id", "text"), "text")
    weights = F.map_values("sparse_vector")
    known = F.col("text").isNotNull()  # an absent text has no counts in SQL, where its map is empty here
    return rows.select("doc_id", F.when(known, F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)).alias("total"), F.when(known, F.size(weights).cast("long")).alias("terms"))


@query("rate_limiter", "SELECT r_regionkey, round(greatest(0, (r_regionkey + 1) * 5 - 10) / 10.0, 6)::DOUBLE AS waited FROM region")
def _(s, d):
    """A bucket of ten tokens a second that starts full, asked for five at once by each region in turn; time stands still."""
    limiter = models.RateLimiter(10.0, lambda: 0.0, lambda seconds: None)
    keys = [r[0] for r in table(s, d, "region").orderBy("r_regionkey").select("r_regionkey").collect()]
    return _rows(s, [(k, round(limiter.acquire(5), 6)) for k in keys], "r_regionkey int, waited double")


# ------------------------------------------------------------------ templates


@query("template_loop", "SELECT conv_id, 'Turns:' || string_agg(chr(10) || row_no || '. ' || upper(role) || CASE WHEN role = 'user' THEN ' asks: ' ELSE ' says: ' END || text, '' ORDER BY turn) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS row_no FROM conversations) GROUP BY 1")
def _(s, d):
    t = PromptTemplate("Turns:{% for t in turns %}\n{{ loop.index }}. {{ t.role | upper }}{% if t.role == 'user' %} asks: {% else %} says: {% endif %}{{ t.text }}{% endfor %}")
    rows = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))
    return rows.select("conv_id", t.render(turns=F.col("l")).alias("prompt"))


@query("template_file", "SELECT r_regionkey, 'Region ' || r_name || ': ' || r_regionkey AS prompt FROM region")
def _(s, d):
    path = _local(scratch(s, "template"))
    Path(path).mkdir(parents=True)
    Path(f"{path}/t.txt").write_text("Region {{ name }}: {key}", encoding="utf-8")
    t = PromptTemplate.from_file(f"{path}/t.txt")
    return table(s, d, "region").select("r_regionkey", t.render(name=F.col("r_name"), key=F.col("r_regionkey")).alias("prompt"))


@query("template_format", "SELECT r_regionkey, 'Region ' || r_name || CASE WHEN r_regionkey > 0 THEN ' (' || r_regionkey || ')' ELSE '' END AS prompt FROM region")
def _(s, d):
    t = PromptTemplate("Region {name}{% if key %} ({{ key }}){% endif %}")
    return _rows(s, [(r[0], t.format(name=r[1], key=r[0])) for r in table(s, d, "region").select("r_regionkey", "r_name").collect()], "r_regionkey int, prompt string")


@query("template_missing", "SELECT * FROM (VALUES ('chat', 'history,question'), ('qa', 'question'), ('summary', 'sentences,text'), ('synthetic_qa', 'chunks,num_questions')) t(name, missing)")
def _(s, d):
    return _rows(s, [(name, ",".join(t.missing({"context"}))) for name, t in sorted(BUILTIN.items())], "name string, missing string")


# ------------------------------------------------------------------ metrics


@query("metric_names", "SELECT * FROM (VALUES ('map'), ('mrr'), ('ndcg'), ('precision'), ('recall')) t(name)")
def _(s, d):
    return _rows(s, [(n,) for n in evaluate.METRICS.names("retrieval")], "name string")


@query("metric_k_resolution", "SELECT * FROM (VALUES ('explicit', '3,7'), ('ks', '1,2'), ('k', '4'), ('default', '5,10,20'), ('name', '7'), ('both', '2'), ('without', 'refused')) t(rule, ks)")
def _(s, d):
    named = lambda *a: str(evaluate.METRICS.parse(*a)[1])
    show = lambda ks: ",".join(map(str, ks))
    try:
        without = named("recall@k")
    except ValueError:
        without = "refused"
    rows = [("explicit", show(evaluate.resolve_ks([7, 3, 7], {"k": 1}))), ("ks", show(evaluate.resolve_ks(None, {"ks": [2, 1, 2], "k": 9}))), ("k", show(evaluate.resolve_ks(None, {"k": 4}))), ("default", show(evaluate.resolve_ks())), ("name", named("recall@7")), ("both", named("recall@7", 2)), ("without", without)]
    return _rows(s, rows, "rule string, ks string")


@query("metric_registered", "SELECT doc_id AS query_id, 'share@2' AS metric, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 0.25 END AS value FROM documents WHERE doc_id % 10 < 5")
def _(s, d):
    registry = evaluate.MetricRegistry()
    registry.register("share", lambda got, relevant, k, scale=1.0: F.size(F.array_intersect(F.slice(got, 1, k), relevant)) / F.lit(float(k)) * F.lit(scale))
    i = F.col("doc_id")
    cases = table(s, d, "documents").where("doc_id % 10 < 5").select(i.alias("query_id"), F.array(i, i + 1, i + 2).alias("got"), F.when(i % 3 == 0, F.array(i, i + 1)).otherwise(F.array(i + 1, i + 2)).alias("relevant"))
    return evaluate.case_metrics(cases, [2], None, {"share": {"scale": 0.5}}, registry).select("query_id", "metric", F.round("value", 6).alias("value"))


@query("metric_validation", "SELECT * FROM (VALUES ('empty', true), ('some', false)) t(relevant, refused)")
def _(s, d):
    out = []
    for name, relevant in (("empty", []), ("some", [1])):
        try:
            evaluate.check_relevant(relevant)
            out.append((name, False))
        except errors.MetricValidationError:
            out.append((name, True))
    return _rows(s, out, "relevant string, refused boolean")


# ------------------------------------------------------------------ reports and monitors


@query("report_json", "SELECT event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY 1")
def _(s, d):
    means = table(s, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    report = reports.AuditReport.of(config.ExperimentProfile(), means, 1.0)
    path = monitor.export_report({"report_id": report.report_id} | json.loads(report.to_json()), _local(scratch(s, "reports")), when=datetime(2024, 1, 1, tzinfo=UTC))
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    return _rows(s, sorted(data["metrics"].items()), "metric string, value double")


@query("monitor_summary", "SELECT 'monitoring' AS part, r_name AS stage, CAST(2 AS BIGINT) AS n, (r_regionkey * 2 + 10)::DOUBLE AS total FROM region UNION ALL SELECT 'streaming', 'queue', 3, 2 FROM region WHERE r_regionkey = 0")
def _(s, d):
    timer, queue = monitor.StageTimer(), monitor.QueueMonitor(10).configure(max_samples=10, backpressure_threshold=0.5)
    with monitor.Monitors(queue):
        for r in table(s, d, "region").collect():  # five rows
            timer.record(r.r_name, float(r.r_regionkey))
            timer.record(r.r_name, float(r.r_regionkey) + 10)
        for size in (1, 6, 9):
            queue.record(size)
    path = monitor.export_summary(timer, _local(scratch(s, "monitor")), when=datetime(2024, 1, 1, tzinfo=UTC))
    stages = json.loads(Path(path).read_text(encoding="utf-8"))
    whole = monitor.combined_summary(timer, queue)
    assert whole["monitoring"] == stages
    q = whole["streaming"]
    return _rows(s, [("monitoring", k, v["count"], v["total_ms"]) for k, v in stages.items()] + [("streaming", "queue", q["total_samples"], float(q["backpressure_events"]))], "part string, stage string, n long, total double")


@query("masked_log", "SELECT r_regionkey, CASE WHEN length(r_name) <= 8 THEN '***' ELSE substr(r_name, 1, 4) || '***' || right(r_name, 4) END AS message, 'WARNING' AS level FROM region")
def _(s, d):
    import io

    from . import logs

    out = io.StringIO()
    log = logs.setup("info", as_json=True, stream=out)
    for r in table(s, d, "region").orderBy("r_regionkey").collect():
        log.warning(logs.mask(r.r_name))
        log.debug("not written at this level")
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    logs.setup("error")
    return _rows(s, [(i, x["message"], x["level"]) for i, x in enumerate(lines)], "r_regionkey int, message string, level string")


# ------------------------------------------------------------------ forge and streams


@query("forge_quarantine", f"WITH x AS ({_windows_sql(128, 112)}) SELECT doc_id, CAST(count(*) AS BIGINT) AS chunks FROM x WHERE doc_id % 6 <> 0 GROUP BY 1")
def _(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.when(F.col("doc_id") % 6 == 0, F.lit("  ")).otherwise(F.col("text")).alias("content"), F.create_map(F.lit("lang"), "lang").alias("metadata"), F.lit("text/plain").alias("mime_type"), F.lit(1).alias("page_count"))
    profile = config.ExperimentProfile(fail_fast=False, fragmenter=config.FragmenterConfig(chunk_size=128, overlap=16))
    nodes, _ = pipeline.build_corpus(docs, profile)
    return nodes.groupBy(F.col("source_id").cast("long").alias("doc_id")).agg(F.count("*").alias("chunks"))


@query("forge_fail_fast", "SELECT true AS stopped")
def _(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.when(F.col("doc_id") % 6 == 0, F.lit("  ")).otherwise(F.col("text")).alias("content"))
    try:
        pipeline.build_corpus(docs)[0].agg(F.count("content")).collect()
        return _rows(s, [(False,)], "stopped boolean")
    except Exception:  # Spark's, with the message of the broken rule
        return _rows(s, [(True,)], "stopped boolean")


@query("fragmenters_by_name", "SELECT * FROM (VALUES ('markdown', 'made'), ('other', 'unsupported'), ('recursive', 'not implemented'), ('semantic', 'not implemented'), ('token', 'made')) t(name, outcome)")
def _(s, d):
    docs, out = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("content")), []
    for name in (*pipeline.FRAGMENTERS.names(), "other"):
        try:
            pipeline.FRAGMENTERS.create(name, docs, config.FragmenterConfig())
            out.append((name, "made"))
        except NotImplementedError:
            out.append((name, "not implemented"))
        except errors.UnsupportedBackendError:
            out.append((name, "unsupported"))
    return _rows(s, out, "name string, outcome string")


@query("chunk_markdown", "SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, 'Part ' || i AS section FROM (SELECT doc_id, unnest(range(1, 2 + doc_id % 3)) AS i FROM documents)")
def _(s, d):
    parts = F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int")), lambda i: F.concat(F.lit("## Part "), i.cast("string"), F.lit("\nsome text #x\n")))
    docs = table(s, d, "documents").select("doc_id", F.array_join(parts, "\n").alias("text"))
    return chunk.markdown_chunks(docs, "doc_id", "text").select(F.col("source_id").alias("doc_id"), "chunk_index", "section")


@query("stream_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n FROM g GROUP BY user_id, s")
def _(s, d):
    from .queries import _stream

    rows = streaming.sessions(_stream(s, d, "events"), delay="3650 days")
    last = streaming.run_to_end(rows, scratch(s, "stream-sessions"), "complete")
    from pyspark.sql import Window

    newest = last.withColumn("_last", F.max("_batch").over(Window.partitionBy(F.lit(1) * 0 + F.col("user_id")))).where("_batch = _last")
    return newest.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")
