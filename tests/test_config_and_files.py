import pytest
from pyspark.sql import functions as F

from sparkrag.config import ExperimentProfile
from sparkrag.errors import ConfigError, ConfigOverrideError
from sparkrag.plans import models, pipeline
from sparkrag.sources import documents, json_files


def test_profiles(tmp_path):
    p = ExperimentProfile()
    q = p.with_overrides({"retrieval.top_k": 5, "fragmenter.overlap": 0})
    assert p.retrieval.top_k == 10 and q.retrieval.top_k == 5
    assert p.diff(q) == {"retrieval.top_k": (10, 5), "fragmenter.overlap": (64, 0)}
    assert p.compute_hash() != q.compute_hash() == q.with_overrides({}).compute_hash()
    for bad in ({"retrieval.nothing": 1}, {"generator.temperature": 1}, {"retrieval.top_k": 0}, {"fragmenter.overlap": 256}):
        with pytest.raises(ConfigOverrideError):
            p.with_overrides(bad)
    with pytest.raises(ConfigError):
        ExperimentProfile.from_dict({"index": {"backend": "qdrant"}})
    with pytest.raises(ConfigError):
        ExperimentProfile.from_dict({"retrieval": {"top_k": "ten"}})


def test_yaml_paths(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "p.yaml").write_text("evaluation:\n  trial_cases_path: ./cases.jsonl\n")
    p = ExperimentProfile.from_yaml(tmp_path / "p.yaml")
    assert p.evaluation.trial_cases_path == str(tmp_path / "cases.jsonl")
    p.to_yaml(tmp_path / "q.yaml")
    assert ExperimentProfile.from_yaml(tmp_path / "q.yaml").compute_hash() == p.compute_hash()


def test_trial_cases_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "Why?", "Because", None, None), ("c2", "Où?", None, ["n"], {"k": "v"})], json_files.TRIAL_CASES)
    json_files.write_json(rows, str(tmp_path / "a.json"))
    json_files.write_jsonl(rows, str(tmp_path / "b.jsonl"), ["case_id"])
    for name in ("a.json", "b.jsonl"):
        assert sorted(map(str, json_files.load_cases(spark, str(tmp_path / name)).collect())) == sorted(map(str, rows.collect()))
    (tmp_path / "c.jsonl").write_text('{"case_id": "x", "question": "Why?"}\n')
    with pytest.raises(Exception, match="ground truth"):
        json_files.load_cases(spark, str(tmp_path / "c.jsonl")).collect()
    with pytest.raises(FileNotFoundError):
        json_files.load_cases(spark, str(tmp_path / "none.json"))
    with pytest.raises(ValueError):
        json_files.load_cases(spark, "cases.csv")


def test_files_with_errors(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿hello\0 é")
    (tmp_path / "b.txt").write_text("  ")
    (tmp_path / "c.xyz").write_text("x")
    rows = {r.metadata["source"].rsplit("/", 1)[1]: r for r in documents.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].content == "hello é" and rows["a.txt"].error is None and len(rows["a.txt"].source_id) == 64
    assert "no text" in rows["b.txt"].error and "unsupported" in rows["c.xyz"].error


def test_html(spark):
    df = spark.createDataFrame([("u", "<html><title>T</title><script>x<y</script><p>a &amp; b</p><!-- no --><p>c</p></html>")], "url string, html string")
    assert documents.from_html(df).first().content == "T a & b\n c" or documents.from_html(df).first().content.split() == ["T", "a", "&", "b", "c"]


def test_question_answering(spark):
    docs = spark.createDataFrame([("d1", "spark runs queries over large tables"), ("d2", "cats sleep all day long")], "source_id string, content string")
    nodes, bad = pipeline.build_corpus(docs)
    assert bad.count() == 0 and nodes.count() == 2
    nodes = models.embed_column(nodes, models.HashingEmbedder(64))
    asked = spark.createDataFrame([("q", "what runs queries over tables")], "query_id string, query string")
    for mode in ("dense", "sparse", "hybrid"):
        found = pipeline.Retriever(nodes, models.HashingEmbedder(64), mode, rerank_k=2).retrieve(asked, 1)
        row = pipeline.answer(asked, found, nodes).first()
        assert row.sources == ["d1"] and row.answer.startswith("spark runs")


def test_lenient_and_strict_corpora(spark):
    docs = spark.createDataFrame([("d1", "text here"), ("d2", "  ")], "source_id string, content string")
    nodes, bad = pipeline.build_corpus(docs, ExperimentProfile(fail_fast=False))
    assert nodes.count() == 1 and bad.count() == 1
    with pytest.raises(Exception, match="no content"):
        pipeline.build_corpus(docs)[0].collect()


def test_duplicate_ids_are_refused(spark):
    from sparkrag.errors import VectorIndexError
    from sparkrag.operators.vector_index import VectorTable

    t = VectorTable(spark.createDataFrame([("a", [1.0])], "node_id string, vector array<double>"), 1)
    with pytest.raises(VectorIndexError):
        t.add(t.df)
    assert t.add(t.df.withColumn("node_id", F.lit("b"))).count() == 2
