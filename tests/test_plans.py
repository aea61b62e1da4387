import io
import json
import re
from dataclasses import dataclass

import pytest

from sparkrag import logs
from sparkrag.config import ExperimentProfile, QuestionGeneratorConfig
from sparkrag.errors import UnsupportedBackendError
from sparkrag.plans import models, pipeline, questions
from sparkrag.reports import AuditReport
from sparkrag.sources import documents, json_files


@dataclass
class Writer:
    """Writes one question about each numbered text; the second chunk is named twice, an unknown one once."""

    context_window: int = 4096
    broken: bool = False

    def generate(self, prompt, max_tokens, temperature):
        chunks = [{"chunk_id": int(n), "qa_pairs": [{"question": f"What about {t}?", "answer": f"All of {t}", "confidence": 0.5}] * 2} for n, t in re.findall(r"\[(\d+)\] (\w+)", prompt)]
        reply = json.dumps({"chunks": [*chunks, {"chunk_id": 99, "qa_pairs": []}]})
        return ("oops" if self.broken else reply), 1, 1, "stop"


def test_questions_for_nodes(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"s{i % 2}", f"subject{i} and more") for i in range(11)], "node_id string, source_id string, content string")
    out = {r.node_id: r.synthetic_qa for r in questions.generate(nodes, Writer(), QuestionGeneratorConfig(batch_size=2)).collect()}
    assert len(out) == 11
    for n, q in out.items():
        assert [p.question for p in q.qa_pairs] == [f"What about subject{n[1:]}?"] and q.num_questions_validated == 1
    with pytest.raises(Exception, match="JSON"):
        questions.generate(nodes, Writer(broken=True)).collect()
    with pytest.raises(UnsupportedBackendError):
        questions.GENERATORS.create("other", nodes)


def test_report(spark):
    means = spark.createDataFrame([("mrr", 0.5)], "metric string, value double")
    r = AuditReport.of(ExperimentProfile(), means, 1.5)
    data = json.loads(r.to_json())
    assert data["metrics"] == {"mrr": 0.5} and data["profile_hash"] == ExperimentProfile().compute_hash() and data["system"]["cpu_count"] >= 1
    with pytest.raises(ValueError):
        AuditReport("x", -1, {})


def test_logs(monkeypatch):
    out = io.StringIO()
    logs.setup("debug", as_json=True, stream=out).debug("häl%s", "lo")
    assert json.loads(out.getvalue())["message"] == "hällo"
    monkeypatch.setenv("SPARKRAG_LOG_LEVEL", "nonsense")
    assert logs.level_of() == 20 and logs.level_of("error") == 40
    assert logs.mask("12345678") == "***" and logs.mask("123456789") == "1234***6789"


def test_languages_and_yaml(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), (None, "y")], "content string, k string")
    assert {r.language for r in documents.with_language(df).collect()} <= {"unknown", "en", "so", "sw"}
    pytest.importorskip("yaml")
    json_files.write_yaml(df, str(tmp_path / "d/a.yaml"))
    assert sorted(map(str, json_files.read_yaml(spark, str(tmp_path / "d/a.yaml"), "content string, k string").collect())) == sorted(map(str, df.collect()))


def test_embedding_is_checked_and_limited(spark):
    df = spark.createDataFrame([(str(i), "some words") for i in range(5)], "node_id string, content string")
    rows = models.embed_column(df, models.HashingEmbedder(16), rate_limit=1000.0, batch_size=2).collect()
    assert {len(r.vector) for r in rows} == {16} and len({tuple(r.vector) for r in rows}) == 1
    wrong = models.HashingEmbedder(16)
    wrong.embed = lambda texts: models.HashingEmbedder(8).embed(texts)
    with pytest.raises(Exception, match="expected 16 dimensions"):
        models.embed_column(df, wrong).collect()
    assert models.sparse_embed(df).first().sparse_vector and "".join(models.EchoDriver().stream("one two")) == "one two"


@pytest.mark.parametrize("strategy", ["semantic", "recursive"])
def test_missing_fragmenters_are_refused(strategy):
    with pytest.raises(NotImplementedError, match=strategy):
        pipeline.FRAGMENTERS.create(strategy, None, None)
