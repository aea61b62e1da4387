import math
import random

import pytest
from pyspark.sql import functions as F

from sparkrag.operators import evaluate


def metrics(spark, got, relevant, k=5):
    row = spark.createDataFrame([(got, relevant)], "got array<string>, relevant array<string>")
    row = row.select(*(evaluate.METRICS.get(n, k)(F.col("got"), F.col("relevant")).alias(n) for n in evaluate.METRICS.names())).first()
    return row.asDict()


@pytest.mark.parametrize(
    "got, relevant, name, want",
    [
        ("abxyz", "abcd", "recall", 0.5),
        ("vwxyza", "a", "recall", 0.0),
        ("axbyz", "ab", "precision", 0.4),
        ("abx", "ab", "precision", 2 / 3),
        ("aabcc", "ab", "recall", 1.0),
        ("aabcc", "ab", "precision", 0.6),
        ("aabcc", "ab", "mrr", 1.0),
        ("xxxxxa", "a", "mrr", 1 / 6),
        ("", "ab", "recall", 0.0),
        ("ab", "", "map", 0.0),
    ],
)
def test_hand_values(spark, got, relevant, name, want):
    assert metrics(spark, list(got), list(relevant))[name] == pytest.approx(want)


def test_identical_lists_score_one(spark):
    assert list(metrics(spark, list("abcde"), list("abcde")).values()) == [pytest.approx(1.0)] * 5


def plain(got, relevant, k):
    top, rel = got[:k], set(relevant)
    if not got or not relevant:
        return dict.fromkeys(("recall", "precision", "mrr", "ndcg", "map"), 0.0)
    hits, ap = 0, 0.0
    for i, x in enumerate(top, 1):
        if x in rel:
            hits += 1
            ap += hits / i
    dcg = sum(1 / math.log2(i + 1) for i, x in enumerate(top, 1) if x in rel)
    ideal = sum(1 / math.log2(i + 1) for i in range(1, min(k, len(relevant)) + 1))
    return {"recall": len(set(top) & rel) / len(rel), "precision": sum(x in rel for x in top) / len(top), "mrr": next((1 / i for i, x in enumerate(got, 1) if x in rel), 0.0), "ndcg": dcg / ideal, "map": ap / len(rel)}


def test_random_lists_agree_with_plain_python(spark):
    rng = random.Random(5)
    rows = [([rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))], [rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "got array<string>, relevant array<string>")
    found = df.select("got", "relevant", *(evaluate.METRICS.get(n, 4)(F.col("got"), F.col("relevant")).alias(n) for n in evaluate.METRICS.names())).collect()
    for r in found:
        for n, want in plain(r.got, r.relevant, 4).items():
            assert r[n] == pytest.approx(want), (r.got, r.relevant, n)


def test_cases_without_truth_or_results_are_left_out(spark):
    run = spark.createDataFrame([("q1", "a", 1), ("q2", "b", 1)], "query_id string, node_id string, rank int")
    truth = spark.createDataFrame([("q1", ["a"]), ("q3", ["c"]), ("q2", [])], "query_id string, relevant array<string>")
    values = evaluate.case_metrics(evaluate.lists(run, truth), [1], ["recall"])
    assert [tuple(r) for r in values.collect()] == [("q1", "recall@1", 1.0)]
    assert evaluate.aggregate(values).first().n_cases == 1


def test_k_resolution_and_names():
    assert evaluate.resolve_ks([3, 1, 3]) == [1, 3]
    assert evaluate.resolve_ks(None, {"ks": [7, 2], "k": 4}) == [2, 7]
    assert evaluate.resolve_ks(None, {"k": 4}) == [4]
    assert evaluate.resolve_ks() == [5, 10, 20]
    assert evaluate.METRICS.parse("recall@7") == ("recall", 7)
    assert evaluate.METRICS.parse("recall@7", 3) == ("recall", 3)
    with pytest.raises(ValueError):
        evaluate.METRICS.parse("recall@k")
    with pytest.raises(KeyError):
        evaluate.METRICS.parse("nothing@3")


def test_long_form_agrees(spark):
    hits = spark.createDataFrame([("q", i, h) for i, h in enumerate([0, 1, 1, 0, 1], 1)], "query_id string, rank int, hit int")
    row = evaluate.long_metrics(hits, spark.createDataFrame([("q", 4)], "query_id string, n_relevant int"), 4).first()
    want = plain(list("xabyc"), list("abcd"), 4)
    assert {n: row[n] for n in want} == {n: pytest.approx(v) for n, v in want.items()}


def test_metrics_of_hits_agree_with_those_of_lists(spark):
    rng = random.Random(8)
    got = {q: rng.sample(range(60), rng.randint(1, 12)) for q in range(40)}
    relevant = {q: rng.sample(range(60), rng.choice([0, 1, 3, 30])) for q in range(38)}
    hits = spark.createDataFrame([(q, i, int(x in relevant.get(q, ()))) for q, xs in got.items() for i, x in enumerate(xs, 1)], "query_id int, rank int, hit int")
    sizes = spark.createDataFrame([(q, len(xs)) for q, xs in relevant.items()], "query_id int, n_relevant long")
    want = {}
    for q, xs in relevant.items():
        for k in (3, 10):
            want |= {(q, n if n == "mrr" else f"{n}@{k}"): pytest.approx(v) for n, v in plain(got[q], xs, k).items() if xs}
    assert {(r.query_id, r.metric): r.value for r in evaluate.hit_metrics(hits, sizes, [3, 10]).collect()} == want


def test_no_query_holds_the_ids_of_its_label(spark, sf):
    """A list of relevant ids for each query grows with the square of the table."""
    from sparkrag import queries

    for name in ("metrics_all_k", "metrics_aggregate", "metrics_report_wide", "recall_at_k", "precision_at_k", "mrr", "ndcg_at_k", "map_at_k", "metrics_long_form"):
        assert "relevant#" not in queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().replace("n_relevant#", "")
