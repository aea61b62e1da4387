import random
import re

import pytest
from pyspark.sql import functions as F

from sparkrag.functions import templates, text
from sparkrag.operators import chunk, context, ingest, monitor, qa
from sparkrag.operators import vector_index as vi
from sparkrag.plans import models


def test_blank_texts_as_python_has_them(spark):
    xs = ["", " ", "\t\n", " ", "　", "\x1c", "﻿x", "a", "  b "]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").select("i", text.non_blank("x").alias("ok"), text.word_count("x").alias("n"), text.strip("x").alias("s")).orderBy("i").collect()
    assert [r.ok for r in rows] == [bool(x.strip()) for x in xs]
    assert [r.n for r in rows] == [len(x.split()) for x in xs]
    assert [r.s for r in rows] == [x.strip() for x in xs]


def test_ids_of_uuid_shape_become_content_hashes(spark):
    rows = spark.createDataFrame([("123e4567-e89b-12d3-a456-426614174000", "x"), ("doc-1", "x"), (None, "x")], "i string, c string")
    got = [r[0] for r in rows.select(text.content_id("i", "c")).collect()]
    assert got[0] == got[2] != "doc-1" == got[1] and len(got[0]) == 64


def loop_windows(s, size, overlap):
    toks = re.findall(r"\S+\s*|\s+", s)
    out, at = [], 0
    while toks:
        if (w := "".join(toks[at : at + size])).strip():
            out.append(w)
        if at + size >= len(toks):
            break
        at += size - overlap
    return out


def test_windows_agree_with_a_loop(spark):
    rng = random.Random(3)
    docs = [(str(i), "".join(rng.choice(["ab", " ", "\n", "é", "😀 ", "x y"]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(docs, "source_id string, content string")
    for size, overlap in ((5, 2), (4, 0), (1, 0), (100, 99)):
        got = {}
        for r in chunk.token_windows(df, size, overlap).orderBy("chunk_index").collect():
            got.setdefault(r.source_id, []).append(r.content)
            assert dict(docs)[r.source_id][r.start_char : r.end_char] == r.content or "😀" in dict(docs)[r.source_id]
        assert got == {i: w for i, s in docs if (w := loop_windows(s, size, overlap))}


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        chunk.check_window(10, 10)


def test_both_ways_of_search_agree(spark):
    rng = random.Random(1)
    nodes = spark.createDataFrame([(i, [float(rng.randint(-3, 3)) for _ in range(4)], i % 3) for i in range(50)], "node_id int, vector array<double>, label int")
    asked = spark.createDataFrame([(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(5)], "query_id int, query_vector array<double>")
    for metric in ("cosine", "dot", "euclidean"):
        t = vi.VectorTable(nodes, 4, metric)
        a = sorted(map(tuple, t.search(asked, 7, {"label": 1}).collect()))
        b = sorted(map(tuple, t.search_blocks(asked, 7, {"label": 1}).collect()))
        assert [(q, n, r) for q, n, _, r in a] == [(q, n, r) for q, n, _, r in b]
    assert t.search_page(asked, vi.Cursor(45, 10))[0].where("query_id = 0").count() == 5
    assert t.search_page(asked, vi.Cursor(100, 10))[1].offset == 100
    fewer, n = t.delete([1, 1, 2, 99])
    assert n == 2 and fewer.count() == 48 and not fewer.exists(1)
    with pytest.raises(ValueError):
        vi.VectorTable(nodes, 4, "hamming")


def test_null_filter_matches_absent_values(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "i int, k string")
    assert [r.i for r in vi.where_equal(df, {"k": None}).collect()] == [1]


def test_hybrid_by_hand(spark):
    dense = spark.createDataFrame([("q", "A", 1.0), ("q", "B", 0.0)], "query_id string, node_id string, score double")
    sparse = spark.createDataFrame([("q", "A", 1.0), ("q", "B", 10.0)], "query_id string, node_id string, score double")
    got = {r.node_id: r.score for r in vi.hybrid(dense, sparse, 0.6).collect()}
    assert got == {"A": pytest.approx(0.6), "B": pytest.approx(0.4)}
    same = dense.withColumn("score", F.lit(0.5))
    assert [r.score for r in vi.hybrid(same, same, 0.5).collect()] == [1.0, 1.0]


def test_eviction(spark):
    nodes = spark.createDataFrame([(i, [0.0]) for i in range(40)], "node_id int, vector array<double>")
    t = vi.VectorTable(nodes, 1, max_nodes=30, eviction="fifo")
    assert sorted(r.node_id for r in t.evict().df.collect()) == list(range(10, 40))
    seen = spark.createDataFrame([(0, 5), (3, 9)], "node_id int, s int").select("node_id", F.timestamp_seconds("s").alias("accessed_at"))
    t = vi.VectorTable(nodes, 1, max_nodes=3, eviction="lru")
    assert sorted(r.node_id for r in t.evict(seen).df.collect()) == [0, 3, 39]


def middle(tokens, budget):
    n, kept, used = len(tokens), set(), 0
    for i in (0, n - 1) if n > 1 else (0,):
        if used + tokens[i] <= budget:
            kept.add(i)
            used += tokens[i]
    lo, hi, left = 1, n - 2, True
    while lo <= hi:
        i = lo if left else hi
        if used + tokens[i] > budget:
            break
        kept.add(i)
        used += tokens[i]
        lo, hi, left = (lo + 1, hi, False) if left else (lo, hi - 1, True)
    return sorted(kept)


def test_packing_agrees_with_a_loop(spark):
    rng = random.Random(2)
    cases = [([rng.randint(1, 9) for _ in range(rng.randint(1, 12))], rng.randint(0, 40)) for _ in range(80)]
    df = spark.createDataFrame([(q, i, t, b) for q, (ts, b) in enumerate(cases) for i, t in enumerate(ts)], "query_id int, rank int, tokens int, budget int")
    got = {q: [] for q in range(len(cases))}
    for r in context.pack(df, "middle").collect():
        got[r.query_id].append(r["rank"])
    assert {q: sorted(v) for q, v in got.items()} == {q: middle(*c) for q, c in enumerate(cases)}
    with pytest.raises(ValueError):
        context.pack(df, "random")


def test_prompt(spark):
    q = spark.createDataFrame([("q", "why?")], "query_id string, query string")
    c = spark.createDataFrame([("q", 1, "one"), ("q", 2, "two")], "query_id string, rank int, content string")
    row = context.fit_context(q, c, 100, 10, "S").first()
    assert row.prompt == "S\nContext:\n[1] one\n[2] two\n\nUser: why?"
    tiny = context.fit_context(q, c, 12, 10, "S").first()
    assert tiny.chunks == [] and tiny.query_cut == "why?"


def test_qa_rules(spark):
    rows = [("n", i, q, a) for i, (q, a) in enumerate([("What is Spark?", "An engine"), ("what is spark? ", "again"), ("short?", "An engine"), ("No question mark here", "An engine"), ("Why so short an answer?", "no")])]
    df = spark.createDataFrame(rows, "node_id string, pos int, question string, answer string")
    assert [r.pos for r in qa.validate_pairs(df).collect()] == [0]
    arrays = df.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("pos", "question", "answer"))).alias("a")).select(F.transform(qa.validate_array(F.col("a")), lambda p: p.pos).alias("p"))
    assert arrays.first().p == [0]


def test_bad_reply_stops_or_is_null(spark):
    df = spark.createDataFrame([("{not json",), ('{"chunks": []}',)], "reply string")
    assert [r[0] is None for r in df.select(qa.parse_batch("reply", strict=False)).collect()] == [True, False]
    with pytest.raises(Exception, match="reply"):
        df.select(qa.parse_batch("reply")).collect()


def test_quarantine_and_masks(spark):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "i int, c string")
    good, bad = ingest.quarantine(df, {"blank": text.non_blank("c")})
    assert [r.i for r in good.collect()] == [1] and [(r.i, r.broken) for r in bad.orderBy("i").collect()] == [(2, ["blank"]), (3, ["blank"])]
    got = spark.createDataFrame([("12345678",), ("123456789",)], "s string").select(text.mask("s")).collect()
    assert [r[0] for r in got] == ["***", "1234***6789"]


def test_templates(spark):
    t = templates.PromptTemplate("Hi {{ name }}, {thing}!")
    assert t.variables == ["name", "thing"] and t.format(name="a", thing="b") == "Hi a, b!"
    assert spark.range(1).select(t.render(name="a", thing=F.lit("b"))).first()[0] == "Hi a, b!"
    with pytest.raises(Exception, match="thing"):
        t.format(name="a")
    empty = spark.range(1).select(templates.numbered_context(F.array().cast("array<string>"))).first()[0]
    assert empty == "(No context available)"


def test_rate_limiter_takes_debt():
    now, waits = [0.0], []
    limiter = models.RateLimiter(10, clock=lambda: now[0], sleep=lambda s: (waits.append(s), now.__setitem__(0, now[0] + s)))
    assert limiter.acquire(10) == 0 and limiter.acquire(100) == pytest.approx(10)
    assert sum(limiter.acquire() for _ in range(20)) == pytest.approx(2)


def test_stage_timer(tmp_path):
    timer = monitor.StageTimer()
    timer.record("parsing", 2.0)
    timer.record("parsing", 4.0)
    assert timer.summary()["parsing"] == {"count": 2, "total_ms": 6.0, "avg_ms": 3.0, "min_ms": 2.0, "max_ms": 4.0}
    assert monitor.export_summary(monitor.StageTimer(False), str(tmp_path)) is None
