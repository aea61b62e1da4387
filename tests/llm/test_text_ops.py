"""Odd input for the operators on texts: nulls, empty and long texts, repeated rows, empty tables, further columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from sparkrag.llm import audio, common, components, decontaminate, jaccard, mixing, pitman_yor, quality, sstable

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, key string, score double, task int"
LONG = " ".join(f"w{i % 977} x{i}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, "a b c d e f"), (5, "a b c d e f"), (5, "other text under the same id"), (6, "Ünïcode ß 你好 😀 A"), (7, "a"), (None, "no id at all"), (None, None), (8, "b"), (9, "A")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "n", "k", 0.5, 7) for i, t in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_word_hashes_follow_words():
    texts = [t for _, t in ODD]
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    seen, got = {}, []
    for first, n, data, offsets in common.text_steps(batch, "text", 64):
        hashes, of = common.word_hashes(data, offsets)
        got += [(first + i, h) for i, h in zip(of.tolist(), hashes.tolist(), strict=True)]
    want = [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(seen.setdefault(w, h) == h for (_, w), (_, h) in zip(want, got, strict=True)) and len(set(seen.values())) == len(seen)


def test_hash_index():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    index = common.HashIndex(16)
    for part in np.array_split(rng.permutation(keys), 7):
        index.add(part)
    at = index.find(keys)
    assert sorted(at.tolist()) == list(range(len(keys))) and (index.keys[at] == keys).all()
    assert (index.find(keys + np.uint64(1)) == np.where(np.isin(keys + np.uint64(1), keys), index.find(keys + np.uint64(1)), -1)).all()


# ---------------------------------------------------------------- joins


def brute(rows):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w := words(t)) >= 5 else frozenset([tuple(w)] if w else []) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def near_copies(seed, n=60):
    rng = random.Random(seed)
    out = []
    for g in range(n // 6):
        base = [f"g{g}w{rng.randint(0, 300)}" for _ in range(rng.choice([4, 8, 30, 150, 700]))]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            out.append((len(out) + 1, " ".join(w)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("most_items", [jaccard.CLUSTER_ITEMS, 0])
def test_links_agree_with_brute_force(spark, most_items):
    rows = near_copies(1) + [(d and d + 1000, t) for d, t in ODD]
    got = sorted((tuple(r) for r in jaccard.link(table(spark, rows), most_items=most_items).collect()), key=str)
    assert got == brute(rows)


def test_large_groups_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "CLUSTER_CLASSES", 3)
    monkeypatch.setattr(jaccard, "MOST_SENT", 0)
    monkeypatch.setattr(jaccard, "BUCKET_KEYS", 64)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(40):  # near copies of one text, and of a variant that none of the others link with
        w = list(base if i % 8 else base[:60])
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i + 1, " ".join(w)))
    rows += [(d + 100, t) for d, t in near_copies(6, 12)]
    got = sorted((tuple(r) for r in jaccard.link(table(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_frequent_hashes_are_counted_to_the_end():
    counts = jaccard._Counts(64)
    rng = np.random.default_rng(0)
    for _ in range(200):
        counts.add(np.append(rng.integers(1000, 1 << 60, 20, dtype=np.uint64), np.array([7, 7], np.uint64)))
    found, count = counts.most(200)
    assert found.tolist() == [7] and 300 <= count[0] <= 400 and len(counts.keys) <= 64


def test_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(0)
    draw = lambda n, at: rng.normal(at, 1, (n, 4)).astype(np.float32)
    for share in (0.3, 0.7):
        mixed_ = np.concatenate([draw(int(3000 * share), 1.5), draw(3000 - int(3000 * share), -1.5)])
        assert abs(quality.estimate_prior(draw(1500, 1.5), rng.permutation(mixed_)) - share) < 0.06
    assert quality.estimate_prior(draw(5, 0), draw(5, 0)) == 0.5


def test_empty_join(spark):
    assert jaccard.link(table(spark, [])).count() == 0
    assert jaccard.dedup(table(spark, [])).count() == 0


def test_dedup_keeps_one_of_each_group_and_all_columns(spark):
    rows = near_copies(2, 30)
    kept = jaccard.dedup(table(spark, rows))
    assert kept.columns == table(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in brute(rows)}


def test_dedup_keeps_rows_not_ids(spark):
    near = " ".join(f"v{i}" for i in range(80))
    rows = [*ODD, *ODD[4:5], (2, ""), (11, "a b c d e f"), (None, "a b c d e f"), (12, near), (13, near + " end"), (13, "of its own"), (14, near), (14, near + " end"), (None, None)]
    kept = jaccard.dedup(table(spark, rows))
    assert kept.columns == table(spark, []).columns
    want = [r for r in rows if r[0] is None or not words(r[1])] + [(4, LONG), (5, "a b c d e f"), (5, ODD[6][1]), (6, ODD[7][1]), (7, "a"), (8, "b"), (12, near), (13, "of its own")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    copies = table(spark, [(1, "a b c")] * 3).withColumn("lang", F.concat(F.lit("l"), F.monotonically_increasing_id().cast("string")))
    assert jaccard.dedup(copies).count() == 1


def test_keys_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    none = np.zeros(0, np.uint64)
    for n in (1, 3, 10, 100, 128, 130, 500, 520, 700, 2047, 2048, 2500):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for _ in range(20):
            b = set(a.tolist())
            for x in rng.permutation(a)[: rng.integers(0, max(1, n // 7) + 1)].tolist():
                b.discard(x)
            b |= set(rng.integers(0, 1 << 63, rng.integers(0, max(1, n // 9) + 1), dtype=np.uint64).tolist())
            b = np.array(sorted(b), np.uint64)
            both = len(np.intersect1d(a, b))
            if len(b) and 7 * both >= 3 * (len(a) + len(b)):
                frequent = a[::3]
                for f in (none, frequent):
                    assert len(np.intersect1d(jaccard.issue_keys(a, f), jaccard.issue_keys(b, f)))


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([a[: len(a) // 2], b]))
        x, y = (np.frombuffer(jaccard.dense_sketches(v, np.array([len(v)]))[0], np.uint8) for v in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1002), (5000, 4000)]
    got = {r.node: r.component for r in components.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **dict.fromkeys((1000, 1001, 1002), 1000), 4000: 4000, 5000: 4000}
    assert components.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- decontamination


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(text, items):
    w, hit, found = bench_words(text), set(), set()
    for name, t in items:
        b = bench_words(t)
        n = min(10, len(b))
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i + 1, i + n + 1))
                found.add(name)
    return len(w), sorted(hit), sorted(found)


@pytest.mark.parametrize("most", [decontaminate.MOST_WINDOWS, 0])
def test_hits_agree_with_brute_force(spark, most):
    items = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "short Item!"), (3, None), (4, "..."), (5, "ONE two-three four five six seven eight nine ten"), (6, "é ß 你好")]
    rows = [*ODD, (20, "x one two three, four five six seven eight nine TEN eleven y short item"), (21, "one two three"), (22, "É é-ß 你好 short item short item")]
    bench = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, hits string")
    got = sorted(((r.doc_id, r.n_words, r.positions, sorted(r["items"])) for r in decontaminate.scan(table(spark, rows), bench, most=most).collect()), key=str)
    assert got == sorted(((d, *brute_hits(t, items)) for d, t in rows), key=str)


def test_removal(spark):
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    docs = table(spark, [(1, "say Alpha, beta now"), (2, "alpha then beta"), (3, None)])
    assert sorted(r.doc_id for r in decontaminate.remove(docs, bench).collect()) == [2, 3]
    spans = {r.doc_id: r.text for r in decontaminate.remove(docs, bench, spans=True).collect()}
    assert spans == {1: "say now", 2: "alpha then beta", 3: None}
    assert decontaminate.remove(docs, bench.limit(0)).count() == 3
    assert decontaminate.scan(table(spark, []), bench).count() == 0


# ---------------------------------------------------------------- shards


def test_shards_round_trip(spark, tmp_path):
    rows = [*ODD, *((i, f"text number {i} it's a <|endoftext|> x  y\n\n z") for i in range(100, 400))]
    manifest = sstable.write(table(spark, rows), f"file://{tmp_path}/s")
    got = [tuple(r) for r in sstable.read(manifest).orderBy("start").collect()]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(sstable.tokenizer_path())
    t.encode_special_tokens = True
    want, at = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), ids))
        at += len(ids)
    assert got == want
    digests = {(r.start, r.ids_crc32) for r in sstable.read(manifest, digests_only=True).collect()}
    assert digests == {(a, zlib.crc32(np.array(ids, "<u4").tobytes())) for _, a, _, ids in want}
    shards = manifest.collect()
    for d, _, _, ids in want:
        if d is None or d >= 100:
            first = next(x for e, _, _, x in want if e == d)
            assert sstable.lookup(shards, d).tolist() == first
    assert sstable.lookup(shards, 99) is None and sstable.lookup(shards, 10**9) is None
    assert sstable.read(sstable.write(table(spark, []), f"file://{tmp_path}/e")).count() == 0


def test_pieces_give_the_ids_of_the_text():
    enc = sstable.PieceEncoder(sstable.tokenizer_path())
    rng = random.Random(0)
    parts = ["a", "B", "é", "1", "23", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "'", ".", "!?", "你", " ", "　", "\x0b", "\x1c", "\x85", "😀", "-", "ß"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    batch = pa.record_batch({"text": pa.array(texts)})
    for first, n, data, offsets in common.text_steps(batch, "text", 200):
        ids, counts = enc.encode(data, offsets)
        at = np.concatenate([[0], np.cumsum(counts)])
        for i in range(n):
            assert ids[at[i] : at[i + 1]].tolist() == enc.tokenizer.encode(texts[first + i], add_special_tokens=False).ids, texts[first + i]


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    enc = sstable.PieceEncoder(sstable.tokenizer_path())
    monkeypatch.setattr(sstable, "span_hashes", lambda data, starts, ends, word: (ends - starts).astype(np.uint64))
    for text in ("ab cd ef", "gh ij", "one two six"):
        data = np.frombuffer(text.encode(), np.uint8)
        ids, _ = enc.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_hot_identifier_is_split(spark, tmp_path):
    rows = [(5, f"text {i:04d}") for i in range(400)] + [(i, "x") for i in range(4)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a small table has several shards
    try:
        manifest = sstable.write(table(spark, rows), f"file://{tmp_path}/h")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.max_id == 5 for r in manifest.collect()) > 1
    got = [(r.doc_id, r.n_tokens) for r in sstable.read(manifest).orderBy("start").collect()]
    assert len(got) == 404 and [d for d, _ in got] == sorted(d for d, _ in rows)
    assert sstable.lookup(manifest.collect(), 5) is not None


def test_queries_encode_as_the_library_does(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(sstable.tokenizer_path())
    mark = "<|endoftext|>"
    texts = ["plain text", f"end.{mark}Next text", mark, f" {mark} {mark}\n", "<|endof", "text|> x", "", f"a{mark}", "x <|endoftext |> y", mark * 3 + "z"]
    table(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in enumerate(texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for rows in (sstable.op8_query(spark, str(tmp_path)), corpus_pipeline.output_stage(spark, docs, str(tmp_path))):
        assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows.collect()) == want


# ---------------------------------------------------------------- language model


def test_scores(spark):
    docs = table(spark, [*ODD, *((100 + i, "the cat sat on the mat and the dog sat on the cat " * (1 + i % 3)) for i in range(60))])
    held = F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False))
    rows = pitman_yor.score(docs, held).collect()
    train = [w for r in docs.collect() if not (r.doc_id is not None and r.doc_id % 5 == 1) for w in [*words(r.text), "END"]]
    count = {w: train.count(w) for w in set(train)} if len(train) < 5000 else None
    if count is None:
        from collections import Counter

        count = Counter(train)
    n, v = len(train), len(count)
    want = sorted(((r.doc_id, len(words(r.text)) + 1, round(sum(math.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(r.text), "END"]), 4)) for r in docs.collect()), key=str)
    assert sorted(((r.doc_id, r.n_tokens, round(r.base_score, 4)) for r in rows), key=str) == want
    assert all(r.train_tokens == n and r.score <= 0 for r in rows)
    cats = [r for r in rows if r.doc_id is not None and r.doc_id >= 100 and r.held_out]
    assert sum(r.score for r in cats) > sum(r.base_score for r in cats)


def test_no_training_text(spark):
    rows = pitman_yor.score(table(spark, [(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert [r.score for r in rows] == [0.0, 0.0] and {r.train_tokens for r in rows} == {0}
    assert pitman_yor.score(table(spark, []), F.lit(False)).count() == 0


def test_probabilities_add_up():
    """In one context, known words and the unknown event share all probability, whatever the seating."""
    rng = np.random.default_rng(0)
    c = rng.integers(0, 40, 50)
    t = pitman_yor.seat(c, 0.6, lambda rows, i: np.full((len(rows), len(i)), 0.7), rng.random(50))
    assert ((t >= np.minimum(c, 1)) & (t <= c)).all()
    s_w = rng.integers(1, 9, 50)
    state = pitman_yor._State([], [], "", "", "", (), 0, 50, 0.6, ((int(s_w.sum()), 0.5),))
    p = np.append(state.root_p(s_w, 0), state.root_p(np.zeros(1, np.int64), 0))
    assert p.sum() == pytest.approx(1)
    own = np.append(np.maximum(c - 0.6 * t, 0), 0) + (pitman_yor.STRENGTH + 0.6 * t.sum()) * p
    assert (own / (pitman_yor.STRENGTH + c.sum())).sum() == pytest.approx(1)


def stirling(most, d):
    """log S_d(c, t) as rows, by the recursion, one number after another."""
    rows = [[], [0.0]]
    for c in range(1, most):
        last = rows[c]
        row = []
        for t in range(1, c + 2):
            stay = last[t - 1] + math.log(c - d * t) if t <= c else -math.inf
            new = last[t - 2] if t > 1 else -math.inf
            top = max(stay, new)
            row.append(top + math.log(math.exp(stay - top) + math.exp(new - top)))
        rows.append(row)
    return rows


def test_stirling_numbers_of_partitions():
    """S_d(c, t) sums, over the partitions of c customers to t tables, the products of (1-d)(2-d)...(n-1-d)."""

    def total(c, t, d):
        if t == 0 or c == 0:
            return float(c == t)
        block = lambda n: math.prod(k - d for k in range(1, n))
        return sum(math.comb(c - 1, n - 1) * block(n) * total(c - n, t - 1, d) for n in range(1, c - t + 2))

    for d in (0.3, 0.8):
        table_, plain = pitman_yor._stirling_table(d, 64), stirling(64, d)
        for c in range(1, 9):
            assert [math.exp(x) for x in table_[c, 1 : c + 1]] == pytest.approx([total(c, t, d) for t in range(1, c + 1)])
        assert table_[64, 1:65] == pytest.approx(plain[64])


def test_tables_follow_their_law():
    """Means and shares of drawn tables agree with the law itself, also past the tabulated numbers."""
    rng = np.random.default_rng(1)
    for c, a, d in ((2, 0.5, 0.5), (5, 0.5, 0.5), (20, 0.3, 0.7), (60, 1, 0.8), (200, 0.3, 0.7), (400, 3.0, 0.4), (1500, 6.0, 0.6), (1500, 60.0, 0.8)):
        log_p = np.array(stirling(c, d)[c]) + np.arange(c) * math.log(a)
        p = np.exp(log_p - log_p.max())
        p /= p.sum()
        got = pitman_yor.seat(np.full(40_000, c), d, lambda rows, i, a=a: np.full((len(rows), len(i)), a), (np.arange(40_000) + rng.random()) / 40_000)
        mean = (p * np.arange(1, c + 1)).sum()
        assert abs(got.mean() - mean) < 0.002 * mean
        share = np.bincount(got, minlength=c + 1)[1 : c + 1] / 40_000
        assert np.abs(share - p).max() < 2e-4


def plain_scores(rows, held, sweeps, burn_in):
    """The model by its definitions, one pair after another, with the operator's random numbers."""
    from collections import Counter

    texts = [words(t) for _, t in rows]
    flat = sorted({w for t in texts for w in t})
    data = np.frombuffer(" ".join(flat).encode(), np.uint8)
    name = dict(zip(flat, common.word_hashes(data, np.array([0, len(data)]))[0].tolist(), strict=True)) | {None: int(pitman_yor.END)}
    pairs = [list(zip([None, *t], [*t, None], strict=True)) for t in texts]
    count = Counter(p for own, h in zip(pairs, held, strict=True) if not h for p in own)
    n_w = Counter()
    for (_, w), c in count.items():
        n_w[w] += c
    n, v = sum(n_w.values()), len(n_w)
    kneser = lambda xs: pitman_yor._kneser(sum(x == 1 for x in xs), sum(x == 2 for x in xs))
    d = kneser(count.values())
    logs = stirling(max(count.values()) + 1, d)
    t, t_u, s_w, d0 = dict.fromkeys(count, 1), {w: math.ceil(c**d) for w, c in n_w.items()}, n_w, 0.5
    scores = {p: 0.0 for own in pairs for p in own}
    for sweep in range(sweeps):
        now = {}
        for (u, w), c in count.items():
            own, weights, product = t[u, w], [], 0.0
            for k in range(1, c + 1):
                if k > 1:
                    i = k - 1
                    product += math.log((1 + d * (t_u[u] - own + i)) * (s_w[w] - own + i - d0) / (1 + sum(s_w.values()) - own + i))
                weights.append(logs[c][k - 1] + product)
            weights = np.cumsum(np.exp(np.array(weights) - max(weights)))
            at = np.uint64
            with np.errstate(over="ignore"):
                h = common.mix(np.array([name[u]], at) * pitman_yor._A + common.mix(np.array([name[w]], at) + pitman_yor._B))
                seed = common.mix(h + at((sweep + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
            now[u, w] = 1 + int((weights < float(seed[0] >> at(11)) * 2.0**-53 * weights[-1]).sum())
        t, t_u, s_w = now, Counter(), Counter()
        for (u, w), k in t.items():
            t_u[u] += k
            s_w[w] += k
        d0, whole = kneser(s_w.values()), sum(s_w.values())
        if sweep >= burn_in:
            for u, w in scores:
                root = (s_w[w] - d0) / (1 + whole) if w in s_w else (1 + d0 * v) / (1 + whole)
                scores[u, w] += (max(count[u, w] - d * t.get((u, w), 0), 0) + (1 + d * t_u[u]) * root) / (1 + n_w[u]) / (sweeps - burn_in)
    return [sum(math.log10(scores[p]) for p in own) for own in pairs], n


def test_scores_agree_with_the_plain_model(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["The", "cat", "dog", "sat", "on", "a", "mat", f"w{rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    want, n = plain_scores(rows, [i % 5 == 1 for i, _ in rows], 4, 1)
    got = {r.doc_id: r for r in pitman_yor.score(table(spark, rows), F.col("doc_id") % 5 == 1, sweeps=4, burn_in=1).collect()}
    assert all(got[i].score == pytest.approx(x) and got[i].train_tokens == n for (i, _), x in zip(rows, want, strict=True))
    with pytest.raises(ValueError):
        pitman_yor.score(table(spark, rows), F.lit(False), sweeps=2, burn_in=2)


def test_chunks_don_t_change_scores(spark, monkeypatch):
    docs = table(spark, [(i, f"the cat number {i % 7} sat on mat {i % 3}") for i in range(200)])
    one = {r.doc_id: (r.base_score, r.score) for r in pitman_yor.score(docs, F.col("doc_id") % 5 == 1).collect()}
    many = {r.doc_id: (r.base_score, r.score) for r in pitman_yor.score(docs.repartition(3), F.col("doc_id") % 5 == 1).collect()}
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k]) for k in one)


def test_ascending_numbers_are_packed_whole():
    for gaps in ([], [0, 1, 255, 256, 65_279, 65_280, 1 << 20, 3, 1 << 40], [1] * 50):
        x = np.cumsum(np.array(gaps, np.int64))
        assert pitman_yor.unpack_ascending(pitman_yor.pack_ascending(x), len(x)).tolist() == x.tolist()


def test_each_pair_is_seated_once(spark, monkeypatch, tmp_path):
    """Chunks that hold the same pairs share them out, and each knows the tables of all in the end."""
    monkeypatch.setattr(pitman_yor, "work_dir", lambda spark, name: f"file://{tmp_path}/{name}")
    texts = [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 40))) for i in range(120)]
    got = pitman_yor.score(table(spark, texts).repartition(4), F.col("doc_id") % 5 == 1, sweeps=3, burn_in=1)
    distinct = {p for i, t in texts if i % 5 != 1 for p in zip([None, *words(t)], [*words(t), None], strict=True)}
    stored = [len(zstandard.ZstdDecompressor().decompress(f.read_bytes()[8:])) for f in (tmp_path / "seats").glob("*-0")]
    assert len(stored) == 4 and sum(stored) == len(distinct) and min(stored) > len(distinct) / 8
    want, _ = plain_scores(texts, [i % 5 == 1 for i, _ in texts], 3, 1)
    assert [r.score for r in sorted(got.collect(), key=lambda r: r.doc_id)] == pytest.approx(want)


# ---------------------------------------------------------------- quality


def test_quality_is_not_fitted_on_the_driver(spark, monkeypatch):
    """The sample's features stay in a task, and the model is that of the rows in the order of their hashes."""
    rng = random.Random(8)
    good, bad = "the report says that many people of this town read good books".split(), "$$$ win!!! click >>> 0000 free %%% #### cash".split()
    rows = [(i, " ".join(rng.choice(bad if i % 3 == 0 else good) for _ in range(30))) for i in range(300)]
    docs = table(spark, rows).select("doc_id", "text")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)], "doc_id long, quality int")
    place = {r.doc_id: (r.p, r.u) for r in docs.where(quality.fold() != 0).select("doc_id", F.xxhash64("doc_id").alias("p"), F.xxhash64(F.lit(7), "doc_id").alias("u")).collect()}

    def features(ids):
        data = [rows[i][1].encode() for i in ids]
        return quality.featurise(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])).astype(np.float16).astype(np.float32)

    positive = features(sorted((i for i in place if i % 3), key=lambda i: place[i][0])[:50])
    unlabelled = features(sorted(place, key=lambda i: place[i][1])[:90])
    want = quality.fit_nnpu(positive, unlabelled, quality.estimate_prior(positive, unlabelled))

    def stop(*args, **more):
        raise AssertionError("the driver holds features")

    monkeypatch.setattr(quality, "fit_nnpu", stop)
    monkeypatch.setattr(quality, "estimate_prior", stop)
    model = quality.fit(docs, labels, 50, 90)
    assert model.prior == pytest.approx(want.prior, abs=1e-3) and model.weights == pytest.approx(want.weights, abs=0.02 * float(np.abs(want.weights).max()))


def test_quality_learns_and_handles_odd_rows(spark):
    rng = random.Random(0)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat", "on", "a", "warm", "mat", "and", "slept", "well."]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["BUY!!", "$$$", "###", "NOW!!", "%%%"]) for _ in range(40))
    rows = [(i, good() if i % 4 else bad()) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 600, 2)] + [(10, 1, 0), (None, 1, 0), (601, None, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, [*rows, *((d and d + 5000, t) for d, t in ODD)])
    model = quality.fit(docs, labels)
    scored = {r.doc_id: r.score for r in quality.score(docs.drop("score"), model).where("doc_id < 600").collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((scored[i] >= 0.3) == (i % 4 > 0) for i in held) / len(held) > 0.97
    assert quality.score(docs.drop("score"), model).count() == 600 + len(ODD)
    again = quality.fit(docs, labels)
    assert np.allclose(model.weights, again.weights)


def test_quality_without_labels(spark):
    docs = table(spark, ODD).drop("score")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, empty)).collect()} == {0.5}
    assert quality.keep_good(table(spark, ODD), empty).columns == table(spark, ODD).columns
    assert quality.keep_good(docs, empty).count() == len(ODD)
    assert quality.score(table(spark, []).drop("score"), quality.fit(docs, empty)).count() == 0


# ---------------------------------------------------------------- mixing


def mixed(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, lang string, n_chars long, alpha double, whole double, limit string, block int, pass int")


def source_rows(n=300):
    return [(i, ["big", "mid", "small", None, ""][min(i % 10, 4) if i % 10 < 5 else 0], "w " * (1 + i % 7), "en", 1, 0.0, 0.0, "k", 1, 1) for i in range(n)]


def test_mix_repeats_within_the_limit_and_fills_the_budget(spark):
    docs = mixed(spark, source_rows())
    plan = mixing.plan(docs, repeat=2.0).collect()
    per = {}
    for r in plan:
        per.setdefault(r.source, []).append(r)
    tokens = {}
    for _, s, t, *_ in source_rows():
        tokens[s or ""] = tokens.get(s or "", 0) + len(t.split())
    top = max(tokens.values())
    passes = {s: sum(r.n_tokens for r in rows) / tokens[s] for s, rows in per.items()}
    assert passes["big"] == pytest.approx(1) and tokens["big"] == top
    assert max(passes.values()) == pytest.approx(2, abs=8 / min(tokens.values()))
    assert {r.doc_id for r in plan} == set(range(300))
    again = sorted((r.doc_id, r["pass"], r.block) for r in mixing.plan(docs, repeat=2.0).collect())
    assert again == sorted((r.doc_id, r["pass"], r.block) for r in plan)
    times = {}
    for r in plan:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    copies = {}
    for r in mixing.mix(docs, repeat=2.0).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == times and mixing.mix(docs, repeat=2.0).columns == docs.columns


def test_target_entropy(spark):
    totals = spark.createDataFrame([("a", 1, 900), ("b", 1, 90), ("c", 1, 10), ("d", 3, 0)], "source string, n_docs long, tokens long")
    rows = mixing.exponents(totals, None, 0.9).collect()
    w = [r.weight for r in rows if r.weight > 0]
    assert sum(w) == pytest.approx(1) and -sum(x * math.log(x) for x in w) == pytest.approx(0.9, abs=1e-6)
    high = {r.source: r.weight for r in mixing.exponents(totals, None, 0.05).collect()}  # under the entropy of the shares: alpha over 1
    assert -sum(x * math.log(x) for x in high.values() if x) == pytest.approx(0.05, abs=1e-6) and high["a"] > 0.98
    flat = [r.weight for r in mixing.exponents(totals, None, math.log(3)).collect()]
    assert sorted(flat) == pytest.approx([0, 1 / 3, 1 / 3, 1 / 3], abs=1e-4)
    for bad in ((None, None), (2.0, 0.9), (None, 5.0), (None, -0.1), (0.5, None)):
        with pytest.raises(ValueError):
            mixing.exponents(totals, *bad)
    with pytest.raises(ValueError):
        mixing.plan(mixed(spark, source_rows(10)), budget=-1)


def test_many_passes_and_given_counts(spark):
    rows = [(i, "big" if i else "tiny", "w " * 9, "en", 7 if i else 2, 0.0, 0.0, "k", 1, 1) for i in range(60)]
    plan = mixing.plan(mixed(spark, rows), None, 0.69, tokens_col="n_chars").collect()
    tiny = [r for r in plan if r.source == "tiny"]
    assert sorted(r["pass"] for r in tiny) == list(range(len(tiny))) and len(tiny) > 100 and {r.n_tokens for r in tiny} == {2}
    assert sorted(r.doc_id for r in plan if r.source == "big") == list(range(1, 60))
    copies = [r.doc_id for r in mixing.mix(mixed(spark, rows), None, 0.69, tokens_col="n_chars").collect()]
    assert copies.count(0) == len(tiny) and len(copies) == len(plan)


def test_mix_of_odd_tables(spark):
    odd = mixed(spark, [(1, None, None, "en", 1, 0.0, 0.0, "k", 1, 1), (2, "a", "", "en", 1, 0.0, 0.0, "k", 1, 1), (3, "b", "x y", "en", 1, 0.0, 0.0, "k", 1, 1), (3, "b", "x y", "en", 1, 0.0, 0.0, "k", 1, 1), (None, "b", "z", "en", 1, 0.0, 0.0, "k", 1, 1)])
    assert sorted((r.doc_id for r in mixing.mix(odd).collect()), key=str) == [1, 2, 3, 3, None]
    assert mixing.plan(mixed(spark, [])).count() == 0 and mixing.mix(mixed(spark, [])).count() == 0


# ---------------------------------------------------------------- audio


def plain_features(payload):
    """Log-mel patches and spans by the definitions: a direct convolution, a direct Fourier sum and a state machine."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float64) - 128) / 128
    x -= x.mean()
    up, down, taps = 3, 8, audio.TAPS  # 16 kHz to 6 kHz
    n = np.arange(up * taps) - (up * taps - 1) / 2
    h = np.sinc(n / down) / down * np.hamming(up * taps)
    h *= up / h.sum()
    zeros = np.zeros(len(x) * up)
    zeros[::up] = x
    full = np.concatenate([np.zeros(up * taps), zeros, np.zeros(2 * up * taps)])
    y = np.array([sum(h[k] * full[up * taps + m * down + up * (taps - 1 - taps // 2) - k] for k in range(up * taps)) for m in range(-(-len(x) * up // down))])
    frames = 1 + max(0, -(-(len(y) - 192) // 96))
    y = np.append(y, np.zeros(max(0, (frames - 1) * 96 + 192 - len(y))))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(192) / 192)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(192)) / 256)
    power = np.array([np.abs(turn @ (y[i * 96 : i * 96 + 192] * window)) ** 2 for i in range(frames)])
    edges = 700 * (10 ** (np.linspace(2595 * np.log10(1 + 20 / 700), 2595 * np.log10(1 + 3000 / 700), 26) / 2595) - 1)
    f = np.linspace(0, 3000, 129)
    bank = np.array([[max(0, min((v - edges[m]) / (edges[m + 1] - edges[m]), (edges[m + 2] - v) / (edges[m + 2] - edges[m + 1]))) for m in range(24)] for v in f])
    energy = 10 * np.log10(power.sum(1) / 256 + 1e-6)
    spans, begin = [], None
    for i, e in enumerate([*(energy - np.median(energy)), -np.inf]):
        if begin is None and e > 3:
            begin = i
        elif begin is not None and e < -1:
            if i - begin >= 3:
                spans.append((begin * 0.016, i * 0.016))
            begin = None
    return np.log10(power @ bank + 1e-6), spans


def test_features_agree_with_plain_ones():
    rng = random.Random(3)
    loud = 0
    for size in (192, 1920, 9600):
        payload = b"".join(bytes([rng.randrange(256) if (i // 1500) % 4 == 1 else rng.choice(b"ab")]) for i in range(size))
        tensor, frames, spans = audio.analyse(audio.wav(payload))
        mel, want = plain_features(payload)
        got = np.frombuffer(tensor, np.float16).reshape(-1, audio.MELS)
        assert frames == len(mel) and np.abs(got[:frames] - mel).max() < 0.02 and not got[frames:].any()
        assert np.allclose(np.array(spans), np.array(want), atol=1e-3) and len(spans) == len(want)
        loud += len(spans)
    assert loud


def test_audio_round_trip_and_equal_texts(spark, tmp_path):
    rows = [*ODD, (30, ODD[4][1]), (31, "x" * 192), (32, "x" * 193)]
    clips = audio.store(table(spark, rows))
    manifest = audio.save_features(clips.repartition(3), f"file://{tmp_path}/f")
    found = audio.load_features(manifest).collect()
    media = [bytes(r.media) for r in clips.collect()]
    assert sorted(r.media_sha256 for r in found) == sorted(hashlib.sha256(m).hexdigest() for m in media)
    assert sorted(r.media_bytes for r in found) == sorted(map(len, media))
    by_media = {hashlib.sha256(m).hexdigest(): audio.analyse(m) for m in media}
    for r in found:
        tensor, frames, spans = by_media[r.media_sha256]
        assert (r.patches, r.n_frames, [(x.start_s, x.end_s) for x in r.spans]) == (tensor, frames, spans)
    want = {}
    for d, t in rows:
        raw = (t or "").encode()
        want.setdefault(d, []).append(raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw)))
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append(r)
    for d, payloads in want.items():
        assert sorted(r.payload_sha256 for r in got[d]) == sorted(hashlib.sha256(p).hexdigest() for p in payloads)
        assert sorted(r.tail_crc32 for r in got[d]) == sorted(zlib.crc32(p[-16:]) for p in payloads)
    assert got[5][0].patches == got[30][0].patches or got[5][1].patches == got[30][0].patches or got[5][2].patches == got[30][0].patches
    tables = [audio.open_features(r.path) for r in manifest.collect()]
    assert all(t.schema.field("patches").type.value_type == audio.TENSOR and audio.TENSOR.shape == [32, 24] for t in tables)
    first = tables[0]["patches"].chunk(0)[0].values.to_numpy_ndarray()
    assert first.shape[1:] == (32, 24) and first.astype(np.float16).tobytes() in {r.patches for r in found}
    assert audio.load_features(audio.save_features(audio.store(table(spark, [])), f"file://{tmp_path}/e")).count() == 0


def test_resampling_keeps_a_tone():
    t = np.arange(16_000) / 16_000
    y = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    assert len(y) == 6000
    spectrum = np.abs(np.fft.rfft(y))
    assert abs(int(spectrum.argmax()) - 440) <= 1
    alias = audio.resample(np.sin(2 * np.pi * 5500 * t).astype(np.float32))
    assert np.abs(alias[100:-100]).max() < 0.2


def test_segments_have_hysteresis():
    e = np.array([0, 0, 0, 5, 2, 1, 5, -3, 0, 0, 0, 4, -2, 0, 0.0])
    assert audio.segments(e, 3, -1, 3) == [(3, 7)]
    assert audio.segments(np.zeros(9), 3, -1, 1) == []
