"""Quality classifier by positive-unlabelled learning.

A linear model over features of a whole text is fitted by minimising the non-negative unbiased risk

    pi * E_P[l(z)] + max(0, E_U[l(-z)] - pi * E_P[l(-z)])

with the logistic loss l, where P are trusted positives, U is unlabelled text of the corpus itself and pi the class
prior, which ``estimate_prior`` finds from P and U alone. Texts labelled 0 are never used. Since the loss is a proper
one, sigmoid(z) estimates the chance of a positive, which is the score.

The fit uses a sample of at most ``most_positive`` and ``most_unlabelled`` rows, those with the smallest hash of their
id; everything else covers all rows, in one pass without a shuffle. Features are the text's shares of hashed byte
pairs and shares of character classes, word lengths and repeated words; no label, language, source or id is among them.

Fixed results: a null text scores like an empty one; rows that repeat a doc_id are scored each; a doc_id with several
labels counts with its least; of rows that repeat a chosen id, the fit takes the least features; a null doc_id counts as
the empty text in the folds, which is held out; without any positive every score is 0.5; an empty table stays empty;
further columns of the tables are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, lean, release, span_hashes, spans, text_steps

PAIRS = 512
STEP_TEXTS = 512  # texts whose features are held at once
_CLASSES = [b"|", b"!", b"$", b"%", b"&", b"*", b"#", b".", b",", b"?", b"<>", b"{}[]()", b"\"'", b"/\\:;@=_-+~`^", b"0123456789", b"\n", b" \t\r"]
_CLASS = np.zeros(256, np.int64)
for _i, _b in enumerate(_CLASSES):
    _CLASS[list(_b)] = _i + 1
_CLASS[65:91] = len(_CLASSES) + 1
_CLASS[128:] = len(_CLASSES) + 2
N_CLASS = len(_CLASSES) + 3
N_DENSE = N_CLASS + 9
WIDTH = PAIRS + N_DENSE


def featurise(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features [texts, WIDTH] of texts that lie one after another in ``data``."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, WIDTH), np.float32)
    text = np.repeat(np.arange(n), size)
    if len(data):
        pair = (data[:-1].astype(np.uint32) * np.uint32(40503) + data[1:].astype(np.uint32) * np.uint32(30011)) >> np.uint32(3)
        same = text[1:] == text[:-1]
        counts = np.bincount(text[:-1][same] * PAIRS + (pair[same] % PAIRS), minlength=n * PAIRS).reshape(n, PAIRS)
        out[:, :PAIRS] = np.sqrt(counts / np.maximum(1, size - 1)[:, None])
        counts = np.bincount(text * N_CLASS + _CLASS[data], minlength=n * N_CLASS).reshape(n, N_CLASS)
        out[:, PAIRS : PAIRS + N_CLASS] = np.sqrt(counts / np.maximum(1, size)[:, None])
    starts, ends, of, word = spans(data, offsets)
    words = np.bincount(of, minlength=n)
    length = (ends - starts).astype(np.float64)
    share = lambda x: np.bincount(of, weights=x, minlength=n) / np.maximum(1, words)
    hashes = span_hashes(LOWER[data], starts, ends, word)
    dense = [np.minimum(share(length), 40) / 10, np.minimum(np.sqrt(share(length**2)), 60) / 15, share(length > 12), share(length == 1)]
    for lag in (1, 2, 3):
        x = np.zeros(len(of))
        x[lag:] = (hashes[lag:] == hashes[:-lag]) & (of[lag:] == of[:-lag])
        dense.append(share(x))
    dense += [np.log1p(words) / 8, words == 0]
    out[:, PAIRS + N_CLASS :] = np.stack(dense, 1)
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x * self.weights).sum(1, dtype=np.float64) + self.bias, -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, l2: float = 1e-4, steps: int = 400, rate: float = 0.05) -> Model:
    """Minimise the non-negative risk by Adam; where the negative part falls below zero, its gradient is reversed."""
    mean = unlabelled.mean(0)
    p, u = positive - mean, unlabelled - mean
    std = np.sqrt(np.einsum("ij,ij->j", u, u) / len(u)) + 1e-3
    for x in (p, u):
        x /= std
        np.clip(x, -8, 8, out=x)
    w, b = np.zeros(p.shape[1], np.float32), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        sp, su = 1 / (1 + np.exp(-(p @ w + b))), 1 / (1 + np.exp(-(u @ w + b)))  # sigmoid: the slope of l(-z)
        negative = -np.log1p(-np.minimum(su, 1 - 1e-7)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-7)).mean()
        g_pos, g_p, g_u = -prior * (1 - sp) / len(p), -prior * sp / len(p), su / len(u)
        own = g_pos + g_p if negative >= 0 else -g_p
        other = g_u if negative >= 0 else -g_u
        grad = np.append(p.T @ own.astype(np.float32) + u.T @ other.astype(np.float32) + l2 * w, own.sum() + other.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), b - step[-1]
    scaled = w / std
    return Model(scaled.astype(np.float32), float(b - mean @ scaled), prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.05, folds: int = 4, rounds: int = 3) -> float:
    """The share of positives among unlabelled texts, from the two samples alone.

    Whatever the classifier and the threshold, unlabelled texts pass it at least pi times as often as positives do: the
    ratio of the two shares bounds pi from above, and the better the classifier, the tighter. Scores are cross-fitted (each
    text's by a model of the other folds); the estimate is the least ratio over thresholds that at least half of the
    positives pass. Each round fits with the estimate of the one before; the mean of the rounds after the first counts.
    """
    if min(len(positive), len(unlabelled)) < 10 * folds:
        return 0.5
    of_p, of_u = np.arange(len(positive)) % folds, np.arange(len(unlabelled)) % folds
    p, u, prior, found = np.zeros(len(positive)), np.zeros(len(unlabelled)), 0.5, []
    for _ in range(rounds):
        for k in range(folds):
            rough = fit_nnpu(positive[of_p != k], unlabelled[of_u != k], prior, steps=120)
            p[of_p == k], u[of_u == k] = rough.score(positive[of_p == k]), rough.score(unlabelled[of_u == k])
        cuts = np.unique(p)
        over_p, over_u = (1 - np.searchsorted(np.sort(x), cuts, side="left") / len(x) for x in (p, u))
        prior = float(np.clip((over_u / over_p)[over_p >= 0.5].min(), least, 1 - least))
        found.append(prior)
    return float(np.mean(found[1:]))


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text (null: the empty text), modulo 5; 0 marks the held-out rows."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def _features(docs: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, offsets in text_steps(batch, "text", rows=STEP_TEXTS):
                x = featurise(data, offsets)
                yield pa.record_batch([batch.column(0).slice(first, n), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(lean(scan), "doc_id long, x binary")


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows (kind, place, doc_id, x) of a task, taken by kind, place and id."""
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held)
    kind, place, ids = (t[i].to_numpy() for i in range(3))
    order = np.lexsort((ids, place, kind))
    x = np.frombuffer(b"".join(v.as_buffer() for v in t["x"]), np.float16).reshape(-1, WIDTH)
    del held, t
    positive, unlabelled = (x[order[kind[order] == k]].astype(np.float32) for k in (1, 0))
    del x
    if len(positive) and len(unlabelled):
        model = fit_nnpu(positive, unlabelled, estimate_prior(positive, unlabelled))
        yield pa.record_batch([pa.array([model.weights.tobytes()]), pa.array([model.bias]), pa.array([model.prior])], names=["weights", "bias", "prior"])


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = 8_000, most_unlabelled: int = 16_000) -> Model:
    """Fit on rows outside the held-out fold: positives from ``labels``, unlabelled text from ``docs``.

    The sample, a row of 1.1 KB for each chosen id, meets in one task; only the model comes to the driver.
    """
    known = labels.where(F.col("quality").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    pick = lambda rows, place, most, kind: rows.select("doc_id", place.alias("place")).orderBy("place", "doc_id").limit(most).withColumn("kind", F.lit(kind))
    chosen = pick(known.where("quality = 1"), F.xxhash64("doc_id"), most_positive, 1)
    free = pick(docs.where(fold() != 0), F.xxhash64(F.lit(7), "doc_id"), most_unlabelled, 0)
    ids = chosen.unionByName(free)  # at most most_positive + most_unlabelled rows of three numbers
    texts = docs.where(fold() != 0).join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")
    found = _features(texts).groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = found.join(F.broadcast(ids), "doc_id").select("kind", "place", "doc_id", "x").repartition(1)
    for r in rows.mapInArrow(lean(_learn), "weights binary, bias double, prior double").collect():
        return Model(np.frombuffer(r.weights, np.float32), r.bias, r.prior)
    return Model(np.zeros(WIDTH, np.float32), 0.0, 0.5)


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """All columns of ``docs`` with the score as column ``out``, which replaces one of that name; one pass over whole texts.

    Only texts travel to Python and only scores come back; the other columns wait in the JVM.
    """

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                batch = pa.record_batch([texts], names=["text"])
                parts = [model.score(featurise(data, offsets)) for _, _, data, offsets in text_steps(batch, "text", rows=STEP_TEXTS)]
                yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
        finally:
            release()

    return docs.withColumn(out, F.arrow_udf(scan, "double")(F.col("text").cast("string")))


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    scored = score(docs, model)
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Documents that the classifier doesn't reject, with their own columns."""
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    return score(docs, model, "_quality_score").where(F.col("_quality_score") >= threshold).drop("_quality_score")
