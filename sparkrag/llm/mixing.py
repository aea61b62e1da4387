"""Mixing sources to target weights with DataFrame functions only.

``exponents``: a source's weight is its share of all tokens to the power of an exponent, normalised. The exponent is
found by bisection. For a repetition limit it lies in [0, 1] and is the least one whose weights repeat no source more than
``repeat`` times as often as the source with most tokens; the smallest source alone decides that, so the bisection runs
inside one SQL expression. For a target entropy (natural logarithm) it lies in [0, ``MOST_ALPHA``]: the entropy falls from
the logarithm of the number of sources, at 0, and each of a few steps evaluates it at ``WAYS`` exponents in one aggregation
over the source totals, which stay distributed. An entropy that no such exponent reaches is an error that names the range.

``plan`` realises the weights within a token budget, at least one whole pass over each source by default: source s gets
floor(budget_s / tokens_s) whole passes over its documents, each in an order of its own (by a seeded hash), and then
documents in the order of one more pass until the rest of the budget is used. Running token counts place each copy in
its source's stream; the copy's place, as a share of that stream, names its block, so that each block is a permutation
of documents in which every source has about its weight.

A hot source costs nothing extra: a running count is made of totals over blocks of hashes (an aggregation that
combines before its shuffle), a running sum over those totals, and windows over single blocks, whose number follows the
number of documents.

Fixed results: null and empty sources are one source ""; null texts have no tokens and come in whole passes only as
often as their source does; a source without tokens keeps each document once; a repetition limit under 1, a negative
budget or an entropy out of reach is a ValueError; rows that repeat a doc_id are documents of their own, equal rows in any
order; texts of any length count whole; an empty table stays empty; further columns are ignored by ``plan`` and kept by
``mix``. Tokens are blank-separated words, or what a column of the table says (``tokens_col``; null: none).
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

STEPS = 40
MOST_ALPHA, WAYS, ROUNDS = 64.0, 32, 9
BLOCK_TOKENS = 1 << 20
_BETWEEN = r"[\x20\x09-\x0D]+"


def n_words(text: str) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), _BETWEEN), "")).cast("long")


def _entropy_alpha(totals: DataFrame, top: float, entropy: float) -> float:
    """The exponent whose weights have that entropy, by bisection in ``WAYS`` parts a step."""
    x = F.col("tokens") / F.lit(top)
    some = totals.where("tokens > 0")

    def entropies(alphas: list[float]) -> list[float]:
        sums = []
        for a in alphas:
            power = F.pow(x, F.lit(a))
            sums += [F.sum(power), F.sum(power * F.log(x))]
        got = some.agg(*(c.alias(f"c{i}") for i, c in enumerate(sums))).first()
        return [log(got[2 * i]) - a * got[2 * i + 1] / got[2 * i] for i, a in enumerate(alphas)]

    low, high = 0.0, MOST_ALPHA
    most, least = entropies([low, high])
    if not least - 1e-9 <= entropy <= most + 1e-9:
        raise ValueError(f"weights of these sources have entropies from {least:.9g} to {most:.9g}")
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / WAYS for i in range(WAYS + 1)]
        i = sum(h > entropy for h in entropies(points[1:-1]))
        low, high = points[i], points[i + 1]
    return high


def exponents(totals: DataFrame, repeat: float | None = 2.0, entropy: float | None = None) -> DataFrame:
    """``totals`` (source, tokens) with columns alpha, weight and passes (of the budget that gives the largest source one)."""
    if (repeat is None) == (entropy is None):
        raise ValueError("give either a repetition limit or an entropy")
    if repeat is not None and repeat < 1:
        raise ValueError("the largest source has one pass: no limit under 1 can be kept")
    if repeat is not None:
        # the largest of all p ** (a - 1) is that of the smallest source
        high = f"pow(least, mid - 1.0D) > {float(repeat)}D"  # repeats too much: a larger exponent is needed
        step = f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0.0D, 'hi', 1.0D), (b, k) -> transform(array((b.lo + b.hi) / 2.0D), mid -> if({high}, named_struct('lo', mid, 'hi', b.hi), named_struct('lo', b.lo, 'hi', mid)))[0], b -> b.hi)"
        ends = totals.where("tokens > 0").agg(F.max("tokens").cast("double").alias("top"), F.min("tokens").cast("double").alias("low"))
        facts = ends.withColumn("least", F.col("low") / F.col("top")).select("top", F.expr(f"if(top IS NULL, 1.0D, {step})").alias("alpha"))
    else:
        top = totals.agg(F.max("tokens").cast("double")).first()[0]
        alpha = _entropy_alpha(totals, top, float(entropy)) if top else 1.0
        facts = totals.sparkSession.range(1).select(F.lit(top).cast("double").alias("top"), F.lit(alpha).alias("alpha"))
    out = totals.crossJoin(F.broadcast(facts))  # one row on the other side
    out = out.withColumn("power", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("top"), "alpha")).otherwise(0.0))
    whole = out.agg(F.sum("power").alias("whole"))
    out = out.crossJoin(F.broadcast(whole))  # one row again
    return out.select("source", "n_docs", "tokens", "alpha", (F.col("power") / F.col("whole")).alias("weight"), F.when(F.col("tokens") > 0, F.col("power") * F.col("top") / F.col("tokens")).otherwise(1.0).alias("passes"))


def _rank_key(number: Column) -> Column:
    return F.md5(F.concat_ws(":", number.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _placed(rows: DataFrame, digits: int) -> DataFrame:
    """rows (source, pass, doc_id, n_tokens, key) with ``before``: tokens of the documents that come earlier, by key, in a
    source's pass."""
    rows = rows.withColumn("part", F.substring("key", 1, digits))
    parts = rows.groupBy("source", "pass", "part").agg(F.sum("n_tokens").alias("part_tokens"))
    first = Window.partitionBy("source", "pass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("earlier", F.coalesce(F.sum("part_tokens").over(first), F.lit(0))).drop("part_tokens")
    inside = Window.partitionBy("source", "pass", "part").orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, ["source", "pass", "part"]).withColumn("before", F.col("own") + F.col("earlier")).drop("own", "earlier", "part")


def _counted(docs: DataFrame, id_col: str, source_col: str, text_col: str, tokens_col: str | None) -> tuple[DataFrame, DataFrame, int]:
    """(narrow rows in the shared folder, totals by source, hex digits that name blocks of about 20,000 documents)."""
    tokens = n_words(text_col) if tokens_col is None else F.coalesce(F.col(tokens_col).cast("long"), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), tokens.alias("n_tokens"))
    rows = cut(docs.sparkSession, rows, "counted")
    totals = cut(docs.sparkSession, rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens")), "totals")
    n = totals.agg(F.coalesce(F.max("n_docs"), F.lit(0))).first()[0]
    return rows, totals, max(2, ceil(log(max(n, 1) / 20_000 + 1, 16)))


def _with_budgets(totals: DataFrame, repeat: float | None, entropy: float | None, budget: int | None) -> DataFrame:
    """Budgets by source. Without ``budget`` the source that needs the largest one has exactly one whole pass."""
    if budget is not None and budget < 0:
        raise ValueError("a budget can't be negative")
    weights = exponents(totals, repeat, entropy)
    tokens = F.col("passes") * F.col("tokens") if budget is None else F.col("weight") * float(budget)
    out = weights.withColumn("budget", F.round(tokens).cast("long"))
    return out.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(1).cast("int")).withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("whole") * F.col("tokens")).otherwise(0))


def plan(docs: DataFrame, repeat: float | None = 2.0, entropy: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """One row for each copy of a document in the mix: doc_id, source, n_tokens, pass (from 0), block and key.

    Read in the order of block and key, the copies are the mix.
    """
    rows, totals, digits = _counted(docs, id_col, source_col, text_col, tokens_col)
    budgets = _with_budgets(totals, repeat, entropy, budget)
    blocks = budgets.agg(F.greatest(F.ceil(F.sum("budget") / block_tokens), F.lit(1)).alias("blocks"))
    budgets = cut(docs.sparkSession, budgets.crossJoin(F.broadcast(blocks)), "budgets")
    own = budgets.select("source", "tokens", "budget", "blocks", "rest", "whole", (F.col("whole") + F.signum("rest").cast("int")).alias("times")).where("times > 0")
    copies = rows.join(own.select("source", "times"), "source").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).drop("times")
    placed = _placed(copies.withColumn("key", _rank_key(F.lit(seed) + F.col("pass"))), digits).join(own, "source")
    out = placed.where((F.col("pass") < F.col("whole")) | (F.col("before") < F.col("rest"))).withColumn("at", F.col("before") + F.col("pass") * F.col("tokens"))
    block = F.least(F.floor(F.col("at") * F.col("blocks") / F.greatest("budget", F.lit(1))), F.col("blocks") - 1)
    return out.select("doc_id", "source", "n_tokens", "pass", block.cast("long").alias("block"), "key")


def mix(docs: DataFrame, repeat: float | None = 2.0, entropy: float | None = None, budget: int | None = None, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """Rows of ``docs``, each as often as ``plan`` takes it; texts are not shuffled.

    The documents of a source's last, partial pass are those up to a hash, which is found on narrow rows.
    """
    rows, totals, digits = _counted(docs, id_col, source_col, text_col, tokens_col)
    budgets = cut(docs.sparkSession, _with_budgets(totals, repeat, entropy, budget), "budgets").select("source", "whole", "rest")
    own = budgets.where("rest > 0")  # the key of the partial pass depends on its number
    last = rows.join(own.withColumnRenamed("whole", "pass"), "source").withColumn("key", _rank_key(F.lit(seed) + F.col("pass")))
    placed = _placed(last.drop("rest"), digits).join(own.select("source", "rest"), "source")
    limits = placed.where(F.col("before") < F.col("rest")).groupBy("source").agg(F.max("key").alias("limit"))
    budgets = cut(docs.sparkSession, budgets.join(limits, "source", "left"), "limits").select(F.col("source").alias("_source"), F.col("whole").alias("_whole"), F.col("limit").alias("_limit"))
    key = F.md5(F.concat_ws(":", (F.lit(seed) + F.col("_whole")).cast("string"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))))
    joined = docs.join(budgets, F.coalesce(docs[source_col], F.lit("")) == budgets["_source"])
    times = F.col("_whole") + F.when(key <= F.col("_limit"), 1).otherwise(0)
    return joined.withColumn("_times", times).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark.read.parquet(f"{sf_dir}/documents.parquet"), repeat=2.0).select("doc_id", "source", "n_tokens", "pass", "block")


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
t AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY 1),
x AS (SELECT min(tokens)::DOUBLE / max(tokens)::DOUBLE AS least, max(tokens)::DOUBLE AS top FROM t WHERE tokens > 0),
bis AS (SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
        UNION ALL
        SELECT k + 1, CASE WHEN pow(least, (lo + hi) / 2 - 1.0) > 2.0 THEN (lo + hi) / 2 ELSE lo END,
               CASE WHEN pow(least, (lo + hi) / 2 - 1.0) > 2.0 THEN hi ELSE (lo + hi) / 2 END
        FROM bis, x WHERE k < 40),
b0 AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN CAST(round(pow(tokens / top, hi) * top / tokens * tokens) AS BIGINT) ELSE 0 END AS budget FROM t, x, bis WHERE k = 40),
b AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest,
      (SELECT greatest(CAST(ceil(sum(budget) / 1048576.0) AS BIGINT), 1) FROM b0) AS blocks FROM b0),
c AS (SELECT d.*, b.tokens, b.budget, b.rest, b.blocks, b.whole, unnest(range(0, CAST(whole + sign(rest) AS BIGINT))) AS pass FROM d JOIN b USING (source)),
p AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, pass ORDER BY md5(pass::VARCHAR || ':' || doc_id::VARCHAR), n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT doc_id, source, n_tokens, CAST(pass AS INTEGER) AS pass,
       CAST(least(floor((before + pass * tokens) * blocks / greatest(budget, 1)::DOUBLE), blocks - 1) AS BIGINT) AS block
FROM p WHERE pass < whole OR before < rest
"""
