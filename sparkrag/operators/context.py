"""Packing ranked chunks into a token budget, and the prompt made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = ("end", "middle", "priority")
CHARS_PER_TOKEN = 4


def count_tokens(text: Column) -> Column:
    """Stand-in for a model's tokenizer: a token for every five characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 5)).cast("int")


def pack_prefix(chunks: DataFrame, query: str = "query_id", rank: str = "rank", tokens: str = "tokens", budget: str = "budget") -> DataFrame:
    """Chunks of the longest prefix, in rank order, that fits the query's budget (strategies "end" and "priority")."""
    w = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("_used", F.sum(tokens).over(w)).where(F.col("_used") <= F.col(budget)).drop("_used")


def pack_middle(chunks: DataFrame, query: str = "query_id", rank: str = "rank", tokens: str = "tokens", budget: str = "budget") -> DataFrame:
    """Chunks kept from both ends inwards: the first and the last, each if it fits, then left and right in turn up to the
    first that doesn't fit."""
    every, order = Window.partitionBy(query), Window.partitionBy(query).orderBy(rank)
    c = chunks.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(every))
    ends = c.withColumn("_a", F.max(F.when((F.col("_i") == 0) & (F.col(tokens) <= F.col(budget)), F.col(tokens))).over(every))
    ends = ends.withColumn("_a", F.coalesce("_a", F.lit(0)))
    is_last = (F.col("_i") == F.col("_n") - 1) & (F.col("_n") > 1)
    ends = ends.withColumn("_b", F.coalesce(F.max(F.when(is_last & (F.col("_a") + F.col(tokens) <= F.col(budget)), F.col(tokens))).over(every), F.lit(0)))
    left, right = F.col("_i") - 1, F.col("_n") - 2 - F.col("_i")
    key = F.when(left <= right, 2 * left).otherwise(2 * right + 1)
    inner = (F.col("_i") > 0) & ~is_last
    w = Window.partitionBy(query, inner).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_used", F.sum(tokens).over(w) + F.col("_a") + F.col("_b"))
    keep = F.when(F.col("_i") == 0, (F.col("_a") > 0) | (F.col(tokens) == 0)).when(is_last, (F.col("_b") > 0) | (F.col(tokens) == 0)).otherwise(F.col("_used") <= F.col(budget))
    return ends.where(keep).drop("_i", "_n", "_a", "_b", "_used")


def pack(chunks: DataFrame, strategy: str = "priority", **columns: str) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    return (pack_middle if strategy == "middle" else pack_prefix)(chunks, **columns)


def cut_text(text: Column, n: Column) -> Column:
    """Text cut to about n tokens, with "..." where it was longer."""
    most = n * CHARS_PER_TOKEN
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, F.lit(1), most), F.lit("...")))


def budgets(queries: DataFrame, window: int, completion: int, system: str, count=count_tokens, query_text: str = "query") -> DataFrame:
    """Queries with ``fixed``, ``budget`` for chunks and ``query_cut``, the text that the prompt takes.

    Where system and query alone fill the window, there is no context, and the query is cut: to what remains beside the
    system text less five tokens, or to 50 characters if less than ten remain.
    """
    available = window - completion
    sys_tokens, q_tokens = count(F.lit(system)), count(F.col(query_text))
    remaining = F.lit(available) - sys_tokens
    over = sys_tokens + q_tokens >= available
    shortened = F.when(remaining < 10, F.substring(query_text, 1, 50)).otherwise(cut_text(F.col(query_text), remaining - 5))
    return queries.withColumn("fixed", sys_tokens + q_tokens).withColumn("budget", F.when(over, F.lit(-1)).otherwise(F.lit(available) - sys_tokens - q_tokens)).withColumn("query_cut", F.when(over, shortened).otherwise(F.col(query_text)))


def build_prompt(system: Column, chunks: Column, query: Column) -> Column:
    """System text, numbered chunks, query."""
    listed = F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("\n["), (i + 1).cast("string"), F.lit("] "), c)), "")
    return F.concat(system, F.lit("\nContext:"), listed, F.lit("\n"), F.lit("\nUser: "), query)


def fit_context(queries: DataFrame, chunks: DataFrame, window: int = 4096, completion: int = 512, system: str = "", strategy: str = "priority", count=count_tokens) -> DataFrame:
    """queries (query_id, query) with ``chunks`` (texts that fit, in rank order) and ``prompt``; chunks: query_id, rank, content."""
    q = budgets(queries, window, completion, system, count)
    rows = chunks.join(q.where("budget >= 0").select("query_id", "budget"), "query_id").withColumn("tokens", count(F.col("content")))
    kept = pack(rows, strategy).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("_c"))
    out = q.join(kept, "query_id", "left").withColumn("chunks", F.coalesce(F.transform("_c", lambda x: x.content), F.array().cast("array<string>")))
    return out.withColumn("prompt", build_prompt(F.lit(system), F.col("chunks"), F.col("query_cut"))).drop("_c")
