"""Scoring retrieval runs: metrics of each case, means over cases, reports; and the registry of metrics."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import MetricValidationError
from ..functions import ranking
from ..schemas import require

Builder = Callable[[Column, Column, int], Column]


@dataclass
class MetricRegistry:
    """Builders of metric expressions (retrieved, relevant, k) by name; ``recall@7`` asks for k = 7."""

    builders: dict[str, tuple[str, Builder]] = field(default_factory=dict)

    def register(self, name: str, builder: Builder, category: str = "retrieval") -> None:
        self.builders[name] = (category, builder)

    def parse(self, name: str, k: int | None = None) -> tuple[str, int | None]:
        """(base name, k): an explicit k counts before the one in the name; ``name@k`` itself needs one."""
        m = re.fullmatch(r"(\w+)@(\w+)", name)
        base = m[1] if m else name
        if base not in self.builders:
            raise KeyError(f"no metric {name!r}; known: {', '.join(sorted(self.builders))}")
        if k is None and m:
            if not m[2].isdigit() or not int(m[2]):
                raise ValueError(f"{name} needs a k")
            k = int(m[2])
        return base, k

    def get(self, name: str, k: int | None = None, **more) -> Callable[[Column, Column], Column]:
        """The expression of a metric; ``more`` is passed on to its builder."""
        base, k = self.parse(name, k)
        builder = self.builders[base][1]
        return lambda got, relevant: builder(got, relevant, 5 if k is None else k, **more)

    def names(self, category: str | None = None) -> list[str]:
        return sorted(n for n, (c, _) in self.builders.items() if category in (None, c))

    def categories(self) -> list[str]:
        return sorted({c for c, _ in self.builders.values()})

    def clear(self) -> None:
        self.builders.clear()


METRICS = MetricRegistry()
for _name, _builder in (("recall", ranking.recall), ("precision", ranking.precision), ("mrr", ranking.mrr), ("ndcg", ranking.ndcg), ("map", ranking.average_precision)):
    METRICS.register(_name, _builder)
WITHOUT_K = ("mrr",)
DEFAULT_KS = [5, 10, 20]


def resolve_ks(ks: list[int] | None = None, parameters: dict | None = None) -> list[int]:
    """Explicit ks, else those of the parameters (``ks``, then ``k``), else 5, 10 and 20; distinct, ascending."""
    parameters = parameters or {}
    if ks:
        return sorted(set(ks))
    if parameters.get("ks"):
        return sorted({int(x) for x in parameters["ks"]})
    return [int(parameters["k"])] if parameters.get("k") else list(DEFAULT_KS)


def lists(runs: DataFrame, truth: DataFrame, case: str = "query_id", node: str = "node_id") -> DataFrame:
    """query_id, got, relevant for cases that have both; others are left out and count in no mean."""
    got = runs.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("rank", node))).alias("_g")).select(case, F.transform("_g", lambda x: x[node]).alias("got"))
    return got.join(truth, case).where((F.size("got") > 0) & (F.size("relevant") > 0))


def case_metrics(cases: DataFrame, ks: list[int] | None = None, names: list[str] | None = None, parameters: dict[str, dict] | None = None, registry: MetricRegistry = METRICS, case: str = "query_id", strict: bool = False) -> DataFrame:
    """query_id, metric, value in long form; all metrics of all k in one projection over the arrays."""
    if strict:
        cases = require(cases, F.size("relevant") > 0, "a case has no relevant ids")
    pairs = []
    for name in names or registry.names("retrieval"):
        base, own = registry.parse(name)
        wanted = [None] if base in WITHOUT_K else [own] if own else resolve_ks(ks, (parameters or {}).get(base))
        more = {x: v for x, v in (parameters or {}).get(base, {}).items() if x not in ("k", "ks")}
        pairs += [F.struct(F.lit(base if k is None else f"{base}@{k}").alias("metric"), registry.get(base, k or 5, **more)(F.col("got"), F.col("relevant")).alias("value")) for k in wanted]
    return cases.select(case, F.inline(F.array(*pairs)))


def aggregate(values: DataFrame) -> DataFrame:
    """metric, value: unweighted means over cases."""
    return values.groupBy("metric").agg(F.avg("value").alias("value"), F.count("*").alias("n_cases"))


def long_metrics(hits: DataFrame, sizes: DataFrame, k: int, case: str = "query_id") -> DataFrame:
    """The same metrics without arrays, for long runs: from rows (query_id, rank, hit) and (query_id, n_relevant).

    Retrieved ids must be distinct. Running counts take one window, the rest one aggregation on the same key, so there
    is a single shuffle.
    """
    w = Window.partitionBy(case).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = hits.withColumn("so_far", F.sum("hit").over(w))
    inside = F.col("rank") <= k
    per = rows.groupBy(case).agg(
        F.sum(F.when(inside, F.col("hit")).otherwise(0)).alias("hits"),
        F.count_if(inside).alias("shown"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(inside, F.col("hit") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(inside, F.col("hit") * F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_relevant").cast("int"))), F.lit(0.0), lambda s, r: s + F.lit(1.0) / F.log2(r + 1.0))
    out = per.join(sizes.where("n_relevant > 0"), case)
    return out.select(case, (F.col("hits") / F.col("n_relevant")).alias("recall"), (F.col("hits") / F.col("shown")).alias("precision"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("dcg") / ideal).alias("ndcg"), (F.col("ap") / F.col("n_relevant")).alias("map"))


def hit_metrics(hits: DataFrame, sizes: DataFrame, ks: list[int] | None = None, names: list[str] | None = None, case: str = "query_id") -> DataFrame:
    """query_id, metric, value: what ``case_metrics`` gives, from rows (query_id, rank, hit) and (query_id, n_relevant).

    For truth that many cases share, such as the rows of a label: no case has the array of its relevant ids, so its size
    doesn't matter. Retrieved and relevant ids must be distinct.
    """
    ks, names = resolve_ks(ks), names or ["map", "mrr", "ndcg", "precision", "recall"]
    rows = hits.withColumn("so_far", F.sum("hit").over(Window.partitionBy(case).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    sums = [F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("_first")]
    for k in ks:
        inside = F.col("rank") <= k
        sums += [
            F.sum(F.when(inside, F.col("hit")).otherwise(0)).alias(f"_hits{k}"),
            F.count_if(inside).alias(f"_shown{k}"),
            F.sum(F.when(inside, F.col("hit") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"_dcg{k}"),
            F.sum(F.when(inside, F.col("hit") * F.col("so_far") / F.col("rank")).otherwise(0.0)).alias(f"_ap{k}"),
        ]
    n = F.col("n_relevant")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), n).cast("int")), F.lit(0.0), lambda s, r: s + F.lit(1.0) / F.log2(r + 1.0))
    value = {
        "recall": lambda k: F.col(f"_hits{k}") / n,
        "precision": lambda k: F.col(f"_hits{k}") / F.col(f"_shown{k}"),
        "ndcg": lambda k: F.col(f"_dcg{k}") / ideal(k),
        "map": lambda k: F.col(f"_ap{k}") / n,
    }
    pairs = []
    for name in names:
        if name == "mrr":
            pairs.append(("mrr", F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0))))
        else:
            pairs += [(f"{name}@{k}", value[name](k)) for k in ks]
    per = rows.groupBy(case).agg(*sums).join(sizes.where("n_relevant > 0"), case)
    return per.select(case, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in pairs))))


def wide_report(results: DataFrame, values: DataFrame, metrics: list[str], case: str = "case_id") -> DataFrame:
    """One row a case: its answer and counts, and a column for each metric; absent values are null."""
    pivoted = values.groupBy(case).pivot("metric", metrics).agg(F.first("value"))
    g = F.col("generation_result")
    flat = results.select(case, "predicted_answer", "query", F.size("retrieved_ids").alias("num_retrieved"), "reranked", g.usage.prompt_tokens.alias("prompt_tokens"), g.usage.completion_tokens.alias("completion_tokens"), g.usage.total_tokens.alias("total_tokens"), g.finish_reason.alias("finish_reason"))
    return flat.join(pivoted, case, "left")


def check_relevant(relevant: list) -> None:
    if not relevant:
        raise MetricValidationError("there must be relevant ids")
