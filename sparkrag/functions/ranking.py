"""Ranking metrics as expressions over arrays: ``got``, retrieved ids in rank order, and ``relevant``, the right ids.

Repeated ids count as the definitions have it: once in recall, each time in precision, NDCG and MAP.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _guard(got: Column, relevant: Column, value: Column) -> Column:
    return F.when((F.size(got) == 0) | (F.size(relevant) == 0), F.lit(0.0)).otherwise(value)


def _hit(relevant: Column) -> Callable[[Column], Column]:
    return lambda x: F.array_contains(relevant, x)


def recall(got: Column, relevant: Column, k: int) -> Column:
    """Share of the distinct relevant ids among the first k."""
    return _guard(got, relevant, F.size(F.array_intersect(F.slice(got, 1, k), relevant)).cast("double") / F.nullif(F.size(F.array_distinct(relevant)), F.lit(0)))


def precision(got: Column, relevant: Column, k: int) -> Column:
    """Share of relevant ids among the first k, or among all if they are fewer."""
    top = F.slice(got, 1, k)
    return _guard(got, relevant, F.size(F.filter(top, _hit(relevant))).cast("double") / F.nullif(F.size(top), F.lit(0)))


def mrr(got: Column, relevant: Column, k: int | None = None) -> Column:
    """One over the rank of the first relevant id in the whole list; 0 if there is none."""
    at = F.filter(F.transform(got, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda r: r.isNotNull())
    return _guard(got, relevant, F.coalesce(F.lit(1.0) / F.array_min(at), F.lit(0.0)))


def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2((rank + 1).cast("double"))


def ndcg(got: Column, relevant: Column, k: int) -> Column:
    """Gains of relevant ids, discounted by log2(rank + 1), over those of an ideal list of min(k, number of relevant ids)."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    own = total(F.transform(F.slice(got, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), _gain(i + 1)).otherwise(0.0)))
    ideal = total(F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.lit(k), F.size(relevant)), F.lit(1))), _gain))
    return _guard(got, relevant, own / ideal)


def average_precision(got: Column, relevant: Column, k: int) -> Column:
    """Precisions at the ranks of relevant ids among the first k, summed, over the number of distinct relevant ids."""
    hits = F.transform(F.slice(got, 1, k), lambda x: F.when(F.array_contains(relevant, x), 1.0).otherwise(0.0))
    start = F.struct(F.lit(0.0).alias("rank"), F.lit(0.0).alias("hits"), F.lit(0.0).alias("total"))
    step = lambda s, h: F.struct((s.rank + 1.0).alias("rank"), (s.hits + h).alias("hits"), (s.total + h * (s.hits + h) / (s.rank + 1.0)).alias("total"))
    return _guard(got, relevant, F.aggregate(hits, start, step, lambda s: s.total) / F.nullif(F.size(F.array_distinct(relevant)), F.lit(0)))
