"""Splitting good rows from bad ones, and exact duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import IngestionError
from ..schemas import require


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with a column ``broken``: names of the rules they break); one pass each, no shuffle."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    marked = df.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def apply_policy(df: DataFrame, fail_fast: bool) -> tuple[DataFrame, DataFrame | None]:
    """Rows with a column ``error``: stop at the first error, or give (good rows, errors)."""
    if fail_fast:
        return require(df, F.col("error").isNull(), "ingestion failed").drop("error"), None
    return df.where(F.col("error").isNull()).drop("error"), df.where(F.col("error").isNotNull())


def exact_dedup(docs: DataFrame, key: str = "source_id", order: str | None = None) -> DataFrame:
    """One row for each key: the least by ``order``; a partial aggregation, so a hot key is combined before the shuffle."""
    if order is None:
        return docs.dropDuplicates([key])
    rest = [c for c in docs.columns if c != key]
    best = docs.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*(F.col(c) if c == key else F.col(f"_row.{c}").alias(c) for c in docs.columns))


def fail_on_empty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise IngestionError("nothing to ingest")
    return df
