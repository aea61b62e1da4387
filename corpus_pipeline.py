"""From raw documents to training shards, in five stages.

Each stage works on all that the one before kept; all but the last keep the columns of ``documents``, and further ones.

Odd input: a null text counts as an empty one and a null id is an id like others; rows are judged each by their own text,
so rows that repeat an id can part ways; an empty table stays empty in every stage; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkrag.llm import decontaminate, jaccard, mixing, quality, sstable
from sparkrag.llm.common import work_dir

#: Passes over a small source for each pass over the largest one, at most.
REPEAT = 1.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects (score under 0.3) go; without any positive label none goes."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: one with the least id. Rows with null ids or without words stay, too."""
    return jaccard.dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of the benchmark occurs go; documents and items without words match nothing."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated up to the limit; every document stays at least once. Null and empty sources are one."""
    return mixing.mix(docs, repeat=REPEAT)


def output_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sorted shards, read back: doc_id, start, n_tokens, ids_crc32; null ids come first."""
    return sstable.read(sstable.write(docs, work_dir(spark, "shards"), added=True), digests_only=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", output_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = work_dir(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: A fitted classifier and a tokenizer have no SQL; tests compare the stages with plain versions instead.
ORACLE_SQL = None
