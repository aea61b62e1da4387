"""Synthetic question-answer pairs for nodes: batches of nodes, one prompt each, replies parsed and attached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import QuestionGeneratorConfig
from ..functions.templates import SYNTHETIC_QA, PromptTemplate
from ..functions.text import strip
from ..operators import qa
from ..registry import Registry
from .models import LLMDriver, generate_column


def batch_prompts(batched: DataFrame, num_questions: int, template: PromptTemplate = SYNTHETIC_QA) -> DataFrame:
    """batch_id, prompt: the texts of a batch, numbered by chunk_id."""
    texts = batched.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "content"))).alias("_t"))
    listed = F.array_join(F.transform("_t", lambda t: F.concat(F.lit("["), t.chunk_id.cast("string"), F.lit("] "), strip(t.content))), "\n\n")
    return texts.select("batch_id", template.render(num_questions=F.lit(num_questions), chunks=listed).alias("prompt"))


def generate(nodes: DataFrame, driver: LLMDriver, config: QuestionGeneratorConfig | None = None, template: PromptTemplate = SYNTHETIC_QA, now=None, **rules) -> DataFrame:
    """Nodes with ``synthetic_qa``. Batches are made within a source, so no window spans all nodes; a reply that is not
    the JSON that was asked for stops the job."""
    config = config or QuestionGeneratorConfig()
    batched = qa.batches(nodes, config.batch_size, "node_id", "source_id").withColumn("batch_id", F.xxhash64("source_id", "batch_id"))
    replies = generate_column(batch_prompts(batched, config.num_questions, template), driver, "prompt", "_g", config.max_tokens, config.temperature)
    replies = replies.select("batch_id", F.col("_g.text").alias("reply"))
    return qa.attach(batched, replies, config.num_questions, config.validation, now, **rules).drop("batch_id", "chunk_id")


GENERATORS = Registry("question generator", llm=generate)
