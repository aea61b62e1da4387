"""Synthetic question-answer pairs: parsing, validation, batching, and trial cases made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QuestionGenerationError
from ..functions.text import ends_with_question_mark, question_key
from ..schemas import BATCH_QA, require


def valid_lengths(question: str = "question", answer: str = "answer", low: int = 10, high: int = 500, least_answer: int = 5, question_mark: bool = True) -> Column:
    ok = F.char_length(question).between(low, high) & (F.char_length(answer) >= least_answer)
    return ok & ends_with_question_mark(question) if question_mark else ok


def validate_pairs(pairs: DataFrame, node: str = "node_id", position: str = "pos", **rules) -> DataFrame:
    """Pairs in long form that keep the rules; of equal questions (by case and outer blanks) of a node, the first."""
    w = Window.partitionBy(node, question_key("question")).orderBy(position)
    return pairs.where(valid_lengths(**rules)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def validate_array(pairs: Column, low: int = 10, high: int = 500, least_answer: int = 5, question_mark: bool = True) -> Column:
    """The same for an array column, within the row: no shuffle."""
    good = F.filter(pairs, lambda p: F.char_length(p.question).between(low, high) & (F.char_length(p.answer) >= least_answer) & (ends_with_question_mark(p.question) if question_mark else F.lit(True)))
    keys = F.transform(good, lambda p: question_key(p.question))
    return F.filter(good, lambda p, i: F.array_position(keys, question_key(p.question)) == i + 1)


def batches(nodes: DataFrame, size: int, order: str, within: str | None = None) -> DataFrame:
    """Nodes with batch_id and chunk_id (from 1), ``size`` at a time in order, the last one partial.

    Give ``within`` (such as source_id) for large inputs: batches are then made within each of its values, and
    numbering is not a window over all rows.
    """
    w = Window.partitionBy(within).orderBy(order) if within else Window.orderBy(order)
    n = F.row_number().over(w) - 1
    return nodes.withColumn("batch_id", F.floor(n / size).cast("long")).withColumn("chunk_id", (n % size + 1).cast("int"))


def parse_batch(raw: str, strict: bool = True) -> Column:
    """A generator's reply as ``BATCH_QA``; a reply that isn't such JSON stops the job, or is null unless ``strict``."""
    value = F.from_json(raw, BATCH_QA, {"mode": "PERMISSIVE"})
    ok = F.try_parse_json(raw).isNotNull() & value.chunks.isNotNull()
    return F.when(ok, value).otherwise(F.raise_error(F.lit("a reply is not the JSON that was asked for")).cast(BATCH_QA) if strict else F.lit(None).cast(BATCH_QA))


def attach(nodes: DataFrame, replies: DataFrame, num_questions: int = 3, validation: bool = True, generated_at: Column | None = None, model: str | None = None, **rules) -> DataFrame:
    """Nodes (with batch_id, chunk_id) with ``synthetic_qa`` from replies (batch_id, reply).

    Chunk ids that no node has are ignored, of repeated ones the last counts, absent ones give no pairs.
    """
    chunks = replies.select("batch_id", F.posexplode(parse_batch("reply").chunks).alias("_p", "_c"))
    last = chunks.groupBy("batch_id", F.col("_c.chunk_id").alias("chunk_id")).agg(F.max_by("_c.qa_pairs", "_p").alias("_pairs"))
    joined = nodes.join(last, ["batch_id", "chunk_id"], "left")
    when = generated_at.cast("string") if generated_at is not None else F.lit(None).cast("string")
    pairs = F.coalesce(F.slice(F.col("_pairs"), 1, num_questions), F.array().cast("array<struct<question:string,answer:string,confidence:double>>"))
    pairs = validate_array(pairs, **rules) if validation else pairs
    pairs = F.transform(pairs, lambda p: F.struct(p.question.alias("question"), p.answer.alias("answer"), p.confidence.alias("confidence"), when.alias("generated_at")))
    qa = F.struct(pairs.alias("qa_pairs"), when.alias("generated_at"), F.lit(model).cast("string").alias("model"), F.lit(num_questions).alias("num_questions_requested"), F.size(pairs).alias("num_questions_validated"), F.col("batch_id").cast("string").alias("batch_id"))
    return joined.withColumn("synthetic_qa", qa).drop("_pairs")


def to_trial_cases(nodes: DataFrame, excluded: set[str] | None = None, ground_truth_ids: bool = True) -> DataFrame:
    """A trial case for each pair; malformed pairs are skipped but keep their index. ``excluded`` metadata keys replace
    the default, and an empty set falls back to it."""
    gone = F.array(*map(F.lit, sorted(excluded or {"synthetic_qa"})))
    kept = F.map_filter("metadata", lambda k, v: ~F.array_contains(gone, k))
    rows = nodes.where(F.col("synthetic_qa").isNotNull()).select("node_id", "source_id", kept.alias("_m"), F.col("synthetic_qa").alias("_q"), F.posexplode("synthetic_qa.qa_pairs").alias("qa_index", "_p"))
    rows = rows.where(F.col("_p.question").isNotNull() & F.col("_p.answer").isNotNull())
    facts = {"source_node_id": "node_id", "source_id": "source_id", "qa_index": "qa_index", "model": "_q.model", "batch_id": "_q.batch_id", "confidence": "_p.confidence"}
    pairs = [x for k, c in facts.items() for x in (F.lit(k), F.col(c).cast("string"))]
    meta = F.create_map(*pairs, F.lit("generated_at"), F.coalesce("_p.generated_at", "_q.generated_at"), F.lit("source_metadata"), F.when(F.size("_m") > 0, F.to_json("_m")))
    return rows.select(
        F.sha2(F.concat_ws(":", "node_id", F.col("qa_index").cast("string")), 256).alias("case_id"),
        F.col("_p.question").alias("question"),
        F.col("_p.answer").alias("ground_truth_answer"),
        (F.array("node_id") if ground_truth_ids else F.lit(None).cast("array<string>")).alias("ground_truth_node_ids"),
        F.map_filter(meta, lambda k, v: v.isNotNull()).alias("metadata"),
    )


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, pos, question, answer: each user turn with the assistant turn that follows it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("_r", F.lead("role").over(w)).withColumn("_t", F.lead("text").over(w))
    return rows.where("role = 'user' AND _r = 'assistant'").select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("question"), F.col("_t").alias("answer"))


def generation_counts(nodes: DataFrame) -> DataFrame:
    q = F.col("synthetic_qa")
    return nodes.agg(F.count("*").alias("nodes"), F.sum(q.num_questions_requested).alias("requested"), F.sum(q.num_questions_validated).alias("validated"))


def fail_on_bad_reply(replies: DataFrame) -> DataFrame:
    return require(replies, F.try_parse_json("reply").isNotNull(), QuestionGenerationError.__name__)
