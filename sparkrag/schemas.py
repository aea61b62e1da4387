"""Row types as Spark schemas, and their validity rules as boolean columns.

Nothing is inferred from data. Rows that break a rule are split off (``operators.ingest.quarantine``) or stop the job
(``require``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import non_blank

POSITION = "struct<start_char:int,end_char:int,page:int,section:string>"
QA_PAIR = "struct<question:string,answer:string,confidence:double,generated_at:string>"
SYNTHETIC_QA = f"struct<qa_pairs:array<{QA_PAIR}>,generated_at:string,model:string,num_questions_requested:int,num_questions_validated:int,batch_id:string>"
USAGE = "struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>"

SOURCE_DOCS = "source_id string, content string, metadata map<string,string>, mime_type string, page_count int"
NODES = f"node_id string, source_id string, content string, metadata map<string,string>, position {POSITION}, dense_vector array<float>, sparse_vector map<bigint,double>"
RETRIEVED = "query_id string, node_id string, score double, rank int"
TRIAL_CASES = "case_id string, question string, ground_truth_answer string, ground_truth_node_ids array<string>, metadata map<string,string>"
GENERATION_RESULT = f"struct<text:string,usage:{USAGE},finish_reason:string>"
CASE_RESULTS = f"case_id string, predicted_answer string, query string, retrieved_ids array<string>, reranked boolean, generation_result {GENERATION_RESULT}"
BATCH_QA = "struct<chunks:array<struct<chunk_id:int,qa_pairs:array<struct<question:string,answer:string,confidence:double>>>>>"
FINISH_REASONS = ("stop", "length", "error")


def valid_source_doc() -> Column:
    return non_blank("content")


def valid_position(column: str = "position") -> Column:
    p = F.col(column)
    return p.isNull() | ((p.start_char >= 0) & (p.end_char > p.start_char) & F.coalesce(p.page >= 1, F.lit(True)))


def valid_node() -> Column:
    return non_blank("content") & valid_position()


def valid_qa_pair(pair: Column) -> Column:
    """Question of 10 to 500 characters, answer of 5 to 1000, confidence absent or within 0 and 1."""
    return F.char_length(pair.question).between(10, 500) & F.char_length(pair.answer).between(5, 1000) & F.coalesce(pair.confidence.between(0, 1), F.lit(True))


def valid_trial_case() -> Column:
    """A question that isn't blank, and at least one kind of ground truth."""
    return non_blank("question") & (F.col("ground_truth_answer").isNotNull() | F.col("ground_truth_node_ids").isNotNull())


def valid_generation(column: str = "generation_result") -> Column:
    g = F.col(column)
    counts = [g.usage.prompt_tokens, g.usage.completion_tokens, g.usage.total_tokens]
    ok = g.finish_reason.isin(*FINISH_REASONS)
    for c in counts:
        ok = ok & (c >= 0)
    return g.isNull() | ok


def valid_retrieved() -> Column:
    return F.col("rank") >= 1


def require(df: DataFrame, rule: Column, message: str) -> DataFrame:
    """``df``, whose evaluation fails at the first row that breaks the rule; null counts as broken."""
    return df.where(F.when(F.coalesce(rule, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
