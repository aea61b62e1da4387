"""JSON and JSON-lines in and out; trial cases."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TRIAL_CASES, require, valid_trial_case


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON: an array of objects, or a single object as one row."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An object a line; blank lines are skipped, a bad one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One pretty array. Rows pass the driver one partition at a time, for files that people read."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("w", encoding="utf-8") as out:
        out.write("[")
        for i, row in enumerate(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
            text = json.dumps(json.loads(row.j), indent=2, ensure_ascii=False)
            out.write(("," if i else "") + "\n  " + text.replace("\n", "\n  "))
        out.write("\n]\n")


def write_jsonl(df: DataFrame, path: str, order_by: list[str] | None = None) -> None:
    """A folder of JSON-lines files; with ``order_by``, the files in the order of their names are sorted as a whole."""
    (df.orderBy(*order_by) if order_by else df).write.mode("overwrite").json(path)


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Trial cases from .json or .jsonl; a case without question or ground truth fails the read."""
    if not path.endswith((".json", ".jsonl")):
        raise ValueError(f"trial cases come from .json or .jsonl, not from {path}")
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    rows = (read_jsonl if path.endswith(".jsonl") else read_json)(spark, path, TRIAL_CASES)
    rows = rows.withColumn("case_id", F.coalesce("case_id", F.sha2(F.col("question"), 256)))
    return require(rows, valid_trial_case(), "a trial case needs a question and a ground truth")


def read_yaml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small YAML list, parsed on the driver."""
    from ..config import _yaml

    data = _yaml().safe_load(Path(path).read_text(encoding="utf-8")) or []
    return spark.createDataFrame(data if isinstance(data, list) else [data], schema)


def write_yaml(df: DataFrame, path: str) -> None:
    """A small YAML list, for files that people read."""
    from ..config import _yaml

    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    rows = [json.loads(r.j) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()]
    target.write_text(_yaml().safe_dump(rows, sort_keys=False, allow_unicode=True), encoding="utf-8")
