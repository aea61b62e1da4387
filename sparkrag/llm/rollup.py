"""Token counts as delta-maintained rollups.

A ``Rollup`` lives in a folder of the shared store. Each batch of signed changes is summed by source, language and
tokenizer version before anything is kept, so a batch costs one aggregation (combined before its shuffle) and leaves a
handful of rows; totals are the sum of the committed batches.

Commits are a log of numbered files, ``log/<version>.json``, each created whole or not at all, and only if no other
driver has taken its number: then the commit is checked against the new state and tried again under the next number. A
version adds one batch, or is a snapshot that ``compact`` wrote: all batch names with their digests, and the tables that
hold their sum. A reader replays the versions from the last snapshot on, so at each moment it sees each batch once:
either in its own table or in the base, never in both. A batch that is sent again, or that a lost driver left half done,
changes nothing or starts anew; tables that no version names are never read.

Changes are rows (op, source, lang, tokenizer, tokens, n_chars) with op insert or delete; ``revised`` makes both from
rows that hold old and new values. Fixed results: null source or language form groups of their own; null counts are
zero; an unknown op fails the batch before it is committed; groups whose counts all return to zero vanish from the
totals; repeated rows count each; an empty batch is committed and changes nothing; further columns are ignored. The
same batch name with other content is an error, as nothing tells which one is right; a batch may have any name, also
one with "/"; of two drivers that send a batch at once, one commits it. Texts of any length are counted whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, open_fs, release, text_steps, work_dir, write_file
from .sstable import encoder, tokenizer_path

GROUP = ["source", "lang", "tokenizer"]
MEASURES = ["docs", "tokens", "chars"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, chars long"


def words_v1(text: str) -> Column:
    """Blank-separated words."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def words_v2(text: str) -> Column:
    """Runs of letters, digits and non-ASCII characters."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")).cast("long")


def vocabulary_tokens(text: str, vocabulary: str = "byte_bpe_50k.json") -> Column:
    """Tokens by a vocabulary file of the tokenizers library, added tokens included, without an end token."""
    path = tokenizer_path(vocabulary)

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                parts = [encoder(path, True).encode(data, offsets)[1] for _, _, data, offsets in text_steps(pa.record_batch([texts], names=["text"]), "text")]
                yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        finally:
            release()

    return F.arrow_udf(count, "long")(F.col(text).cast("string"))


#: Tokenizer versions that SQL can count as well. ``vocabulary_tokens`` makes others: {"byte-bpe-50k/1": vocabulary_tokens}.
TOKENIZERS = {"blank-words/1": words_v1, "letter-words/2": words_v2}


def put_new(spark: SparkSession, uri: str, data: bytes) -> bool:
    """Create a file whole, unless it is there already (False): atomic on local and on HDFS-like stores."""
    where, path = open_fs(uri)
    own = f"{uri}.{os.urandom(6).hex()}.new"
    write_file(own, data)
    if "://" not in uri or uri.startswith("file:"):
        own = open_fs(own)[1]
        try:
            os.link(own, path)  # unlike a rename, fails if the name is taken
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(uri).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.rename(hadoop.Path(own), hadoop.Path(uri)):  # refuses a name that is taken
        return True
    files.delete(hadoop.Path(own), False)
    return False


def revised(rows: DataFrame) -> DataFrame:
    """Changes that replace old_source, old_lang, old_tokens, old_n_chars (of one tokenizer) by the new values."""
    old = rows.select(F.lit("delete").alias("op"), F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), "tokenizer", F.col("old_tokens").alias("tokens"), F.col("old_n_chars").alias("n_chars"))
    return old.unionByName(rows.select(F.lit("insert").alias("op"), "source", "lang", "tokenizer", "tokens", "n_chars"))


class Rollup:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _state(self) -> tuple[int, dict[str, dict], list[str]]:
        """(last version, committed batches by name, tables whose sum the totals are)."""
        from pyarrow import fs

        where, path = open_fs(f"{self.folder}/log")
        files = sorted((int(f.base_name[:-5]), f.path) for f in where.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.base_name[:-5].isdigit() and f.base_name.endswith(".json"))
        after: list[dict] = []
        batches, tables = {}, []
        for _, file in reversed(files):
            with where.open_input_stream(file) as f:
                entry = json.loads(f.read())
            if "tables" in entry:
                batches, tables = entry["batches"], entry["tables"]
                break
            after.append(entry)
        for entry in reversed(after):
            batches[entry["batch"]] = {k: entry[k] for k in ("changes", "digest")}
            tables.append(entry["table"])
        return files[-1][0] if files else 0, batches, tables

    def _put(self, version: int, entry: dict) -> bool:
        return put_new(self.spark, f"{self.folder}/log/{version:020d}.json", json.dumps(entry).encode())

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch; False if it had been committed before."""
        sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(F.raise_error(F.concat(F.lit("no such op: "), F.coalesce("op", F.lit("null")))).cast("int"))
        signed = changes.select(*GROUP, sign.alias("sign"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
        sums = signed.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"), F.sum(F.col("sign") * F.col("n_chars")).cast("long").alias("chars"), F.count("*").alias("changes"))
        data = work_dir(self.spark, "delta").rpartition("/")[2]
        sums.write.parquet(f"{self.folder}/{data}")
        rows = self.spark.read.schema(SCHEMA + ", changes long").parquet(f"{self.folder}/{data}")
        n, digest = rows.agg(F.coalesce(F.sum("changes"), F.lit(0)), F.coalesce(F.sum(F.xxhash64(*GROUP, *MEASURES, "changes").cast("decimal(38,0)")), F.lit(0))).first()
        own = {"changes": int(n), "digest": str(digest)}
        while True:
            version, batches, _ = self._state()
            if batch in batches:
                if batches[batch] != own:
                    raise ValueError(f"batch {batch} was committed with other changes")
                return False
            if self._put(version + 1, {"batch": batch, "table": data, **own}):
                return True

    def totals(self) -> DataFrame:
        return self._sum(self._state()[2])

    def _sum(self, tables: list[str]) -> DataFrame:
        if not tables:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.folder}/{t}" for t in tables)).groupBy(*GROUP).agg(*(F.sum(m).cast("long").alias(m) for m in MEASURES))
        return rows.where(" OR ".join(f"{m} <> 0" for m in MEASURES))

    def compact(self) -> None:
        """Fold the batches into one table; names and digests stay known. One new version names the table in their place."""
        _, _, folded = self._state()
        if len(folded) < 2:
            return
        base = work_dir(self.spark, "base").rpartition("/")[2]
        self._sum(folded).coalesce(1).write.parquet(f"{self.folder}/{base}")
        while True:  # batches that others commit meanwhile stay tables of their own
            version, batches, tables = self._state()
            if not set(folded) <= set(tables):
                return  # another driver has folded them
            if self._put(version + 1, {"batches": batches, "tables": [base, *(t for t in tables if t not in folded)]}):
                return


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents, count them with a second tokenizer, quarantine bad ones, delete toxic ones, send a batch twice."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    counted = cut(spark, docs.select("doc_id", "source", "lang", "n_chars", *(f("text").alias(f"t{i}") for i, f in enumerate(TOKENIZERS.values()))), "counted")
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))

    def changes(rows: DataFrame, op: str, *which: int) -> DataFrame:
        names = list(TOKENIZERS)
        pairs = F.array(*(F.struct(F.lit(names[i]).alias("tokenizer"), F.col(f"t{i}").alias("tokens")) for i in which))
        return rows.select(F.lit(op).alias("op"), "source", "lang", "n_chars", F.inline(pairs))

    rollup = Rollup(spark, work_dir(spark, "rollup"))
    marked = counted.join(labels, "doc_id")
    rollup.apply("load", changes(counted, "insert", 0))
    rollup.apply("second-tokenizer", changes(counted, "insert", 1))
    bad = marked.where("quality = 0 AND coalesce(toxic, 0) = 0")
    moved = bad.select(F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.col("t0").alias("old_tokens"), F.col("n_chars").alias("old_n_chars"), F.lit("quarantine").alias("source"), "lang", F.lit(next(iter(TOKENIZERS))).alias("tokenizer"), F.col("t1").alias("tokens"), "n_chars")
    rollup.apply("quarantine", revised(moved))
    rollup.apply("remove-toxic", changes(marked.where("toxic = 1"), "delete", 0, 1))
    rollup.apply("load", changes(counted, "insert", 0))
    rollup.compact()
    return rollup.totals()


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, lang, n_chars, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS t0,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t1 FROM documents),
l AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
m AS (SELECT d.*, quality, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN l USING (doc_id)),
r AS (SELECT CASE WHEN quality = 0 AND toxic = 0 THEN 'quarantine' ELSE source END AS source, lang, 'blank-words/1' AS tokenizer,
             CASE WHEN quality = 0 AND toxic = 0 THEN t1 ELSE t0 END AS t, n_chars FROM m WHERE toxic <> 1
      UNION ALL SELECT source, lang, 'letter-words/2', t1, n_chars FROM m WHERE toxic <> 1)
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(n_chars) AS BIGINT) AS chars
FROM r GROUP BY ALL
"""
