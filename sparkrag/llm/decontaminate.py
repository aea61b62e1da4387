"""Benchmark decontamination with DataFrame functions only.

The windows of all benchmark items (``WINDOW`` consecutive normalised words, or a whole shorter item) are hashed; the
set of hashes travels to every task inside the plan, as one hash set, if it has at most ``MOST_WINDOWS`` entries. A
document's words are scanned once: each of its windows is hashed and looked up in that set where it stands, without
exploding or shuffling the text. Only windows that hit leave the scan; they are verified by their words against the
windows of the items. A larger benchmark takes the other way: hashes of the documents' windows (never their words) meet
those of the items in a shuffled semi-join, and only documents with a hit are read again for the words at the positions
that hit, which are verified as before. Both ways give the same rows.

Fixed results: null texts and texts without words have no window, so they are clean; rows that repeat a doc_id are
judged each by their own text (equal rows alike); items that share a window all count; an empty benchmark or table
leaves everything clean; further columns are kept by ``remove`` and ignored by ``scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

WINDOW = 10
#: Entries of the hash set that is sent to the tasks (8 bytes each); above this the join is shuffled.
MOST_WINDOWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """Lower-cased (A-Z) words of a text column; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def _windows(array: str, n: int, make) -> Column:
    """make(position, words of the window) for each window of ``n`` words; positions count from 1."""
    last = F.size(array) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: make(i, F.slice(F.col(array), i, n)))).otherwise(F.array())


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, n, win, h): distinct windows of each item, as words joined by blanks."""
    rows = benchmark.select(F.col(id_col).alias("item"), words(text_col).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    last = F.size("w") - n + 1
    rows = rows.select("item", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice(F.col("w"), i, n))).alias("s"))
    return rows.select("item", "n", F.array_join("s", " ").alias("win"), F.xxhash64("s").alias("h")).distinct()


def _hits(docs: DataFrame, wins: DataFrame, most: int) -> tuple[DataFrame, DataFrame, bool]:
    """(documents as doc_id, key, n_words; hits as doc_id, key, pos, n, win; whether the windows are few)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), words("text").alias("w"))
    shapes = wins.groupBy("n").agg(F.count_distinct("h").alias("c")).collect()  # at most one row for each length
    lengths = sorted(r.n for r in shapes)
    few = sum(r.c for r in shapes) <= most
    if few:
        known = {n: [r.h for r in wins.where(F.col("n") == n).select("h").distinct().collect()] for n in lengths}

        def found(n: int) -> Column:
            listed = ",".join(f"{h}L" if h >= 0 else f"({h}L)" for h in known[n]).replace("(-9223372036854775808L)", "long('-9223372036854775808')")
            last = f"size(w) - {n - 1}"
            at = f"filter(sequence(1, {last}), i -> xxhash64(slice(w, i, {n})) IN ({listed}))"
            return F.expr(f"if({last} >= 1, transform({at}, i -> named_struct('pos', i, 'n', {n}, 'win', array_join(slice(w, i, {n}), ' '))), array())")

        hits = F.concat(*(found(n) for n in lengths)) if lengths else F.expr("CAST(array() AS array<struct<pos:int,n:int,win:string>>)")
        scanned = cut(spark, rows.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), hits.alias("hits")), "scanned")
        return scanned.drop("hits"), scanned.where(F.size("hits") > 0).select("doc_id", "key", F.inline("hits")), True
    every = F.concat(*(_windows("w", n, lambda i, s, n=n: F.struct(i.alias("pos"), F.lit(n).alias("n"), F.xxhash64(s).alias("h"))) for n in lengths))
    near = rows.select("doc_id", "key", F.inline(every)).join(wins.select("n", "h").distinct(), ["n", "h"], "left_semi")
    places = near.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_set(F.struct("pos", "n")).alias("_places"))
    places = cut(spark, places, "places")
    # rows of one id and one text have the same hits, so one of them is enough
    met = rows.join(places, rows["doc_id"].eqNullSafe(places["_id"]) & (rows["key"] == places["_key"])).dropDuplicates(["doc_id", "key"])
    words_at = F.transform("_places", lambda p: F.struct(p.pos.alias("pos"), p.n.alias("n"), F.array_join(F.slice(F.col("w"), p.pos, p.n), " ").alias("win")))
    return rows.select("doc_id", "key", F.size("w").cast("long").alias("n_words")), met.select("doc_id", "key", F.inline(words_at)), False


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MOST_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, key (hash of its text), n_words, hit positions (from 1) and items that occur in it."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    wins = cut(docs.sparkSession, item_windows(benchmark, window), "windows")
    base, hits, few = _hits(docs, wins, most)
    items = wins.groupBy("win").agg(F.collect_set("item").alias("items")).withColumnRenamed("win", "known")
    joined = hits.join(F.broadcast(items) if few else items, hits["win"] == items["known"])
    rows = joined.groupBy("doc_id", "key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("pos", F.col("pos") + F.col("n") - 1))))).alias("positions"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    rows = rows.withColumnsRenamed({"doc_id": "hit_id", "key": "hit_key"})
    out = base.join(rows, base["doc_id"].eqNullSafe(rows["hit_id"]) & (base["key"] == rows["hit_key"]), "left")
    return out.select("doc_id", "key", "n_words", F.coalesce("positions", F.expr("CAST(array() AS array<int>)")).alias("positions"), F.coalesce("items", F.expr("CAST(array() AS array<bigint>)")).alias("items"))


def remove(docs: DataFrame, benchmark: DataFrame, spans: bool = False, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents or, for ``spans``, without the words that lie in hits.

    A word goes with what stands between it and the next one; a document that nothing is left of stays, with an empty text.
    """
    hit = scan(docs, benchmark, id_col=id_col, text_col=text_col, **options).where(F.size("positions") > 0)
    hit = hit.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("positions").alias("_positions")).dropDuplicates(["_id", "_key"])
    same = docs[id_col].eqNullSafe(hit["_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == hit["_key"])
    if not spans:
        return docs.join(hit, same, "left_anti")
    between = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # the same in a text with capitals
    lead = F.regexp_extract(text_col, f"^[{between}]*", 0)
    piece = F.regexp_extract_all(F.col(text_col), F.lit(f"[^{between}]+[{between}]*"), F.lit(0))
    rest = F.concat(lead, F.array_join(F.filter(piece, lambda x, i: ~F.array_contains(F.col("_positions"), i + 1)), ""))
    joined = docs.join(hit, same, "left")
    return joined.select(*(F.when(F.col("_id").isNotNull() | F.col("_key").isNotNull(), rest).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns))


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", F.size("positions").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("positions") > 0).alias("contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, iw.n FROM dw JOIN iw USING (win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_distinct(list(item_id::VARCHAR)) AS l FROM hit GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(list_sort(l), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
