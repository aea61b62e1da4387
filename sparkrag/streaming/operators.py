"""Structured Streaming forms of the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import non_blank
from ..operators import chunk


def chunks(docs: DataFrame, size: int = 256, overlap: int = 64, **columns: str) -> DataFrame:
    """Token windows of a stream of documents: a narrow map, no state."""
    return chunk.token_windows(docs.where(non_blank(columns.get("content", "content"))), size, overlap, **columns)


def dedup_by_content(docs: DataFrame, content: str = "text", watermark: tuple[str, str] | None = None) -> DataFrame:
    """First row of each content hash; with a watermark (column, delay), state older than it is dropped."""
    hashed = docs.withColumn("content_hash", F.sha2(content, 256))
    if watermark:
        return hashed.withWatermark(*watermark).dropDuplicatesWithinWatermark(["content_hash"])
    return hashed.dropDuplicates(["content_hash"])


def stage_windows(events: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes", ts: str = "ts", stage: str = "event_type", value: str = "value") -> DataFrame:
    """Stage timings by event-time window; a window is final once the watermark has passed it."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    sums = events.withWatermark(ts, delay).groupBy(w, stage).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return sums.select(F.col("window.start").alias("window_start"), stage, "n", "total", "least", "most")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", ts: str = "ts", user: str = "user_id") -> DataFrame:
    s = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), user, "n")


def last_access(events: DataFrame, key: str = "user_id", ts: str = "ts", idle_ms: int = 0) -> DataFrame:
    """Latest access of each key, updated as events arrive: a streaming aggregation. Only with ``idle_ms``, by which keys that
    stay silent so long are forgotten, it needs state of its own."""
    if not idle_ms:
        return events.groupBy(key).agg(F.max(F.unix_micros(ts)).alias("last_us"), F.count("*").alias("n"))

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        latest, n = state.get if state.exists else (0, 0)
        for f in frames:
            latest, n = max(latest, int(f["_us"].max())), n + len(f)
        state.update((latest, n))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: [k[0]], "last_us": [latest], "n": [n]})

    rows = events.select(key, F.unix_micros(ts).alias("_us"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, last_us long, n long", "last_us long, n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def run_to_end(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process all that is there (trigger availableNow) into Parquet below ``folder`` and read it back.

    The checkpoint lies beside the output, so a run that was cut short goes on where it was; modes other than append
    keep each batch's rows, in their order, and the last batch that has a key counts.
    """
    spark, out = df.sparkSession, f"{folder}/out"
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", out)
    else:

        def put(batch: DataFrame, number: int) -> None:
            batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/b={number}")

        query = df.writeStream.foreachBatch(put)
    q = query.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    if mode == "append":
        return spark.read.schema(df.schema).parquet(out)
    return spark.read.option("basePath", out).parquet(f"{out}/b=*").drop("b")
