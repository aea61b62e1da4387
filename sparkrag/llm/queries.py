"""The thin queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, decontaminate, jaccard, licenses, mixing, pitman_yor, quality, rollup, sstable, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_rollups": rollup.op1_query,
    "op2_pitman_yor_scores": pitman_yor.op2_query,
    "op3_quality_nnpu": quality.op3_query,
    "op4_benchmark_decontamination": decontaminate.op4_query,
    "op5_parity_sketch_join": jaccard.op5_query,
    "op6_license_scan": licenses.op6_query,
    "op7_temperature_mixing": mixing.op7_query,
    "op8_sstable_shards": sstable.op8_query,
    "op9_warc_source": warc.op9_query,
    "op10_audio_features": audio.op10_query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_token_rollups": rollup.OP1_SQL,
    "op4_benchmark_decontamination": decontaminate.OP4_SQL,
    "op7_temperature_mixing": mixing.OP7_SQL,
    "op9_warc_source": warc.OP9_SQL,
}
