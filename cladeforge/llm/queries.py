"""The operators' queries and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ball_kmeans, divergence, fingerprint, mixing, ngram_join, packing, pii, quality, sentencepiece_codec, sharding, suffix_dedup, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.op1,
        "op2_sharding": sharding.op2,
        "op3_toxicity": toxicity.op3,
        "op4_ngram_join": ngram_join.op4,
        "op5_sentencepiece": sentencepiece_codec.op5,
        "op6_quality": quality.op6,
        "op7_mixing": mixing.op7,
        "op8_urls": urls.op8,
        "op9_suffix_dedup": suffix_dedup.op9,
        "op10_fingerprint": fingerprint.op10,
        "op11_packing": packing.op11,
        "op12_ball_kmeans": ball_kmeans.op12,
        "op13_divergence": divergence.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pii": pii.OP1_SQL,
        "op2_sharding": sharding.OP2_SQL,
        "op4_ngram_join": ngram_join.OP4_SQL,
        "op6_quality": quality.OP6_SQL,
        "op7_mixing": mixing.OP7_SQL,
        "op12_ball_kmeans": ball_kmeans.OP12_SQL,
        "op13_divergence": divergence.OP13_SQL,
    }
