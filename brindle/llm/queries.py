"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, language_id, mixing, ngram_join, pii, quality_model, quality_rules, sentencepiece_codec, sharding, substring_dedup
from .common import documents, labels


def piece_model() -> str:
    """The path of the public vocabulary; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_personal_data": lambda spark, d: pii.find_personal_data(documents(spark, d)),
        "op2_mix_sources": lambda spark, d: mixing.mix_sources(documents(spark, d)).drop("copies", "part"),
        "op3_ngram_join": lambda spark, d: ngram_join.classes(documents(spark, d)),
        "op4_sentencepiece": lambda spark, d: sentencepiece_codec.encode_documents(documents(spark, d), piece_model()),
        "op5_quality_classifier": lambda spark, d: quality_model.score_documents(documents(spark, d), labels(spark, d)),
        "op6_quality_rules": lambda spark, d: quality_rules.judge(documents(spark, d)),
        "op7_sharding": lambda spark, d: sharding.shard_documents(documents(spark, d)),
        "op8_exact_dedup": lambda spark, d: exact_dedup.dedup_documents(documents(spark, d)),
        "op9_repeated_passages": lambda spark, d: substring_dedup.repeated_passages(documents(spark, d)),
        "op10_language_id": lambda spark, d: language_id.identify(documents(spark, d), piece_model()),
    }


def oracle_sql() -> dict[str, str]:
    from .sql import oracle_sql as told

    return told()
