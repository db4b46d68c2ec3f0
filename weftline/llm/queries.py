"""Queries of the training-data operators over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import warc
from weftline.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op2_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op4_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.sharding import shards

    return shards(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.nearcopies import near_copies

    return near_copies(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_pii_boosting,
        op3_best_fit_packing,
        op4_secret_crf,
        op5_quality_rules,
        op6_sharding,
        op7_warc,
        op8_decontamination,
        op9_ngram_jaccard,
        op10_language_id,
    )
}
ORACLE_SQL: dict[str, str] = {"op7_warc": warc.ORACLE}
