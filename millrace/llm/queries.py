"""The operators applied to their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import DIGEST_DDL, digest, remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), finish=digest, finish_ddl=DIGEST_DDL)


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_vectors import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_texts import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import through_files

    return through_files(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import default_list, judge

    return judge(_table(spark, sf_dir, "pages"), default_list(spark))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import DIGESTS, digest_sink, find_pii

    return find_pii(_table(spark, sf_dir, "documents"), sink=digest_sink, sink_schema=DIGESTS)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepieces import DIGESTS, digest_sink, encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), sink=digest_sink, sink_schema=DIGESTS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_repeats, op2_near_vectors, op3_quality_rules, op4_near_texts, op5_html_text, op6_token_files, op7_mixing,
        op8_url_filter, op9_pii, op10_sentencepiece
    )}
