"""A training corpus from raw documents, in five stages.

Each stage takes and returns the columns of ``documents``, the last one token ids. Between
stages the rows are written as Parquet into the folder that all executors share, and read
again, so that a lost executor costs part of one stage.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.llm import mixing, near_texts, pii, quality, sentencepieces
from millrace.operators.durable import drop_folder, shared_folder

#: Stages on word shingles take five words and a similarity of 0.8.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    A null or empty text has no words and goes; rows that repeat an id are judged each by its
    own text; a null language or id is allowed; a folder whose labels are empty learns no cutoffs.
    """
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays.

    Texts without words and rows without an id are in no group and stay; rows that repeat an id
    but not its text are documents of their own; of rows that repeat both one stays.
    """
    return near_texts.one_of_each(docs, width=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become placeholders; no row goes, a null text stays null, and rows are independent."""
    return pii.redacted_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, twice at most.

    Texts without words are not taken; a null source is a source; rows equal in id, text and
    source are taken together.
    """
    return mixing.mixed_documents(docs)


def _ids_and_digests(*batch) -> list[pa.Array]:
    return [sentencepieces.pieces_sink(*batch)[0], *sentencepieces.digest_sink(*batch)]


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of them and of the decoded text.

    A null text counts as empty and has no ids; each row is encoded by itself, repeated ones
    too; columns other than the id and the text are left out.
    """
    import public_tokenizers

    schema = T.StructType([sentencepieces.PIECES["ids"], *sentencepieces.DIGESTS.fields])
    return sentencepieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), sink=_ids_and_digests, sink_schema=schema)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("pii", redact), ("mixing", mix), ("sentencepiece", encode)]

#: Near-duplicates and tokenizers are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents in ``sf_dir``."""
    folder = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:  # what this stage read is read no more
            drop_folder(spark, f"{folder}/{number - 1}-{STAGES[number - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
