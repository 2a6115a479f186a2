"""Decontamination: overlap of word n-grams or paragraphs with another collection, joined exactly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams, words
from .bloom import Bloom
from .dedup import paragraph_lines
from .durable import materialise, spread

#: Features of a reference collection up to this number are broadcast, some 64 MB; beyond it a filter goes before a shuffle.
MOST_BROADCAST_FEATURES = 1_000_000


def features(line: Column, n: int, stride: int = 0) -> Column:
    """The n-grams of a paragraph; one of fewer words is its own feature."""
    grams = ngrams(words(line), n, stride)
    return F.when(F.size(grams) > 0, grams).otherwise(F.array(line))


def paragraph_features(frame: DataFrame, identifier: str, text: str, n: int, stride: int = 0) -> DataFrame:
    """``id, begin, end, features``: the hashes of the features of each paragraph."""
    lines = paragraph_lines(frame, identifier, text)
    hashed = F.transform(features(F.col("line"), n, stride), F.md5)
    return lines.select(F.col(identifier).alias("id"), "begin", "end", hashed.alias("features"))


def feature_keys(frame: DataFrame, text: str, n: int, stride: int = 0) -> DataFrame:
    """The distinct hashes of a collection's features, as ``gram``."""
    lines = frame.where(F.col(text).isNotNull()).select(F.explode(F.split(text, "\n")).alias("line")).where("line <> ''")
    return lines.select(F.explode(features(F.col("line"), n, stride)).alias("g")).select(F.md5("g").alias("gram")).distinct()


def _hits(rows: DataFrame, known: DataFrame, count: int) -> DataFrame:
    """The rows whose ``gram`` is known; only those that a filter lets through are shuffled when known ones are many."""
    if count <= MOST_BROADCAST_FEATURES:
        return rows.join(F.broadcast(known), "gram")
    return Bloom.build(known, "gram", count).stored().ask(rows, "gram").where("may_contain").drop("may_contain").join(known, "gram")


def ngram_overlap(
    target: DataFrame, reference: DataFrame, n: int, target_id: str, target_text: str, reference_id: str,
    reference_text: str, stride: int = 0,
) -> DataFrame:
    """``id, begin, end, score``: paragraphs of ``target`` that share n-grams with ``reference``, and the share.

    A paragraph of fewer than ``n`` words is looked for whole among those of ``reference``.
    """
    known = materialise(feature_keys(reference, reference_text, n, stride))
    split = paragraph_features(spread(target.select(target_id, target_text)), target_id, target_text, n, stride)
    # The number of features goes along, so that features without a hit need not.
    rows = split.select("id", "begin", "end", F.size("features").alias("of"), F.explode("features").alias("gram"))
    scored = _hits(rows, known, known.count()).groupBy("id", "begin", "end", "of").agg(F.count(F.lit(1)).alias("hits"))
    return scored.select(F.col("id").alias(target_id), "begin", "end", (F.col("hits") / F.col("of")).alias("score"))


def exact_overlap(target: DataFrame, reference: DataFrame, target_id: str, target_text: str, reference_text: str) -> DataFrame:
    """``id, begin, end, score``: paragraphs of ``target`` that are a paragraph of ``reference``."""
    lines = reference.where(F.col(reference_text).isNotNull()).select(F.explode(F.split(reference_text, "\n")).alias("line"))
    known = materialise(lines.where("line <> ''").select(F.md5("line").alias("gram")).distinct())
    split = paragraph_lines(spread(target.select(target_id, target_text)), target_id, target_text)
    rows = split.select(F.col(target_id).alias("id"), "begin", "end", F.md5("line").alias("gram"))
    return _hits(rows, known, known.count()).select(F.col("id").alias(target_id), "begin", "end", F.lit(1.0).alias("score"))


def contamination_matrix(
    train: DataFrame, evaluation: DataFrame, n: int, train_group: str, eval_id: str, train_text: str, eval_text: str,
) -> DataFrame:
    """``train, overlapping, eval_size, fraction``: evaluation items that share an n-gram with each train set, and with any of them."""
    items = evaluation.where(F.col(eval_text).isNotNull()).select(F.col(eval_id).alias("item"), F.explode(F.split(eval_text, "\n")).alias("line"))
    items = materialise(items.select(
        "item", F.explode(ngrams(words(F.col("line")), n)).alias("g")
    ).select("item", F.md5("g").alias("gram")).distinct())
    known = materialise(items.select("gram").distinct())
    lines = spread(train.select(train_group, train_text)).where(F.col(train_text).isNotNull()).select(
        F.col(train_group).cast("string").alias("train"), F.explode(F.split(train_text, "\n")).alias("line")
    )
    # Only grams that the evaluation side has go on from the train side.
    grams = lines.select("train", F.explode(ngrams(words(F.col("line")), n)).alias("g")).select("train", F.md5("g").alias("gram"))
    hits = materialise(_hits(grams, known, known.count()).distinct().join(items, "gram").select("train", "item").distinct())
    size = evaluation.agg(F.count(F.lit(1)).alias("eval_size"))
    each = hits.groupBy("train").agg(F.count(F.lit(1)).alias("overlapping"))
    union = hits.agg(F.count_distinct("item").alias("overlapping")).select(F.lit("union").alias("train"), "overlapping")
    counted = each.unionByName(union).join(F.broadcast(size))  # one row
    return counted.select("train", "overlapping", "eval_size", (F.col("overlapping") / F.col("eval_size")).alias("fraction"))


def overlap_by_sizes(target: DataFrame, reference: DataFrame, sizes: Sequence[int], *columns: str) -> DataFrame:
    """``ngram_overlap`` for several n, with the n."""
    out = None
    for n in sizes:
        own = ngram_overlap(target, reference, n, *columns).withColumn("n", F.lit(n).cast("long"))
        out = own if out is None else out.unionByName(own)
    return out
