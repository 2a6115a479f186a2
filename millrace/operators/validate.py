"""Statistics that describe a corpus, mergeable over shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def length_statistics(docs: DataFrame, group: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Documents, UTF-8 bytes and characters: numbers, means and population deviations."""
    sized = docs.select(*group, F.octet_length(text).cast("long").alias("bytes"), F.length(text).cast("long").alias("chars"))
    aggregates = [
        F.count(F.lit(1)).alias("docs"), F.sum("bytes").alias("total_bytes"), F.avg("bytes").alias("mean_bytes"),
        F.stddev_pop("bytes").alias("std_bytes"), F.avg("chars").alias("mean_chars")
    ]
    return sized.groupBy(*group).agg(*aggregates)


def pooled(parts: DataFrame, n: str, mean: str, std: str) -> DataFrame:
    """One row of ``n, mean, std`` from rows of the same, one a shard."""
    total = F.sum(n)
    overall = F.sum(F.col(n) * F.col(mean)) / total
    variance = F.sum(F.col(n) * (F.col(std) * F.col(std) + F.col(mean) * F.col(mean))) / total - overall * overall
    return parts.agg(total.alias("n"), overall.alias("mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std"))


def required_fields(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``field, missing``: rows whose required field is null, or all rows where there is no such column."""
    rows = docs.agg(F.count(F.lit(1)).alias("all"), *(F.count(F.when(
        F.col(c).isNull(), 1
    )).alias(f"m_{c}") if c in docs.columns else F.count(F.lit(1)).alias(f"m_{c}") for c in fields))
    return rows.select(F.explode(F.array(*(F.struct(
        F.lit(c).alias("field"), F.col(f"m_{c}").alias("missing")
    ) for c in fields))).alias("r")).select("r.field", "r.missing")


def corpus_size(tokens: DataFrame, n_tokens: str, length: int, group: Sequence[str] = ()) -> DataFrame:
    """Documents, tokens, full sequences, and the share of tokens that cutting to ``length`` would drop."""
    cut = F.sum(F.greatest(F.col(n_tokens) - length, F.lit(0)))
    return tokens.groupBy(*group).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(n_tokens).alias("tokens"),
        F.floor(F.sum(n_tokens) / length).cast("long").alias("sequences"), (cut / F.sum(n_tokens)).alias("truncated")
    )


def summary(frame: DataFrame, groups: Sequence[str], shard: Column | None = None) -> DataFrame:
    """``groups, rows, shards``: rows and shards of every combination, with subtotals whose groups are null. ``shard`` names
    the shard of a row, by default its file."""
    own = frame.select(*groups, (F.input_file_name() if shard is None else shard).alias("__shard"))
    return own.rollup(*groups).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("__shard").alias("shards"))


def corpus_shares(sizes: DataFrame, tokens: str, sequences: str, length: int) -> DataFrame:
    """Adds to a row a corpus ``padding``, the share of its last sequence that stays empty if none is dropped, ``weight``, its
    share of all tokens, and ``epoch_tokens``, the tokens that full sequences hold."""
    every = Window.partitionBy(F.lit(0))  # a row a corpus
    used = F.ceil(F.col(tokens) / length) * length
    padding = F.when(F.col(tokens) > 0, (used - F.col(tokens)) / used).otherwise(0.0)
    return sizes.withColumns({"padding": padding, "weight": F.col(tokens) / F.sum(tokens).over(every), "epoch_tokens": F.col(sequences) * length})
