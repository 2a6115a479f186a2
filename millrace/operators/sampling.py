"""Samples and splits by a hash of a seed and an id: the same rows in every run and engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: str, identifier: Column) -> Column:
    """A number in [0, 1) for an id, from 28 bits of md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), identifier.cast("string"))), 1, 7), 16, 10).cast("double") / F.lit(float(16**7))


def bernoulli(frame: DataFrame, rate: float, identifier: str, seed: str = "sample") -> DataFrame:
    """Each row with probability ``rate``."""
    return frame.where(draw(seed, F.col(identifier)) < rate)


def split(frame: DataFrame, rate: float, identifier: str, seed: str = "split", out: str = "part") -> DataFrame:
    """Adds ``validation`` with probability ``rate``, else ``train``."""
    return frame.withColumn(out, F.when(draw(seed, F.col(identifier)) < rate, "validation").otherwise("train"))


def reservoir(frame: DataFrame, k: int, identifier: str, group: Sequence[str] = (), seed: str = "reservoir") -> DataFrame:
    """A uniform sample of ``k`` rows of each group, or of all: those with the least hashes."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(identifier).cast("string")))
    if not group:
        return frame.orderBy(key, identifier).limit(k)
    ranked = frame.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy(key, identifier)))
    return ranked.where(F.col("__rank") <= k).drop("__rank")


def shuffled(frame: DataFrame, identifier: str, seed: str = "shuffle") -> DataFrame:
    """All rows in an order drawn by hash."""
    return frame.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(identifier).cast("string"))), identifier)
