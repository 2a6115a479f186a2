"""Filtering documents by attributes that other steps attached to them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import remove_spans


@dataclass(frozen=True)
class Threshold:
    """Keep rows whose value lies in ``[lower, upper]``, or outside with ``reverse``; or the best ``keep_fraction``."""

    column: str
    lower: float | None = None
    upper: float | None = None
    reverse: bool = False
    keep_fraction: float | None = None

    def __post_init__(self):
        if self.keep_fraction is not None and (self.lower is not None or self.upper is not None):
            raise ValueError("keep_fraction excludes lower and upper")
        if self.keep_fraction is not None and not 0 < self.keep_fraction < 1:
            raise ValueError("keep_fraction must lie between 0 and 1")

    def condition(self) -> Column:
        inside = F.lit(True)
        if self.lower is not None:
            inside = inside & (F.col(self.column) >= self.lower)
        if self.upper is not None:
            inside = inside & (F.col(self.column) <= self.upper)
        return ~inside if self.reverse else inside


def sketch_quantile(frame: DataFrame, column: str, q: float, accuracy: float = 0.01) -> float | None:
    """A quantile of a column within a relative ``accuracy``: values are counted in buckets that grow by a factor.

    Buckets are aggregated inside tasks before the shuffle and number a few thousand at most,
    whatever the number of rows: sketches of parts merge by adding counts.
    """
    gamma = (1 + accuracy) / (1 - accuracy)
    value = F.col(column).cast("double")
    size = F.ceil(F.ln(F.abs(value)) / math.log(gamma))
    bucketed = frame.where(value.isNotNull() & ~F.isnan(value)).select(
        F.signum(value).cast("int").alias("sign"), F.when(value != 0, size).alias("bucket")
    )
    counts = bucketed.groupBy("sign", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return None
    ordered = sorted(counts, key=lambda r: (r["sign"], (r["bucket"] or 0) * r["sign"]))
    rank, seen = q * (sum(r["n"] for r in ordered) - 1), 0
    for r in ordered:
        seen += r["n"]
        if seen > rank:
            return 0.0 if r["sign"] == 0 else r["sign"] * 2 * gamma ** r["bucket"] / (gamma + 1)
    return None


def quantile(frame: DataFrame, column: str, q: float, exact: bool = False) -> float | None:
    """The quantile of a column: from a mergeable sketch, or with ``exact`` the discrete one, which holds all distinct values in one task."""
    if not exact:
        return sketch_quantile(frame, column, q)
    return frame.agg(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})").alias("q")).first()["q"]


def keep(docs: DataFrame, attributes: DataFrame, thresholds: list[Threshold], identifier: str, exact: bool = False) -> DataFrame:
    """Documents with attributes that pass every threshold; documents without attributes go."""
    columns = [t.column for t in thresholds]
    one = attributes.select(identifier, *columns).groupBy(identifier).agg(*(F.max(c).alias(c) for c in columns))
    for t in thresholds:
        if t.keep_fraction is not None:
            t = Threshold(t.column, lower=quantile(one, t.column, 1 - t.keep_fraction, exact))
        one = one.where(t.condition())
    return docs.join(one.select(identifier), identifier, "left_semi")


def without_spans(docs: DataFrame, spans: DataFrame, identifier: str, text: str = "text") -> DataFrame:
    """Documents with their spans removed; those left empty go. ``spans`` has ``id, begin, end``."""
    listed = spans.groupBy(identifier).agg(F.collect_list(F.struct("begin", "end")).alias("__spans"))
    cut = docs.join(listed, identifier, "left").withColumn(text, remove_spans(F.col(text), F.col("__spans"))).drop("__spans")
    return cut.where(F.length(text) > 0)
