"""Numbers about training runs and projects: histories, plateaus, leaderboards, scaling-law fits, durations.

Histories are aggregated by the engine. Fits run on the driver over one row a run, a number
that is bounded by ``MOST_RUNS``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_RUNS = 100_000


def flat_history(runs: DataFrame, run: str, history: str, metrics: Sequence[str]) -> DataFrame:
    """``run, step`` and a column for each metric: a row for each entry of an array of structs."""
    each = runs.select(run, F.posexplode(history).alias("step", "__h"))
    return each.select(run, F.col("step").cast("long").alias("step"), *(F.col(f"__h.{m}").alias(m) for m in metrics))


def without_zeros(frame: DataFrame, column: str) -> DataFrame:
    """The rows whose value is not zero; null ones stay."""
    return frame.where((F.col(column) != 0) | F.col(column).isNull())


def aggregated_steps(
    steps: DataFrame, run: str, step: str, columns: Sequence[str], how: str, step_range: tuple[int, int] = (1, 5),
) -> DataFrame:
    """``run`` and its columns: ``average`` over the last steps counted from the end in ``step_range``, ``last`` or ``all`` steps."""
    if how == "all":
        return steps.select(run, step, *columns)
    if how == "last":
        last = steps.groupBy(run).agg(F.max_by(F.struct(*columns), step).alias("__last"))
        return last.select(run, *(F.col(f"__last.{c}").alias(c) for c in columns))
    if how != "average":
        raise ValueError("how must be average, last or all")
    low, high = step_range
    rank = F.row_number().over(Window.partitionBy(run).orderBy(F.col(step).desc()))
    chosen = steps.withColumn("__rank", rank).where((F.col("__rank") >= low) & (F.col("__rank") <= high))
    return chosen.groupBy(run).agg(*(F.avg(c).alias(c) for c in columns))


def leaderboard(
    results: DataFrame, run: str, metric: str, value: str, metrics: Sequence[str], order: str,
    descending: bool = True,
) -> DataFrame:
    """``rank, run`` and a column for each metric: the best value of each run, ordered by one metric."""
    wide = results.groupBy(run).pivot(metric, list(metrics)).agg(F.max(value))
    by = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    # One row a run.
    return wide.withColumn("rank", F.row_number().over(Window.orderBy(by, run)).cast("long")).select("rank", run, *metrics)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def two_sided_p(t: float, degrees: float) -> float:
    """The chance that Student's t is as far from 0 as ``t``."""
    if math.isinf(t):
        return 0.0
    a, b, x = degrees / 2, 0.5, degrees / (degrees + t * t)
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.udf(T.DoubleType())
def _p_value(slope, r2, n):
    if slope is None or r2 is None:
        return 1.0  # a constant history has no trend
    if n <= 2:
        return 1.0
    t = math.inf if r2 >= 1 else math.sqrt(r2 * (n - 2) / (1 - r2))
    return two_sided_p(t, n - 2)


def plateaus(
    history: DataFrame, group: Sequence[str], order: str, value: str, window: int = 100, slope: float = 0.01,
    variation: float = 0.1, p: float = 0.1,
) -> DataFrame:
    """``group, plateaued``: whether the last ``window`` values are flat, stable, and without a significant trend.

    A line is fitted by the engine's regression aggregates; the p value is computed once a group.
    """
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(order).desc()))
    recent = history.withColumn("__x", rank.cast("double")).where(F.col("__x") <= window)
    y, x = F.col(value), -F.col("__x")
    stats = recent.groupBy(*group).agg(
        F.count(value).alias("n"), F.avg(F.abs(y)).alias("mean"), F.stddev_pop(y).alias("std"), F.regr_slope(
            y, x
        ).alias("slope"), F.regr_r2(y, x).alias("r2")
    )
    big = F.col("mean") > 1e-6
    flat = ~big | (F.abs("slope") / F.col("mean") < slope)
    stable = ~big | (F.col("std") / F.col("mean") < variation)
    trend = _p_value(F.when(F.col("std") > 0, F.col("slope")), F.when(F.col("std") > 0, F.col("r2")), F.col("n")) <= p
    return stats.select(*group, ((F.col("n") >= window) & F.coalesce(flat, F.lit(True)) & stable & ~trend).alias("plateaued"))


def minimised(
    loss: Callable[[np.ndarray], float], start: Sequence[float], bounds: Sequence[tuple[float | None, float | None]],
    rounds: int = 4000,
) -> np.ndarray:
    """A minimum near ``start`` inside bounds, by a simplex that restarts until it no longer improves."""
    low, high = (np.array([fallback if b[i] is None else b[i] for b in bounds]) for i, fallback in ((0, -np.inf), (1, np.inf)))
    inside = lambda x: np.clip(x, low, high)
    best, value = inside(np.array(start, float)), math.inf
    for _ in range(12):
        points = np.array([best, *(inside(best + (0.1 * abs(best[i]) + 0.05) * np.eye(len(best))[i]) for i in range(len(best)))])
        losses = np.array([loss(x) for x in points])
        for _ in range(rounds):
            order = np.argsort(losses)
            points, losses = points[order], losses[order]
            if losses[-1] - losses[0] <= 1e-15 * (1 + abs(losses[0])):
                break
            centre = points[:-1].mean(axis=0)
            tried = inside(centre + (centre - points[-1]))
            at = loss(tried)
            if at < losses[0]:
                further = inside(centre + 2 * (centre - points[-1]))
                beyond = loss(further)
                points[-1], losses[-1] = (further, beyond) if beyond < at else (tried, at)
            elif at < losses[-2]:
                points[-1], losses[-1] = tried, at
            else:
                nearer = inside(centre + 0.5 * ((tried if at < losses[-1] else points[-1]) - centre))
                closer = loss(nearer)
                if closer < min(at, losses[-1]):
                    points[-1], losses[-1] = nearer, closer
                else:
                    points[1:] = inside(points[0] + 0.5 * (points[1:] - points[0]))
                    losses[1:] = [loss(x) for x in points[1:]]
        k = int(np.argmin(losses))
        if value - losses[k] <= 1e-12 * (1 + abs(losses[k])):
            return points[k]
        best, value = points[k], float(losses[k])
    return best


def _huber(residual: np.ndarray, delta: float) -> float:
    size = np.abs(residual)
    return float(np.where(size <= delta, 0.5 * residual**2, delta * (size - 0.5 * delta)).sum())


def fit_power_law(parameters: np.ndarray, tokens: np.ndarray, losses: np.ndarray, delta: float = 1e-3) -> tuple[float, ...]:
    """``A, B, alpha, beta, E`` of ``A / N**alpha + B / D**beta + E``, by the Huber loss of logarithms."""
    n, d, y = np.log(parameters), np.log(tokens), np.log(losses)

    def loss(x: np.ndarray) -> float:
        terms = np.stack([x[0] - x[2] * n, x[1] - x[3] * d, np.full_like(n, math.log(max(x[4], 1e-300)))])
        return _huber(y - np.logaddexp.reduce(terms, axis=0), delta)

    least = max(float(np.min(losses)), 1e-10)
    bounds = [(None, None), (None, None), (0, None), (0, None), (0, None)]
    starts = [[0.0, 0.0, 1.0, 1.0, least], *([a, a, s, s, 0.8 * least] for a in (2.0, 6.0, 12.0) for s in (0.2, 0.5))]
    found = min((minimised(loss, s, bounds) for s in starts), key=loss)
    return math.exp(found[0]), math.exp(found[1]), *map(float, found[2:])


def fit_sigmoid(task_loss: np.ndarray, accuracy: np.ndarray) -> tuple[float, ...]:
    """``a, b, k, L0`` of ``a / (1 + exp(-k (L - L0))) + b`` with ``k`` at most 0, by least squares."""
    low, high = float(np.min(accuracy)), float(np.max(accuracy))
    bounds = [(0, None), (0, None), (None, 0), (None, None)]

    def loss(x: np.ndarray) -> float:
        return float(((x[0] / (1 + np.exp(np.clip(-x[2] * (task_loss - x[3]), -700, 700))) + x[1] - accuracy) ** 2).sum())

    starts = [[high - low, low, k, float(m)] for k in (-1.0, -4.0, -15.0) for m in np.quantile(task_loss, (0.25, 0.5, 0.75))]
    return tuple(map(float, min((minimised(loss, s, bounds) for s in starts), key=loss)))


def scaling_fit(runs: DataFrame, parameters: str, tokens: str, loss: str) -> tuple[float, ...]:
    """The power law through a table with one row a run; rows without tokens are left out."""
    rows = without_zeros(runs, tokens).select(*(F.col(c).cast("double").alias(c) for c in (
        parameters, tokens, loss
    ))).dropna().limit(MOST_RUNS + 1).collect()
    if len(rows) > MOST_RUNS:
        raise ValueError("a fit is over one row a run; aggregate the steps first")
    return fit_power_law(*(np.array([r[c] for r in rows]) for c in (parameters, tokens, loss)))


def mean_minutes(begin: Column, end: Column) -> Column:
    """The mean of some durations, in minutes."""
    return F.avg(F.timestamp_diff("MICROSECOND", begin, end) / 60_000_000)


def closed_since(closed: Column, since: str) -> Column:
    """How many of some dates are not before another."""
    return F.count(F.when(closed >= F.to_timestamp(F.lit(since)), 1))
