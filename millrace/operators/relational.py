"""Relational building blocks beyond what a DataFrame has by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import materialise
from .folds import in_order, packs


def take_per_group(frame: DataFrame, n: int, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows of each group; a window limit prunes rows before the shuffle."""
    ranked = frame.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("__rank") <= n).drop("__rank")


def count_batches(frame: DataFrame, size: int, group: Sequence[str], order: Sequence[Column], out: str = "batch") -> DataFrame:
    """Numbers tumbling batches of up to ``size`` rows inside each group."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return frame.withColumn(out, F.floor((rank - 1) / size).cast("long"))


def size_batches(frame: DataFrame, most: float, size: str, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``group, batch, items, total``: greedy batches that close before ``total`` would reach ``most``.

    An item that alone reaches the limit is a batch of its own.
    """
    own = frame.withColumn(size, F.col(size).cast("double"))
    return packs(own, lambda items, total, n: total + n >= most, size, group, order, ("batch", "items", "total"))


def fold_batches(frame: DataFrame, fold: Callable, group: Sequence[str], order: Sequence[str], out: str = "batch") -> DataFrame:
    """Numbers batches by a stateful fold: ``fold(state, row) -> (goes_on, state)``, with state ``None`` at a batch's start.

    The row that ends a batch begins the next one and is folded again from the start. Rows
    stream through the fold as dictionaries; only the state is held.
    """
    schema, columns = T.StructType([*frame.schema.fields, T.StructField(out, T.LongType())]), frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, number, filled = None, None, 0, False
        for batch in batches:
            keys, own = batch.column("__group").to_pylist(), batch.select(columns)
            numbers = []
            for key, row in zip(keys, own.to_pylist()):
                if not filled or key != at:
                    at, state, number, filled = key, None, 0, False
                goes_on, following = fold(state, row)
                if not goes_on and filled:
                    number += 1
                    _, following = fold(None, row)
                state, filled = following, True
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(numbers, pa.int64())], names=schema.names)

    return in_order(frame, group, order).mapInArrow(run, schema)


def reshard(frame: DataFrame, n: int | None) -> DataFrame:
    """Deals rows to ``n`` partitions; ``None`` leaves them."""
    if n is None:
        return frame
    if n <= 0:
        raise ValueError("the number of partitions must be positive")
    return frame.repartition(n)


def deduplicate(frame: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The least row of each key by ``order``; combined inside tasks before the shuffle."""
    others = [c for c in frame.columns if c not in key]
    least = frame.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__row"))
    return least.select(*(c if c in key else F.col(f"__row.{c}") for c in frame.columns))


def latest(frame: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """The row of the greatest version of each key."""
    others = [c for c in frame.columns if c not in key]
    last = frame.groupBy(*key).agg(F.max_by(F.struct(*others), F.col(version)).alias("__row"))
    return last.select(*(c if c in key else F.col(f"__row.{c}") for c in frame.columns))


def combined_join(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join whose shared columns come from the right side where it has a value."""
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    shared = [c for c in right.columns if c in left.columns and c not in key]
    renamed = right.select(*(F.col(c).alias(f"__right_{c}") if c in shared else F.col(c) for c in right.columns))
    joined = left.join(renamed, list(key), how)
    own = [F.coalesce(f"__right_{c}", c).alias(c) if c in shared else F.col(c) for c in left.columns]
    return joined.select(*own, *(c for c in right.columns if c not in left.columns))


def page(frame: DataFrame, offset: int, count: int, order: Sequence[Column]) -> DataFrame:
    """Rows ``offset`` to ``offset + count`` in an order."""
    return frame.orderBy(*order).offset(offset).limit(count)


def prefix_sums(frame: DataFrame, size: str, order: Sequence[Column], group: Sequence[str] = (), out: str = "start") -> DataFrame:
    """Adds the sum of ``size`` over the rows before each row."""
    window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumn(out, F.sum(size).over(window) - F.col(size))


def numbered(frame: DataFrame, order: Sequence[str], out: str = "idx") -> DataFrame:
    """Adds dense numbers from 0 in an order, without a task that sees all rows."""
    from .folds import running_sums

    return running_sums(frame.withColumn("__one", F.lit(1).cast("long")), "__one", order, out=out).drop("__one")


def positional_join(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """The first row of one side with the first of the other, and so on; both must have as many rows."""
    one, two = materialise(numbered(left, left_order, "__at")), materialise(numbered(right, right_order, "__at"))
    if one.count() != two.count():
        raise ValueError("the sides have different numbers of rows")
    return one.join(two, "__at").drop("__at")


def filter_rows(frame: DataFrame, keep: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """The rows for which ``keep`` gives true, a boolean array for each Arrow batch; columns' own predicates push down, this one does not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(keep(batch))

    return frame.mapInArrow(run, frame.schema)


def map_shards(
    frame: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: T.StructType | str,
) -> DataFrame:
    """What a function makes of each partition's batches, read as a stream."""
    return frame.mapInArrow(function, schema)


def map_batches(
    frame: DataFrame, functions: Sequence[Callable[[pa.RecordBatch], pa.RecordBatch]], schema: T.StructType | str,
    size: int = 2048,
) -> DataFrame:
    """Batch functions one after the other, in one pass over slices of up to ``size`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                for function in functions:
                    part = function(part)
                yield part

    return frame.mapInArrow(run, schema)


def loader_batches(indexed: DataFrame, sizes: Sequence[tuple[int, int]], index: str = "idx") -> DataFrame:
    """Adds ``step`` and ``slot``: the batch that an index is in, and its place there.

    ``sizes`` has the first step of each stage and its batch size, by step, from step 0 on.
    """
    if not sizes or sizes[0][0] != 0 or list(sizes) != sorted(sizes):
        raise ValueError("stages must begin at step 0 and ascend")
    step, offset = F.lit(None).cast("long"), F.lit(None).cast("long")
    for first, begin, size in stage_offsets(sizes):
        here = F.col(index) >= begin
        step = F.when(here, first + F.floor((F.col(index) - begin) / size)).otherwise(step)
        offset = F.when(here, (F.col(index) - begin) % size).otherwise(offset)
    return indexed.withColumns({"step": step.cast("long"), "slot": offset.cast("long")})


def stage_offsets(sizes: Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``first step, first example, batch size`` of each stage."""
    out, offset = [], 0
    for k, (first, size) in enumerate(sizes):
        if k:
            offset += (first - sizes[k - 1][0]) * sizes[k - 1][1]
        out.append((first, offset, size))
    return out


def example_offset(step: int, sizes: Sequence[tuple[int, int]]) -> int:
    """The number of examples before a step."""
    first, offset, size = [x for x in stage_offsets(sizes) if x[0] <= step][-1]
    return offset + (step - first) * size
