"""Folds over rows in order: each group streams through one task, with a state and not its rows in memory.

Rows are dealt by group and sorted inside tasks, then read batch by batch. Only what a fold
closes leaves it. A group's fold is sequential by nature; many groups run side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import materialise


def in_order(frame: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``frame`` with ``__group``, a hash of the group; a group's rows follow each other in one task, in order."""
    marked = frame.withColumn("__group", F.xxhash64(*group) if group else F.lit(0).cast("long"))
    dealt = marked.repartition(*group) if group else marked.repartition(1)
    return dealt.sortWithinPartitions("__group", *group, *order)


def packs(
    frame: DataFrame, closes: Callable[[int, float, float], bool], size: str, group: Sequence[str],
    order: Sequence[str], names: tuple[str, str, str],
) -> DataFrame:
    """``group`` and three columns, named by ``names``: a pack's number, its rows, and the sum of their sizes.

    ``closes(rows, total, size)`` says whether a pack that is not empty ends before a row of that size.
    """
    kind = frame.schema[size].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    pack, rows, total = names
    fields = [T.StructField(pack, T.LongType()), T.StructField(rows, T.LongType()), T.StructField(total, T.LongType() if whole else T.DoubleType())]
    schema = T.StructType([*(frame.schema[c] for c in group), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, count, held, first, done = None, 0, 0, 0, None, []

        def made(last: bool) -> Iterator[pa.RecordBatch]:
            if done and (last or len(done) > 10_000):
                columns = zip(*done)
                types = [f.type for f in first.schema] if first is not None else []
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    columns, [*types, pa.int64(), pa.int64(), pa.int64() if whole else pa.float64()]
                )], names=schema.names)
                done.clear()

        def close() -> None:
            if count:
                done.append((*(c[0].as_py() for c in first.columns), number, count, held))

        for batch in batches:
            keys = batch.column("__group").to_numpy()
            for i, n in enumerate(batch.column(size).to_pylist()):
                n = 0 if n is None else n
                if first is None or keys[i] != at:
                    close()
                    at, number, count, held, first = keys[i], 0, 0, 0, batch.select(list(group)).slice(i, 1)
                elif closes(count, held, n):
                    close()
                    number, count, held = number + 1, 0, 0
                count, held = count + 1, held + n
            yield from made(False)
        if first is not None:
            close()
        yield from made(True)

    return in_order(frame.select(*dict.fromkeys([*group, *order, size])), group, order).mapInArrow(run, schema)


def running_sums(frame: DataFrame, size: str, order: Sequence[str], group: Sequence[str] = (), out: str = "start") -> DataFrame:
    """Adds the sum of ``size`` over the rows before each row of its group, with no group or order in one task.

    Rows are dealt by ranges of group and order; sums run inside tasks, and a task's first sum
    comes from the totals of the tasks before.
    """
    marked = frame.withColumn("__group", F.xxhash64(*group) if group else F.lit(0).cast("long"))
    dealt = marked.repartitionByRange("__group", *group, *order).sortWithinPartitions("__group", *group, *order)
    schema = T.StructType([*marked.schema.fields, T.StructField("__task", T.IntegerType()), T.StructField("__inside", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, at, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("__group").to_numpy()
            sizes = batch.column(size).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(sizes) - sizes
            heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            carried = held if at is not None and keys[0] == at else 0
            inside = before - np.repeat(before[heads], np.diff(np.append(heads, len(keys))))
            inside[: heads[1] if len(heads) > 1 else len(keys)] += carried
            at, held = keys[-1], int(inside[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(keys), task, np.int32)), pa.array(inside)], names=schema.names)

    placed = materialise(dealt.mapInArrow(run, schema))
    totals = placed.groupBy("__group", "__task").agg(F.sum(size).alias("__total"))
    # A group's totals by task are few: one for each task that it spans.
    before = totals.select("__group", "__task", F.expr("sum(__total) over (partition by __group order by __task) - __total").alias("__before"))
    joined = placed.join(before, ["__group", "__task"])
    return joined.withColumn(out, F.col("__before") + F.col("__inside")).select(*frame.columns, out)
