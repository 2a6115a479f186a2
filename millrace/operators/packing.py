"""Packing of prompts with completions into examples of one length, and sums over their segments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import in_order

EXAMPLE = [
    T.StructField("pack", T.LongType()), T.StructField("documents", T.ArrayType(T.LongType())),
    T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("loss_weights", T.ArrayType(T.DoubleType())),
    T.StructField("segments", T.ArrayType(T.LongType()))
]
_ARROW = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64())]


class _Open:
    """A pack that is being filled."""

    def __init__(self):
        self.documents: list[int] = []
        self.tokens: list[int] = []
        self.weights: list[float] = []
        self.segments: list[int] = []

    def add(self, document: int, ids: list[int], prompt: int) -> None:
        self.documents.append(document)
        self.tokens += ids
        self.weights += [float(i >= prompt - 1) for i in range(len(ids) - 1)] + [0.0]
        self.segments += [document] * len(ids)

    def example(self, number: int, length: int, pad: int) -> tuple:
        # Of a document longer than a pack the last tokens stay.
        fill = max(0, length - len(self.tokens))
        cut = lambda values, value: values[-length:] + [value] * fill
        return number, self.documents, cut(self.tokens, pad), cut(self.weights, 0.0), cut(self.segments, -1)


def _packed(
    examples: DataFrame, length: int, pad: int, most_segments: int, most_open: int, group: Sequence[str],
    identifier: str, ids: str, prompt: str,
) -> DataFrame:
    schema = T.StructType([*(examples.schema[c] for c in group), *EXAMPLE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, first, held = None, 0, None, []
        done: list[tuple] = []

        def close(pack: _Open) -> None:
            nonlocal number
            done.append((*(c[0].as_py() for c in first.columns), *pack.example(number, length, pad)))
            number += 1

        for batch in batches:
            keys = batch.column("__group").to_numpy()
            for i, (document, tokens, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in (identifier, ids, prompt)))):
                if first is None or keys[i] != at:
                    for pack in held:
                        close(pack)
                    at, number, first, held = keys[i], 0, batch.select(list(group)).slice(i, 1), []
                if len(tokens) <= n:
                    raise ValueError("an example must be longer than its prompt")
                if len(tokens) > length and most_open > 1:
                    raise ValueError("an example is longer than a pack")
                place = next((p for p in held if len(p.tokens) + len(tokens) <= length and len(p.documents) < most_segments), None)
                if place is None:
                    if most_open == 1:
                        for pack in held:
                            close(pack)
                        held = []
                    place = _Open()
                    held.append(place)
                place.add(document, tokens, n)
                if len(place.documents) == most_segments and most_open > 1:
                    held.remove(place)
                    close(place)
                while len(held) >= most_open > 1:
                    close(held.pop(0))
            if len(done) > 500:
                yield _batch(done, first, schema)
                done.clear()
        for pack in held:
            close(pack)
        if done:
            yield _batch(done, first, schema)

    return in_order(examples.select(*dict.fromkeys([*group, identifier, ids, prompt])), group, [identifier]).mapInArrow(run, schema)


def _batch(done: list[tuple], first: pa.RecordBatch, schema: T.StructType) -> pa.RecordBatch:
    types = [*(f.type for f in first.schema), *_ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=schema.names)


def first_fit_packs(
    examples: DataFrame, length: int, pad: int = 0, most_segments: int = 64, most_open: int = 64,
    group: Sequence[str] = (), identifier: str = "doc_id", ids: str = "ids", prompt: str = "prompt",
) -> DataFrame:
    """``group, pack, documents, tokens, loss_weights, segments``: each example goes to the first open pack that has room.

    A pack closes when it is full of segments, when too many packs are open, the oldest first,
    and at the end. Weights are 1 from the last prompt token on, 0 before it and at the last token.
    """
    return _packed(examples, length, pad, most_segments, most_open, group, identifier, ids, prompt)


def contiguous_packs(
    examples: DataFrame, length: int, pad: int = 0, most_segments: int = 64, group: Sequence[str] = (),
    identifier: str = "doc_id", ids: str = "ids", prompt: str = "prompt",
) -> DataFrame:
    """The same columns for packs of examples that follow each other; one longer than a pack stands alone, by its last tokens."""
    return _packed(examples, length, pad, most_segments, 1, group, identifier, ids, prompt)


def segment_losses(
    packs: DataFrame, key: Sequence[str], losses: str, weights: str = "loss_weights", segments: str = "segments",
    correct: str | None = None,
) -> DataFrame:
    """``key, segment, loss`` and with ``correct`` whether all weighed tokens are right: sums over each segment of each pack."""
    columns = [F.col(segments).alias("segment"), F.col(weights).alias("weight"), F.col(losses).alias("value")]
    if correct is not None:
        columns.append(F.col(correct).alias("right"))
    rows = packs.select(*key, F.explode(F.arrays_zip(*columns)).alias("t")).select(*key, "t.*").where("segment >= 0")
    sums: list[Column] = [F.sum(F.col("value") * F.col("weight")).alias("loss")]
    if correct is not None:
        sums.append(F.coalesce(F.bool_and(F.when(F.col("weight") > 0, F.col("right"))), F.lit(True)).alias("all_correct"))
    return rows.groupBy(*key, "segment").agg(*sums)
