"""Near-duplicate vectors: a subspace pigeonhole join.

Unit vectors are turned by random rotations and cut into blocks of a few dimensions. When
two vectors are within squared distance D, some block of each rotation is within its share
of D, by the pigeonhole principle. Each block is range-joined by a grid of cells, a bit
wider than that share, with random offsets: vectors in one cell become candidates if their
sign sketches agree enough, and each candidate is verified exactly, in double precision.

Cells around a vector's own are not searched, they number 3 ** dimensions; instead there are
as many rotations as it takes for a pair just at the threshold to share a cell somewhere with
probability ``recall``. The number of dimensions of a block follows the number of vectors, so
that unrelated vectors seldom share a cell, and work grows as about the power 1.2 of it.

Equal vectors are one class at once, with a weight. A first pass over a few blocks links each
class to the least one of its cell only. Classes that the first pass has joined are not
compared again in the full pass: a group of thousands of near copies gives as many links, not
their square. There a crowded cell is cut into chunks, and every two chunks are a tile that
compares sketches and lets candidates out, so that it is dealt over many tasks. All links lie
inside components, so links are counted there in the end, exactly and by weight, over
tiles of two chunks of a component.

Defined results: vectors that are null, zero, or hold null or non-finite components, or have
no id, have no links and are their own component, as are vectors of an odd length for which no
other is; rows with equal ids are vectors of their own, each with its links; an empty table
gives no rows; other columns are not read. Fingerprints of 128 bits tell vectors apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.durable import materialise, tasks_for

#: Side of a cell as a share of the typical size of a coordinate's part of a unit vector.
SIDE = 2.0
#: Vectors in one chunk of a component while links are counted.
CHUNK = 512
#: Cells with more vectors are crowded.
CROWD = 64
#: Sketch bits, and how many of them a candidate may differ in: over six standard deviations above the mean at a cosine of
#: 0.95, where a bit differs with a chance of 0.101. A recall parameter: at most one pair in 1e9 at the threshold is lost by it.
SKETCH_BITS, SKETCH_DIFFER = 128, 42
#: Classes that are broadcast at most, some 8 MB.
MOST_BROADCAST = 250_000


class Plan:
    """Rotations, blocks and offsets for vectors of one length."""

    def __init__(self, length: int, count: int, cosine: float, recall: float):
        self.length = length
        spread = 1 / math.sqrt(length)
        self.side = SIDE * spread
        # Chances that two coordinates share a cell: of unrelated vectors, and of a pair at the threshold.
        a = SIDE / math.sqrt(2)
        unrelated = math.erf(a / math.sqrt(2)) - 2 / a * (1 - math.exp(-a * a / 2)) / math.sqrt(2 * math.pi)
        near = 1 - math.sqrt((2 - 2 * cosine) / length) * math.sqrt(2 / math.pi) / self.side
        self.dims = min(length, max(2, math.ceil(math.log(max(count, 2)) / -math.log(unrelated))))
        self.blocks = max(1, length // self.dims)
        tables = math.log(1 - recall) / math.log(1 - near**self.dims)
        # The fewer dimensions, the more the blocks of a rotation depend on each other.
        self.rotations = math.ceil(tables * (1 + 4 / length) / self.blocks)
        self.random = np.random.Generator(np.random.PCG64([length, self.dims]))
        self.turns = [np.linalg.qr(self.random.standard_normal((length, length)))[0] for _ in range(self.rotations)]
        self.offsets = self.random.uniform(0, self.side, (self.rotations, length))
        self.factors = self.random.integers(0, 2**63, (self.rotations, length), dtype=np.int64) | 1
        self.planes = self.random.standard_normal((length, SKETCH_BITS))

    @property
    def tables(self) -> int:
        return self.rotations * self.blocks

    def cells(self, unit: np.ndarray, rotations: int) -> np.ndarray:
        """One cell number for each vector and block, of the first ``rotations``."""
        out = []
        for r in range(rotations):
            grid = np.floor((unit @ self.turns[r] + self.offsets[r]) / self.side).astype(np.int64) * self.factors[r]
            for b in range(self.blocks):
                cell = grid[:, b * self.dims : (b + 1) * self.dims].sum(axis=1) + np.int64(r * 1_000_003 + b * 7919 + 1)
                cell ^= (cell >> 29) & np.int64(0x7FFFFFFFF)
                out.append(cell * np.int64(-7046029254386353131))
        return np.stack(out, axis=1)

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        bits = np.packbits(unit @ self.planes > 0, axis=1)
        return np.ascontiguousarray(bits).view(np.int64)


_plans: dict[tuple, Plan] = {}


def plan(*of) -> Plan:
    """A plan, made once a worker."""
    if of not in _plans:
        _plans[of] = Plan(*of)
    return _plans[of]


def _units(column: pa.Array, length: int) -> np.ndarray:
    rows = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[len(column)].as_py()].astype(np.float64).reshape(
        -1, length
    )
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fingerprinted(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, h0, h1, vector`` of every row; the fingerprint and the vector, in double precision, are null where it can have no links."""
    vector = F.col(vector_column).cast("array<double>")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    own = vectors.select(F.col(id_column).cast("long").alias("id"), vector.alias("vector"))
    own = own.withColumn("vector", F.when(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)), F.col("vector")))
    # A negative zero is a zero.
    own = own.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    known = F.col("vector").isNotNull()
    return own.select("id", F.when(known, F.xxhash64("vector")).alias("h0"), F.when(known, F.xxhash64(F.lit(7), "vector")).alias("h1"), "vector")


def _cell_rows(frame: DataFrame, length: int, of: tuple, rotations: int, extra: list[str]) -> DataFrame:
    """``cell, id, s0, s1`` and the columns in ``extra``, a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = plan(*of)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                unit = _units(part.column("vector"), length)
                cells, sketch = made.cells(unit, rotations), made.sketch(unit)
                spread = pa.array(np.repeat(np.arange(len(unit)), cells.shape[1]))
                taken = [part.column(c).take(spread) for c in ("id", *extra)]
                s0, s1 = (pa.array(np.repeat(sketch[:, i], cells.shape[1])) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), taken[0], s0, s1, *taken[1:]], names=["cell", "id", "s0", "s1", *extra])

    return frame.select("id", "vector", *extra).mapInArrow(run, "cell long, id long, s0 long, s1 long" + "".join(f", {c} long" for c in extra))


def _alike(a: str, b: str):
    differ = lambda s: F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}")))
    return differ("s0") + differ("s1") <= SKETCH_DIFFER


def _verified(pairs: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """The pairs ``a, b`` whose cosine reaches the threshold."""
    left, right = vectors.select(
        F.col("id").alias("a"), F.col("vector").alias("x")
    ), vectors.select(F.col("id").alias("b"), F.col("vector").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                length = len(batch.column("x")[0])
                x, y = _units(batch.column("x"), length), _units(batch.column("y"), length)
                keep = pa.array(np.einsum("ij,ij->i", x, y) >= cosine)
                yield batch.select(["a", "b"]).filter(keep)

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def links(vectors: DataFrame, length: int, cosine: float, recall: float) -> DataFrame:
    """Verified links ``a, b`` that hold together every component of vectors of one length."""
    of = (length, max(2, vectors.count()), cosine, recall)
    made = plan(*of)
    first = min(made.rotations, max(1, 8 // made.blocks))
    rows = _cell_rows(vectors, length, of, first, [])
    least = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "s0", "s1")).alias("head")).where("n > 1")
    stars = rows.join(least, "cell").select(
        F.col("head.id").alias("a"), F.col("id").alias("b"), "head", F.struct("s0", "s1").alias("own")
    ).where("a < b").where(_alike("head", "own"))
    found = materialise(_verified(stars.select("a", "b").distinct(), vectors, cosine))
    joined = connected_components(found)
    known = vectors.join(
        joined.select(F.col("node").alias("id"), "component"), "id", "left"
    ).select("id", "vector", F.coalesce("component", "id").alias("group"))
    rows = _cell_rows(known, length, of, made.rotations, ["group"])
    # Within a cell only vectors of different groups meet; most cells with company are one group, and drop out here.
    mixed = rows.groupBy("cell").agg(
        F.min("group").alias("low"), F.max("group").alias("high"), F.count(F.lit(1)).alias("n")
    ).where("low <> high").select("cell", "n")
    rows = materialise(rows.join(mixed, "cell"))
    crowded = rows.where(F.col("n") > CROWD).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    # Of a small cell the engine makes all pairs, at most CROWD for each row.
    one, two = (rows.where(F.col("n") <= CROWD).alias(name) for name in ("one", "two"))
    met = one.join(
        two, F.col("one.cell") == F.col("two.cell")
    ).where((F.col("one.id") < F.col("two.id")) & (F.col("one.group") != F.col("two.group")))
    pairs = met.where(_alike("one", "two")).select(F.col("one.id").alias("a"), F.col("two.id").alias("b"))
    more = _verified(pairs.unionByName(_candidates(crowded)).distinct(), vectors, cosine)
    return found.unionByName(more)


def _tiled(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, low, high, chunk`` and the columns: rows of a key with ``chunks``, dealt to the tiles of every two of its chunks."""
    cut = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    tiles = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = tiles.select(key, F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", *columns)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(partitions, key, "low", "high").sortWithinPartitions(key, "low", "high", "chunk", "id")


def _candidates(rows: DataFrame) -> DataFrame:
    """``a, b``: pairs of different groups in a cell whose sketches agree enough."""

    def pairs(ids: np.ndarray, groups: np.ndarray, sketch: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left, right = (np.flatnonzero(own), np.flatnonzero(~own)) if not own.all() else (np.arange(len(ids)), np.arange(len(ids)))
        for at in range(0, len(left), 64):
            part = left[at : at + 64]
            differ = np.bitwise_count(sketch[part, None] ^ sketch[None, right]).sum(axis=2)
            near = (differ <= SKETCH_DIFFER) & (groups[part, None] != groups[None, right])
            if own.all():
                near &= ids[part, None] < ids[None, right]
            i, j = np.nonzero(near)
            if len(i):
                one, two = ids[part[i]], ids[right[j]]
                yield np.minimum(one, two), np.maximum(one, two)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        names = ["cell", "low", "high", "chunk", "id", "group", "s0", "s1"]

        def close() -> Iterator[pa.RecordBatch]:
            if held is not None and len(held[4]) > 1:
                for a, b in pairs(held[4], held[5], np.stack(held[6:8], axis=1).astype(np.uint64, copy=False), held[3] == held[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in names]
            cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:3]])) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                part = [c[begin:end] for c in columns]
                if held is not None and all(held[k][0] == part[k][0] for k in range(3)):
                    held = [np.concatenate([x, y]) for x, y in zip(held, part)]
                    continue
                yield from close()
                held = part
        yield from close()

    return _tiled(rows, "cell", ["id", "group", "s0", "s1"]).mapInArrow(run, "a long, b long")


def count_links(members: DataFrame, cosine: float) -> DataFrame:
    """``id, n_links`` inside components; ``members`` has ``id, component, weight, vector``.

    A component is cut into chunks by a hash; every two chunks make a tile. A tile's counts
    leave its task, not its pairs, and no task holds more than two chunks of a component. A
    class counts as many times as it has vectors, and its own vectors are linked with each other.
    """
    sizes = materialise(members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).coalesce(8))
    few = sizes.count() <= MOST_BROADCAST
    cut = members.join(F.broadcast(sizes) if few else sizes, "component").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))

    def counted(rows: list) -> pa.RecordBatch:
        ids, chunks, low, high = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), rows[0][2], rows[0][3]
        weight = np.array([r[4] for r in rows], np.int64)
        unit = np.stack([r[5] for r in rows])
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        own = chunks == low
        if low == high:
            close = unit @ unit.T >= cosine
            np.fill_diagonal(close, False)
            n = close @ weight + weight - 1
        else:
            close = unit[own] @ unit[~own].T >= cosine
            n = np.zeros(len(ids), np.int64)
            n[own], n[~own] = close @ weight[~own], weight[own] @ close
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n.astype(np.int64))], names=["id", "n_links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vector")  # of one length in a component, of any in a batch
            values, edges = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            columns = (batch.column(c).to_pylist() for c in ("id", "component", "chunk", "low", "high", "weight"))
            for i, (vec, component, chunk, low, high, weight) in enumerate(zip(*columns)):
                if at != (component, low, high):
                    if held:
                        yield counted(held)
                    held, at = [], (component, low, high)
                held.append((vec, chunk, low, high, weight, values[edges[i] : edges[i + 1]].astype(np.float64)))
        if held:
            yield counted(held)

    tiles = _tiled(cut, "component", ["id", "weight", "vector"])
    return tiles.mapInArrow(run, "id long, n_links long").groupBy("id").agg(F.sum("n_links").alias("n_links"))


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.95, recall: float = 0.99999, id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``id, n_links, component_id, kept`` of every row of ``vectors``."""
    rows = fingerprinted(vectors, id_column, vector_column)
    # Copies are combined inside tasks before the shuffle; classes are numbered, and the numbers stored.
    grouped = rows.where("h0 is not null").groupBy("h0", "h1").agg(
        F.min("id").alias("doc"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector")
    )
    classes = materialise(grouped.select(
        F.monotonically_increasing_id().alias("id"), "h0", "h1", "doc", "weight", F.size("vector").alias("length"),
        "vector"
    ))
    # One plan of rotations for each length that at least two vectors have; a table of embeddings has few.
    lengths = [r["length"] for r in classes.groupBy("length").count().where("count > 1").select("length").collect()]
    edges = None
    for length in lengths:
        own = links(classes.where(F.col("length") == length).select("id", "vector"), length, cosine, recall)
        edges = own if edges is None else edges.unionByName(own)
    alone = classes.select("h0", "h1", (F.col("weight") - 1).alias("n_links"), "doc")
    if edges is None:
        placed = alone
    else:
        members = materialise(connected_components(edges).withColumnRenamed("node", "id"))
        known = members.join(classes.select("id", "doc", "weight", "vector"), "id")
        heads = materialise(known.groupBy("component").agg(F.min("doc").alias("head")).coalesce(tasks_for(classes.count())))
        few = heads.count() <= MOST_BROADCAST
        counts = count_links(known.drop("doc"), cosine)
        joined = members.join(
            F.broadcast(heads) if few else heads, "component"
        ).join(counts, "id").select("id", F.col("n_links").alias("own_links"), "head")
        placed = classes.select("id", "h0", "h1", "doc", "weight").join(joined, "id", "left")
        placed = placed.select("h0", "h1", F.coalesce("own_links", F.col("weight") - 1).alias("n_links"), F.coalesce("head", "doc").alias("doc"))
    placed = materialise(placed)
    small = placed.count() <= MOST_BROADCAST
    out = rows.select("id", "h0", "h1").join(F.broadcast(placed) if small else placed, ["h0", "h1"], "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("doc", "id").alias("component_id"))
    return out.select(
        F.col("id").alias(id_column), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
