import pytest
from pyspark.sql import functions as F

from millrace.operators import relational, sampling
from millrace.operators.components import connected_components


def values(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_take_per_group_and_batches(spark):
    rows = spark.createDataFrame([(g, p, g * 5 + p) for g in range(3) for p in range(5)], "shard int, pos int, value int")
    taken = relational.take_per_group(rows, 2, ["shard"], [F.col("pos")])
    assert values(taken, "value") == [(0,), (1,), (5,), (6,), (10,), (11,)]
    assert relational.take_per_group(rows, 0, ["shard"], [F.col("pos")]).count() == 0
    batches = relational.count_batches(rows.where("shard = 0"), 2, ["shard"], [F.col("pos")])
    assert values(batches, "batch", "value") == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 4)]


def test_size_batches_close_before_the_limit(spark):
    rows = spark.createDataFrame([(0, 1, 5e9), (0, 2, 6e9), (0, 3, 3e9), (0, 4, 8e9)], "g int, id int, size double")
    assert values(relational.size_batches(rows, 1e10, "size", ["g"], ["id"]), "batch", "items") == [(0, 1), (1, 2), (2, 1)]


def test_fold_batches(spark):
    rows = spark.createDataFrame([(0, i) for i in range(1, 11)], "g int, v int")

    def fold(state, row):
        total = (state or 0) + row["v"]
        return total < 10, total

    got = values(relational.fold_batches(rows, fold, ["g"], ["v"]), "batch", "v")
    assert [b for b, _ in got] == [0, 0, 0, 1, 1, 2, 3, 4, 5, 6]


def test_reshard(spark):
    rows = spark.range(50)
    assert relational.reshard(rows, 5).rdd.getNumPartitions() == 5
    assert relational.reshard(rows, None) is rows
    for n in (0, -5):
        with pytest.raises(ValueError):
            relational.reshard(rows, n)


def test_combined_join(spark):
    left = spark.createDataFrame([(1, "hello", 0.0), (2, "world", 0.0)], "id int, text string, score double")
    right = spark.createDataFrame([(1, 0.9)], "id int, score double")
    assert values(relational.combined_join(left, right, ["id"], "left"), "id", "score") == [(1, 0.9), (2, 0.0)]
    with pytest.raises(ValueError):
        relational.combined_join(left, right, ["id"], "outer")


def test_deduplicate_and_latest(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id int, version int, text string")
    assert values(relational.deduplicate(rows, ["id"], ["version"]), "id", "text") == [(1, "a"), (2, "c")]
    assert values(relational.latest(rows, ["id"], "version"), "id", "text") == [(1, "b"), (2, "c")]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, None)], "a long, b long")
    got = dict(values(connected_components(edges), "node", "component"))
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert connected_components(edges.limit(0)).count() == 0


def test_samples_repeat(spark):
    rows = spark.range(2000)
    one, two = sampling.bernoulli(rows, 0.3, "id"), sampling.bernoulli(rows, 0.3, "id")
    assert values(one, "id") == values(two, "id") and 450 < one.count() < 750
    assert sampling.reservoir(rows, 10, "id").count() == 10


def test_running_sums_and_positions(spark):
    from millrace.operators import folds

    rows = [(i % 3, i, (7 * i) % 11) for i in range(500)]
    frame = spark.createDataFrame(rows, "g int, i int, n long").repartition(6)
    got = {(r.g, r.i): r.start for r in folds.running_sums(frame, "n", ["i"], ["g"]).collect()}
    for g in range(3):
        total = 0
        for _, i, n in sorted(r for r in rows if r[0] == g):
            assert got[g, i] == total
            total += n
    assert [r.idx for r in relational.numbered(frame.select("i"), ["i"]).orderBy("i").collect()] == list(range(500))
    assert relational.numbered(frame.limit(0), ["i"]).count() == 0
    left, right = spark.createDataFrame([(5, "a"), (9, "b")], "x int, s string"), spark.createDataFrame([(2,), (1,)], "y int")
    assert sorted(map(tuple, relational.positional_join(left, right, ["x"], ["y"]).collect())) == [(5, "a", 1), (9, "b", 2)]
    with pytest.raises(ValueError):
        relational.positional_join(left, right.limit(1), ["x"], ["y"])


def test_batches_of_rows(spark):
    import pyarrow as pa
    import pyarrow.compute as pc

    frame = spark.range(10)
    assert sorted(r.id for r in relational.filter_rows(frame, lambda b: pc.greater(b.column("id"), 6)).collect()) == [7, 8, 9]
    double = lambda b: pa.RecordBatch.from_arrays([pc.multiply(b.column("id"), 2)], names=["id"])
    assert sorted(r.id for r in relational.map_batches(frame, [double, double], "id long", 3).collect()) == [4 * i for i in range(10)]
    counted = relational.map_shards(frame.repartition(2), lambda bs: iter([pa.RecordBatch.from_arrays([pa.array([sum(b.num_rows for b in bs)])], names=["n"])]), "n long")
    assert sum(r.n for r in counted.collect()) == 10
    sizes = [(0, 2), (2, 3)]
    got = relational.loader_batches(frame.withColumnRenamed("id", "idx"), sizes).orderBy("idx").collect()
    assert [(r.step, r.slot) for r in got] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (3, 2)]
    assert [relational.example_offset(s, sizes) for s in range(5)] == [0, 2, 4, 7, 10]
    with pytest.raises(ValueError):
        relational.loader_batches(frame, [(1, 2)])
