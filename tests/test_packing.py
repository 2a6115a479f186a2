"""Packing against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import packing, training


def examples(spark, rows):
    return spark.createDataFrame([(i, list(range(100 * i, 100 * i + n)), p) for i, (n, p) in enumerate(rows)], "doc_id long, ids array<long>, prompt int")


def weights(n, prompt):
    return [float(i >= prompt - 1) for i in range(n - 1)] + [0.0]


def padded(values, pad, length):
    return (values + [pad] * length)[:length] if len(values) <= length else values[-length:]


def plain(rows, length, most_segments, most_open):
    held, out = [], []
    for i, (n, p) in enumerate(rows):
        for pack in held:
            if sum(rows[j][0] for j in pack) + n <= length and len(pack) < most_segments:
                pack.append(i)
                if len(pack) == most_segments:
                    held.remove(pack)
                    out.append(pack)
                break
        else:
            held.append([i])
        while len(held) >= most_open:
            out.append(held.pop(0))
    return out + held


def test_first_fit(spark):
    rng = random.Random(4)
    rows = [(n := rng.randint(2, 30), rng.randint(1, n - 1)) for _ in range(300)]
    for most_segments, most_open in ((64, 64), (3, 4)):
        got = packing.first_fit_packs(examples(spark, rows), 40, 7, most_segments, most_open).orderBy("pack").collect()
        assert [r.documents for r in got] == plain(rows, 40, most_segments, most_open)
        for r in got:
            assert r.tokens == padded([t for i in r.documents for t in range(100 * i, 100 * i + rows[i][0])], 7, 40)
            assert r.loss_weights == padded([w for i in r.documents for w in weights(*rows[i])], 0.0, 40)
            assert r.segments == padded([i for i in r.documents for _ in range(rows[i][0])], -1, 40)
    with pytest.raises(Exception, match="longer than its prompt"):
        packing.first_fit_packs(examples(spark, [(3, 3)]), 10).collect()
    with pytest.raises(Exception, match="longer than a pack"):
        packing.first_fit_packs(examples(spark, [(30, 3)]), 10).collect()


def test_contiguous(spark):
    rows = [(4, 1), (5, 2), (3, 1), (25, 4), (2, 1), (2, 1), (2, 1)]
    got = packing.contiguous_packs(examples(spark, rows), 10, 0, 2).orderBy("pack").collect()
    assert [r.documents for r in got] == [[0, 1], [2], [3], [4, 5], [6]]
    assert got[2].tokens == list(range(315, 325)) and got[2].loss_weights == weights(25, 4)[-10:] and got[2].segments == [3] * 10
    assert got[1].tokens == [200, 201, 202] + [0] * 7 and packing.contiguous_packs(examples(spark, rows).limit(0), 10).count() == 0


def test_segment_losses(spark):
    frame = spark.createDataFrame([(1, [5, 5, 6, 6, -1], [1.0, 0.0, 1.0, 1.0, 0.0], [0.5, 9.0, 1.0, 2.0, 9.0], [True, False, True, False, True])], "pack long, segments array<long>, loss_weights array<double>, l array<double>, ok array<boolean>")
    got = sorted(map(tuple, packing.segment_losses(frame, ["pack"], "l", correct="ok").collect()))
    assert got == [(1, 5, 0.5, True), (1, 6, 3.0, False)]


def test_causal_views(spark):
    frame = spark.createDataFrame([([4, 0, 5, 0, 6],)], "ids array<int>")
    got = training.causal_examples(frame, end_id=0).first()
    assert got.loss_weights == [1.0, 1.0, 1.0, 1.0, 0.0] and got.segments == [0, 0, 1, 1, 2]
    indexed = spark.range(10).withColumnRenamed("id", "idx")
    train, tail = training.validation_tail(indexed, 10, 3)
    assert train.count() == 7 and sorted(r.idx for r in tail.collect()) == [7, 8, 9] and training.train_batches(indexed, 2, 4).count() == 8
    with pytest.raises(ValueError):
        training.validation_tail(indexed, 10, 11)


def test_permutations_of_very_long_tables(spark):
    n = 10**13
    points = spark.createDataFrame([(0,), (1,), (n - 1,), (123_456_789_012,)], "i long")
    got = [tuple(r) for r in points.select("i", training.linear_permutation(F.col("i"), n, 7_368_787_111, 17), training.era_permutation(F.col("i"), n, 10**9 + 7, 9_999_991, 3)).collect()]
    for i, linear, era in got:
        block = i // (10**9 + 7)
        size = min(10**9 + 7, n - block * (10**9 + 7))
        assert linear == (7_368_787_111 * i + 17) % n and era == block * (10**9 + 7) + (9_999_991 * (i % (10**9 + 7)) + 3) % size
    assert all(0 <= r[0] < n for r in points.select(training.feistel_permutation(F.col("i"), n, (1, 2, 3, 4, 5))).collect())
    for make in (lambda i: training.linear_permutation(i, 10, 3, 0), lambda i: training.feistel_permutation(i, 10, (1, 2)), lambda i: training.era_permutation(i, 10, 4, 3, 0)):
        with pytest.raises(Exception, match="out of range"):
            spark.range(10, 11).select(make(F.col("id"))).collect()
    with pytest.raises(ValueError):
        training.era_permutation(F.col("i"), 10, 4, 2, 0)


def test_replay_limits_and_stages(spark):
    rows = spark.createDataFrame([("e", i, i, f"2024-01-{i + 1:02d} 00:00:00") for i in range(10)], "g string, id int, weight_step int, t string").withColumn("t", F.to_timestamp("t"))
    kept = training.replay_buffer(rows, 4, 9, 20, ["g"], time="t", since=F.to_timestamp(F.lit("2024-01-05 00:00:00")))
    assert sorted(r.id for r in kept.collect()) == [6, 7, 8, 9]
    assert training.replay_buffer(rows, 40, 9, 20, ["g"], time="t", since=F.to_timestamp(F.lit("2024-01-05 00:00:00"))).count() == 5
    drawn = training.replay_sample(rows.withColumn("g", F.lit(None).cast("string")), 3, ["g"], "id", ["id"], 4.0)
    assert drawn.count() == 3 and drawn.columns == rows.columns
    with pytest.raises(ValueError):
        training.staged_mixture(spark, [(1, {"a": 1.0})], {"a": 3}, 4)
    one = {(r.idx, r.item) for r in training.staged_mixture(spark, [(0, {"a": 1.0}), (2, {"a": 3.0})], {"a": 100}, 4, 10).collect()}
    plain = {(r.idx, r.item) for r in training.mixture_blocks(spark, {"a": 1.0}, {"a": 100}, 4, 10).collect()}
    assert sorted(i for _, i in one) == sorted(i for _, i in plain) == list(range(40))
