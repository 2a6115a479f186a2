"""Run metrics, steps, hashes and text helpers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import hashing, text
from millrace.operators import classify, consolidate, dedup, metrics, steps


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_hash_vectors(spark):
    assert hashing.blake3_digest(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert hashing.blake3_digest(b"hello").hex() == "ea8f163db38682925e4491c5e58d4bb3506ef8c14eb78a86e908c5624a67200f"
    pattern = bytes(i % 251 for i in range(8192))
    assert hashing.blake3_digest(pattern[:1024]).hex() == "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"
    assert hashing.blake3_digest(pattern[:1025]).hex() == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"
    got = spark.createDataFrame([("hello",), (None,), ("",)], "t string").select(hashing.blake3("t"), hashing.blake2b_64("t"), hashing.compression_ratio("t")).collect()
    assert got[0][0].startswith("ea8f163d") and got[1] == (None, None, None) and got[2][2] == 2.0
    frame = spark.createDataFrame([("a" * 10_000,), ("abc",)], "t string").select(hashing.compression_ratio("t")).collect()
    # A frame of 15 bytes of header, 4 of block size, the block, and 4 of end mark.
    assert frame[1][0] == (15 + 4 + 3 + 4) / 3 and frame[0][0] < 0.01


def test_text_helpers(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c).first()[0]
    t = F.col("t")
    assert one(text.truncated(t, 3), "é😀xyz") == "é😀x" and one(text.strip(t), "\n\t a b  \n") == "a b"
    assert one(text.plain_article(t), "a^(1) b\n  \n\n []\nc") == "a b\n\nc"
    assert one(text.unlabelled(t), "__label__x the text") == "the text" and one(text.unlabelled(t), "none") is None
    import hashlib

    assert one(text.line_id(F.lit(7), t), "l") == hashlib.sha256(b"7:l").hexdigest()
    assert one(text.any_text(t, ["text", "body"], ["lines"]), '{"text": " ", "body": "b"}') == "b"
    assert one(text.any_text(t, ["text"], ["lines"]), '{"lines": ["x", null, "y"]}') == "x\ny"
    assert one(text.any_text(t, ["text"]), '{"title": " T ", "body": "B"}') == "T\n\nB" and one(text.any_text(t, ["text"]), '{"q": 1}') == '{"q": 1}'
    assert one(text.any_id(t, ["id", "uuid"], "b_2024", F.lit(3)), '{"metadata": {"uuid": "u"}}') == "u" and one(text.any_id(t, ["id"], "b_2024", F.lit(3)), "{}") == "b_2024_000003"
    lists = spark.createDataFrame([(["Py"],), (["a", "b"],), (None,)], "l array<string>")
    assert [r[0] for r in lists.select(text.listed_extension(F.col("l"))).collect()] == [".py", None, None]
    text.check_train_paths(["/data/train", "/latest/x"])
    for path in ("/data/test/x", "/x/validation.jsonl"):
        with pytest.raises(ValueError):
            text.check_train_paths([path])


def test_sketch_quantile(spark):
    values = [float(v) for v in np.random.default_rng(1).lognormal(3, 2, 3000)] + [0.0] * 50 + [-5.0, -2.5]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    ordered = sorted(values)
    for q in (0.0, 0.005, 0.3, 0.9, 1.0):
        exact = ordered[math.floor(q * (len(ordered) - 1))]
        assert abs(consolidate.quantile(frame, "v", q) - exact) <= 0.0101 * abs(exact) + 1e-12
    assert consolidate.quantile(frame.where("v > 1e9"), "v", 0.5) is None
    assert consolidate.quantile(frame.where("v > 0"), "v", 0.5, exact=True) in ordered


def test_histories(spark):
    runs = spark.createDataFrame([("r", [(1.0, 5), (2.0, 0), (4.0, 7)])], "run string, h array<struct<loss: double, tokens: long>>")
    flat = metrics.flat_history(runs, "run", "h", ["loss", "tokens"])
    assert rows(flat, "run", "step", "loss", "tokens") == [("r", 0, 1.0, 5), ("r", 1, 2.0, 0), ("r", 2, 4.0, 7)] and metrics.without_zeros(flat, "tokens").count() == 2
    assert rows(metrics.aggregated_steps(flat, "run", "step", ["loss"], "average", (1, 2)), "loss") == [(3.0,)]
    assert rows(metrics.aggregated_steps(flat, "run", "step", ["loss"], "last"), "loss") == [(4.0,)] and metrics.aggregated_steps(flat, "run", "step", ["loss"], "all").count() == 3
    with pytest.raises(ValueError):
        metrics.aggregated_steps(flat, "run", "step", ["loss"], "none")
    results = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0), ("a", "x", 0.5)], "run string, metric string, value double")
    assert [tuple(r) for r in metrics.leaderboard(results, "run", "metric", "value", ["x", "y"], "x").collect()] == [(1, "b", 3.0, None), (2, "a", 1.0, 2.0)]


def test_plateaus(spark):
    rng = np.random.default_rng(0)
    series = {"flat": 1 + 0.01 * rng.standard_normal(150), "rising": np.linspace(0.5, 1.5, 150), "noisy": 1 + rng.standard_normal(150), "short": np.ones(50), "constant": np.ones(120), "zero": np.zeros(100)}
    frame = spark.createDataFrame([(k, i, float(v)) for k, vs in series.items() for i, v in enumerate(vs)], "g string, i int, v double")
    assert dict(rows(metrics.plateaus(frame, ["g"], "i", "v"), "g", "plateaued")) == {"flat": True, "rising": False, "noisy": False, "short": False, "constant": True, "zero": True}
    # Student's t, from tables.
    assert metrics.two_sided_p(2.228, 10) == pytest.approx(0.05, abs=2e-5) and metrics.two_sided_p(1.984, 100) == pytest.approx(0.05, abs=3e-5) and metrics.two_sided_p(0.0, 5) == 1.0


def test_scaling_fits(spark):
    n, d = np.meshgrid([1e7, 1e8, 1e9, 1e10], [1e9, 1e10, 1e11])
    n, d = n.ravel(), d.ravel()
    y = 400 / n**0.34 + 410 / d**0.28 + 1.7
    frame = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(n, d, y)] + [(1.0, 0.0, 9.0)], "n double, d double, loss double")
    a, b, alpha, beta, e = metrics.scaling_fit(frame, "n", "d", "loss")
    assert np.allclose(a / n**alpha + b / d**beta + e, y, rtol=2e-3) and alpha == pytest.approx(0.34, abs=0.03) and e == pytest.approx(1.7, abs=0.05)
    x = np.linspace(2, 5, 40)
    a, b, k, at = metrics.fit_sigmoid(x, 0.7 / (1 + np.exp(3 * (x - 3.2))) + 0.25)
    assert (a, b, k, at) == pytest.approx((0.7, 0.25, -3.0, 3.2), abs=0.02)


def test_durations(spark):
    frame = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-01 00:10:00"), ("2024-01-02 00:00:00", "2024-01-02 00:30:00")], "b string, e string").select(F.to_timestamp("b").alias("b"), F.to_timestamp("e").alias("e"))
    assert tuple(frame.agg(metrics.mean_minutes(F.col("b"), F.col("e")), metrics.closed_since(F.col("e"), "2024-01-02")).first()) == (20.0, 1)


def test_labels(spark):
    data = [(i, ["red apple", "blue sky", "green grass"][i % 3] + f" w{i}", ["a", "b", "c"][i % 3]) for i in range(90)]
    docs = spark.createDataFrame(data, "doc_id long, text string, topic string")
    model = classify.LabelModel.fit(docs, "text", "topic", "doc_id")
    got = docs.select("topic", model.scores(F.col("text"), 2).alias("s")).collect()
    assert all(max(r.s, key=r.s.get) == r.topic and len(r.s) == 2 for r in got)
    labelled = classify.attribute_labels(docs, docs.select("doc_id", F.length("text").alias("n")).where("doc_id < 5"), "doc_id", F.col("n") > 10)
    assert labelled.count() == 5 and "label" in labelled.columns


def test_counters_and_votes(spark):
    components = spark.createDataFrame([(1,), (1,), (2,), (3,), (3,), (3,)], "component long")
    assert tuple(dedup.fuzzy_counters(components).first()) == (6, 5, 1, 2)
    votes = spark.createDataFrame([("f", 1, 12, 0), ("f", 1, 15, 1), ("f", 2, 5, 2), ("g", 1, 30, 0)], "file string, q int, votes int, pos int")
    assert rows(dedup.voted_first(votes, "votes", 10, "q", "file", "pos"), "file", "q", "votes") == [("f", 1, 12), ("g", 1, 30)]


def test_steps(spark, tmp_path):
    def write(value):
        return lambda s, path, inputs: s.createDataFrame([(value + sum(s.read.parquet(p).first()[0] for p in inputs),)], "v int").write.parquet(path)

    one = steps.Step("one", write(1), {"v": 1})
    two = steps.Step("two", write(10), {"v": 10}, (one,))
    other = steps.Step("other", write(0))
    base = str(tmp_path)
    assert steps.run(spark, [two, other], base, only="two", dry=True) == ["one", "two"] and steps.run(spark, [two], base) == ["one", "two"]
    assert steps.run(spark, [two, other], base) == ["other"] and spark.read.parquet(two.path(base)).first()[0] == 11
    changed = steps.Step("one", write(1), {"v": 2})
    assert changed.version() != one.version() and steps.Step("two", write(10), {"v": 10}, (changed,)).version() != two.version()
    loop = steps.Step("loop", write(0))
    object.__setattr__(loop, "inputs", (loop,))
    with pytest.raises(ValueError):
        steps.ordered([loop])


def test_classifier_on_held_out_texts(spark):
    rng = np.random.default_rng(11)
    bad = [f"bad{i}" for i in range(12)]
    rows = []
    for i in range(1200):
        words = [f"w{int(rng.zipf(1.3)) % 3000}" for _ in range(int(rng.integers(20, 200)))]
        toxic = int(rng.random() < 0.1)
        if toxic:
            words[:: max(1, len(words) // 4)] = rng.choice(bad, len(words[:: max(1, len(words) // 4)])).tolist()
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = classify.LinearModel.fit(docs.where("doc_id < 800"), "text", "toxic", "doc_id", balanced=True)
    got = classify.predictions(docs.where("doc_id >= 800"), model, "doc_id", "text").join(docs, "doc_id").collect()
    assert np.mean([(r.score > 0.5) == bool(r.toxic) for r in got]) > 0.97 and np.mean([r.score > 0.5 for r in got if r.toxic]) > 0.9
