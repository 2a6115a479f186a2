"""The pipeline against the stages' plain versions, on a small fixture."""

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from millrace.llm import mixing, pii, sentencepieces  # noqa: E402

from .test_operators import brute_texts, counts  # noqa: E402


def test_pipeline(spark, tmp_path):
    good = lambda i: " ".join(f"w{(i * 37 + j * 11) % 997}x{i}" for j in range(30))
    rows = [(i, good(i), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, good(i) + " mail a@b.cd", "en", "s0", 0) for i in range(20)] + [(200, "too short", "en", "s1", 0), (201, None, None, None, None), (202, good(70) + " mail a@b.cd", "de", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [r for r in rows if counts(r[1])[0] >= 10]
    component = brute_texts([(r[0], r[1]) for r in kept], 5, 80)
    kept = [r for r in kept if component[r[0]][1] == r[0]]
    redacted = [(r[0], pii.redact(r[1], pii.find(r[1])), r[2], r[3], r[4]) for r in kept]
    times = {r.doc_id: r.taken // r["size"] for r in mixing.mix(spark.createDataFrame(redacted, docs.schema)).collect()}
    codec = sentencepieces.codec(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    want = sorted((r[0], codec.model.encode(r[1])) for r in redacted for _ in range(times[r[0]]))
    got = sorted((r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and len(got) > 60


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path, k):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, size double, ids string"
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    long = "a very long text of many words " * 3000
    rows = [(1, None, None, None, None, None, None, None), (None, "some words of no id but more than ten of them in one row", "en", None, 3, "k", 1.0, "x")] * 2
    rows += [(2, "", "en", "s", 0, "k", 1.0, "x"), (3, long, "en", "s", 9, "k", 1.0, "x"), (3, "another text of the same id with more than ten words in it", "en", "s", 9, "k", 1.0, "x")]
    docs = spark.createDataFrame(rows, schema)
    for frame in (docs, docs.limit(0)):
        out = corpus_pipeline.STAGES[k][1](spark, frame, str(tmp_path))
        found = out.collect()
        assert out.columns == (docs.columns if k < 4 else ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256", "n_covered_bytes"])
        if frame is docs:
            assert len(found) == {0: 3, 1: 6, 2: 7, 4: 7}.get(k, len(found)) and (k != 3 or {r.doc_id for r in found} <= {None, 3})
        else:
            assert not found


def test_stages_leave_nothing_behind(spark, tmp_path):
    import os

    text = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    spark.createDataFrame([(i, text(i), "en", "s", 9) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 30
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    newest = max((d for d in os.listdir(base) if d.startswith("pipeline-")), key=lambda d: os.path.getmtime(f"{base}/{d}"))
    assert os.listdir(f"{base}/{newest}") == ["3-mixing"]
