import pytest
from pyspark.sql import functions as F

from millrace.functions import hashing, text
from millrace.operators import bloom, classify, consolidate, conversations, dedup, overlap, training, validate

FOX = "The quick brown fox\njumps over the lazy dog\nand runs away"


def values(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def one(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_text_functions(spark):
    assert one(spark, text.clean_text(F.col("t")), [("  Hello,\tWORLD!! ",), (None,)], "t string") == ["hello world", None]
    assert one(spark, text.ngrams(text.words(F.col("t")), 3, 1), [("a b c d e",), ("a b",)], "t string") == [["a b c", "c d e"], []]
    assert one(spark, text.char_shingles(F.col("t"), 3), [("abcab",), ("ab",), ("",)], "t string") == [["abc", "bca", "cab"], ["ab"], []]
    assert one(spark, text.remove_spans(F.col("t"), F.array(F.struct(F.lit(4).alias("begin"), F.lit(6).alias("end")), F.struct(F.lit(0).alias("begin"), F.lit(2).alias("end")))), [("aé😀dxyz",)], "t string") == ["😀dz"]
    assert one(spark, text.normalised_extension(F.col("t")), [(" PY ",), (".md",), ("",)], "t string") == [".py", ".md", None]


def test_word_ngrams_of_every_document(spark, tmp_path):
    from millrace.plans import catalog

    texts = ["a b c d e f g", " ".join(f"w{i}" for i in range(300)), "a b c", None]
    rows = [(i, t, None if i == 0 else len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    words = [(t or "").split() for t in texts]
    want = sorted((i, at + 1, " ".join(w[at : at + 4])) for i, w in enumerate(words) for at in range(0, len(w) - 3, 2))
    assert values(catalog.queries()["word_ngrams"](spark, str(tmp_path)), "doc_id", "pos", "gram") == want


def test_hash_vectors(spark):
    got = spark.createDataFrame([("hello",)], "t string").select(hashing.xxh3_64("t"), hashing.xxh3_128("t")).first()
    assert int(got[0]) == 10760762337991515389 and int(got[1], 16) == 241804000618833338782870102822322583576


def test_exact_and_fuzzy_documents(spark):
    rows = [(1, FOX), (2, FOX), (3, FOX), (4, "Something else entirely, with other words"), (5, FOX + "."), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert values(dedup.exact_documents(docs), "doc_id", "exact_duplicate") == [(1, False), (2, True), (3, True), (4, False), (5, False), (6, False)]
    fuzzy = dict(values(dedup.fuzzy_documents(docs), "doc_id", "component"))
    assert fuzzy[2] == fuzzy[3] == fuzzy[5] == 1 and fuzzy[4] == 4 and fuzzy[6] == 6


def test_lsh_buckets_match_plain_minhash(spark, monkeypatch):
    import hashlib
    import random

    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeéß😀", k=rng.randint(1, 9))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=n)) for n in (1, 3, 40, 400, 900)] + ["abcd", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def buckets(text, permutations, bands):
        shingles = {text[i : i + 5] for i in range(max(1, len(text) - 4))} if text else set()
        hashes = [sum(ord(c) * f for c, f in zip(x, dedup.shingle_factors(5))) % dedup.MODULUS for x in shingles]
        least = [min(((h * a + b) % dedup.MODULUS for h in hashes), default=dedup.MODULUS) for a, b in map(dedup.permutation, range(permutations))]
        rows = permutations // bands
        return [(band, hashlib.md5(",".join(map(str, least[band * rows : (band + 1) * rows])).encode()).hexdigest()) for band in range(bands)]

    monkeypatch.setattr(dedup, "ROWS", 100)
    for options, setting in (({}, (286, 26)), ({"permutations": 20, "bands": 5}, (20, 5))):
        want = sorted((i, *b) for i, t in enumerate(texts) if t is not None for b in buckets(t, *setting))
        assert values(dedup.lsh_buckets(docs, **options), "doc_id", "band", "bucket") == want
    # The share of equal values estimates the similarity of the sets.
    letters = [chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(6000)]
    one, two = dedup.minhash_batch(["".join(letters[:4000]), "".join(letters[1000:5000])], 5, 1000)
    assert abs((one == two).mean() - 2996 / 4996) < 0.05


def test_unrelated_prose_is_no_fuzzy_duplicate(spark):
    import random

    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 6))) for _ in range(120)]
    rows = [(i, " ".join(rng.choices(words, k=400))) for i in range(60)]
    rows += [(60 + i, rows[i][1] + " and more") for i in range(5)]
    got = dict(values(dedup.fuzzy_documents(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "component"))
    assert got == {i: i - 60 if i >= 60 else i for i in range(65)}


def test_paragraph_spans_and_removal(spark):
    docs = spark.createDataFrame([(1, "ém\nb"), (2, "x\nb\ny"), (3, "b")], "doc_id long, text string")
    spans = dedup.exact_paragraphs(docs)
    assert values(spans, "doc_id", "begin", "end") == [(2, 2, 3), (3, 0, 1)]
    assert values(consolidate.without_spans(docs, spans, "doc_id"), "doc_id", "text") == [(1, "ém\nb"), (2, "x\n\ny")]
    counts = dedup.hash_counts(dedup.paragraphs(docs), "hash", "doc_id")
    assert tuple(dedup.duplicate_counters(counts).first()) == (6, 3, 3, 1)


def test_overlap(spark):
    docs = spark.createDataFrame([(1, "p q r s t u"), (2, "none of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "q r s x y z")], "item_id long, text string")
    got = values(overlap.ngram_overlap(docs, bench, 3, "doc_id", "text", "item_id", "text"), "doc_id", "begin", "end", "score")
    assert got == [(1, 0, 11, 0.25)]


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_overlap_of_short_paragraphs_and_large_references(spark, monkeypatch, bound):
    monkeypatch.setattr(overlap, "MOST_BROADCAST_FEATURES", bound)
    docs = spark.createDataFrame([(1, "é x\n\nshort one\np q r s"), (2, "short two\nq r s t"), (3, None), (4, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "short one\nq r s z\n\n"), (8, None)], "item_id long, text string")
    got = values(overlap.ngram_overlap(docs, bench, 3, "doc_id", "text", "item_id", "text"), "doc_id", "begin", "end", "score")
    assert got == [(1, 5, 14, 1.0), (1, 15, 22, 0.5), (2, 10, 17, 0.5)]
    assert values(overlap.exact_overlap(docs, bench, "doc_id", "text", "text"), "doc_id", "begin", "end") == [(1, 5, 14)]
    matrix = overlap.contamination_matrix(docs, bench, 3, "doc_id", "item_id", "text", "text")
    assert values(matrix, "train", "overlapping") == [("1", 1), ("2", 1), ("union", 1)]


@pytest.mark.parametrize("bound", [16 << 20, 0])
def test_bloom_filters(spark, monkeypatch, bound):
    monkeypatch.setattr(bloom, "MOST_BROADCAST_BYTES", bound)
    keys = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("k"))
    one, two = (bloom.Bloom.build(keys(*r), "k", 2000).stored() for r in ((0, 1000), (500, 1500)))
    asked = dict(values(one.ask(keys(0, 11_000), "k"), "k", "may_contain"))
    assert all(asked[str(i)] for i in range(1000)) and sum(asked[str(i)] for i in range(1000, 11_000)) < 100
    both, shared = one | two, one & two
    assert one.issubset(both) and two.issubset(both) and not both.issubset(one) and shared.issubset(one) and shared.issubset(two)
    assert all(v for _, v in values(both.ask(keys(0, 1500), "k"), "k", "may_contain")) and all(v for _, v in values(shared.ask(keys(500, 1000), "k"), "k", "may_contain"))
    assert max(one.bits(), two.bits()) <= both.bits() <= one.bits() + two.bits()
    assert [r.may_contain for r in one.ask(spark.createDataFrame([(None,)], "k string"), "k").collect()] == [False]
    with pytest.raises(ValueError):
        one | bloom.Bloom.build(keys(0, 10), "k", 100_000)


def test_thresholds(spark):
    docs = spark.createDataFrame([(i,) for i in range(1, 5)], "doc_id long")
    scores = spark.createDataFrame([(1, 0.1), (2, 0.4), (3, 0.7)], "doc_id long, s double")
    keep = lambda *t: values(consolidate.keep(docs, scores, list(t), "doc_id"), "doc_id")
    assert keep(consolidate.Threshold("s", lower=0.4)) == [(2,), (3,)]
    assert keep(consolidate.Threshold("s", lower=0.4, upper=0.5, reverse=True)) == [(1,), (3,)]
    with pytest.raises(ValueError):
        consolidate.Threshold("s", lower=0.1, keep_fraction=0.5)


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "yes"), (1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    chat = conversations.gathered(turns).select(conversations.as_text(F.col("messages"))).first()[0]
    assert chat == "user: hi\n\nassistant: yes"
    asked = spark.createDataFrame([("2+2?", ["3", "4"], 1)], "q string, o array<string>, a long")
    got = asked.select(conversations.choice_prompt(F.col("q"), F.col("o")), conversations.choice_response(F.col("o"), F.col("a"))).first()
    assert tuple(got) == ("2+2?\nA. 3\nB. 4\nAnswer:", "B. 4")
    index = conversations.answer_index(F.col("o"), F.array(F.lit("A"), F.lit("B")), F.lit("B"))
    assert asked.select(index).first()[0] == 1


def test_packs_and_chunks(spark):
    lengths = spark.createDataFrame([("s", i, n) for i, n in enumerate([100, 200, 150, 150])], "g string, id int, n long")
    assert values(training.greedy_packs(lengths, 300, 64, ["g"], "id", "n"), "pack", "documents", "tokens") == [(0, 2, 300), (1, 2, 300)]
    with pytest.raises(ValueError):
        training.greedy_packs(lengths, 120, 64, ["g"], "id", "n", allow_long=False)
    tokens = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, [4, 5, 6, 7])], "doc_id long, ids array<int>")
    assert values(training.sequence_chunks(tokens, 3), "chunk", "ids") == [(0, [1, 2, 3]), (1, [4, 5, 6])]


def test_epochs_follow_the_table(spark, tmp_path):
    from millrace.plans import catalog

    ids = [3 * i - 50 for i in range(1400)]
    spark.createDataFrame([(i, i % 90) for i in ids], "doc_id long, n_chars int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name, *columns: values(catalog.queries()[name](spark, str(tmp_path)), *columns)
    assert run("simulated_epoch", "idx") == [(i,) for i in range(350)]
    assert run("epoch_wrap", "position", "idx", "epoch", "n_chars") == [(p, p % 1400, p // 1400, ids[p % 1400] % 90) for p in range(3500)]


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permutations_are_bijective(spark, n):
    rows = spark.range(n)
    for column in (training.feistel_permutation(F.col("id"), n, (1, 2, 3, 4, 5)), training.linear_permutation(F.col("id"), n, 1009, 5), training.era_permutation(F.col("id"), n, 64, 1009, 5)):
        assert sorted(r[0] for r in rows.select(column).collect()) == list(range(n))


def test_advantage_and_statistics(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "g string, r double")
    assert values(training.leave_one_out_advantage(rows, ["g"], "r"), "g", "advantage") == [("a", -2.0), ("a", 2.0), ("b", 0.0)]
    assert values(validate.required_fields(rows, ["r", "x"]), "field", "missing") == [("r", 0), ("x", 3)]


def test_classifier_learns(spark):
    rows = [(i, ("good words here" if i % 2 else "junk spam noise") + f" w{i}", i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = classify.LinearModel.fit(docs, "text", "quality", "doc_id")
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in classify.predictions(docs, model, "doc_id", "text").collect())
