"""The ten operators on hand-made rows with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from millrace.llm import html_text, mixing, near_texts, near_vectors, pii, quality, repeats, sentencepieces, token_files, url_filter  # noqa: E402

LONG = "the quick brown fox jumps over the lazy dog and so on " * 400
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, ids string"
TEXTS = [None, "", " \n\t", "one", "A b\x0bC  d é\x85x", LONG, LONG, LONG + "tail", "mail a.b@c.de or +1 (555) 555-3824 now 4111 1111 1111 1111", "日本語 テキスト 😀", "x" * 5000, "a\nb\na\nb\n\n a"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None][i % 2], ["s1", "s2", None][i % 3], len(t or ""), 1, "k", "i") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id at all", None, None, None, None, None, None)], SCHEMA)


def by_id(frame, *columns):
    return sorted(((r[0], *(r[c] for c in columns)) for r in frame.collect()), key=repr)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def unioned(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# 1


def brute_repeats(docs, span=50):
    first = {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        for k in range(len(t) - span + 1):
            first.setdefault(t[k : k + span], i)
    out = {}
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - span + 1):
            if first[t[k : k + span]] < i:
                gone[k : k + span] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[i] = (len(t), int(gone.sum()), int((edges == 1).sum()), sha(np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


def repeats_digest(frame):
    return repeats.remove_repeats(frame, finish=repeats.digest, finish_ddl=repeats.DIGEST_DDL)


def test_repeats(spark, docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.where("doc_id is not null").collect()]
    want, got = brute_repeats(rows), repeats_digest(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    assert repeats_digest(docs.limit(0)).count() == 0


def test_repeats_at_edges(spark):
    rng = np.random.default_rng(3)
    base = [bytes(rng.choice(list(b"abcd "), int(rng.integers(30, 300)))).decode() for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [base[j][int(rng.integers(0, 20)) : int(rng.integers(40, 300))] for j in rng.integers(0, 6, int(rng.integers(0, 5)))]
        rows.append((i * 3, "".join(parts) + "a" * int(rng.integers(0, 120))))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_repeats([(i, t.encode()) for i, t in rows])


def test_repeats_of_rows_that_share_an_id(spark):
    one, two, three = ("".join(f"{w}{i} " for i in range(40)) for w in "abc")
    rows = [(4, one + "x"), (4, one + two), (4, one + "x"), (6, two + "y"), (None, one + three), (None, three), (2, "z" + three[:80])]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in repeats_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [("2", 81, 0), ("4", len(one) + 1, 0), ("4", len(one) + 1, 0), ("4", len(one + two), 0), ("6", len(two) + 1, len(two)), ("None", len(one + three), len(one) + 80), ("None", len(three), 80)]
    assert got == sorted(want)


def test_repeats_keep_bytes_and_spans(spark):
    shared = "".join(chr(97 + i % 23) for i in range(70))
    rows = spark.createDataFrame([(1, shared), (2, "x" + shared + "y")], "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), [tuple(s) for s in r.spans]) for r in repeats.remove_repeats(rows).collect()}
    assert got == {1: (shared.encode(), []), 2: (b"xy", [(1, 71)])}


def test_long_text_is_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 300)
    import pyarrow as pa

    rows = [(0, bytes(range(1, 120)) * 9), (5, bytes(range(1, 120)) * 12), (7, b"q" * 1000)]
    batch = repeats.Batch(pa.table({"id": pa.array([0, 5, 7]), "text": pa.array([t for _, t in rows], pa.binary())}), 1)
    answers = repeats.answer(repeats._sent(0, batch.entries, 0))
    batch.decide(repeats._bits(answers, 0, "dup", batch.entries), repeats._bits(answers, 0, "several", batch.entries))
    answers = pa.concat_tables([answers, repeats.answer(repeats._sent(0, batch.suffixes(), 1))])
    got = {r["id"]: tuple(r.values())[1:] for r in repeats.digest(batch, repeats.removed_runs(batch, answers)).to_pylist()}
    assert got == brute_repeats(rows)


# 2


def brute_vectors(rows, cosine=0.95):
    fine = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in fine.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    component = unioned([i for i, _ in rows], links)
    degree = Counter(x for pair in links for x in pair)
    return {i: (degree[i], component[i]) for i, _ in rows}


def test_near_vectors(spark):
    rng, rows = np.random.default_rng(1), []
    for i in range(60):
        base = rng.standard_normal(64)
        rows += [(5 * i + k, (base + 0.01 * k * rng.standard_normal(64)).tolist()) for k in range(4)]
    rows += [(1000 + i, (rows[0][1] + 0.003 * rng.standard_normal(64)).tolist()) for i in range(600)]
    rows += [(2001, None), (2002, [0.0, 0.0]), (2003, [1.0, float("nan")]), (2004, [1.0, 2.0]), (2005, [2.0, 4.0]), (2006, [1.0, None]), (2007, [])]
    frame = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<double>, component_id string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_duplicates(frame).collect()}
    assert got == brute_vectors(rows)
    assert near_vectors.near_duplicates(frame.limit(0)).count() == 0


# 3


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    g = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if g[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def brute_rows(rows, cosine=0.95):
    """Links and the least id of the component of every row, rows being vectors of their own."""
    plain = brute_vectors([(k, v if i is not None else None) for k, (i, v) in enumerate(rows)], cosine)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[plain[k][1]].append(i)
    return sorted(((str(i), plain[k][0], min(least[plain[k][1]]) if i is not None else None) for k, (i, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("bound", [250_000, 0])
def test_near_vectors_of_repeated_and_missing_ids(spark, monkeypatch, bound):
    monkeypatch.setattr(near_vectors, "MOST_BROADCAST", bound)
    monkeypatch.setattr(near_vectors, "CHUNK", 8)
    monkeypatch.setattr(near_vectors, "CROWD", 5)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 16))
    rows = []
    for i in range(300):
        v = base[i % 12] + rng.standard_normal(16) * (0.0 if i % 3 == 0 else 0.12)
        rows.append((int(rng.integers(0, 150)) if i % 10 else None, [float(x) for x in v]))
    rows += [(7, [0.0] * 16), (7, [-0.0, 1.0] + [0.0] * 14), (400, [0.0, 1.0] + [0.0] * 14), (401, [0.0, 2.0] + [0.0] * 14), (402, None), (403, [1.0]), (404, [1.0, float("nan")])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, vector string")
    got = sorted(((str(r.vec_id), r.n_links, r.component_id) for r in near_vectors.near_duplicates(frame).collect()), key=repr)
    assert got == brute_rows(rows)
    assert near_vectors.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("length", [8, 64])
def test_near_vectors_just_at_the_threshold(spark, length):
    rng = np.random.default_rng(length)
    rows = []
    for k in range(1500):
        one, turn = rng.standard_normal((2, length))
        one /= np.linalg.norm(one)
        turn -= (turn @ one) * one
        turn /= np.linalg.norm(turn)
        for n, cosine in enumerate((1.0, 0.9500001, 0.9499999)):
            rows.append((10 * k + n, cosine * one + np.sqrt(1 - cosine**2) * turn * (1 if n < 2 else -1)))
    unit = np.stack([v / np.linalg.norm(v) for _, v in rows])
    ids = np.array([i for i, _ in rows])
    want = dict(zip(ids.tolist(), ((unit @ unit.T >= 0.95).sum(axis=1) - 1).tolist()))
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in near_vectors.near_duplicates(frame).collect()}
    missed = sum(max(0, want[i] - got[i]) for i in want)
    assert all(got[i] <= want[i] for i in want) and missed <= 2


def test_quality_counts_and_guarantee(spark, docs):
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 1)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)  # too few labels for any cutoff
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert quality.good_documents(docs, labels).columns == docs.columns


def test_quality_cutoffs_learned(spark):
    words = " ".join(f"word{j}" for j in range(12))
    rows = [(i, (words + f" n{i}").replace(" ", "### ") if i % 4 == 0 else words + f" n{i}", "en") for i in range(6000)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(6000)], "doc_id long, quality int")
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).groupBy((F.col("doc_id") % 4 == 0).alias("bad"), "kept").count().collect()
    assert {(r.bad, r.kept): r["count"] for r in got} == {(True, False): 1500, (False, True): 4500}


@pytest.mark.parametrize("bound", [50_000, 0])
def test_quality_judges_every_stratum_by_its_own_labels(spark, monkeypatch, bound):
    monkeypatch.setattr(quality, "MOST_BROADCAST_STRATA", bound)
    words = " ".join(f"word{j}" for j in range(12))
    long = words.replace("word", "wordwithoutanyspaces")
    # "xx" has no labels, "yy" and "zz" few of them; the 300 small languages have 10 each and keep to the cutoffs.
    rows = [(i, f"{words} n{i}", "en") for i in range(12_000)]
    rows += [(20_000 + i, f"{long} n{i}", lang) for lang, first, n in (("xx", 0, 20), ("yy", 20, 2), ("zz", 30, 1)) for i in range(first, first + n)]
    rows += [(30_000 + i, f"{words} r{i}", f"small{i % 300}") for i in range(3000)]
    rows += [(40_000, f"{long} e", "en")]
    labels = spark.createDataFrame([(r[0], 1) for r in rows if r[2] != "xx" and r[0] != 40_000], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r.doc_id for r in quality.judge(docs, labels).where("not kept").collect()] == [40_000]
    assert quality.good_documents(docs, labels).count() == len(rows) - 1


def test_quality_verdicts_against_plain_python(spark):
    import math

    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(9000):
        lang, good = ["en", "de", None][i % 3], rng.random() < 0.8
        word = lambda: "w" * int(rng.integers(2, 9 if good else 25)) + str(int(rng.integers(0, 9999)))
        n = int(rng.integers(8, 40))
        words = [word() + ("#" * int(rng.integers(0, 2 if good else 4))) for _ in range(n)]
        rows.append((i, " ".join(words), lang))
        if lang != "de" or i % 5 == 0:
            labels.append((i, int(good)))
    measured = {}
    for i, text, lang in rows:
        n_words, word_chars, n_symbols, n_dup, n_repeat = counts(text)
        share = lambda a, b: a / b if b else 0.0
        lines = len([x for x in text.split("\n") if x.strip()])
        measured[i] = (lang, n_words < 10 or 100 * n_repeat > 20 * n_words, {"symbols_per_word": share(n_symbols, n_words), "chars_per_word": share(word_chars, n_words), "dup_line_share": share(n_dup, lines), "repeat_share": share(n_repeat, n_words)})
    good = [measured[i] for i, q in labels if q == 1 and not measured[i][1]]
    strata, p = {g[0] for g in good}, quality.TOLERATED / len(quality.CUTOFFS)
    limit, cut = quality.FAILURE / len(quality.CUTOFFS) / len(strata), {}
    for lang in strata:
        own = [g[2] for g in good if g[0] == lang]
        for m, steps in quality.CUTOFFS.items():
            for c in steps:
                k, n = sum(x[m] > c for x in own), len(own)
                if k >= n * p or sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) > limit:
                    break
                cut[lang, m] = c
    want = {i: not failed and not any(v > cut.get((lang, m), math.inf) for m, v in x.items()) for i, (lang, failed, x) in measured.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    assert {r.doc_id: r.kept for r in quality.judge(docs, frame).collect()} == want
    rejected = sum(not k for i, k in want.items() if not measured[i][1])
    assert cut and 100 < rejected < 4000
    assert sorted(r.doc_id for r in quality.good_documents(docs, frame).collect()) == sorted(i for i, k in want.items() if k)


def test_binomial_tail(spark):
    import math

    exact = lambda k, n, p: sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
    rows = [(0, 1000), (2, 1000), (4, 1000), (3, 5000)]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.005).alias("p")).collect()
    assert all(r.p == pytest.approx(exact(r.k, r.n, 0.005)) for r in got)


# 4


def brute_texts(rows, width, percent):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])

    sets, index, links = {i: shingles(t) for i, t in rows}, defaultdict(list), []
    for i in sorted(sets):
        for j, both in Counter(j for s in sets[i] for j in index[s]).items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links.append((i, j))
        for s in sets[i]:
            index[s].append(i)
    component = unioned(list(sets), links)
    return {i: (len(sets[i]), component[i]) for i in sets}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_texts(spark, width, percent):
    rng = np.random.default_rng(width)
    word = lambda: "w" + str(int(rng.integers(0, 5000)))
    rows, hot = [(0, None), (1, ""), (2, "a b"), (3, "A  B"), (4, LONG)], [word() for _ in range(120)]
    for i in range(700):
        text = list(hot) if i % 2 else [word() for _ in range(int(rng.integers(3, 150)))]
        for _ in range(int(rng.integers(0, 5))):
            text[int(rng.integers(0, len(text)))] = word()
        rows.append((10 + i, " ".join(text)))
        if i % 7 == 0:
            rows.append((2000 + i, rows[-1][1].upper()))
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_shingles string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_texts.near_duplicates(frame, width=width, percent=percent).collect()}
    assert got == brute_texts(rows, width, percent)


def test_near_texts_that_share_a_passage(spark, monkeypatch):
    monkeypatch.setattr(near_texts, "SMALL", 16)
    monkeypatch.setattr(near_texts, "CROWD", 40)
    rng = np.random.default_rng(9)
    word = lambda: "w" + str(int(rng.integers(0, 50_000)))
    passage, rows = [word() for _ in range(60)], []
    for i in range(500):
        # Half of each text is a passage that all share; every tenth has a near copy.
        text = passage + [word() for _ in range(60)]
        rows.append((i, " ".join(text)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join(text[:-2] + [word(), word()])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    branched = []
    plain = near_texts.leaves
    monkeypatch.setattr(near_texts, "leaves", lambda *a, **k: branched.append(k) or plain(*a, **k))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_texts.near_duplicates(frame, width=3, percent=85).collect()}
    assert got == brute_texts(rows, 3, 85) and len(branched) == 2


def test_near_texts_odd_rows(spark, docs):
    got = near_texts.near_duplicates(docs).collect()
    assert len(got) == docs.count() and all(r.kept for r in got if r.doc_id is None)
    assert near_texts.near_duplicates(docs.limit(0)).count() == 0
    kept = near_texts.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 5, 8, 9, 10, 11]


def test_rows_that_share_an_id_but_not_a_text(spark):
    one, two, three = ("".join(f"{w}{i} " for i in range(60)) for w in "abc")
    rows = [(7, one, "x"), (7, two, "x"), (7, two, "y"), (8, two + "tail", "x"), (9, three, "x"), (3, three + "end", "x"), (3, "", "x"), (3, "", "x"), (4, None, "x"), (None, one, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __row string")
    got = near_texts.one_of_each(frame)
    assert got.columns == frame.columns
    kept = sorted(((r[0], r[1]) for r in got.collect()), key=repr)
    assert kept == sorted([(7, one), (7, two), (3, three + "end"), (3, ""), (4, None), (None, one)], key=repr)
    found = near_texts.near_duplicates(frame).collect()
    assert sorted((r.doc_id, r.component_id) for r in found if r.doc_id in (8, 9)) == [(8, 7), (9, 3)]


def test_words_of_any_length():
    text = ("y" * 3000 + " z ").encode() * 3 + b"end"
    assert (near_texts.word_hashes(text, piece=500) == near_texts.word_hashes(text)).all()


# 5


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("<p>a<p>b &amp; c<br>d", "a b & c d"), ("a < b <i>c</i>", "a < b c"), ("<script>x</script>y<!-- z", "y"),
    ('<div class="sidebar">x</div><article class="post">A <b>b</b>c<div class="comments">no</div><ul><li>1<li>2</ul><form><p>f</form>z</article>tail', "A bc 1 2 z"),
    ('<div><p class="ad"><b>x<p>real<span class=ad><span>a</span>b</span>c', "real c"), ("<article><h1>T</h1><p>x &am", "T x &am"), ("<article>\n a\t b <p", "a b"),
])
def test_html(html, text):
    assert (html_text.walk(html) if html else "") == text


def test_html_site_tree(spark):
    page = lambda i: f"<body><div class=top>Always the same words</div><div class=body><p>Text number {i} of many</div></body>"
    rows = [(i, f"http://one.example/{i}", page(i), 1) for i in range(40)] + [(100, None, page(0), 1), (101, "http://two.example/", None, 1), (101, "http://two.example/", page(7), 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = {(r.page_id, r.url): r.text for r in html_text.extract(frame).where("n_chars > 0").collect()}
    assert got[3, "http://one.example/3"] == "Text number 3 of many" and got[100, None] == "Text number 0 of many" and got[101, "http://two.example/"] == "Text number 7 of many"
    assert html_text.extract(frame).count() == 43 and html_text.extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize(("html", "text"), [
    ('<body class="single no-sidebar"><p>real text</p></body>', "real text"), ('<div class="content has-sidebar"><article>the article</article></div>', "the article"),
    ('<div class="header-image-post"><p>real</p></div>', "real"), ('<div class="site-footer">f</div><div class="comments-area">c</div><div class="main-nav">n</div><p>real', "real"),
    ('<section class="comments"><article class="comment">Nice!</article></section><article>the article</article>', "the article"),
    ('<div class="widget"><article>the one article of this page</article></div><p>tail</p>', "the one article of this page"),
    ('<div class="sidebar"><article>teaser</article></div><p>a text that is much longer than the teaser', "a text that is much longer than the teaser"),
    ("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>tail", "deep tail"), ("<p>word " * 20_000, " ".join(["word"] * 20_000)),
    ('<html class="menu"><body id="nav"><p>a</p><div class="ad"><div>x</div>y</div><p>b</body></html>', "a b"),
])
def test_html_classes_count_as_whole_words(html, text):
    assert html_text.walk(html) == text


def plain_trees(pages, least, low):
    """Texts of well-formed pages ``(id, host, html)`` by a plain style tree: no class means anything, paths are texts."""
    from html.parser import HTMLParser
    from math import log

    class Tree(HTMLParser):
        def __init__(self, html):
            super().__init__()
            self.stack, self.nodes, self.blocks = [], [], []
            self.feed(html)

        def handle_starttag(self, tag, attributes):
            node = {"path": (self.stack[-1]["path"] if self.stack else "") + f"/{tag}.{dict(attributes).get('class', '')}", "children": [], "first": len(self.blocks)}
            if self.stack:
                self.stack[-1]["children"].append(tag)
            self.nodes.append(node)
            self.stack.append(node)

        def handle_endtag(self, tag):
            self.stack.pop()["end"] = len(self.blocks)

        def handle_data(self, data):
            if data.split():
                self.blocks.append(" ".join(data.split()))

    trees = {i: (host, Tree(html)) for i, host, html in pages}
    scopes = [lambda h: h, lambda h: ".".join(h.split(".")[-2:]), lambda h: ""]
    seen = [defaultdict(lambda: (Counter(), Counter())) for _ in scopes]
    content = lambda t, n: tuple(sorted(t.blocks[n["first"] : n["end"]]))
    for host, t in trees.values():
        for n in t.nodes:
            if n["end"] > n["first"] and n["path"] not in ("/html.", "/html./body."):
                for scope, table in zip(scopes, seen):
                    contents, shapes = table[scope(host), n["path"]]
                    contents[content(t, n)] += 1
                    shapes[tuple(n["children"])] += 1

    def share(counter):
        total = sum(counter.values())
        return (log(total) - sum(n * log(n) for n in counter.values()) / total) / log(total) if total > 1 else 1.0

    out = {}
    for i, (host, t) in trees.items():
        gone, size = set(), sum(map(len, t.blocks))
        for n in t.nodes:
            if n["end"] > n["first"] and n["path"] not in ("/html.", "/html./body."):
                found = next((c for scope, table in zip(scopes, seen) if sum((c := table[scope(host), n["path"]])[0].values()) >= least), None)
                if found and (share(found[0]) + share(found[1])) / 2 < low:
                    times = found[0][content(t, n)]
                    if times > 1 and times >= 0.01 * sum(found[0].values()) and 2 * sum(map(len, t.blocks[n["first"] : n["end"]])) <= size:
                        gone |= set(range(n["first"], n["end"]))
        out[i] = " ".join(b for k, b in enumerate(t.blocks) if k not in gone)
    return out


def test_html_against_plain_trees(spark):
    rng = np.random.default_rng(6)
    pick = lambda *x: x[int(rng.integers(0, len(x)))]
    pages = []
    for i in range(600):
        host = pick("www.big.example", "www.big.example", "a.mid.example", "b.mid.example", f"only{i}.one", f"h{i}.small.example")
        top = f"<div class='{pick('t1', 't1', 't2')}'><p>{pick('Welcome here', 'Welcome here', 'Welcome here', f'Hello {i}')}</p></div>" if rng.random() < 0.9 else ""
        text = "".join(f"<p>{pick('same words again', *(f'w{int(rng.integers(0, 50))} x{i} y{j}' for j in range(8)))}</p>" for _ in range(int(rng.integers(1, 6))))
        low = f"<div class='b'><div>{pick('All rights', 'All rights', 'No rights')}</div><div>{pick('Made by us', f'page {i}')}</div></div>"
        pages.append((i, host, f"<html><body>{top}<div class='c'>{text}</div>{low if rng.random() < 0.95 else ''}</body></html>"))
    frame = spark.createDataFrame([(i, f"http://{h}/{i}", x) for i, h, x in pages], "page_id long, url string, html string")
    for least, low in ((20, 0.1), (5, 0.3), (20, 0.5)):
        want = plain_trees(pages, least, low)
        assert {r.page_id: r.text for r in html_text.extract(frame, least_seen=least, low=low).collect()} == want
    assert sum("Welcome here" in x for x in want.values()) < 100


@pytest.mark.parametrize("bound", [16 << 20, 0])
def test_html_hosts_are_salted(spark, monkeypatch, bound):
    monkeypatch.setattr(html_text, "MOST_BROADCAST_BYTES", bound)
    rows = [(i, f"http://one.example/{i}", f"<div class=x>same old</div><p>text number {i} of a host</p>") for i in range(300)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(i, f"text number {i} of a host") for i in range(300)]


@pytest.mark.parametrize("frame", ["<body><h1>Site</h1><div class=entry><p>{}</p></div></body>", "<body><article><h1>Site</h1><div class=entry><p>{}</p></div></article></body>"])
def test_html_keeps_what_one_page_has(spark, frame):
    page = lambda i: frame.format(f"Article number {i} of few" if i % 20 == 0 else "This page cannot be shown")
    pages = spark.createDataFrame([(i, f"http://one.example/{i}", page(i)) for i in range(1000)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert len(got) == 1000 and all(f"Article number {i} of few" in got[i] for i in range(0, 1000, 20))
    assert frame.startswith("<body><article>") or "Site" not in got[0]


# 6


def test_token_files(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    rows = docs.collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, len(ids := [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in rows)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.through_files(docs, path).collect())
    assert [(d is not None, d or 0, n, c) for _, d, n, c in got] == want
    assert [s for s, *_ in got] == np.cumsum([0, *(n for *_, n, _ in got)])[:-1].tolist()
    assert token_files.through_files(docs.limit(0), path).count() == 0


def test_word_encoder_gives_the_ids_of_the_library(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(path), np.random.default_rng(2)
    parts = ["a", "word", "it's", "we'll", "don't", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "Ünder", "日本", "🙂", "12", "3.5", "!!", "...", ",", "<|endoftext|>", "<|end", "\x01", "\x02", "\u00a0", "\u0301", "'", "'s", "x" * 30]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 25)))) for _ in range(10_000)]
    encoder = token_files.WordEncoder(path, most_words=400)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        offsets, ids = encoder(pa.array(part), 0)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in part]


def test_token_files_are_pruned_and_ordered(spark, tmp_path):
    path, files = public_tokenizers.path("byte_bpe_50k.json"), f"{tmp_path}/tokens"
    rows = [(i // 2 if i < 400 else None if i < 2400 else i, f"text number {i} " * (1 + i % 30)) for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    token_files.write_token_files(docs, files, path, file_bytes=100_000)
    back = token_files.read_token_files(spark, files)
    assert back.inputFiles() and len(back.inputFiles()) > 20
    # Equal ids are dealt over files; files and starts agree.
    each = back.select("doc_id", F.input_file_name().alias("file"), "ids").collect()
    by_file = Counter(r.file for r in each if r.doc_id is None)
    assert sum(by_file.values()) == 2000 and len(by_file) > 1
    got = sorted((r.start, r.n_tokens) for r in token_files.digests(back).collect())
    assert [s for s, _ in got] == np.cumsum([0, *(n for _, n in got)])[:-1].tolist()
    tokenizer = __import__("tokenizers").Tokenizer.from_file(path)
    stream = [i for name in sorted({r.file for r in each}) for r in sorted((r for r in each if r.file == name), key=lambda r: (r.doc_id is not None, r.doc_id or 0)) for i in r.ids]
    assert len(stream) == sum(n for _, n in got)
    wanted = back.where("doc_id = 7777")
    assert "EqualTo(doc_id,7777)" in wanted._jdf.queryExecution().toString()
    assert [list(r.ids) for r in wanted.collect()] == [[*tokenizer.encode(rows[7777][1], add_special_tokens=False).ids, 0]]
    # Of some thirty files a reader takes no more than the one that may hold the id.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = back.where("doc_id = 7777").select("ids")._jdf.queryExecution().executedPlan()
    spark.conf.unset("spark.sql.adaptive.enabled")
    plan.executeCollect()
    read = plan.collectLeaves().head().metrics().apply("numOutputRows").value()
    assert 0 < read <= 1000, read


def test_token_files_over_part_numbers_of_six_digits(spark, tmp_path):
    frame = spark.createDataFrame([(1, 0, "x/part-99999-a.orc", [1, 2]), (2, 0, "x/part-100000-a.orc", [3]), (3, 0, "x/part-100001-a.orc", [4])], "doc_id long, text_hash long, file string, ids array<int>")
    named = frame.withColumn("_metadata", F.struct(F.col("file").alias("file_path")))
    assert sorted((r.doc_id, r.start) for r in token_files.digests(named).collect()) == [(1, 0), (2, 2), (3, 3)]


def test_token_files_with_an_added_token(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    text = "a <|endoftext|> b"
    ids = [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 0]
    got = token_files.through_files(spark.createDataFrame([(1, text)], "doc_id long, text string"), path).collect()
    assert 50256 in ids and [(r.n_tokens, r.ids_crc32) for r in got] == [(len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))]


# 7


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    assert sum(r.taken for r in got) <= 1.5 * sum(r["size"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_mixing_nears_targets(spark):
    rows = [(i, "w " * (1 + i % 40), f"s{i % 5}") for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 0.02 * r.target for r in got)


# 8


def test_url_filter(spark):
    urls = [None, "no scheme", "http://A.Example.NET/en/x?q#f", "http://x.net", "http://x.net/", "http://fr.org/fr/", "https://example.com/de/1", "http://m.casino-win.example.com/de", "http://free-bets.example.org?x", "http://ok.example.com/a/b/c", "http:///p"]
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(frame, url_filter.default_list(spark)).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[3] == ("x.net", "", None, "allow") and got[4][2:] == ("net/", "block")
    assert got[5][2:] == ("org/fr/", "allow") and got[6][2:] == ("example.com/de/", "block") and got[7][3] == got[8][3] == "block" and got[9][3] == "allow"
    assert url_filter.judge(frame.limit(0), url_filter.default_list(spark)).count() == 0
    assert url_filter.judge(frame, url_filter.default_list(spark).limit(0)).where("rule is null and verdict = 'block'").count() == 0


@pytest.mark.parametrize("bound", [0, 1 << 24])
def test_url_filter_large_lists_are_shuffled(spark, monkeypatch, bound):
    monkeypatch.setattr(url_filter, "MOST_BROADCAST_BYTES", bound)
    listed = spark.createDataFrame([(f"http://site{i}.test/a/",) for i in range(0, 3000, 2)], "url string")
    urls = spark.createDataFrame([(f"http://www.site{i}.test/a/b/{i}",) for i in range(3000)] + [("http://site0.test/b",)], "url string")
    assert sorted(r[0] for r in url_filter.listed_urls(urls, listed).collect()) == sorted(f"http://www.site{i}.test/a/b/{i}" for i in range(0, 3000, 2))


# 9


@pytest.mark.parametrize("bound", [16 << 20, 0])
def test_url_filter_against_plain_python(spark, monkeypatch, tmp_path, bound):
    monkeypatch.setattr(url_filter, "MOST_BROADCAST_BYTES", bound)
    rng = np.random.default_rng(4)
    pick = lambda *x: str(rng.choice(x))
    host = lambda: ".".join(pick("a", "b", "ads", "x-y") for _ in range(int(rng.integers(0, 4)))) + pick("", ".") + pick("com", "de")
    path = lambda: "".join(pick("/", "//") + pick("p", "q", "r s", "") for _ in range(int(rng.integers(0, 5))))
    listed = [None, "", "no scheme", "http://"] + [f"http://{host()}{path()}" for _ in range(25)]
    (tmp_path / "list.txt").write_text("# listed\n" + "\n".join(x or "" for x in listed))
    urls = [f"{pick('http', 'HTTPS')}://{host().upper() if i % 3 else host()}{path()}{pick('', '?q=/p', '#f')}" for i in range(1500)]
    urls += ["http://a.com/" + "p/" * 500_000, "http://" + "a." * 200_000 + "com", None] + ["http://ads.com/p/q"] * 3000

    def parts(url):
        rest = url.split("://", 1)[1] if "://" in (url or "") else ""
        own = re.match("[^/?#]*", rest)[0]
        return own.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), [x for x in re.match("[^?#]*", rest[len(own) :])[0].split("/") if x]

    known = [parts(x) for x in listed if "://" in (x or "")]

    def covered(url):
        at, below = parts(url)
        return bool(at) and any((h or p) and (at == h or at.endswith("." + h)) and below[: len(p)] == p for h, p in known if h)

    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(frame, url_filter.read_list(spark, str(tmp_path / "list.txt")), rules=()).collect()}
    want = {u: "block" if covered(u) else "allow" for u in set(urls)}
    assert got == {i: want[u] for i, u in enumerate(urls)} and 100 < sum(v == "block" for v in want.values()) < len(want)


def test_pii_base_spans_match_plain_patterns():
    import random

    email, ip, card, phone = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))
    digits = lambda x: re.sub("[^0-9]", "", x)

    def plain(t):
        out = [("email", *m.span()) for m in email.finditer(t)]
        out += [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [("card", *m.span()) for m in card.finditer(t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        return out + [("phone", *m.span()) for m in phone.finditer(t) if 9 <= len(digits(m[0])) <= 15]

    r = random.Random(3)
    parts = ["1", "22", "333", ".", "-", " ", "@", "a", "b.c", "+", "(", "%", "4111111111111111", "1.2.3.4", "x@y.z", "é", "+1 (2", "0" * 30]
    for _ in range(20_000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 22)))
        assert plain(t) == pii.base_spans(t)
    for t in ("9" * 50_000, "a" * 50_000 + "@", "1." * 30_000, "+1" * 30_000):
        assert plain(t[:3000]) == pii.base_spans(t[:3000]) and pii.base_spans(t) is not None


def test_pii_validators_and_context():
    assert [s.kind for s in pii.find("iban GB82 WEST 1234 5698 7654 32 ok")] == ["iban"] and pii.find("iban GB83 WEST 1234 5698 7654 32 ok") == []
    assert [s.kind for s in pii.find("her ssn is 123-45-6789")] == ["ssn"] and pii.find("part 123-45-6789 of it") == []
    assert pii.redact("to a@b.cd!", pii.find("to a@b.cd!")) == "to <EMAIL>!"


@pytest.mark.parametrize("n", [16, 128, 129, 200, 5000])
def test_pii_secret_is_covered_whole(n):
    text = f"api_key = '{('a1B2' * n)[:n]}' end"
    assert [(s.begin, s.end) for s in pii.find(text) if s.kind == "secret"] == [(11, 11 + n)]
    assert pii.redact(text, pii.find(text)) == "api_key = '<SECRET>' end"


def test_pii_added_spans_match_plain_patterns():
    import random

    r = random.Random(8)
    parts = ["GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00", "GB83WEST12345698765432", "XX22ABCD12345678", "123-45-6789", "000-12-3456", "666-45-6789", " ssn ", " my account ", " isbn ", " hotel ", "token=", "Abcdef0123456789xyz", " password: 'abcdefgh12345678' ", " dummy ", " ", "-", "x", ", ", " the word and the next one is long enough to push words away "]
    iban, ssn = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.A), re.compile(r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])", re.A)
    secret = re.compile(r"""\b(?:token|secret|password|api[_-]?key)\b\s{0,3}[:=]\s{0,3}["']?([\w/+=-]{16,})""", re.A | re.I)

    def mod(x):
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1

    def words(t, b, e):
        kept = []
        for m in re.finditer(r"[^\W\d_]+", t):
            if (m.start() >= b - 40 and m.end() <= b) or (m.start() >= e and m.end() <= e + 40):
                kept.append(m[0].lower())
        return set(kept)

    def plain(t):
        out = []
        for m in iban.finditer(t):
            n = m[0].replace(" ", "")
            if 15 <= len(n) <= 34 and mod(n):
                out.append(("iban", *m.span(), 0.4 + 0.2 * ({"GB": 22, "DE": 22}.get(n[:2]) == len(n))))
        out += [("ssn", *m.span(), 0.3) for m in ssn.finditer(t)]
        out += [("secret", *m.span(1), 0.3) for m in secret.finditer(t) if re.search(r"\d", m[1]) and re.search("[A-Za-z]", m[1])]
        scored = [(k, b, e, s + 0.3 * bool(words(t, b, e) & pii.CONTEXT[k]) - 0.3 * bool(words(t, b, e) & pii.AGAINST[k])) for k, b, e, s in out]
        return [(k, b, e, round(min(1, max(0, s)), 2)) for k, b, e, s in scored if round(s, 2) >= 0.5]

    seen = set()
    for _ in range(5000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        got = [tuple(s) for s in pii.find(t) if s.kind in pii.ADDED_KINDS]
        assert got == plain(t), t
        seen |= {(k, s) for k, *_, s in got}
    assert {k for k, _ in seen} == set(pii.ADDED_KINDS) and len(seen) >= 4


def test_pii_context_is_of_whole_words():
    number = "123-45-6789"
    assert not pii.find(f"antisocial {number}") and pii.find(f"social {number}")
    assert not pii.find("x" * 30 + "social" + " " * 38 + number)  # the window cuts the word
    assert [s.kind for s in pii.find("DE89370400440532013000")] == ["iban"] and not pii.find("isbn DE89370400440532013000")
    assert [s.score for s in pii.find("version 1.2.3.4")] == [0.3] and [s.score for s in pii.find("host 1.2.3.4")] == [0.9]


def test_pii_rows(spark, docs):
    got = {r.doc_id: r for r in pii.find_pii(docs, sink=pii.digest_sink, sink_schema=pii.DIGESTS).collect()}
    assert (got[8].n_email, got[8].n_phone, got[8].n_card, got[0].spans) == (1, 1, 1, "") and got[0].base_sha256 == sha("")
    redacted = pii.redacted_documents(docs)
    assert redacted.columns == docs.columns and redacted.count() == docs.count()
    assert {r.doc_id: r.text for r in redacted.collect()}[0] is None


# 10


def test_sentencepiece(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = docs.collect()
    want = sorted((str(r.doc_id), len(ids := model.encode(r.text or "")), sha(",".join(map(str, ids))), sha(model.decode(ids))) for r in rows)
    got = sentencepieces.encode_documents(docs, path, sink=sentencepieces.digest_sink, sink_schema=sentencepieces.DIGESTS).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    texts = {r.doc_id: r.text or "" for r in rows}
    for r in sentencepieces.encode_documents(docs, path).collect():
        data = texts[r.doc_id].encode()
        assert b"".join(data[b:e] for b, e in zip(r.begins, r.ends)) == data


@pytest.fixture(params=["nmt_nfkc", "nfkc_cf", "unknown"])
def mapped_model(request, tmp_path):
    """The model with a compiled character map, and one without byte pieces, so that some characters are unknown."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model, rules = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model.ParseFromString(file.read())
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc" if request.param == "unknown" else request.param).serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = True
    if request.param == "unknown":
        model.trainer_spec.byte_fallback = False
        for piece in model.pieces:
            if piece.type == piece.BYTE:
                piece.type = piece.UNUSED
    path = tmp_path / "mapped.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def test_sentencepiece_with_a_character_map(spark, mapped_model):
    codec, rng = sentencepieces.codec(mapped_model), np.random.default_rng(3)
    parts = ["ﬁ", "Ａ", "①", "日本", "  ", " ", "\t", "\n", "e\u0301", "\u3000", "Ⅷ", "x", "word", "ﬃ", "\u00a0", "ſ", "ÅB", "\u0007", "한", "ᄒ\u1161", "\ud7fb", "𒀀", "½", "\u200b", "ǆ", "ß"]
    texts = ["", " ", "\u200b", *("".join(rng.choice(parts, int(rng.integers(1, 14)))) for _ in range(3000))]
    unknown = 0
    for text in texts:
        normal, source = codec.normalise(text.encode())
        assert normal.decode() == codec.model.normalize(text)
        assert len(source) == len(normal) + 1 and (np.diff(source) >= 0).all() and (not len(normal) or source[-1] <= len(text.encode()))
        proto = codec.model.encode(text, out_type="proto").pieces
        begins, ends = codec.spans(text, [p.id for p in proto])
        assert len(begins) == len(proto)
        unknown += any(p.id == codec.model.unk_id() for p in proto)
        data = text.encode()
        for p, b, e in zip(proto, begins, ends):
            if p.surface and not p.piece.startswith("<0x"):
                # The library's offsets are code points; it lets the white space that is squeezed belong to a neighbour.
                assert p.surface.strip() == data[b:e].decode(errors="ignore").strip() or codec.model.normalize(data[b:e].decode(errors="replace")) == codec.model.normalize(p.surface)
    assert "unknown" not in mapped_model or unknown
    frame = spark.createDataFrame(list(enumerate(texts[:200])), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in sentencepieces.encode_documents(frame, mapped_model).collect()}
    assert got == {i: codec.model.encode(t) for i, t in enumerate(texts[:200])}


def test_character_map_takes_longest_prefix():
    class Spec:
        precompiled_charsmap, add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces = b"", True, True, True

    normal, source = sentencepieces.Normaliser(Spec)(b"  a  b ")
    assert normal.decode() == "▁a▁b" and source.tolist() == [2, 2, 2, 2, 3, 3, 3, 5, 6]
