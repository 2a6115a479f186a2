"""Chats, questions and token ids on hand-made rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.operators import conversations, questions, tokens


def first(frame):
    return tuple(frame.first())


def test_adapters(spark):
    rows = spark.createDataFrame([("q", [{"content": "a"}, {"content": "b"}], [{"role": "user", "content": "m"}], "r")], "i string, rs array<struct<content: string>>, ms array<struct<role: string, content: string>>, r string")
    got = rows.select(conversations.first_response(F.col("i"), F.col("rs")).alias("a"), conversations.single_message(F.col("ms"), F.col("r")).alias("b"), conversations.single_message(F.concat("ms", "ms"), F.col("r")).alias("c"), conversations.single_message(F.col("ms"), F.lit(None).cast("string")).alias("d"), conversations.first_response(F.col("i"), F.slice("rs", 1, 0)).alias("e")).first()
    assert [tuple(m) for m in got.a] == [("user", "q"), ("assistant", "a")] and [tuple(m) for m in got.b] == [("user", "m"), ("assistant", "r")] and got.c == [] and got.d == [] and got.e is None


def test_chat_records(spark):
    rows = spark.createDataFrame([("q", "<think>r</think>", "x"), (None, "r", "y")], "i string, o string, topic string")
    made = conversations.chat_records(rows, conversations.instruction_response(F.col("i"), F.col("o")), "here", ["topic", "absent"], {"topic": "subject", "i": "id"}, {"<think>": "[", "</think>": "]"})
    assert made.columns == ["id", "source", "messages", "created", "metadata", "subject"] and made.count() == 1
    row = made.first()
    assert row.messages[1].content == "[r]" and row.metadata.asDict() == {"topic": "x", "absent": ""} and row.subject == "x"
    assert row.id == hashlib.sha256("user\u001fq\u001eassistant\u001f<think>r</think>".encode()).hexdigest()
    assert first(spark.createDataFrame([('{"a": 1}',)], "t string").select(F.variant_get(conversations.parsed_arguments(F.col("t")), "$.a", "int"))) == (1,)
    with_prompt = conversations.with_system(F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("content"))), F.lit("be brief"))
    assert [m.role for m in spark.range(1).select(with_prompt).first()[0]] == ["system", "user"]


def test_question_page(spark):
    frame = spark.createDataFrame([(i, "T", "Q", [("A1", 3), ("A2", 5)], ["x", "y"]) for i in range(20)], "id long, t string, q string, a array<struct<body: string, votes: int>>, g array<string>")
    page = conversations.question_page_markdown(F.col("t"), F.col("q"), F.col("a"), F.col("g"), "s", F.col("id"))
    got = {r[0] for r in frame.select(page).collect()}
    after = "# Question\nTitle: T\nQ\n\n# Answer\nA1\n> 3 votes\n\n# Answer\nA2\n> 5 votes\n\n---\nTags: x, y\n---"
    assert got == {after, after.replace("A1\n> 3 votes", "> 3 votes\nA1").replace("A2\n> 5 votes", "> 5 votes\nA2")}


def test_options_and_lookup(spark):
    pick = lambda c: [r[0] for r in spark.createDataFrame([('{"a": {"b": ["x", "y"]}, "n": null}',)], "j string").select(c).collect()][0]
    assert pick(questions.nested(F.col("j"), "a.b.1")) == "y" and pick(questions.nested(F.col("j"), "a.z", "none")) == "none" and pick(questions.nested(F.col("j"), "", "d")) == "d"
    rows = [('["France", "Canada"]',), ('{"B": "Canada", "A": "France"}',), ('[{"key": "B", "value": "Canada"}, {"key": "A", "value": "France"}]',)]
    got = [r[0] for r in spark.createDataFrame(rows, "o string").select(questions.standard_options(F.col("o"))).collect()]
    assert got == [["France", "Canada"]] * 3


def test_evaluation_records(spark):
    rows = spark.createDataFrame([(1, " 2+2? ", ["3", "4", "5"], "B"), (2, "x?", ["p", "q", "r"], "3"), (3, "y?", ["p", "q", "r"], "q"), (4, "z?", ["p", "q", "r"], "none"), (5, "open?", None, "yes"), (6, None, None, "yes")], "i int, q string, o array<string>, a string")
    made = questions.evaluation_records(rows, F.col("i"), F.col("q"), F.col("o"), F.array(*map(F.lit, "ABC")), F.col("a"))
    got = {r.id: (r.prompt, r.response, r.answer_index) for r in made.collect()}
    assert got == {1: ("2+2?\nA. 3\nB. 4\nC. 5\nAnswer:", "B. 4", 1), 2: ("x?\nA. p\nB. q\nC. r\nAnswer:", "C. r", 2), 3: ("y?\nA. p\nB. q\nC. r\nAnswer:", "B. q", 1), 5: ("open?\n\n", "yes", None)}
    assert first(made.where("id = 5").select(questions.evaluation_text(F.col("prompt"), F.col("response")))) == ("open?\n\n\nyes",)


def test_medical_texts(spark):
    one = spark.createDataFrame([(["c1", "c2"], "q", "yes", "long")], "c array<string>, q string, d string, a string")
    assert first(one.select(*questions.context_question(*(F.col(x) for x in "cqda")))) == (hashlib.sha256(b"c1\nc2qyeslong").hexdigest(), "c1\nc2\n\nq\n\nyes\nlong")
    two = spark.createDataFrame([("i", "g", "o")], "i string, g string, o string")
    assert first(two.select(*questions.instruction_with_input(*(F.col(x) for x in "igo")))) == (hashlib.sha256(b"igo").hexdigest(), "i\n\nContext: \ng\n\nAnswer: \no")
    three = spark.createDataFrame([("q", "w", "x", "y", "z", 2, None), ("q", "w", "x", "y", "z", 9, "e")], "q string, a string, b string, c string, d string, r int, e string")
    text = questions.lettered_question(F.col("q"), [F.col(x) for x in "abcd"], F.col("r"), F.col("e"))
    assert [r[0] for r in three.select(text).collect()] == ["q\n\nAnswer choices: \na. w\nb. x\nc. y\nd. z\nAnswer: c", None]


def test_chunked_texts(spark):
    rows = [("g", i, "x" * n) for i, n in enumerate([10, 20, 30, 5, 50, 1])] + [("h", 0, "y")]
    got = {(r.g, r.chunk): r.text for r in questions.chunked_texts(spark.createDataFrame(rows, "g string, i int, text string"), 30, ["g"], ["i"]).collect()}
    assert {k: len(v) for k, v in got.items()} == {("g", 0): 32, ("g", 1): 31, ("g", 2): 57, ("g", 3): 2, ("h", 0): 2} and got["h", 0] == "y\n"


def test_text_tokenizer(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    made = tokens.TextTokenizer(path, end="<|endoftext|>", most_characters=20)
    text = "word " * 30 + "x" * 50
    assert "".join(made.pieces(text)) == text and len(made.pieces(text)) > 5
    frame = spark.createDataFrame([(1, "hello there"), (2, None), (3, ""), (4, text)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokens.tokenized(frame, made).collect()}
    assert got[1] == [*library.encode("hello there ").ids, 50256] and got[2] is None and got[3] == library.encode(" <|endoftext|>").ids
    assert library.decode(got[4], skip_special_tokens=False) == text + " <|endoftext|>"
    short = tokens.TextTokenizer(path, length=4, pad=9)
    assert short(["a", "a b c d e f"])[0][1:] == [9, 9, 9] and len(short(["a b c d e f"])[0]) == 4
    ledger = tokens.token_cache(frame.where("text is not null"), f"{tmp_path}/cache", made)
    assert tokens.cached_token_count(spark, f"{tmp_path}/cache") == sum(len(x) for x in got.values() if x) == sum(r.tokens for r in ledger.collect())
    assert tokens.token_cache(frame.limit(0), f"{tmp_path}/cache", made).count() == ledger.count()


def test_chat_tokens(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    chat = [("user", "hi you"), ("assistant", "well hello"), ("user", "ok"), ("assistant", "bye")]
    schema = "conv_id long, messages array<struct<role: string, content: string>>, system string, own string"
    frame = spark.createDataFrame([(1, chat, None, None), (2, chat, "be brief", "[{role}] ")], schema)
    got = {r.conv_id: r for r in tokens.tokenized_chats(frame, path, system="system", template_column="own").collect()}
    assert library.decode(got[1].ids) == "<|user|>\nhi you\n<|assistant|>\nwell hello\n<|user|>\nok\n<|assistant|>\nbye\n"
    learnt = lambda r: library.decode([i for i, m in zip(r.ids, r.assistant_mask) if m])
    assert learnt(got[1]) == "well hello\nbye\n" and learnt(got[2]).split() == ["well", "hello", "bye"] and library.decode(got[2].ids).startswith("[system] be brief\n[user] hi you")
    with pytest.raises(Exception, match="no assistant message"):
        tokens.tokenized_chats(spark.createDataFrame([(1, chat[:1], None, None)], schema), path).collect()
