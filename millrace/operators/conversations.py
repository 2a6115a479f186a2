"""Chats, questions and answers: into one shape, into text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import replace_all, strip
from .sampling import draw

ROLES = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "system": "system", "tool": "tool"}


def mapped_messages(messages: Column, role: str = "role", content: str = "content", roles: Mapping[str, str] = ROLES) -> Column:
    """Messages with standard roles; an unknown role raises."""
    table = F.create_map(*(F.lit(x) for pair in roles.items() for x in pair))
    known = lambda m: F.coalesce(table[m[role]], F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(m[role], F.lit("null")))).cast("string"))
    return F.transform(messages, lambda m: F.struct(known(m).alias("role"), m[content].alias("content")))


def instruction_response(instruction: Column, response: Column) -> Column:
    """A two-message chat; null when either side is."""
    pair = F.array(
        F.struct(F.lit("user").alias("role"), instruction.alias("content")),
        F.struct(F.lit("assistant").alias("role"), response.alias("content"))
    )
    return F.when(instruction.isNotNull() & response.isNotNull(), pair)


def best_completion(completions: Column, score: str) -> Column:
    """The completion with the greatest score, the first of equals."""
    return F.aggregate(completions, F.element_at(completions, 1), lambda best, c: F.when(c[score] > best[score], c).otherwise(best))


def gathered(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conversation, messages``: the turns of each conversation in order."""
    ordered = F.array_sort(F.collect_list(F.struct(turn, F.col(role).alias("role"), F.col(text).alias("content"))))
    return turns.groupBy(conversation).agg(F.transform(ordered, lambda m: F.struct(m["role"], m["content"])).alias("messages"))


def as_text(messages: Column) -> Column:
    """``role: content`` lines with an empty line between, trimmed."""
    return strip(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n\n"))


def content_id(messages: Column) -> Column:
    """A hash of a chat's roles and contents."""
    return F.sha2(F.array_join(F.transform(messages, lambda m: F.concat_ws("\u001f", m["role"], m["content"])), "\u001e"), 256)


def alternating_text(texts: Column, speakers: Sequence[str] = ("User", "Assistant")) -> Column:
    """Texts with speakers that take turns."""
    names = F.array(*(F.lit(s) for s in speakers))
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.element_at(names, i % len(speakers) + 1), F.lit(": "), t)), "\n\n")


def preference_pair(chosen: Column, rejected: Column) -> Column:
    """A struct of both chats, null when either is empty."""
    return F.when((F.size(chosen) > 0) & (F.size(rejected) > 0), F.struct(chosen.alias("chosen"), rejected.alias("rejected")))


def choice_prompt(question: Column, options: Column) -> Column:
    """The question, lettered options and ``Answer:``."""
    lines = F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o))
    return F.concat(question, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\nAnswer:"))


def choice_response(options: Column, answer: Column) -> Column:
    """The lettered option at a zero-based index."""
    return F.concat(F.char((answer + 65).cast("int")), F.lit(". "), F.element_at(options, (answer + 1).cast("int")))


def answer_index(options: Column, labels: Column, answer: Column) -> Column:
    """The zero-based index of an answer given as a label, a number from 1 on, or an option's text."""
    find = lambda where: F.nullif(F.array_position(where, answer), F.lit(0)) - 1
    number = answer.try_cast("long") - 1
    in_range = F.when((number >= 0) & (number < F.size(options)), number)
    return F.coalesce(find(labels), in_range, find(options))


def question_page(title: Column, question: Column, answers: Column, tags: Column) -> Column:
    """A page of a question and its answers, best votes first, as Markdown; answers have ``votes`` and ``body``."""
    ordered = F.array_sort(
        answers, lambda a,
        b: F.when(a["votes"] > b["votes"], -1).when(a["votes"] < b["votes"], 1).otherwise(F.when(a["body"] < b["body"], -1).when(a["body"] > b["body"], 1).otherwise(0))
    )
    parts = F.transform(ordered, lambda a: F.concat(F.lit("# Answer\n\n"), a["body"], F.lit("\n\n> "), a["votes"].cast("string"), F.lit(" votes")))
    return F.concat(
        F.lit("# "), title, F.lit("\n\n"), question, F.lit("\n\n"), F.array_join(parts, "\n\n"), F.lit("\n\nTags: "),
        F.array_join(tags, ", ")
    )


def _chat(user: Column, assistant: Column) -> Column:
    return F.array(
        F.struct(F.lit("user").alias("role"), user.alias("content")),
        F.struct(F.lit("assistant").alias("role"), assistant.alias("content"))
    )


def first_response(instruction: Column, responses: Column, content: str = "content") -> Column:
    """A chat of an instruction and the first of a list of responses; null without a response."""
    first = F.get(responses, 0)
    return F.when(first.isNotNull(), _chat(instruction, first[content]))


def single_message(messages: Column, response: Column, role: str = "role", content: str = "content") -> Column:
    """A chat of one message and its response; an empty one where there are more messages, no role or no response."""
    one = F.get(messages, 0)
    fine = (F.size(messages) == 1) & one[role].isNotNull() & response.isNotNull()
    return F.when(F.coalesce(fine, F.lit(False)), _chat(one[content], response)).otherwise(F.slice(_chat(F.lit(""), F.lit("")), 1, 0))


def replaced(messages: Column, replacements: Mapping[str, str]) -> Column:
    """Messages whose contents went through literal replacements, in order."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), replace_all(m["content"], replacements).alias("content")))


def parsed_arguments(arguments: Column) -> Column:
    """The arguments of a tool call as a variant: parsed where they are JSON, else the text itself."""
    return F.coalesce(F.try_parse_json(arguments), F.to_variant_object(F.array(arguments)))


#: Names that a remapped column must not take, and what thinking marks become.
RESERVED = frozenset("id source messages added created metadata".split())


def chat_records(
    rows: DataFrame, messages: Column, source: str, metadata: Sequence[str] = (),
    remap: Mapping[str, str] | None = None, replacements: Mapping[str, str] | None = None,
) -> DataFrame:
    """``id, source, messages, created, metadata`` of every row with messages, then remapped columns.

    The id is a hash of the messages before replacements. Metadata columns that a row lacks are
    empty texts; a remapped column whose new name is reserved is skipped.
    """
    kept = rows.select(messages.alias("__messages"), *rows.columns).where("__messages is not null")
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in metadata]
    extra = [F.col(old).alias(new) for old, new in (remap or {}).items() if old in rows.columns and new not in RESERVED]
    final = replaced(F.col("__messages"), replacements) if replacements else F.col("__messages")
    fields = F.struct(*known) if known else F.lit(None).cast("struct<>")
    return kept.select(
        content_id(F.col("__messages")).alias("id"), F.lit(source).alias("source"), final.alias("messages"),
        F.lit("").alias("created"), fields.alias("metadata"), *extra
    )


def with_system(messages: Column, system: Column) -> Column:
    """Messages after a system prompt; as they are where it is null."""
    prompt = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))
    return F.when(system.isNotNull(), F.concat(prompt, messages)).otherwise(messages)


def question_page_markdown(title: Column, question: Column, answers: Column, tags: Column, seed: str, identifier: Column) -> Column:
    """A page of a question and its answers in the order given; votes stand after or, by a coin of the id, before an answer."""
    first = draw(seed, identifier) < 0.5
    votes = lambda a: F.concat(F.lit("> "), a["votes"].cast("string"), F.lit(" votes"))
    one = lambda a: F.concat(F.lit("\n\n# Answer\n"), F.when(first, F.concat(a["body"], F.lit("\n"), votes(a))).otherwise(F.concat(votes(a), F.lit("\n"), a["body"])))
    tagged = F.when(F.size(tags) > 0, F.concat(F.lit("\n\n---\nTags: "), F.array_join(tags, ", "), F.lit("\n---"))).otherwise("")
    return F.concat(F.lit("# Question\nTitle: "), title, F.lit("\n"), question, F.array_join(F.transform(answers, one), ""), tagged)
