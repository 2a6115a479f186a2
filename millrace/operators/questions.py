"""Questions with options into prompts and responses, and question collections into texts. All native."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .conversations import answer_index, choice_prompt, choice_response
from .relational import fold_batches


def nested(record: Column, path: str, default: str | None = None) -> Column:
    """The text at a dotted path of a JSON record; the default where the path is empty or leads nowhere."""
    if not path:
        return F.lit(default)
    found = F.get_json_object(record, "$" + "".join(f"['{part}']" if not part.isdigit() else f"[{part}]" for part in path.split(".")))
    return F.coalesce(found, F.lit(default))


def standard_options(options: Column) -> Column:
    """Options as a list of texts, from JSON: a list as it is, an object by its keys, or ``key, value`` pairs by their keys."""
    pairs = F.from_json(options, "array<struct<key: string, value: string>>")
    by_key = F.transform(F.array_sort(pairs), lambda p: p["value"])
    is_pairs = (F.size(pairs) > 0) & F.forall(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    of_object = F.transform(F.array_sort(F.map_entries(F.from_json(options, "map<string, string>"))), lambda e: e["value"])
    plain = F.from_json(options, "array<string>")
    return F.when(F.startswith(F.ltrim(options), F.lit("{")), of_object).when(F.coalesce(is_pairs, F.lit(False)), by_key).otherwise(plain)


def evaluation_records(rows: DataFrame, identifier: Column, question: Column, options: Column, labels: Column, answer: Column) -> DataFrame:
    """``id, prompt, response, answer_index``; a row whose answer is none of its options goes.

    Without options the prompt is the question and the response the answer itself.
    """
    asked = rows.select(identifier.alias("id"), strip(question).alias("q"), options.alias("o"), labels.alias("l"), answer.alias("a"))
    asked = asked.withColumn("answer_index", F.when(F.size("o") > 0, answer_index(F.col("o"), F.col("l"), F.col("a"))))
    prompt = F.when(F.size("o") > 0, choice_prompt(F.col("q"), F.col("o"))).otherwise(F.concat(F.col("q"), F.lit("\n\n")))
    response = F.when(F.size("o") > 0, choice_response(F.col("o"), F.col("answer_index"))).otherwise(F.col("a"))
    made = asked.select("id", prompt.alias("prompt"), response.alias("response"), F.col("answer_index").cast("long").alias("answer_index"))
    return made.where("prompt is not null and response is not null")


def evaluation_text(prompt: Column, response: Column) -> Column:
    """A prompt and its response as a text."""
    return F.concat(prompt, F.lit("\n"), response)


def context_question(contexts: Column, question: Column, decision: Column, answer: Column) -> tuple[Column, Column]:
    """The id and the text of a question on passages with a decision and a long answer."""
    joined = F.array_join(contexts, "\n")
    text = F.concat(joined, F.lit("\n\n"), question, F.lit("\n\n"), decision, F.lit("\n"), answer)
    return F.sha2(F.concat(joined, question, decision, answer), 256), text


def instruction_with_input(instruction: Column, given: Column, output: Column) -> tuple[Column, Column]:
    """The id and the text of an instruction with its input and output."""
    text = F.concat(instruction, F.lit("\n\nContext: \n"), given, F.lit("\n\nAnswer: \n"), output)
    return F.sha2(F.concat(instruction, given, output), 256), text


def lettered_question(question: Column, options: Sequence[Column], right: Column, explanation: Column) -> Column:
    """The text of a question with lettered options, the right letter and an explanation; null where the letter is none of them."""
    letters = [chr(97 + i) for i in range(len(options))]
    lines = [F.concat(F.lit(f"{letter}. "), o, F.lit("\n")) for letter, o in zip(letters, options)]
    letter = F.get(F.array(*map(F.lit, letters)), right.cast("int"))
    return strip(F.concat(
        question, F.lit("\n\nAnswer choices: \n"), *lines, F.lit("Answer: "), letter, F.lit("\n"),
        F.coalesce(explanation, F.lit(""))
    ))


def chunked_texts(parts: DataFrame, most: int, group: Sequence[str], order: Sequence[str], text: str = "text") -> DataFrame:
    """``group, chunk, text``: texts in order, each with a line feed, gathered until they are longer than ``most``; the rest is the last chunk."""
    def fold(held, row):
        return (False, None) if held is not None and held > most else (True, (held or 0) + len(row[text] or "") + 1)

    numbered = fold_batches(parts.select(*group, *order, text), fold, group, order, "chunk")
    ordered = F.array_sort(F.collect_list(F.struct(*order, text)))
    return numbered.groupBy(*group, "chunk").agg(F.array_join(F.transform(ordered, lambda x: F.concat(x[text], F.lit("\n"))), "").alias("text"))
