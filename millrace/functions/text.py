"""Text expressions: normalising, paragraphs, shingles, n-grams, spans and filters. All native."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 32 ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: ASCII white space, the same in every engine.
SPACES = "[ \\t-\\r]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it for every element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse_spaces(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """Lower case, without ASCII punctuation, white space collapsed."""
    return collapse_spaces(F.translate(F.lower(text), PUNCTUATION, ""))


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def ngrams(tokens: Column, n: int, stride: int = 0) -> Column:
    """Word n-grams joined by a space; consecutive ones begin ``stride + 1`` words apart."""
    none = F.array().cast("array<string>")
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1), F.lit(stride + 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return let(tokens, lambda w: F.when(F.size(w) >= n, cut(w)).otherwise(none))


def char_shingles(text: Column, k: int) -> Column:
    """All windows of ``k`` characters, repeated ones too; a shorter text is its own shingle, an empty one has none."""
    none = F.array().cast("array<string>")
    cut = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - (k - 1)), lambda i: F.array_join(F.slice(c, i, k), ""))
    return let(
        F.array_remove(F.split(text, ""), ""),
        lambda c: F.when(F.size(c) >= k, cut(c)).when(F.size(c) > 0, F.array(F.array_join(c, ""))).otherwise(none)
    )


def record_id(identifier: Column, text: Column, hashed: Callable[[Column], Column] = F.md5) -> Column:
    """The identifier, or where it is null a hash of the text; null when both are. ``hashed`` may be another hash, such as XXH3."""
    return F.coalesce(identifier.cast("string"), hashed(text))


def remove_spans(text: Column, spans: Column) -> Column:
    """The text without ``[begin, end)`` character spans, given as structs; they may overlap."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["begin"].cast("int").alias("begin"), s["end"].cast("int").alias("end"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def cut(acc: Column, s: Column) -> Column:
        piece = F.when(s["begin"] > acc["at"], F.substring(text, acc["at"] + 1, s["begin"] - acc["at"])).otherwise("")
        return F.struct(F.concat(acc["out"], piece).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(spans.isNull() | (F.size(spans) == 0), text).otherwise(F.aggregate(ordered, start, cut, done))


def normalised_extension(value: Column) -> Column:
    """Trimmed, lower-cased and with a leading dot."""
    bare = F.lower(F.trim(value))
    return F.when(bare == "", None).when(F.startswith(bare, F.lit(".")), bare).otherwise(F.concat(F.lit("."), bare))


def replace_all(text: Column, replacements: Mapping[str, str]) -> Column:
    """Literal replacements, in order."""
    for old, new in replacements.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def citations_removed(text: Column) -> Column:
    """Without escaped numeric citations such as ``\\[3, 4\\]``; the pattern is a fixed value."""
    return F.regexp_replace(text, r"\s?\\\[(?:\d+(?:,\s*\d+)*)\\\]", "")


def training_line(label: Column, text: Column) -> Column:
    """A labelled line for a linear text classifier."""
    return F.concat(F.lit("__label__"), label.cast("string"), F.lit(" "), F.translate(text, "\n\r", ""))


def encyclopedia_gate(text: Column, digits: int = 50, least_words: int = 70, special: int = 50) -> Column:
    """Whether an article passes: not too short, few digits, enough words, few characters beyond letters and digits. The limits are fixed values."""
    share = lambda pattern: F.floor(100 * F.length(F.regexp_replace(text, pattern, "")) / F.length(text))
    fine = (share(r"[^\p{Nd}]") <= digits) & (F.size(words(text)) >= least_words) & (share(r"[\p{L}\p{N}]") <= special)
    return F.when(F.length(text) < 10, F.lit(False)).otherwise(F.coalesce(fine, F.lit(False)))


def truncated(text: Column, n: int = 100) -> Column:
    """The first ``n`` characters."""
    return F.substring(text, 1, n)


def plain_article(text: Column) -> Column:
    """Without marks such as ``^(1)``; blank lines and lines of empty brackets go, paragraphs stay apart by one empty line."""
    bare = F.regexp_replace(text, r"\^\([^)]+\)", "")
    emptied = F.regexp_replace(bare, r"(?m)^[^\S\n]*(\[\])?[^\S\n]*$", "\n")
    return F.regexp_replace(emptied, r"\n{2,}", "\n\n")


def unlabelled(line: Column) -> Column:
    """A labelled line without its label; null where there is no space."""
    at = F.instr(line, " ")
    return F.when(at > 0, F.substring(line, at + 1, F.length(line)))


def line_id(number: Column, line: Column) -> Column:
    """A hash of a line and its number."""
    return F.sha2(F.concat(number.cast("string"), F.lit(":"), line), 256)


def listed_extension(values: Column) -> Column:
    """The normalised extension of a list that holds one value; null for others."""
    return F.when(F.size(values) == 1, normalised_extension(values[0]))


def any_text(record: Column, fields: Sequence[str], lists: Sequence[str] = ()) -> Column:
    """A text from a JSON record: the first field with text, else the first list, joined by lines, else title and body, else the record."""
    at = lambda name: F.get_json_object(record, f"$['{name}']")
    array = lambda name: F.from_json(at(name), "array<string>")
    plain = [F.when((strip(at(n)) != "") & ~F.startswith(at(n), F.lit("[")), at(n)) for n in fields]
    joined = [F.when(F.size(F.array_compact(array(n))) > 0, F.array_join(F.array_compact(array(n)), "\n")) for n in (*fields, *lists)]
    title, body = at("title"), at("body")
    page = F.when(title.isNotNull() & body.isNotNull(), F.concat(strip(title), F.lit("\n\n"), strip(body)))
    return F.coalesce(*plain, *joined, page, F.when(strip(title) != "", title), record)


def six_digits(index: Column) -> Column:
    """A number with zeros before it up to six digits; longer ones stay whole."""
    return F.format_string("%06d", index)


def any_id(record: Column, fields: Sequence[str], fallback: str, index: Column, padded: Callable[[Column], Column] = six_digits) -> Column:
    """The first identifier of a JSON record or of its metadata, else a name with a ``padded`` number."""
    found = [F.get_json_object(record, f"${path}['{n}']") for path in ("", ".metadata") for n in fields]
    return F.coalesce(*(F.when(c != "", c) for c in found), F.concat(F.lit(f"{fallback}_"), padded(index)))


#: Names of collections that are not for training.
_HELD_OUT = re.compile("[^a-zA-Z]test[^a-zA-Z]|validation")


def check_train_paths(paths: Sequence[str]) -> None:
    """Raises when a path looks like a test or validation collection."""
    for path in paths:
        if _HELD_OUT.search(path):
            raise ValueError(f"{path} looks like a collection that is not for training")


def first_text(candidates: Sequence[Column]) -> Column:
    """The first candidate that is not blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in candidates))
