"""Quality rules whose cutoffs carry a guarantee on how many good documents they reject.

Each rule rejects a document when one of its measures exceeds a cutoff. Labelled documents
are the holdout. In every stratum (a language), a cutoff is accepted when the exact binomial
test says, at a level corrected for all rules and strata, that fewer than the tolerated
share of good documents exceed it; cutoffs are tested from the most lenient on, and the last
one before the first that fails is used. With too few labelled good documents in a stratum, or
none, no cutoff passes there and the rule rejects nothing. Everything is native.

Defined results: a null text has no words; such and other short documents fail the base
rule; labels that are null or lack a document are left out, and a document labelled more
than once is good only if all its labels say so; a null language is a stratum like any
other; repeated rows are judged alike and all returned; an empty table or empty labels work.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import materialise, spread, stored, tasks_for

SPACES = r"[\x20\x09-\x0D]+"

#: Measures and their cutoffs, the most lenient first. Fixed before any label is seen.
CUTOFFS: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (3.0, 2.0, 1.0, 0.5, 0.4, 0.3, 0.2, 0.15),
    "chars_per_word": (14.0, 12.0, 10.0, 9.0, 8.0, 7.5, 7.0),
    "dup_line_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2),
    "repeat_share": (0.19, 0.17, 0.15, 0.12, 0.1),
}
#: Share of good documents that all rules together may reject, and the chance that this fails anywhere.
TOLERATED, FAILURE = 0.02, 0.05
#: Up to so many strata with cutoffs are broadcast; beyond it strata are salted.
MOST_BROADCAST_STRATA = 50_000
SALTS = 32


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``__id``, the columns in ``keep`` and the counts of every row; one pass, no shuffle."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    kept = [F.col(f"__keep_{c}") for c in keep]
    split = docs.select(
        F.col(id_column).alias("__id"),
        *(F.col(c).alias(f"__keep_{c}") for c in keep),
        F.array_remove(F.split(text, SPACES), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    n = F.size("words")
    windows = F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice("words", i, 5)))
    counted = split.select(
        "__id", *kept, "n_symbols",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 5, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    # Windows are sorted with their places only in the documents that repeat one.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    numbers = ("n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines")
    counted = counted.select("__id", *kept, *numbers, F.when(repeats, placed).alias("placed"))
    same = lambda i: F.col("placed")[i]["x"]
    as_before = lambda s, i: (i > 0) & (same(F.greatest(i - 1, F.lit(0))) == s["x"])
    as_after = lambda s, i: (i + 1 < F.size("placed")) & (same(F.least(i + 1, F.size("placed") - 1)) == s["x"])
    found = F.filter("placed", lambda s, i: as_before(s, i) | as_after(s, i))
    counted = counted.select("__id", *kept, *numbers, F.array_sort(F.transform(found, lambda s: s["i"])).alias("at"))
    # A repeated window adds five words, or as many as its distance to the next one.
    following = lambda i: F.col("at")[F.least(i + 1, F.size("at") - 1)]
    gaps = F.transform("at", lambda x, i: F.when(i + 1 < F.size("at"), F.least(F.lit(5), following(i) - x)).otherwise(5))
    total = F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    return counted.select("__id", *kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", total.cast("long").alias("n_repeat_words"), "n_lines")


def base_failed() -> Column:
    """The rule that needs no labels."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """The measures that cutoffs apply to; 0 where there is nothing to measure."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "symbols_per_word": per("n_symbols", "n_words"), "chars_per_word": per("word_chars", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words")
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact up to rounding; 1 where k reaches the mean."""
    import math

    odds = math.log(p / (1 - p))
    start = F.struct((n * math.log(1 - p)).alias("log"), F.exp(n * math.log(1 - p)).alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        log = acc["log"] + F.ln((n - j + 1) / j) + odds
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    steps = F.when(
        (k > 0) & (k < n * p), F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long")))
    ).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, 1.0).otherwise(F.aggregate(steps, start, add, lambda acc: acc["sum"]))


def accepted_cutoffs(
    holdout: DataFrame, cutoffs: Mapping[str, Sequence[float]] = CUTOFFS, tolerated: float = TOLERATED,
    failure: float = FAILURE,
) -> DataFrame:
    """``stratum`` and one cutoff for each measure, null where none is accepted.

    ``holdout`` has ``stratum`` and the measures, for good documents only. Counts are
    aggregated before anything is shuffled.
    """
    names = [(m, i, c) for m, cs in cutoffs.items() for i, c in enumerate(cs)]
    counts = holdout.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *(
        F.count(F.when(F.col(m) > c, 1)).alias(f"k_{m}_{i}") for m, i, c in names
    ))
    level = failure / len(cutoffs)
    strata = counts.agg(F.count(F.lit(1)).alias("strata"))
    counts = counts.join(F.broadcast(strata))  # one row
    tests = F.array(*(
        F.struct(F.lit(m).alias("measure"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"), F.col(f"k_{m}_{i}").alias("k")) for m,
        i, c in names
    ))
    rows = counts.select("stratum", "n", "strata", F.explode(tests).alias("r")).select("stratum", "n", "strata", "r.*")
    tested = rows.withColumn("passes", binomial_tail(F.col("k"), F.col("n"), tolerated / len(cutoffs)) <= level / F.col("strata"))
    failed = F.min(F.when(~F.col("passes"), F.col("step")))
    passed = F.array_sort(F.collect_list(F.struct("step", "cutoff", "passes")))
    chosen = tested.groupBy("stratum", "measure").agg(failed.alias("failed"), passed.alias("all"))
    before = F.filter("all", lambda x: F.col("failed").isNull() | (x["step"] < F.col("failed")))
    chosen = chosen.select("stratum", "measure", F.when(F.size(before) > 0, F.element_at(before, -1)["cutoff"]).alias("cutoff"))
    return chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("measure") == m, F.col("cutoff"))).alias(f"cut_{m}") for m in cutoffs))


def counted_and_measured(docs: DataFrame, id_column: str, text_column: str, stratum_column: str, keep: Sequence[str] = ()) -> DataFrame:
    """``measured`` with ``stratum``, ``base_failed`` and the measures; one pass, no shuffle."""
    stratum = F.coalesce(F.concat(F.lit("="), F.col(stratum_column).cast("string")), F.lit("null"))
    needed = dict.fromkeys([id_column, text_column, *keep])
    own = spread(docs.select(*needed, stratum.alias("__stratum")))
    counted = measured(own, id_column, text_column, (*keep, "__stratum")).withColumnRenamed("__keep___stratum", "stratum")
    return counted.withColumns({"base_failed": base_failed(), **measures()})


def fit(
    counted: DataFrame, labels: DataFrame, cutoffs: Mapping[str, Sequence[float]] = CUTOFFS,
    tolerated: float = TOLERATED, failure: float = FAILURE, id_column: str = "doc_id",
) -> DataFrame:
    """The cutoffs of every stratum that has any."""
    known = labels.select(F.col(id_column).alias("__id"), F.col("quality")).where("__id is not null and quality is not null")
    good = known.groupBy("__id").agg(F.min("quality").alias("quality")).where("quality = 1")
    holdout = counted.where(~F.col("base_failed")).join(good, "__id", "left_semi").select("stratum", *cutoffs)
    chosen = accepted_cutoffs(holdout, cutoffs, tolerated, failure)
    # A row a stratum: at most as many as good labels.
    return materialise(chosen.where(F.coalesce(*(F.col(f"cut_{m}") for m in cutoffs)).isNotNull()).coalesce(tasks_for(labels.count())))


def verdicts(counted: DataFrame, fitted: DataFrame, cutoffs: Mapping[str, Sequence[float]] = CUTOFFS) -> DataFrame:
    """Adds ``kept`` to ``counted``."""
    if fitted.count() <= MOST_BROADCAST_STRATA:
        judged = counted.join(F.broadcast(fitted), "stratum", "left")
    else:
        salted = fitted.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        judged = counted.withColumn(
            "__salt", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int")
        ).join(salted, ["stratum", "__salt"], "left").drop("__salt")
    beyond = F.lit(False)
    for m in cutoffs:
        beyond = beyond | F.coalesce(F.col(m) > F.col(f"cut_{m}"), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~beyond)


def judge(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    stratum_column: str = "lang", cutoffs: Mapping[str, Sequence[float]] = CUTOFFS, tolerated: float = TOLERATED,
    failure: float = FAILURE,
) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every row of ``docs``, then the measures.

    The counts, a few numbers a row, are materialised: holdout and verdicts both read them.
    """
    counted = materialise(counted_and_measured(docs, id_column, text_column, stratum_column))
    judged = verdicts(counted, fit(counted, labels, cutoffs, tolerated, failure, id_column), cutoffs)
    return judged.select(
        F.col("__id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", *cutoffs
    )


def good_documents(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    stratum_column: str = "lang", cutoffs: Mapping[str, Sequence[float]] = CUTOFFS, tolerated: float = TOLERATED,
    failure: float = FAILURE,
) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Rows and their counts are stored once, by column: the cutoffs read the counts only, the
    verdicts everything. Counting again would cost far more than reading back.
    """
    counted = stored(counted_and_measured(docs, id_column, text_column, stratum_column, docs.columns), "counted")
    fitted = fit(counted, labels, cutoffs, tolerated, failure, id_column)
    return verdicts(counted, fitted, cutoffs).where("kept").select(*(F.col(f"`__keep_{c}`").alias(c) for c in docs.columns))
