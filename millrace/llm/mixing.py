"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash and queue up, once for each pass over the
source. A queued document's virtual finish time is the words queued before and with it,
divided by the source's target. All queues are merged by virtual finish time and the merged
queue is cut where the words taken would exceed the total budget.

Running sums are taken in two steps, inside hash ranges and over the totals of the ranges,
so that a source with a third of all rows is dealt over many tasks. In a source, finish times
grow along its queue, so what a pass takes is a beginning of the queue: all that goes back to
the documents is the last hash that each source takes in each pass. Texts are neither
shuffled nor sorted. Everything is native.

Defined results: a null text has size 0; documents of size 0 and sources of size 0 take
nothing; null sources form one source, the last; the hash is one of the id and the text, so
rows with the same id and different texts count separately, and rows with the same id, text
and source are taken together or not at all; ties between sources are broken by their names;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.durable import materialise, spread, tasks_for

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
#: Of the words of a source that a mix takes at most: each document twice.
PASSES = 2
#: Up to so many sources are broadcast; beyond it sources are salted.
MOST_BROADCAST_SOURCES = 50_000
SALTS = 32


def words(text: Column) -> Column:
    """Number of words; 0 for null. Spaces between words are counted, so that no array of words is made."""
    single = F.trim(F.regexp_replace(text, SPACES, " "))
    gaps = F.length(single) - F.length(F.replace(single, F.lit(" "), F.lit("")))
    return F.when(F.length(single) > 0, gaps + 1).otherwise(0).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float) -> DataFrame:
    """Adds ``target`` to ``(skey, source_size)``: by weight, at most ``PASSES`` times the size.

    With sources in the order of the fill level at which each reaches its limit, the level
    that spends the budget is the first that lies below its own source's limit.
    """
    listed = F.array(*(F.lit(float(w)) for w in weights))
    full = PASSES * F.col("source_size")
    by_key, by_limit = Window.orderBy("skey"), Window.orderBy("limit", "skey")
    place = F.pmod(F.row_number().over(by_key) - 1, F.lit(len(weights))) + 1
    ranked = sources.withColumn("weight", F.element_at(listed, place.cast("int")))
    ranked = ranked.withColumn("limit", full / F.col("weight"))
    everything = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = F.sum(full).over(by_limit.rowsBetween(Window.unboundedPreceding, 0)) - full
    open_weight = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    left = (share * F.sum("source_size").over(everything) - filled) / open_weight
    first = F.min(F.when(F.col("level") <= F.col("limit"), F.struct("limit", "skey", "level"))).over(everything)
    levelled = ranked.withColumn("level", left).withColumn("level", first["level"])
    full = full.cast("double")
    above = F.col("level").isNull() | (F.col("level") >= F.col("limit"))
    return levelled.select("skey", "source_size", F.when(above, full).otherwise(F.col("level") * F.col("weight")).alias("target"))


def source_key(source: Column) -> Column:
    """The name of a source, null last."""
    name = source.cast("string")
    return F.when(name.isNull(), "1").otherwise(F.concat(F.lit("0"), name))


def queue_hash(seed: str, identity: Column, text: Column) -> Column:
    """The place of a document in its source's queue."""
    known = lambda x: F.coalesce(x, F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(seed), known(identity.cast("string")), F.md5(known(text))))


def last_taken(queues: DataFrame, weights: Sequence[float], share: float) -> DataFrame:
    """``skey, source_size, target`` and the last hash taken in each pass, ``last_0`` and on; null where none is.

    ``queues`` has ``skey, hash, size`` of every row and is materialised.
    """
    rows = queues.count()
    digits, tasks = max(1, round(math.log(max(rows, 16), 16) / 2)), tasks_for(rows)
    bins = 16 ** (digits + 1)
    # Rows of one hash are one entry; copies are combined before the shuffle.
    entry = F.substring("hash", 1, digits).alias("range")
    base = materialise(queues.groupBy("skey", entry, "hash").agg(F.sum("size").alias("size")).coalesce(tasks))
    ranges = base.groupBy("skey", "range").agg(F.sum("size").alias("range_size"))
    before = F.sum("range_size").over(Window.partitionBy("skey").orderBy("range")) - F.col("range_size")
    ranges = materialise(ranges.withColumn("before", before).coalesce(tasks))
    sizes = ranges.groupBy("skey").agg(F.sum("range_size").alias("source_size"))
    goals = materialise(targets(sizes, weights, share).coalesce(tasks))
    ranges = materialise(ranges.join(goals, "skey").select("skey", "range", "before", "source_size", "target").coalesce(tasks))
    inside = Window.partitionBy("skey", "range").orderBy("hash").rowsBetween(Window.unboundedPreceding, 0)
    queued = F.col("before") + F.sum("size").over(inside)
    placed = base.where("size > 0").join(ranges, ["skey", "range"]).where("target > 0").withColumn("queued", queued)
    turns = F.array(*(F.struct(
        F.lit(t).alias("turn"), ((F.col("queued") + t * F.col("source_size")) / F.col("target")).alias("finish")
    ) for t in range(PASSES)))
    entries = placed.select("skey", "hash", "size", F.explode(turns).alias("at")).select("skey", "hash", "size", "at.*")
    entries = materialise(entries.withColumn("bin", F.floor(F.col("finish") * bins)).coalesce(tasks))
    budget = share * (goals.agg(F.sum("source_size")).first()[0] or 0)
    # The bin in which the budget ends: bins are few and their totals are all that is ordered in one task.
    sums = entries.groupBy("bin").agg(F.sum("size").alias("bin_size"))
    sums = sums.withColumn("upto", F.sum("bin_size").over(Window.orderBy("bin")))
    last = sums.where(F.col("upto") > budget).orderBy("bin").first()
    taken = entries
    if last is not None:
        order = Window.orderBy("finish", "skey", "hash").rowsBetween(Window.unboundedPreceding, 0)
        upto = F.sum("size").over(order) + (last["upto"] - last["bin_size"])
        tail = entries.where(F.col("bin") == last["bin"]).withColumn("upto", upto)
        cut = tail.where(F.col("upto") > budget).orderBy("upto").select("finish", "skey", "hash").first()
        tie = F.struct("skey", "hash") < F.struct(F.lit(cut["skey"]), F.lit(cut["hash"]))
        taken = entries.where((F.col("finish") < cut["finish"]) | ((F.col("finish") == cut["finish"]) & tie))
    lasts = taken.groupBy("skey").agg(*(F.max(F.when(F.col("turn") == t, F.col("hash"))).alias(f"last_{t}") for t in range(PASSES)))
    return materialise(goals.join(lasts, "skey", "left").coalesce(tasks))


def with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds the columns of ``sources`` to ``rows``, which have ``skey`` and ``hash``; rows are not shuffled when sources are few."""
    if sources.count() <= MOST_BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), "skey")
    salted = sources.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("hash"), F.lit(SALTS)).cast("int")
    return rows.withColumn("__salt", salt).join(salted, ["skey", "__salt"]).drop("__salt")


def times_taken() -> Column:
    """In how many passes a row with ``hash`` is taken."""
    return sum((F.coalesce((F.col("hash") <= F.col(f"last_{t}")).cast("long"), F.lit(0).cast("long")) for t in range(PASSES)), F.lit(0).cast("long"))


def _queued(seed: str, id_column: str, text_column: str, source_column: str) -> list[Column]:
    text = F.col(text_column).cast("string")
    return [source_key(F.col(source_column)).alias("skey"), queue_hash(seed, F.col(id_column), text).alias("hash"), words(text).alias("size")]


def mix(
    docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, seed: str = "mix",
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """``id, size, source_size, target, taken`` of every row.

    ``weights`` are dealt to the sources in the order of their names, repeating. The total
    budget is ``share`` times all words. ``taken`` is the document's words that the mix has,
    0, 1 or 2 times its size.
    """
    own = spread(docs.select(*dict.fromkeys([id_column, text_column, source_column])))
    rows = materialise(own.select(F.col(id_column).alias("__id"), *_queued(seed, id_column, text_column, source_column)))
    out = with_sources(rows, last_taken(rows, weights, share))
    return out.select(F.col("__id").alias(id_column), "size", "source_size", "target", (F.col("size") * times_taken()).alias("taken"))


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, seed: str = "mix",
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns: one map over them.

    Rows without words are not taken.
    """
    queues = materialise(docs.select(*_queued(seed, id_column, text_column, source_column)))
    sources = last_taken(queues, weights, share)
    text = F.col(text_column).cast("string")
    own = docs.select(
        F.struct(*(F.col(c) for c in docs.columns)).alias("row"), source_key(F.col(source_column)).alias("skey"),
        queue_hash(seed, F.col(id_column), text).alias("hash")
    )
    found = with_sources(own, sources).withColumn("times", times_taken()).where(F.col("times") > 0)
    found = found.where(F.col(f"row.`{text_column}`").cast("string").rlike(WORD))
    copies = found.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return copies.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
