"""Views of a corpus for model training: chunks, packs, permutations, mixtures, slices."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let
from .durable import materialise
from .folds import in_order, packs, running_sums
from .sampling import draw


def sequence_chunks(tokens: DataFrame, length: int, order: str = "doc_id", ids: str = "ids", group: Sequence[str] = ()) -> DataFrame:
    """``group, chunk, ids``: the documents end to end, cut into full chunks; the remainder is dropped.

    Each document is cut at the chunk borders it spans, and slices are shuffled to their
    chunks; where a document begins is a running sum over ranges, so no task sees a whole group.
    """
    placed = running_sums(tokens.select(*group, order, ids).withColumn("__n", F.size(ids).cast("long")).where("__n > 0"), "__n", [order], group)
    first, last = F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("__n") - 1) / length)
    cut = placed.withColumn("chunk", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("chunk") * length - F.col("start"), F.lit(0))
    end = F.least((F.col("chunk") + 1) * length - F.col("start"), F.col("__n"))
    pieces = cut.select(*group, "chunk", "start", F.slice(ids, (begin + 1).cast("int"), (end - begin).cast("int")).alias("piece"))
    ordered = F.array_sort(F.collect_list(F.struct("start", "piece")))
    joined = pieces.groupBy(*group, "chunk").agg(F.flatten(F.transform(ordered, lambda x: x["piece"])).alias("ids"))
    return joined.where(F.size("ids") == length)


def causal_examples(chunks: DataFrame, ids: str = "ids", end_id: int | None = None) -> DataFrame:
    """Adds ``loss_weights``, 1 but for the last token, and with ``end_id`` ``segments``: how many documents ended before a token."""
    weights = F.transform(ids, lambda x, i: F.when(i < F.size(ids) - 1, 1.0).otherwise(0.0))
    out = chunks.withColumn("loss_weights", weights)
    if end_id is None:
        return out
    ends = F.array_compact(F.transform(ids, lambda x, i: F.when(x == end_id, i)))
    return out.withColumn("__ends", ends).withColumn(
        "segments", F.transform(ids, lambda x, i: F.size(F.filter("__ends", lambda e: e < i)))
    ).drop("__ends")


def validation_tail(indexed: DataFrame, n: int, validation: int, index: str = "idx") -> tuple[DataFrame, DataFrame]:
    """The rows before the last ``validation`` of ``n``, and those."""
    if not 0 <= validation <= n:
        raise ValueError("more rows are asked for than there are")
    return indexed.where(F.col(index) < n - validation), indexed.where(F.col(index) >= n - validation)


def train_batches(indexed: DataFrame, batches: int, size: int, index: str = "idx") -> DataFrame:
    """The rows of the first ``batches`` batches."""
    return indexed.where(F.col(index) < batches * size)


def greedy_packs(
    lengths: DataFrame, most_tokens: int, most_documents: int, group: Sequence[str], order: str, length: str,
    allow_long: bool = True,
) -> DataFrame:
    """``group, pack, documents, tokens``: documents in order, packed greedily.

    A pack closes when the next document would not fit in tokens or number. A document longer
    than a pack stands alone, or raises with ``allow_long=False``.
    """
    if not allow_long and lengths.where(F.col(length) > most_tokens).take(1):
        raise ValueError("a document is longer than a pack")
    closes = lambda documents, tokens, n: tokens + n > most_tokens or documents >= most_documents
    return packs(lengths.withColumn(length, F.col(length).cast("long")), closes, length, group, [order], ("pack", "documents", "tokens"))


def loss_weights(prompt: Column, length: Column) -> Column:
    """1 from the last prompt token on, 0 before it and at the last token."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.when((i >= prompt - 1) & (i < length - 1), 1.0).otherwise(0.0))


def _times_modulo(a: int, index: Column, b: int, n: int) -> Column:
    """``(a * index + b) mod n`` for an index below ``n``; beyond 64 bits in decimals of 38 digits."""
    if a % n * n + b % n < 1 << 63:
        return F.pmod(F.lit(a % n) * index.cast("long") + F.lit(b % n), F.lit(n))
    wide = lambda x: F.lit(str(x)).cast("decimal(19,0)")
    return ((wide(a % n) * index.cast("decimal(19,0)") + wide(b % n)) % wide(n)).cast("long")


def _in_range(index: Column, n: int, value: Column) -> Column:
    outside = F.concat(F.lit("index out of range: "), index.cast("string"))
    return F.when((index >= 0) & (index < n), value).when(index.isNotNull(), F.raise_error(outside).cast("long"))


def linear_permutation(index: Column, n: int, a: int, b: int) -> Column:
    """``(a * index + b) mod n``, a permutation when ``a`` and ``n`` are coprime; an index out of range raises."""
    if math.gcd(a, n) != 1:
        raise ValueError("the factor and the length must be coprime")
    return _in_range(index, n, _times_modulo(a, index, b, n))


#: A fixed value: the factor inside a round of the network.
FEISTEL_FACTOR = 2_654_435_761


def feistel_permutation(index: Column, n: int, keys: Sequence[int]) -> Column:
    """A permutation of ``0 .. n - 1`` by a Feistel network over the next power of four, walking cycles.

    Values that leave the range are sent through the network again; at most four times as many
    values as ``n`` exist, so a walk of over a thousand steps has a chance below 1e-120 and raises.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def network(x: Column) -> Column:
        left, right = F.shiftright(x, half), x.bitwiseAND(mask)
        for key in keys:
            # A product of 32 bits each; only its lower bits count.
            mixed = (right * F.lit(FEISTEL_FACTOR % (1 << half)) + F.lit(key % (1 << half))).bitwiseAND(mask)
            left, right = right, left.bitwiseXOR(mixed)
        return F.shiftleft(left, half).bitwiseOR(right)

    def walked(x: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, lambda at, _: F.when(at < n, at).otherwise(network(at)))

    # Few values need more than the first steps; for the others the second walk is not taken.
    short = walked(network(index.cast("long")), 12)
    finish = lambda x: F.when(x < n, x).otherwise(F.coalesce(F.nullif(F.least(walked(x, 1100), F.lit(n)), F.lit(n)), F.raise_error(F.lit("a walk did not end")).cast("long")))
    return _in_range(index, n, let(short, finish))


def era_permutation(index: Column, n: int, era: int, a: int, b: int) -> Column:
    """A linear permutation inside consecutive blocks of ``era`` indexes; the last block may be shorter."""
    if any(math.gcd(a, size) != 1 for size in {min(era, n), n % era} - {0}):
        raise ValueError("the factor must be coprime to the length of every block")
    block = F.floor(index / era)
    last = n - n % era
    inside = index - block * era
    turned = F.when(index < last, _times_modulo(a, inside, b, era))
    if n % era:
        turned = turned.otherwise(_times_modulo(a, inside, b, n % era))
    return _in_range(index, n, block * era + turned)


def mixture_blocks(
    spark: SparkSession, weights: dict[str, float], lengths: dict[str, int], blocks: int, block: int = 2048,
    a: int = 1_000_003,
) -> DataFrame:
    """``idx, block, dataset, item``: every block holds each dataset by weight, the remainder goes to the largest.

    Positions inside a block are permuted by a key of the block; used-up datasets start again.
    """
    total = sum(weights.values())
    counts = {k: int(w / total * block) for k, w in weights.items()}
    counts[max(counts, key=lambda k: (counts[k], k))] += block - sum(counts.values())
    edges, at = [], 0
    for name, count in counts.items():
        edges.append((name, at, at + count, count))
        at += count
    factor = a
    while math.gcd(factor, block) != 1:
        factor += 1
    rows = spark.range(blocks * block).select(
        F.col("id").alias("idx"), F.floor(F.col("id") / block).alias("block"), (F.col("id") % block).alias("pos")
    )
    rows = rows.withColumn("slot", F.pmod(F.lit(factor) * F.col("pos") + F.col("block") * 7919, F.lit(block)))
    name, item = F.lit(None).cast("string"), F.lit(None).cast("long")
    for dataset, low, high, count in edges:
        here = (F.col("slot") >= low) & (F.col("slot") < high)
        name, item = F.when(here, dataset).otherwise(name), F.when(
            here, (F.col("block") * count + F.col("slot") - low) % lengths[dataset]
        ).otherwise(item)
    return rows.select("idx", "block", name.alias("dataset"), item.alias("item"))


def staged_mixture(
    spark: SparkSession, stages: Sequence[tuple[int, dict[str, float]]], lengths: dict[str, int], blocks: int,
    block: int = 2048,
) -> DataFrame:
    """``mixture_blocks`` whose weights change at given blocks; items go on where the stage before ended."""
    if not stages or stages[0][0] != 0 or [s for s, _ in stages] != sorted({s for s, _ in stages}):
        raise ValueError("stages must begin at block 0 and ascend")
    out, used = None, dict.fromkeys(lengths, 0)
    for k, (first, weights) in enumerate(stages):
        last = stages[k + 1][0] if k + 1 < len(stages) else blocks
        if last <= first:
            break
        own = mixture_blocks(spark, weights, {n: 1 << 62 for n in weights}, last - first, block)
        item = F.lit(None).cast("long")
        counts = {r["dataset"]: r["n"] for r in own.where("block = 0").groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a dataset
        for name in counts:
            item = F.when(F.col("dataset") == name, (F.col("item") + used[name]) % lengths[name]).otherwise(item)
            used[name] += counts[name] * (last - first)
        placed = own.select((F.col("idx") + first * block).alias("idx"), (F.col("block") + first).alias("block"), "dataset", item.alias("item"))
        out = placed if out is None else out.unionByName(placed)
    return out


def interpolated_weights(mixtures: Sequence[dict[str, float]], shares: Sequence[float]) -> dict[str, float]:
    """A weighted sum of normalised weights."""
    if abs(sum(shares) - 1) > 1e-9:
        raise ValueError("the shares must sum to 1")
    out: dict[str, float] = {}
    for weights, share in zip(mixtures, shares):
        for name, w in weights.items():
            out[name] = out.get(name, 0.0) + share * w / sum(weights.values())
    return out


def token_budget(docs: DataFrame, budget: int, identifier: str, size: str, seed: str = "slice") -> DataFrame:
    """Documents in shuffled order until their tokens pass ``budget``; the document that passes it is included.

    The order is a hash; running sums are taken inside hash ranges and over the ranges' totals.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(identifier).cast("string")))
    # Ranges of the hash, as many as their documents: both grow with the root of the number of rows.
    digits = max(1, round(math.log(max(docs.count(), 16), 16) / 2))
    ranked = docs.withColumn("__key", key).withColumn("__range", F.substring("__key", 1, digits))
    totals = materialise(ranked.groupBy("__range").agg(F.sum(size).alias("__total")))
    if (totals.agg(F.sum("__total")).first()[0] or 0) <= budget:
        raise ValueError("the documents hold fewer tokens than asked for")
    before = totals.select("__range", (F.sum("__total").over(Window.orderBy("__range")) - F.col("__total")).alias("__before"))
    # Ranges that begin beyond the budget are left out before their documents are sorted.
    before = before.where(F.col("__before") <= budget)
    inside = Window.partitionBy("__range").orderBy("__key", identifier).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranked.join(before, "__range")
    return placed.withColumn("__at", F.col("__before") + F.sum(size).over(inside) - F.col(size)).where(F.col("__at") <= budget).select(docs.columns)


def numbered(frame: DataFrame, order: str, out: str = "idx") -> tuple[DataFrame, int]:
    """``frame`` with dense numbers from 0 by ``order``, and the number of its rows.

    Rows are dealt by range and numbered inside tasks; a task's first number is the count of rows in the tasks before.
    """
    place = F.monotonically_increasing_id()
    dealt = frame.repartitionByRange(order).sortWithinPartitions(order).withColumns({
        "__task": F.shiftright(place, 33), "__row": place.bitwiseAND((1 << 33) - 1)
    })
    dealt = materialise(dealt)
    firsts, n = [], 0
    for task, count in sorted(map(tuple, dealt.groupBy("__task").count().collect())):
        firsts.append((task, n))
        n += count
    first = F.broadcast(frame.sparkSession.createDataFrame(firsts, "__task long, __first long"))  # one row a task
    return dealt.join(first, "__task").withColumn(out, F.col("__first") + F.col("__row")).drop("__task", "__row", "__first"), n


def epochs(indexed: DataFrame, n: int, rows: int, index: str = "idx") -> DataFrame:
    """``rows`` rows that run through ``n`` indexed ones again and again, with ``position`` and ``epoch``."""
    positions = indexed.sparkSession.range(rows).select(
        F.col("id").alias("position"), (F.col("id") % n).alias(index), F.floor(F.col("id") / n).alias("epoch")
    )
    return positions.join(indexed, index)


def simulated_epoch(indexed: DataFrame, n: int, experiment: int, target: int, index: str = "idx") -> DataFrame:
    """The share of a dataset that an experiment sees of a run of ``target`` tokens."""
    return indexed.where(F.col(index) < int(n * experiment / target))


def leave_one_out_advantage(frame: DataFrame, group: Sequence[str], reward: str, out: str = "advantage") -> DataFrame:
    """A reward less the mean of the others in its group; 0 when it is alone."""
    window = Window.partitionBy(*group)
    n, total = F.count(F.lit(1)).over(window), F.sum(reward).over(window)
    return frame.withColumn(out, F.when(n > 1, F.col(reward) - (total - F.col(reward)) / F.nullif(n - 1, F.lit(0))).otherwise(0.0))


def curriculum_weights(lessons: DataFrame, success: str, samples: str, least: float) -> DataFrame:
    """Adds ``weight``: most for half-mastered and new lessons, at least ``least``, summing to 1. The formula is a fixed value."""
    raw = F.greatest(F.lit(0.0), 4 * F.col(success) - 4 * F.col(success) * F.col(success)) * (1 + F.exp(-0.01 * F.col(samples)))
    every = Window.partitionBy(F.lit(0))
    floored = lessons.withColumn("__raw", raw).withColumn("__floor", F.greatest(F.col("__raw") / (1 + F.sum("__raw").over(every)), F.lit(least)))
    return floored.withColumn("weight", F.col("__floor") / F.sum("__floor").over(every)).drop("__raw", "__floor")


def replay_buffer(
    rollouts: DataFrame, capacity: int, step: int, most_delay: int, group: Sequence[str], at: str = "weight_step",
    order: Sequence[str] = (), time: str | None = None, since: Column | None = None,
) -> DataFrame:
    """The newest ``capacity`` rollouts of each group that are not older than ``most_delay`` steps, nor than ``since`` in ``time``."""
    fresh = rollouts.where((F.col(at) >= step - most_delay) & (F.col(at) <= step))
    if time is not None:
        fresh = fresh.where(F.col(time) > since)
    newest = Window.partitionBy(*group).orderBy(*(F.col(c).desc() for c in (at, *order)))
    return fresh.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= capacity)


def replay_sample(
    buffer: DataFrame, n: int, group: Sequence[str], identifier: str, order: Sequence[str], alpha: float = 1.0,
    seed: str = "replay",
) -> DataFrame:
    """Some ``n`` rollouts: of each group in proportion to its size, within it by recency, the k-th oldest with weight ``k ** alpha``."""
    sizes = buffer.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    share = F.round(n * F.col("__n") / F.sum("__n").over(Window.partitionBy(F.lit(0))))  # a row a group
    oldest = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    # A group with a missing name is a group.
    same = [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in group]
    counts = sizes.select(*(F.col(c).alias(f"__{c}") for c in group), share.alias("__share"))
    ranked = buffer.withColumn("__age", oldest).join(counts, same)
    key = [F.ln(F.greatest(draw(seed, F.col(identifier)), F.lit(1e-12))) / F.pow("__age", F.lit(float(alpha))), F.col(identifier)]
    place = F.row_number().over(Window.partitionBy(*group).orderBy(key[0].desc(), key[1]))
    return ranked.withColumn("__place", place).where("__place <= __share").select(buffer.columns)


def unretired(buffer: DataFrame, uses: DataFrame, identifier: str, most: int) -> DataFrame:
    """The rollouts that ``uses``, a row a use, has fewer than ``most`` times."""
    worn = uses.groupBy(identifier).agg(F.count(F.lit(1)).alias("__uses")).where(F.col("__uses") >= most)
    return buffer.join(worn.select(identifier), identifier, "left_anti")


def weighted_draw(frame: DataFrame, k: int, group: Sequence[str], weight: Column, identifier: str, seed: str = "replay") -> DataFrame:
    """``k`` rows of each group without replacement, by weight: those with the greatest ``log(u) / weight``."""
    score = F.ln(F.greatest(draw(seed, F.col(identifier)), F.lit(1e-12))) / weight
    ranked = frame.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy(score.desc(), identifier)))
    return ranked.where(F.col("__rank") <= k).drop("__rank")


def moving_average(
    frame: DataFrame, group: Sequence[str], order: str, value: str, alpha: float = 0.1, prior: float = 0.5,
) -> DataFrame:
    """``group, average``: an exponential moving average of each group's values in order; values stream by, only the average is held."""
    schema = T.StructType([*(frame.schema[c] for c in group), T.StructField("average", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, average, named = None, prior, None

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*named.columns, pa.array([average])], names=schema.names)

        for batch in batches:
            keys = batch.column("__group").to_numpy()
            for i, x in enumerate(batch.column("__value").to_pylist()):
                if named is None or keys[i] != at:
                    if named is not None:
                        yield close()
                    at, average, named = keys[i], prior, batch.select(list(group)).slice(i, 1)
                if x is not None:
                    average = (1 - alpha) * average + alpha * x
        if named is not None:
            yield close()

    own = frame.select(*dict.fromkeys([*group, order]), F.col(value).cast("double").alias("__value"))
    return in_order(own, group, [order]).mapInArrow(run, schema)


def packed_readout(packs: DataFrame, length: int, pad: int = 0) -> DataFrame:
    """``pack`` columns with ``tokens`` cut or padded to ``length`` and ``segments``, the document of each, -1 for padding.

    ``packs`` has ``pack, doc_id, ids``, one row a document.
    """
    one = packs.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("doc_id", "ids"))).alias("d"))
    tokens = F.flatten(F.transform("d", lambda x: x["ids"]))
    segments = F.flatten(F.transform("d", lambda x: F.transform(x["ids"], lambda _: x["doc_id"])))
    fill = lambda c, v: F.slice(F.concat(c, F.array_repeat(v, length)), 1, length)
    return one.select("pack", fill(tokens, F.lit(pad)).alias("tokens"), fill(segments, F.lit(-1).cast("long")).alias("segments"))
