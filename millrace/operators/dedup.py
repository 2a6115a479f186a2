"""Exact and fuzzy deduplication that annotates rather than deletes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text
from .components import connected_components
from .durable import materialise, spread


def hash_counts(frame: DataFrame, key: str, identifier: str) -> DataFrame:
    """``key, cnt, canonical`` of every key; the canonical id is the least."""
    return frame.groupBy(key).agg(F.count(F.lit(1)).alias("cnt"), F.min(identifier).alias("canonical"))


def exact_documents(docs: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, exact_duplicate``: whether another document with the same text has a smaller id."""
    hashed = spread(docs.select(identifier, text)).select(identifier, F.md5(text).alias("hash"))
    counts = hash_counts(hashed.where("hash is not null"), "hash", identifier)
    joined = hashed.join(counts, "hash", "left")
    return joined.select(
        identifier,
        F.coalesce((F.col("cnt") > 1) & (F.col("canonical") != F.col(identifier)), F.lit(False)).alias("exact_duplicate")
    )


def paragraph_lines(docs: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, pos, begin, end, line`` of the non-empty lines; spans in characters. A map: a line's place is a sum over its own text's lines."""
    schema = T.StructType([
        docs.schema[identifier], *(T.StructField(c, T.LongType()) for c in ("pos", "begin", "end")),
        T.StructField("line", T.StringType())
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                split = pc.split_pattern(part.column("__text"), "\n")
                lines = split.flatten()
                sizes = pc.utf8_length(lines).to_numpy().astype(np.int64) + 1
                first = split.offsets.to_numpy() - split.offsets[0].as_py()
                counts = np.diff(first)
                upto = np.append(0, np.cumsum(sizes))
                begin = upto[:-1] - np.repeat(upto[first[:-1]], counts)
                pos = np.arange(len(lines)) - np.repeat(first[:-1], counts)
                kept = pa.array(np.flatnonzero(sizes > 1))
                ids = part.column(identifier).take(pa.array(np.repeat(np.arange(part.num_rows), counts)))
                columns = [ids, pa.array(pos), pa.array(begin), pa.array(begin + sizes - 1), lines]
                yield pa.RecordBatch.from_arrays([c.take(kept) for c in columns], names=schema.names)

    return docs.select(identifier, F.col(text).alias("__text")).where("__text is not null").mapInArrow(run, schema)


def paragraphs(docs: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, pos, begin, end, hash`` of the non-empty lines; spans in characters. Nothing is shuffled."""
    return paragraph_lines(docs, identifier, text).select(identifier, "pos", "begin", "end", F.md5("line").alias("hash"))


def exact_paragraphs(docs: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, begin, end, score`` of the paragraphs whose canonical document is another one."""
    split = paragraphs(spread(docs.select(identifier, text)), identifier, text)
    repeated = hash_counts(split, "hash", identifier).where("cnt > 1")
    marked = split.join(repeated, "hash").where(F.col("canonical") != F.col(identifier))
    return marked.select(identifier, "begin", "end", F.lit(1.0).alias("score"))


def duplicate_counters(counts: DataFrame) -> DataFrame:
    """One row: ``total, dups, unique_items, dup_clusters`` over ``cnt``."""
    pick = lambda condition, value: F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("long")
    more = F.col("cnt") > 1
    return counts.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("total"), pick(more, F.col("cnt")).alias("dups"),
        pick(F.col("cnt") == 1, F.lit(1)).alias("unique_items"), pick(more, F.lit(1)).alias("dup_clusters")
    )


#: A prime; shingles and permutations are numbers below it.
MODULUS = 2**31 - 1


def permutation(j: int) -> tuple[int, int]:
    """The ``j``-th member of the hash family ``(a * h + b) mod MODULUS``."""
    return pow(1_103_515_245, j + 1, MODULUS), pow(69_069, j + 1, MODULUS)


def shingle_factors(width: int) -> list[int]:
    """A shingle's number is the sum of its code points, each times the factor of its place, modulo ``MODULUS``."""
    return [pow(1_284_865_837, k + 1, MODULUS) for k in range(width)]


def _folded(x: np.ndarray) -> np.ndarray:
    """``x mod MODULUS`` of numbers below 2**62: the modulus is a Mersenne prime."""
    modulus = np.uint64(MODULUS)
    x = (x & modulus) + (x >> np.uint64(31))
    x = (x & modulus) + (x >> np.uint64(31))
    return np.where(x >= modulus, x - modulus, x)


def minhash_batch(texts: list[str], width: int, permutations: int) -> np.ndarray:
    """The signatures of some texts, a row each; ``MODULUS`` everywhere for an empty one.

    Texts share most of their shingles, so the values of each distinct one are computed once.
    """
    a, b = np.array([permutation(j) for j in range(permutations)], np.uint64).T.copy()
    factors = shingle_factors(width)
    numbers = []
    for text in texts:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = max(1, len(points) - width + 1) if len(points) else 0
        h = np.zeros(n, np.uint64)
        for k, factor in enumerate(factors[: len(points)]):
            h += points[k : k + n] * np.uint64(factor)
        numbers.append(np.unique(_folded(h)))
    out = np.full((len(texts), permutations), MODULUS, np.uint32)
    known, places = np.unique(np.concatenate(numbers), return_inverse=True) if numbers else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    edges = np.cumsum([0, *map(len, numbers)])
    for low in range(0, len(known), ROWS):
        # A bounded table of values: rows are distinct shingles, columns permutations.
        part = known[low : low + ROWS]
        table = np.empty((len(part), permutations), np.uint32)
        for i in range(0, len(part), 64):
            table[i : i + 64] = _folded(part[i : i + 64, None] * a + b)
        for k in range(len(texts)):
            own = places[edges[k] : edges[k + 1]]  # ascending, as the numbers are
            own = own[np.searchsorted(own, low) : np.searchsorted(own, low + ROWS)] - low
            for j in range(0, len(own), 256):
                np.minimum(out[k], table[own[j : j + 256]].min(axis=0), out=out[k])
    return out


#: Distinct shingles whose values are held at a time.
ROWS = 1 << 15


def _texts(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with some ``most`` characters of text each, one row at least."""
    for batch in batches:
        begin, held, size = 0, [], 0
        for at, value in enumerate(batch.column(text)):
            held.append(value.as_py())
            size += len(held[-1])
            if size > most or at + 1 == batch.num_rows:
                yield batch.slice(begin, len(held)), held
                begin, held, size = at + 1, [], 0


def lsh_buckets(
    docs: DataFrame, identifier: str = "doc_id", text: str = "text", shingle: int = 5, permutations: int = 286,
    bands: int = 26,
) -> DataFrame:
    """``id, band, bucket`` for every band of the MinHash signature of a cleaned text; a map, without shuffle.

    A text shorter than ``shingle`` is its own shingle; empty texts share their buckets, null ones have none.
    """
    rows = permutations // bands
    schema = T.StructType([docs.schema[identifier], T.StructField("band", T.LongType()), T.StructField("bucket", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, "__cleaned"):
            signed = minhash_batch(texts, shingle, permutations)[:, : rows * bands].reshape(-1, rows).tolist()
            buckets = [hashlib.md5(",".join(map(str, x)).encode()).hexdigest() for x in signed]
            places = np.repeat(np.arange(len(texts)), bands)
            numbers = np.tile(np.arange(bands), len(texts))
            yield pa.RecordBatch.from_arrays(
                [part.column(identifier).take(pa.array(places)), pa.array(numbers), pa.array(buckets, pa.string())],
                names=schema.names
            )

    return spread(docs.select(identifier, text)).select(
        identifier, clean_text(F.col(text)).alias("__cleaned")
    ).where("__cleaned is not null").mapInArrow(run, schema)


def fuzzy_documents(docs: DataFrame, identifier: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``id, component, fuzzy_duplicate``: documents that share a bucket, directly or through others."""
    buckets = materialise(lsh_buckets(docs, identifier, text, **options))
    # A star around the least id joins a bucket with one edge a member.
    heads = buckets.groupBy("band", "bucket").agg(F.min(identifier).alias("head"))
    edges = buckets.join(heads, ["band", "bucket"]).where(F.col(identifier) != F.col("head")).select(
        F.col("head").alias("a"), F.col(identifier).alias("b")
    )
    components = connected_components(edges)
    joined = docs.select(identifier).join(components, F.col(identifier) == F.col("node"), "left")
    component = F.coalesce("component", identifier)
    return joined.select(identifier, component.alias("component"), (component != F.col(identifier)).alias("fuzzy_duplicate"))


def fuzzy_counters(components: DataFrame, component: str = "component") -> DataFrame:
    """The counters of groups of near-duplicates: a document alone is unique."""
    return duplicate_counters(components.groupBy(component).agg(F.count(F.lit(1)).alias("cnt")))


def voted_first(rows: DataFrame, votes: str, least: int, key: str, file: str, position: str) -> DataFrame:
    """Rows with enough votes, of each key the first in each file; combined inside tasks before the shuffle."""
    enough = rows.where(F.col(votes) >= least)
    others = [c for c in rows.columns if c not in (file, key)]
    first = enough.groupBy(file, key).agg(F.min_by(F.struct(*others), F.col(position)).alias("__first"))
    return first.select(*(F.col(c) if c in (file, key) else F.col(f"__first.{c}").alias(c) for c in rows.columns))
