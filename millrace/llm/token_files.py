"""Token ids in ORC files: encoding, writing, pruned reading, per-document digests.

Documents are dealt to tasks by ranges of their id and sorted inside each task, so the
files hold ascending ids: file ``part-00000`` before ``part-00001``. Each file has stripes
of integers under run-length encoding, row indexes, and Bloom filters on the id, so that
readers split work by stripe and skip what cannot hold a wanted id. A hash of the text stands
beside the id: it deals and orders rows that repeat an id.

Defined results: a null text counts as empty and has the end id alone; null ids sort
first; rows with the same id are all kept, next to each other, ordered by the hash of their
text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.durable import materialise, shared_folder
from .batches import sliced

#: Bytes of text that a worker encodes at a time, and that a file holds at most, about; the column beside the id.
SLICE_BYTES, FILE_BYTES, HASH = 4 << 20, 128 << 20, "text_hash"
#: White space after a space or line feed, and characters for which word boundaries are left to the library itself.
_UNUSUAL = "[ \n][ \n\t\r]|[^\t\n\r -~¡-ɏ]"
#: Marks the word that begins a text, and stands for a line feed at the beginning of a word; both are unusual in a text.
_FIRST, _LINE = "\x01", "\x02"


def _gathered(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ``flat`` one after the other, and their edges."""
    edges = np.append(0, np.cumsum(lengths, dtype=np.int64))
    return edges, flat[np.repeat(starts - edges[:-1], lengths) + np.arange(edges[-1])]


class WordEncoder:
    """A byte-level BPE tokenizer that encodes each distinct word once.

    The tokenizer cuts a text by a fixed pattern and encodes each part on its own. It always
    cuts before a space or line feed between two characters that are not white space, so the
    ids of a text are those of its words, each with the space or line feed before it. Words
    are split off here, the library encodes those not met before, many of them as one text:
    a token that begins with a space or line feed begins a word. Texts with unusual
    characters, with the text of an added token, or with white space after a space or line
    feed go to the library whole. ``most_words`` bounds the memory for words already met.
    """

    def __init__(self, path: str, most_words: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_words = most_words
        added = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.unusual = "|".join([_UNUSUAL, *added])
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.begins[number] = token[0] in "ĠĊ"
        # The ids of word k stand in ``flat`` between its two ``edges``.
        self.words = pa.array([], pa.string())
        self.uses, self.edges, self.flat = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keep the words used most, at most half of those allowed and none used once only."""
        kept = np.argsort(-self.uses, kind="stable")[: self.most_words // 2]
        kept = np.sort(kept[self.uses[kept] > 1])
        self.words = self.words.take(pa.array(kept))
        self.edges, self.flat = _gathered(self.edges[kept], np.diff(self.edges)[kept], self.flat)
        self.uses = self.uses[kept] // 2

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of words that begin with their space or line feed."""
        texts = ["".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        ids = np.fromiter(chain.from_iterable(x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.int32)
        heads = np.flatnonzero(self.begins[ids])
        if len(heads) != len(words) or (len(heads) and heads[0]):
            raise ValueError("the tokenizer does not cut before every word")
        return np.diff(np.append(heads, len(ids))), ids

    def _learn(self, fresh: list[str]) -> None:
        # Words that begin a text or end in white space are encoded one by one.
        alone = [not x or x[0] == _FIRST or x[-1] in "\t\r" or x == _LINE for x in fresh]
        many = [" " + x if x[0] != _LINE else "\n" + x[1:] for x, a in zip(fresh, alone) if not a]
        single = [x[1:] if x[:1] == _FIRST else "\n" + x[1:] if x[:1] == _LINE else " " + x for x, a in zip(fresh, alone) if a]
        lengths, ids = self._encoded(many)
        own = [x.ids for x in self.tokenizer.encode_batch_fast(single, add_special_tokens=False)]
        own_lengths = np.fromiter(map(len, own), np.int64, len(own))
        every = np.concatenate([lengths, own_lengths])
        both = np.concatenate([ids, np.fromiter(chain.from_iterable(own), np.int32, int(own_lengths.sum()))])
        # Where each fresh word stands in ``many + single``.
        order = np.empty(len(fresh), np.int64)
        order[np.argsort(np.array(alone), kind="stable")] = np.arange(len(fresh))
        edges, flat = _gathered((np.cumsum(every) - every)[order], every[order], both)
        self.edges = np.concatenate([self.edges, edges[1:] + len(self.flat)])
        self.flat = np.concatenate([self.flat, flat])
        self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int64)])

    def __call__(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts, one after the other."""
        if len(self.words) > self.most_words:
            self._forget()
        unusual = pc.match_substring_regex(texts, self.unusual)
        whole = {k: self.tokenizer.encode(
            texts[k].as_py(), add_special_tokens=False
        ).ids for k in np.flatnonzero(unusual.to_numpy(zero_copy_only=False)).tolist()}
        plain = pc.binary_join_element_wise(_FIRST, pc.if_else(unusual, "", texts), "")
        words = pc.split_pattern(pc.replace_substring(plain, "\n", " " + _LINE), " ")
        coded = words.flatten().dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=self.words)
        fresh = coded.dictionary.filter(known.is_null())
        known = known.fill_null(-1).to_numpy().astype(np.int64)
        if len(fresh):
            known[known < 0] = len(self.words) + np.arange(len(fresh))
            self.words = pa.concat_arrays([self.words, fresh])
            self._learn(fresh.to_pylist())
        self.uses[known] += np.bincount(coded.indices.to_numpy(), minlength=len(known))
        # The ids as bytes, so that a word's are copied in one piece.
        table = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.uses), [None, pa.py_buffer(4 * self.edges), pa.py_buffer(self.flat)])
        taken = table.take(pa.array(known)).take(coded.indices)
        _, ends, data = taken.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(taken) + 1] // 4
        ids = np.frombuffer(data, np.int32)[: ends[-1]] if data is not None else np.zeros(0, np.int32)
        edges = ends[words.offsets.to_numpy() - words.offsets[0].as_py()]
        parts, offsets = [], [0]
        tail = np.array([] if end_id is None else [end_id], np.int32)
        for k in range(len(texts)):
            own = np.array(whole[k], np.int32) if k in whole else ids[edges[k] : edges[k + 1]]
            parts += [own, tail]
            offsets.append(offsets[-1] + len(own) + len(tail))
        return np.array(offsets, np.int32), np.concatenate(parts).astype(np.int32, copy=False)


_loaded: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The tokenizer at ``path``, loaded once a worker."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def encode(
    docs: DataFrame, tokenizer: str, end_id: int | None = 0, id_column: str = "doc_id", text_column: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``id_column``, the columns in ``keep`` and ``ids array<int>`` of every row, in the order of the input."""
    kept = [id_column, *keep]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = encoder(tokenizer)
        for batch in sliced(batches, "__text", SLICE_BYTES):
            offsets, ids = loaded(batch.column("__text").fill_null(""), end_id)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], names=schema.names)

    return docs.select(*kept, F.col(text_column).cast("string").alias("__text")).mapInArrow(run, schema)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, id_column: str = "doc_id",
    text_column: str = "text", stripe_mb: int = 64, stride: int = 1000, file_bytes: int = FILE_BYTES,
) -> None:
    """Encode ``docs`` and write ORC files in ascending id order under ``path``.

    The text is dealt by id range before it is encoded: the sample that finds the ranges
    then costs a scan and not a second encoding. The number of files follows the bytes.
    """
    text = F.col(text_column).cast("string")
    own = docs.select(id_column, F.xxhash64(text).alias(HASH), text.alias(text_column))
    total = own.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))
    order = [F.col(id_column).asc_nulls_first(), F.col(HASH)]
    dealt = own.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    out = encode(dealt, tokenizer, end_id, id_column, text_column, (HASH,)).write.mode("error")
    out = out.option("orc.bloom.filter.columns", id_column).option("orc.bloom.filter.fpp", "0.01")
    out.option("orc.row.index.stride", stride).option("orc.stripe.size", stripe_mb << 20).option("compression", "zstd").orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The written ids; a filter on the id is pushed to row indexes and Bloom filters."""
    return spark.read.orc(path)


def digests(tokens: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every document in written files.

    ``start`` is a prefix sum in two steps: inside each file, and over the files' totals.
    """
    fields = [tokens.schema[id_column], T.StructField(HASH, T.LongType()), T.StructField("file", T.StringType())]
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            columns = [*(batch.column(c) for c in (id_column, HASH, "file")), pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    each = materialise(tokens.select(F.col(id_column), HASH, F.col("_metadata.file_path").alias("file"), "ids").mapInArrow(run, schema))
    # Files follow each other by their number, which has five digits or more.
    number = F.regexp_extract("file", r"part-([0-9]+)[^/]*$", 1).cast("long")
    totals = each.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"))
    before = totals.select("file", (F.sum("file_tokens").over(Window.orderBy(number)) - F.col("file_tokens")).alias("before"))
    inside = Window.partitionBy("file").orderBy(F.col(id_column).asc_nulls_first(), HASH)
    placed = each.withColumn("inside", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    return placed.join(before, "file").select(id_column, (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def through_files(
    docs: DataFrame, tokenizer: str, end_id: int | None = 0, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Write ``docs`` to token files in the shared folder, read them back, digest them."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark, 'tokens')}/files"
    write_token_files(docs, path, tokenizer, end_id, id_column, text_column)
    return digests(read_token_files(spark, path), id_column)
