"""Token ids of texts and chats with a tokenizer file: begin and end marks, long texts in pieces, assistant masks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


@dataclass(frozen=True)
class TextTokenizer:
    """A tokenizer file with the marks to put around a text, where the tokenizer puts none itself.

    Texts longer than ``most_characters`` are cut at the next white space and their ids joined.
    ``length`` cuts, and with ``pad`` also fills, every row to one number of ids.
    """

    path: str
    begin: str | None = None
    end: str | None = None
    most_characters: int = 100_000
    length: int | None = None
    pad: int | None = None

    def _missing(self) -> tuple[str | None, str | None]:
        tokenizer = _tokenizer(self.path)
        ids = tokenizer.encode("hi there").ids
        lacks = lambda mark, at: mark if mark is not None and (not ids or ids[at] != tokenizer.token_to_id(mark)) else None
        return lacks(self.begin, 0), lacks(self.end, -1)

    def pieces(self, text: str) -> list[str]:
        """The text in pieces, cut at the first white space from every limit on."""
        out, space = [], re.compile(r"\s")
        while len(text) > self.most_characters:
            match = space.search(text, self.most_characters)
            at = match.start() if match else len(text)
            out.append(text[:at])
            text = text[at:]
        return [*out, text]

    def __call__(self, texts: Sequence[str]) -> list[list[int]]:
        tokenizer, (begin, end) = _tokenizer(self.path), self._missing()
        marked = [(f"{begin} " if begin else "") + t + (f" {end}" if end else "") for t in texts]
        cut = [self.pieces(t) for t in marked]
        ids = iter(tokenizer.encode_batch([p for parts in cut for p in parts]))
        rows = [[i for _ in parts for i in next(ids).ids] for parts in cut]
        if self.length is not None:
            fill = [] if self.pad is None else [self.pad]
            rows = [r[: self.length] + fill * max(0, self.length - len(r)) for r in rows]
        return rows


def tokenized(
    docs: DataFrame, tokenizer: TextTokenizer, text: str = "text", keep: Sequence[str] = ("doc_id",),
    window: int = 64,
) -> DataFrame:
    """The columns in ``keep`` and ``ids`` of every row, in batches of ``window`` texts; a null text has none."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, window):
                part = batch.slice(at, window)
                texts = part.column("__text").to_pylist()
                ids = iter(tokenizer([t for t in texts if t is not None]))
                rows = [None if t is None else next(ids) for t in texts]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(rows, pa.list_(pa.int32()))], names=schema.names)

    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def token_cache(
    docs: DataFrame, path: str, tokenizer: TextTokenizer, text: str = "text", keep: Sequence[str] = ("doc_id",),
    sample: float | None = None, seed: int = 0,
) -> DataFrame:
    """Tokenizes ``docs`` into a cache with a ledger, which is returned; a finished cache is not computed again.

    ``sample`` keeps that share of the rows, by a hash of the kept columns.
    """
    from ..sources.writers import write_token_cache

    if sample is not None:
        docs = docs.where(F.pmod(F.xxhash64(F.lit(seed), *keep), F.lit(1 << 30)) < int(sample * (1 << 30)))
    metadata = {"tokenizer": tokenizer.path.rsplit("/", 1)[-1], "begin": tokenizer.begin, "end": tokenizer.end}
    return write_token_cache(tokenized(docs, tokenizer, text, keep), path, metadata=metadata, skip_existing=True)


def cached_token_count(spark, path: str) -> int:
    """The tokens that a cache's ledger counts."""
    return spark.read.parquet(f"{path}/ledger").agg(F.sum("tokens")).first()[0] or 0


@dataclass(frozen=True)
class ChatTemplate:
    """How a chat becomes one text: what goes before and after a message of each role, and which roles are learnt."""

    before: str = "<|{role}|>\n"
    after: str = "\n"
    learnt: tuple[str, ...] = ("assistant",)

    def spans(self, messages: Sequence[dict]) -> tuple[str, list[tuple[int, int]]]:
        """The text and the spans of learnt contents, their ends included."""
        text, spans = "", []
        for message in messages:
            text += self.before.format(role=message["role"])
            begin = len(text)
            text += message["content"] + self.after
            if message["role"] in self.learnt:
                spans.append((begin, len(text)))
        return text, spans


def tokenized_chats(
    chats: DataFrame, path: str, template: ChatTemplate = ChatTemplate(), messages: str = "messages",
    system: str | None = None, template_column: str | None = None, keep: Sequence[str] = ("conv_id",),
) -> DataFrame:
    """The columns in ``keep``, ``ids`` and ``assistant_mask``, 1 for the tokens that hold some of a learnt content; a chat without any raises.

    ``system`` names a column with a prompt that goes before the messages of a row, and
    ``template_column`` one with the row's own text before a message, for rows that have it.
    """
    schema = T.StructType([
        *(chats.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("assistant_mask", T.ArrayType(T.IntegerType()))
    ])
    given = [
        F.col(messages).alias("__messages"),
        (F.col(system) if system else F.lit(None).cast("string")).alias("__system"),
        (F.col(template_column) if template_column else F.lit(None).cast("string")).alias("__before")
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            ids, masks = [], []
            for rows, prompt, before in zip(*(batch.column(c).to_pylist() for c in ("__messages", "__system", "__before"))):
                rows = ([{"role": "system", "content": prompt}] if prompt is not None else []) + (rows or [])
                own = template if before is None else ChatTemplate(before, template.after, template.learnt)
                text, spans = own.spans(rows)
                coded = tokenizer.encode(text, add_special_tokens=False)
                mask = [int(any(b < end and begin < e for begin, end in spans)) for b, e in coded.offsets]
                if not any(mask):
                    raise ValueError("a chat has no assistant message")
                ids.append(coded.ids)
                masks.append(mask)
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(ids, lists), pa.array(masks, lists)], names=schema.names)

    return chats.select(*keep, *given).mapInArrow(run, schema)
