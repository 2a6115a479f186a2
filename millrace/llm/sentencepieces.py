"""SentencePiece encoding with spans of the original bytes, and decoding.

The text is normalised by longest-prefix matches in the model's compiled
character map (a double-array trie). While it is normalised, the original byte
of every normalised byte is recorded, so that each piece that the library's
encoder returns can be projected back onto the bytes it came from.

Defined results: a null text counts as empty; an empty text has no pieces and
decodes to the empty string; rows are independent, so repeated rows, ties and
null ids need no special care; an empty table gives an empty result; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.durable import spread
from .batches import sliced

SPACE = "▁".encode()


class CharacterMap:
    """The compiled map of a model: byte sequences to their normalised form."""

    def __init__(self, blob: bytes):
        if not blob:
            self.units, self.strings = (), b""
            return
        (size,) = struct.unpack_from("<I", blob)
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.strings = blob[4 + size :]

    @staticmethod
    def _step(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest key that starts at ``at``: its length and what it becomes."""
        found, node, units = None, self._step(self.units[0]), self.units
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= self._step(unit)
            if unit & 0x100:
                value = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.strings[value : self.strings.index(b"\0", value)])
        return found


class Normaliser:
    """Normalised bytes of a text and the original byte of each of them."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            return self._plain(data)
        return self._mapped(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        raw = np.frombuffer(data, np.uint8)
        sign = SPACE if self.escape else b" "
        widths = np.where(raw == 32, len(sign), 1)
        source = np.repeat(np.arange(len(raw)), widths)
        lead = len(sign) if self.prefix else 0
        text = (sign if self.prefix else b"") + data.replace(b" ", sign)
        return text, np.concatenate([np.zeros(lead, np.int64), source, [len(raw)]])

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        sign = SPACE if self.escape else b" "
        out, source, at, n = bytearray(), [], 0, len(data)

        def prefix_at(i: int) -> tuple[int, bytes]:
            if self.map.units and (hit := self.map.longest(data, i)):
                return hit
            width = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
            return width, data[i : i + width]

        if self.squeeze:
            while at < n and prefix_at(at)[1] == b" ":
                at += prefix_at(at)[0]
            if at == n:
                return b"", np.array([n])
        if self.prefix:
            out += sign
            source += [at] * len(sign)
        spaced = self.squeeze
        while at < n:
            width, piece = prefix_at(at)
            while spaced and piece.startswith(b" "):
                piece = piece[1:]
            for byte in piece:
                put = sign if byte == 32 else bytes([byte])
                out += put
                source += [at] * len(put)
            if piece:
                spaced = self.squeeze and piece.endswith(b" ")
            at += width
        end = n
        while self.squeeze and out.endswith(sign) and out:
            end = source[len(out) - len(sign)]
            del out[-len(sign) :], source[-len(sign) :]
        return bytes(out), np.array([*source, end], np.int64)


class Codec:
    """One loaded model: encodes with spans, decodes."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        self.normalise = Normaliser(proto.normalizer_spec)
        byte = sentencepiece_model_pb2.ModelProto.SentencePiece.BYTE
        self.widths = np.array([1 if p.type == byte else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.widths[self.model.unk_id()] = -(1 << 40)  # of any width: the sum then never fits
        self.names = [str(i) for i in range(len(proto.pieces))]

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one original UTF-8 byte of every piece."""
        normal, source = self.normalise(text.encode())
        widths = self.widths[ids] if ids else np.zeros(0, np.int64)
        if widths.sum() != len(normal):  # unknown pieces stand for characters of any width
            pieces = self.model.encode(text, out_type="proto").pieces
            widths = np.array([len(p.piece.encode()) if p.id == self.model.unk_id() else w for p, w in zip(pieces, widths)], np.int64)
            if widths.sum() != len(normal):
                raise ValueError("pieces do not cover the normalised text")
        edges = source[np.concatenate([[0], np.cumsum(widths)])]
        return edges[:-1], edges[1:]


_loaded: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The model at ``path``, loaded once a worker."""
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


#: What a sink gets: the codec, the texts, and per text the ids, first bytes, end bytes and the decoded text.
Sink = Callable[[Codec, list[str], list[list[int]], list[tuple[np.ndarray, np.ndarray]], list[str]], list[pa.Array]]

PIECES = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("begins", T.ArrayType(T.LongType())),
    T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType())
])
DIGESTS = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()), T.StructField("n_covered_bytes", T.LongType())
])


def pieces_sink(_codec, _texts, ids, spans, decoded) -> list[pa.Array]:
    """Ids, spans and decoded text as columns."""
    return [
        pa.array(ids, pa.list_(pa.int32())), pa.array([b for b, _ in spans], pa.list_(pa.int64())),
        pa.array([e for _, e in spans], pa.list_(pa.int64())), pa.array(decoded, pa.string())
    ]


def digest_sink(codec_, _texts, ids, spans, decoded) -> list[pa.Array]:
    """Counts and digests; nothing as long as the text leaves the worker."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    names = codec_.names
    covered = [int((e - b).sum()) for b, e in spans]
    return [
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array([sha(",".join([names[i] for i in x])) for x in ids], pa.string()),
        pa.array([sha(x) for x in decoded], pa.string()), pa.array(covered, pa.int64())
    ]


def encode_documents(
    docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", sink: Sink = pieces_sink,
    sink_schema: T.StructType = PIECES,
) -> DataFrame:
    """One row per row of ``docs``: its id and what ``sink`` makes of its pieces.

    Encoding adds no begin or end id and does not sample. Everything is one map over
    the scan: no shuffle, and each worker holds a few MB of text at a time.
    """
    id_type = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField(id_column, id_type), *sink_schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = codec(model)
        for batch in sliced(batches, text_column):
            texts = [x or "" for x in batch.column(text_column).to_pylist()]
            ids = loaded.model.encode(texts, num_threads=1)
            spans = [loaded.spans(t, i) for t, i in zip(texts, ids)]
            decoded = loaded.model.decode(ids, num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *sink(loaded, texts, ids, spans, decoded)], names=schema.names)

    own = spread(docs.select(F.col(id_column), F.col(text_column).cast("string").alias(text_column)))
    return own.mapInArrow(run, schema)
