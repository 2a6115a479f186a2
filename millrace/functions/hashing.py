"""Hashes that the engine lacks, as Arrow functions over batches; md5, sha2 and xxhash64 are native."""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.DecimalType(20, 0))
def xxh3_64(text: pa.Array) -> pa.Array:
    """XXH3, 64 bits, of a string or binary, as an unsigned number."""
    import decimal

    import xxhash

    return pa.array([None if x is None else decimal.Decimal(xxhash.xxh3_64_intdigest(x)) for x in text.to_pylist()], pa.decimal128(20, 0))


@F.arrow_udf(T.StringType())
def xxh3_128(text: pa.Array) -> pa.Array:
    """XXH3, 128 bits, as 32 hexadecimal digits."""
    import xxhash

    return pa.array([None if x is None else xxhash.xxh3_128_hexdigest(x) for x in text.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def blake2b(text: pa.Array) -> pa.Array:
    """BLAKE2b, 512 bits, as hexadecimal digits."""
    data = (None if x is None else x.encode() if isinstance(x, str) else x for x in text.to_pylist())
    return pa.array([None if x is None else hashlib.blake2b(x).hexdigest() for x in data], pa.string())


@F.arrow_udf(T.DoubleType())
def compression_ratio(text: pa.Array) -> pa.Array:
    """Bytes of an LZ4 frame that states its content's size, by bytes of a text; 2.0 for an empty one, null for null."""
    codec, out = pa.Codec("lz4"), []
    for x in text.to_pylist():
        data = None if x is None else x.encode()
        # The frame here does not state the size, which takes eight bytes.
        out.append(None if data is None else (len(codec.compress(data)) + 8) / len(data) if data else 2.0)
    return pa.array(out, pa.float64())


# Fixed values of BLAKE3: initial words, the order of words in the next round, and flags.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
_MASK = 0xFFFFFFFF


def _compress(chain: tuple[int, ...], words: list[int], counter: int, size: int, flags: int) -> list[int]:
    v = [*chain, *_IV[:4], counter & _MASK, counter >> 32, size, flags]

    def mix(a: int, b: int, c: int, d: int, x: int, y: int) -> None:
        for add, one, two in ((x, 16, 12), (y, 8, 7)):
            v[a] = (v[a] + v[b] + add) & _MASK
            r = v[d] ^ v[a]
            v[d] = (r >> one | r << 32 - one) & _MASK
            v[c] = (v[c] + v[d]) & _MASK
            r = v[b] ^ v[c]
            v[b] = (r >> two | r << 32 - two) & _MASK

    for _ in range(7):
        for k in range(4):
            mix(k, k + 4, k + 8, k + 12, words[2 * k], words[2 * k + 1])
        for k in range(4):
            mix(k, (k + 1) % 4 + 4, (k + 2) % 4 + 8, (k + 3) % 4 + 12, words[2 * k + 8], words[2 * k + 9])
        words = [words[i] for i in _ORDER]
    return [v[i] ^ v[i + 8] for i in range(8)]


def _chunk(data: bytes, counter: int, root: bool) -> list[int]:
    chain: tuple[int, ...] | list[int] = _IV
    blocks = [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
    for i, block in enumerate(blocks):
        last = i == len(blocks) - 1
        flags = _START * (i == 0) | _END * last | _ROOT * (last and root)
        words = list(struct.unpack("<16I", block.ljust(64, b"\0")))
        chain = _compress(tuple(chain), words, counter, len(block), flags)
    return list(chain)


def blake3_digest(data: bytes) -> bytes:
    """BLAKE3, 256 bits: a tree of chunks of 1024 bytes, the left subtree as large a power of two as there is."""
    chunks = [data[i : i + 1024] for i in range(0, len(data), 1024)] or [b""]

    def subtree(low: int, high: int, root: bool) -> list[int]:
        if high - low == 1:
            return _chunk(chunks[low], low, root)
        middle = low + (1 << (high - low - 1).bit_length() - 1)
        words = subtree(low, middle, False) + subtree(middle, high, False)
        return _compress(_IV, words, 0, 64, _PARENT | _ROOT * root)

    return struct.pack("<8I", *subtree(0, len(chunks), True))


@F.arrow_udf(T.StringType())
def blake3(text: pa.Array) -> pa.Array:
    """BLAKE3, 256 bits, as hexadecimal digits; plain Python, for short values."""
    data = (None if x is None else x.encode() if isinstance(x, str) else x for x in text.to_pylist())
    return pa.array([None if x is None else blake3_digest(x).hex() for x in data], pa.string())


@F.arrow_udf(T.DecimalType(20, 0))
def blake2b_64(text: pa.Array) -> pa.Array:
    """BLAKE2b, 64 bits, as an unsigned number."""
    import decimal

    data = (None if x is None else x.encode() if isinstance(x, str) else x for x in text.to_pylist())
    return pa.array([None if x is None else decimal.Decimal(int.from_bytes(
        hashlib.blake2b(x, digest_size=8).digest(), "big"
    )) for x in data], pa.decimal128(20, 0))
