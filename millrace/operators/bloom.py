"""Bloom filters as tables: built by an aggregate, merged, compared, and asked by a join.

A filter is a table of blocks of 256 bits, ``block, w0, w1, w2, w3``, and the number of blocks.
A key sets eight bits of one block. Building is a ``bit_or`` that is combined inside tasks
before the shuffle, so it scales with the number of blocks and not of keys; the filter is
never on the driver. Filters of the same number of blocks can be merged and compared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import materialise

WORDS = ("w0", "w1", "w2", "w3")
#: A filter up to this size is broadcast to be asked; beyond it both sides are shuffled, copies of blocks dealing a hot key.
MOST_BROADCAST_BYTES, SALTS = 16 << 20, 32


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(key, F.lit(1))
    bit = lambda place: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, place).bitwiseAND(63).cast("int"))
    return [bit(12 * i).bitwiseOR(bit(12 * i + 6)) for i in range(len(WORDS))]


@dataclass(frozen=True)
class Bloom:
    """A filter: its blocks as a table, and their number."""

    rows: DataFrame
    blocks: int

    @classmethod
    def build(cls, keys: DataFrame, column: str, expected: int, bits_per_key: int = 16) -> Bloom:
        """The filter of the keys in a column; nulls are left out. 16 bits a key give about one false hit in 500."""
        blocks = max(1, -(-expected * bits_per_key // 256))
        key = F.col(column)
        masked = keys.where(key.isNotNull()).select(_block(key, blocks).alias("block"), *(m.alias(w) for w, m in zip(WORDS, _masks(key))))
        return cls(masked.groupBy("block").agg(*(F.bit_or(w).alias(w) for w in WORDS)), blocks)

    def stored(self) -> Bloom:
        """The filter, computed once."""
        return Bloom(materialise(self.rows), self.blocks)

    def _same(self, other: Bloom) -> None:
        if self.blocks != other.blocks:
            raise ValueError("the filters have different numbers of blocks")

    def __or__(self, other: Bloom) -> Bloom:
        self._same(other)
        both = self.rows.unionByName(other.rows)
        return Bloom(both.groupBy("block").agg(*(F.bit_or(w).alias(w) for w in WORDS)), self.blocks)

    def __and__(self, other: Bloom) -> Bloom:
        self._same(other)
        renamed = other.rows.select("block", *(F.col(w).alias(f"o{w}") for w in WORDS))
        shared = self.rows.join(renamed, "block").select("block", *(F.col(w).bitwiseAND(F.col(f"o{w}")).alias(w) for w in WORDS))
        return Bloom(shared.where(" or ".join(f"{w} <> 0" for w in WORDS)), self.blocks)

    def bits(self) -> int:
        """How many bits are set."""
        counts = sum((F.bit_count(w) for w in WORDS), F.lit(0))
        return int(self.rows.agg(F.sum(counts)).first()[0] or 0)

    def issubset(self, other: Bloom) -> bool:
        """Whether every key may be in ``other``; if not, some key certainly is not."""
        self._same(other)
        renamed = other.rows.select("block", *(F.col(w).alias(f"o{w}") for w in WORDS))
        beyond = " or ".join(f"(w{i} & ~coalesce(ow{i}, 0L)) <> 0" for i in range(len(WORDS)))
        return not self.rows.join(renamed, "block", "left").where(beyond).take(1)

    def ask(self, frame: DataFrame, column: str, out: str = "may_contain") -> DataFrame:
        """``frame`` with whether each key may be in the filter; false for null."""
        key = F.col(column)
        asked = frame.withColumn("__block", _block(key, self.blocks))
        rows = self.rows.select(F.col("block").alias("__block"), *(F.col(w).alias(f"__{w}") for w in WORDS))
        if self.blocks * 48 <= MOST_BROADCAST_BYTES:
            joined = asked.join(F.broadcast(rows), "__block", "left")
        else:
            salted = rows.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            joined = asked.withColumn(
                "__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
            ).join(salted, ["__block", "__salt"], "left")
        found = F.lit(True)
        for w, mask in zip(WORDS, _masks(key)):
            found = found & (F.col(f"__{w}").bitwiseAND(mask) == mask)
        return joined.withColumn(out, key.isNotNull() & F.coalesce(found, F.lit(False))).select(*frame.columns, out)
