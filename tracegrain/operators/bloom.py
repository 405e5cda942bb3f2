"""Blocked Bloom filters as small tables: built by an aggregation, asked by a join.

A filter has 64-bit words, as many as its keys need. A key sets ``BITS`` bits in one of them, both chosen by its hash, so asking
is one lookup and one comparison.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.operators.tables import materialize

BITS = 6
# Bits of a filter per key that it is made for; of the keys that are not in it fewer than one in a hundred pass.
BITS_PER_KEY = 16
SCHEMA = "word bigint, bits bigint"


def words_for(keys: int) -> int:
    """Words of a filter for so many keys."""
    return max(1, -(-keys * BITS_PER_KEY // 64))


def _place(columns: list[str], words: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(words))


def _mask(columns: list[str]) -> Column:
    """The bits of a key: groups of six bits of a second hash number them."""
    second = F.xxhash64(*columns, F.lit(1))
    mask = F.lit(0).cast("bigint")
    for i in range(BITS):
        number = F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), number))
    return mask


@dataclass(frozen=True)
class Bloom:
    """``df`` has the words that are not zero (word, bits); ``words`` is their possible number."""

    df: DataFrame
    words: int
    columns: tuple[str, ...]

    @classmethod
    def build(cls, keys: DataFrame, columns: list[str], rows: int) -> Bloom:
        """A filter of the keys in ``columns``, made for about ``rows`` of them."""
        words = words_for(rows)
        marked = keys.select(_place(columns, words).alias("word"), _mask(columns).alias("bits"))
        return cls(marked.groupBy("word").agg(F.bit_or("bits").alias("bits")), words, tuple(columns))


def possible(rows: DataFrame, filters: list[Bloom]) -> DataFrame:
    """The rows whose key may be in one of the filters: all that are, and a few others."""
    out = rows.withColumn("_hit", F.lit(False))
    for number, f in enumerate(filters):
        word, bits = f"_word{number}", f"_bits{number}"
        known = materialize(f.df.select(F.col("word").alias(word), F.col("bits").alias(bits)), "filter")
        # A filter too large for a broadcast is met word by word; words are dealt by a hash, so none is hot.
        lookup = F.broadcast(known.df) if known.fits_broadcast else known.df
        mask = _mask(list(f.columns))
        found = F.coalesce(F.col(bits).bitwiseAND(mask) == mask, F.lit(False))
        placed = out.withColumn(word, _place(list(f.columns), f.words))
        out = placed.join(lookup, word, "left").withColumn("_hit", F.col("_hit") | found).drop(word, bits)
    return out.filter("_hit").select(rows.columns)
