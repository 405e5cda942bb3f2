"""A reproducible global shuffle: a Feistel permutation of the row numbers, with cycle walking.

Rows are numbered 0 .. n-1 in the order of (id, checksum, size), rows equal in all three being
interchangeable. A keyed Feistel network permutes the smallest power of two that holds n; a value
outside 0 .. n-1 is sent through the network again until it falls inside, which keeps the map a
permutation. The place p of a row gives shard ``p mod shards`` and slot ``p div shards``, so shard
sizes differ by one row at most and slots have no gaps. The network runs backwards too: ``row_at``
tells which row sits in a slot without reading any table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tracegrain.llm.common import written

ROUNDS = 8
SEED = 20_240_607

# Round keys come from the seed by a multiplicative generator modulo this prime, which keeps every
# product below 2**63 in any engine.
MODULUS = 2**31 - 1
STEP = 48_271


def round_keys(seed: int = SEED, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    keys, state = [], seed % MODULUS or 1
    for _ in range(rounds):
        pair = []
        for _ in range(2):
            state = state * STEP % MODULUS
            pair.append(state)
        keys.append(tuple(pair))
    return keys


def halves(n: int) -> tuple[int, int]:
    """Bits of the left and of the right half; their sum is the width of n - 1, two at least."""
    bits = max((max(n, 1) - 1).bit_length(), 2)
    return bits // 2, bits - bits // 2


def _round(value: np.ndarray, key: tuple[int, int], bits: int) -> np.ndarray:
    """A keyed function of one half, with ``bits`` bits. Values are below 2**32."""
    high, low = value >> 16, value & 0xFFFF
    mixed = (low * key[0] + high * key[1] + key[0]) % MODULUS
    mixed = (mixed * STEP + (mixed >> 15)) % MODULUS
    return mixed & ((1 << bits) - 1)


def _network(values: np.ndarray, n: int, seed: int, backwards: bool) -> np.ndarray:
    left_bits, right_bits = halves(n)
    left, right = values >> right_bits, values & ((1 << right_bits) - 1)
    keys = list(enumerate(round_keys(seed)))
    # Even rounds change the left half, odd rounds the right one, so each round is its own inverse.
    for i, key in reversed(keys) if backwards else keys:
        if i % 2 == 0:
            left = left ^ _round(right, key, left_bits)
        else:
            right = right ^ _round(left, key, right_bits)
    return (left << right_bits) | right


def permute(values: np.ndarray, n: int, seed: int = SEED, backwards: bool = False) -> np.ndarray:
    """The place of each row number in 0 .. n-1, or the row number of each place."""
    out = np.asarray(values, dtype=np.int64)
    out = _network(out, n, seed, backwards)
    while (outside := out >= n).any():
        out[outside] = _network(out[outside], n, seed, backwards)
    return out


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = SEED) -> int:
    """The row number that the shuffle puts there."""
    return int(permute(np.array([slot * shards + shard]), n, seed, backwards=True)[0])


def with_row_numbers(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """Numbers rows 0 .. n-1 in the given order, and their count.

    Rows are dealt out by ranges and numbered inside their range; only one count per range is ordered as
    a whole. A running number as the last sort key splits large groups of equal rows.
    """
    tie = df.withColumn("_tie", F.monotonically_increasing_id())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = tie.repartitionByRange(parts, *order, "_tie").withColumn("_part", F.spark_partition_id())
    stored = written(ranged, "sharding-rows")
    counts = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select("_part", "_start")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order, "_tie"))
    # One row per range: as many as there are shuffle partitions.
    numbered = stored.withColumn("_in", inside).join(F.broadcast(starts), "_part")
    number = (F.col("_start") + F.col("_in") - 1).alias(name)
    return numbered.select(*df.columns, number), stored.count()


def _place(number: Column, n: int, seed: int) -> Column:
    @pandas_udf("bigint")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    return place(number)


def shard(docs: DataFrame, shards: int = 16, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals all rows to ``shards`` shards of equal row counts (law ``rows``).

    Columns: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot, grown_shard (null
    under this law), row_number. A null text counts as empty; null ids come first in the numbering; repeated
    rows each get a place of their own; an empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered, n = with_row_numbers(slim, ["doc_id", "text_crc32", "size"], "row_number")
    placed = numbered.withColumn("_place", _place(F.col("row_number"), n, seed))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
