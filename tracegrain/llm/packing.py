"""Best-fit packing of token pieces into sequences, certified by dual-feasible lower bounds.

Pieces are dealt to groups at random and every group runs best-fit decreasing. A group whose number of
sequences equals its lower bound is certified: no packing of it can use fewer. The lower bound is the
largest of those that two families of dual-feasible functions give; such a function maps sizes so that
whatever fits into a sequence still fits, so the mapped sizes divided by the capacity count sequences that
any packing needs. Groups with a gap give their open sequences, and every group its emptiest one, to a pool
that is dealt anew and packed again; a round is taken over only where it saves sequences.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.common import written

CAPACITY = 2048
END_ID = 0
# Pieces of a group that is packed in one task: bounds its memory.
GROUP_ITEMS = 16_384
ROUNDS = 4
# Sequence numbers: the number of the group times this, plus the number within the group.
STRIDE = 1 << 32
STEPS = 64


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Sequence number of every piece: pieces in falling size, each into the fullest sequence it fits in."""
    out = np.empty(len(sizes), dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by room left
    rooms = 0  # bit r is set where a sequence with room r is open
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = open_at[room].pop()
            if not open_at[room]:
                rooms ^= 1 << room
        else:
            room, number, used = capacity, used, used + 1
        out[i] = number
        left = room - size
        if left:
            open_at[left].append(number)
            rooms |= 1 << left
    return out


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs, from the number of pieces of each size 0 .. capacity.

    First family: for a threshold t up to half the capacity, sizes above capacity - t count as a full
    sequence, sizes below t as nothing. Second family: with k steps, a size that is no multiple of
    capacity / (k + 1) is rounded down to such a multiple and then measured in k-ths.
    """
    sizes = np.arange(capacity + 1)
    mass = np.concatenate([[0], np.cumsum(counts * sizes)])
    number = np.concatenate([[0], np.cumsum(counts)])
    t = np.arange(capacity // 2 + 1)
    large = number[-1] - number[capacity - t + 1]
    middle = mass[capacity - t + 1] - mass[t]
    best = int(np.max(large + -(-middle // capacity))) if len(counts) else 0
    for k in range(1, STEPS):
        whole = (k + 1) * sizes % capacity == 0
        # In units of capacity * k: a multiple keeps its size, another one gets floor(...) / k.
        mapped = np.where(whole, sizes * k, (k + 1) * sizes // capacity * capacity)
        best = max(best, -(-int((counts * mapped).sum()) // (capacity * k)))
    return best


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Tokens of every whole text, ended by id 0 and cut into pieces of at most ``capacity``.

    Columns doc_id, piece, start, length, ids_crc32, and with ``with_ids`` the ids. Only documents longer than
    the capacity are cut: all pieces but the first are full. ``path`` names a file of base64 tokens with ranks.
    """

    def batches(frames):
        encoder = _encoder(path)
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                ids = np.append(encoder.encode_to_numpy(text or "", allowed_special="all"), END_ID).astype("<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for number, (start, end) in enumerate(zip(bounds, bounds[1:])):
                    part = ids[start:end]
                    row = (doc, number, start, end - start, zlib.crc32(part.tobytes()))
                    rows.append((*row, part.astype(np.int32)) if with_ids else row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            yield pd.DataFrame(rows, columns=names)

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    columns = "piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return slim.mapInPandas(batches, f"doc_id {kind}, {columns}")


def _encoder(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    special = {"<|endoftext|>": len(ranks)}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _pack_groups(items: DataFrame, capacity: int) -> DataFrame:
    """Packs each group (columns item, length, group); adds seq, offset, fill, bins and bound of the group."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item", kind="stable").reset_index(drop=True)
        sizes = frame["length"].to_numpy()
        bins = best_fit_decreasing(sizes, capacity)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(sizes[order])
        starts = ends - sizes[order]
        first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        offsets = np.empty(len(sizes), dtype=np.int64)
        offsets[order] = starts - np.maximum.accumulate(np.where(first, starts, 0))
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        out = frame[["item", "length", "group"]].copy()
        out["seq"] = frame["group"] * STRIDE + bins
        out["offset"] = offsets
        out["fill"] = fill[bins]
        out["open"] = (fill == fill.min())[bins]
        out["bins"] = len(fill)
        out["bound"] = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        return out

    schema = "item bigint, length bigint, group bigint, seq bigint, offset bigint, fill bigint, open boolean, bins bigint, bound bigint"
    return items.select("item", "length", "group").groupBy("group").applyInPandas(pack, schema)


def _dealt(items: DataFrame, rows: int, first: int, salt: int, group_items: int) -> tuple[DataFrame, int]:
    groups = max(1, -(-rows // group_items))
    number = F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(groups)) + F.lit(first)
    return items.select("item", "length", number.alias("group")), first + groups


def assign(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """item, seq and offset of every row of ``items`` (item bigint, unique; length from 1 to ``capacity``)."""
    sizes = items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per size: capacity at most
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in sizes:
        counts[row["length"]] = row["n"]
    rows, bound = int(counts.sum()), lower_bound(counts, capacity)
    dealt, used = _dealt(items, rows, 0, 0, group_items)
    state = written(_pack_groups(dealt, capacity), "packing")
    total = state.select("seq").distinct().count()
    for number in range(1, rounds + 1):
        if total <= bound:
            break
        loose = F.col("open") | ((F.col("bins") > F.col("bound")) & (F.col("fill") < capacity))
        pool = state.filter(loose)
        size = pool.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("bins")).first()
        dealt, used = _dealt(pool, size["n"], used, number, group_items)
        again = written(_pack_groups(dealt, capacity), "packing")
        saved = size["bins"] - again.select("seq").distinct().count()
        if saved <= 0:
            break
        state = written(state.filter(~loose).unionByName(again), "packing")
        total -= saved
    return state.select("item", "seq", "offset")


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request). A null text is
    empty and makes one piece, the end id alone; repeated rows and ids are pieces of their own; an empty table
    gives no rows. Other columns are ignored.
    """
    cut = pieces(docs, path, capacity, id_col, text_col, with_ids)
    stored = written(cut.withColumn("_item", F.monotonically_increasing_id()), "pieces")
    places = assign(stored.select(F.col("_item").alias("item"), "length"), capacity)
    places = places.select(F.col("item").alias("_item"), F.col("seq").alias("sequence_id"), "offset")
    ordered = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return stored.join(places, "_item").select(ordered)
