"""Alignment of two tokenizers over the same bytes, by pointer jumping.

A text is cut at blanks between two other characters. Both tokenizers start a token at such a blank, so
tokens, groups and links of a text are those of its segments one after the other, and every different segment is
worked out once per task. For the new segments of a batch the tokens of both sides lie on one axis of
bytes. Every token points to the token farthest to the right among those it overlaps; where a token of the second
side ends together with one of the first, the second side's is the farther one. Replacing all pointers by the
pointers of what they point to doubles their reach, so after a few rounds, each one array operation for all tokens, every
token points to the last token of its group.

A link is a pair of overlapping tokens, one of each side. Links are counted for the whole corpus: a task sums the
occurrences of its segments before anything is shuffled, and there are no more counts than pairs of ids.
Counts are brought back to the documents by a broadcast of the most frequent pairs, bounded in number, and by a
shuffle join for the links that it does not cover, which are rare and so not skewed.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.common import discard, written
from tracegrain.operators.tables import BROADCAST_ROWS

# Segments remembered by a task; characters of texts that are aligned together.
SEGMENTS = 200_000
CHUNK = 1 << 20
# A pair of ids in one number: the first side's id times this, plus the second side's.
SIDE = 1 << 31

_CUT = re.compile(r"(?<=\S) (?=\S)")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Segments:
    """The segments seen by a task, with their tokens, groups and links, in arrays by segment number."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.a_size[rank] = len(token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_size = np.array([len(p) for p in self.b_bytes], dtype=np.int64)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        # Per segment: whether both sides give its bytes back, tokens of both sides, groups, links.
        self.facts = np.zeros((0, 5), dtype=np.int64)
        self.keys = np.zeros(0, dtype=np.int64)
        self.first = np.zeros(1, dtype=np.int64)

    def numbers(self, segments: list[str]) -> np.ndarray:
        """Numbers of the segments, given in the order of a text; new ones are aligned."""
        known = self.number
        new = [s for s in dict.fromkeys(segments) if s not in known]
        if new:
            self._learn(new)
        return np.fromiter(map(known.__getitem__, segments), dtype=np.int64, count=len(segments))

    def _learn(self, new: list[str]) -> None:
        """Aligns new segments, each given with the blank before it."""
        a_ids = [self.a.encode_ordinary(s) for s in new]
        b_ids = self.b.encode([s[1:] for s in new], num_threads=1)
        for k, segment in enumerate(new):
            self.number[segment] = len(self.groups) + k
            if b"".join(map(self.b_bytes.__getitem__, b_ids[k])) != segment.encode():
                a_ids[k], b_ids[k] = [], []  # not to be aligned; marked below
        facts, keys, groups = align(a_ids, b_ids, self.a_size, self.b_size)
        self.facts = np.concatenate([self.facts, facts])
        self.keys = np.concatenate([self.keys, keys])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(facts[:, 4])])
        self.groups += groups


def _piece_bytes(piece: str) -> bytes:
    match = _BYTE.fullmatch(piece)
    return bytes([int(match[1], 16)]) if match else piece.replace("▁", " ").encode()


def align(a_ids: list[list[int]], b_ids: list[list[int]], a_size: np.ndarray, b_size: np.ndarray):
    """Aligns the tokens of two sides over many segments at once; both sides of a segment have the same bytes.

    Returns per segment (aligned, tokens of a, tokens of b, groups, links), the links of all segments as pairs of
    ids, and per segment the groups as text.
    """
    n = len(a_ids)
    na, nb = (np.fromiter(map(len, ids), dtype=np.int64, count=n) for ids in (a_ids, b_ids))
    a = np.fromiter((i for ids in a_ids for i in ids), dtype=np.int64, count=int(na.sum()))
    b = np.fromiter((i for ids in b_ids for i in ids), dtype=np.int64, count=int(nb.sum()))
    a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    terminal = terminals(a_end - a_size[a], a_end, b_end - b_size[b], b_end)
    # Groups in order, by the last token of the second side.
    last = np.flatnonzero(terminal[len(a) :] == np.arange(len(a), len(a) + len(b)))
    a_group = np.searchsorted(last, terminal[: len(a)] - len(a))
    b_group = np.searchsorted(last, terminal[len(a) :] - len(a))
    # Every stretch between two neighbouring token ends lies in one token of each side, and is a link.
    cuts = np.union1d(a_end, b_end)
    at_a, at_b = np.searchsorted(a_end, cuts), np.searchsorted(b_end, cuts)
    keys = a[at_a] * SIDE + b[at_b]
    owner = np.repeat(np.arange(n), na)
    links = np.bincount(owner[at_a], minlength=n)
    ends = np.bincount(np.repeat(np.arange(n), nb)[last], minlength=n)
    facts = np.stack([na > 0, na, nb, ends, links], axis=1).astype(np.int64)
    texts = _texts(a, a_group, b, b_group, len(last))
    bounds = np.concatenate([[0], np.cumsum(ends)]).tolist()
    return facts, keys, [";".join(texts[i:j]) for i, j in zip(bounds, bounds[1:])]


def terminals(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """The last token of the group of every token, tokens of a being numbered first.

    Both sides cover the same bytes. Sorted by start, the farthest-right overlap of a token is the token of the other
    side that holds its last byte, or itself where that one ends no later.
    """
    n = len(a_end)
    to_b = np.searchsorted(b_start, a_end) - 1 + n
    to_a = np.searchsorted(a_start, b_end) - 1
    own = np.arange(n, n + len(b_end))
    pointer = np.concatenate([to_b, np.where(a_end[to_a] > b_end, to_a, own) if len(own) else own])
    while True:
        farther = pointer[pointer]
        if np.array_equal(farther, pointer):
            return pointer
        pointer = farther


def _texts(a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, groups: int) -> list[str]:
    sides = []
    for ids, group in ((a, a_group), (b, b_group)):
        words, bounds = list(map(str, ids.tolist())), np.searchsorted(group, np.arange(groups + 1)).tolist()
        sides.append([words[i] if j == i + 1 else ",".join(words[i:j]) for i, j in zip(bounds, bounds[1:])])
    return [f"{x}|{y}" for x, y in zip(*sides)]


def _gathered(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions first[i] .. first[i] + count[i] - 1 of all i, one after the other."""
    total = np.cumsum(count)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(first - (total - count), count)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    """Rows of a batch in chunks of bounded length: the first row and the texts."""
    texts, size, start = [], 0, 0
    for k, text in enumerate(batch.column("text").to_pylist()):
        texts.append(text)
        size += len(text or "")
        if size >= CHUNK:
            yield start, texts
            texts, size, start = [], 0, k + 1
    if texts:
        yield start, texts


def _aligned_chunk(texts: list[str | None], known: Segments) -> tuple[np.ndarray, list[str], tuple]:
    """Counts, digests, and distinct links with their numbers, of each text of a chunk."""
    if len(known.number) > SEGMENTS:
        known.clear()
    cut = [_CUT.split(t) if t else [] for t in texts]
    size = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
    numbers = known.numbers([" " + s for segments in cut for s in segments])
    row = np.repeat(np.arange(len(texts)), size)
    facts = known.facts[numbers]
    whole = np.bincount(row, weights=1 - facts[:, 0], minlength=len(texts)) == 0
    numbers, row, facts = numbers[whole[row]], row[whole[row]], facts[whole[row]]
    counts = np.stack([np.bincount(row, weights=facts[:, k], minlength=len(texts)) for k in range(1, 5)], axis=1)
    bounds = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
    order = numbers.tolist()
    digests = []
    for i, j in zip(bounds, bounds[1:]):
        text = ";".join([known.groups[s] for s in order[i:j]])
        digests.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
    keys = known.keys[_gathered(known.first[numbers], facts[:, 4])]
    pairs, place = np.unique(keys, return_inverse=True)
    held, times = np.unique(np.repeat(row, facts[:, 4]) * max(len(pairs), 1) + place, return_counts=True)
    of = held // max(len(pairs), 1)
    offsets = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
    return counts.astype(np.int64), digests, (offsets, pairs[held % max(len(pairs), 1)] if len(held) else held, times)


def _aligned(slim: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, the counts of a text, its digest, and its distinct links as ``keys`` with their numbers ``times``."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Segments(a_path, b_path)
        for batch in frames:
            for start, texts in _chunks(batch):
                counts, digests, (offsets, keys, times) = _aligned_chunk(texts, known)
                columns = [batch.column("doc_id").slice(start, len(texts)), *map(pa.array, counts.T.copy()), pa.array(digests)]
                offsets = pa.array(offsets)
                columns += [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())) for v in (keys, times)]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"]
    kind = slim.schema["doc_id"].dataType.simpleString()
    counts = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"
    return slim.mapInArrow(batches, f"doc_id {kind}, {counts}, groups_sha256 string, keys array<bigint>, times array<bigint>")


def _pair_counts(aligned: DataFrame) -> DataFrame:
    """key, n (links of the corpus that hold the pair) and best (no pair of the same second id has more)."""
    links = aligned.select(F.explode(F.arrays_zip("keys", "times")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.times").alias("t"))
    counted = written(links.groupBy("key").agg(F.sum("t").alias("n")), "pair-counts")
    second = (F.col("key") % SIDE).alias("b")
    most = counted.groupBy(second).agg(F.max("n").alias("most"))
    marked = counted.select("key", "n", second).join(most, "b").select("key", "n", (F.col("n") == F.col("most")).alias("best"))
    stored = written(marked, "pairs")
    discard(counted)
    return stored


def _cut(pairs: DataFrame, rows: int) -> int:
    """The smallest power of two such that at most ``rows`` pairs have as many links."""
    sizes = pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("rows"))
    held, power = 0, 63
    for size in sorted(sizes.collect(), reverse=True):  # 63 rows at most
        held += size["rows"]
        if held > rows:
            break
        power = size["power"]
    else:
        power = 0
    return 1 << power


def token_alignment(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Aligns the tokens of both tokenizers over every whole text, and measures the pairs over the corpus.

    ``a_path`` names a file of base64 tokens with ranks (byte-level BPE, given a blank and the text), ``b_path`` a
    piece model that puts a blank before the text itself and has no piece with a blank behind another
    character. Columns: the id column; n_a, n_b, n_groups, n_links; n_best, links whose count is the highest of all
    pairs with their second id, ties included; count_sum, the counts of all links added up; groups_sha256, of the groups
    ``a1,a2|b1;…`` in order. A null or empty text, and one that a tokenizer does not give back byte by byte, has no
    tokens: all zero, the digest ''. Repeated rows and null ids are rows of their own and count each time; an
    empty table gives no rows; other columns are ignored. At most ``broadcast_rows`` pairs are broadcast.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    stored = written(_aligned(slim, a_path, b_path).withColumn("_row", F.monotonically_increasing_id()), "alignment")
    pairs = _pair_counts(stored)
    least = _cut(pairs, broadcast_rows)
    links = stored.select("_row", F.explode(F.arrays_zip("keys", "times")).alias("x"))
    links = links.select("_row", F.col("x.keys").alias("key"), F.col("x.times").alias("t"))
    # Bounded: ``_cut`` has counted them.
    frequent = F.broadcast(pairs.filter(F.col("n") >= least))
    value = [F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("n_best"), F.sum(F.col("t") * F.col("n")).alias("count_sum")]
    sums = links.join(frequent, "key").groupBy("_row").agg(*value)
    if least > 1:
        rest = links.join(frequent.select("key"), "key", "left_anti")
        rare = rest.join(pairs.filter(F.col("n") < least), "key").groupBy("_row").agg(*value)
        sums = sums.unionByName(rare).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    facts = stored.select("_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda name: F.coalesce(name, F.lit(0).cast("bigint")).alias(name)
    return facts.join(sums, "_row", "left").select(
        F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )
