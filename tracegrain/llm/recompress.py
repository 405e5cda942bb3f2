"""Repeated word windows found by recompression.

A text is a row of word names. A round of recompression gives every run of equal symbols one symbol and then
every pair of a "left" and a "right" symbol next to each other one symbol; a bit of a symbol's name says which
it is. Names are computed from what they stand for, so a round needs no exchange: equal runs and pairs get equal
names in every task, globally. What a symbol depends on is a stretch of words around it, tracked
through the rounds; wherever that stretch occurs, the same symbol stands inside it.

Every window of words therefore has, among the symbols that depend on words of the window alone, one of most
bytes, white space not counted (the smallest name breaks ties): its anchor. Equal windows have equal anchors. Spark counts in which
documents an anchor occurs; windows under an anchor of one document can't repeat elsewhere and go no further. The
others are verified by 96-bit names of the whole window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.common import WordHasher, checked_join, discard, marked, mix64, span_lists, written

WINDOW = 13
ROUNDS = 2
SEED = 41
NONE = np.uint64(2**64 - 1)
# Characters that are parsed at a time, and what stands between two texts.
BATCH = 1 << 17
BETWEEN = b"\n\x00\n"
# Stands for a null id, which counts as larger than all others.
LAST = 2**63 - 1

_A, _B, _C = (np.uint64(x) for x in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0x9FB21C651E98DF25))


def anchors(names: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """The anchor of every window; the name of the window itself where no symbol depends on it alone."""
    count = len(names) - window + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    best = np.full(count, NONE)
    first, last = np.arange(len(names)), np.arange(len(names))  # words of a symbol
    low, high = first, first + 1  # words it depends on
    total = np.concatenate([[0], np.cumsum(ends - starts)])  # bytes of words, without what stands between them
    for _ in range(rounds):
        names, first, last, low, high = _runs(names, first, last, low, high, len(starts))
        names, first, last, low, high, made = _pairs(names, first, last, low, high, len(starts))
        size = np.minimum(total[last[made] + 1] - total[first[made]], 255).astype(np.uint64)
        keys = ((np.uint64(255) - size) << np.uint64(56)) | (names[made] >> np.uint64(8))
        best = np.minimum(best, _least(keys, low[made], high[made], count, window))
    return best


def _runs(names, first, last, low, high, words):
    """Runs of equal symbols become one; every symbol now depends on its neighbours, which differ from it."""
    same = names[1:] == names[:-1]
    low = np.concatenate([[-1], low[:-1]])
    high = np.concatenate([high[1:], [words + 1]])
    if not same.any():
        return names, first, last, low, high
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    tails = np.append(heads[1:], len(names)) - 1
    length = (tails - heads + 1).astype(np.uint64)
    with np.errstate(over="ignore"):
        runs = np.where(length > 1, mix64(names[heads] * _A + length * _B), names[heads])
    return runs, first[heads], last[tails], low[heads], high[tails]


def _pairs(names, first, last, low, high, words):
    """Left and right symbols next to each other become one; a single one depends on the one it didn't meet."""
    right = ((names >> np.uint64(20)) & np.uint64(1)).astype(bool)
    made = np.append(~right[:-1] & right[1:], False)
    taken = np.concatenate([[False], made[:-1]])
    follower = np.append(names[1:], np.uint64(0))
    with np.errstate(over="ignore"):
        names = np.where(made, mix64(names * _B + follower * _C + _A), names)
    next_high, before_low = np.append(high[1:], words + 1), np.concatenate([[-1], low[:-1]])
    last = np.where(made, np.append(last[1:], 0), last)
    high = np.where(~right, next_high, high)
    low = np.where(right, before_low, low)
    keep = ~taken
    return names[keep], first[keep], last[keep], low[keep], high[keep], made[keep]


def _least(keys: np.ndarray, low: np.ndarray, high: np.ndarray, count: int, window: int) -> np.ndarray:
    """Smallest key of each window among the symbols that depend on its words alone; both bounds ascend."""
    if not len(keys):
        return np.full(count, NONE)
    at = np.arange(count)
    begin, end = np.searchsorted(low, at), np.searchsorted(high, at + window, side="right")
    padded = np.append(keys, NONE)
    least = np.minimum.reduceat(padded, np.stack([begin, np.maximum(begin, end)], axis=1).ravel())[::2]
    return np.where(begin < end, least, NONE)


class Windows:
    """Words, anchors and names of the windows of several texts at a time.

    The texts stand one after the other with a word of their own between them; windows that hold that word
    are left out, and so is every symbol that depends on it.
    """

    def __init__(self, window: int = WINDOW):
        self.window, self.hasher = window, WordHasher(SEED)

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word names, then of every window its place among all words, its text and its anchor."""
        parts = [text.encode("utf-8", "surrogatepass") for text in texts]
        names, starts, ends = self.hasher(BETWEEN.join(parts))
        begin = np.cumsum([0, *(len(p) + len(BETWEEN) for p in parts[:-1]), 0])[:-1]
        text = np.searchsorted(begin, starts, side="right") - 1
        text[starts >= begin[text] + np.array([len(p) for p in parts])[text]] = -1
        at = np.flatnonzero((text[: len(names) - self.window + 1] == text[self.window - 1 :]) & (text[self.window - 1 :] >= 0))
        found = anchors(names, starts, ends, self.window)[at]
        bare = np.flatnonzero(found == NONE)
        if len(bare):
            found[bare] = self.names(names, at[bare])[0].view(np.uint64)
        return names, at, text[at], found

    def first_words(self, texts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place of the first window of the text of each window."""
        new = np.concatenate([[True], texts[1:] != texts[:-1]])
        return np.maximum.accumulate(np.where(new, at, 0))

    def names(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit and a 32-bit name of the windows that start at ``at``."""
        return (
            _names_at(words, at, self.window, SEED).view(np.int64),
            (_names_at(words, at, self.window, SEED + 1) >> np.uint64(32)).astype(np.uint32).view(np.int32),
        )


def _names_at(words: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        factors = mix64(np.arange(1, length + 1, dtype=np.uint64) * _B + np.uint64(seed)) | np.uint64(1)
        total = np.full(len(at), length, dtype=np.uint64)
        for k in range(length):
            total += words[at + k] * factors[k]
    return mix64(total)


def _batches(frame: pd.DataFrame):
    """Slices of a frame with about ``BATCH`` characters, one row at least."""
    size = np.cumsum(frame["text"].str.len().to_numpy())
    start = 0
    while start < len(frame):
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + BATCH, side="right")))
        yield frame.iloc[start:end]
        start = end


def _copies(base: DataFrame) -> DataFrame:
    """Ids and text names of documents whose whole text stands in a document of smaller id."""
    keys = written(base.select("id", "h", F.md5("text").alias("whole")), "text-names")
    firsts = keys.groupBy("whole").agg(F.min("id").alias("least"))
    return written(keys.join(firsts, "whole").filter("id > least").select("id", "h").distinct(), "text-copies")


def _anchor_rows(base: DataFrame, window: int) -> DataFrame:
    """name, id, text name and code of every run of windows with one anchor.

    A code holds the place of the first window and the length of the run.
    """

    def emit(frames):
        windows = Windows(window)
        for frame in frames:
            for some in _batches(frame):
                words, at, texts, found = windows.parse(some["text"].tolist())
                if not len(at):
                    continue
                new = np.concatenate([[True], (found[1:] != found[:-1]) | (texts[1:] != texts[:-1])])
                # Runs longer than a code can tell are cut.
                first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                new = np.flatnonzero(new | ((np.arange(len(at)) - first) % 255 == 0))
                length = np.diff(np.append(new, len(at)))
                place = (at - windows.first_words(texts, at))[new]
                ids, names = (some[c].to_numpy()[texts[new]] for c in ("id", "h"))
                yield pd.DataFrame({"name": found[new].view(np.int64), "id": ids, "h": names, "code": place << 8 | length})

    return base.select("id", "h", "text").mapInPandas(emit, "name bigint, id bigint, h bigint, code bigint")


def _window_rows(listed: DataFrame, window: int) -> DataFrame:
    """The windows under shared anchors: two names, id, text name and place."""

    def emit(frames):
        windows = Windows(window)
        for frame in frames:
            for some in _batches(frame):
                parts = []
                for doc, h, text, spans in some[["id", "h", "text", "spans"]].itertuples(index=False):
                    words = windows.hasher(text.encode("utf-8", "surrogatepass"))[0]
                    at = np.flatnonzero(marked(spans, max(len(words) - window + 1, 0)))
                    parts.append((*windows.names(words, at), np.full(len(at), doc), np.full(len(at), h), at))
                yield pd.DataFrame(dict(zip(("a", "b", "id", "h", "first"), map(np.concatenate, zip(*parts)))))

    rows = listed.select("id", "h", "text", "spans")
    return rows.mapInPandas(emit, "a bigint, b int, id bigint, h bigint, first bigint")


def repeated_windows(base: DataFrame, window: int) -> DataFrame:
    """Runs of windows that also start in a document of smaller id, as a stored table of ``span_lists``."""
    found = written(_anchor_rows(base, window), "anchors")
    shared = found.groupBy("name").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("name")
    shared = written(shared, "shared-anchors")
    place, length = F.shiftright("code", 8), F.col("code").bitwiseAND(F.lit(255))
    runs = found.join(shared, "name").select("id", "h", place.alias("first"), (place + length - 1).alias("last"))
    lists = written(span_lists(runs), "anchor-runs")
    discard(found, shared)
    # Grows with the texts, so both sides are shuffled at every size.
    rows = written(_window_rows(base.join(lists, ["id", "h"]), window), "windows")
    least = rows.groupBy("a", "b").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    least = written(least.select("a", "b", "low"), "repeated-windows")
    later = rows.join(least, ["a", "b"]).filter("id > low")
    spans = written(span_lists(later.select("id", "h", "first", F.col("first").alias("last"))), "window-runs")
    discard(rows, least)
    return spans


def removals(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Takes out every word under a window that also starts in a document of smaller id.

    Columns: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space, and on request that
    text. Null and empty texts have no words. Rows under one id don't count against each other, repeated rows
    of one id included; null ids count as larger than all others. Other columns are ignored.
    """
    base = docs.select(F.coalesce(F.col(id_col), F.lit(LAST)).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("h", F.xxhash64("text"))
    copies = _copies(base)
    # What stands in a smaller document as a whole is settled; its windows are all found there.
    singles = checked_join(base, copies, ["id", "h"], "left_anti")
    spans = repeated_windows(singles, window)
    rows = checked_join(base, copies.withColumn("copy", F.lit(True)), ["id", "h"], "left")
    rows = checked_join(rows, spans, ["id", "h"], "left").select("id", "text", "copy", "spans")

    def take(frames):
        for frame in frames:
            rows = [_kept(*row, window) for row in zip(frame["text"], frame["copy"], frame["spans"])]
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "text"])
            out.insert(0, "doc_id", frame["id"].to_numpy())
            yield out if with_text else out.drop(columns="text")

    more = ", text string" * with_text
    found = rows.mapInPandas(take, f"doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string{more}")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")).cast(docs.schema[id_col].dataType))


def _kept(text: str, copy: bool | None, spans, window: int) -> tuple[int, int, str, str]:
    # Bytes are split at the blank and the control characters from tab to carriage return.
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if copy is True:
        words = words if n < window else []
    elif spans is not None:
        keep = np.ones(n, dtype=bool)
        for first, last in np.asarray(spans).reshape(-1, 2):
            keep[first : last + window] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    kept = b" ".join(words)
    return n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")
