"""Repeated byte strings by prefix-free parsing.

A rolling hash of the last few bytes triggers the end of a phrase, so texts are parsed into phrases that
overlap by a trigger, and equal strings are parsed equally behind their first trigger. Spark gathers the dictionary:
how often each phrase occurs in all texts. A window of the wanted length can only repeat if every phrase within
it does.

The order of the corpus is then settled trigger by trigger instead of byte by byte. The windows whose first trigger
is the same occurrence start in one phrase and go on with the phrases behind it; the suffix of the first and the
phrases that follow place them in corpus order next to their equals. Where the whole stretch that they cover
occurs again, all of them repeat at once, and only one occurrence of the stretch still stands for them as a partner of
others. What is left, the windows at the ends of repeats, is compared by names of the whole window. Windows
without a phrase in them count as phrases of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.common import checked_join, discard, marked, mix64, scratch, span_lists, written

LENGTH = 400
TRIGGER = 8  # bytes of a trigger
PHRASE = 48  # mean length of a phrase, trigger not counted
SEED = 61
LAST = 2**63 - 1
# Texts that a task holds hashes of at a time.
SLICE = 256


class Parser:
    """Prefix-free parse of byte strings, and names of their substrings.

    Names are differences of running sums of (random number of the byte) times (power of an odd number by the
    place), taken back to place 0: equal for equal substrings, wherever they stand.
    """

    def __init__(self, length: int = LENGTH, phrase: int = PHRASE):
        self.length, self.phrase = length, phrase
        pick = np.random.default_rng(SEED)
        self.bytes = pick.integers(1, 2**64, (2, 256), dtype=np.uint64)
        self.base = [int(x) * 4 + 3 for x in pick.integers(2**40, 2**61, 2)]
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        def powers(base: int) -> np.ndarray:
            with np.errstate(over="ignore"):
                factors = np.full(n + 1, base % 2**64, dtype=np.uint64)
                factors[0] = 1
                return np.cumprod(factors)

        self.up = [powers(b) for b in self.base]
        self.down = [powers(pow(b, -1, 2**64)) for b in self.base]

    def sums(self, data: bytes, which: int = 0) -> np.ndarray:
        """Running sums of the text, 0 first."""
        if len(data) >= len(self.up[0]):
            self._powers(2 * len(data))
        codes = np.frombuffer(data, dtype=np.uint8)
        with np.errstate(over="ignore"):
            terms = self.bytes[which][codes] * self.up[which][: len(codes)]
            return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms)])

    def names(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """Names of the substrings from ``begin`` to ``end``."""
        with np.errstate(over="ignore"):
            return mix64((sums[end] - sums[begin]) * self.down[which][begin] + (end - begin).astype(np.uint64))

    def triggers(self, data: bytes) -> np.ndarray:
        """Places behind the triggers."""
        if len(data) < TRIGGER:
            return np.zeros(0, dtype=np.int64)
        words = np.ndarray(len(data) - TRIGGER + 1, dtype="<u8", buffer=data, strides=(1,))
        hashed = mix64(words)
        return np.flatnonzero(hashed < np.uint64(2**64 // self.phrase)) + TRIGGER


class Parse:
    """What the steps need of one text: phrases, and for each trigger the windows that meet it first."""

    def __init__(self, parser: Parser, data: bytes):
        length = parser.length
        self.parser, self.data, self.sums = parser, data, parser.sums(data)
        self.windows = len(data) - length + 1
        ends = parser.triggers(data)
        # Phrases from trigger to trigger, both included.
        self.begin, self.end = ends[:-1] - TRIGGER, ends[1:]
        # Windows start behind the start of the trigger before and not behind that of their own.
        after = np.concatenate([[0], ends - TRIGGER + 1])
        own, following = np.append(ends, LAST), np.append(ends[1:], [LAST, LAST])[: len(ends) + 1]
        low = np.clip(after, 0, self.windows)
        high = np.clip(np.append(after[1:], self.windows), low, self.windows)
        # Those that end before the second trigger hold no phrase.
        dense = np.clip(following - length, low, high)
        self.bare = _ranges(low, dense)
        some = np.flatnonzero((dense < high) & (own != LAST))
        self.trigger, self.low, self.high = some, dense[some], high[some]  # starts of windows: low .. high - 1

    def phrase_names(self) -> np.ndarray:
        return self.parser.names(self.sums, self.begin, self.end).view(np.int64)

    def bare_names(self) -> np.ndarray:
        names = self.parser.names(self.sums, self.bare, self.bare + self.parser.length)
        return (names ^ np.uint64(SEED)).view(np.int64)

    def stretch_names(self, some: np.ndarray) -> np.ndarray:
        """Names of the stretches covered by the windows of some triggers."""
        return self.parser.names(self.sums, self.low[some], self.high[some] - 1 + self.parser.length).view(np.int64)

    def possible(self, repeated: np.ndarray) -> np.ndarray:
        """Whether each window may repeat: no phrase within it is unique. ``repeated`` tells it of each phrase."""
        length = self.parser.length
        short = ~repeated & (self.end - self.begin <= length)
        change = np.zeros(self.windows + 1, dtype=np.int64)
        np.add.at(change, np.clip(self.end[short] - length, 0, self.windows), 1)
        np.add.at(change, np.clip(self.begin[short] + 1, 0, self.windows), -1)
        return np.cumsum(change[:-1]) == 0


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges low .. high - 1, one after the other."""
    count = high - low
    return np.arange(count.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count)


def _texts(frame: pd.DataFrame, length: int, parser: Parser):
    """Parses of the texts of a frame that hold a window, with id and name of the text."""
    for doc, h, text, *more in frame.itertuples(index=False):
        data = text.encode("utf-8", "surrogatepass")
        if len(data) >= length:
            yield doc, int(h), Parse(parser, data), *more


def _rows(parts: list[tuple], names: str):
    return pd.DataFrame(dict(zip(names.split(), map(np.concatenate, zip(*parts)))))


def _slices(frames):
    for frame in frames:
        for start in range(0, len(frame), SLICE):
            yield frame.iloc[start : start + SLICE]


def _phrases(texts: DataFrame, length: int, phrase: int) -> DataFrame:
    """name, id, text name and number within the text of the phrases and then the bare windows of every text."""

    def emit(frames):
        parser = Parser(length, phrase)
        for frame in _slices(frames):
            parts = []
            for doc, h, parse in _texts(frame, length, parser):
                names = np.concatenate([parse.phrase_names(), parse.bare_names()])
                parts.append((names, np.full(len(names), doc), np.full(len(names), h), np.arange(len(names))))
            if parts:
                yield _rows(parts, "name id h first")

    return texts.select("id", "h", "text").mapInPandas(emit, "name bigint, id bigint, h bigint, first bigint")


def _chosen(parse: Parse, spans) -> tuple[np.ndarray, np.ndarray]:
    """Windows that may repeat, and the triggers that have such windows."""
    repeated = marked(spans, len(parse.begin) + len(parse.bare))
    possible = parse.possible(repeated[: len(parse.begin)])
    possible[parse.bare] = repeated[len(parse.begin) :]
    total = np.concatenate([[0], np.cumsum(possible)])
    return possible, np.flatnonzero(total[parse.high] > total[parse.low])


def _stretches(listed: DataFrame, length: int, phrase: int) -> DataFrame:
    """stretch, phrase, id, text name and number of every trigger whose windows may repeat."""

    def emit(frames):
        parser = Parser(length, phrase)
        for frame in _slices(frames):
            parts = []
            for doc, h, parse, spans in _texts(frame, length, parser):
                some = _chosen(parse, spans)[1]
                phrases = parse.phrase_names()[parse.trigger[some]]
                parts.append((parse.stretch_names(some), phrases, np.full(len(some), doc), np.full(len(some), h), some))
            if parts:
                yield _rows(parts, "stretch phrase id h first")

    rows = listed.select("id", "h", "text", "spans")
    return rows.mapInPandas(emit, "stretch bigint, phrase bigint, id bigint, h bigint, first bigint")


def _left_over(listed: DataFrame, length: int, phrase: int) -> DataFrame:
    """Runs of windows that repeat as a stretch (first, until), and single windows to compare (a, b, first)."""

    def emit(frames):
        parser = Parser(length, phrase)
        for frame in _slices(frames):
            parts = []
            for doc, h, parse, spans, again, stands in _texts(frame, length, parser):
                possible = _chosen(parse, spans)[0]
                again = marked(again, len(parse.low))
                stands = marked(stands, len(parse.low))
                possible[_ranges(parse.low[again & ~stands], parse.high[again & ~stands])] = False
                at = np.flatnonzero(possible)
                second = parser.sums(parse.data, 1)
                a = parser.names(parse.sums, at, at + length).view(np.int64)
                b = (parser.names(second, at, at + length, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                low, until = parse.low[again], parse.high[again]
                none, nothing = np.zeros(len(low), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
                first = np.concatenate([at, low])
                text = np.full(len(first), doc), np.full(len(first), h)
                parts.append((np.append(a, none), np.append(b, none.astype(np.int32)), *text, first, np.append(nothing, until)))
            if parts:
                yield _rows(parts, "a b id h first until")

    rows = listed.select("id", "h", "text", "spans", "again", "stands")
    return rows.mapInPandas(emit, "a bigint, b int, id bigint, h bigint, first bigint, until bigint")


def _runs(rows: DataFrame, label: str) -> DataFrame:
    """Runs of consecutive numbers of each text, as a stored table."""
    return written(span_lists(rows.select("id", "h", "first", F.col("first").alias("last"))), label)


def repeated_windows(texts: DataFrame, length: int, phrase: int) -> DataFrame:
    """Runs of windows that occur elsewhere, in another text or in the same one: a stored table of ``span_lists``."""
    found = written(_phrases(texts, length, phrase), "phrases")
    dictionary = written(found.groupBy("name").count().filter("count > 1").select("name"), "repeated-phrases")
    spans = _runs(found.join(dictionary, "name"), "phrase-runs")
    discard(found, dictionary)
    # Runs grow with the texts, so both sides are shuffled at every size.
    listed = texts.join(spans, ["id", "h"])
    rows = written(_stretches(listed, length, phrase), "stretches")
    by = rows.groupBy("stretch").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "h", "first")).alias("least"), F.min("phrase").alias("phrase")
    )
    by = written(by, "stretch-counts")
    asked = by.filter("n = 1").select("phrase").distinct().withColumn("asked", F.lit(True))
    again = by.filter("n > 1").join(written(asked, "asked-phrases"), "phrase", "left").select("stretch", "least", "asked")
    twice = written(rows.select("stretch", "id", "h", "first").join(written(again, "repeated-stretches"), "stretch"), "marked-stretches")
    # One occurrence stands for all as long as some single window might meet it.
    stands = twice.filter(F.col("asked") & (F.struct("id", "h", "first") == F.col("least")))
    stands = _runs(stands, "standing-runs").withColumnRenamed("spans", "stands")
    again = _runs(twice, "stretch-runs").withColumnRenamed("spans", "again")
    discard(rows, by, twice)
    listed = listed.join(again, ["id", "h"], "left").join(stands, ["id", "h"], "left")
    rows = written(_left_over(listed, length, phrase), "left-over")
    single = rows.filter("until = 0").select("a", "b", "id", "h", "first")
    names = written(single.groupBy("a", "b").count().filter("count > 1").select("a", "b"), "repeated-windows")
    matched = single.join(names, ["a", "b"]).select("id", "h", "first", F.col("first").alias("last"))
    whole = rows.filter("until > 0").select("id", "h", "first", F.col("until") - 1)
    out = written(span_lists(matched.unionAll(whole)), "window-runs")
    discard(rows, names)
    return out


def removals(
    docs: DataFrame,
    length: int = LENGTH,
    phrase: int = PHRASE,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    with_text: bool = False,
) -> DataFrame:
    """Takes out every byte under a string of ``length`` bytes that also starts anywhere else.

    Columns: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the remaining bytes, and on
    request the remaining text, without bytes that no longer make a character. Null and empty texts have no bytes. A
    repeated row is elsewhere for its copies, so texts of at least ``length`` bytes that occur twice go
    as a whole. The columns named in ``keep`` come along as keep_0, keep_1 and so on; others are ignored.
    """
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    base = docs.select(F.coalesce(F.col(id_col), F.lit(LAST)).cast("long").alias("id"), text, *kept)
    base = base.withColumn("h", F.xxhash64("text"))
    with scratch() as keep_table:
        keys = written(base.select("id", "h", F.md5("text").alias("whole")), "text-names")
        firsts = keys.groupBy("whole").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        # Rows of texts that occur twice or more; the least of each stands for them in the corpus.
        copies = keys.join(firsts, "whole").select("id", "h", (F.col("id") > F.col("least")).alias("later")).distinct()
        copies = keep_table(copies, "text-copies")
        later = copies.filter("later").select("id", "h")
        texts = checked_join(base, later, ["id", "h"], "left_anti")
        spans = keep_table(repeated_windows(texts, length, phrase), "window-runs")
    found = checked_join(base, copies.select("id", "h", F.lit(True).alias("copy")), ["id", "h"], "left")
    along = [f"keep_{i}" for i in range(len(keep))]
    found = checked_join(found, spans, ["id", "h"], "left").select("id", "text", "copy", "spans", *along)

    def take(frames):
        for frame in frames:
            rows = [_kept(*row, length) for row in zip(frame["text"], frame["copy"], frame["spans"])]
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])
            out.insert(0, "doc_id", frame["id"].to_numpy())
            out = out if with_text else out.drop(columns="text")
            yield out.assign(**{c: frame[c].to_numpy() for c in along})

    more = ", text string" * with_text + "".join(f", {f.name} {f.dataType.simpleString()}" for f in base.select(along).schema)
    schema = f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{more}"
    found = found.mapInPandas(take, schema)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")).cast(docs.schema[id_col].dataType))


def stripped(
    docs: DataFrame, length: int = LENGTH, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the remaining text of every document; a column n_chars gets its length. No row is dropped."""
    along = tuple(c for c in docs.columns if c not in (id_col, text_col))
    found = removals(docs, length, phrase, id_col, text_col, along, with_text=True)
    names = {id_col: "doc_id", text_col: "text"} | {c: f"keep_{i}" for i, c in enumerate(along)}
    columns = [F.col(names[c]).alias(c) for c in docs.columns]
    if "n_chars" in along:
        columns[docs.columns.index("n_chars")] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return found.select(columns)


def _kept(text: str, copy: bool | None, spans, length: int) -> tuple[int, int, int, str, str]:
    data = text.encode("utf-8", "surrogatepass")
    runs: list[tuple[int, int]] = []
    if copy is True:
        runs = [(0, len(data))] if len(data) >= length else []
    elif spans is not None:
        for first, last in np.asarray(spans).reshape(-1, 2).tolist():
            # Windows further apart than their length leave bytes between them.
            if runs and first <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(runs[-1][1], last + length))
            else:
                runs.append((first, last + length))
    edges = [0, *(e for run in runs for e in run), len(data)]
    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")
