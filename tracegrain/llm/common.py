"""Shared pieces of the text operators: stored tables, words and connected components."""

from __future__ import annotations

import contextlib
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.operators.tables import Table, new_path

# White space between words: the blank and the five control characters from tab to carriage return.
BLANKS = "\x20\x09-\x0d"
WORD = re.compile(f"[^{BLANKS}]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Lets Spark drop the shuffle files of a write once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# Tables written since each open ``scratch`` began, innermost last.
_SCRATCH: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes at its end what is ``written`` inside, but for the tables handed to the function it gives.

    That function stores a DataFrame, or takes a table that is stored already.
    """
    made: list[DataFrame] = []
    _SCRATCH.append(made)

    def keep(df: DataFrame, label: str) -> DataFrame:
        table = df if any(t is df for t in made) else written(df, label)
        made[:] = [t for t in made if t is not table]
        if len(_SCRATCH) > 1:
            _SCRATCH[-2].append(table)
        return table

    try:
        yield keep
    finally:
        _SCRATCH.pop()
        discard(*made)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, keeps column pruning, survives lost executors.

    The table takes the place of the shuffle files it came from, so these are dropped.
    """
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(_CLEANUP, "false")
    spark.sparkContext.setJobDescription(label)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
        spark.sparkContext.setJobDescription(None)
    table = spark.read.schema(df.schema).parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(table)
    return table


def spread_rows(df: DataFrame) -> DataFrame:
    """Rows of a table that has fewer splits than there are cores, dealt out evenly; a larger table stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` stored and that nothing still to run reads."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for file in table.inputFiles()[:1]:
            folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def checked_join(rows: DataFrame, lookup: DataFrame, on, how: str) -> DataFrame:
    """Join to a stored table, which is broadcast only if its counted size allows; else both sides are shuffled."""
    return rows.join(F.broadcast(lookup) if Table(lookup).fits_broadcast else lookup, on, how)


def words_column(text: Column) -> Column:
    """Words of a text, unchanged; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), "")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def mix64(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = values.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


# Edges that one task joins up, so that small graphs need no rounds: a bound on its memory.
LOCAL_EDGES = 50_000


def _joined_up(frame: pd.DataFrame) -> pd.DataFrame:
    """Components of all edges (u, v) of a small graph."""
    nodes, at = np.unique(np.concatenate([frame["u"].to_numpy(), frame["v"].to_numpy()]), return_inverse=True)
    links = Links(len(nodes))
    for x, y in zip(at[: len(frame)].tolist(), at[len(frame) :].tolist()):
        links.join(x, y)
    return pd.DataFrame({"node": nodes, "component": nodes[[links.root(x) for x in range(len(nodes))]]})


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: rows (node, component), component being the smallest node.

    A graph of at most ``LOCAL_EDGES`` edges is joined up in one task. In a larger one every round writes to each node the smallest label of its neighbours and then follows that label once
    (pointer jumping), so the number of rounds grows with the logarithm of the diameter in practice. Rounds
    are stored tables, and nothing but the number of changed labels reaches the driver. Only nodes with
    an edge to another node are returned.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = written(pairs.union(pairs.select("v", "u")).distinct(), "component-edges")
    if both.count() <= 2 * LOCAL_EDGES:
        kind = both.schema["u"].dataType.simpleString()
        small = both.filter("u < v").withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_joined_up, f"node {kind}, component {kind}")
        found = written(small, "components")
        discard(both)
        return found
    labels = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")), "component-labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(near, "u").select("u", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("u").alias("low"), F.col("label").alias("far"))
        moved = lower.join(jump, "low", "left").select("u", F.col("label").alias("old"), F.least("low", "far").alias("label"))
        stored = written(moved, "component-labels")
        discard(labels)
        if stored.filter("old <> label").isEmpty():
            discard(both)
            return stored.select(F.col("u").alias("node"), F.col("label").alias("component"))
        labels = stored.select("u", "label")


class Links:
    """Union by smallest root over a dense range of row numbers, used inside one task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class WordHasher:
    """64-bit names of the words of UTF-8 texts, equal for equal words in every task.

    A name mixes, over the bytes of the word, a random number of the byte times one of its place. Different
    words share a name with a probability near 2**-63; ``seed`` gives independent names.
    """

    def __init__(self, seed: int):
        pick = np.random.default_rng([seed, 1])
        self.letters = pick.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.letters[_BLANK] = 0
        self.seed = seed
        self.places = self._places(1 << 12)

    def _places(self, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(self.seed)) | np.uint64(1)

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names, starts and ends (in bytes) of the words."""
        codes = np.frombuffer(data, dtype=np.uint8)
        blank = np.concatenate([[True], _BLANK[codes], [True]])
        starts = np.flatnonzero(blank[:-1] & ~blank[1:])
        ends = np.flatnonzero(~blank[:-1] & blank[1:])
        if not len(starts):
            return np.zeros(0, dtype=np.uint64), starts, ends
        steps = np.diff(np.append(starts, len(codes)))
        place = np.arange(starts[0], len(codes)) - np.repeat(starts, steps)
        if (most := int(steps.max())) > len(self.places):
            self.places = self._places(2 * most)
        with np.errstate(over="ignore"):
            terms = self.letters[codes[starts[0] :]] * self.places[place]
            sums = np.add.reduceat(terms, starts - starts[0])
            return mix64(sums + (ends - starts).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)), starts, ends


def sequence_names(words: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """64-bit names of all runs of ``length`` consecutive words."""
    if len(words) < length:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        factors = mix64(np.arange(1, length + 1, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3) + np.uint64(seed)) | np.uint64(1)
        total = np.full(len(words) - length + 1, length, dtype=np.uint64)
        for k in range(length):
            total += words[k : len(words) - length + 1 + k] * factors[k]
    return mix64(total)


def span_lists(runs: DataFrame) -> DataFrame:
    """The runs (id, h, first, last) of each text in one array of (first, last), ascending and merged.

    A text is told by its id and its whole name h: rows under one id may have different texts.
    """

    def pack(frames):
        for frame in frames:
            spans = []
            for first, last in zip(frame["firsts"], frame["lasts"]):
                first, last = np.asarray(first), np.asarray(last)
                order = np.argsort(first, kind="stable")
                first, reach = first[order], np.maximum.accumulate(last[order])
                # Runs that touch or overlap become one.
                new = np.concatenate([[True], first[1:] > reach[:-1] + 1])
                ends = np.append(np.flatnonzero(new)[1:], len(first)) - 1
                spans.append(np.stack([first[new], reach[ends]], axis=1).ravel())
            yield pd.DataFrame({"id": frame["id"], "h": frame["h"], "spans": spans})

    lists = runs.groupBy("id", "h").agg(F.collect_list(F.struct("first", "last")).alias("r"))
    lists = lists.select("id", "h", F.col("r.first").alias("firsts"), F.col("r.last").alias("lasts"))
    return lists.mapInPandas(pack, "id bigint, h bigint, spans array<bigint>")


def marked(spans, size: int) -> np.ndarray:
    """Which of ``size`` numbers the runs of a text cover, ``spans`` being a list of ``span_lists`` or None."""
    out = np.zeros(size, dtype=bool)
    if spans is not None:
        for first, last in np.asarray(spans).reshape(-1, 2).tolist():
            out[first : last + 1] = True
    return out
