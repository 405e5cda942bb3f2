"""Ranked lexical search for a set of items by a dual tree.

Both sides are trees whose nodes hold coordinate maxima: a node of documents the highest impact of every term among
its documents, a node of items the highest weight of every term among its items. The product of two nodes bounds the
score of every document of the one for every item of the other. Where it is below the weakest k-th score of the items,
the pair of nodes is dropped whole; else both are opened, down to single items and leaves of a few documents, which
are scored exactly, best bound first. All arithmetic is in whole numbers, so bounds are never too low.

Items come in blocks of bounded size that are known to every task; documents stay where they are. One pass over the texts
keeps, per document, its length and the terms that some item of the block asks for. The k-th scores found in a small
sample of these rows are where every task starts from: they are scores of real documents, so nothing that belongs into
the result lies below them. A task returns k documents per item at most, and the best of all are taken by a window.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.llm.common import discard, spread_rows, written

TOP = 10
# Bounds of a block: items, and their distinct terms (a single item may have more).
BLOCK_ITEMS = 1_024
BLOCK_TERMS = 1 << 15
# Documents of a leaf, children of a node, and numbers in the maxima of a task.
LEAF = 32
FAN = 4
CELLS = 1 << 22
# Share of the rows that give the first thresholds.
SAMPLE = 0.02
# Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20
# Stands for a null id, behind all others.
LAST = (1 << 63) - 1

# Terms hold ASCII letters and digits and all bytes of other characters; only A to Z are folded.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def term_runs(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded length; null has none."""
    data = (text or "").encode().translate(_FOLD)
    start = 0
    while len(data) - start > PIECE and (cut := data.find(b" ", start + PIECE)) >= 0:
        yield data[start:cut].split()
        start = cut
    yield data[start:].split()


class Block:
    """Items with their terms, numbered within the block."""

    def __init__(self, items: list[tuple[object, Counter]]):
        self.ids = [i for i, _ in items]
        self.vocabulary = {t: k for k, t in enumerate(dict.fromkeys(t for _, terms in items for t in terms))}
        self.terms = [np.array([self.vocabulary[t] for t in terms], dtype=np.int64) for _, terms in items]
        self.times = [np.array(list(terms.values()), dtype=np.int64) for _, terms in items]


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """All items, in blocks; the rows are streamed, so that the driver holds one block at a time."""
    held, vocabulary = [], set()
    for item, text in items.select(id_col, text_col).toLocalIterator():
        terms = Counter(t for run in term_runs(text) for t in run)
        if held and (len(held) >= BLOCK_ITEMS or len(vocabulary | terms.keys()) > BLOCK_TERMS):
            yield Block(held)
            held, vocabulary = [], set()
        held.append((item, terms))
        vocabulary |= terms.keys()
    if held:
        yield Block(held)


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Per document its number of terms n and, for the terms of the vocabulary, numbers and occurrences."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            n, terms, times, size = [], [], [], []
            for text in batch.column("text"):
                found, count = Counter(), 0
                for run in term_runs(text.as_py()):
                    count += len(run)
                    found.update([vocabulary[t] for t in run if t in vocabulary])
                n.append(count)
                terms.extend(found.keys())
                times.extend(found.values())
                size.append(len(found))
            ends = pa.array(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v, kind)) for v, kind in ((terms, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return spread_rows(slim).mapInArrow(batches, "doc_id bigint, n bigint, terms array<int>, times array<bigint>")


class Node:
    """Items first .. last - 1 of the ordered block, with the highest weight of each of their terms."""

    def __init__(self, first: int, last: int, terms: np.ndarray, weights: np.ndarray, children: list[Node]):
        self.first, self.last, self.terms, self.weights, self.children = first, last, terms, weights, children


def item_tree(terms: list[np.ndarray], weights: list[np.ndarray]) -> tuple[Node, list[int]]:
    """The tree over items with terms, and the item of each place: items with the same heaviest term are neighbours."""
    order = sorted(range(len(terms)), key=lambda i: sorted(zip((-weights[i]).tolist(), terms[i].tolist()))[:4])
    level = [Node(k, k + 1, terms[i], weights[i], []) for k, i in enumerate(order)]
    while len(level) > 1:
        upper = []
        for part in (level[i : i + FAN] for i in range(0, len(level), FAN)):
            every, place = np.unique(np.concatenate([p.terms for p in part]), return_inverse=True)
            most = np.zeros(len(every), dtype=np.int64)
            np.maximum.at(most, place, np.concatenate([p.weights for p in part]))
            upper.append(Node(part[0].first, part[-1].last, every, most, part))
        level = upper
    return level[0], order


class Documents:
    """A tree over documents: rows of terms with impacts, ordered so that a leaf's documents have much in common."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, terms: np.ndarray, impacts: np.ndarray, vocabulary: int):
        row = np.repeat(np.arange(len(ids)), size)
        # By the term of highest impact; the last of them in this order.
        by_impact = np.lexsort((terms, impacts, row))
        top = np.full(len(ids), -1, dtype=np.int64)
        top[row[by_impact]] = terms[by_impact]
        order = np.argsort(top, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        entries = np.argsort(place[row], kind="stable")
        self.ids, self.terms, self.impacts = ids[order], terms[entries], impacts[entries]
        self.first = np.concatenate([[0], np.cumsum(size[order])])
        leaves = -(-len(ids) // LEAF)
        maxima = np.zeros((leaves, vocabulary), dtype=np.int32)
        np.maximum.at(maxima, (place[row[entries]] // LEAF, self.terms), self.impacts.astype(np.int32))
        self.levels = [maxima]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN), axis=0))


class Search:
    """The best documents of every item of a block among those offered so far."""

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray], floor: np.ndarray, top: int, vocabulary: int):
        self.root, self.order = item_tree(terms, weights)
        # The k-th score of the item of each place, or what is known to be no higher than it.
        self.least = floor[self.order].copy()
        self.best: list[list[tuple[int, int]]] = [[] for _ in terms]  # by place: (minus score, id)
        self.top, self.dense = top, np.zeros(vocabulary, dtype=np.int64)
        self.scored = 0

    def offer(self, docs: Documents) -> None:
        self._visit(self.root, docs, len(docs.levels) - 1, np.arange(len(docs.levels[-1])))

    def _visit(self, items: Node, docs: Documents, level: int, nodes: np.ndarray) -> None:
        bounds = docs.levels[level][nodes[:, None], items.terms] @ items.weights
        near = (bounds > 0) & (bounds >= self.least[items.first : items.last].min())
        nodes, bounds = nodes[near], bounds[near]
        if not len(nodes):
            return
        if not level and not items.children:
            self._score(items, docs, nodes, bounds)
            return
        if level:
            nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            nodes = nodes[nodes < len(docs.levels[level - 1])]
        for child in items.children or [items]:
            self._visit(child, docs, max(level - 1, 0), nodes)

    def _score(self, item: Node, docs: Documents, leaves: np.ndarray, bounds: np.ndarray) -> None:
        place, best = item.first, self.best[item.first]
        self.dense[item.terms] = item.weights
        for k in np.argsort(-bounds, kind="stable").tolist():
            if bounds[k] < self.least[place]:
                break
            low = int(leaves[k]) * LEAF
            first = docs.first[low : low + LEAF + 1]
            part = slice(int(first[0]), int(first[-1]))
            total = np.concatenate([[0], np.cumsum(self.dense[docs.terms[part]] * docs.impacts[part])])
            scores = np.diff(total[first - first[0]])
            self.scored += len(scores)
            for i in np.flatnonzero((scores > 0) & (scores >= self.least[place])).tolist():
                best.append((-int(scores[i]), int(docs.ids[low + i])))
            if len(best) > self.top:
                best.sort()
                del best[self.top :]
            if len(best) == self.top:
                self.least[place] = max(int(self.least[place]), -max(best)[0])
        self.dense[item.terms] = 0


def _impacts(times: np.ndarray, n: np.ndarray, total: tuple[int, int]) -> np.ndarray:
    """Whole-number impact of terms that occur ``times`` in documents of n terms; total: documents, terms of all."""
    m = 25 + (75 * n * total[0]) // total[1]
    return (1_000_000_000 * times) // (1_000 * times + 8 * m)


def _searched(rows: DataFrame, block: Block, weights: list[np.ndarray], total: tuple[int, int], floor: np.ndarray, top: int) -> DataFrame:
    """The best documents of every task: item (number in the block), doc_id, score."""
    size = len(block.vocabulary)
    chunk = LEAF * min(max(CELLS // size, 1), 256)
    asked = [k for k, terms in enumerate(block.terms) if len(terms)]
    terms, heavy, low = [block.terms[k] for k in asked], [weights[k] for k in asked], floor[asked]

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(terms, heavy, low, top, size)
        for batch in frames:
            for start in range(0, len(batch), chunk):
                part = batch.slice(start, chunk)
                lists = [part.column(name) for name in ("terms", "times")]
                count = np.diff(lists[0].offsets.to_numpy()).astype(np.int64)
                number, times = (x.flatten().to_numpy().astype(np.int64) for x in lists)
                n = np.repeat(part.column("n").to_numpy(), count)
                ids = part.column("doc_id").fill_null(LAST).to_numpy()
                search.offer(Documents(ids, count, number, _impacts(times, n, total), size))
        found = [(asked[i], doc, -score) for place, i in enumerate(search.order) for score, doc in search.best[place]]
        columns = [pa.array([row[k] for row in found], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return rows.filter(F.size("terms") > 0).mapInArrow(batches, "item int, doc_id bigint, score bigint")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    window = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top)


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The ``top`` documents of highest score above 0 for every item, over all documents and whole texts.

    Terms, weights and scores are those of the query's contract (a BM25-like score in whole numbers). Columns: item_id (the
    name in ``item_col``), rank from 1, doc_id (whole numbers), score; equal scores by ascending id, null ids last.
    An item without terms, or none of whose terms occur, has no rows; repeated items are ranked each on its own, and
    repeated documents take a rank each. Null and empty texts have no terms and count for nothing. Empty tables give
    no rows; other columns are ignored. The result is computed when the function is called.
    """
    spark, results = docs.sparkSession, []
    kind = items.schema[item_col].dataType.simpleString()
    for block in blocks(items, item_col, item_text_col):
        if not block.vocabulary:
            continue
        rows = written(postings(docs, block.vocabulary, id_col, text_col), "postings")
        total = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if total["docs"]:
            # A row per term of the block at most.
            held = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()
            df = np.zeros(len(block.vocabulary), dtype=np.int64)
            for row in held:
                df[row["t"]] = row["df"]
            weight = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
            weights = [weight[t] * k for t, k in zip(block.terms, block.times)]
            floor = np.zeros(len(block.ids), dtype=np.int64)
            sample = rows.sample(SAMPLE, 1)
            for row in _ranked(_searched(sample, block, weights, tuple(total), floor, top), top).filter(F.col("rank") == top).collect():
                floor[row["item"]] = row["score"]
            best = _ranked(_searched(rows, block, weights, tuple(total), floor, top), top)
            names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, _item {kind}")
            found = best.join(F.broadcast(names), "item")  # a block's items
            doc = F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id")
            results.append(written(found.select(F.col("_item").alias(item_col), "rank", doc, "score"), "ranked"))
        discard(rows)
    if not results:
        return spark.createDataFrame([], f"{item_col} {kind}, rank int, doc_id bigint, score bigint")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
