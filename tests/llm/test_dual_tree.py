"""Dual-tree search: against the SQL and plain Python, with pruning, blocks and the odd tables."""

import collections
import math
import random
import re

import numpy as np

from tracegrain.llm import dual_tree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _plain(docs, items, top=10):
    bags = [(d, collections.Counter(_terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            m = 25 + (75 * sum(bag.values()) * n) // length
            score = 0
            for t in _terms(text):
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, math.inf if doc is None else doc))
        for rank, (score, doc) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, None if doc == math.inf else doc, -score))
    return sorted(out, key=repr)


def _found(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=repr)


def _tables(spark, docs, items):
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id bigint, text string, n int, score int")
    return frame, spark.createDataFrame(items, "item_id bigint, text string")


def test_random_tables_with_ties(spark, monkeypatch):
    pick = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Été", "naïve", "ÉTÉ", "日本", "a1", "1"]
    text = lambda most: pick.choice([" ", "-", "\n"]).join(pick.choice(words[: pick.randrange(2, 67)]) for _ in range(pick.randrange(most)))
    docs = [(i, text(80)) for i in range(700)]
    docs += [(1000 + i, docs[i % 40][1]) for i in range(400)]  # equal scores
    docs += [(None, docs[1][1]), (None, "w1 w2"), (5, docs[5][1]), (2000, None), (2001, ""), (2002, "-- !!"), (2003, "w3 " * 4000)]
    items = [(i, text(30)) for i in range(40)] + [(50, None), (51, "!!"), (52, "unknown"), (53, "w1"), (53, "w1"), (None, "W2 w3 w3")]
    expected = _plain(docs, items)
    frames = _tables(spark, docs, items)
    assert _found(dual_tree.search(*frames)) == expected
    # Several blocks of items, small chunks of documents and pieces of text.
    monkeypatch.setattr(dual_tree, "BLOCK_ITEMS", 17)
    monkeypatch.setattr(dual_tree, "CELLS", 400)
    monkeypatch.setattr(dual_tree, "PIECE", 50)
    monkeypatch.setattr(dual_tree, "SAMPLE", 0.3)
    assert _found(dual_tree.search(*frames)) == expected
    assert _found(dual_tree.search(*frames, top=3)) == _plain(docs, items, 3)


def test_empty_tables(spark):
    docs, items = _tables(spark, [(1, "a b")], [(1, "a")])
    assert dual_tree.search(docs.filter("false"), items).collect() == []
    assert dual_tree.search(docs, items.filter("false")).collect() == []
    assert dual_tree.search(docs, items.filter("false")).columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_prune_whole_batches():
    pick = np.random.default_rng(1)
    size, docs = 200, 4096
    terms = [pick.choice(size, 6, replace=False) for _ in range(50)]
    weights = [pick.integers(1, 9_000, 6) for _ in terms]
    # Documents of one topic share their terms.
    topic = pick.integers(0, 20, docs)
    rows = [np.unique(np.concatenate([(t * 10 + pick.integers(0, 10, 5)), pick.integers(0, size, 1)])) for t in topic]
    count = np.array([len(r) for r in rows])
    impacts = pick.integers(1, 900_000, int(count.sum()))
    tree = dual_tree.Documents(np.arange(docs), count, np.concatenate(rows), impacts, size)
    search = dual_tree.Search(terms, weights, np.zeros(50, dtype=np.int64), 10, size)
    search.offer(tree)
    dense = np.zeros((docs, size), dtype=np.int64)
    dense[np.repeat(np.arange(docs), count), np.concatenate(rows)] = impacts
    for place, item in enumerate(search.order):
        scores = dense[:, terms[item]] @ weights[item]
        expected = sorted((-int(s), i) for i, s in enumerate(scores) if s > 0)[:10]
        assert sorted(search.best[place]) == expected
    assert search.scored < 0.5 * docs * len(terms)
