"""Packing: ids of the library, gapless sequences, bounds that hold, and rounds that only save."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests import oracle
from tracegrain.llm import packing, queries

SF_DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _check(rows, capacity):
    by = {}
    for row in rows:
        by.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_query_against_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(oracle.connect(SF_DIR).execute("select doc_id, text from documents").fetchall())
    rows = queries.op7_packing(spark, SF_DIR).collect()
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for d, t in texts.items()}
    by = {}
    for row in rows:
        by.setdefault(row["doc_id"], []).append(row)
        part = ids[row["doc_id"]][row["start"] : row["start"] + row["length"]]
        assert row["ids_crc32"] == zlib.crc32(part.tobytes())
    assert set(by) == set(texts)
    for doc, parts in by.items():
        parts.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert [r["start"] for r in parts] == [sum(r["length"] for r in parts[:i]) for i in range(len(parts))]
        assert sum(r["length"] for r in parts) == len(ids[doc])
        assert len(parts) == 1 or all(r["length"] == 2048 for r in parts[1:])
    used = _check(rows, 2048)
    assert used >= packing.lower_bound(np.bincount([r["length"] for r in rows], minlength=2049))


def _fewest(sizes, capacity):
    best = len(sizes)
    for labels in itertools.product(range(len(sizes)), repeat=len(sizes)):
        fill = {}
        for label, size in zip(labels, sizes):
            fill[label] = fill.get(label, 0) + size
        if max(fill.values()) <= capacity:
            best = min(best, len(fill))
    return best


def test_bound_never_exceeds_the_best_packing():
    pick = random.Random(5)
    for _ in range(60):
        sizes = [pick.randrange(1, 13) for _ in range(5)]
        best = _fewest(sizes, 12)
        assert packing.lower_bound(np.bincount(sizes, minlength=13), 12) <= best
        assert best <= packing.best_fit_decreasing(np.array(sizes), 12).max() + 1
    assert packing.lower_bound(np.bincount([7] * 5, minlength=13), 12) == 5
    assert packing.lower_bound(np.bincount([5] * 6, minlength=13), 12) == 3


def test_exchange_between_groups_saves_sequences(spark):
    sizes = [random.Random(i).randrange(1, 1500) for i in range(900)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item bigint, length bigint")
    counts = []
    for rounds in (0, 4):
        rows = packing.assign(items, 2048, group_items=30, rounds=rounds).join(items, "item")
        counts.append(_check(rows.withColumnRenamed("seq", "sequence_id").collect(), 2048))
        assert rows.count() == 900
    assert counts[1] < counts[0]


def test_odd_tables(spark):
    rows = [(None, None, 1), (None, "", 1), (7, "a b", 1), (7, "a b", 1), (8, "word " * 9_000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, length int")
    out = packing.pack(df, PATH, with_ids=True).collect()
    assert sorted(r["length"] for r in out if r["doc_id"] != 8) == [1, 1, 3, 3]
    assert [r["ids"] for r in out if r["doc_id"] is None] == [[0], [0]]
    _check(out, 2048)
    assert packing.pack(df.filter("false"), PATH).count() == 0
