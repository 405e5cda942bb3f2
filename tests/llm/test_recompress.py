"""Recompression: windows against plain Python, anchors that equal windows share, and the odd tables."""

import random

import numpy as np

from tests import oracle
from tests.llm import plain
from tracegrain.llm import queries, recompress

SF_DIR = "/root/testdata/sf0.001"


def _found(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def test_query_against_plain_python(spark):
    rows = oracle.connect(SF_DIR).execute("select doc_id, text from documents").fetchall()
    assert _found(queries.op2_substrings(spark, SF_DIR)) == plain.window_removals(rows, 13)


def test_equal_windows_have_equal_anchors():
    pick = random.Random(2)
    tool = recompress.Windows(6)
    for _ in range(200):
        middle = " ".join(pick.choice("abc") for _ in range(pick.randrange(6, 30)))
        known = {}
        for _ in range(3):
            text = " ".join([pick.choice("abc") for _ in range(pick.randrange(9))] + [middle] + [pick.choice("abc") for _ in range(pick.randrange(9))])
            words, at, _, anchors = tool.parse([text, "a b", text])
            names = tool.names(words, at)[0]
            for name, anchor in zip(names.tolist(), anchors.tolist()):
                assert known.setdefault(name, anchor) == anchor


def test_rounds_name_runs_and_pairs():
    names = np.array([5, 5, 5, 9, 5, 5, 5], dtype=np.uint64)
    at = np.arange(7)
    runs, first, last, low, high = recompress._runs(names, at, at, at, at + 1, 7)
    assert runs[0] == runs[2] != np.uint64(5) and runs[1] == 9
    assert (first.tolist(), last.tolist()) == ([0, 3, 4], [2, 3, 6])
    assert (low.tolist(), high.tolist()) == ([-1, 2, 3], [4, 5, 8])


def test_small_alphabets_and_odd_tables(spark):
    pick = random.Random(4)
    rows = [(i, " ".join(pick.choice("ab") for _ in range(pick.randrange(60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a " * 30_000), (103, "a " * 30_000), (104, "b\ta\n" * 20)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, h int")
    assert _found(recompress.removals(df)) == plain.window_removals(rows, 13)
    assert recompress.removals(df.filter("false")).count() == 0
    text = " ".join(f"w{i}" for i in range(20))
    odd = spark.createDataFrame([(5, text), (5, text), (5, text + " z"), (None, text), (None, text)], "doc_id bigint, text string")
    found = recompress.removals(odd, with_text=True).collect()
    assert sorted(r["n_removed"] for r in found if r["doc_id"] == 5) == [0, 0, 0]
    assert [(r["n_removed"], r["text"]) for r in found if r["doc_id"] is None] == [(20, "")] * 2


def test_white_space_does_not_matter(spark):
    pick = random.Random(7)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(pick.randrange(1, 9)))
    rows = []
    for i in range(0, 40, 4):
        words = [word() for _ in range(40)]
        rows += [(i, " ".join(words)), (i + 1, "  ".join(words)), (i + 2, "\r\n".join(words))]
        rows.append((i + 3, "".join(w + pick.choice([" ", "  ", "\t", "\r\n", "\n    "]) for w in words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert _found(recompress.removals(df)) == plain.window_removals(rows, 13)
    tool = recompress.Windows()
    once, *others = [tool.parse([text])[3].tolist() for _, text in rows[:4]]
    assert all(anchors == once for anchors in others)
