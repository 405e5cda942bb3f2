"""The Jaccard join against plain Python, in one piece and in many, and the odd tables."""

import random

import numpy as np
import pytest

from tests import oracle
from tests.llm import plain
from tracegrain.llm import jaccard, queries

SF_DIR = "/root/testdata/sf0.001"


def _expected(rows, size=3, percent=90):
    sizes, first = plain.shingle_components([t for _, t in rows], size, percent)
    return {d: (n, rows[f][0]) for (d, _), n, f in zip(rows, sizes, first)}


def _found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_against_plain_python(spark):
    rows = oracle.connect(SF_DIR).execute("select doc_id, text from documents order by doc_id").fetchall()
    assert _found(queries.op5_jaccard(spark, SF_DIR)) == _expected(rows)


@pytest.mark.parametrize("piece, small", [(5, 64), (1000, 64), (5, 3)])
def test_groups_of_near_copies(spark, monkeypatch, piece, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    pick = random.Random(piece)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(4):
        base = [word() for _ in range(80)]
        for _ in range(15):
            copy = list(base)
            for _ in range(pick.randrange(5)):
                copy[pick.randrange(80)] = word()
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for size, percent in ((3, 90), (5, 80)):
        assert _found(jaccard.link(df, percent, size, piece)) == _expected(rows, size, percent)


def test_odd_tables(spark):
    rows = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (5, "a"), (6, "x " * 20_000), (7, "X " * 20_000), (8, "É é É"), (9, "é é é")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, n bigint")
    assert _found(jaccard.link(df)) == _expected(rows)
    # Repeated rows of an id are one node, a null id stands alone.
    more = spark.createDataFrame([(4, "a B", 1), (None, "a b", 1)], df.schema)
    found = jaccard.link(df.union(more)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found if r["doc_id"] in (3, 4)) == [(3, 3), (4, 3), (4, 3)]
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [None]
    assert jaccard.link(df.filter("false")).count() == 0
    kept = jaccard.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 5, 6, 8, 9]


def test_sketches_never_rule_out_a_link():
    pick = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(pick.integers(0, 2**63, int(pick.integers(1, 900)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[pick.random(len(a)) < 0.9], pick.integers(0, 2**63, int(pick.integers(0, 40)), dtype=np.uint64)]))
        one, two = (np.frombuffer(jaccard.sketch(x), dtype=np.uint64) for x in (a, b))
        assert np.bitwise_count(one ^ two).sum() <= len(np.setxor1d(a, b))


def test_shared_passages_and_chance_shingles(spark, monkeypatch):
    """Short vocabularies: rare shingles are shared by chance, a passage by all, and few documents link."""
    pick = random.Random(9)
    words = [f"w{i}" for i in range(14)]
    passage = " ".join(pick.choice(words) for _ in range(30))
    rows = [(i, " ".join(pick.choice(words) for _ in range(60)) + " " + passage) for i in range(150)]
    for i in range(0, 40, 2):
        other = rows[i][1].split()
        other[pick.randrange(50)] = "x"
        rows.append((1000 + i, " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = _expected(rows, 3, 80)
    assert _found(jaccard.link(df, 80)) == expected
    for small, piece in ((2, 1_000), (8, 4)):
        monkeypatch.setattr(jaccard, "SMALL", small)
        assert _found(jaccard.link(df, 80, piece=piece)) == expected


def test_documents_of_a_common_shingle_are_not_searched_among_each_other(spark, monkeypatch):
    """Of a bucket far larger than a piece, only documents that might link reach the search with their sets."""
    pick = random.Random(4)
    words = [f"w{i}" for i in range(14)]
    passage = " ".join(pick.choice(words) for _ in range(30))
    rows = [(i, " ".join(pick.choice(words) for _ in range(60)) + " " + passage) for i in range(200)]
    rows += [(1000 + i, "x " + rows[i][1]) for i in range(0, 20, 2)]
    searched, find = [], jaccard._find_links
    monkeypatch.setattr(jaccard, "_find_links", lambda tasks, *more: searched.append(tasks.count()) or find(tasks, *more))
    monkeypatch.setattr(jaccard, "SMALL", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    assert _found(jaccard.link(spark.createDataFrame(rows, "doc_id bigint, text string"), 80, piece=10)) == _expected(rows, 3, 80)
    assert 20 <= sum(searched) <= 2 * len(rows)
