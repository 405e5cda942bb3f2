"""The subspace join against brute force, hot cells included, and the odd vectors."""

import numpy as np
import pytest

from tests.llm import plain
from tracegrain.llm import queries, subspace

SF_DIR = "/root/testdata/sf0.001"


def _expected(rows, cosine):
    unit = [None if v is None else np.array(v, dtype=float) / np.linalg.norm(v) for _, v, _ in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and float(unit[i] @ unit[j]) >= cosine
    ]
    roots = plain.components(len(rows), [(j, i) for i, j in links])
    counts = np.bincount(np.array(links, dtype=int).ravel(), minlength=len(rows))
    return {r[0]: (int(n), rows[c][0], c == i) for i, (r, n, c) in enumerate(zip(rows, counts, roots))}


def _found(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding", "label").orderBy("vec_id").collect()]
    assert _found(queries.op10_embeddings(spark, SF_DIR)) == _expected(rows, 0.93)


@pytest.mark.parametrize("size, piece", [(10, 4), (7, 1_024)])
def test_clusters(spark, monkeypatch, size, piece):
    monkeypatch.setattr(subspace, "PIECE", piece)
    pick = np.random.default_rng(size)
    centers = pick.normal(size=(5, size))
    rows = [(i, (centers[i % 5] + pick.normal(scale=0.12, size=size)).tolist(), i % 2) for i in range(120)]
    rows += [(200 + i, rows[0][1], 0) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    expected = _expected(rows, 0.93)
    assert sum(n for n, _, _ in expected.values()) > 500
    assert _found(subspace.near_duplicates(df)) == expected


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1), (3, [1.0, 2.0], 2), (4, [1.0, 2.0], None), (5, None, 1), (6, [0.0, 0.0], 1)]
    rows += [(7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 2.0, 0.0], 1), (None, [1.0, 2.0], 1)]
    rows += [(1, [1.0, 2.0], 1), (12, [0.0, 1.0], 3), (13, [-0.0, 1.0], 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, cell string")
    found = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in subspace.near_duplicates(df).collect()), key=repr)
    linked = [(1, 2, 1), (1, 2, 1), (2, 2, 1), (12, 1, 12), (13, 1, 12), (None, 0, None)]
    alone = [(i, 0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert found == sorted(linked + alone, key=repr)
    assert subspace.near_duplicates(df.filter("false")).count() == 0


def test_vectors_are_not_repeated_per_cell(spark, monkeypatch):
    """No table on the way has more rows than the input: a vector moves once per piece of its label, not once per cell."""
    pick = np.random.default_rng(3)
    vectors = pick.normal(size=(150, 64))
    vectors[100:] = vectors[:50] + pick.normal(scale=0.02, size=(50, 64))
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(vectors)]
    sizes, store = [], subspace.written

    def counted(df, label):
        table = store(df, label)
        sizes.append(table.count())
        return table

    monkeypatch.setattr(subspace, "written", counted)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert _found(subspace.near_duplicates(df)) == _expected(rows, 0.93)
    assert max(sizes) <= len(rows)


def test_tiles_and_pieces(spark, monkeypatch):
    """Links across products of few rows, in one piece and between several, with repeated and scaled vectors."""
    monkeypatch.setattr(subspace, "TILE", 8)
    pick = np.random.default_rng(4)
    centers = pick.normal(size=(4, 40))
    rows = [(i, (centers[i % 4] * (1 + i) + (1 + i) * pick.normal(scale=0.15, size=40)).tolist(), 0) for i in range(90)]
    rows += [(100 + i, rows[i][1], 0) for i in range(5)]
    expected = _expected(rows, 0.93)
    assert sum(n for n, _, _ in expected.values()) > 500
    for piece in (16, 1_024):
        monkeypatch.setattr(subspace, "PIECE", piece)
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
        assert _found(subspace.near_duplicates(df)) == expected
