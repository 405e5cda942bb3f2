"""Prefix-free parsing against plain Python, with phrases of any length, and the odd tables."""

import random

import pytest

from tests import oracle
from tests.llm import plain
from tracegrain.llm import prefix_free, queries

SF_DIR = "/root/testdata/sf0.001"


def _found(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_query_against_plain_python(spark):
    rows = oracle.connect(SF_DIR).execute("select doc_id, text from documents").fetchall()
    expected = plain.byte_removals([t for _, t in rows], 400)
    assert _found(queries.op9_suffixes(spark, SF_DIR)) == {d: e[:4] for (d, _), e in zip(rows, expected)}


@pytest.mark.parametrize("phrase", [3, 12, 200])
def test_repeats_anywhere(spark, phrase):
    pick = random.Random(phrase)
    part = lambda n, letters="abcdé": "".join(pick.choice(letters) for _ in range(n))
    passages = [part(pick.randrange(20, 90)) for _ in range(6)]
    texts = ["".join(pick.choice([part(pick.randrange(50)), pick.choice(passages)]) for _ in range(6)) for _ in range(50)]
    texts += [None, "", "x" * 300, "ab" * 200, part(30), "é" * 50, texts[0], passages[0] * 3, part(20_000, "ab")]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, h int")
    expected = plain.byte_removals(texts, 40)
    assert _found(prefix_free.removals(df, 40, phrase)) == {d: e[:4] for d, e in enumerate(expected)}
    kept = {r["doc_id"]: r["text"] for r in prefix_free.stripped(df, 40).collect()}
    assert kept == {d: e[4].decode("utf-8", "ignore") for d, e in enumerate(expected)}


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "z" * 39, 1), (5, "q" * 400, 2), (5, "q" * 400, 2), (6, "short", 3)], "doc_id bigint, text string, n_chars int")
    found = sorted(prefix_free.removals(df).collect(), key=repr)
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in found) == [(0, 0), (5, 400), (5, 400), (6, 0)]
    out = prefix_free.stripped(df)
    assert out.columns == df.columns
    assert sorted(r["n_chars"] for r in out.collect()) == [0, 0, 5, 39]
    assert prefix_free.removals(df.filter("false")).count() == 0
