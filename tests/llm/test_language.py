"""Language identification: held-out accuracy, codewords, and the odd texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrain.llm import language, queries

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    langs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = queries.op1_language(spark, SF_DIR).join(langs, "doc_id").toPandas()
    held = rows[rows["held_out"]]
    assert len(rows) == 1000 and 250 < len(held) < 420
    assert (held["lang_pred"] == held["lang"]).mean() > 0.98
    assert rows["score"].between(0, 1).all()


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
    assert min(apart) >= (1 if n == 2 else code.shape[1] // 5)
    assert (np.abs(code.sum(axis=0)) < n).all()


def test_chunks_count_like_the_whole(monkeypatch):
    letters = language.letter_table()
    text = "Der schnelle  braune Fuchs -- springt über 3 Hunde, ja! " * 9
    whole = language.gram_counts(text, letters)
    for piece in (1, 2, 3, 7, 50):
        monkeypatch.setattr(language, "PIECE", piece)
        assert np.allclose(language.gram_counts(text, letters), whole)
    assert language.gram_counts("12 +!", letters) is None


def test_an_even_split_is_ambiguous():
    code = language.codewords(4)
    model = language.Model(list("abcd"), code, np.zeros((2, code.shape[1])), np.zeros(code.shape[1]), np.full(code.shape, 1 / code.shape[1]))
    model.weights[0] = 5 * code[2]
    best, score, unsure = model.predict(np.array([[1.0, 0.0], [0.0, 1.0]]))
    assert best[0] == 2 and score[0] > 0.9 and not unsure[0] and unsure[1]


def test_odd_tables(spark):
    rows = [(1, "der und die das ist nicht " * 5, "de"), (2, "the and of to in that is " * 5, "en"), (3, None, "en"), (4, "", None)]
    rows += [(5, "12 34 !?", "en"), (6, "und nicht die das", None), (6, "und nicht die das", None), (7, "the of and " * 50_000, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, lang string, score int")
    model = language.train(df, F.lit(True))
    found = sorted((r["doc_id"], r["lang_pred"]) for r in language.identify(df, model, ["doc_id"]).collect())
    assert found == [(1, "de"), (2, "en"), (3, "und"), (4, "und"), (5, "und"), (6, "de"), (6, "de"), (7, "en")]
    clash = df.selectExpr("*", "1 as _score", "'x' as lang_pred", "2 as row", "named_struct('a', 1) as ambiguous")
    kept = language.keep_known(clash)
    assert kept.columns == clash.columns
    assert {tuple(r[4:]) for r in kept.collect()} == {(1, "x", 2, (1,))}
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 6, 6, 7]
    assert language.train(df.filter("lang is null"), F.lit(True)) is None
    assert {r["lang_pred"] for r in language.identify(df, None, ["doc_id"]).collect()} == {"und"}
    assert language.keep_known(df.filter("false")).count() == 0


def test_copies_do_not_thin_the_sample(spark):
    texts = [f"satz nummer {i}" for i in range(500)] + ["immer wieder derselbe satz"] * 100_000
    df = spark.createDataFrame([("de", t) for t in texts] + [("en", "the one text")], "lang string, text string")
    found = language.training_sample(df, F.lit(True)).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in found} == {"de": 501, "en": 1}


def test_no_language_is_left_out(spark):
    """Many languages share the bound on training rows; the rarest is still learned."""
    count = 200
    letters = "abcdefghijklmnopqrstuvwxyz"
    pick = np.random.default_rng(1)
    stems = ["".join(letters[c] for c in pick.integers(0, 26, 5)) for _ in range(count)]
    rows = [(f"l{i:03}", f"{stem} {stem}{letters[k]} {stem[:3]}{letters[k]}") for i, stem in enumerate(stems) for k in range(2 if i else 12)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert language.training_sample(df, F.lit(True)).select("lang").distinct().count() == count
    model = language.train(df, F.lit(True))
    assert len(model.languages) == count
    found = language.identify(df, model, ["lang"]).toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.9
