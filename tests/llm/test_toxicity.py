"""Toxicity: held-out precision and recall, misspellings, and the odd texts."""

import numpy as np
from pyspark.sql import functions as F

from tracegrain.llm import queries, toxicity

SF_DIR = "/root/testdata/sf0.1"


def test_held_out_precision_and_recall(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = queries.op8_toxicity(spark, SF_DIR).join(labels, "doc_id").toPandas()
    held = rows[rows["held_out"]]
    right = ((held["predicted"] == 1) & (held["toxic"] == 1)).sum()
    assert right / (held["predicted"] == 1).sum() > 0.9
    assert right / (held["toxic"] == 1).sum() > 0.85
    assert rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= 0.7)).all()


def _model():
    pick = np.random.default_rng(1)
    words = ["".join(pick.choice(list("abcdefgh"), 6)) for _ in range(400)]
    texts = [pick.choice(words, 20).tolist() + (["wretchling"] if i % 2 else []) for i in range(200)]
    return toxicity.fit(texts, np.array([i % 2 for i in range(200)])), words


def test_misspellings_share_vectors():
    model, words = _model()
    chance = 1 - np.exp(model.words(["wretchling", "wretchlingg", "xwretchling", words[0], words[1]]))
    assert chance[:3].min() > 0.5 and chance[3:].max() < 0.1


def test_odd_tables(spark):
    model, words = _model()
    rows = [(1, None), (2, ""), (3, "!! 12"), (4, "wretchling"), (4, "wretchling"), (5, " ".join(words) * 30 + " WRETCHLING")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, score double")
    found = sorted((r["doc_id"], r["score"] > 0.5) for r in toxicity.score(df, model, ["doc_id"]).collect())
    assert found == [(1, False), (2, False), (3, False), (4, True), (4, True), (5, True)]
    assert toxicity.score(df.filter("false"), model, ["doc_id"]).count() == 0
    labels = spark.createDataFrame([(1, 1), (4, None)], "doc_id bigint, toxic int")
    empty = toxicity.train(df, labels, F.lit(True))
    assert toxicity.score(df, empty, ["doc_id"]).filter("score > 0.7").count() == 0
