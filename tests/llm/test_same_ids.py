"""Different texts under one id, null or not, whose names agree in their low 16 bits."""

import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from tracegrain.llm import prefix_free, recompress

PASSAGE = " ".join(f"shared{i}" for i in range(20))


def _alike(spark):
    """A text that starts with PASSAGE and one that shares nothing with any other."""
    unique = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.concat(F.lit("w"), F.col("id"), F.lit("x"), k)), " ")
    with_it = spark.range(1500).select(F.concat(F.lit(PASSAGE + " "), unique).alias("some"))
    without = spark.range(1500, 3000).select(unique.alias("none"))
    low = lambda c: F.xxhash64(c).bitwiseAND(F.lit(0xFFFF))
    return with_it.join(without, low("some") == low("none")).orderBy("some").first()


@pytest.mark.parametrize("doc", [None, 7])
def test_texts_under_one_id_keep_their_own_spans(spark, doc):
    some, none = _alike(spark)
    df = spark.createDataFrame([(1, PASSAGE), (doc, some), (doc, none)], "doc_id bigint, text string")
    words = {r["n_words"]: r["n_removed"] for r in recompress.removals(df).collect() if r["doc_id"] == doc}
    assert words == {40: 20, 20: 0}
    found = {r["kept_sha256"]: r["n_removed"] for r in prefix_free.removals(df, 40, 12).collect()}
    expected = plain.byte_removals([PASSAGE, some, none], 40)
    assert found == {e[3]: e[1] for e in expected} and expected[2][1] == 0
