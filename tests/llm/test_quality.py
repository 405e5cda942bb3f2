"""Quality rules: counts against SQL, the cascade in any order, and the odd texts."""

import itertools

import pytest
from pyspark.sql import functions as F

from tests import oracle
from tracegrain.llm import quality, queries

SF_DIR = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    expected = oracle.sql_rows(oracle.connect(SF_DIR), queries.ORACLES["op4_quality"])
    assert oracle.spark_rows(queries.op4_quality(spark, SF_DIR)) == expected


def _count(words):
    """Words under windows that occur twice, the plain way."""
    size = quality.WINDOW
    grams = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    covered = set()
    for i, gram in enumerate(grams):
        if grams.count(gram) > 1:
            covered.update(range(i, i + size))
    return len(covered)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a", "a " * 30, "a b c d e f g h " * 2, "x a b c d e f g h y a b c d e f g h"])
def test_odd_texts(spark, text):
    df = spark.createDataFrame([(1, text, "x")], "doc_id bigint, text string, n_words string")
    row = quality.judge(df).first()
    words = (text or "").split()
    assert (row["n_words"], row["n_repeat_words"]) == (len(words), _count(words))
    assert row["base_failed"] == (len(words) < 20 or 100 * row["n_repeat_words"] > 30 * len(words))
    assert not (row["base_failed"] and row["kept"])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert quality.judge(df).count() == 0
    assert quality.keep_good(df).count() == 0


def test_order_of_rules_never_changes_the_verdict(spark):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    good = {r[0] for r in quality.judge(df).filter("kept").collect()}
    assert {r[0] for r in kept.select("doc_id").collect()} == good
    for rules in itertools.islice(itertools.permutations(quality.BASE_RULES + quality.RULES), 0, 40_000, 15_000):
        rows = quality.cascade(df, rules)
        assert {r[0] for r in rows.filter("rejected_by is null").select("doc_id").collect()} == good


def test_dear_rules_come_later(spark):
    sample = spark.range(2000).select(F.concat_ws(" ", F.array_repeat("id", 200)).alias("_text"))
    never = quality.Rule("never", ("n_words", "n_repeat_words"), lambda n, r: n + r < 0)
    always = quality.Rule("always", ("n_words",), lambda n: n > 0)
    assert [r.name for r in quality.plan_cascade(sample, (never, always))] == ["always", "never"]
