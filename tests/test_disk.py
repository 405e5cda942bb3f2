"""Tables with texts: stored once, compressed, and gone when no later step reads them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tracegrain.functions.text import mask
from tracegrain.operators import dedup
from tracegrain.operators import templates as tm
from tracegrain.operators.tables import shared_dir, stored
from tracegrain.plans.analyze import analyze


def _bytes(spark):
    folders = {shared_dir(spark), spark.sparkContext.getCheckpointDir() or shared_dir(spark)}
    folders = {f.removeprefix("file://").removeprefix("file:") for f in folders}
    folders = [f for f in folders if not any(f != g and f.startswith(g) for g in folders)]
    return sum(os.path.getsize(f"{at}/{name}") for folder in folders for at, _, names in os.walk(folder) for name in names)


def _texts(n=6_000):
    pick = random.Random(7)
    words = ["".join(pick.choice("abcdefghijklmnop") for _ in range(12)) for _ in range(4_000)]
    rows = [" ".join(pick.choice(words) for _ in range(60)) for _ in range(n)]
    return rows + [" ".join(r.split()[:57] + ["x", "y", "z"]) for r in rows[: n // 10]] + rows[: n // 10]


@pytest.mark.parametrize(
    "job",
    [
        lambda df: tm.mine_templates(tm.with_mask(df)).templates.df,
        lambda df: dedup.near_dup_pairs(df, "raw", verify=True),
        lambda df: analyze(df).scored,
    ],
    ids=["templates", "pairs", "analysis"],
)
def test_what_stays_on_disk(spark, lines, job):
    """What a job leaves is no more than twice its input, whatever number of steps carried the texts."""
    texts = _texts()
    before = _bytes(spark)
    result = job(lines(texts))
    assert result.count() > 0
    assert _bytes(spark) - before < 2 * sum(map(len, texts))


def test_stored_columns_that_equal_another(spark):
    rows = [(1, "a", "a", None), (2, None, "b", "b"), (3, "c", None, None), (4, None, None, "d"), (5, "", "", "")]
    df = spark.createDataFrame(rows, "k int, raw string, masked string, other string")
    table = stored(df, "t", {"raw": "masked", "other": "masked"}, longest=F.max(F.length("raw")))
    assert table.df.columns == df.columns and table.rows == 5 and table.observed == {"longest": 1}
    assert sorted(map(tuple, table.df.collect())) == sorted(rows)
    folder = table.path.removeprefix("file://")
    assert os.path.isdir(folder)
    table.drop()
    table.drop()
    assert not os.path.exists(folder)


def test_raw_lines_of_the_analysis(spark, lines):
    """Raw lines come back whole, whether masking changed them or not."""
    texts = ["ERROR disk 10.0.0.1 full", "plain words only here", "two  blanks   in this", "port 8080 open", "", "plain words only here"]
    for options in ({}, {"online": True}, {"freq_source": "raw"}):
        found = {r["line_no"]: (r["raw"], r["template"]) for r in analyze(lines(texts), **options).scored.collect()}
        masks = [r[0] for r in lines(texts).orderBy("line_no").select(mask("raw")).collect()]
        assert found == {i: (texts[i], " ".join(masks[i].split())) for i in range(5)}
