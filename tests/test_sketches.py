import math

import pytest
from pyspark.sql import functions as F

from tracegrain.operators import sketches


def test_merged_counts_are_near_the_exact_ones(spark):
    df = spark.range(60_000).select((F.col("id") % 40).alias("chunk_id"), F.concat(F.lit("t"), F.pmod(F.xxhash64("id"), F.lit(9_000))).alias("template"))
    kept = sketches.template_sketches(df, "chunk_id")
    exact = df.select("template").distinct().count()
    assert abs(sketches.merged_templates(kept).first()[0] - exact) <= 0.05 * exact
    half = sketches.merged_templates(kept.filter("chunk_id < 20")).first()[0]
    exact = df.filter("chunk_id < 20").select("template").distinct().count()
    assert abs(half - exact) <= 0.05 * exact
    by = {r["odd"]: r["unique_templates"] for r in sketches.merged_templates(kept, (F.col("chunk_id") % 2).alias("odd")).collect()}
    assert set(by) == {0, 1}


@pytest.mark.parametrize("share", [0.05, 0.5, 0.99])
def test_merged_quantiles_have_the_stated_rank(spark, share):
    df = spark.range(50_000).select((F.col("id") % 25).alias("c"), F.sqrt(F.pmod(F.xxhash64("id"), F.lit(1_000_003))).alias("score"))
    value = sketches.merged_quantile(sketches.score_sketches(df, "score", "c"), share)
    rank = df.filter(F.col("score") <= value).count() / 50_000
    assert abs(rank - share) < 0.02


def test_flags_and_odd_values(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(None,), (math.nan,)], "score double")
    flagged = sketches.flag_by_sketch(df, sketches.score_sketches(df, "score"), "score", 0.05)
    assert 3 <= flagged.filter("is_anomaly").count() <= 7
    empty = df.filter("score is null")
    assert sketches.merged_quantile(sketches.score_sketches(empty, "score"), 0.5) is None
    assert sketches.merged_quantile(sketches.score_sketches(df.filter("false"), "score"), 0.5) is None
    assert sketches.flag_by_sketch(empty, sketches.score_sketches(empty, "score"), "score", 0.5).filter("is_anomaly").count() == 0
    none = df.select(F.lit(None).cast("string").alias("template"))
    assert sketches.merged_templates(sketches.template_sketches(none)).first()[0] == 0
