"""Mergeable sketches: approximate numbers of templates and approximate score thresholds, kept per chunk.

A sketch table has one small binary value per group, is written once per chunk of lines and merged over any choice of
chunks without reading lines again. The exact forms are ``unique_templates`` and ``weighted_percentile``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# log2 of the buckets of a distinct-count sketch: a standard error of 0.8 %.
DISTINCT_BITS = 14
# Size parameter of a quantile sketch: ranks are off by 0.8 % at most, with 99 % probability.
QUANTILE_K = 350


def template_sketches(df: DataFrame, by: str | None = None, column: str = "template") -> DataFrame:
    """A distinct-count sketch of ``column`` per value of ``by``: columns ``by`` (if any), sketch. Nulls do not count."""
    sketch = F.hll_sketch_agg(F.col(column).cast("string"), DISTINCT_BITS).alias("sketch")
    return df.groupBy(by).agg(sketch) if by else df.agg(sketch)


def merged_templates(sketches: DataFrame, by: str | Column | None = None) -> DataFrame:
    """Estimated number of different templates over sketches, per value of ``by`` or over all: ``unique_templates``."""
    count = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("unique_templates")
    return sketches.groupBy(by).agg(count) if by is not None else sketches.agg(count)


def score_sketches(df: DataFrame, score: str, by: str | None = None) -> DataFrame:
    """A quantile sketch of ``score`` per value of ``by``: columns ``by`` (if any), sketch. Nulls and NaN do not count."""
    value = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    sketch = F.kll_sketch_agg_double(value, QUANTILE_K).alias("sketch")
    return df.groupBy(by).agg(sketch) if by else df.agg(sketch)


def merged_quantile(sketches: DataFrame, share: float) -> float | None:
    """The value below which about ``share`` of all sketched scores lie; None if there are none."""
    merged = sketches.agg(F.kll_merge_agg_double("sketch", QUANTILE_K).alias("sketch"))
    known = merged.filter(F.kll_sketch_get_n_double("sketch") > 0)
    row = known.select(F.kll_sketch_get_quantile_double("sketch", F.lit(share)).alias("value")).first()
    return row["value"] if row else None


def flag_by_sketch(df: DataFrame, sketches: DataFrame, score: str, contamination: float) -> DataFrame:
    """Adds ``is_anomaly``: scores strictly below the sketched threshold. Without scores nothing is flagged."""
    threshold = merged_quantile(sketches, contamination)
    below = F.col(score) < F.lit(threshold) if threshold is not None else F.lit(False)
    return df.withColumn("is_anomaly", F.coalesce(below, F.lit(False)))
