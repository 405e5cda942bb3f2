"""Numeric features of parsed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.functions.text import extract_hour, level_of_upper, word_count
from tracegrain.operators.tables import lookup_join, materialize


def with_cluster_freq(df: DataFrame, salt: str = "line_no") -> DataFrame:
    """Add how many rows of ``df`` share the row's cluster; a missing cluster counts as -1."""
    if "cluster_id" in df.columns:
        df = df.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))
    else:
        df = df.withColumn("cluster_id", F.lit(-1))
    counts = materialize(
        df.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_freq")), "cluster-freq"
    )
    return lookup_join(df, counts, ["cluster_id"], "left", "cluster_freq", salt)


def feature_columns(df: DataFrame) -> DataFrame:
    """The four features as columns and as one array; needs ``cluster_freq``."""
    text = F.coalesce("template", "raw") if "template" in df.columns else F.col("raw")
    # The upper-case line is a column of its own, as every severity word looks at it.
    out = df.withColumn("_upper", F.upper("raw")).withColumns(
        {
            "log_level": level_of_upper("_upper"),
            "hour": extract_hour("raw"),
            "template_length": word_count(text),
        }
    ).drop("_upper")
    parts = ("log_level", "cluster_freq", "hour", "template_length")
    return out.withColumn("features", F.array(*[F.col(c).cast("long") for c in parts]))


def build_features(df: DataFrame, salt: str = "line_no") -> DataFrame:
    return feature_columns(with_cluster_freq(df, salt))
