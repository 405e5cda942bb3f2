"""Filters, search and top-k lists over the stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.functions.text import (
    LEVEL_NAMES,
    is_highlighted,
    is_severe,
    level_name,
    severity_pct,
    snippet,
)
from tracegrain.sources.scored import with_defaults

ALL = "All"


def flagged(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_anomaly"))


def normal(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_anomaly"))


def by_level(df: DataFrame, name: str = ALL) -> DataFrame:
    """Rows of one severity; compares the code, so that the filter reaches the Parquet scan."""
    if name == ALL or "log_level" not in df.columns:
        return df
    codes = [code for code, text in LEVEL_NAMES.items() if text == name]
    return df.filter(F.col("log_level").isin(codes) if codes else F.lit(False))


def by_cluster(df: DataFrame, cluster_id: int | str = ALL) -> DataFrame:
    if cluster_id == ALL or "cluster_id" not in df.columns:
        return df
    return df.filter(F.col("cluster_id") == int(cluster_id))


def by_status(df: DataFrame, status: str = ALL) -> DataFrame:
    if status == ALL or "is_anomaly" not in df.columns:
        return df
    return flagged(df) if status == "Flagged" else normal(df)


def search(df: DataFrame, text: str, literal: bool = False) -> DataFrame:
    """Rows whose line or template matches a case-insensitive pattern (or contains plain text)."""
    if not text:
        return df
    hit = F.lit(False)
    for name in ("raw", "template"):
        if name in df.columns:
            column = F.col(name)
            if literal:
                found = F.lower(column).contains(F.lower(F.lit(text)))
            else:
                found = column.rlike("(?iu)" + text)
            hit = hit | F.coalesce(found, F.lit(False))
    return df.filter(hit)


def explore(
    df: DataFrame,
    level: str = ALL,
    cluster_id: int | str = ALL,
    status: str = ALL,
    text: str = "",
    literal: bool = False,
) -> DataFrame:
    """All filters together; each is skipped when its column is absent."""
    view = by_status(by_cluster(by_level(df, level), cluster_id), status)
    return search(view, text, literal)


def filtered_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def cluster_ids(df: DataFrame) -> DataFrame:
    """Distinct cluster ids as text, in text order (1, 10, 2)."""
    ids = with_defaults(df).select(F.col("cluster_id").cast("string").alias("cluster_id"))
    return ids.distinct().orderBy("cluster_id")


def most_anomalous(df: DataFrame, n: int = 5, score: str = "anomaly_score", tie: str = "line_no") -> DataFrame:
    """Flagged rows, lowest score first."""
    return flagged(with_defaults(df)).orderBy(F.col(score).asc(), F.col(tie).asc()).limit(n)


def flagged_preview(df: DataFrame, n: int = 8, score: str = "anomaly_score", tie: str = "line_no") -> DataFrame:
    """Flagged rows, highest score first."""
    return flagged(with_defaults(df)).orderBy(F.col(score).desc(), F.col(tie).asc()).limit(n)


def first_rows(df: DataFrame, n: int = 15) -> DataFrame:
    return df.orderBy("line_no").limit(n)


def detail_row(df: DataFrame) -> DataFrame:
    return first_rows(df, 1)


def explore_rows(df: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Display columns of the explore list; absent columns show their defaults."""
    return with_defaults(df).select(
        "line_no",
        snippet("raw", 55).alias("message"),
        level_name("log_level", "INFO").alias("level"),
        "cluster_id",
        F.col(score),
        is_severe("log_level").alias("is_severe"),
        is_highlighted(score).alias("is_highlighted"),
    )


def anomaly_rows(df: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Display columns of the anomaly list; absent columns show their defaults."""
    return with_defaults(df).select(
        "line_no",
        snippet("raw", 65).alias("message"),
        snippet("template", 30).alias("template"),
        F.abs(F.col(score)).alias("severity"),
        severity_pct(score).alias("severity_pct"),
        level_name("log_level", "INFO").alias("level"),
        is_severe("log_level").alias("is_severe"),
    )
