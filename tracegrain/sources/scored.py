"""The stored table: its schema, writer, reader and size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.operators.numbering import with_line_no

# Column, type and default of the stored table.
SCORED_COLUMNS = (
    ("raw", "string", ""),
    ("template", "string", ""),
    ("cluster_id", "int", -1),
    ("anomaly_score", "float", 0.0),
    ("is_anomaly", "boolean", False),
    ("log_level", "tinyint", 1),
)


def conform_scored(df: DataFrame, level_from_column: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """Project to the stored columns; absent columns and nulls take their defaults.

    The level is the first of the features. Without features it takes its default, or with
    ``level_from_column`` the value of the column ``log_level``. ``more`` columns come after them.
    """
    out = []
    for name, kind, default in SCORED_COLUMNS:
        value = F.lit(default)
        if name == "log_level" and "features" in df.columns:
            value = F.coalesce(F.get("features", F.lit(0)), value)
        elif name in df.columns and (name != "log_level" or level_from_column):
            value = F.coalesce(F.col(name), value)
        out.append(value.cast(kind).alias(name))
    return df.select(*out, *more)


def write_scored(df: DataFrame, path: str, level_from_column: bool = False, keep_line_no: bool = False) -> str:
    """Stores the table; with ``keep_line_no`` in line order and with the line number as a further column."""
    rows = conform_scored(df, level_from_column, ("line_no",) if keep_line_no else ())
    if keep_line_no:
        rows = rows.repartitionByRange("line_no").sortWithinPartitions("line_no")
    rows.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return path


def read_scored(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """The stored table; ``numbered`` adds the place in the files as line number if none was stored."""
    rows = spark.read.parquet(path)
    return with_line_no(rows) if numbered and "line_no" not in rows.columns else rows


def with_defaults(df: DataFrame) -> DataFrame:
    """``df`` with a default for every stored column that it lacks, for tables of another origin."""
    return df.withColumns({n: F.lit(d).cast(k) for n, k, d in SCORED_COLUMNS if n not in df.columns})


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Total size of the data files; the listing is enough, no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("stored_bytes"))
