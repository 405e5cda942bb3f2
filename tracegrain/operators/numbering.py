"""Line numbers for text files, and count-based chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.operators.tables import lookup_join, materialize, rows_before

CHUNK_SIZE = 500


def with_line_no(df: DataFrame) -> DataFrame:
    """Add a dense ``line_no`` from 0, in file order and files by path, to a file-source DataFrame.

    A counting pass gives the rows of every input block; running totals over the blocks, which are
    few, then turn the position inside a block into a line number. No line is sorted, and none is
    shuffled unless the table of blocks is too large to broadcast.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return number_placed(placed, df.columns)[0]


def number_placed(placed: DataFrame, columns: list[str], start: int = 0) -> tuple[DataFrame, DataFrame]:
    """``line_no`` from ``start`` and the ``columns`` of rows with their ``_file`` and ``_block``; also the rows per block."""
    placed = placed.withColumn("_id", F.monotonically_increasing_id())
    blocks = materialize(
        placed.groupBy("_file", "_block").agg(
            F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first")
        ),
        "blocks",
    )
    offsets = rows_before(blocks.df, "_file", "_block", "_rows", "_before")
    shift = (F.col("_before") - F.col("_first") + F.lit(start)).alias("_shift")
    table = materialize(offsets.select("_file", "_block", "_rows", shift), "block-offsets")
    joined = lookup_join(placed, table, ["_file", "_block"], "inner", "_rows", salt="_id")
    return joined.select((F.col("_id") + F.col("_shift")).alias("line_no"), *columns), blocks.df


def chunk_id(line_no: Column | str = "line_no", size: int = CHUNK_SIZE) -> Column:
    line_no = F.col(line_no) if isinstance(line_no, str) else line_no
    return F.floor(line_no / F.lit(size)).cast("long")


def assign_chunks(df: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Count-based chunks over ``line_no``; the last one may be short."""
    return df.withColumn("chunk_id", chunk_id(size=size))
