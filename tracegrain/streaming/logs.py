"""Log files as a stream of numbered lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracegrain.operators.numbering import number_placed
from tracegrain.streaming.state import StateTable

_FILES = "file string, lines bigint"


def stream_log_lines(
    spark: SparkSession,
    path: str,
    state_dir: str,
    checkpoint_dir: str,
    on_lines: Callable[[DataFrame, int], None],
    max_files: int = 1_000,
    **trigger,
) -> StreamingQuery:
    """Calls ``on_lines(lines, batch_id)`` with the ``line_no, raw`` rows of the files of every micro-batch.

    Numbers go on where the batch before ended, and inside a batch they follow the paths of its files; so they are those of
    ``read_log_lines`` as long as files arrive in the order of their paths. The lines of each file are kept as state; a batch
    that is repeated after a failure gets the same numbers. ``on_lines`` must bear repetition.
    """
    files = StateTable(spark, state_dir, _FILES, ["file"])
    source = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)
    placed = source.select(
        F.col("value").alias("raw"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        known = files.before(batch.sparkSession, batch_id)
        start = known.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
        lines, blocks = number_placed(batch, ["raw"], start)
        on_lines(lines, batch_id)
        files.write(blocks.groupBy(F.col("_file").alias("file")).agg(F.sum("_rows").alias("lines")), batch_id)

    writer = placed.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint_dir)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
