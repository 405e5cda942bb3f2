"""Near-duplicate removal over a stream of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracegrain.operators.dedup import dedup_incremental, word_set
from tracegrain.streaming.state import StateTable

_KEPT = "line_no bigint, band int, key binary"


def kept_buckets(spark, state_dir: str) -> StateTable:
    """The buckets of all rows kept so far, with a filter per run."""
    return StateTable(spark, state_dir, _KEPT, ["band", "key"], bloom=True)


def dedup_stream(
    lines: DataFrame,
    state_dir: str,
    output_dir: str,
    checkpoint_dir: str,
    text: str = "template",
    threshold: float = 0.8,
    num_perm: int = 64,
    **trigger,
) -> StreamingQuery:
    """Write the survivors of every micro-batch; rows kept in earlier batches count as seen.

    Only buckets that pass the filter of the kept ones are looked up in the history.
    """
    kept = kept_buckets(lines.sparkSession, state_dir)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = kept.seen(spark, batch_id)
        earlier = kept.before(spark, batch_id) if seen else None
        survivors, bands = dedup_incremental(batch, earlier, text, threshold, num_perm, seen)
        survivors.write.mode("overwrite").parquet(f"{output_dir}/batch_id={batch_id}")
        kept.write(bands, batch_id)

    writer = lines.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint_dir)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def drop_exact_duplicates(lines: DataFrame, text: str = "template") -> DataFrame:
    """Streaming state for exact duplicates only: one row of every text, any one of those that came in the same batch.

    The state keeps every text seen and so grows with the stream; ``dedup_stream`` keeps the first row.
    """
    return lines.dropDuplicates([text])


def drop_exact_within(lines: DataFrame, time: Column | str, delay: str, text: str = "template") -> DataFrame:
    """Exact duplicates dropped over a stream with bounded state: a word set is remembered for ``delay`` of event time.

    ``time`` is the event time of a row. Rows whose word set, whatever its order and case, occurred within ``delay``
    before them are dropped; one that repeats later is kept again, once the watermark has let the set go. Rows
    behind the watermark are dropped unseen. A null text has no words. Of equal rows of one micro-batch any one stays.
    """
    columns = [F.col(f"`{c}`") for c in lines.columns]
    stamped = lines.select(*columns, (F.col(time) if isinstance(time, str) else time).alias("_time"), word_set(text).alias("_set"))
    return stamped.withWatermark("_time", delay).dropDuplicatesWithinWatermark(["_set"]).select(*columns)
