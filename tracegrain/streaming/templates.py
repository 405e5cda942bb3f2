"""Template mining over a stream of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracegrain.operators.tables import Table, materialize
from tracegrain.operators.templates import (
    Mining,
    Model,
    assign_templates,
    collapsed_table,
    extend_collapsed,
    leaf_key,
    touched_leaves,
    with_mask,
)
from tracegrain.streaming.state import StateTable

_TEMPLATES = "leader_line bigint, cluster_id int, leaf string, template string, n bigint, first_line bigint"
_ASSIGNMENTS = "masked string, first_line bigint, n bigint, leader_line bigint, emitted string, leaf string, route string"
_CHILDREN = "node string, word string, first_line bigint, n bigint"


class TemplateState:
    """The model of a stream by leaves, so that a batch reads the leaves it touches.

    Clusters lie in the bucket of their leaf, masked lines in that of their leading words.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.templates = StateTable(spark, f"{path}/templates", _TEMPLATES, ["leaf"], newest_by=["leader_line"])
        self.assignments = StateTable(spark, f"{path}/assignments", _ASSIGNMENTS, ["route"])
        self.children = StateTable(spark, f"{path}/children", _CHILDREN, ["node"], newest_by=["node", "word"])

    def load(self, spark: SparkSession, batch_id: int, collapsed: DataFrame, options: Mining = Mining()) -> Model:
        """The part of the model before a batch that its lines can touch."""
        routes = collapsed.select(leaf_key("masked", options.prefix_tokens).alias("route"))
        assignments = materialize(self.assignments.before(spark, batch_id, routes), "state")
        children = materialize(self.children.before(spark, batch_id), "state")
        leaves = touched_leaves(collapsed, assignments.df, children.df, options)
        templates = materialize(self.templates.before(spark, batch_id, leaves), "state")
        return Model(templates, assignments, children)

    def last_id(self, spark: SparkSession, batch_id: int) -> int:
        """The highest cluster id before a batch."""
        return max((run.get("last", 0) for run in self.templates.runs(spark, batch_id)), default=0)

    def save(self, old: Model, new: Model, fresh: Table, batch_id: int, options: Mining = Mining()) -> None:
        spark = new.templates.df.sparkSession
        changed = new.templates.df.join(old.templates.df, ["leader_line", "template", "n"], "left_anti")
        words = new.children.df.join(old.children.df, ["node", "word", "first_line"], "left_anti")
        leaves = new.templates.df.select("leader_line", "leaf")
        rows = fresh.df.join(leaves, "leader_line").withColumn("route", leaf_key("masked", options.prefix_tokens))
        last = new.templates.df.agg(F.max("cluster_id")).first()[0] or 0
        self.children.write(words, batch_id)
        self.assignments.write(rows, batch_id)
        self.templates.write(changed, batch_id, last=max(last, self.last_id(spark, batch_id)))


def stream_templates(lines: DataFrame, state_dir: str, output_dir: str, checkpoint_dir: str, **trigger) -> StreamingQuery:
    """Assign templates to a stream of ``line_no, raw`` rows, learning on the way.

    Every micro-batch runs the batch operators (collapse, match, merge the new lines), so a leaf that
    receives most of the stream is pre-aggregated and split just as in a batch job.
    """
    state = TemplateState(lines.sparkSession, state_dir)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        masked = with_mask(batch)
        stored = collapsed_table(masked)
        collapsed = stored.df
        model = state.load(batch.sparkSession, batch_id, collapsed)
        extended, fresh = extend_collapsed(collapsed, model, last=state.last_id(batch.sparkSession, batch_id))
        out = assign_templates(masked, extended)
        out.write.mode("overwrite").parquet(f"{output_dir}/batch_id={batch_id}")
        state.save(model, extended, fresh, batch_id)
        stored.drop()

    writer = lines.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint_dir)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
