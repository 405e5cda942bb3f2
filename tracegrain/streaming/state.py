"""State of a stream as log-structured tables with an atomic commit.

Every batch adds one run, a Parquet folder dealt into buckets by the hash of the key. When a level has ``FAN`` runs
they are merged into one run of the next level, so a row is rewritten once per level and a state of n batches costs
work in proportion to n, but for a factor that grows with its logarithm. Which runs make up the state is said by one small file per
batch, put in place by a rename. Until then nothing of the batch counts: a run left over by a crash is never
named. A batch that is run again starts from the file of the batch before it and puts its own in place of the first.
"""

from __future__ import annotations

import json
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.operators.bloom import SCHEMA as FILTER
from tracegrain.operators.bloom import Bloom

FAN = 4
BUCKETS = 32


class StateTable:
    """Rows of ``schema``, in buckets by ``keys``, one version per batch.

    With ``newest_by`` only the row of the latest batch counts for equal values of these columns, and merges drop
    the others; else all rows stay. With ``bloom`` every run has a filter of its keys.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str,
        keys: list[str],
        newest_by: list[str] | None = None,
        bloom: bool = False,
        buckets: int = BUCKETS,
    ):
        self.path, self.schema, self.keys = path.rstrip("/"), schema, keys
        self.newest_by, self.bloom, self.buckets = newest_by, bloom, buckets
        self.columns = [field.split()[0] for field in schema.split(", ")]

    # -- files

    def _fs(self, spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
        context = spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(context._jsc.hadoopConfiguration()), at

    def _versions(self, spark: SparkSession) -> list[int]:
        fs, at = self._fs(spark, f"{self.path}/versions")
        if not fs.exists(at):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(at)]
        return sorted(int(name) for name in names if name.isdigit())

    def runs(self, spark: SparkSession, batch_id: int | None = None) -> list[dict]:
        """The runs of the state before a batch, or of the newest version, oldest first."""
        known = [v for v in self._versions(spark) if batch_id is None or v < batch_id]
        if not known:
            return []
        fs, at = self._fs(spark, f"{self.path}/versions/{known[-1]}")
        stream = fs.open(at)
        try:
            return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, spark: SparkSession, batch_id: int, runs: list[dict]) -> None:
        """Makes the runs the state after the batch, at once."""
        fs, new = self._fs(spark, f"{self.path}/versions/_{uuid.uuid4().hex}")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(runs).encode()))
        stream.close()
        jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = hadoop.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(new, hadoop.Path(f"{self.path}/versions/{batch_id}"), options)

    def clean(self, spark: SparkSession, batch_id: int) -> None:
        """Deletes versions that no restart can ask for any more, and runs that only they name."""
        fs, root = self._fs(spark, f"{self.path}/runs")
        versions = self._versions(spark)
        # A restart runs the last batch again, from the version before it.
        old = [v for v in versions if v < batch_id][:-1]
        named = {run["name"] for v in versions if v not in old for run in self.runs(spark, v + 1)}
        for v in old:
            fs.delete(self._fs(spark, f"{self.path}/versions/{v}")[1], False)
        if fs.exists(root):
            for status in fs.listStatus(root):
                if status.getPath().getName() not in named:
                    fs.delete(status.getPath(), True)

    # -- rows

    def _read(self, spark: SparkSession, runs: list[dict], buckets: list[int] | None = None) -> DataFrame:
        """All rows of the runs with their batch."""
        typed = spark.createDataFrame([], f"{self.schema}, batch_id bigint, bucket int")
        out = typed
        if runs:
            paths = [f"{self.path}/runs/{run['name']}/rows" for run in runs]
            # Runs lie under different roots, so that the bucket is found per run.
            out = None
            for path in paths:
                part = spark.read.schema(typed.schema).parquet(path)
                out = part if out is None else out.unionByName(part)
        if buckets is not None:
            out = out.filter(F.col("bucket").isin(buckets))
        return out.drop("bucket")

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _latest(self, rows: DataFrame) -> DataFrame:
        if not self.newest_by:
            return rows
        values = [c for c in rows.columns if c not in self.newest_by]
        newest = F.max_by(F.struct(*values), "batch_id").alias("_row")
        return rows.groupBy(*self.newest_by).agg(newest).select(*self.newest_by, "_row.*")

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets that hold the keys; there are no more than ``buckets``."""
        return sorted(row["b"] for row in keys.select(self._bucket().alias("b")).distinct().collect())

    def before(self, spark: SparkSession, batch_id: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The state that a batch starts from; with ``keys``, at least the rows of these keys, and only buckets they are in."""
        rows = self._read(spark, self.runs(spark, batch_id), None if keys is None else self.touched(keys))
        return self._latest(rows).select(self.columns)

    def all(self, spark: SparkSession) -> DataFrame:
        return self.before(spark)

    def seen(self, spark: SparkSession, batch_id: int) -> list[Bloom]:
        """Filters of all keys of the state that a batch starts from, one per run; none for an empty state."""
        return [
            Bloom(spark.read.schema(FILTER).parquet(f"{self.path}/runs/{run['name']}/filter"), run["words"], tuple(self.keys))
            for run in self.runs(spark, batch_id)
            if run["rows"]
        ]

    def _write_run(self, rows: DataFrame, level: int) -> dict:
        spark, name = rows.sparkSession, uuid.uuid4().hex
        at = f"{self.path}/runs/{name}"
        dealt = rows.withColumn("bucket", self._bucket()).repartition(F.col("bucket"))
        dealt.sortWithinPartitions("bucket", *self.keys).write.partitionBy("bucket").parquet(f"{at}/rows")
        stored = spark.read.schema(f"{self.schema}, batch_id bigint").parquet(f"{at}/rows")
        run = {"name": name, "level": level, "rows": stored.count()}  # from the footers of the files
        if self.bloom and run["rows"]:
            made = Bloom.build(stored, self.keys, run["rows"])
            made.df.write.parquet(f"{at}/filter")
            run["words"] = made.words
        return run

    def write(self, df: DataFrame, batch_id: int, last: int = 0) -> None:
        """Adds the rows of a batch to the state before it, merges full levels and commits.

        ``last`` is a number kept beside the run; of merged runs the largest stays.
        """
        spark = df.sparkSession
        runs = self.runs(spark, batch_id)
        rows = df.select(self.columns).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        runs.append(self._write_run(rows, 0) | {"last": last})
        level = 0
        while len(full := [run for run in runs if run["level"] == level]) >= FAN:
            merged = self._write_run(self._latest(self._read(spark, full)), level + 1)
            merged["last"] = max(run["last"] for run in full)
            runs = [run for run in runs if run["level"] != level] + [merged]
            level += 1
        self.commit(spark, batch_id, runs)
        self.clean(spark, batch_id)
