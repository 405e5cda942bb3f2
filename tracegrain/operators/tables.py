"""Intermediate tables on shared storage, and joins against them that survive skew."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

# A side is broadcast only when its measured size stays below both.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20

# A key is hot when it holds more than 1/HOT_SHARE of the rows: there are at most HOT_SHARE of them.
HOT_SHARE = 2_000


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session may go without a checkpoint folder; it gets a temporary one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    # "local" or "local[…]", but not "local-cluster[…]", whose executors have folders of their own.
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_dir()


@functools.cache
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="tracegrain-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/{app}/{label}-{uuid.uuid4().hex}"


class Table:
    """A DataFrame on shared storage, with its size in rows and bytes."""

    path: str | None = None

    def __init__(self, df: DataFrame, size: tuple[int, int] | None = None, observed: dict | None = None):
        self.df = df
        self.observed = observed or {}
        if size:
            self._size = size

    @functools.cached_property
    def _size(self) -> tuple[int, int]:
        row = self.df.agg(*_size_columns(self.df)).first()
        return row["rows"], row["bytes"] or 0

    @property
    def rows(self) -> int:
        return self._size[0]

    @property
    def fits_broadcast(self) -> bool:
        rows, size = self._size
        return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES

    def narrowed(self, *columns: Column | str) -> Table:
        """The same rows with fewer columns; the known size stays an upper bound."""
        return Table(self.df.select(*columns), self._size)

    def drop(self) -> None:
        """Deletes the files of a table that ``stored`` wrote, once nothing still to run reads them."""
        if self.path is not None:
            context = self.df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(self.path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
            self.path = None


def _size_columns(df: DataFrame) -> list[Column]:
    """Row count and bytes: 16 per value, plus the length of texts and 32 per array entry."""
    parts = [f"{16 * len(df.columns)}L"]
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            parts.append(f"coalesce(octet_length(`{field.name}`), 0)")
        elif kind == "array":
            parts.append(f"32 * coalesce(size(`{field.name}`), 0)")
    return [F.expr("count(1) as rows"), F.expr(f"sum({' + '.join(parts)}) as bytes")]


def materialize(df: DataFrame, label: str, **totals: Column) -> Table:
    """Checkpoint ``df`` on shared storage: cuts lineage and survives the loss of executors.

    The checkpoint keeps the partitioning of the plan, so later steps on the same key need no second
    shuffle. The size is counted on the way, and so are further ``totals``, which the table has as ``observed``.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    context.setJobDescription(label)  # shown in the Spark UI
    size = Observation()
    more = [value.alias(name) for name, value in totals.items()]
    saved = df.observe(size, *_size_columns(df), *more).checkpoint()
    context.setJobDescription(None)
    counted = size.get
    return Table(saved, (counted["rows"], counted["bytes"] or 0), {name: counted[name] for name in totals})


# Lets Spark drop the shuffle files of a write once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str, like: dict[str, str] | None = None, **totals: Column) -> Table:
    """``materialize`` for large tables with texts: compressed columns, and no shuffle files stay behind.

    ``like`` names columns that often equal another; such values are not stored twice. Nothing deletes the table but its
    ``drop``, so its maker calls that as soon as no later step reads it.
    """
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(_CLEANUP, "false")
    size, like = Observation(), like or {}
    more = [value.alias(name) for name, value in totals.items()]
    rows = df.observe(size, *_size_columns(df), *more)
    same = {f"_same_{c}": F.col(c).eqNullSafe(F.col(other)) for c, other in like.items()}
    rows = rows.withColumns(same).withColumns({c: F.when(~F.col(f"_same_{c}"), F.col(c)) for c in like})
    spark.sparkContext.setJobDescription(label)
    spark.conf.set(_CLEANUP, "true")
    try:
        rows.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
        spark.sparkContext.setJobDescription(None)
    saved = spark.read.schema(rows.schema).parquet(path)
    saved = saved.withColumns({c: F.when(F.col(f"_same_{c}"), F.col(other)).otherwise(F.col(c)) for c, other in like.items()})
    counted = size.get
    table = Table(saved.select(df.columns), (counted["rows"], counted["bytes"] or 0), {name: counted[name] for name in totals})
    table.path = path
    return table


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for the work on a table that lies in fewer files than there are cores.

    A large table has more splits than that and stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def lookup_join(
    rows: DataFrame,
    lookup: Table,
    on: list[str],
    how: str = "left",
    weight: str | None = None,
    salt: Column | str = "line_no",
) -> DataFrame:
    """Join many rows to a table with one row per key.

    The lookup is broadcast when its measured size allows. Otherwise both sides are shuffled, and
    with ``weight`` (rows of the other side per key) the hot keys are cut into pieces by ``salt``,
    a column that differs between rows of one key. Their lookup rows are repeated once per piece.
    """
    if lookup.fits_broadcast:
        return rows.join(F.broadcast(lookup.df), on, how)
    if weight is None:
        return rows.join(lookup.df, on, how)
    total = lookup.df.agg(F.sum(weight)).first()[0] or 0
    return salted_join(rows, lookup.df, on, how, weight, salt, max(total // HOT_SHARE, 1))


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str,
    weight: str,
    salt: Column | str,
    limit: int,
) -> DataFrame:
    """Shuffle join in which no piece of a key holds many more than ``limit`` rows."""
    pieces = F.ceil(F.col(weight) / F.lit(limit)).cast("int")
    # Bounded: the weights of these keys are above ``limit`` each and add up to the total.
    hot = lookup.filter(F.col(weight) > limit).select(*on, pieces.alias("_pieces"))
    salted = rows.join(F.broadcast(hot), on, "left").withColumn(
        "_piece", F.pmod(F.xxhash64(salt), F.coalesce("_pieces", F.lit(1))).cast("int")
    )
    last = F.when(F.col(weight) > limit, pieces - 1).otherwise(F.lit(0))
    spread = lookup.withColumn("_piece", F.explode(F.sequence(F.lit(0), last)))
    return salted.join(spread, [*on, "_piece"], how).drop("_piece", "_pieces")


def rows_before(df: DataFrame, group: str, order: str, rows: str, name: str) -> DataFrame:
    """Running total of ``rows`` in the order of ``group``, then ``order``, the row itself excluded.

    Totals run inside each group in parallel; only one row per group is ordered as a whole.
    """
    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(group).orderBy(order).rowsBetween(*earlier)
    across = Window.orderBy(group).rowsBetween(*earlier)
    groups = df.groupBy(group).agg(F.sum(rows).alias("_n")).select(
        group, F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_groups")
    )
    total = F.coalesce(F.sum(rows).over(inside), F.lit(0))
    return df.withColumn("_inside", total).join(groups, group).withColumn(
        name, F.col("_groups") + F.col("_inside")
    ).drop("_groups", "_inside")


def dense_ids(df: DataFrame, order: str, name: str, start: int = 0, bits: int = 20) -> DataFrame:
    """Number rows 1, 2, 3 … after ``start`` by a unique whole-number column, without a global sort.

    Rows are numbered within ranges of ``2**bits`` values, which bounds the rows of a range, and
    offset by running totals over the ranges.
    """
    ranged = df.withColumn("_range", F.shiftright(F.col(order), bits))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    counts = counts.withColumn("_block", F.shiftright("_range", 16))
    offsets = rows_before(counts, "_block", "_range", "_rows", "_before").select("_range", "_before")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    numbered = ranged.withColumn("_within", within).join(offsets, "_range")
    number = F.col("_before") + F.col("_within") + F.lit(start)
    return numbered.withColumn(name, number.cast("int")).drop("_range", "_within", "_before")
