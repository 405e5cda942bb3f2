import pytest
from pyspark.sql import functions as F

from tests.test_templates import random_lines
from tracegrain.operators import dedup
from tracegrain.operators import templates as tm
from tracegrain.operators.bloom import possible
from tracegrain.sources.logs import read_log_lines
from tracegrain.streaming.dedup import dedup_stream, drop_exact_duplicates, drop_exact_within
from tracegrain.streaming.logs import stream_log_lines
from tracegrain.streaming.state import StateTable
from tracegrain.streaming.templates import TemplateState, stream_templates


@pytest.fixture
def source(spark, tmp_path):
    def make(df, cuts):
        path = str(tmp_path / "in")
        for low, high in zip(cuts, cuts[1:]):
            part = df.filter((F.col("line_no") >= low) & (F.col("line_no") < high))
            part.coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return make


def folders(tmp_path):
    return [str(tmp_path / name) for name in ("state", "out", "check")]


def test_templates_of_a_stream(spark, lines, source, tmp_path):
    df = lines(random_lines(40, 90))
    stream_templates(source(df, [0, 30, 60, 90]), *folders(tmp_path)).awaitTermination()
    rows = tm.with_mask(df)
    whole = tm.assign_templates(rows, tm.mine_templates(rows))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("batch_id").distinct().count() == 3
    expected = {r["line_no"]: r["cluster_id"] for r in whole.collect()}
    assert {r["line_no"]: r["cluster_id"] for r in out.collect()} == expected
    last = {r["line_no"]: r["template"] for r in out.filter("batch_id = 2").collect()}
    final = {r["line_no"]: r["template"] for r in whole.collect()}
    assert last == {line: final[line] for line in last}


def test_dedup_of_a_stream(spark, lines, source, tmp_path):
    df = lines(random_lines(41, 120), "template")
    dedup_stream(source(df, [0, 50, 100, 120]), *folders(tmp_path), threshold=0.5).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    expected = dedup.dedup_first_wins(df, threshold=0.5)
    assert {r["line_no"] for r in out.collect()} == {r["line_no"] for r in expected.collect()}


def state(spark, tmp_path, **options):
    return StateTable(spark, str(tmp_path / "t"), "k int, v int", ["k"], **options)


def put(spark, table, batch_id, rows):
    table.write(spark.createDataFrame(rows, "k int, v int"), batch_id)


def test_a_batch_can_be_repeated(spark, tmp_path):
    table = state(spark, tmp_path)
    for batch_id, value in ((0, 1), (1, 2), (1, 2)):
        put(spark, table, batch_id, [(value, value)])
    assert [r["v"] for r in table.before(spark, 1).collect()] == [1]
    assert sorted(r["v"] for r in state(spark, tmp_path).all(spark).collect()) == [1, 2]


def test_levels_keep_work_linear(spark, tmp_path, monkeypatch):
    """Every row is rewritten once per level, and old runs and versions go."""
    table, written = state(spark, tmp_path, newest_by=["k"], buckets=2), []
    real = StateTable._write_run
    monkeypatch.setattr(StateTable, "_write_run", lambda self, rows, level: written.append(real(self, rows, level)) or written[-1])
    expected = {}
    for batch_id in range(20):
        rows = [(batch_id % 7, batch_id), (100 + batch_id, batch_id)]
        expected.update(rows)
        put(spark, table, batch_id, rows)
    assert {r["k"]: r["v"] for r in table.all(spark).collect()} == expected
    # 20 runs of level 0, 5 of level 1, 1 of level 2.
    assert [run["level"] for run in written].count(0) == 20 and len(written) == 26
    assert sum(run["rows"] for run in written) <= 3 * 40
    runs = table.runs(spark)
    assert [run["level"] for run in runs] == [2, 1]
    assert len(list((tmp_path / "t" / "versions").iterdir())) == len(list((tmp_path / "t" / "versions").glob("[0-9.]*")))
    assert {p.name for p in (tmp_path / "t" / "versions").glob("[0-9]*")} == {"18", "19"}
    named = {run["name"] for run in runs} | {run["name"] for run in table.runs(spark, 19)}
    assert {p.name for p in (tmp_path / "t" / "runs").glob("[0-9a-f]*")} == named


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    table = state(spark, tmp_path)
    for batch_id in range(3):
        put(spark, table, batch_id, [(batch_id, 0)])
    with monkeypatch.context() as patch:
        patch.setattr(StateTable, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            put(spark, table, 3, [(9, 9)])
    assert sorted(r["k"] for r in table.all(spark).collect()) == [0, 1, 2]
    put(spark, table, 3, [(3, 0)])
    assert sorted(r["k"] for r in table.all(spark).collect()) == [0, 1, 2, 3]
    # The run that was lost is deleted with the next commit.
    assert len(list((tmp_path / "t" / "runs").glob("[0-9a-f]*"))) <= 4


def test_only_touched_buckets_are_read(spark, tmp_path):
    table = state(spark, tmp_path, buckets=16)
    put(spark, table, 0, [(k, k) for k in range(200)])
    asked = spark.createDataFrame([(5,)], "k int")
    part = table.before(spark, 1, asked)
    assert table.touched(asked) == sorted({r["b"] for r in asked.selectExpr("cast(pmod(xxhash64(k), 16) as int) as b").collect()})
    found = {r["v"] for r in part.collect()}
    assert 5 in found and len(found) < 40
    assert "PartitionFilters: [isnotnull(bucket" in part._jdf.queryExecution().toString() or "bucket" in part._jdf.queryExecution().executedPlan().toString()


def test_templates_after_a_restart(spark, lines, tmp_path):
    """Each batch is a query of its own that goes on from the checkpoint; only leaves of the batch are read."""
    df = lines(random_lines(43, 120))
    path = str(tmp_path / "in")
    for low in range(0, 120, 20):
        df.filter(F.col("line_no").between(low, low + 19)).coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(df.schema).parquet(path)
        stream_templates(source, *folders(tmp_path)).awaitTermination()
    rows = tm.with_mask(df)
    whole = tm.assign_templates(rows, tm.mine_templates(rows))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r["line_no"]: r["cluster_id"] for r in out.collect()} == {r["line_no"]: r["cluster_id"] for r in whole.collect()}
    templates = TemplateState(spark, str(tmp_path / "state")).templates
    assert templates.all(spark).count() == whole.select("cluster_id").distinct().count()


def test_the_filter_leaves_hits_and_a_few_others(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), "line_no bigint, band int, key binary", ["band", "key"], bloom=True)
    assert table.seen(spark, 0) == []
    keys = spark.range(40_000).selectExpr("id as line_no", "cast(id % 5 as int) as band", "unhex(md5(cast(id as string))) as key")
    for batch_id, low in enumerate(range(0, 30_000, 10_000)):
        table.write(keys.filter(F.col("line_no").between(low, low + 9_999)), batch_id)
    seen = table.seen(spark, 3)
    passed = [r["line_no"] for r in possible(keys, seen).collect()]
    assert sum(n < 30_000 for n in passed) == 30_000
    assert sum(n >= 30_000 for n in passed) < 800


def test_lines_of_files_that_arrive(spark, tmp_path):
    source, out = tmp_path / "logs", str(tmp_path / "numbered")
    source.mkdir()
    texts = {f"{k}.log": "".join(f"file {k} line {i}\n" for i in range(3 * k)) for k in range(1, 7)}

    def store(lines, batch_id):
        lines.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    for names in (["1.log", "2.log", "3.log"], ["4.log"], ["5.log", "6.log"]):
        for name in names:
            (source / name).write_text(texts[name])
        stream_log_lines(spark, str(source), str(tmp_path / "s"), str(tmp_path / "c"), store).awaitTermination()
    expected = read_log_lines(spark, str(source)).select("line_no", "raw").collect()
    assert sorted(map(tuple, spark.read.parquet(out).select("line_no", "raw").collect())) == sorted(map(tuple, expected))


def test_exact_duplicates_within_a_delay(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = "at timestamp, template string"

    def batch(rows):
        spark.createDataFrame([(f"2024-01-01 {t}", x) for t, x in rows], "at string, template string").selectExpr(
            "to_timestamp(at) as at", "template"
        ).coalesce(1).write.mode("append").parquet(path)
        stream = drop_exact_within(spark.readStream.schema(schema).parquet(path), "at", "10 minutes")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        query.trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()
        return sorted(((str(r["at"])[11:16], r["template"]) for r in rows), key=repr)

    assert batch([("00:00:00", "a b"), ("00:01:00", "B  a"), ("00:02:00", "c"), ("00:02:00", None)]) in (
        [("00:00", "a b"), ("00:02", "c"), ("00:02", None)],
        [("00:01", "B  a"), ("00:02", "c"), ("00:02", None)],
    )
    found = batch([("00:05:00", "b a"), ("01:00:00", "d")])
    assert ("01:00", "d") in found and ("00:05", "b a") not in found
    # The set has been let go: the repeat counts anew. A row behind the watermark is not looked at.
    found = batch([("01:01:00", "a b"), ("00:10:00", "late")])
    assert ("01:01", "a b") in found and all(x != "late" for _, x in found)


def test_exact_duplicates(spark, lines, source, tmp_path):
    stream = drop_exact_duplicates(source(lines(["a", "b", "a", "b", "c"], "template"), [0, 3, 5]))
    query = stream.writeStream.format("memory").queryName("exact").option("checkpointLocation", str(tmp_path / "c"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["template"] for r in spark.table("exact").collect()) == ["a", "b", "c"]
