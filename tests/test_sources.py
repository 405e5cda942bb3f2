import pytest
from pyspark.sql import functions as F

from tracegrain.operators import tables
from tracegrain.operators.numbering import assign_chunks
from tracegrain.sources import logs, scored


def read(df):
    return [r["raw"] for r in df.orderBy("line_no").collect()], [
        r["line_no"] for r in df.orderBy("line_no").collect()
    ]


def test_lines_are_numbered_across_files_and_splits(spark, tmp_path):
    expected = []
    for name, count in (("a.log", 400), ("b.log", 1), ("c.log", 900)):
        texts = [f"{name} line {i} {'x' * (i % 50)}" for i in range(count)]
        (tmp_path / name).write_text("\n".join(texts) + "\n")
        expected += texts
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        df = logs.read_log_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 3
        texts, numbers = read(df)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert texts == expected
    assert numbers == list(range(len(expected)))


def test_numbering_without_broadcast(spark, tmp_path, monkeypatch):
    for name in "abcd":
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(50)))
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    texts, numbers = read(logs.read_log_lines(spark, str(tmp_path)))
    assert texts == [f"{name}{i}" for name in "abcd" for i in range(50)]
    assert numbers == list(range(200))


def test_blank_lines_and_line_ends(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"a\r\n\nb\rc\n")
    assert read(logs.read_log_lines(spark, str(tmp_path / "x.log")))[0] == ["a", "", "b", "c"]


def test_empty_file(spark, tmp_path):
    (tmp_path / "x.log").write_text("")
    assert logs.read_log_lines(spark, str(tmp_path / "x.log")).count() == 0


def test_uploaded_text_is_stripped_like_one_string(spark, tmp_path):
    content = b"\n \n  first \n\nmid\xff\r\nlast\t\n\n"
    (tmp_path / "x.log").write_bytes(content)
    expected = content.decode("utf-8", errors="replace").strip().split("\n")
    texts, numbers = read(logs.read_uploaded_text(spark, str(tmp_path / "x.log")))
    assert texts == expected
    assert numbers == list(range(len(expected)))


def test_blank_upload_is_one_empty_line(spark, tmp_path):
    (tmp_path / "x.log").write_text(" \n\n")
    assert read(logs.read_uploaded_text(spark, str(tmp_path / "x.log"))) == ([""], [0])


def test_bad_utf8_raises_or_is_marked(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"good\nb\xffd\n")
    df = logs.read_log_lines(spark, str(tmp_path / "x.log"))
    assert [r["is_valid"] for r in logs.mark_valid_utf8(df).orderBy("line_no").collect()] == [True, False]
    with pytest.raises(Exception, match="UTF8|UTF-8"):
        logs.require_valid_utf8(df).collect()


def test_chunks(spark):
    df = spark.range(1203).withColumnRenamed("id", "line_no")
    sizes = assign_chunks(df).groupBy("chunk_id").count().orderBy("chunk_id").collect()
    assert [r["count"] for r in sizes] == [500, 500, 203]
    assert assign_chunks(df, 100).select("chunk_id").distinct().count() == 13


def test_store_round_trip_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "new" / "dir")
    rows = [("r1", "t1", 1, -0.25, True, [4, 1, 8, 5]), ("r2", "t2", 2, 0.125, False, [0, 1, -1, 5])]
    df = spark.createDataFrame(
        rows, "raw string, template string, cluster_id int, anomaly_score double, is_anomaly boolean, features array<int>"
    )
    scored.write_scored(df, path)
    scored.write_scored(df, path)
    back = scored.read_scored(spark, path)
    assert [(f.name, f.dataType.simpleString()) for f in back.schema.fields] == [
        (name, kind) for name, kind, _ in scored.SCORED_COLUMNS
    ]
    assert [tuple(r) for r in back.orderBy("raw").collect()] == [
        ("r1", "t1", 1, -0.25, True, 4),
        ("r2", "t2", 2, 0.125, False, 0),
    ]
    size = scored.stored_bytes(spark, path).first()["stored_bytes"]
    assert size == sum(f.stat().st_size for f in (tmp_path / "new" / "dir").glob("*.parquet"))


def test_defaults_and_empty_table(spark, tmp_path):
    sparse = spark.createDataFrame([("only raw",)], "raw string")
    assert tuple(scored.conform_scored(sparse).first()) == ("only raw", "", -1, 0.0, False, 1)
    scored.write_scored(sparse.limit(0), str(tmp_path / "e"))
    assert scored.read_scored(spark, str(tmp_path / "e")).count() == 0


def test_lookup_join_with_hot_keys(spark, monkeypatch):
    """A key with most of the rows is cut into pieces; the result is that of a plain join."""
    rows = spark.range(3000).select(
        F.col("id").alias("line_no"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("k")
    )
    counts = tables.materialize(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "t")
    plain = sorted(tuple(r) for r in rows.join(counts.df, "k").select("line_no", "k", "n").collect())
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(tables, "HOT_SHARE", 20)
    for how in ("inner", "left"):
        out = tables.lookup_join(rows, counts, ["k"], how, "n")
        assert sorted(tuple(r) for r in out.select("line_no", "k", "n").collect()) == plain
    some = tables.Table(counts.df.filter("k != 3"))
    for how in ("left_semi", "left_anti"):
        out = tables.lookup_join(rows, some, ["k"], how, "n").select("line_no")
        kept = [x for x in plain if (x[1] != 3) == (how == "left_semi")]
        assert sorted(r[0] for r in out.collect()) == sorted(x[0] for x in kept)


def test_dense_ids_across_ranges(spark):
    values = [0, 5, 7, 1000, 1001, 5000, 9_000_000_000]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(3)
    out = tables.dense_ids(df, "v", "id", start=10, bits=3).orderBy("v").collect()
    assert [r["id"] for r in out] == list(range(11, 18))


def test_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session())
