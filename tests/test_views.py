import pytest
from pyspark.sql import functions as F

from tracegrain.operators import explore, report


@pytest.fixture
def rows(spark):
    data = [
        (0, "INFO start", "INFO <*>", 1, 0.2, False, 1),
        (1, "ERROR Timeout", "ERROR <*>", 2, -0.3, True, 3),
        (2, "ERROR other", "ERROR <*>", 2, -0.1, True, 3),
        (3, "CRITICAL down", "CRITICAL <*>", 10, -0.6, True, 4),
        (4, None, "INFO <*>", 1, 0.1, False, 1),
    ]
    return spark.createDataFrame(
        data,
        "line_no bigint, raw string, template string, cluster_id int, anomaly_score double, is_anomaly boolean, log_level int",
    )


def ids(df):
    return [r["line_no"] for r in df.collect()]


def test_filters(rows):
    assert ids(explore.flagged(rows)) == [1, 2, 3]
    assert ids(explore.normal(rows)) == [0, 4]
    assert ids(explore.by_level(rows, "ERROR")) == [1, 2]
    assert ids(explore.by_level(rows, "nothing")) == []
    assert ids(explore.by_cluster(rows, "10")) == [3]
    assert ids(explore.search(rows, "time.ut")) == [1]
    assert ids(explore.search(rows, "time.ut", literal=True)) == []
    assert ids(explore.search(rows, "info")) == [0, 4]
    assert ids(explore.explore(rows, "ERROR", 2, "Flagged", "other")) == [2]
    assert ids(explore.explore(rows)) == [0, 1, 2, 3, 4]


def test_absent_columns_skip_their_filter(rows):
    bare = rows.select("line_no", "raw")
    assert ids(explore.explore(bare, "ERROR", 2, "Flagged", "down")) == [3]


def test_bad_pattern_raises(rows):
    with pytest.raises(Exception):
        explore.search(rows, "(").collect()


def test_level_filter_reaches_the_scan(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = explore.by_level(stored, "ERROR").select("raw")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(log_level), EqualTo(log_level,3)]" in plan


def test_lists(rows):
    assert ids(explore.most_anomalous(rows, 2)) == [3, 1]
    assert ids(explore.flagged_preview(rows, 2)) == [2, 1]
    assert ids(explore.first_rows(rows, 3)) == [0, 1, 2]
    assert ids(explore.detail_row(explore.flagged(rows))) == [1]
    assert [r["cluster_id"] for r in explore.cluster_ids(rows).collect()] == ["1", "10", "2"]


def test_level_distribution_is_zero_filled(rows):
    out = report.level_distribution(rows).collect()
    assert [(r["level"], r["n"]) for r in out] == [("DEBUG", 0), ("INFO", 2), ("WARNING", 0), ("ERROR", 2), ("CRITICAL", 1)]
    assert [r["bar_pct"] for r in out] == [2.0, 100.0, 2.0, 100.0, 50.0]
    assert [r["n"] for r in report.level_distribution(rows.limit(0)).collect()] == [0] * 5


def test_top_templates(rows):
    out = report.top_templates(rows, 2).collect()
    assert [(r["template"], r["n"], r["share_of_top"], r["share_of_all"]) for r in out] == [
        ("ERROR <*>", 2, 50.0, 40.0),
        ("INFO <*>", 2, 50.0, 40.0),
    ]


def test_summary(rows):
    assert tuple(report.anomaly_summary(rows).first()) == (5, 3, 60.0)
    assert tuple(report.anomaly_summary(rows.limit(0)).first()) == (0, 0, 0.0)


def test_histogram(rows):
    out = report.score_histogram(rows).orderBy("bin").collect()
    assert len(out) == 14
    assert sum(r["normal"] for r in out) == 2 and sum(r["flagged"] for r in out) == 3
    assert out[0]["flagged"] == 1
    edge = report.score_histogram(rows.withColumn("anomaly_score", F.lit(0.5))).orderBy("bin").collect()
    assert edge[13]["normal"] + edge[13]["flagged"] == 5
    assert report.score_histogram(rows.limit(0)).count() == 14


def test_classification(spark):
    truth = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "k int, t int")
    guess = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "k int, p int")
    out = report.classification_metrics(truth, guess, "k", "t", "p").first()
    assert tuple(out) == (1, 1, 1, 0.5, 0.5, 0.5)
    none = report.classification_metrics(truth, guess.withColumn("p", F.lit(0)), "k", "t", "p").first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)
    with pytest.raises(Exception, match="without a partner"):
        report.classification_metrics(truth, guess.filter("k < 4"), "k", "t", "p").collect()


def test_ratios(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    assert one(report.compression_ratio(F.lit(10), F.lit(4))) == 2.5
    assert one(report.compression_ratio(F.lit(10), F.lit(0))) == float("inf")
    assert one(report.dedup_reduction(F.lit(20), F.lit(16))) == 20.0
    assert one(report.dedup_reduction(F.lit(0), F.lit(0))) == 0.0
    assert one(report.saved_pct(F.lit(200), F.lit(50))) == 75.0


def test_raw_bytes(spark, lines):
    texts = ["añ", "", "x"]
    assert report.raw_bytes(lines(texts)).first()[0] == len("\n".join(texts).encode())
    assert report.raw_bytes(lines([])).first()[0] == 0
