import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrain.operators import features, forest, tables
from tracegrain.operators.tables import Table, materialize
from tracegrain.plans.analyze import analyze, run
from tracegrain.sources.scored import read_scored


@pytest.fixture
def outlier(spark):
    rows = [(i, f"2024-01-15 08:00:{i:02d} INFO all is well", "<TIMESTAMP> INFO all is well", 1) for i in range(20)]
    rows.append((20, "2024-01-15 03:00:00 CRITICAL disk gone", "<TIMESTAMP> CRITICAL disk gone", 2))
    df = spark.createDataFrame(rows, "line_no bigint, raw string, template string, cluster_id int")
    return materialize(features.build_features(df), "features")


def scores(table, **options):
    out = forest.score(table.df, forest.train_forest(table), **options)
    return {r["line_no"]: (r["anomaly_score"], r["is_anomaly"]) for r in out.collect()}


def test_features(spark, outlier):
    rows = {r["line_no"]: r["features"] for r in outlier.df.collect()}
    assert rows[0] == [1, 20, 8, 5]
    assert rows[20] == [4, 1, 3, 4]


def test_features_without_cluster_or_template(spark, lines):
    rows = features.build_features(lines(["ERROR a b", "x"])).orderBy("line_no").collect()
    assert [r["features"] for r in rows] == [[3, 2, -1, 3], [1, 2, -1, 1]]


def test_outlier_is_flagged_and_lowest(outlier):
    out = scores(outlier, contamination=0.1)
    assert out[20][1] and out[20][0] == min(s for s, _ in out.values())
    assert not any(flag for line, (_, flag) in out.items() if line != 20)
    assert all(np.isfinite(s) for s, _ in out.values())


def test_same_result_whatever_the_partitions(outlier):
    expected = scores(outlier)
    assert scores(Table(outlier.df.repartition(7))) == expected


def test_flags_follow_the_contamination(spark):
    df = spark.range(4000).select(
        F.col("id").alias("line_no"),
        F.array(*[(F.xxhash64("id", F.lit(k)) % 50).cast("int") for k in range(4)]).alias("features"),
    )
    table = materialize(df, "features")
    few, many = (
        sum(flag for _, flag in scores(table, contamination=c).values()) for c in (0.02, 0.2)
    )
    assert abs(few - 80) <= 5 and abs(many - 800) <= 20


@pytest.mark.parametrize("rows", [150, 160, 161, 3000])
def test_every_tree_draws_for_itself_at_any_size(spark, rows):
    df = spark.range(rows).select(F.col("id").alias("line_no"), F.array(F.lit(1), F.col("id").cast("int")).alias("features"))
    picked = {(r["tree"], r["line_no"]) for r in forest._samples(df, rows, trees=10, sample=16, seed=1).collect()}
    sizes = {}
    for tree, _ in picked:
        sizes[tree] = sizes.get(tree, 0) + 1
    assert sizes == dict.fromkeys(range(10), 16)
    again = forest._samples(df.repartition(9), rows, trees=10, sample=16, seed=1).collect()
    assert {(r["tree"], r["line_no"]) for r in again} == picked


@pytest.mark.parametrize("share", [0.0, 0.05, 0.4, 0.97, 1.0])
def test_percentile_of_odd_values_is_the_same_on_both_sides_of_the_bound(spark, monkeypatch, share):
    inf, nan = float("inf"), float("nan")
    rows = [(None, 60), (nan, 3), (inf, 4), (-inf, 5), *((i / 7, 2) for i in range(40))]
    table = Table(spark.createDataFrame(rows, "value double, weight bigint"))
    expected = forest.weighted_percentile(table, share)
    monkeypatch.setattr(forest, "PERCENTILE_ROWS", 0)
    assert forest.weighted_percentile(table, share) == pytest.approx(expected, nan_ok=True)
    nothing = Table(spark.createDataFrame([(None, 2)], "value double, weight bigint"))
    assert forest.weighted_percentile(nothing, share) is None


@pytest.mark.parametrize("share", [0.0, 0.05, 0.333, 0.5, 1.0])
def test_percentile_by_narrowing(spark, monkeypatch, share):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=500), np.repeat(0.25, 300), [1e9, -1e9, 3.0, 3.0 + 1e-12]])
    unique, counts = np.unique(values, return_counts=True)
    df = spark.createDataFrame(list(zip(unique.tolist(), counts.tolist())), "value double, weight bigint")
    expected = np.percentile(values, 100 * share)
    assert forest.weighted_percentile(Table(df), share) == pytest.approx(expected, rel=1e-12)
    monkeypatch.setattr(forest, "PERCENTILE_ROWS", 0)
    assert forest.weighted_percentile(Table(df), share) == pytest.approx(expected, rel=1e-12)


def test_rows_on_the_threshold_are_normal(spark):
    df = spark.createDataFrame([(1.0,)] * 10 + [(0.5,)], "v double")
    assert forest.flag_by_contamination(df, "v", 0.2).filter("is_anomaly").count() == 1


LINES = (
    ["2031-07-04 08:22:41 INFO Kettle boils at 97"] * 4
    + ["2031-07-04 09:22:43 ERROR Door of 172.16.4.9 jammed for 12 minutes"] * 3
    + ["2031-07-04 10:22:44 DEBUG Parrot sleeps over guest_5", ""]
    + ["2031-07-04 11:22:45 CRITICAL Well 80% empty near pump-6, call plumber"]
)


def test_whole_analysis(spark, lines, tmp_path):
    done = run(lines(LINES), str(tmp_path))
    stored = read_scored(spark, done.path)
    assert stored.count() == 5
    assert {r["line_no"] for r in done.analysis.scored.collect()} == {0, 4, 7, 8, 9}
    report = done.report.first()
    assert (report["lines"], report["total_records"], report["dedup_reduction_pct"]) == (10, 5, 50.0)
    assert report["raw_size_bytes"] == len("\n".join(LINES).encode())
    ledger = done.ledger.orderBy("stage").collect()
    assert [r["lines_out"] for r in ledger] == [10, 10, 5, 5, 5]
    assert ledger[2]["entries_removed"] == 5 and ledger[1]["unique_templates"] == 5


def test_analysis_equals_its_steps(spark, lines):
    """Deduplicating the assigned lines gives the lines that the short way keeps."""
    from tests.test_templates import random_lines
    from tracegrain.operators import dedup, templates as tm

    df = lines(random_lines(31, 200))
    for online in (False, True):
        rows = tm.with_mask(df)
        assigned = tm.assign_templates(rows, tm.mine_templates(rows), online=online)
        kept = dedup.dedup_first_wins(assigned).select("line_no", "template", "cluster_id")
        scored = analyze(df, online=online).scored.select("line_no", "template", "cluster_id")
        assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, kept.collect()))


def test_frequency_before_dedup(spark, lines):
    out = {r["line_no"]: r["cluster_freq"] for r in analyze(lines(LINES), freq_source="raw").scored.collect()}
    assert out == {0: 4, 4: 3, 7: 1, 8: 1, 9: 1}


def test_analysis_without_broadcast(spark, lines, monkeypatch):
    """Tables that are too large to broadcast give the same result by shuffles."""
    from tests.test_templates import random_lines

    df = lines(random_lines(32, 100) + LINES * 20)
    expected = sorted(map(str, analyze(df).scored.select("line_no", "cluster_id", "anomaly_score").collect()))
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(tables, "HOT_SHARE", 10)
    out = analyze(df).scored.select("line_no", "cluster_id", "anomaly_score")
    assert sorted(map(str, out.collect())) == expected


def test_empty_analysis(spark, lines):
    done = analyze(lines([]))
    assert done.scored.count() == 0
    assert done.totals().first()["lines"] == 0
