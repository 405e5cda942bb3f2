import random

import pytest
from pyspark.sql import functions as F

from tracegrain.functions import minhash as mh
from tracegrain.operators import dedup, tables
from tracegrain.operators.bloom import Bloom, possible
from tracegrain.plans.analyze import analyze

SAME = ["ERROR Door of <IP> jammed for <NUM> minutes"] * 3
UNIQUE = [
    "INFO Kettle boils at <NUM> degrees",
    "DEBUG Parrot number <NUM> sleeps soundly",
    "CRITICAL Well <NUM>% empty near pump-<NUM>, call the plumber",
]


def kept(df, **options):
    return [r["line_no"] for r in dedup.dedup_first_wins(df, **options).orderBy("line_no").collect()]


def loop(rows):
    taken, out = set(), []
    for line, keys in sorted(rows):
        own = set(enumerate(keys))
        if not own & taken:
            taken |= own
            out.append(line)
    return out


def bands_frame(spark, rows):
    return spark.createDataFrame(rows, "line_no bigint, bands array<binary>").repartition(5)


def run_first_wins(spark, rows, width):
    result = dedup.first_wins(bands_frame(spark, rows), width)
    return sorted(r["line_no"] for r in result.df.collect()), result.rounds


def test_contract(spark, lines):
    assert kept(lines(SAME, "template")) == [0]
    assert kept(lines(UNIQUE, "template")) == [0, 1, 2]
    assert kept(lines(SAME + UNIQUE[:2], "template")) == [0, 3, 4]
    assert kept(lines([], "template")) == []
    assert kept(lines(UNIQUE[:1], "template")) == [0]
    assert kept(lines(["", "a b", " ", ""], "template")) == [0, 1]


def test_all_columns_stay(spark, lines):
    df = lines(SAME, "template").withColumn("raw", F.lit("x")).withColumn("cluster_id", F.lit(3))
    assert dedup.dedup_first_wins(df).columns == df.columns


def test_word_order_and_case_do_not_count(spark, lines):
    df = lines(["a b c", "C B A", "a b b c", "a b d"], "template")
    assert kept(df) == [0, 3]
    assert [r["line_no"] for r in dedup.dedup_exact(df).orderBy("line_no").collect()] == [0, 3]


def test_signatures_follow_their_definition(spark, lines):
    import hashlib

    texts = ["a b c", "", "a  B", "x"]
    got = lines(texts).select(mh.minhash("raw").alias("s")).collect()
    for text, row in zip(texts, got):
        hashes = {int(hashlib.md5(w.encode()).hexdigest()[:7], 16) for w in text.lower().split()}
        expected = [min(((h * a + b) % mh.PRIME for h in hashes), default=-1) for a, b in mh.permutations(64)]
        assert row["s"] == expected


def test_similarity_estimate(spark, lines):
    rows = lines([UNIQUE[0], UNIQUE[0].upper(), UNIQUE[2]]).select("line_no", mh.minhash("raw").alias("s"))
    pairs = rows.alias("a").join(rows.alias("b"), F.col("a.line_no") == 0)
    out = pairs.select("b.line_no", mh.jaccard_estimate("a.s", "b.s").alias("j"))
    j = {r["line_no"]: r["j"] for r in out.collect()}
    assert j[0] == j[1] == 1.0 and j[2] < 0.5


def test_banding_table_follows_from_the_rule():
    fixed = dict(mh.BANDINGS)
    for key in fixed:
        mh.BANDINGS.pop(key)
    try:
        assert {key: mh.banding(*key) for key in fixed} == fixed
    finally:
        mh.BANDINGS.update(fixed)


@pytest.mark.parametrize("keys, width", [(20, 5), (60, 5), (200, 5), (30, 1)])
def test_rounds_equal_the_loop(spark, keys, width):
    rng = random.Random(keys)
    rows = [(i, [bytes([rng.randrange(keys)]) for _ in range(width)]) for i in range(300)]
    assert run_first_wins(spark, rows, width)[0] == loop(rows)


def test_chain_keeps_every_second_row(spark):
    rows = [(i, [str((i + 1) // 2).encode(), b"x" + str(i // 2).encode()]) for i in range(24)]
    out, rounds = run_first_wins(spark, rows, 2)
    assert out == loop(rows) == list(range(0, 24, 2))
    assert rounds == dedup.TAIL_ROUNDS


def test_chain_by_rounds_only(spark, monkeypatch):
    monkeypatch.setattr(dedup, "TAIL_ROWS", -1)
    rows = [(i, [str((i + 1) // 2).encode(), b"x" + str(i // 2).encode()]) for i in range(16)]
    out, rounds = run_first_wins(spark, rows, 2)
    assert out == loop(rows) and rounds == 8


def test_hot_buckets(spark, monkeypatch):
    """A bucket with a third of all rows goes through the salted join."""
    monkeypatch.setattr(dedup, "SKEW_ROWS", 0)
    monkeypatch.setattr(dedup, "HOT_SHARE", 10)
    rng = random.Random(1)
    rows = [(i, [b"hot" if i % 3 == 0 else bytes([rng.randrange(250)]), bytes([rng.randrange(90)])]) for i in range(300)]
    assert run_first_wins(spark, rows, 2)[0] == loop(rows)


def test_stricter_threshold_keeps_at_least_as_much(spark, lines):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    df = lines([base, base + " lambda", base + " mu nu", base.replace("alpha", "omega")], "template")
    assert len(kept(df, threshold=0.95)) >= len(kept(df, threshold=0.5))
    assert kept(df, threshold=0.9, num_perm=128)[0] == 0


@pytest.mark.parametrize("seed", [0])
def test_chunks_equal_one_pass(spark, lines, seed):
    rng = random.Random(seed)
    words = ["aa", "bb", "cc", "dd", "ee"]
    df = lines([" ".join(rng.choices(words, k=3)) for _ in range(120)], "template")
    whole = kept(df, threshold=0.5)
    earlier, out = None, []
    for low in (0, 50, 100):
        part = df.filter(F.col("line_no").between(low, low + 49))
        if earlier is None:
            first = dedup.find_kept(part, threshold=0.5)
            survivors, bands = dedup.keep_lines(part, first.lines()), first.bands()
        else:
            survivors, bands = dedup.dedup_incremental(part, earlier, threshold=0.5)
        out += [r["line_no"] for r in survivors.collect()]
        earlier = bands if earlier is None else earlier.unionByName(bands)
    assert sorted(out) == whole


def test_pairs(spark, lines, monkeypatch):
    df = lines(SAME + UNIQUE + ["", ""], "template")
    expected = [(0, 1), (0, 2), (6, 7)]
    assert sorted(map(tuple, dedup.near_dup_pairs(df).collect())) == expected
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, dedup.near_dup_pairs(df).collect())) == expected


def scans(spark, df):
    """``df`` with a column that counts how often its rows are computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    return df.withColumn("raw", counted("raw")), seen


def test_lines_are_read_once(spark, lines, monkeypatch):
    """Rows come along through the aggregation: no second scan, and no shuffle by line number."""
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 0)
    texts = [f"{pick} number {i % 7} of {i % 3}" for i, pick in enumerate(["alpha", "beta", "gamma"] * 40)]
    plain = lines(texts).withColumn("other", F.concat(F.lit("row "), "line_no"))
    for run in (
        lambda df: dedup.dedup_first_wins(df, "raw"),
        lambda df: dedup.dedup_exact(df, "raw"),
        lambda df: dedup.dedup_incremental(df, None, "raw")[0],
    ):
        df, seen = scans(spark, plain)
        rows = run(df).collect()
        assert seen.value == len(texts)
        assert all(r["other"] == f"row {r['line_no']}" and r["raw"] == texts[r["line_no"]] for r in rows)
    df, seen = scans(spark, plain)
    found = analyze(df.select("line_no", "raw")).scored.collect()
    assert seen.value == len(texts)
    assert found and all(r["raw"] == texts[r["line_no"]] for r in found)


def test_verified_pairs(spark, lines, monkeypatch):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    df = lines([base, base + " x", base.upper(), "x y", "", " ", base + " a b c d e f g h"] + [base + " x"] * 3, "template")
    loose = {tuple(p) for p in dedup.near_dup_pairs(df, threshold=0.5).collect()}
    sets = [set((r["template"] or "").lower().split()) for r in df.orderBy("line_no").collect()]
    alike = lambda a, b, t: not (a | b) or len(a & b) >= t * len(a | b)
    for broadcast in (None, 0):
        if broadcast is not None:
            monkeypatch.setattr(tables, "BROADCAST_ROWS", broadcast)
        found = {tuple(p) for p in dedup.near_dup_pairs(df, threshold=0.5, verify=True).collect()}
        assert found == {(a, b) for a, b in loose if alike(sets[a], sets[b], 0.5)}
    assert (0, 2) in found and (4, 5) in found


def test_filters_pass_their_keys_and_few_others(spark):
    keys = spark.range(6_000).selectExpr("id as k")
    small, large = keys.filter("k < 40"), keys.filter("k between 40 and 2999")
    filters = [Bloom.build(small, ["k"], 40), Bloom.build(large, ["k"], 2_960)]
    passed = {r["k"] for r in possible(keys, filters).collect()}
    assert passed >= set(range(3_000)) and len(passed) < 3_000 + 100
    assert possible(keys, []).count() == 0


def test_incremental_with_a_filter(spark, lines):
    rng = random.Random(5)
    df = lines([" ".join(rng.choices(["aa", "bb", "cc", "dd", "ee"], k=3)) for _ in range(200)], "template")
    first, second = df.filter("line_no < 120"), df.filter("line_no >= 120")
    early = dedup.find_kept(first, threshold=0.5)
    seen = [Bloom.build(early.bands(), ["band", "key"], 500)]
    plain, bands = dedup.dedup_incremental(second, early.bands(), threshold=0.5)
    filtered, same = dedup.dedup_incremental(second, early.bands(), threshold=0.5, seen=seen)
    key = lambda rows: sorted(r["line_no"] for r in rows.collect())
    assert key(plain) == key(filtered) and key(bands) == key(same)
