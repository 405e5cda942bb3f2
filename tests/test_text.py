import pytest
from pyspark.sql import functions as F

from tracegrain.functions import text as tx


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, masked",
    [
        ("2031-07-04 19:22:41 INFO  Kettle 7 boils at 100 degrees", "<TIMESTAMP> INFO  Kettle <NUM> boils at <NUM> degrees"),
        (
            "2031-07-04 19:22:43 ERROR Door of 172.16.4.9 jammed for 12 minutes",
            "<TIMESTAMP> ERROR Door of <IP> jammed for <NUM> minutes",
        ),
        ("CRITICAL Well 80% empty near pump-6", "CRITICAL Well <NUM>% empty near pump-<NUM>"),
        ("sorted within 9ms for guest_5", "sorted within 9ms for guest_5"),
        (
            "2031-07-04T08:00:01Z x 300.1.2.3 v1.2 -5 0x1f 3.14",
            "<NUM>-<NUM>-04T08:<NUM>:01Z x <IP> v1.<NUM> -<NUM> 0x1f <NUM>.<NUM>",
        ),
        ("2031-07-04 08:00:01,123 a", "<TIMESTAMP>,<NUM> a"),
        ("", ""),
    ],
)
def test_mask(spark, raw, masked):
    assert one(spark, tx.mask(F.lit(raw))) == masked


def test_mask_rules_and_brackets_can_be_replaced(spark):
    assert one(spark, tx.mask(F.lit("a 12 b"), [(r"\d+", "N$")], "{", "}")) == "a {N$} b"


@pytest.mark.parametrize(
    "raw, level",
    [
        ("x DEBUG y", 0),
        ("x INFO y", 1),
        ("x WARN y", 2),
        ("x WARNING y", 2),
        ("x error y", 3),
        ("x CRITICAL y", 4),
        ("x fatal y", 4),
        ("no level here", 1),
        ("ERROR in debug mode", 0),
        ("ERROR for your information", 1),
        ("", 1),
    ],
)
def test_level(spark, raw, level):
    assert one(spark, tx.extract_level(F.lit(raw))) == level


def test_level_by_whole_word(spark):
    assert one(spark, tx.extract_level(F.lit("ERROR for your information"), word_match=True)) == 3


@pytest.mark.parametrize(
    "raw, hour",
    [
        ("2031-07-04 08:00:01 x", 8),
        ("[23:59:59] x", 23),
        ("at 00:00:00", 0),
        ("no time", -1),
        ("8:00:01", -1),
        ("99:10:10", 99),
        ("2031-07-04T08:00:01", -1),
        ("a 11:22:33 b 12:00:00", 11),
        ("", -1),
    ],
)
def test_hour(spark, raw, hour):
    assert one(spark, tx.extract_hour(F.lit(raw))) == hour


def test_strict_hour(spark):
    assert one(spark, tx.extract_hour(F.lit("99:10:10"), strict=True)) == -1


def test_tokens(spark):
    assert one(spark, tx.tokens(F.lit(""))) == []
    assert one(spark, tx.tokens(F.lit("  a\tB  c "), lower=True)) == ["a", "b", "c"]
    assert one(spark, tx.word_count(F.lit("   "))) == 0


def test_level_name(spark):
    assert one(spark, tx.level_name(F.lit(3))) == "ERROR"
    assert one(spark, tx.level_name(F.lit(9))) is None
    assert one(spark, tx.level_name(F.lit(9), "INFO")) == "INFO"


def test_severity(spark):
    assert one(spark, tx.severity_pct(F.lit(-0.25))) == 25.0
    assert one(spark, tx.severity_pct(F.lit(-3.0))) == 100.0
    assert one(spark, tx.is_severe(F.lit(4))) and not one(spark, tx.is_severe(F.lit(2)))


def test_snippet(spark):
    assert one(spark, tx.snippet(F.lit("abcdef"), 3)) == "abc"
    assert one(spark, tx.snippet(F.lit("abcdef"), 3, "…")) == "abc…"
    assert one(spark, tx.snippet(F.lit("abc"), 3, "…")) == "abc"


def test_parameters(spark):
    found = tx.extract_parameters(F.lit("user u1 did x in 5ms"), F.lit("user <*> did x in <*>"))
    assert one(spark, found) == ["u1", "5ms"]
    assert one(spark, tx.extract_parameters(F.lit("a b"), F.lit("a b"))) == []
