"""Search through the trigram index: the rows of a full scan, and files that are left out."""

import re

import pytest
from pyspark.sql import functions as F

from tracegrain.operators import explore
from tracegrain.operators.search_index import build_index, needed_grams, search_stored

TEXTS = [f"INFO guest_{i} opened door {i * 7}" for i in range(60)] + ["Straße ſensor İstanbul", "KELVIN sign 3", "a.b [x] 50%", "", "ab"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path, index = (str(tmp_path_factory.mktemp(name)) for name in ("table", "index"))
    df = spark.createDataFrame([(i, t, f"<*> {t[:6]}") for i, t in enumerate(TEXTS)], "line_no bigint, raw string, template string")
    df.repartitionByRange(13, "line_no").write.mode("overwrite").parquet(path)
    build_index(spark, path, index)
    return path, index


CASES = [
    ("guest_42", False), ("guest_4[0-3]|door 14\\b", False), ("GUEST_7 ", True), ("sensor", False), ("istanbul", False), ("kelvin", True),
    ("Kelvin|zzz", False), ("a\\.b", False), ("50%", True), ("nothing here", True), ("door \\d+", False), ("(guest)_1", False),
    ("(?i)guest_2", False), ("gues+t_3", False), ("gue?st_3", False), ("guest_3{1,2}", False), ("[x]", False), ("straße", True), ("", False),
    ("x|guest_59", False), ("^INFO.*399$", False), ("guest_(1|2)2", False), ("\\bdoor\\b", False), ("a.b", True),
]


@pytest.mark.parametrize("text, literal", CASES)
def test_same_rows_as_a_scan(spark, stored, text, literal):
    found = search_stored(spark, *stored, text, literal)
    expected = explore.search(spark.read.parquet(stored[0]), text, literal)
    assert sorted(r["line_no"] for r in found.rows.collect()) == sorted(r["line_no"] for r in expected.collect())
    assert found.files + found.skipped == 13


def test_files_without_a_hit_are_left_out(spark, stored):
    assert search_stored(spark, *stored, "guest_42").skipped >= 11
    assert search_stored(spark, *stored, "nothing here", literal=True).files == 0
    assert search_stored(spark, *stored, ".*").skipped == 0


def test_later_files_are_read(spark, stored, tmp_path):
    path, index = str(tmp_path / "t"), str(tmp_path / "i")
    spark.read.parquet(stored[0]).write.parquet(path)
    build_index(spark, path, index)
    spark.createDataFrame([(900, "guest_42 again", "")], "line_no bigint, raw string, template string").write.mode("append").parquet(path)
    found = search_stored(spark, path, index, "guest_42 again", literal=True)
    assert [r["line_no"] for r in found.rows.collect()] == [900] and found.skipped > 0


def test_needed_grams_are_needed():
    assert needed_grams("abc|de") is None
    assert needed_grams("abcd|X.efg") == [{"abc", "bcd"}, {"efg"}]
    assert needed_grams("ab*cd?efg") == [{"efg"}]
    assert needed_grams("a{2}bcd") == [{"bcd"}]
    assert needed_grams("(abc|x)yz1") == [{"yz1"}]
    assert needed_grams("abc[") is None and needed_grams("\\Qabc") is None
    for pattern, text in (("gr[ae]y door", "GREY DOOR"), ("1\\.5 ms", "took 1.5 MS"), ("ab+cde", "ABBBCDE")):
        assert re.search(pattern, text, re.I)
        for grams in needed_grams(pattern):
            assert all(g in text.lower() for g in grams)


def test_empty_table(spark, tmp_path):
    path, index = str(tmp_path / "t"), str(tmp_path / "i")
    spark.createDataFrame([], "line_no bigint, raw string, template string").write.parquet(path)
    build_index(spark, path, index)
    assert search_stored(spark, path, index, "abc", True).rows.count() == 0
    odd = spark.createDataFrame([(None, None), ("abcd", None)], "raw string, template string").withColumn("file", F.lit(1))
    odd.write.mode("overwrite").parquet(path)
    build_index(spark, path, index)
    assert search_stored(spark, path, index, "BCD", True).rows.count() == 1
