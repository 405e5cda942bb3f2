"""Connected components by rounds and in one task, and the deletion of tables."""

import os
import random

import pytest

from tests.llm import plain
from tracegrain.llm import common


@pytest.mark.parametrize("local", [0, 50_000])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(common, "LOCAL_EDGES", local)
    pick = random.Random(3)
    links = [(pick.randrange(120), pick.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(30)] + [(7, 7)]
    first = plain.components(300, links)
    nodes = {x for pair in links if pair[0] != pair[1] for x in pair}
    found = common.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r["node"]: r["component"] for r in found} == {n: first[n] for n in nodes}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_scratch_deletes_all_but_what_is_kept(spark):
    with common.scratch() as keep:
        gone = common.written(spark.range(3), "gone")
        early = common.written(spark.range(4), "early")
        assert keep(early, "early") is early
        kept = keep(gone.filter("id > 0"), "kept")
        files = [df.inputFiles()[0].removeprefix("file://") for df in (gone, early, kept)]
    assert [os.path.exists(f) for f in files] == [False, True, True]
    assert kept.count() == 2
