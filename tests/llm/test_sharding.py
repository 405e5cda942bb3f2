"""Sharding: a permutation, equal shards, gapless slots, and the odd tables."""

import binascii

import numpy as np
import pytest

from tests import oracle
from tracegrain.llm import queries, sharding

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 255, 1000, 4097])
def test_is_a_permutation_and_turns_back(n):
    places = sharding.permute(np.arange(n), n)
    assert sorted(places) == list(range(n))
    assert (sharding.permute(places, n, backwards=True) == np.arange(n)).all()


def test_seed_changes_the_order():
    assert (sharding.permute(np.arange(500), 500, 1) != sharding.permute(np.arange(500), 500, 2)).mean() > 0.9


def test_query_against_rows_in_python(spark):
    rows = queries.op3_shards(spark, SF_DIR).toPandas()
    texts = oracle.connect(SF_DIR).execute("select doc_id, text from documents order by doc_id").fetchall()
    places = dict(zip([d for d, _ in texts], sharding.permute(np.arange(len(texts)), len(texts)).tolist()))
    assert len(rows) == len(texts)
    for row, text in zip(rows.sort_values("doc_id").itertuples(), [t for _, t in texts]):
        data = (text or "").encode()
        assert (row.size, row.text_crc32) == (len(data) + 1, binascii.crc32(data))
        assert (row.shard, row.slot) == (places[row.doc_id] % 16, places[row.doc_id] // 16)
    counts = rows.groupby("shard").slot.agg(["count", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1
    assert (counts["count"] == counts["max"] + 1).all() and (counts["count"] == counts["nunique"]).all()


def test_row_at_names_the_row(spark):
    df = spark.range(37).selectExpr("id as doc_id", "cast(id as string) as text")
    for row in sharding.shard(df, 5).collect():
        assert sharding.row_at(row["shard"], row["slot"], 37, 5) == row["row_number"]


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(None, None, 1, 9), (None, "a", 1, 9), (3, "", 1, 9), (3, "", 1, 9), (4, "ü" * 50_000, 1, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int, _part int")
    out = sharding.shard(df, 2).toPandas()
    assert sorted(out["size"]) == [1, 1, 1, 2, 100_001]
    assert sorted(zip(out["shard"], out["slot"])) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    assert sharding.shard(df.filter("false"), 2).count() == 0
