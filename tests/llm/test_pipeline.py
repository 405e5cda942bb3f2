"""The pipeline stage by stage against plain versions, each on what the stage before kept."""

import random

import corpus_pipeline
from tests import oracle
from tests.llm import plain
from tracegrain.llm import jaccard, queries
from tracegrain.llm.common import table, written

SF_DIR = "/root/testdata/sf0.001"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    columns = docs.columns
    good = {r[0] for r in oracle.connect(SF_DIR).execute(f"select doc_id from ({queries.QUALITY_SQL}) where kept").fetchall()}
    expected = _rows(docs.filter(docs["doc_id"].isin(list(good))))
    stages = dict(corpus_pipeline.STAGES)
    docs = written(stages["quality rules"](spark, docs, SF_DIR), "stage")
    assert docs.columns == columns and _rows(docs) == expected

    known = written(stages["language ID"](spark, docs, SF_DIR), "stage")
    assert known.columns == columns and set(_rows(known)) <= set(expected)
    assert known.count() > 0.98 * docs.count()

    rows = sorted(_rows(known))
    first = plain.shingle_components([r[1] for r in rows], 5, 80)[1]
    expected = sorted((rows[i] for i in set(first)), key=repr)
    docs = written(stages["n-gram Jaccard join"](spark, known, SF_DIR), "stage")
    assert docs.columns == columns and _rows(docs) == expected and len(expected) < len(rows)

    kept = [e[4].decode("utf-8", "ignore") for e in plain.byte_removals([r[1] for r in expected], corpus_pipeline.REPEAT_BYTES)]
    expected = sorted(((d, t, *more[:-1], len(t)) for (d, _, *more), t in zip(expected, kept)), key=repr)
    docs = written(stages["suffix-array dedup"](spark, docs, SF_DIR), "stage")
    assert docs.columns == columns and _rows(docs) == expected

    packed = stages["best-fit packing"](spark, docs, SF_DIR)
    assert {r["doc_id"] for r in packed.collect()} == {r[0] for r in expected}


def test_run_equals_its_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_DIR), "stage")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert _rows(corpus_pipeline.run(spark, SF_DIR).select(columns)) == _rows(docs.select(columns))


def test_empty_table(spark):
    docs = table(spark, SF_DIR, "documents").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_DIR), "stage")
    assert docs.count() == 0


def test_near_duplicates_of_a_common_passage(spark, monkeypatch):
    """Documents that share a passage only do not reach the search of the stage among each other."""
    pick = random.Random(6)
    words = [f"w{i}" for i in range(6)]
    passage = " ".join(pick.choice(words) for _ in range(25))
    rows = [(i, " ".join(pick.choice(words) for _ in range(70)) + " " + passage) for i in range(160)]
    rows += [(1000 + i, "x " + rows[i][1]) for i in range(10)]
    searched, find = [], jaccard._find_links
    monkeypatch.setattr(jaccard, "_find_links", lambda tasks, *more: searched.append(tasks.count()) or find(tasks, *more))
    monkeypatch.setattr(jaccard, "SMALL", 8)
    monkeypatch.setattr(jaccard.link, "__defaults__", (*jaccard.link.__defaults__[:2], 10, *jaccard.link.__defaults__[3:]))
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    first = plain.shingle_components([t for _, t in rows], 5, 80)[1]
    assert sorted(r["doc_id"] for r in kept.collect()) == [rows[i][0] for i in range(len(rows)) if first[i] == i]
    assert sum(searched) <= 2 * len(rows)
