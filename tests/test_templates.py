import random

import pytest
from pyspark.sql import functions as F

from tracegrain.operators import tables
from tracegrain.operators import templates as tm

LINES = [
    "2031-07-04 19:22:41 INFO  Kettle boils at 100 degrees",
    "2031-07-04 19:22:42 INFO  Kettle boils at 97 degrees",
    "2031-07-04 19:22:43 ERROR Door of 172.16.4.9 jammed for 12 minutes",
    "2031-07-04 19:22:44 DEBUG Parrot sleeps",
    "2031-07-04 19:22:44 DEBUG Parrot sleeps",
    "2031-07-04 19:22:45 CRITICAL Well 80% empty near pump-6, call the plumber",
]


def sequential(masked, threshold=0.5, prefix=1, max_children=100):
    """Plain loop over distinct masked lines: template per line, in order."""
    children, leaves, seen, where = {}, {}, {}, []
    for text in dict.fromkeys(masked):
        words = text.split()
        path = str(len(words))
        for word in words[: max(min(prefix, len(words) - 1), 0)]:
            if any(c in "0123456789" for c in word):
                word = "<*>"
            elif word != "<*>":
                known = children.setdefault(path, [])
                if word not in known and len(known) < max_children - 1:
                    known.append(word)
                if word not in known:
                    word = "<*>"
            path += " " + word
        clusters = leaves.setdefault(path, [])
        best, score = None, (-1, -1)
        for i, cluster in enumerate(clusters):
            equal = sum(a == b != "<*>" for a, b in zip(cluster, words))
            if (equal, cluster.count("<*>")) > score:
                best, score = i, (equal, cluster.count("<*>"))
        if best is not None and (not words or score[0] / len(words) >= threshold):
            clusters[best] = [a if a == b else "<*>" for a, b in zip(clusters[best], words)]
        else:
            best = len(clusters)
            clusters.append(words)
        seen[text] = (path, best)
    for text in masked:
        path, i = seen[text]
        where.append(((path, i), " ".join(leaves[path][i])))
    order = list(dict.fromkeys(key for key, _ in where))
    return [(template, order.index(key) + 1) for key, template in where]


def mined(df, options=tm.Mining()):
    rows = tm.with_mask(df)
    out = tm.assign_templates(rows, tm.mine_templates(rows, options)).orderBy("line_no").collect()
    return [(r["template"], r["cluster_id"]) for r in out]


def random_lines(seed, count, vocabulary=6):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i)}" for i in range(vocabulary)] + ["n1", "n2", "17"]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 4, 5]))) for _ in range(count)]


def test_contract(spark, lines):
    rows = tm.with_mask(lines(LINES))
    out = tm.assign_templates(rows, tm.mine_templates(rows), parameters=True).orderBy("line_no").collect()
    assert [r["raw"] for r in out] == LINES
    assert all(isinstance(r["cluster_id"], int) and r["template"] for r in out)
    assert all(isinstance(r["parameters"], list) for r in out)
    assert out[0]["template"] == out[1]["template"] == "<TIMESTAMP> INFO Kettle boils at <NUM> degrees"
    assert out[0]["cluster_id"] == out[1]["cluster_id"]
    assert out[3]["cluster_id"] == out[4]["cluster_id"]
    assert len({r["cluster_id"] for r in out}) == 4
    assert "172.16.4.9" not in out[2]["template"] and "12" not in out[2]["template"]


def test_empty_and_single(spark, lines):
    assert mined(lines([])) == []
    assert mined(lines(["a b c"])) == [("a b c", 1)]
    assert mined(lines(["", " ", "x"])) == [("", 1), ("", 1), ("x", 2)]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("threshold, prefix, children", [(0.5, 1, 100), (0.4, 2, 4), (0.7, 1, 3)])
def test_equals_the_loop(spark, lines, seed, threshold, prefix, children):
    texts = random_lines(seed, 120)
    masked = [r["masked"] for r in tm.with_mask(lines(texts)).orderBy("line_no").collect()]
    options = tm.Mining(similarity=threshold, prefix_tokens=prefix, max_children=children)
    assert mined(lines(texts), options) == sequential(masked, threshold, prefix, children)


def test_partitioning_does_not_matter(spark, lines):
    texts = random_lines(9, 200)
    expected = mined(lines(texts).repartition(1))
    assert mined(lines(texts).repartition(17)) == expected


def test_without_broadcast(spark, lines, monkeypatch):
    texts = random_lines(5, 150)
    expected = mined(lines(texts), tm.Mining(max_children=3))
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    assert mined(lines(texts), tm.Mining(max_children=3)) == expected


def test_online_templates(spark, lines):
    rows = tm.with_mask(lines(["go a b c", "go a b d", "go a b c"]))
    model = tm.mine_templates(rows)
    out = tm.assign_templates(rows, model, online=True).orderBy("line_no").collect()
    assert [r["template"] for r in out] == ["go a b c", "go a b <*>", "go a b c"]
    out = tm.assign_templates(rows, model).orderBy("line_no").collect()
    assert {r["template"] for r in out} == {"go a b <*>"}


@pytest.mark.parametrize("seed", [0])
def test_chunks_equal_one_pass(spark, lines, seed):
    """Chunks that share the model end with the clusters of a single pass."""
    texts = random_lines(seed + 20, 150)
    rows = tm.with_mask(lines(texts))
    options = tm.Mining(max_children=4)
    whole = tm.mine_templates(rows, options)
    model = tm.mine_templates(rows.filter("line_no < 40"), options)
    for low, high in ((40, 90), (90, 150)):
        chunk = rows.filter((F.col("line_no") >= low) & (F.col("line_no") < high))
        out, model = tm.match_templates(chunk, model, options)
        assert out.filter("template is null").isEmpty()
    columns = ["leader_line", "cluster_id", "template", "n", "first_line"]
    assert sorted(map(tuple, model.templates.df.select(columns).collect())) == sorted(
        map(tuple, whole.templates.df.select(columns).collect())
    )


def test_saved_model(spark, lines, tmp_path):
    rows = tm.with_mask(lines(LINES))
    tm.save_model(tm.mine_templates(rows), str(tmp_path))
    out, model = tm.match_templates(rows, tm.load_model(spark, str(tmp_path)))
    assert out.select("cluster_id").distinct().count() == 4
    assert model.templates.df.agg(F.sum("n")).first()[0] == 2 * len(LINES)


@pytest.mark.parametrize("seed, block", [(0, 7), (1, 30), (2, 1)])
def test_leaves_in_blocks_equal_the_loop(spark, lines, monkeypatch, seed, block):
    """The size of a block never changes a cluster, in one pass or in chunks."""
    monkeypatch.setattr(tm, "BLOCK_LINES", block)
    texts = random_lines(seed, 90, vocabulary=4)
    masked = [r["masked"] for r in tm.with_mask(lines(texts)).orderBy("line_no").collect()]
    assert mined(lines(texts)) == sequential(masked)
    rows = tm.with_mask(lines(texts))
    whole = tm.mine_templates(rows)
    model = tm.mine_templates(rows.filter("line_no < 50"))
    _, model = tm.match_templates(rows.filter("line_no >= 50"), model)
    columns = ["leader_line", "cluster_id", "template", "n", "first_line"]
    assert sorted(map(tuple, model.templates.df.select(columns).collect())) == sorted(
        map(tuple, whole.templates.df.select(columns).collect())
    )


def test_postings_find_what_a_full_comparison_finds():
    rng = random.Random(8)
    for threshold in (0.0, 0.3, 0.5, 0.75, 1.0):
        rows = [[rng.choice("abcd") for _ in range(5)] for _ in range(120)]
        owner, _, templates = tm._merge_leaf(rows, [], threshold)
        clusters, plain = [], []
        for row in rows:
            score = [(sum(a == b != "<*>" for a, b in zip(c, row)), c.count("<*>"), -i) for i, c in enumerate(clusters)]
            best = -max(score)[2] if score and max(score)[0] / 5 >= threshold else len(clusters)
            clusters[best : best + 1] = [[a if a == b else "<*>" for a, b in zip(clusters[best], row)] if best < len(clusters) else row]
            plain.append(best)
        assert owner == plain and templates == [" ".join(c) for c in clusters]


def test_unlike_lines_get_only_the_clusters_they_might_join(spark, lines, monkeypatch):
    """A leaf of lines that have little in common: same clusters, and blocks are sent few of them."""
    monkeypatch.setattr(tm, "BLOCK_LINES", 200)
    rng = random.Random(12)
    texts = ["go " + " ".join(f"w{rng.randrange(4000):x}q" for _ in range(5)) for _ in range(1_500)]
    texts += [t.rsplit(" ", 1)[0] + " zz" for t in texts[:60]]
    sent, real = [], tm._sent
    monkeypatch.setattr(tm, "_sent", lambda *a: sent.append(real(*a)) or sent[-1])
    masked = [r["masked"] for r in tm.with_mask(lines(texts)).orderBy("line_no").collect()]
    assert mined(lines(texts)) == sequential(masked)
    blocks = 1_560 // 200 + 1
    assert sent[-1].count() < 0.7 * len(texts) * blocks / 2


def test_blank_lines_in_blocks(spark, lines, monkeypatch):
    monkeypatch.setattr(tm, "BLOCK_LINES", 3)
    texts = [" " * i for i in range(20)] + ["a b"]
    assert mined(lines(texts)) == sequential([r["masked"] for r in tm.with_mask(lines(texts)).orderBy("line_no").collect()])
