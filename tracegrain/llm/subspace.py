"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors are scaled to length 1, turned by a fixed random rotation and cut into blocks of some dimensions.
Two vectors whose squared distance is at most D have a block in which it is at most D times that block's
share of the dimensions. So vectors are compared block by block, each with its share of the budget, as products of
matrices; a pair within the budget of any block is a candidate and verified exactly on the original components.
Wide blocks leave next to no others as candidates. No grid goes before the blocks: at this distance its cells hold
most vectors and repeat each of them many times.

Vectors of equal label and components are one class from the start. The vectors of a label are dealt to pieces, and
two pieces are compared in a task, so the rows that move are those of the table times the pieces of a label.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.common import Links, checked_join, components, written

COSINE = 0.93
BLOCK = 32
# Rows of a piece of a label: two of them are compared in a task at a time.
PIECE = 16_384
# Rows of either side in one product, and candidates that are verified at a time.
TILE = 1_024
SEED = 17
# Slack for rounding when candidates are searched, in double and in single precision; verification has none.
SLACK = 1e-9
ROUNDING = 1e-4


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for every task."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0]


def blocks(size: int, limit: float, width: int = BLOCK) -> list[tuple[int, int, float]]:
    """Start, end and squared-distance budget of every block."""
    starts = range(0, size, width)
    return [(s, min(s + width, size), limit * (min(s + width, size) - s) / size) for s in starts]


def limit_of(cosine: float) -> float:
    """Largest squared distance of unit vectors of that cosine."""
    return 2 - 2 * cosine + SLACK


def _turned(vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return (vectors / norms[:, None]) @ rotation(vectors.shape[1])


def usable(frame: pd.DataFrame) -> np.ndarray:
    """Whether a vector can link at all: label and vector there, all components finite, not zero."""

    def good(vector) -> bool:
        if vector is None or len(vector) == 0:
            return False
        values = np.array([np.nan if v is None else v for v in vector], dtype=np.float64)
        return bool(np.isfinite(values).all() and values.any())

    return np.array([label is not None and label == label and good(v) for label, v in zip(frame["label"], frame["vector"])], dtype=bool)


def _classes(rows: DataFrame) -> DataFrame:
    """One row per class of equal label and vector: class id (smallest id), number of members."""
    return rows.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))


def _pieces(classes: DataFrame) -> DataFrame:
    """Rows of every pair of pieces of a label and length: those of ``piece`` are compared with those of ``other``.

    The rows of a label are dealt to pieces by their hash, and each goes to all pairs that its piece is in.
    """
    rows = classes.withColumn("size", F.size("vector"))
    sizes = rows.groupBy("label", "size").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    rows = checked_join(rows, written(sizes, "label-sizes"), ["label", "size"], "inner")
    rows = rows.withColumn("_k", F.ceil(F.col("_rows") / PIECE).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id", "vector"), F.col("_k")).cast("int"))
    rows = rows.withColumn("_met", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    pair = {"piece": F.least("own", "_met"), "other": F.greatest("own", "_met")}
    return rows.withColumns(pair).drop("_rows", "_k", "_met")


def _sides(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices whose product holds the squared distances of all rows."""
    squares, ones = (turned * turned).sum(axis=1, keepdims=True), np.ones((len(turned), 1))
    left, right = np.hstack([-2 * turned, squares, ones]), np.hstack([turned, ones, squares])
    return left.astype(np.float32), right.astype(np.float32)


def _candidates(turned: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float):
    """Row numbers of pairs within the budget of a block, some at a time; each pair once, too, if both sides are the same."""
    same = np.array_equal(left, right)
    parts = blocks(turned.shape[1], limit_of(cosine))
    sides = [_sides(turned[:, start:end]) for start, end, _ in parts]
    for at in range(0, len(left), TILE):
        some = left[at : at + TILE]
        ahead = [side[0][some] for side in sides]
        for others in (right[i : i + TILE] for i in range(at if same else 0, len(right), TILE)):
            near = np.zeros((len(some), len(others)), dtype=bool)
            for mine, side, part in zip(ahead, sides, parts):
                near |= mine @ side[1][others].T <= np.float32(part[2] + ROUNDING)
            # Over one dimension, as numpy finds places in two dimensions far more slowly.
            found = np.flatnonzero(near)
            for i in range(0, len(found), 16 * TILE):
                a, b = np.divmod(found[i : i + 16 * TILE], len(others))
                a, b = some[a], others[b]
                yield (a[a < b], b[a < b]) if same else (a, b)


def _compare(key: tuple, frame: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links between the rows of two pieces, or inside one: of each row their number and the smallest id reached."""
    vectors = np.stack(frame["vector"].to_numpy()).astype(np.float64)
    ids, members, own = frame["id"].to_numpy(), frame["n"].to_numpy(), frame["own"].to_numpy()
    piece, other = key[2:]
    links, roots = np.zeros(len(frame), dtype=np.int64), np.arange(len(frame))
    joined = Links(len(frame))
    with np.errstate(all="ignore"):
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        turned = _turned(vectors, norms)
        for a, b in _candidates(turned, np.flatnonzero(own == piece), np.flatnonzero(own == other), cosine):
            apart = ids[a] != ids[b]
            a, b = a[apart], b[apart]
            linked = (vectors[a] * vectors[b]).sum(axis=1) / (norms[a] * norms[b]) >= cosine
            a, b = a[linked], b[linked]
            np.add.at(links, a, members[b])
            np.add.at(links, b, members[a])
            # Only pairs that are not yet joined, each pair of roots once.
            ends = np.sort(np.stack([roots[a], roots[b]], axis=1), axis=1)
            ends = np.unique(ends[ends[:, 0] != ends[:, 1]], axis=0)
            for x, y in ends.tolist():
                joined.join(x, y)
            touched, now = np.unique(ends), np.arange(len(frame))
            now[touched] = [joined.root(x) for x in touched.tolist()]
            roots = now[roots]
    smallest = pd.Series(ids).groupby(roots).transform("min").to_numpy()
    out = pd.DataFrame({"id": ids, "links": links, "near": smallest})
    return out[(out["links"] > 0) | (out["near"] != out["id"])]


def near_duplicates(
    vectors: DataFrame,
    cosine: float = COSINE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Links of vectors of equal label whose cosine, in double precision, is at least ``cosine``.

    Columns: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept. One row
    per input row. Rows link with nothing if label or vector is null, or the vector is empty, zero or holds a null or
    a number that isn't finite; vectors of different lengths don't link either. Repeated rows
    count each other as links; different vectors under one id are one node with the links of all. A null id
    is a row by itself. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))

    def mark(frames):
        for frame in frames:
            yield frame.assign(good=usable(frame))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    marked = written(rows.mapInPandas(mark, f"{kinds}, good boolean"), "vectors")
    # A zero of either sign is the same component.
    good = marked.filter("good and id is not null").withColumn("vector", F.transform("vector", lambda v: v + F.lit(0)))
    good = good.withColumn("vector", F.col("vector").cast(rows.schema["vector"].dataType))
    classes = written(_classes(good), "vector-classes")
    id_kind = rows.schema["id"].dataType.simpleString()
    found = _pieces(classes).groupBy("label", "size", "piece", "other").applyInPandas(
        lambda key, frame: _compare(key, frame, cosine), f"id {id_kind}, links bigint, near {id_kind}"
    )
    found = written(found, "vector-links")
    totals = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.filter("id <> near").select(F.col("id").alias("a"), F.col("near").alias("b")))
    known = classes.join(totals, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    known = known.select(
        "label",
        "vector",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    linked = good.select("id", "label", "vector").join(known, ["label", "vector"])
    linked = linked.select(F.col("id").alias("vec_id"), "n_links", "component_id")
    alone = marked.filter("not good or id is null").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
