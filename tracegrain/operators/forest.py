"""Isolation forest (Liu, Ting and Zhou, ICDM 2008): deterministic sample, trees in parallel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.functions.text import round_score
from tracegrain.operators.tables import Table, lookup_join, materialize

# Model parameters.
TREES = 100
SAMPLE = 256
CONTAMINATION = 0.05
SEED = 42
EULER = 0.5772156649

# Up to this many distinct scores the built-in percentile holds them in one buffer.
PERCENTILE_ROWS = 1_000_000

_TREE = "tree int, node int, feature int, threshold double, below int, above int, path double, sample int"


def _mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _samples(df: DataFrame, total: int, trees: int, sample: int, seed: int) -> DataFrame:
    """``tree, line_no, features``: ``sample`` rows for every tree, chosen by the order of a hash of tree and row.

    One rule at every size, and the same rows whatever the partitioning: each tree draws for itself from
    all rows. A bound on the hash leaves about three times the rows a tree needs, so that nothing
    but those hits is spread over the trees and ranked.
    """
    span = 2**32
    bound = min(span, math.ceil(span * 3 * sample / max(total, 1)))
    place = lambda tree: F.pmod(F.xxhash64(F.lit(seed), tree, "line_no"), F.lit(span))
    hits = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: place(tree) < bound)
    dealt = df.select("line_no", "features", F.explode(hits).alias("tree")).withColumn("_hash", place(F.col("tree")))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("tree").orderBy("_hash", "line_no")))
    return ranked.filter(F.col("_rank") <= sample).drop("_rank", "_hash")


def _grow(seed: int):
    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("line_no")
        tree = int(rows["tree"].iloc[0])
        points = np.stack(rows["features"].to_numpy()).astype(np.float64)
        rng = np.random.default_rng([seed, tree])
        limit = math.ceil(math.log2(max(len(points), 2)))
        nodes, pending, free = [], [(0, points, 0)], 1
        while pending:
            node, part, depth = pending.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            varying = np.flatnonzero(high > low)
            if depth >= limit or len(part) <= 1 or not len(varying):
                nodes.append((tree, node, -1, 0.0, -1, -1, depth + _mean_path(len(part)), len(points)))
                continue
            feature = int(varying[rng.integers(len(varying))])
            cut = float(rng.uniform(low[feature], high[feature]))
            side = part[:, feature] <= cut
            nodes.append((tree, node, feature, cut, free, free + 1, 0.0, len(points)))
            pending += [(free, part[side], depth + 1), (free + 1, part[~side], depth + 1)]
            free += 2
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in _TREE.split(", ")])

    return grow


def train_forest(rows: Table, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Table:
    """The forest as a table of nodes, at most ``trees * (2 * sample - 1)`` rows."""
    samples = _samples(rows.df, rows.rows, trees, sample, seed)
    return materialize(samples.groupBy("tree").applyInPandas(_grow(seed), _TREE), "forest")


def score_vectors(df: DataFrame, forest: Table, name: str = "score") -> DataFrame:
    """Add minus the isolation score of ``features``: between -1 and 0, lower is more unusual."""
    nodes = forest.df.toPandas()  # bounded by the forest's parameters, not by the data
    if nodes.empty:
        return df.withColumn(name, F.lit(None).cast("double"))
    trees, width = nodes["tree"].max() + 1, nodes["node"].max() + 1
    parts = {}
    for column, empty in (("feature", -1), ("threshold", 0.0), ("below", -1), ("above", -1), ("path", 0.0)):
        table = np.full((trees, width), empty, dtype=nodes[column].dtype)
        table[nodes["tree"], nodes["node"]] = nodes[column]
        parts[column] = table
    parts["scale"] = _mean_path(int(nodes["sample"].max())) or 1.0
    shared = df.sparkSession.sparkContext.broadcast(parts)

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        model = shared.value
        if features.empty:
            return pd.Series([], dtype="float64")
        points = np.stack(features.to_numpy()).astype(np.float64)
        every = np.arange(len(points))
        total = np.zeros(len(points))
        for feature, threshold, below, above, path in zip(
            *(model[c] for c in ("feature", "threshold", "below", "above", "path"))
        ):
            at = np.zeros(len(points), dtype=np.int64)
            while True:
                tested = feature[at]
                inner = tested >= 0
                if not inner.any():
                    break
                goes_below = points[every, np.maximum(tested, 0)] <= threshold[at]
                at = np.where(inner, np.where(goes_below, below[at], above[at]), at)
            total += path[at]
        return pd.Series(-(2.0 ** (-total / len(model["feature"]) / model["scale"])))

    return df.withColumn(name, score("features"))


def _value_at(values: DataFrame, rank: int) -> float:
    """The value at a 0-based rank of ``value, weight`` rows, by narrowing a histogram."""
    span = values.agg(F.min("value").alias("low"), F.max("value").alias("high")).first()
    low, high = span["low"], span["high"]
    while low < high:
        part = values.filter(F.col("value").between(low, high))
        # The rows at either end get buckets of their own, so that every pass narrows the range.
        bucket = (
            F.when(F.col("value") == low, F.lit(-1))
            .when(F.col("value") == high, F.lit(2000))
            .otherwise(F.width_bucket("value", F.lit(low), F.lit(high), F.lit(1000)))
        )
        counts = part.groupBy(bucket.alias("bucket")).agg(
            F.min("value").alias("low"), F.max("value").alias("high"), F.sum("weight").alias("n")
        )
        for row in sorted(counts.collect(), key=lambda r: r["bucket"]):
            if rank < row["n"]:
                low, high = row["low"], row["high"]
                break
            rank -= row["n"]
    return low


def weighted_percentile(values: Table, share: float) -> float | None:
    """Interpolated percentile of ``value, weight`` rows; exact for any number of rows.

    Nulls don't count. Infinities and NaN do, NaN above all other values, as for the built-in function.
    """
    known = values.df.filter(F.col("value").isNotNull())
    if values.rows <= PERCENTILE_ROWS:
        return known.agg(F.percentile("value", F.lit(share), F.col("weight"))).first()[0]
    finite = F.abs("value") < F.lit(math.inf)
    kind = F.when(F.col("value") == -math.inf, 0).when(finite, 1).when(F.isnan("value"), 3).otherwise(2)
    weights = {r["kind"]: r["n"] for r in known.groupBy(kind.alias("kind")).agg(F.sum("weight").alias("n")).collect()}
    total = sum(weights.values())
    if not total:
        return None

    def at(rank: int) -> float:
        for number, value in enumerate((-math.inf, None, math.inf, math.nan)):
            if rank < (n := weights.get(number, 0)):
                return _value_at(known.filter(finite), rank) if value is None else value
            rank -= n
        return math.nan

    position = share * (total - 1)
    rank = math.floor(position)
    low = at(rank)
    high = low if position == rank else at(rank + 1)
    return low if low == high else (rank + 1 - position) * low + (position - rank) * high


def score_threshold(df: DataFrame, score: str, contamination: float = CONTAMINATION) -> float | None:
    """The score below which about ``contamination`` of the rows lie."""
    values = df.groupBy(F.col(score).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("weight"))
    return weighted_percentile(materialize(values, "scores"), contamination)


def flag_by_contamination(df: DataFrame, score: str, contamination: float = CONTAMINATION) -> DataFrame:
    """Flag rows strictly below the threshold; rows on it are normal."""
    threshold = score_threshold(df, score, contamination)
    return df.withColumn("is_anomaly", F.coalesce(F.col(score) < F.lit(threshold), F.lit(False)))


def score(df: DataFrame, forest: Table, contamination: float = CONTAMINATION) -> DataFrame:
    """Add ``anomaly_score`` (negative is suspicious, rounded) and ``is_anomaly`` (before rounding).

    Rows with the same features share one evaluation. Only if there are too many distinct vectors to
    broadcast, every row is evaluated in place.
    """
    vectors = materialize(df.groupBy("features").agg(F.count(F.lit(1)).alias("weight")), "vectors")
    scored = materialize(score_vectors(vectors.df, forest), "scored-vectors")
    offset = weighted_percentile(scored.narrowed(F.col("score").alias("value"), "weight"), contamination)
    if scored.fits_broadcast:
        rows = lookup_join(df, scored.narrowed("features", "score"), ["features"], "left")
    else:
        rows = score_vectors(df, forest)
    distance = F.col("score") - F.lit(offset)
    return rows.withColumns(
        {"anomaly_score": round_score(distance), "is_anomaly": distance < 0}
    ).drop("score")
