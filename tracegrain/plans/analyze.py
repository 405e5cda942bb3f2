"""The whole analysis: lines -> templates -> dedup -> features -> scores -> stored table."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.functions.minhash import banding
from tracegrain.operators.dedup import first_wins, with_bands
from tracegrain.operators.features import feature_columns, with_cluster_freq
from tracegrain.operators.forest import CONTAMINATION, score, train_forest
from tracegrain.operators.report import run_report, stage_ledger
from tracegrain.operators.tables import lookup_join, stored
from tracegrain.operators.templates import (
    Mining,
    Model,
    collapsed_table,
    mine_merged,
    with_mask,
)
from tracegrain.sources.scored import stored_bytes, write_scored


@dataclass(frozen=True)
class Analysis:
    """``scored`` has one row per kept line; ``counts`` are the totals for the reports, observed on the way."""

    scored: DataFrame
    model: Model
    counts: dict[str, int]

    def totals(self, **more: int) -> DataFrame:
        values = {name: int(value or 0) for name, value in (self.counts | more).items()}
        spark = self.scored.sparkSession
        return spark.createDataFrame([tuple(values.values())], ", ".join(f"{name} bigint" for name in values))


def analyze(
    lines: DataFrame,
    mining: Mining = Mining(),
    threshold: float = 0.8,
    num_perm: int = 64,
    contamination: float = CONTAMINATION,
    freq_source: str = "deduped",
    online: bool = False,
) -> Analysis:
    """Analyse ``line_no, raw`` rows.

    Dedup compares templates, and of equal templates only the first line can survive. The first line of every masked
    text comes along when lines are collapsed, so they are read once. Dedup and features carry numbers, and the texts that
    are left join them at the end; intermediate tables are dropped as soon as they are read.
    ``freq_source="raw"`` counts the lines of a cluster before instead of after dedup.
    """
    before = collapsed_table(with_mask(lines), mining, with_raw=True)
    # Where masking changed nothing, the masked text stands for the raw one.
    changed = before.df.filter(~F.col("raw").eqNullSafe(F.col("masked")))
    raws = stored(changed.select(F.col("first_line").alias("line_no"), F.xxhash64("masked").alias("_mask"), "raw"), "raw-lines")
    model, merged = mine_merged(before.df.drop("raw"), mining, lazy=True)
    before.drop()
    texts = merged.df.select(F.col("emitted" if online else "template").alias("template"), "masked", "first_line", "leader_line")
    if not online:
        # All lines of a cluster have its template, and its leader is the first of them.
        texts = texts.filter("first_line = leader_line")
    firsts = texts.groupBy("template").agg(
        F.min("first_line").alias("line_no"), F.min_by("leader_line", "first_line").alias("leader_line")
    )
    firsts = firsts.withColumn("_key", F.xxhash64("template"))
    firsts = stored(with_bands(firsts, "template", threshold, num_perm, "leader_line", "_key"), "first-lines")
    unique = firsts.rows
    kept = first_wins(firsts, banding(threshold, num_perm)[0], put=stored)
    left = firsts.df.drop("bands").join(kept.df.select("line_no"), "line_no", "left_semi")
    ids = model.templates.df.groupBy("leader_line").agg(F.min("cluster_id").alias("cluster_id"), F.max("n").alias("cluster_freq"))
    left = left.join(ids if freq_source == "raw" else ids.drop("cluster_freq"), "leader_line").drop("leader_line")
    survivors = stored(left, "survivors")
    firsts.drop()
    kept.drop()
    # Texts move once, to the numbers of the lines that are left.
    numbered = survivors if freq_source == "raw" else stored(with_cluster_freq(survivors.df), "numbered")
    texts = texts.select(F.col("first_line").alias("line_no"), F.xxhash64("template").alias("_key"), "template", "masked")
    rows = lookup_join(texts, numbered, ["line_no", "_key"], "inner").withColumn("_mask", F.xxhash64("masked"))
    others = lookup_join(raws.df, survivors.narrowed("line_no"), ["line_no"], "left_semi").withColumn("_other", F.lit(True))
    rows = rows.join(others, ["line_no", "_mask"], "left")
    raw = F.when(F.col("_other"), F.col("raw")).otherwise(F.col("masked"))
    rows = rows.select("line_no", raw.alias("raw"), "template", "cluster_id", "cluster_freq")
    featured = stored(feature_columns(rows), "featured", {"raw": "template"})
    for used in (raws, survivors, numbered):
        used.drop()
    if featured.rows:
        scored = score(featured.df, train_forest(featured), contamination)
    else:
        scored = featured.df.withColumns(
            {"anomaly_score": F.lit(None).cast("double"), "is_anomaly": F.lit(None).cast("boolean")}
        )
    totals = {"raw_bytes": F.sum(F.octet_length("raw")), "anomalies": F.count_if("is_anomaly")}
    after = stored(scored, "scored", {"raw": "template"}, **totals)
    featured.drop()
    counts = {
        "lines": before.observed["lines"],
        "raw_bytes": before.observed["raw_bytes"],
        "unique_templates": unique,
        "kept": after.rows,
        "kept_raw_bytes": after.observed["raw_bytes"],
        "anomalies": after.observed["anomalies"],
    }
    return Analysis(after.df, model, counts)


@dataclass(frozen=True)
class Run:
    path: str
    analysis: Analysis
    ledger: DataFrame
    report: DataFrame


def run(lines: DataFrame, output_dir: str, **options) -> Run:
    """Analyse, store the result under ``output_dir`` and report."""
    start = time.time()
    analysis = analyze(lines, **options)
    path = write_scored(analysis.scored, output_dir)
    totals = analysis.totals(stored_bytes=stored_bytes(lines.sparkSession, path).first()["stored_bytes"])
    return Run(path, analysis, stage_ledger(totals), run_report(totals, time.time() - start))
