"""Registered queries: each over whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracegrain.functions import minhash as mh
from tracegrain.functions import text as tx
from tracegrain.operators import dedup, explore, features, forest, numbering, report, search_index, sketches
from tracegrain.operators import templates as tm
from tracegrain.operators.tables import Table, lookup_join, materialize, new_path
from tracegrain.plans.analyze import analyze, run
from tracegrain.plans.inputs import (
    HOUR_SQL,
    LEVEL_SQL,
    NAME_SQL,
    WORDS,
    clustered,
    kept_ctes,
    log_lines,
    scored,
    signature_ctes,
    table,
    templated,
    text_lines,
    with_ctes,
)
from tracegrain.sources import logs
from tracegrain.sources import scored as stored
from tracegrain.streaming.dedup import dedup_stream
from tracegrain.streaming.logs import stream_log_lines
from tracegrain.streaming.templates import stream_templates

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- sources, sinks and layout -------------------------------------------------------------------


@query("read_log_lines", with_ctes("select row_number() over (order by line_no) - 1 as line_no, raw from log", "log"))
def _(spark, sf):
    path = new_path(spark, "log-text")
    log_lines(spark, sf).orderBy("line_no").select("raw").write.text(path)
    return logs.read_log_lines(spark, path)


@query(
    "read_uploaded_text",
    with_ctes(
        """select line_no, case when line_no = 0 then ltrim(raw) when line_no = total - 1 then rtrim(raw) else raw end as raw
from (select row_number() over (order by line_no) - 1 as line_no, raw, count(*) over () as total from lines)""",
        "lines",
    ),
)
def _(spark, sf):
    path = new_path(spark, "document-text")
    text_lines(spark, sf).orderBy("line_no").select("raw").write.text(path)
    return logs.read_uploaded_text(spark, path)


@query("require_valid_utf8", with_ctes("select line_no, raw, true as is_valid from lines", "lines"))
def _(spark, sf):
    return logs.mark_valid_utf8(logs.require_valid_utf8(text_lines(spark, sf)))


@query("assign_chunks", with_ctes("select line_no, line_no // 500 as chunk_id from log", "log"))
def _(spark, sf):
    return numbering.assign_chunks(log_lines(spark, sf)).select("line_no", "chunk_id")


@query("line_count", with_ctes("select count(*) as lines from lines", "lines"))
def _(spark, sf):
    return report.line_count(text_lines(spark, sf))


@query(
    "raw_bytes",
    with_ctes("select cast(sum(strlen(raw)) + greatest(count(*) - 1, 0) as bigint) as raw_bytes from lines", "lines"),
)
def _(spark, sf):
    return report.raw_bytes(text_lines(spark, sf))


_CONFORMED = """select raw, template, cluster_id, cast(anomaly_score as float) as anomaly_score, is_anomaly,
  cast(log_level as tinyint) as log_level from scored"""


@query("conform_scored", with_ctes(_CONFORMED.replace("log_level as", "1 as"), "scored"))
def _(spark, sf):
    """Without features every row takes the default level."""
    return stored.conform_scored(scored(spark, sf))


@query("conform_column_level", with_ctes(_CONFORMED, "scored"))
def _(spark, sf):
    return stored.conform_scored(scored(spark, sf), level_from_column=True)


@query(
    "conform_defaults",
    with_ctes(
        """select raw, '' as template, cast(-1 as integer) as cluster_id, cast(0 as float) as anomaly_score,
  false as is_anomaly, cast(1 as tinyint) as log_level from lines""",
        "lines",
    ),
)
def _(spark, sf):
    return stored.conform_scored(text_lines(spark, sf))


@query("stored_round_trip", with_ctes(_CONFORMED, "scored"))
def _(spark, sf):
    return stored.read_scored(spark, stored.write_scored(scored(spark, sf), new_path(spark, "stored"), True))


@query("stored_bytes")
def _(spark, sf):
    return stored.stored_bytes(spark, stored.write_scored(scored(spark, sf), new_path(spark, "stored")))


@query("compression_ratio")
def _(spark, sf):
    rows = scored(spark, sf)
    size = stored.stored_bytes(spark, stored.write_scored(rows, new_path(spark, "stored")))
    totals = report.one_row(raw=(report.raw_bytes(rows), "raw_bytes"), kept=(size, "stored_bytes"))
    return totals.select(
        "raw",
        "kept",
        report.compression_ratio(F.col("raw"), F.col("kept")).alias("ratio"),
        report.saved_pct(F.col("raw"), F.col("kept")).alias("saved_pct"),
    )


@query(
    "compression_parts",
    with_ctes(
        "select cast(sum(strlen(raw)) + count(*) - 1 as bigint) as raw, true as smaller, true as ratio_fits, true as saving_fits from scored",
        "scored",
    ),
)
def _(spark, sf):
    """The raw size, and that the figures of the stored table follow from it and from the files."""
    rows = scored(spark, sf)
    size = stored.stored_bytes(spark, stored.write_scored(rows, new_path(spark, "stored")))
    totals = report.one_row(raw=(report.raw_bytes(rows), "raw_bytes"), kept=(size, "stored_bytes"))
    raw, kept = F.col("raw"), F.col("kept")
    return totals.select(
        "raw",
        (kept.between(1, raw)).alias("smaller"),
        (F.abs(report.compression_ratio(raw, kept) - raw / kept) <= 0.005001).alias("ratio_fits"),
        (F.abs(report.saved_pct(raw, kept) - (raw - kept) * 100 / raw) <= 0.05001).alias("saving_fits"),
    )


# --- scalar functions ----------------------------------------------------------------------------


@query("mask", with_ctes("select line_no, masked from masked_log", "masked_log"))
def _(spark, sf):
    return tm.with_mask(log_lines(spark, sf)).select("line_no", "masked")


@query(
    "tokens",
    with_ctes(f"select line_no, array_to_string({WORDS.format('lower(raw)')}, '|') as tokens from lines", "lines"),
)
def _(spark, sf):
    return text_lines(spark, sf).select("line_no", F.array_join(tx.tokens("raw", lower=True), "|").alias("tokens"))


@query("extract_level", with_ctes(f"select line_no, {LEVEL_SQL} as level from log", "log"))
def _(spark, sf):
    return log_lines(spark, sf).select("line_no", tx.extract_level("raw").alias("level"))


@query("extract_hour", with_ctes(f"select line_no, {HOUR_SQL} as hour from log", "log"))
def _(spark, sf):
    return log_lines(spark, sf).select("line_no", tx.extract_hour("raw").alias("hour"))


@query(
    "template_length",
    with_ctes(f"select line_no, cast(len({WORDS.format('template')}) as integer) as words from templated", "templated"),
)
def _(spark, sf):
    return templated(spark, sf).select("line_no", tx.word_count("template").alias("words"))


_FEATURES = f"""select line_no, {LEVEL_SQL} as log_level, count(*) over (partition by cluster_id) as cluster_freq,
  {HOUR_SQL} as hour, cast(len({WORDS.format('template')}) as integer) as template_length from clustered"""


@query("build_features", with_ctes(_FEATURES, "clustered"))
def _(spark, sf):
    rows = features.build_features(clustered(spark, sf))
    return rows.select("line_no", "log_level", "cluster_freq", "hour", "template_length")


@query(
    "feature_vector",
    with_ctes(
        f"""select line_no, concat(log_level, ',', cluster_freq, ',', hour, ',', template_length) as features
from ({_FEATURES})""",
        "clustered",
    ),
)
def _(spark, sf):
    rows = features.build_features(clustered(spark, sf))
    return rows.select("line_no", F.array_join(F.col("features").cast("array<string>"), ",").alias("features"))


@query(
    "level_name",
    with_ctes(f"select line_no, {NAME_SQL} as level from (select line_no, {LEVEL_SQL} as log_level from log)", "log"),
)
def _(spark, sf):
    return log_lines(spark, sf).select("line_no", tx.level_name(tx.extract_level("raw")).alias("level"))


@query("is_severe", with_ctes("select line_no, log_level in (3, 4) as is_severe from scored", "scored"))
def _(spark, sf):
    return scored(spark, sf).select("line_no", tx.is_severe("log_level").alias("is_severe"))


@query(
    "severity_pct",
    with_ctes(
        """select line_no, least(abs(anomaly_score) * 100, 100.0) as severity_pct,
  abs(anomaly_score) > 0.5 as is_highlighted from scored""",
        "scored",
    ),
)
def _(spark, sf):
    return scored(spark, sf).select(
        "line_no",
        tx.severity_pct("anomaly_score").alias("severity_pct"),
        tx.is_highlighted("anomaly_score").alias("is_highlighted"),
    )


@query(
    "snippet",
    with_ctes(
        """select line_no, substr(raw, 1, 55) as explore, substr(raw, 1, 65) as anomaly, substr(raw, 1, 80) as summary,
  case when length(raw) > 70 then concat(substr(raw, 1, 70), '…') else raw end as label from lines""",
        "lines",
    ),
)
def _(spark, sf):
    return text_lines(spark, sf).select(
        "line_no",
        tx.snippet("raw", 55).alias("explore"),
        tx.snippet("raw", 65).alias("anomaly"),
        tx.snippet("raw", 80).alias("summary"),
        tx.snippet("raw", 70, "…").alias("label"),
    )


@query("round_score", "select event_id as line_no, round(value / 7.0::double, 4) as score from events")
def _(spark, sf):
    events = table(spark, sf, "events")
    return events.select(F.col("event_id").alias("line_no"), tx.round_score(F.col("value") / 7.0).alias("score"))


@query(
    "extract_parameters",
    with_ctes(
        f"""select line_no, array_to_string(list_transform(list_filter(list_zip({WORDS.format('masked')},
  {WORDS.format('template')}), lambda p: p[2] = '<*>'), lambda p: p[1]), '|') as parameters from templated""",
        "templated",
    ),
)
def _(spark, sf):
    found = F.array_join(tx.extract_parameters("masked", "template"), "|")
    return templated(spark, sf).select("line_no", found.alias("parameters"))


# --- template mining -----------------------------------------------------------------------------


@query(
    "collapse_masked",
    with_ctes(
        """select masked, min(line_no) as first_line, count(*) as n, cast(sum(strlen(raw)) as bigint) as raw_bytes
from masked_log group by masked""",
        "masked_log",
    ),
)
def _(spark, sf):
    return tm.collapse_masked(tm.with_mask(log_lines(spark, sf)))


@query(
    "leaf_key",
    with_ctes(
        f"""select leaf, count(*) as lines from (select concat_ws(' ', len(w)::varchar,
  case when len(w) > 1 then case when regexp_matches(w[1], '[0-9]') then '<*>' else w[1] end end) as leaf
  from (select {WORDS.format('raw')} as w from lines)) group by leaf""",
        "lines",
    ),
)
def _(spark, sf):
    leaves = text_lines(spark, sf).groupBy(tm.leaf_key("raw").alias("leaf"))
    return leaves.agg(F.count(F.lit(1)).alias("lines"))


_CLUSTERS = with_ctes("select template, n, first_line, cluster_id from clusters", "clusters")


@query("mine_templates", _CLUSTERS)
def _(spark, sf):
    model = tm.mine_templates(tm.with_mask(log_lines(spark, sf)))
    return model.templates.df.select("template", "n", "first_line", "cluster_id")


@query("mine_document_templates")
def _(spark, sf):
    model = tm.mine_templates(tm.with_mask(text_lines(spark, sf)))
    return model.templates.df.select("template", "n", "first_line", "cluster_id")


_ASSIGNED = with_ctes("select line_no, raw, template, cluster_id from clustered", "clustered")


@query("assign_templates", _ASSIGNED)
def _(spark, sf):
    rows = tm.with_mask(log_lines(spark, sf))
    return tm.assign_templates(rows, tm.mine_templates(rows)).select("line_no", "raw", "template", "cluster_id")


@query("fast_templates", with_ctes("select template, n from firsts", "firsts"))
def _(spark, sf):
    return templated(spark, sf).groupBy("template").agg(F.count(F.lit(1)).alias("n"))


@query("unique_templates", with_ctes("select count(distinct template) as unique_templates from templated", "templated"))
def _(spark, sf):
    return tm.unique_templates(templated(spark, sf))


@query(
    "unique_templates_by_chunk",
    with_ctes(
        """select line_no // 500 as chunk_id, count(distinct template) as unique_templates
from templated group by line_no // 500""",
        "templated",
    ),
)
def _(spark, sf):
    return tm.unique_templates(numbering.assign_chunks(templated(spark, sf)), "chunk_id")


@query(
    "template_sketches",
    with_ctes(
        """select line_no // 500 % 8 as part, count(distinct template) as unique_templates, true as within_5_pct
from templated group by line_no // 500 % 8""",
        "templated",
    ),
)
def _(spark, sf):
    """Distinct templates from sketches per chunk, merged over every eighth chunk, next to the exact numbers."""
    rows = materialize(numbering.assign_chunks(templated(spark, sf)), "chunks").df
    part = (F.col("chunk_id") % 8).alias("part")
    merged = sketches.merged_templates(materialize(sketches.template_sketches(rows, "chunk_id"), "sketches").df, part)
    exact = tm.unique_templates(rows.withColumn("part", part), "part")
    near = F.abs(F.col("estimate") - F.col("unique_templates")) <= 0.05 * F.col("unique_templates")
    both = exact.join(merged.withColumnRenamed("unique_templates", "estimate"), "part")
    return both.select("part", "unique_templates", near.alias("within_5_pct"))


def _halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    middle = rows.agg(F.floor(F.avg("line_no")).alias("m")).first()["m"]
    return rows.filter(F.col("line_no") <= middle), rows.filter(F.col("line_no") > middle)


@query("match_templates", _CLUSTERS)
def _(spark, sf):
    first, second = _halves(tm.with_mask(log_lines(spark, sf)))
    _, model = tm.match_templates(second, tm.mine_templates(first))
    return model.templates.df.select("template", "n", "first_line", "cluster_id")


def _in_two_batches(spark: SparkSession, lines: DataFrame, start: Callable[[DataFrame], object]) -> None:
    """Runs a stream over the first half of the lines, and starts it again when the second half has come."""
    path = new_path(spark, "stream-source")
    for part in _halves(lines):
        part.write.mode("append").parquet(path)
        source = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1_000_000).parquet(path)
        start(source).awaitTermination()


@query("stream_templates", _ASSIGNED)
def _(spark, sf):
    out, state, check = (new_path(spark, name) for name in ("stream-out", "stream-state", "stream-check"))
    _in_two_batches(spark, log_lines(spark, sf), lambda source: stream_templates(source, state, out, check))
    return spark.read.parquet(out).select("line_no", "raw", "template", "cluster_id")


@query(
    "stream_log_lines",
    with_ctes("select row_number() over (order by line_no) - 1 as line_no, raw from log", "log"),
)
def _(spark, sf):
    """Text files that come in two lots, numbered on from where the first ended."""
    path, out, state, check = (new_path(spark, name) for name in ("stream-text", "stream-out", "stream-state", "stream-check"))

    def store(lines: DataFrame, batch_id: int) -> None:
        lines.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    for part in _halves(log_lines(spark, sf)):
        part.orderBy("line_no").select("raw").write.mode("append").text(path)
        stream_log_lines(spark, path, state, check, store, 1_000_000).awaitTermination()
    return spark.read.parquet(out).select("line_no", "raw")


# --- aggregations and reports --------------------------------------------------------------------


@query(
    "cluster_freq",
    with_ctes("select line_no, count(*) over (partition by cluster_id) as cluster_freq from clustered", "clustered"),
)
def _(spark, sf):
    return features.with_cluster_freq(clustered(spark, sf)).select("line_no", "cluster_freq")


@query(
    "level_distribution",
    with_ctes(
        """select code, level, coalesce(n, 0) as n,
  greatest(coalesce(n, 0) / max(coalesce(n, 0)) over () * 100, 2.0) as bar_pct
from (values (0, 'DEBUG'), (1, 'INFO'), (2, 'WARNING'), (3, 'ERROR'), (4, 'CRITICAL')) as names(code, level)
left join (select log_level as code, count(*) as n from scored group by log_level) using (code)""",
        "scored",
    ),
)
def _(spark, sf):
    return report.level_distribution(scored(spark, sf))


@query(
    "top_templates",
    with_ctes(
        """, top as (select template, n, (select cast(sum(n) as bigint) from firsts) as rows from firsts
  order by n desc, template limit 5)
select template, case when length(template) > 70 then concat(substr(template, 1, 70), '…') else template end as label,
  n, n / cast(sum(n) over () as bigint) * 100 as share_of_top, n / rows * 100 as share_of_all,
  greatest(n / max(n) over () * 100, 3.0) as bar_pct from top""",
        "firsts",
    ).replace("\n, top", ", top"),
)
def _(spark, sf):
    return report.top_templates(templated(spark, sf))


@query(
    "anomaly_summary",
    with_ctes(
        """select count(*) as total, count_if(is_anomaly)::bigint as anomalies,
  case when count(*) > 0 then count_if(is_anomaly) * 100.0::double / count(*) else 0 end as anomaly_pct from scored""",
        "scored",
    ),
)
def _(spark, sf):
    return report.anomaly_summary(scored(spark, sf))


@query(
    "dedup_reduction",
    with_ctes(
        """select total, kept, round((1 - kept / total) * 100, 2) as reduction_pct from (select count(*) as total,
  count(distinct array_to_string(list_sort(list_distinct(regexp_extract_all(lower(raw), '\\S+'))), ' ')) as kept
  from lines)""",
        "lines",
    ),
)
def _(spark, sf):
    lines = text_lines(spark, sf)
    counts = report.one_row(
        total=(report.line_count(lines), "lines"), kept=(report.line_count(dedup.dedup_exact(lines, "raw")), "lines")
    )
    return counts.withColumn("reduction_pct", report.dedup_reduction(F.col("total"), F.col("kept")))


@query(
    "chunk_stats",
    with_ctes(
        """select line_no // 500 as chunk_id, count(*) as lines, count(distinct template) as unique_templates,
  count_if(first)::bigint as kept, (count(*) - count_if(first))::bigint as removed
from (select *, line_no = min(line_no) over (partition by template) as first from templated) group by line_no // 500""",
        "templated",
    ),
)
def _(spark, sf):
    rows = templated(spark, sf)
    kept = Table(dedup.find_kept(rows).df.select("line_no", F.lit(True).alias("kept")))
    marked = lookup_join(rows, kept, ["line_no"]).withColumn("kept", F.coalesce("kept", F.lit(False)))
    return report.chunk_stats(numbering.assign_chunks(marked))


@query(
    "score_histogram",
    with_ctes(
        """, span as (select least(min(anomaly_score), -0.5::double) as lo, greatest(max(anomaly_score), 0.5::double) as hi
  from scored),
binned as (select least(cast(floor((anomaly_score - lo) * 14 / (hi - lo)) as integer) + 1, 14) as bin, is_anomaly
  from scored, span)
select g.bin, (lo + (g.bin - 1) * ((hi - lo) / 14)) as bin_low, coalesce(count_if(is_anomaly = false), 0)::bigint as normal,
  coalesce(count_if(is_anomaly), 0)::bigint as flagged
from (select cast(range as integer) as bin from range(1, 15)) g cross join span left join binned b on b.bin = g.bin
group by g.bin, lo, hi""",
        "scored",
    ).replace("\n, span", ", span"),
)
def _(spark, sf):
    return report.score_histogram(scored(spark, sf))


_RATES = """select tp, fp, fn, round(p, 4) as precision, round(r, 4) as recall,
  round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 4) as f1 from (select *,
  case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as p,
  case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as r from (select
  count_if(t = 1 and p = 1)::bigint as tp, count_if(t = 0 and p = 1)::bigint as fp,
  count_if(t = 1 and p = 0)::bigint as fn from pairs))"""


@query("classification_metrics", "with pairs as (select quality as t, toxic as p from labels) " + _RATES)
def _(spark, sf):
    labels = table(spark, sf, "labels")
    return report.classification_metrics(labels, labels, "doc_id", "quality", "toxic")


@query(
    "classification_metrics_lines",
    with_ctes(
        f""", pairs as (select case when event_type = 'error' then 1 else 0 end as t,
  case when {LEVEL_SQL} = 4 then 1 else 0 end as p from log) {_RATES}""",
        "log",
    ).replace("\n, pairs", ", pairs"),
)
def _(spark, sf):
    rows = log_lines(spark, sf, "event_type")
    truth = (F.col("event_type") == "error").cast("int")
    return report.row_metrics(rows, truth, (tx.extract_level("raw") == 4).cast("int"))


@query("cluster_ids", with_ctes("select distinct cast(cluster_id as varchar) as cluster_id from clustered", "clustered"))
def _(spark, sf):
    return explore.cluster_ids(clustered(spark, sf))


_COUNTS = """with stages as (select (select count(*) from log) as lines, (select count(*) from firsts) as kept,
  (select cast(sum(strlen(raw)) as bigint) from log) as bytes,
  (select cast(sum(strlen(raw)) as bigint) from log join firsts on line_no = first_line) as kept_bytes)
select 1 as stage, lines as lines_in, lines as lines_out, null::bigint as unique_templates,
  null::bigint as entries_removed, 0.0::double as reduction_pct, bytes + lines - 1 as size_after_bytes from stages
union all select 2, lines, lines, kept, null, 0.0, null from stages
union all select 3, lines, kept, null, lines - kept, round((1 - kept / lines) * 100, 1), kept_bytes + kept - 1 from stages
union all select 4, kept, kept, null, null, 0.0, null from stages
union all select 5, kept, kept, null, null, null, null from stages"""


@query("stage_counts", with_ctes(_COUNTS, "firsts").replace("\nwith stages", ", stages"))
def _(spark, sf):
    """The part of the ledger that does not depend on scores and file sizes."""
    ledger = run(log_lines(spark, sf), new_path(spark, "stored")).ledger
    sized = lambda name: F.when(F.col("stage") < 5, F.col(name)).alias(name)
    counts = "stage", "lines_in", "lines_out", "unique_templates", "entries_removed"
    return ledger.select(*counts, sized("reduction_pct"), sized("size_after_bytes"))


@query(
    "report_counts",
    with_ctes(
        """select lines, kept as total_records, size as raw_size_bytes, round(size / 1048576, 4) as raw_size_mb,
  round((1 - kept / lines) * 100, 1) as dedup_reduction_pct
from (select (select count(*) from log) as lines, (select count(*) from firsts) as kept,
  (select cast(sum(strlen(raw)) as bigint) + count(*) - 1 from log) as size)""",
        "firsts",
    ),
)
def _(spark, sf):
    """The part of the run report that does not depend on scores and file sizes."""
    report_row = run(log_lines(spark, sf), new_path(spark, "stored")).report
    return report_row.select("lines", "total_records", "raw_size_bytes", "raw_size_mb", "dedup_reduction_pct")


@query("stage_ledger")
def _(spark, sf):
    return run(log_lines(spark, sf), new_path(spark, "stored")).ledger


@query("run_report")
def _(spark, sf):
    return run(text_lines(spark, sf), new_path(spark, "stored")).report


# --- near-duplicates -----------------------------------------------------------------------------


@query(
    "minhash",
    signature_ctes(64)
    + " select line_no, string_agg(m::varchar, ',' order by k) as signature from sig group by line_no",
)
def _(spark, sf):
    signature = F.array_join(mh.minhash("raw").cast("array<string>"), ",")
    return text_lines(spark, sf).select("line_no", signature.alias("signature"))


@query(
    "jaccard_estimate",
    signature_ctes(64)
    + """ select a.line_no, count_if(a.m = b.m) / 64::double as similarity
from sig a join sig b on b.line_no = (a.line_no >> 32) << 32 and b.k = a.k group by a.line_no""",
)
def _(spark, sf):
    """Every line against the first line of its document."""
    document = F.shiftright("line_no", 32)
    signed = text_lines(spark, sf).select("line_no", document.alias("doc"), mh.minhash("raw").alias("a"))
    signed = materialize(signed, "signatures").df
    sizes = signed.groupBy("doc").agg(F.count(F.lit(1)).alias("_n"))
    opening = signed.filter(F.col("line_no") == F.shiftleft("doc", 32)).select("doc", F.col("a").alias("b"))
    pairs = lookup_join(signed, materialize(opening.join(sizes, "doc"), "first-lines"), ["doc"], "inner", "_n")
    return pairs.select("line_no", mh.jaccard_estimate("a", "b").alias("similarity"))


@query("lsh_bands", kept_ctes() + " select line_no, cast(band as integer) as band, key from bands")
def _(spark, sf):
    bands, rows = mh.banding(0.8, 64)
    signed = text_lines(spark, sf).select("line_no", mh.minhash("raw", 64, bands * rows).alias("s"))
    return signed.select("line_no", F.posexplode(mh.band_keys("s", bands, rows)).alias("band", "key"))


@query(
    "near_dup_pairs",
    kept_ctes()
    + """ select distinct a.line_no as lo, b.line_no as hi from bands a join kept using (line_no)
join bands b on a.band = b.band and a.key = b.key and a.line_no < b.line_no""",
)
def _(spark, sf):
    return dedup.near_dup_pairs(text_lines(spark, sf), "raw")


@query(
    "near_dup_pairs_verified",
    kept_ctes()
    + """, sets as (select line_no, list_distinct(regexp_extract_all(lower(raw), '\\S+')) as ws from lines),
found as (select distinct a.line_no as lo, b.line_no as hi from bands a join kept using (line_no)
  join bands b on a.band = b.band and a.key = b.key and a.line_no < b.line_no)
select lo, hi from found join sets a on a.line_no = lo join sets b on b.line_no = hi
where len(list_intersect(a.ws, b.ws)) >= 0.8::double * len(list_distinct(list_concat(a.ws, b.ws)))""",
)
def _(spark, sf):
    return dedup.near_dup_pairs(text_lines(spark, sf), "raw", verify=True)


_KEPT = kept_ctes() + " select line_no, raw from lines join kept using (line_no)"


@query("dedup_first_wins", _KEPT)
def _(spark, sf):
    return dedup.dedup_first_wins(text_lines(spark, sf), "raw")


@query(
    "dedup_exact",
    with_ctes(
        """select min(line_no) as line_no, arg_min(raw, line_no) as raw from lines
group by array_to_string(list_sort(list_distinct(regexp_extract_all(lower(raw), '\\S+'))), ' ')""",
        "lines",
    ),
)
def _(spark, sf):
    return dedup.dedup_exact(text_lines(spark, sf), "raw")


@query("dedup_incremental", _KEPT)
def _(spark, sf):
    first, second = _halves(text_lines(spark, sf))
    kept = dedup.find_kept(first, "raw")
    early = dedup.keep_lines(first, kept.lines())
    late, _ = dedup.dedup_incremental(second, kept.bands(), "raw")
    return early.unionByName(late)


@query("dedup_stream", _KEPT)
def _(spark, sf):
    out, state, check = (new_path(spark, name) for name in ("stream-out", "stream-state", "stream-check"))
    _in_two_batches(spark, text_lines(spark, sf), lambda source: dedup_stream(source, state, out, check, text="raw"))
    return spark.read.parquet(out).select("line_no", "raw")


# --- filters, search and top-k -------------------------------------------------------------------

_ROWS = "select line_no, raw, template, cluster_id, anomaly_score, is_anomaly, log_level from scored"


@query("flagged", with_ctes(f"{_ROWS} where is_anomaly", "scored"))
def _(spark, sf):
    return explore.flagged(scored(spark, sf))


@query("normal", with_ctes(f"{_ROWS} where not is_anomaly", "scored"))
def _(spark, sf):
    return explore.normal(scored(spark, sf))


@query("by_level", with_ctes(f"{_ROWS} where {NAME_SQL} = 'ERROR'", "scored"))
def _(spark, sf):
    return explore.by_level(scored(spark, sf), "ERROR")


@query("by_cluster", with_ctes(f"{_ROWS} where cluster_id = 3", "scored"))
def _(spark, sf):
    return explore.by_cluster(scored(spark, sf), 3)


@query(
    "search",
    with_ctes(
        f"{_ROWS} where regexp_matches(raw, 'stuck|GUEST_1[0-4]\\b', 'i') or regexp_matches(template, 'stuck|GUEST_1[0-4]\\b', 'i')",
        "scored",
    ),
)
def _(spark, sf):
    return explore.search(scored(spark, sf), r"stuck|GUEST_1[0-4]\b")


@query("search_literal", with_ctes(f"{_ROWS} where contains(lower(raw), 'guest_4') or contains(lower(template), 'guest_4')", "scored"))
def _(spark, sf):
    return explore.search(scored(spark, sf), "Guest_4", literal=True)


_STORED_ROWS = """select line_no, raw, template, cluster_id, cast(anomaly_score as float) as anomaly_score, is_anomaly,
  cast(log_level as tinyint) as log_level from scored"""


def _indexed(spark: SparkSession, sf: str, text: str, literal: bool = False) -> DataFrame:
    path = stored.write_scored(scored(spark, sf), new_path(spark, "stored"), True, keep_line_no=True)
    index = new_path(spark, "search-index")
    search_index.build_index(spark, path, index)
    return search_index.search_stored(spark, path, index, text, literal).rows


@query(
    "search_indexed",
    with_ctes(
        f"""{_STORED_ROWS} where regexp_matches(raw, 'guest_1[0-4]\\b|sensor says 4\\d+%', 'i')
  or regexp_matches(template, 'guest_1[0-4]\\b|sensor says 4\\d+%', 'i')""",
        "scored",
    ),
)
def _(spark, sf):
    return _indexed(spark, sf, r"guest_1[0-4]\b|sensor says 4\d+%")


@query(
    "search_indexed_literal",
    with_ctes(f"{_STORED_ROWS} where contains(lower(raw), 'guest_4') or contains(lower(template), 'guest_4')", "scored"),
)
def _(spark, sf):
    return _indexed(spark, sf, "Guest_4", literal=True)


_EXPLORE = """ where log_level = 2 and not is_anomaly and (regexp_matches(raw, 'late', 'i')
  or regexp_matches(template, 'late', 'i'))"""


def _view(spark: SparkSession, sf: str) -> DataFrame:
    return explore.explore(scored(spark, sf), level="WARNING", status="Normal", text="late")


@query("explore", with_ctes(_ROWS + _EXPLORE, "scored"))
def _(spark, sf):
    return _view(spark, sf)


@query("filtered_count", with_ctes("select count(*) as rows from scored" + _EXPLORE, "scored"))
def _(spark, sf):
    return explore.filtered_count(_view(spark, sf))


@query("most_anomalous", with_ctes(f"{_ROWS} where is_anomaly order by anomaly_score, line_no limit 5", "scored"))
def _(spark, sf):
    return explore.most_anomalous(scored(spark, sf))


@query(
    "flagged_preview",
    with_ctes(
        f"""select line_no, substr(raw, 1, 65) as message, substr(template, 1, 30) as template,
  abs(anomaly_score) as severity, least(abs(anomaly_score) * 100, 100.0) as severity_pct,
  {NAME_SQL} as level, log_level in (3, 4) as is_severe
from (select * from scored where is_anomaly order by anomaly_score desc, line_no limit 8)""",
        "scored",
    ),
)
def _(spark, sf):
    return explore.anomaly_rows(explore.flagged_preview(scored(spark, sf)))


@query(
    "first_rows",
    with_ctes(
        f"""select line_no, substr(raw, 1, 55) as message, {NAME_SQL} as level, cluster_id, anomaly_score,
  log_level in (3, 4) as is_severe, abs(anomaly_score) > 0.5 as is_highlighted
from (select * from scored {_EXPLORE} order by line_no limit 15)""",
        "scored",
    ),
)
def _(spark, sf):
    return explore.explore_rows(explore.first_rows(_view(spark, sf)))


@query("detail_row", with_ctes(f"{_ROWS} {_EXPLORE} order by line_no limit 1", "scored"))
def _(spark, sf):
    return explore.detail_row(_view(spark, sf))


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """The stand-in table written in line order and read back."""
    path = stored.write_scored(scored(spark, sf), new_path(spark, "stored"), True, keep_line_no=True)
    return stored.read_scored(spark, path, numbered=True)


_STORED_SCORE = "cast(anomaly_score as float) as anomaly_score"


@query(
    "stored_first_rows",
    with_ctes(
        f"""select line_no, substr(raw, 1, 55) as message, {NAME_SQL} as level, cluster_id, {_STORED_SCORE},
  log_level in (3, 4) as is_severe, abs(cast(anomaly_score as float)) > 0.5 as is_highlighted
from (select * from scored order by line_no limit 15)""",
        "scored",
    ),
)
def _(spark, sf):
    return explore.explore_rows(explore.first_rows(_stored(spark, sf)))


@query(
    "stored_flagged_preview",
    with_ctes(
        f"""select line_no, raw, template, cluster_id, {_STORED_SCORE}, is_anomaly, cast(log_level as tinyint) as log_level
from scored where is_anomaly order by cast(anomaly_score as float) desc, line_no limit 8""",
        "scored",
    ),
)
def _(spark, sf):
    return explore.flagged_preview(_stored(spark, sf))


@query(
    "stored_explore",
    with_ctes(
        f"""select line_no, raw, template, cluster_id, {_STORED_SCORE}, is_anomaly, cast(log_level as tinyint) as log_level
from scored {_EXPLORE}""",
        "scored",
    ),
)
def _(spark, sf):
    return explore.explore(_stored(spark, sf), level="WARNING", status="Normal", text="late")


# --- anomaly model -------------------------------------------------------------------------------


def _featured(spark: SparkSession, sf: str) -> Table:
    return materialize(features.build_features(clustered(spark, sf)), "featured")


@query("train_forest")
def _(spark, sf):
    return forest.train_forest(_featured(spark, sf)).df


@query("score")
def _(spark, sf):
    rows = _featured(spark, sf)
    return forest.score(rows.df, forest.train_forest(rows)).select("line_no", "anomaly_score", "is_anomaly")


@query("forest_shape", with_ctes("select 100::bigint as trees, least(256, count(*))::integer as sample, true as binary from log", "log"))
def _(spark, sf):
    """What holds for every forest: its trees, their samples, and that an inner node has two children."""
    nodes = forest.train_forest(_featured(spark, sf)).df
    inner = F.col("feature") >= 0
    trees = nodes.groupBy("tree").agg(F.max("sample").alias("sample"), F.count_if(inner).alias("inner"), F.count_if(~inner).alias("leaves"))
    sample = F.when(F.min("sample") == F.max("sample"), F.max("sample")).alias("sample")
    return trees.agg(F.count(F.lit(1)).alias("trees"), sample, F.bool_and(F.col("leaves") == F.col("inner") + 1).alias("binary"))


@query(
    "score_rules",
    with_ctes("select count(*) as rows, true as one_score_per_vector, true as in_range, true as flags_follow, true as few_flags from log", "log"),
)
def _(spark, sf):
    """What holds for every scoring: equal features score equally, flags lie below zero, at most their share is flagged."""
    rows = _featured(spark, sf)
    scored_rows = forest.score(rows.df, forest.train_forest(rows))
    score, flag = F.col("anomaly_score"), F.col("is_anomaly")
    vectors = scored_rows.groupBy("features").agg(
        F.count(F.lit(1)).alias("n"), F.min(score).alias("low"), F.max(score).alias("high"), F.count_if(flag).alias("flagged"),
        F.bool_and(F.when(flag, score <= 0).otherwise(score >= 0)).alias("follows"),
    )
    return vectors.agg(
        F.sum("n").alias("rows"),
        F.bool_and(F.col("low") == F.col("high")).alias("one_score_per_vector"),
        ((F.min("low") >= -1) & (F.max("high") <= 1)).alias("in_range"),
        F.bool_and("follows").alias("flags_follow"),
        (F.sum("flagged") <= forest.CONTAMINATION * F.sum("n") + 1).alias("few_flags"),
    )


@query(
    "flag_by_contamination",
    """select event_id as line_no, value < (select quantile_cont(value, 0.05) from events) as is_anomaly from events""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("line_no"), "value")
    return forest.flag_by_contamination(rows, "value").select("line_no", "is_anomaly")


_SCORED = ["line_no", "raw", "template", "cluster_id", "log_level", "anomaly_score", "is_anomaly"]


@query("analyze_log")
def _(spark, sf):
    return analyze(log_lines(spark, sf)).scored.select(_SCORED)


@query(
    "analyze_log_kept",
    with_ctes(
        f"""select line_no, raw, template, cluster_id, {LEVEL_SQL} as log_level
from clustered join firsts using (template) where line_no = first_line""",
        "clustered",
        "firsts",
    ),
)
def _(spark, sf):
    """The kept lines of the analysis, without their scores."""
    return analyze(log_lines(spark, sf)).scored.select(_SCORED[:5])


@query(
    "upload_to_lists",
    with_ctes(
        f"""select 'explore' as list, cast(row_number() over (order by line_no) as integer) as place, substr(raw, 1, 55) as text,
  n from (select line_no, raw, cast(cluster_id as bigint) as n from numbered join firsts_numbered using (line_no) order by line_no limit 15)
union all
select 'levels', cast(log_level + 1 as integer), {NAME_SQL}, count(*) from (select {LEVEL_SQL} as log_level
  from numbered join firsts_numbered using (line_no)) group by log_level""",
        "clustered",
        "firsts",
    ).replace(
        "\nselect 'explore'",
        """,
numbered as (select row_number() over (order by line_no) - 1 as line_no, line_no as old, raw, cluster_id from clustered),
firsts_numbered as (select numbered.line_no from numbered join firsts on numbered.old = firsts.first_line)
select 'explore'""",
        1,
    ),
)
def _(spark, sf):
    """From a text file to the lists of a view: read, analyse, store, read back."""
    path = new_path(spark, "log-text")
    log_lines(spark, sf).orderBy("line_no").select("raw").write.text(path)
    analysed = analyze(logs.read_uploaded_text(spark, path)).scored
    rows = stored.read_scored(spark, stored.write_scored(analysed, new_path(spark, "stored"), True, keep_line_no=True), numbered=True)
    first = explore.first_rows(rows).select("line_no", F.substring("raw", 1, 55).alias("text"), F.col("cluster_id").cast("bigint").alias("n"))
    place = F.row_number().over(Window.orderBy("line_no"))  # fifteen rows
    listed = first.select(F.lit("explore").alias("list"), place.alias("place"), "text", "n")
    levels = report.level_distribution(rows).filter("n > 0")
    return listed.unionByName(levels.select(F.lit("levels").alias("list"), (F.col("code") + 1).alias("place"), F.col("level").alias("text"), "n"))


@query("analyze_documents")
def _(spark, sf):
    return analyze(text_lines(spark, sf)).scored.select(_SCORED)
