"""Log-like inputs made from the given tables, each as a DataFrame and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.functions.minhash import PRIME, permutations
from tracegrain.functions.text import MASK_RULES, extract_level
from tracegrain.operators.tables import dense_ids, lookup_join, materialize, spread
from tracegrain.operators.templates import fast_templates, with_mask
from tracegrain.sources.logs import lines_from_documents, log_lines_from_events

# The stand-in score of a log line: below zero for large values, flagged above 200.
FLAG_ABOVE = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_lines(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return log_lines_from_events(spread(table(spark, sf_dir, "events"), "event_id"), *keep)


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines_from_documents(spread(documents, "doc_id"))


def templated(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Log lines with masked text and digit-free template."""
    return fast_templates(with_mask(log_lines(spark, sf_dir, *keep)))


def clustered(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """``templated`` with cluster ids in the order of first lines."""
    rows = templated(spark, sf_dir, *keep)
    firsts = rows.groupBy("template").agg(F.min("line_no").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ids = materialize(dense_ids(firsts, "_first", "cluster_id"), "cluster-ids")
    return lookup_join(rows, ids, ["template"], "left", "_n").drop("_first", "_n")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored-table look-alike whose score comes from the value of the event."""
    return clustered(spark, sf_dir, "value").select(
        "line_no",
        "raw",
        "template",
        "cluster_id",
        ((F.lit(150.0) - F.col("value")) / 500.0).alias("anomaly_score"),
        (F.col("value") > FLAG_ABOVE).alias("is_anomaly"),
        extract_level("raw").alias("log_level"),
    )


def _mask_sql(text: str) -> str:
    for pattern, name in MASK_RULES:
        text = f"regexp_replace({text}, '{pattern}', '<{name}>', 'g')"
    return text


WORDS = r"regexp_extract_all({}, '\S+')"
LEVEL_SQL = """case when contains(upper(raw), 'DEBUG') then 0 when contains(upper(raw), 'INFO') then 1
  when contains(upper(raw), 'WARN') then 2 when contains(upper(raw), 'ERROR') then 3
  when contains(upper(raw), 'CRITICAL') or contains(upper(raw), 'FATAL') then 4 else 1 end"""
HOUR_SQL = r"coalesce(try_cast(nullif(regexp_extract(raw, '\b(\d{2}):\d{2}:\d{2}\b', 1), '') as integer), -1)"
NAME_SQL = """case log_level when 0 then 'DEBUG' when 1 then 'INFO' when 2 then 'WARNING'
  when 3 then 'ERROR' when 4 then 'CRITICAL' end"""

_LOG_SQL = """select event_id as line_no, value, event_type, concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ', case
  when event_type = 'error' and value > 200 then concat('CRITICAL Furnace rack-', u, ' overheats: sensor says ', v, '% above limit')
  when event_type = 'error' then concat('ERROR Valve of gateway ', ip, ' stuck after ', 1024 + event_id % 1000, ' turns')
  when event_type = 'signup' then concat('WARNING Badge guest_', u, ' printed late by ', v, 'ms')
  when event_type = 'view' then concat('DEBUG Tile for guest_', u, ' drawn through ', ip)
  when event_type = 'purchase' then concat('INFO Parcel ', event_id, ' weighing ', v, ' grams sent towards guest_', u)
  else concat('INFO Lamp guest_', u, ' switched with ', props) end) as raw
from (select *, user_id as u, cast(floor(value) as int) as v,
  concat('10.0.', user_id % 256, '.', event_id % 256) as ip from events)"""

_FAST_SQL = f"""array_to_string(list_transform({WORDS.format('masked')},
  lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end), ' ')"""

_CTES = {
    "log": _LOG_SQL,
    "masked_log": f"select *, {_mask_sql('raw')} as masked from log",
    "templated": f"select *, {_FAST_SQL} as template from masked_log",
    "firsts": "select template, min(line_no) as first_line, count(*) as n from templated group by template",
    "clusters": "select *, cast(row_number() over (order by first_line) as integer) as cluster_id from firsts",
    "clustered": "select t.*, c.cluster_id from templated t join clusters c using (template)",
    "scored": f"""select line_no, raw, template, cluster_id, (150.0::double - value) / 500.0::double as anomaly_score,
      value > 200 as is_anomaly, {LEVEL_SQL} as log_level from clustered""",
    "lines": """select (doc_id << 32) + pos as line_no, raw from (select doc_id,
      unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
      from documents)""",
}
_NEEDS = {
    "masked_log": ["log"],
    "templated": ["masked_log"],
    "firsts": ["templated"],
    "clusters": ["firsts"],
    "clustered": ["templated", "clusters"],
    "scored": ["clustered"],
}


def with_ctes(body: str, *names: str) -> str:
    """``body`` after the named inputs and everything they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "with " + ",\n".join(f"{n} as ({_CTES[n]})" for n in order) + "\n" + body


def signature_ctes(slots: int) -> str:
    """``sig(line_no, k, m)``: the signature slots of the document lines."""
    values = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(permutations(64)[:slots]))
    return f"""with lines as ({_CTES['lines']}),
perm(k, a, b) as (values {values}),
words as (select line_no, unnest(list_distinct(regexp_extract_all(lower(raw), '\\S+'))) as t from lines),
hashes as (select line_no, concat('0x', substr(md5(t), 1, 7))::bigint as h from words),
sig as (select line_no, k, min((h * a + b) % {PRIME}) as m from hashes, perm group by line_no, k
  union all select line_no, k, -1 from lines, perm where len(regexp_extract_all(raw, '\\S+')) = 0)"""


def kept_ctes() -> str:
    """``bands`` of the document lines and ``kept``: the greedy first-wins rule as a recursion.

    Lines with the same keys collide, so only the first of them takes part.
    """
    return signature_ctes(55).replace("with lines", "with recursive lines", 1) + """,
bands as (select line_no, k // 11 as band, md5(string_agg(m::varchar, ',' order by k)) as key
  from sig group by line_no, k // 11),
same as (select line_no, string_agg(key, ',' order by band) as keys from bands group by line_no),
reps as (select min(line_no) as line_no from same group by keys),
rep_bands as (select b.* from bands b join reps using (line_no)),
pairs as (select distinct a.line_no as lo, b.line_no as hi
  from rep_bands a join rep_bands b on a.band = b.band and a.key = b.key and a.line_no < b.line_no),
turns as (select hi as id, row_number() over (order by hi) as n from (select distinct hi from pairs)),
before as (select hi as id, list(lo) as lo from pairs group by hi),
walk(n, removed) as (
  select 0::bigint, []::bigint[]
  union all
  select walk.n + 1, case when len(list_filter(before.lo, lambda v: not list_contains(walk.removed, v))) > 0
    then list_append(walk.removed, turns.id) else walk.removed end
  from walk join turns on turns.n = walk.n + 1 join before on before.id = turns.id),
gone as (select unnest(removed) as line_no from (select removed from walk order by n desc limit 1)),
kept as (select line_no from reps where line_no not in (select line_no from gone))"""
