"""The registered queries of the text operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.llm import (
    alignment,
    bpe,
    dual_tree,
    jaccard,
    language,
    packing,
    prefix_free,
    quality,
    recompress,
    sharding,
    subspace,
    toxicity,
    wrappers,
)
from tracegrain.llm.common import table

SHARDS = 16


# A third of the documents, by a checksum of the id, is held out from all training.
HELD_OUT = 1


def _held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == HELD_OUT


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, ~_held_out())
    found = language.identify(docs, model, ["doc_id"])
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.removals(table(spark, sf_dir, "documents"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS).drop("row_number")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The same vocabulary as byte_bpe_50k.json, as ranks.
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~_held_out())
    found = toxicity.score(docs, model, ["doc_id"])
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return found.select("doc_id", _held_out().alias("held_out"), "score", predicted)


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_free.removals(table(spark, sf_dir, "documents"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The first file has the same vocabulary as byte_bpe_50k.json, as ranks.
    paths = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.token_alignment(table(spark, sf_dir, "documents"), *paths)


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_language": op1_language,
    "op2_substrings": op2_substrings,
    "op3_shards": op3_shards,
    "op4_quality": op4_quality,
    "op5_jaccard": op5_jaccard,
    "op6_bpe": op6_bpe,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_suffixes": op9_suffixes,
    "op10_embeddings": op10_embeddings,
    "op11_articles": op11_articles,
    "op12_alignment": op12_alignment,
    "op13_search": op13_search,
}


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

_BASE_SQL = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"
_RULES_SQL = """10 * n_symbols > 3 * n_words or 2 * n_shouts > n_words or 2 * n_capitals > word_chars
    or n_dup_lines > 3 and 10 * n_dup_lines > 3 * n_lines or 10 * n_stutters > 3 * n_words
    or word_chars < 2 * n_words or word_chars > 20 * n_words"""

QUALITY_SQL = f"""
with w as (select doc_id, coalesce(text, '') as t, {_WORDS} as ws from documents),
l as (
    select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from w
),
windows as (
    select doc_id, i, array_to_string(ws[i : i + {quality.WINDOW - 1}], ' ') as g
    from (select doc_id, ws, unnest(range(1, len(ws) - {quality.WINDOW - 2})) as i from w)
),
starts as (
    select doc_id, i, lead(i) over (partition by doc_id order by i) as after
    from (select doc_id, i, count(*) over (partition by doc_id, g) as c from windows) where c > 1
),
repeats as (select doc_id, sum(least({quality.WINDOW}, coalesce(after - i, {quality.WINDOW}))) as n from starts group by doc_id),
measures as (
    select doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
        length(regexp_replace(t, '[^{quality.SYMBOLS}]', '', 'g')) as n_symbols,
        length(regexp_replace(t, '[^!]', '', 'g')) as n_shouts,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_capitals,
        len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines,
        len(list_filter(ws, lambda w, i: i > 1 and w = ws[i - 1])) as n_stutters,
        coalesce(repeats.n, 0)::bigint as n_repeat_words
    from w join l using (doc_id) left join repeats using (doc_id)
),
judged as (select *, {_BASE_SQL} as base_failed from measures)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not (base_failed or {_RULES_SQL}) as kept
from judged"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SEARCH_SQL = f"""
with t as (select doc_id, {_TERMS} as ts from documents where text is not null),
d as (select doc_id, len(ts)::bigint as n from t where len(ts) > 0),
s as (select count(*)::bigint as docs, sum(n)::bigint as terms from d),
tf as (select doc_id, term, count(*)::bigint as tf from (select doc_id, unnest(ts) as term from t) group by all),
i as (
    select item_id, term, count(*)::bigint as times
    from (select item_id, unnest({_TERMS}) as term from benchmark) group by all
),
w as (
    select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, s group by term, docs
),
scores as (
    select item_id, doc_id,
        sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::bigint as score
    from i join w using (term) join tf using (term) join d using (doc_id), s group by item_id, doc_id
)
select item_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
where rank <= {dual_tree.TOP}"""

_LOWERED = _WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")

# Removes words under windows that also start in a document of a smaller id.
SUBSTRINGS_SQL = f"""
with w as (select doc_id, {_WORDS} as ws from documents),
win as (
    select doc_id, i, array_to_string(ws[i : i + 12], ' ') as g
    from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w)
),
firsts as (select g, min(doc_id) as least from win group by g),
gone as (select distinct doc_id, i + k as pos from win join firsts using (g), range(13) t(k) where least < doc_id),
placed as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w),
kept as (
    select doc_id, string_agg(word, ' ' order by pos) as words, count(*) as n from placed anti join gone using (doc_id, pos) group by doc_id
)
select doc_id, len(ws)::bigint as n_words, len(ws) - coalesce(n, 0)::bigint as n_removed, sha256(coalesce(words, '')) as kept_sha256
from w left join kept using (doc_id)"""

# Shingle sets, links by counting shared shingles, and what links reach.
JACCARD_SQL = f"""
with recursive w as (select doc_id, {_LOWERED} as ws from documents),
s as (
    select doc_id, list_distinct(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' '))
        when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as gs from w
),
g as (select doc_id, len(gs) as n, unnest(gs) as g from s),
links as (
    select a.doc_id as a, b.doc_id as b from g a join g b on a.g = b.g and a.doc_id <> b.doc_id
    where 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
reach(id, other) as (select doc_id, doc_id from s union select id, b from reach join links on a = other)
select s.doc_id, len(gs)::bigint as n_shingles, min(other) as component_id from s join reach on id = s.doc_id group by s.doc_id, gs"""

EMBEDDINGS_SQL = f"""
with recursive v as (
    select vec_id, label, embedding::double[] as e from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links as (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
    where list_cosine_similarity(a.e, b.e) >= {subspace.COSINE}
),
reach(id, other) as (select vec_id, vec_id from embeddings union select id, b from reach join links on a = other),
n as (select a, count(*) as n from links group by a)
select vec_id, coalesce(max(n), 0)::bigint as n_links, min(other) as component_id, vec_id = min(other) as kept
from embeddings join reach on id = vec_id left join n on a = vec_id group by vec_id"""

# The pages of the given tables name their article; the wrappers have to find the same.
ARTICLES_SQL = """
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) as t from pages),
b as (
    select page_id, url, list_transform(string_split_regex(regexp_replace(t, '</?b>', '', 'g'), '</?(?:p|h1|br)>'),
        lambda x: trim(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'),
            '\\s+', ' ', 'g'))) as parts
    from a
),
c as (select page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) as text from b)
select page_id, url, text, length(text)::bigint as n_chars from c"""

ORACLES = {
    "op2_substrings": SUBSTRINGS_SQL,
    "op4_quality": QUALITY_SQL,
    "op5_jaccard": JACCARD_SQL,
    "op10_embeddings": EMBEDDINGS_SQL,
    "op11_articles": ARTICLES_SQL,
    "op13_search": SEARCH_SQL,
}
