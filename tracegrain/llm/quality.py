"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule names the columns it has to compute and a condition that rejects a document. ``plan_cascade`` runs
every rule over a bounded sample, takes its seconds and the share it rejects, and orders the rules by
rejection per cost. ``cascade`` then applies them in that order: what a rule computes is evaluated only
for documents that all rules before it let pass. The order changes the time, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.common import BLANKS, words_column, written

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
# Documents that the cost and selectivity of the rules are estimated on; the verdict doesn't depend on it.
SAMPLE_ROWS = 2_000


@dataclass(frozen=True)
class Rule:
    """``needs`` are names in ``MEASURES``; ``reject`` makes the condition from their columns, in that order."""

    name: str
    needs: tuple[str, ...]
    reject: Callable[..., Column]


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{BLANKS}]"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _repeated_starts(hashes: Column) -> Column:
    """Starts of the windows whose hash occurs twice or more, ascending: neighbours in the order of the hash."""
    marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    later = F.slice(marked, F.lit(2), F.size(hashes))
    pairs = F.zip_with(marked, later, lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))


def _covered(starts: Column) -> Column:
    """Words under windows of the given starts: each adds what the ones before it don't cover."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    end = lambda s: s + WINDOW
    add = lambda a, s: F.struct((a["n"] + end(s) - F.greatest(a["end"], s)).alias("n"), end(s).alias("end"))
    return F.aggregate(starts, none, add, lambda a: a["n"])


def _repeat_words(text: Column, words: Column) -> Column:
    """Words in windows found twice or more; sorting is left to texts in which a window hash repeats."""
    last = F.size(words) - WINDOW
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i + 1, WINDOW)))
    repeats = lambda h: F.size(F.array_distinct(h)) < F.size(h)
    count = _let(hashes, lambda h: F.when(repeats(h), _covered(_repeated_starts(h))))
    return F.coalesce(F.when(last >= 1, count), F.lit(0).cast("long"))


def _stutters(text: Column, words: Column) -> Column:
    """Words that equal the word before them."""
    return F.size(F.filter(words, lambda w, i: (i > 0) & (w == words[F.greatest(i - 1, F.lit(0))]))).cast("long")


def _length(others: str):
    """Characters of a text that are left when ``others`` are taken out."""
    return lambda text, words: F.length(F.regexp_replace(text, others, "")).cast("long")


def _dup_lines(text: Column, words: Column) -> Column:
    return _let(_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


# Each measure is one expression of the text and its words, so that it is evaluated only where it is asked for.
MEASURES = {
    "n_words": lambda text, words: F.size(words).cast("long"),
    "word_chars": lambda text, words: F.length(F.array_join(words, "")).cast("long"),
    "n_stutters": _stutters,
    "n_symbols": _length(f"[^{SYMBOLS}]+"),
    "n_shouts": _length("[^!]+"),
    "n_capitals": _length("[^A-Z]+"),
    "n_lines": lambda text, words: F.size(_lines(text)).cast("long"),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
}

BASE_RULES = (
    Rule("too_short", ("n_words",), lambda words: words < MIN_WORDS),
    Rule("repetitive", ("n_repeat_words", "n_words"), lambda n, words: n * 100 > words * 30),
)
RULES = (
    Rule("symbols", ("n_symbols", "n_words"), lambda n, words: n * 10 > words * 3),
    Rule("shouting", ("n_shouts", "n_words"), lambda n, words: n * 2 > words),
    Rule("capitals", ("n_capitals", "word_chars"), lambda n, chars: n * 2 > chars),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda n, lines: (n > 3) & (n * 10 > lines * 3)),
    Rule("stutter", ("n_stutters", "n_words"), lambda n, words: n * 10 > words * 3),
    Rule("word_length", ("word_chars", "n_words"), lambda n, words: (n < words * 2) | (n > words * 20)),
)


def _with_text(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """``keep``, the text and its words. Exploding one array holds the optimizer from splitting the text again
    for each use, above all from doing so inside a filter that it moves below the projection."""
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.withColumn("_words", F.explode(F.array(words_column(F.col("_text")))))


def _rejects(rule: Rule) -> Column:
    """The condition of a rule over the text; its measures are computed once, where it is asked for."""
    values = [MEASURES[name](F.col("_text"), F.col("_words")) for name in rule.needs]
    return _let(F.array(*values), lambda v: rule.reject(*[v[i] for i in range(len(values))]))


def measure(docs: DataFrame, names: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the named measures of every whole text; a null text has no words and no lines."""
    rows = _with_text(docs, text_col, F.col(id_col).alias("doc_id"))
    return rows.select("doc_id", *[MEASURES[n](F.col("_text"), F.col("_words")).alias(n) for n in names])


def sample_of(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` texts, chosen by their hash, as a stored table."""
    share = min(1.0, rows / max(docs.count(), 1))
    text = F.coalesce(F.col(text_col), F.lit(""))
    chosen = F.pmod(F.xxhash64(text), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))
    return written(docs.select(text.alias("_text")).filter(chosen), "quality-sample")


def plan_cascade(sample: DataFrame, rules: tuple[Rule, ...]) -> list[Rule]:
    """The rules by share rejected per second over ``sample``, dearest per rejection last."""
    rows, worth = _with_text(sample, "_text"), []
    for rule in rules:
        began = time.monotonic()
        share = rows.agg(F.avg(_rejects(rule).cast("int"))).first()[0] or 0.0
        worth.append((-share / max(time.monotonic() - began, 1e-6), rule.name, rule))
    return [rule for _, _, rule in sorted(worth, key=lambda x: x[:2])]


def rejected_by(rules: list[Rule] | tuple[Rule, ...]) -> Column:
    """Name of the first rule in the given order that rejects the text, else null.

    Conditions of one CASE are evaluated from the left and only up to the first that holds.
    """
    chain = F.when(_rejects(rules[0]), rules[0].name)
    for rule in rules[1:]:
        chain = chain.when(_rejects(rule), rule.name)
    return chain


def cascade(docs: DataFrame, rules: list[Rule] | tuple[Rule, ...], text_col: str = "text") -> DataFrame:
    """``docs`` with ``rejected_by``: the first rule in the given order that rejects the row, else null.

    A null text is an empty one. The columns of ``docs`` come through unchanged; a column of the name
    ``rejected_by`` is replaced.
    """
    names = [c for c in docs.columns if c != "rejected_by"]
    rows = _with_text(docs, text_col, F.struct(*names).alias("_row"))
    return rows.select(*[F.col("_row")[c].alias(c) for c in names], rejected_by(rules).alias("rejected_by"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts of every document and the verdict of the cascade.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept. All counts
    are of the whole text; null and empty texts count zero and fail. Repeated rows are judged one by one.
    The base counts are asked for anyway; the cascade runs over the documents that the base lets pass.
    """
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    order = plan_cascade(sample_of(docs, text_col), RULES)
    rows = _with_text(docs, text_col, F.col(id_col).alias("doc_id"))
    counts = F.struct(*[MEASURES[n](F.col("_text"), F.col("_words")).alias(n) for n in base])
    rows = rows.withColumn("_counts", counts)
    failed = F.lit(False)
    for rule in BASE_RULES:
        failed = failed | rule.reject(*[F.col("_counts")[n] for n in rule.needs])
    rows = rows.withColumn("base_failed", failed)
    verdict = F.when(F.col("base_failed"), "base").otherwise(rejected_by(order))
    return rows.select("doc_id", "_counts.*", "base_failed", verdict.isNull().alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass all rules, base rules included, with their columns as they are."""
    order = plan_cascade(sample_of(docs, text_col), BASE_RULES + RULES)
    return cascade(docs, order, text_col).filter(F.col("rejected_by").isNull()).select(docs.columns)
