"""Search of a stored table through postings of trigrams, so that files without a hit are not opened.

The index lists, for every three letters, the files that have them somewhere. A text that is sought, or the literal parts of
a pattern, needs certain trigrams; only files with all of them are read, and the search itself is run on their
rows, so the result is that of a full scan. Letters are compared as a case-insensitive pattern compares them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.operators.explore import search

COLUMNS = ("raw", "template")
GRAM = 3
# Letters that a case-insensitive pattern takes for an ASCII letter (fixed values).
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZſKıİ"
_LOWER = "abcdefghijklmnopqrstuvwxyzskii"
_FOLD = str.maketrans(_UPPER, _LOWER)


def _name(path: Column) -> Column:
    """The file without its folder."""
    return F.substring_index(path, "/", -1)


def build_index(spark: SparkSession, table: str, index: str, columns: tuple[str, ...] = COLUMNS) -> None:
    """Writes the index of a stored table: ``grams`` (gram, file), sorted by gram, and ``files`` (file, rows).

    Every task sums up its own rows first, so a file adds no more rows than there are different trigrams in it.
    """
    rows = spark.read.parquet(table).select("*", _name(F.col("_metadata.file_path")).alias("_file"))
    rows.groupBy(F.col("_file").alias("file")).agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{index}/files")
    texts = [F.translate(F.coalesce(F.col(c), F.lit("")), _UPPER, _LOWER) for c in columns if c in rows.columns]
    text = F.explode(F.array(*texts)).alias("text")
    last = F.length("text") - (GRAM - 1)
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.col("text").substr(i, F.lit(GRAM)))
    cut = rows.select("_file", text).filter(last >= 1).select("_file", F.explode(F.array_distinct(grams)).alias("gram"))
    found = cut.select("gram", F.col("_file").alias("file")).distinct()
    found.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{index}/grams")


def _runs(pattern: str) -> list[list[str]] | None:
    """Literal runs that a match of each alternative must hold; None if the pattern is too involved to tell."""
    if "(?" in pattern or "\\Q" in pattern:
        return None
    out: list[list[str]] = [[]]
    run, depth, k = "", 0, 0

    def end() -> None:
        nonlocal run
        if run:
            out[-1].append(run)
        run = ""

    while k < len(pattern):
        c = pattern[k]
        width = 1
        literal = None
        if c == "\\":
            width = 2
            if k + 1 == len(pattern):
                return None
            if not pattern[k + 1].isalnum():
                literal = pattern[k + 1]
            elif pattern[k + 1] not in "bBdDsSwW":
                return None
        elif c == "[":
            close = _class_end(pattern, k)
            if close is None:
                return None
            width = close - k + 1
        elif c in "(":
            depth += 1
        elif c in ")":
            depth -= 1
        elif c == "|":
            if depth:
                pass  # inside a group, which is passed over
            else:
                end()
                out.append([])
        elif c not in ".^$*+?{}":
            literal = c
        k += width
        after = pattern[k : k + 1]
        if literal is None or depth:
            end()
        elif after in ("*", "?", "{"):
            end()
        else:
            run += literal
            if after == "+":
                end()
        if c == "{":
            close = pattern.find("}", k)
            if close < 0:
                return None
            k = close + 1
    end()
    return out


def _class_end(pattern: str, start: int) -> int | None:
    """Where a bracket that opens at ``start`` closes; None for nested ones."""
    k = start + 1 + (pattern[start + 1 : start + 2] == "^")
    if pattern[k : k + 1] == "]":
        k += 1
    while k < len(pattern) and pattern[k] != "]":
        if pattern[k] == "[":
            return None
        k += 1 + (pattern[k] == "\\")
    return k if k < len(pattern) else None


def needed_grams(text: str, literal: bool = False) -> list[set[str]] | None:
    """For each alternative of a pattern the trigrams that a match must hold; None if any file may match.

    Only runs of ASCII letters count, as others are compared in more ways.
    """
    runs = [[text]] if literal else _runs(text)
    if runs is None:
        return None
    out = []
    for parts in runs:
        grams = set()
        for part in parts:
            folded = part.translate(_FOLD)
            grams |= {folded[i : i + GRAM] for i in range(len(folded) - GRAM + 1)}
        grams = {g for g in grams if g.isascii()}
        if not grams:
            return None
        out.append(grams)
    return out


@dataclass(frozen=True)
class Found:
    """Rows that match, and how many files of the table were opened and left out."""

    rows: DataFrame
    files: int
    skipped: int


def search_stored(spark: SparkSession, table: str, index: str, text: str, literal: bool = False) -> Found:
    """``explore.search`` over a stored table, reading only files that can hold a match.

    Files that the index does not know, because they came later, are read. An empty text matches all rows.
    """
    rows = spark.read.parquet(table)
    paths = {path.rsplit("/", 1)[-1]: path for path in rows.inputFiles()}  # a name per file
    grams = needed_grams(text, literal) if text else None
    if grams is None:
        return Found(search(rows, text, literal), len(paths), 0)
    known = {row["file"] for row in spark.read.parquet(f"{index}/files").select("file").collect()}
    asked = sorted(set().union(*grams))
    held = spark.read.parquet(f"{index}/grams").filter(F.col("gram").isin(asked)).groupBy("file").agg(F.collect_set("gram").alias("has"))
    whole = F.lit(False)
    for alternative in grams:
        whole = whole | (F.size(F.array_intersect("has", F.array(*map(F.lit, sorted(alternative))))) == len(alternative))
    near = {row["file"] for row in held.filter(whole).select("file").collect()}
    names = sorted(name for name in paths if name in near or name not in known)
    part = spark.read.schema(rows.schema).parquet(*[paths[n] for n in names]) if names else rows.limit(0)
    return Found(search(part, text, literal), len(names), len(paths) - len(names))
