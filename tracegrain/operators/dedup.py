"""Near-duplicate removal: keep a row unless it collides with a row kept before it.

Two rows collide when they share a key in any LSH band. The rule is evaluated in rounds over the
bucket table. A row that is the first of all its buckets is kept, every other row of those buckets is
dropped, and the rest goes into the next round. That gives exactly the result of the loop over lines,
and no bucket is ever held by one task: its minimum is pre-aggregated, and a bucket has at most one
kept row, which the others look up.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.functions.minhash import band_keys, banding, minhash
from tracegrain.functions.text import tokens
from tracegrain.operators.bloom import Bloom, possible
from tracegrain.operators.tables import HOT_SHARE, Table, lookup_join, materialize, salted_join, stored

# After this many rounds a remainder of at most TAIL_ROWS rows is finished in one task.
TAIL_ROUNDS = 6
TAIL_ROWS = 20_000

# Below this many bucket rows no key can hold enough to slow a task down.
SKEW_ROWS = 5_000_000


@dataclass(frozen=True)
class Kept:
    """Kept rows ``line_no, bands``, their number, the rounds it took to find them, and the tables they lie in."""

    df: DataFrame
    rounds: int
    rows: int
    tables: tuple[Table, ...] = ()

    def lines(self) -> Table:
        return Table(self.df.select("line_no"), (self.rows, 16 * self.rows))

    def bands(self) -> DataFrame:
        """The bucket table of the kept rows: one row per bucket."""
        return buckets(self.df)

    def drop(self) -> None:
        """Deletes the tables, if ``first_wins`` was told to put them where that is possible."""
        for table in self.tables:
            table.drop()


def with_bands(df: DataFrame, text: str, threshold: float = 0.8, num_perm: int = 64, *more: str) -> DataFrame:
    """``line_no``, the array of its band keys (16 bytes each) and ``more`` columns."""
    count, width = banding(threshold, num_perm)
    signed = df.select("line_no", minhash(F.coalesce(text, F.lit("")), num_perm, count * width).alias("_s"), *more)
    keys = F.transform(band_keys("_s", count, width), F.unhex)
    return signed.select("line_no", keys.alias("bands"), *more)


def buckets(df: DataFrame) -> DataFrame:
    return df.select("line_no", F.posexplode("bands").alias("band", "key"))


def first_rows(df: DataFrame, by: Column) -> DataFrame:
    """``_text`` (the value of ``by``), its first ``line_no`` and that whole row as ``_row``.

    The row comes along through the aggregation, which tasks begin on their own lines, so rows are neither read a
    second time nor moved by their number.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.groupBy(by.alias("_text")).agg(F.min("line_no").alias("line_no"), F.min_by(row, "line_no").alias("_row"))


def _first_of_text(df: DataFrame, text: str) -> Table:
    """The first row of every distinct text: equal texts always collide."""
    return materialize(first_rows(df, F.coalesce(text, F.lit(""))), "first-rows")


def _drop_hit(rows: DataFrame, won: DataFrame, total: int) -> Table:
    """``rows`` without those that stand in a bucket of ``won`` (band, key, n).

    ``total`` is the size of the bucket table that the counts ``n`` belong to.
    """
    won = won.withColumn("_won", F.lit(True))
    if total > SKEW_ROWS:
        limit = max(total // HOT_SHARE, 1)
        joined = salted_join(buckets(rows), won, ["band", "key"], "left", "n", "line_no", limit)
    else:
        joined = buckets(rows).join(won, ["band", "key"], "left")
    state = joined.groupBy("line_no").agg(
        F.array_sort(F.collect_list(F.struct("band", "key"))).alias("_b"), F.max("_won").alias("_hit")
    )
    still_open = state.filter(F.col("_hit").isNull())
    return stored(still_open.select("line_no", _keys("_b").alias("bands")), "dedup-open")


def _found_earlier(sizes: DataFrame, earlier: DataFrame, seen: list[Bloom] | None) -> DataFrame:
    """The buckets of ``sizes`` (band, key, n) that ``earlier`` holds.

    The filters leave the true hits and a few others. These look through the history where it lies if they are few
    enough to be sent there, and only then is none of it moved.
    """
    if seen is None:
        return sizes.join(earlier.select("band", "key"), ["band", "key"], "left_semi")
    asked = materialize(possible(sizes, seen), "asked-buckets")
    if asked.rows == 0:
        return asked.df
    hits = lookup_join(earlier.select("band", "key"), asked.narrowed("band", "key"), ["band", "key"], "left_semi").distinct()
    return asked.df.join(hits, ["band", "key"], "left_semi")


def _keys(pairs: str) -> Column:
    return F.transform(pairs, lambda b: b["key"])


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """The rule itself, row by row."""
    taken, keep = set(), []
    rows = rows.sort_values("line_no")
    for keys in rows["bands"]:
        own = list(enumerate(keys))
        fresh = taken.isdisjoint(own)
        keep.append(fresh)
        if fresh:
            taken.update(own)
    return rows.loc[keep, ["line_no", "bands"]]


def first_wins(
    rows: DataFrame | Table, width: int, earlier: DataFrame | None = None, seen: list[Bloom] | None = None, put=materialize
) -> Kept:
    """Kept rows of ``line_no, bands`` with ``width`` bands each.

    ``earlier`` is the bucket table of rows kept before, ``seen`` are filters of its buckets. A table that is stored
    already is read where it lies. The kept rows are ``put`` on shared storage; a caller that drops them takes ``stored``.
    """
    undecided = given = rows if isinstance(rows, Table) else stored(rows, "dedup-bands")
    kept: list[Table] = []
    tables: list[Table] = []
    rounds = 0

    def pass_on(rest: Table) -> Table:
        """``rest`` takes the place of the rows before it, unless those are the caller's."""
        if undecided is not rows:
            undecided.drop()
        return rest

    none = given.df.sparkSession.createDataFrame([], given.df.select("line_no", "bands").schema)
    if undecided.rows == 0:
        pass_on(undecided)
        return Kept(none, 0, 0)
    if earlier is not None:
        sizes = buckets(undecided.df).groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"))
        undecided = pass_on(_drop_hit(undecided.df, _found_earlier(sizes, earlier, seen), undecided.rows * width))
    while undecided.rows:
        if rounds >= TAIL_ROUNDS and undecided.rows <= TAIL_ROWS:
            open_rows = undecided.df.select("line_no", "bands")
            tail = open_rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_walk, open_rows.schema)
            kept.append(put(tail, "dedup-tail"))
            tables.append(kept[-1])
            break
        firsts = buckets(undecided.df).groupBy("band", "key").agg(
            F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n")
        )
        # At most ``width`` buckets per row. A row that is first in all of its buckets is kept.
        led = firsts.groupBy("line_no").agg(
            F.array_sort(F.collect_list(F.struct("band", "key", "n"))).alias("_b")
        )
        leaders = put(led.filter(F.size("_b") == width), "dedup-kept")
        tables.append(leaders)
        kept.append(leaders.narrowed("line_no", _keys("_b").alias("bands")))
        rounds += 1
        if leaders.rows == undecided.rows:
            break
        # Buckets without other rows have nothing left to drop.
        won = leaders.df.select(F.inline("_b")).filter("n > 1")
        rest = undecided.df.join(leaders.df.select("line_no"), "line_no", "left_anti")
        undecided = pass_on(_drop_hit(rest, won, undecided.rows * width))
    pass_on(undecided)
    if not kept:
        return Kept(none, rounds, 0)
    total = sum(part.rows for part in kept)
    if len(kept) <= TAIL_ROUNDS:
        return Kept(_union(kept), rounds, total, tuple(tables))
    # Many parts become one table, so that plans do not grow with the rounds.
    whole = put(_union(kept), "dedup-kept")
    found = Kept(whole.df, rounds, total, (whole,))
    for table in tables:
        table.drop()
    return found


def _union(parts: list[Table]) -> DataFrame:
    out = parts[0].df
    for part in parts[1:]:
        out = out.unionByName(part.df)
    return out


def keep_lines(df: DataFrame, lines: Table) -> DataFrame:
    """Rows of ``df`` whose line is listed."""
    return lookup_join(df, lines, ["line_no"], "left_semi")


def _kept_of(firsts: Table, threshold: float, num_perm: int, earlier: DataFrame | None = None, seen: list[Bloom] | None = None) -> Kept:
    rows = with_bands(firsts.df, "_text", threshold, num_perm)
    return first_wins(rows, banding(threshold, num_perm)[0], earlier, seen)


def find_kept(
    df: DataFrame,
    text: str = "template",
    threshold: float = 0.8,
    num_perm: int = 64,
    earlier: DataFrame | None = None,
) -> Kept:
    """Numbers and bands of the rows that survive."""
    lines = df.groupBy(F.coalesce(text, F.lit("")).alias("_text")).agg(F.min("line_no").alias("line_no"))
    return _kept_of(Table(lines), threshold, num_perm, earlier)


def _survivors(firsts: Table, kept: Kept) -> DataFrame:
    return keep_lines(firsts.df, kept.lines()).select("_row.*")


def dedup_first_wins(df: DataFrame, text: str = "template", threshold: float = 0.8, num_perm: int = 64) -> DataFrame:
    """Rows of ``df`` that survive, in the order of ``line_no``. The lines are read once."""
    firsts = _first_of_text(df, text)
    return _survivors(firsts, _kept_of(firsts, threshold, num_perm))


def dedup_incremental(
    df: DataFrame,
    earlier: DataFrame | None,
    text: str = "template",
    threshold: float = 0.8,
    num_perm: int = 64,
    seen: list[Bloom] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Survivors of a further chunk, and the buckets to append to ``earlier``.

    With ``seen``, filters of the buckets in ``earlier``, only buckets that pass one are looked up there.
    """
    firsts = _first_of_text(df, text)
    kept = _kept_of(firsts, threshold, num_perm, earlier, seen)
    return _survivors(firsts, kept), kept.bands()


def dedup_exact(df: DataFrame, text: str = "template") -> DataFrame:
    """First row of every distinct set of lower-cased words, by one aggregation."""
    return first_rows(df, word_set(text)).select("_row.*")


def word_set(text: Column | str) -> Column:
    """The set of lower-cased words of a text in one string; null has none."""
    return F.array_join(F.array_sort(F.array_distinct(tokens(F.coalesce(text, F.lit("")), lower=True))), " ")


def near_dup_pairs(
    df: DataFrame, text: str = "template", threshold: float = 0.8, num_perm: int = 64, verify: bool = False
) -> DataFrame:
    """Every removed line with the kept lines before it that it collides with: ``lo, hi``.

    A bucket has one kept row at most, so a line has no more partners than there are bands; pairs
    among the removed lines are never formed. Equal texts are signed and compared once, and
    their lines attached afterwards. With ``verify`` a pair must have a Jaccard similarity of word sets of
    ``threshold`` or more; sets are cut and compared once per pair of distinct texts. Texts without words are equal. Intermediate tables are dropped as soon as they are read.
    """
    texts = df.groupBy(F.coalesce(text, F.lit("")).alias("_text")).agg(
        F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("_lines")
    )
    texts = stored(texts, "first-texts")
    rows = stored(with_bands(texts.df, "_text", threshold, num_perm), "line-bands")
    kept = first_wins(rows, banding(threshold, num_perm)[0], put=stored)
    # A bucket of one text pairs its lines among themselves only, and that pair of a text with itself is added below.
    sizes = buckets(rows.df).groupBy("band", "key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    owners = kept.bands().select("band", "key", F.col("line_no").alias("lo"))
    lookup = stored(owners.join(sizes, ["band", "key"]), "kept-buckets")
    hits = lookup_join(buckets(rows.df), lookup, ["band", "key"], "inner", "_n").select("lo", "line_no")
    repeated = texts.df.filter("_lines > 1").select("line_no").join(kept.df.select("line_no"), "line_no", "left_semi")
    hits = hits.unionByName(repeated.select(F.col("line_no").alias("lo"), "line_no"))
    hits = stored(hits.distinct(), "line-pairs")
    for table in (lookup, rows, kept):
        table.drop()
    if verify:
        similar = stored(_verified(hits.df, texts, threshold), "similar-pairs")
        hits.drop()
        hits = similar
    lists = hits.df.groupBy("line_no").agg(F.collect_list("lo").alias("_los"))
    partners = stored(texts.df.join(lists, "line_no").select("_text", "_los", "_lines"), "text-partners")
    hits.drop()
    texts.drop()
    lines = df.select("line_no", F.coalesce(text, F.lit("")).alias("_text"))
    pairs = lookup_join(lines, partners, ["_text"], "inner", "_lines")
    pairs = pairs.select(F.explode("_los").alias("lo"), F.col("line_no").alias("hi"))
    return pairs.filter("lo < hi")


def _verified(pairs: DataFrame, texts: Table, threshold: float) -> DataFrame:
    """The pairs (lo, line_no) of first lines of texts whose word sets are similar enough.

    Only texts in pairs move, and they are cut into words where they meet, as words apart are several times larger.
    A kept line may have very many partners, so its text is joined with the hot ones cut into pieces.
    """
    counted = materialize(pairs.groupBy("lo").agg(F.count(F.lit(1)).alias("_n")), "pair-counts").df
    low = texts.df.select(F.col("line_no").alias("lo"), F.col("_text").alias("_first")).join(counted, "lo")
    low = stored(low, "kept-texts")
    both = pairs.join(texts.df.select("line_no", "_text"), "line_no")
    both = lookup_join(both, low, ["lo"], "inner", "_n", "line_no")

    def words(name: str) -> Column:
        return F.array_distinct(tokens(name, lower=True))

    both = both.select("lo", "line_no", words("_first").alias("_low"), words("_text").alias("_set"))
    shared = F.size(F.array_intersect("_low", "_set"))
    whole = F.size("_low") + F.size("_set") - shared
    return both.filter((whole == 0) | (shared >= F.lit(threshold) * whole)).select("lo", "line_no")
