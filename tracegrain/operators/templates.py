"""Template mining: lines that share a routing leaf and most of their words form one cluster.

Within a leaf the merge is greedy in line order, so small leaves are the unit of parallel work and are
packed into Python groups of limited size. A leaf with many distinct lines is cut into blocks in line
order. Few of its lines open or widen a cluster; once those are known, every block can be
replayed on its own against the clusters as they stood at each line. They are found in rounds: a
guess is merged in order, all blocks are replayed against it and report the lines that would still open or
widen something, which join the guess until no block reports any. The result is that of the plain loop.
"""

from __future__ import annotations

import re
import weakref
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.functions.text import (
    WILDCARD,
    extract_parameters,
    fast_template,
    generalize_digits,
    mask,
    tokens,
)
from tracegrain.operators.tables import Table, dense_ids, lookup_join, materialize, stored

# Lines and words that one Python group should hold.
GROUP_LINES = 10_000
GROUP_WORDS = 1_000_000
# Leaves with more lines are merged in blocks of about so many; the result is the same either way.
BLOCK_LINES = 50_000


@dataclass(frozen=True)
class Mining:
    """Parameters of the merge.

    similarity       share of equal words that makes a line join a cluster
    prefix_tokens    leading words that route a line to its leaf
    max_children     branches per routing node, the wildcard branch included
    """

    similarity: float = 0.5
    prefix_tokens: int = 1
    max_children: int = 100


@dataclass(frozen=True)
class Model:
    """What was learnt: clusters, the cluster of every distinct masked line, and the routing words.

    templates    leader_line, cluster_id, leaf, template, n, first_line
    assignments  masked, first_line, n, leader_line, emitted
    children     node, word, first_line
    """

    templates: Table
    assignments: Table
    children: Table


def with_mask(df: DataFrame, **options) -> DataFrame:
    return df.withColumn("masked", mask("raw", **options))


def collapse_masked(df: DataFrame) -> DataFrame:
    """Distinct masked lines with their first line, count and raw bytes."""
    return df.groupBy("masked").agg(*_collapsed())


def _collapsed() -> list[Column]:
    return [
        F.min("line_no").alias("first_line"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.octet_length("raw")).alias("raw_bytes"),
    ]


def with_head(collapsed: DataFrame, prefix_tokens: int = Mining.prefix_tokens) -> DataFrame:
    """Add the word count and the routing words, so that lines are cut into words only once."""
    split = collapsed.withColumn("_words", tokens("masked"))
    head = F.transform(F.slice("_words", 1, _depth(F.size("_words"), prefix_tokens)), generalize_digits)
    return split.withColumns({"words": F.size("_words"), "head": head}).drop("_words")


def _depth(words: Column, prefix_tokens: int) -> Column:
    """The last word never routes."""
    return F.greatest(F.least(F.lit(prefix_tokens), words - 1), F.lit(0))


def leaf_key(masked: Column | str, prefix_tokens: int = Mining.prefix_tokens) -> Column:
    """Word count and leading words, a word with a digit counting as the wildcard."""
    words = tokens(masked)
    head = F.slice(words, F.lit(1), _depth(F.size(words), prefix_tokens))
    return _leaf(F.size(words), F.transform(head, generalize_digits))


def _leaf(count: Column, route: Column) -> Column:
    return F.concat_ws(" ", count.cast("string"), route)


def _deep_leaf(masked: Column | str, depth: int) -> Column:
    words = tokens(masked)
    return _leaf(F.size(words), F.transform(F.slice(words, 1, depth), generalize_digits))


def route(
    items: DataFrame,
    known: DataFrame | None = None,
    prefix_tokens: int = Mining.prefix_tokens,
    max_children: int = Mining.max_children,
) -> tuple[DataFrame, Table]:
    """Add ``leaf`` to rows of ``with_head``, with at most ``max_children`` branches per node.

    A node keeps the branches whose words were seen first, and one of its branches is the wildcard
    that takes all other words. ``known`` holds the words of earlier chunks; the second result holds
    those and the new ones.
    """
    routed = items.withColumn("leaf", F.col("words").cast("string"))
    for i in range(prefix_tokens):
        routed = routed.withColumn("_word", F.get("head", F.lit(i)))
        seen = routed.filter(F.col("_word") != WILDCARD).select(
            F.col("leaf").alias("node"), F.col("_word").alias("word"), "first_line", F.lit(1).alias("n")
        )
        if known is not None:
            seen = seen.unionByName(known.select("node", "word", "first_line", F.lit(0).alias("n")))
        children = materialize(
            seen.groupBy("node", "word").agg(F.min("first_line").alias("first_line"), F.sum("n").alias("n")),
            "children",
        )
        known = children.df
        crowded = known.groupBy("node").count().filter(F.col("count") >= max_children)
        if not crowded.isEmpty():
            oldest = Window.partitionBy("node").orderBy("first_line", "word")
            kept = materialize(
                known.withColumn("_rank", F.row_number().over(oldest))
                .filter(F.col("_rank") < max_children)
                .select(
                    F.col("node").alias("leaf"),
                    F.col("word").alias("_word"),
                    F.lit(True).alias("_kept"),
                    F.col("n").alias("_weight"),
                ),
                "kept-children",
            )
            routed = lookup_join(routed, kept, ["leaf", "_word"], "left", "_weight", "first_line")
            stays = F.col("_word").isNull() | F.col("_kept")
            routed = routed.withColumn(
                "_word", F.when(stays, F.col("_word")).otherwise(F.lit(WILDCARD))
            ).drop("_kept", "_weight")
        routed = routed.withColumn("leaf", F.concat_ws(" ", "leaf", "_word")).drop("_word")
    if prefix_tokens == 0:
        children = materialize(
            routed.select(F.lit("").alias("node"), F.lit("").alias("word"), "first_line", F.lit(0).alias("n")).limit(0),
            "children",
        )
    return routed, children


class _Clusters:
    """Clusters of word lists of one length.

    A line joins the cluster with the largest share of equal words if that reaches ``threshold``
    (ties: more wildcards, then the older cluster) and turns the differing words into wildcards.
    ``at`` lists, for a word at a place, the clusters that have it there. A cluster with enough equal
    words is on one of the line's shortest lists, so only those are looked through.
    """

    def __init__(self, length: int, threshold: float):
        self.length, self.used = length, 0
        self.least = next((n for n in range(length + 1) if n / max(length, 1) >= threshold), length + 1)
        self.codes: dict[str, int] = {WILDCARD: 0}
        self.rows = np.zeros((16, length), dtype=np.int32)
        self.wild = np.zeros(16, dtype=np.int64)
        self.at: dict[tuple[int, int], dict[int, None]] = {}

    def encode(self, words: list[str]) -> list[int]:
        codes = self.codes
        return [codes.setdefault(word, len(codes)) for word in words]

    def nearest(self, row: list[int]) -> int:
        """The cluster that a line joins, or -1."""
        if not self.used or self.length == 0:
            return self.used - 1 if not self.used else 0
        if self.least == 0:
            near = np.arange(self.used)
        else:
            lists = sorted((self.at.get(place, {}) for place in enumerate(row) if place[1]), key=len)
            lists = lists[: max(len(lists) - self.least + 1, 0)]
            near = np.array(sorted(set().union(*lists)), dtype=np.int64)
        if not len(near):
            return -1
        line = np.array(row, dtype=np.int32)
        equal = ((self.rows[near] == line) & (line > 0)).sum(axis=1)
        best = int(np.argmax(equal * (self.length + 1) + self.wild[near]))
        return int(near[best]) if equal[best] >= self.least else -1

    def open(self, row: list[int]) -> int:
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.wild = np.concatenate([self.wild, np.zeros_like(self.wild)])
        self.used += 1
        self.replace(self.used - 1, row)
        return self.used - 1

    def replace(self, cluster: int, row: list[int]) -> None:
        """Sets the words of a cluster; code 0 is the wildcard."""
        for place in enumerate(self.rows[cluster].tolist()):
            self.at.get(place, {}).pop(cluster, None)
        self.rows[cluster] = row
        for place in enumerate(row):
            if place[1]:
                self.at.setdefault(place, {})[cluster] = None
        self.wild[cluster] = row.count(0)

    def widened(self, cluster: int, row: list[int]) -> list[int] | None:
        """The words of the cluster after the line joined it, if that changes them."""
        old = self.rows[cluster].tolist()
        new = [a if a == b else 0 for a, b in zip(old, row)]
        return new if new != old else None


def _narrowed(template: str, row: list[int]) -> str:
    return " ".join(word if code else WILDCARD for word, code in zip(template.split(" "), row))


def _merge_leaf(lines: list[list[str]], seeds: list[list[str]], threshold: float):
    """Greedy merge of word lists of one length, in order, into ``seeds`` and new clusters.

    Returns the cluster of every line, its template right after the line, and the final templates.
    """
    clusters = _Clusters(len(lines[0] if lines else seeds[0]), threshold)
    for words in seeds:
        clusters.open(clusters.encode(words))
    templates = [" ".join(words) for words in seeds]
    owner, emitted = [], []
    for words in lines:
        row = clusters.encode(words)
        target = clusters.nearest(row)
        if target < 0:
            target = clusters.open(row)
            templates.append(" ".join(words))
        elif (new := clusters.widened(target, row)) is not None:
            clusters.replace(target, new)
            templates[target] = _narrowed(templates[target], new)
        owner.append(target)
        emitted.append(templates[target])
    return owner, emitted, templates


_WORDS = re.compile(r"\S+", re.ASCII).findall
_MERGED = "masked string, first_line bigint, n bigint, leaf string, leader_line bigint, emitted string, template string"


def _merge_groups(threshold: float):
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["leaf", "is_seed", "first_line"], ascending=[True, False, True])
        words = [_WORDS(text) for text in group["masked"]]
        ids, is_seed = group["first_line"].to_list(), group["is_seed"].to_numpy()
        starts = np.flatnonzero(np.r_[True, group["leaf"].to_numpy()[1:] != group["leaf"].to_numpy()[:-1]])
        leader, emitted, final = [], [], []
        for start, end in zip(starts, np.r_[starts[1:], len(group)]):
            middle = start + int(is_seed[start:end].sum())
            if middle == end:
                continue
            if end - start == 1:
                owner, seen = [0], [" ".join(words[start])]
                templates = seen
            else:
                owner, seen, templates = _merge_leaf(words[middle:end], words[start:middle], threshold)
            leaders = ids[start:middle]
            for line, cluster in zip(ids[middle:end], owner):
                if cluster == len(leaders):
                    leaders.append(line)
            leader += [leaders[cluster] for cluster in owner]
            emitted += seen
            final += [templates[cluster] for cluster in owner]
        lines = {c: group[c].to_numpy()[~is_seed] for c in ("masked", "first_line", "n", "leaf")}
        # Explicit types: a group of seeds only gives no rows.
        texts = {"emitted": np.array(emitted, dtype=object), "template": np.array(final, dtype=object)}
        return pd.DataFrame({**lines, "leader_line": np.array(leader, dtype=np.int64), **texts})

    return merge


_EVENTS = "leaf string, first_line bigint, leader_line bigint, template string"


def _history(threshold: float):
    """Merges the guesses of leaves in order; gives the seeds and the lines that open or widen a cluster.

    Rows come sorted by leaf, seeds first, then by line; they pass through, and only the clusters of one leaf stay.
    """

    def merge(frames):
        leaf, clusters, leaders, templates = None, None, [], []
        for frame in frames:
            events = []
            for own, text, line, seed in zip(frame["leaf"], frame["masked"], frame["first_line"], frame["is_seed"]):
                words = _WORDS(text)
                if own != leaf:
                    leaf, clusters, leaders, templates = own, _Clusters(len(words), threshold), [], []
                row = clusters.encode(words)
                target = -1 if seed else clusters.nearest(row)
                if target < 0:
                    clusters.open(row)
                    leaders.append(line)
                    templates.append(" ".join(words))
                elif (new := clusters.widened(target, row)) is not None:
                    clusters.replace(target, new)
                    templates[target] = _narrowed(templates[target], new)
                else:
                    continue
                events.append((own, -1 if seed else line, leaders[target], templates[target]))
            yield pd.DataFrame(events, columns=["leaf", "first_line", "leader_line", "template"])

    return merge


def _replay(threshold: float):
    """Replays a block of a leaf against the history; ``reported`` lines would open or widen a cluster."""

    def replay(lines: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
        lines, events = lines.sort_values("first_line"), events.sort_values("first_line", kind="stable")
        pending = list(zip(events["first_line"], events["leader_line"], events["template"]))[::-1]
        words = [_WORDS(text) for text in lines["masked"]]
        clusters = _Clusters(len(words[0]) if words else 0, threshold)
        number: dict[int, int] = {}
        leaders: list[int] = []
        templates: list[str] = []

        def put(leader: int, template: str) -> int:
            row = clusters.encode(_WORDS(template))
            if leader in number:
                clusters.replace(number[leader], row)
                templates[number[leader]] = template
            else:
                number[leader] = clusters.open(row)
                leaders.append(leader)
                templates.append(template)
            return number[leader]

        owner, emitted, reported = [], [], []
        for line, own in zip(lines["first_line"], words):
            while pending and pending[-1][0] < line:
                put(*pending.pop()[1:])
            wrong = False
            if pending and pending[-1][0] == line:
                target = put(*pending.pop()[1:])
            else:
                row = clusters.encode(own)
                target = clusters.nearest(row)
                new = None if target < 0 else clusters.widened(target, row)
                wrong = target < 0 or new is not None
                if target < 0:
                    target = put(line, " ".join(own))
                elif new is not None:
                    put(leaders[target], _narrowed(templates[target], new))
            owner.append(leaders[target])
            emitted.append(templates[target])
            reported.append(wrong)
        out = lines[["masked", "first_line", "n", "leaf", "block"]].copy()
        out["leader_line"] = np.array(owner, dtype=np.int64)
        out["emitted"] = np.array(emitted, dtype=object)
        out["reported"] = np.array(reported, dtype=bool)
        return out

    return replay


def _needed_words(length: Column, threshold: float) -> Column:
    """The fewest equal words of so many that reach the threshold; more than there are if none do."""
    enough = F.filter(F.sequence(F.lit(0), length), lambda n: n / F.greatest(length, F.lit(1)) >= F.lit(threshold))
    return F.coalesce(F.get(enough, F.lit(0)), length + 1)


def _placed_words(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """``keys``, place and word of the words of a text that are no wildcards, and the length of the text."""
    split = df.select(*keys, tokens(text).alias("_words"))
    placed = split.select(*keys, F.size("_words").alias("length"), F.posexplode("_words").alias("place", "word"))
    return placed.filter(F.col("word") != WILDCARD)


def _sent(events: DataFrame, dealt: DataFrame, blocks: DataFrame, threshold: float) -> DataFrame:
    """The events that a block needs: those before its end, of clusters that one of its lines might join.

    A line that joins a cluster has enough of the words that the cluster was opened with; so it has one of the few
    that are rarest among the blocks, and only these are looked up.
    """
    known = events.withColumnsRenamed({"first_line": "_at"})
    if threshold <= 0:
        return known.join(blocks, "leaf").filter(F.col("_at") <= F.col("last_line")).drop("last_line")
    placed = _placed_words(dealt, "masked", "leaf", "block")
    # Under attributes of its own, as it meets the lines again.
    own_names = F.concat("leaf").alias("leaf"), (F.col("block") + 0).alias("block")
    words_of_blocks = stored(placed.select(*own_names, "place", "word").distinct(), "block-words")
    held = words_of_blocks.df
    spread = held.groupBy("leaf", "place", "word").agg(F.count(F.lit(1)).alias("_blocks"))
    opening = events.groupBy("leaf", "leader_line").agg(F.min_by("template", "first_line").alias("template"))
    words = _placed_words(opening, "template", "leaf", "leader_line").join(spread, ["leaf", "place", "word"], "left")
    own = Window.partitionBy("leaf", "leader_line")
    # Words that a seed has lost to wildcards count as missing.
    places = words.withColumns(
        {
            "_rank": F.row_number().over(own.orderBy(F.coalesce("_blocks", F.lit(0)), "place")),
            "_left": F.count(F.lit(1)).over(own) - _needed_words(F.col("length"), threshold) + 1,
        }
    )
    rare = places.filter((F.col("_rank") <= F.col("_left")) & F.col("_blocks").isNotNull()).select("leaf", "leader_line", "place", "word")
    near = materialize(rare.join(held, ["leaf", "place", "word"]).select("leaf", "leader_line", "block").distinct(), "block-clusters")
    words_of_blocks.drop()
    sent = known.join(near.df, ["leaf", "leader_line"]).join(blocks, ["leaf", "block"])
    # Lines without words all join the one cluster of theirs.
    wordless = known.filter(F.col("leaf") == "0").join(blocks, "leaf")
    sent = sent.select(wordless.columns).unionByName(wordless)
    return sent.filter(F.col("_at") <= F.col("last_line")).drop("last_line")


def _merge_in_blocks(items: DataFrame, threshold: float) -> tuple[DataFrame, list[Table]]:
    """The merge of large leaves: columns of ``_MERGED``, and the tables to drop once it is stored.

    A round replays only blocks that end behind the first line that the round before has found in their leaf.
    """
    seeds = items.filter("is_seed").select("masked", "first_line", "leaf", "is_seed")
    lines = items.filter("not is_seed").select("masked", "first_line", "n", "leaf")
    size = lines.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    # Ranges of leaf and line: a block is the part of a leaf that lies in one partition.
    dealt = lines.repartitionByRange(size // BLOCK_LINES + 1, "leaf", "first_line")
    texts = stored(dealt.withColumn("block", F.spark_partition_id()), "leaf-blocks")
    dealt = texts.df
    # Under attributes of its own, as it meets the lines again.
    blocks = dealt.select(F.concat("leaf").alias("leaf"), (F.col("block") + 0).alias("block"), (F.col("first_line") + 0).alias("_line"))
    blocks = materialize(blocks.groupBy("leaf", "block").agg(F.max("_line").alias("last_line")), "block-ends").df
    leaves = blocks.select("leaf").distinct().count()
    schema = "masked string, first_line bigint, n bigint, leaf string, block int, leader_line bigint, emitted string, reported boolean"
    guess = lines.select("masked", "first_line", "leaf", F.lit(False).alias("is_seed")).limit(0)
    replayed, stale, asked = None, blocks, None
    while True:
        ordered = guess.unionByName(seeds).repartition(leaves, "leaf")
        ordered = ordered.sortWithinPartitions("leaf", F.desc("is_seed"), "first_line")
        events = stored(ordered.mapInPandas(_history(threshold), _EVENTS), "leaf-history")
        again = dealt.join(stale.select("leaf", "block"), ["leaf", "block"], "left_semi")
        sent = _sent(events.df, again, stale, threshold)
        # The events of a round go when nobody holds what is sent of them, at the latest with this function.
        weakref.finalize(sent, events.drop).atexit = False
        pairs = again.groupBy("leaf", "block").cogroup(sent.withColumnRenamed("_at", "first_line").groupBy("leaf", "block"))
        new = stored(pairs.applyInPandas(_replay(threshold), schema), "leaf-replay", {"emitted": "masked"})
        if replayed is not None:
            kept = replayed.df.join(stale.select("leaf", "block"), ["leaf", "block"], "left_anti")
            both = stored(kept.unionByName(new.df), "leaf-replay", {"emitted": "masked"})
            replayed.drop()
            new.drop()
            new = both
        replayed = new
        found = replayed.df.filter("reported").select("masked", "first_line", "leaf", F.lit(False).alias("is_seed"))
        fresh = found.join(guess.select("leaf", "first_line"), ["leaf", "first_line"], "left_anti")
        fresh = stored(fresh.select("masked", "first_line", "leaf", "is_seed"), "leaf-reports")
        if fresh.rows == 0:
            break
        since = fresh.df.groupBy("leaf").agg(F.min("first_line").alias("_since"))
        stale = materialize(blocks.join(since, "leaf").filter("last_line >= _since").drop("_since"), "stale-blocks").df
        grown = stored(guess.unionByName(fresh.df), "leaf-guess")
        for used in (fresh, asked):
            if used is not None:
                used.drop()
        asked, guess = grown, grown.df
    texts.drop()
    final = events.df.groupBy("leaf", "leader_line").agg(F.max_by("template", "first_line").alias("template"))
    final = stored(final, "leaf-templates")
    columns = [c.split()[0] for c in _MERGED.split(", ")]
    merged = lookup_join(replayed.df.drop("reported", "block"), final, ["leaf", "leader_line"], "inner").select(columns)
    return merged, [t for t in (fresh, asked, replayed, final) if t is not None]


def _merge(
    collapsed: DataFrame,
    seeds: DataFrame | None,
    known: DataFrame | None,
    options: Mining,
) -> tuple[Table, Table]:
    """Clusters of distinct masked lines; seeds are the clusters of earlier chunks."""
    items, children = route(collapsed.drop("raw_bytes"), known, options.prefix_tokens, options.max_children)
    items = items.drop("head").withColumn("is_seed", F.lit(False))
    if seeds is not None:
        items = items.unionByName(
            seeds.select(
                F.col("template").alias("masked"),
                F.col("leader_line").alias("first_line"),
                F.lit(0).cast("bigint").alias("n"),
                F.size(tokens("template")).alias("words"),
                "leaf",
                F.lit(True).alias("is_seed"),
            )
        )
        items = materialize(items, "routed").df
    sizes = items.filter("not is_seed").groupBy("leaf").agg(
        F.count(F.lit(1)).alias("_lines"), F.coalesce(F.sum("words"), F.lit(0)).alias("_words")
    )
    sizes = materialize(sizes, "leaf-sizes")
    total = sizes.df.agg(
        F.coalesce(F.sum("_lines"), F.lit(0)).alias("lines"),
        F.coalesce(F.sum("_words"), F.lit(0)).alias("words"),
        F.coalesce(F.max("_lines"), F.lit(0)).alias("most"),
    ).first()
    blocked, used = None, []
    if total["most"] > BLOCK_LINES:
        large = materialize(sizes.df.filter(F.col("_lines") > BLOCK_LINES).select("leaf", "_lines"), "large-leaves")
        whole = lookup_join(items, large, ["leaf"], "left", "_lines", "first_line")
        blocked, used = _merge_in_blocks(whole.filter(F.col("_lines").isNotNull()).drop("_lines"), options.similarity)
        items = whole.filter(F.col("_lines").isNull()).drop("_lines")
    cores = items.sparkSession.sparkContext.defaultParallelism
    groups = max(total["lines"] // GROUP_LINES, total["words"] // GROUP_WORDS, min(3 * cores, total["lines"] // 500)) + 1
    packed = items.drop("words").withColumn("_group", F.pmod(F.xxhash64("leaf"), F.lit(groups)))
    merged = (
        packed.repartition(min(groups, 20_000), "_group")
        .groupBy("_group")
        .applyInPandas(_merge_groups(options.similarity), _MERGED)
    )
    if blocked is not None:
        merged = merged.unionByName(blocked)
    # What a chunk adds to a model stays in use, and its checkpoints go with the model.
    merged = stored(merged, "merged", {"emitted": "masked", "template": "masked"}) if seeds is None else materialize(merged, "merged")
    for table in used:
        table.drop()
    return merged, children


def mine_templates(df: DataFrame, options: Mining = Mining()) -> Model:
    """Learn the clusters of ``(line_no, raw, masked)`` rows."""
    collapsed = collapsed_table(df, options)
    model = mine_collapsed(collapsed.df, options)
    collapsed.drop()
    return model


def collapsed_table(df: DataFrame, options: Mining = Mining(), with_raw: bool = False) -> Table:
    """Distinct masked lines with their routing words; ``with_raw`` brings the first raw line of each along."""
    same = F.col("raw").eqNullSafe(F.col("masked"))
    first = F.struct(F.when(~same, F.col("raw")).alias("text"), same.alias("same"))
    carried = [F.min_by(first, "line_no").alias("_raw")] if with_raw else []
    rows = with_head(df.groupBy("masked").agg(*_collapsed(), *carried), options.prefix_tokens)
    if with_raw:
        # Most lines hold no variable field, and then the masked text stands for both.
        rows = rows.withColumn("raw", F.when(F.col("_raw.same"), F.col("masked")).otherwise(F.col("_raw.text"))).drop("_raw")
    like = {"raw": "masked"} if with_raw else {}
    return stored(rows, "collapsed", like, lines=F.sum("n"), raw_bytes=F.sum("raw_bytes"))


def mine_collapsed(collapsed: DataFrame, options: Mining = Mining()) -> Model:
    """``mine_templates`` on the result of ``collapsed_table``."""
    return mine_merged(collapsed, options)[0]


def mine_merged(collapsed: DataFrame, options: Mining = Mining(), lazy: bool = False) -> tuple[Model, Table]:
    """``mine_collapsed``, with the assignments that also hold the template of each line.

    If ``lazy``, the templates are read from there each time they are asked for, and not stored once more.
    """
    merged, children = _merge(collapsed, None, None, options)
    counts = merged.df.groupBy("leader_line").agg(F.sum("n").alias("n"))
    leaders = merged.df.filter("first_line = leader_line")
    # Numbers are found without texts, which then move once at most.
    leaders = leaders.select("leader_line", F.xxhash64("masked").alias("_key"), "leaf", "template", "first_line")
    ids = dense_ids(leaders.select("leader_line", "_key"), "leader_line", "cluster_id").join(counts, "leader_line")
    ids = materialize(ids, "cluster-ids")
    templates = lookup_join(leaders, ids, ["leader_line", "_key"], "inner")
    templates = templates.select("leader_line", "leaf", "template", "first_line", "cluster_id", "n")
    templates = Table(templates) if lazy else stored(templates, "templates")
    return Model(templates, merged.narrowed("masked", "first_line", "n", "leader_line", "emitted"), children), merged


def extend_model(df: DataFrame, model: Model, options: Mining = Mining()) -> tuple[Model, Table]:
    """Learn from a further chunk of ``(line_no, raw, masked)`` rows.

    Masked lines seen before keep their cluster; new ones go through the same greedy merge with the
    stored clusters in front. The second result holds the assignments of the new masked lines.
    """
    collapsed = collapsed_table(df, options)
    extended = extend_collapsed(collapsed.df, model, options)
    collapsed.drop()
    return extended


def extend_collapsed(
    collapsed: DataFrame, model: Model, options: Mining = Mining(), last: int | None = None
) -> tuple[Model, Table]:
    """``extend_model`` on the result of ``collapsed_table``.

    The model may be only the part that the lines can touch (see ``touched_leaves``); then ``last`` must be the
    highest cluster id of the whole one.
    """
    past = model.assignments.df.select("masked", "leader_line")
    seen = collapsed.join(past, "masked")
    unseen = collapsed.join(past, "masked", "left_anti")
    merged, children = _merge(unseen, model.templates.df, model.children.df, options)
    nothing = {"cluster_id": "int", "leaf": "string", "template": "string"}
    parts = [
        model.templates.df.withColumn("_age", F.lit(0)),
        merged.df.withColumn("cluster_id", F.lit(None).cast("int")).withColumn("_age", F.lit(1)),
        seen.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()}).withColumn("_age", F.lit(-1)),
    ]
    columns = ["leader_line", "cluster_id", "leaf", "template", "n", "first_line", "_age"]
    every = parts[0].select(columns)
    for part in parts[1:]:
        every = every.unionByName(part.select(columns))
    clusters = materialize(
        every.groupBy("leader_line").agg(
            F.max("cluster_id").alias("cluster_id"),
            F.max_by("leaf", "_age").alias("leaf"),
            F.max_by("template", "_age").alias("template"),
            F.sum("n").alias("n"),
            F.min("first_line").alias("first_line"),
        ),
        "clusters",
    ).df
    if last is None:
        last = clusters.agg(F.max("cluster_id")).first()[0] or 0
    old = clusters.filter(F.col("cluster_id").isNotNull())
    new = dense_ids(clusters.filter(F.col("cluster_id").isNull()).drop("cluster_id"), "leader_line", "cluster_id", last)
    templates = materialize(old.unionByName(new), "templates")
    fresh = merged.narrowed("masked", "first_line", "n", "leader_line", "emitted")
    known = model.assignments.df.select(fresh.df.columns).unionByName(fresh.df)
    return Model(templates, Table(known), children), fresh


def touched_leaves(collapsed: DataFrame, assignments: DataFrame, children: DataFrame, options: Mining = Mining()) -> DataFrame:
    """The leaves whose clusters a chunk can join or change: those of its lines seen before, and of its new ones."""
    seen = collapsed.join(assignments.select("masked", "leaf"), "masked").select("leaf")
    unseen = collapsed.join(assignments.select("masked"), "masked", "left_anti")
    routed, _ = route(unseen.drop("raw_bytes"), children, options.prefix_tokens, options.max_children)
    return seen.union(routed.select("leaf")).distinct()


def assign_templates(df: DataFrame, model: Model, online: bool = False, parameters: bool = False) -> DataFrame:
    """Add ``template`` and ``cluster_id`` to every ``(line_no, masked, …)`` row.

    ``online`` gives the template as it stood right after the masked line was first seen.
    ``parameters`` also adds the words of the line that the template leaves open.
    """
    lookup = template_lookup(model, online)
    out = lookup_join(df, lookup, ["masked"], "left", "_lines").drop("_lines", "_first_line")
    return out.withColumn("parameters", extract_parameters("masked", "template")) if parameters else out


def template_lookup(model: Model, online: bool = False) -> Table:
    """masked -> template and cluster_id, with the number of lines behind it and the first of them."""
    clusters = model.templates.narrowed("leader_line", "cluster_id", "template", F.col("n").alias("_weight"))
    known = model.assignments.df.select("masked", "first_line", "leader_line", "n", "emitted")
    joined = lookup_join(known, clusters, ["leader_line"], "inner", "_weight", "first_line")
    return materialize(
        joined.select(
            "masked",
            F.col("emitted" if online else "template").alias("template"),
            "cluster_id",
            F.col("n").alias("_lines"),
            F.col("first_line").alias("_first_line"),
        ),
        "lookup",
    )


def match_templates(df: DataFrame, model: Model, options: Mining = Mining()) -> tuple[DataFrame, Model]:
    """Assign a further chunk with a model learnt before, extending the model where needed."""
    extended, _ = extend_model(df, model, options)
    return assign_templates(df, extended), extended


def fast_templates(df: DataFrame) -> DataFrame:
    """Templates without similarity merging: the digit-free form of the masked line, in SQL only."""
    return df.withColumn("template", fast_template("masked"))


def unique_templates(df: DataFrame, by: str | None = None) -> DataFrame:
    count = F.countDistinct("template").alias("unique_templates")
    return df.groupBy(by).agg(count) if by else df.agg(count)


def save_model(model: Model, path: str) -> None:
    model.templates.df.write.mode("overwrite").parquet(f"{path}/templates")
    model.assignments.df.write.mode("overwrite").parquet(f"{path}/assignments")
    model.children.df.write.mode("overwrite").parquet(f"{path}/children")


def load_model(spark, path: str) -> Model:
    names = ("templates", "assignments", "children")
    return Model(*[Table(spark.read.parquet(f"{path}/{name}")) for name in names])
