"""Jaccard join over word shingles by T-occurrence search.

Two documents link when their shingle sets overlap by a given share of the union. Equal sets are one class from
the start, only one document of each goes on. The search is prepared by the prefix rule, twice. By the order of their
hashes, two linking sets have k shingles in common among their first n - ceil(share * n) + k. These are counted over all
documents, and by the order of these counts, rarest first, one of the first n - ceil(share * n) + 1 of them is shared again.
Passages that many documents share so find no candidates, and documents with enough shingles of their own drop out. Documents
that share a rare shingle at a compatible size, and whose sketches do not differ too much, are candidates of each other.
Where very many share it, only as many of these pairs are kept as connect them. Candidates form groups; nothing but shingle names,
sketches and ids is moved for that, and only members of a group have their sets shuffled.

Inside a group every document is a query to the inverted lists of the group (DivideSkip): the short lists are
merged by counting, documents below the count that the long lists could still make up for are skipped, and the long
lists are probed by binary search for the rest. Documents that reach the required overlap are retained and
checked exactly. A pair whose documents are known to be connected needs no probing. A large group is cut into pieces
that are searched apart; then one document of every component found stands for it and the search is
repeated among these while that merges anything; last, candidates that are still in different components are compared:
pairs of small buckets one by one; in buckets of very many documents the sketches tell which may still link to another
component, and these are searched among each other, so no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.llm.common import WordHasher, checked_join, components, discard, mix64, scratch, sequence_names, written

SHINGLE = 3
# Required overlap in hundredths of the union.
PERCENT = 90
# Documents of a piece of a candidate group, and shingles of all of them.
PIECE = 1_024
PIECE_SHINGLES = 1 << 19
# Documents of a bucket that are compared by their sketches in one task; larger ones go on as they are.
SMALL = 64
# Rows of a larger bucket that one task compares by their sketches with as many others.
BLOCK = 16_384
# Bits of a sketch, and tasks that small buckets are dealt to for each shuffle partition.
SKETCH = 512
DEALT = 4
# Texts whose sets a task holds at a time.
SLICE = 256
SEED = 23


class Shingler:
    """Sorted distinct shingle names of a text, letters A to Z in lower case."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.hasher = size, WordHasher(SEED)

    def __call__(self, text: str | None) -> np.ndarray:
        # Lowering bytes touches A to Z only.
        words = self.hasher((text or "").encode("utf-8", "surrogatepass").lower())[0]
        if not len(words):
            return words
        return np.unique(sequence_names(words, min(self.size, len(words)), SEED))


def needed(n: np.ndarray | int, percent: int = PERCENT):
    """Shingles of a set of ``n`` that any linking set must share: ceil(percent / 100 * n)."""
    return -(-percent * n // 100)


def asked(n: np.ndarray | int, percent: int = PERCENT):
    """Shingles that the hash prefixes of a set of ``n`` and of a linking set, at least as large, have in common."""
    return np.maximum((n - needed(n, percent)) // 2, 1)


def sketch(names: np.ndarray, bits: int = SKETCH) -> bytes:
    """For every value that the names have in their last bits, whether their number is odd; ``bits`` is a power of two.

    Two sketches differ in no more bits than the sets have shingles that only one of them holds.
    """
    odd = np.bincount((names & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, two names of the whole set, its sketch, and its hash prefix: the shingles of the smallest names."""

    def cut(frames):
        shingler = Shingler(size)
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                names = shingler(text)
                n = len(names)
                prefix = names[: n - needed(n, percent) + asked(n, percent)]
                with np.errstate(over="ignore"):
                    whole = [int(mix64(names ^ np.uint64(s)).sum().view(np.int64)) for s in (0x5851F42D, 0x14057B7E)]
                rows.append((doc, n, *whole, sketch(names), prefix.tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "name_a", "name_b", "sketch", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(cut, f"doc_id {kind}, n bigint, name_a bigint, name_b bigint, sketch binary, prefix binary")


def _rarest(rows: DataFrame, percent: int) -> DataFrame:
    """Of the rows (name, rep, n) of hash prefixes those that candidates are found by.

    Counted are all documents. Of m shingles in a hash prefix at least k are shared with any linking set, so by any
    order two linking prefixes have one of their first m - k + 1 shingles in common; the order is by rarity.
    Shingles of one document come first and find nothing, so a document with enough of them drops out.
    """
    counts = rows.groupBy("name").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    shared = written(counts, "shared-shingles")
    kept = written(rows.join(shared, "name"), "shared-rows")
    discard(shared)
    fit = f"(({percent} * n + 99) div 100)"
    prefix = f"least(n, n - {fit} + greatest((n - {fit}) div 2, 1))"
    # The smallest size that links asks for least.
    k = f"greatest(({fit} - ({percent} * {fit} + 99) div 100) div 2, 1)"
    own = Window.partitionBy("rep", "n")
    ranked = kept.withColumns({"_at": F.row_number().over(own.orderBy("held", "name")), "_shared": F.count(F.lit(1)).over(own)})
    chosen = ranked.filter(F.expr(f"_at <= {prefix} - {k} + 1 - ({prefix} - _shared)")).select("name", "rep", "n")
    out = written(chosen, "rarest-rows")
    discard(kept)
    return out


def _buckets(classes: DataFrame, percent: int) -> DataFrame:
    """bucket, id, n and number of members of documents that share a rare prefix shingle: a stored table."""
    kind = classes.schema["rep"].dataType.simpleString()

    def names(frames):
        for frame in frames:
            parts = [np.frombuffer(p, dtype=np.int64) for p in frame["prefix"]]
            counts = [len(p) for p in parts]
            yield pd.DataFrame(
                {
                    "name": np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64),
                    "rep": np.repeat(frame["rep"].to_numpy(), counts),
                    "n": np.repeat(frame["n"].to_numpy(), counts),
                }
            )

    every = written(classes.select("rep", "n", "prefix").mapInPandas(names, f"name bigint, rep {kind}, n bigint"), "shingles")
    rows = _rarest(every, percent)
    discard(every)
    sizes = rows.groupBy("name").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    # Two shingles under one number would only bring more documents together.
    out = rows.join(sizes, "name").select(F.xxhash64("name").alias("bucket"), F.col("rep").alias("id"), "n", "members")
    out = written(out, "buckets")
    discard(rows)
    return out


def _near(buckets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents of one small bucket whose sizes and sketches allow a link: a stored table."""
    sketches = classes.select(F.col("rep").alias("id"), "n", "sketch")
    small = buckets.filter(F.col("members") <= SMALL).select("bucket", "id", "n").join(sketches, ["id", "n"])
    kind = classes.schema["rep"].dataType.simpleString()

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bucket", "id"], kind="stable")
        ids, sizes, bucket = (frame[c].to_numpy() for c in ("id", "n", "bucket"))
        bits = np.frombuffer(b"".join(frame["sketch"]), dtype=np.uint64).reshape(len(frame), -1)
        found = []
        # Each row against the one so many places behind it, as long as any bucket reaches that far.
        for apart in range(1, len(frame)):
            low = np.flatnonzero(bucket[apart:] == bucket[:-apart])
            if not len(low):
                break
            high = low + apart
            least, most = np.minimum(sizes[low], sizes[high]), np.maximum(sizes[low], sizes[high])
            # With so many shingles in common the sets differ in at most the rest of both.
            apart_at_most = _apart(sizes[low], sizes[high], percent)
            differ = np.bitwise_count(bits[low] ^ bits[high]).sum(axis=1, dtype=np.int64)
            fits = (100 * least >= percent * most) & (differ <= apart_at_most) & (ids[low] != ids[high])
            found.append((ids[low[fits]], ids[high[fits]]))
        a, b = (np.concatenate([f[k] for f in found]) if found else ids[:0] for k in (0, 1))
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    tasks = DEALT * int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = small.withColumn("task", F.pmod(F.col("bucket"), F.lit(tasks)))
    return written(dealt.groupBy("task").applyInPandas(compare, f"a {kind}, b {kind}").distinct(), "near-pairs")


def _apart(sizes_a: np.ndarray, sizes_b: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that only one of two linking sets of these sizes can hold, at most."""
    return sizes_a + sizes_b - 2 * -(-percent * (sizes_a + sizes_b) // (100 + percent))


def _crowded(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """bucket, id, n, sketch and number of pieces of documents of large buckets: a stored table."""
    sketches = classes.select(F.col("rep").alias("id"), "n", "sketch")
    large = buckets.filter(F.col("members") > SMALL).join(sketches, ["id", "n"])
    pieces = F.ceil(F.col("members") / BLOCK).cast("int").alias("pieces")
    return written(large.select("bucket", "id", "n", "sketch", pieces), "large-buckets")


def _met(crowded: DataFrame) -> DataFrame:
    """The rows in tasks (bucket, low, high) of two pieces of a bucket, so that any two rows of a bucket meet."""
    own, other = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    rows = crowded.withColumn("own", own).withColumn("_other", other)
    return rows.withColumns({"low": F.least("own", "_other"), "high": F.greatest("own", "_other")}).drop("_other", "pieces")


def _alike(frame: pd.DataFrame, labels: np.ndarray, percent: int):
    """Of rows ordered by n: a row and later ones of other labels whose sizes and sketches allow a link, row by row."""
    sizes, own = frame["n"].to_numpy(), frame["own"].to_numpy()
    bits = np.frombuffer(b"".join(frame["sketch"]), dtype=np.uint64).reshape(len(frame), -1)
    within = bool(len(frame)) and frame["low"].iat[0] == frame["high"].iat[0]
    ends = np.searchsorted(sizes, 100 * sizes // percent, side="right")
    for i, end in enumerate(ends.tolist()):
        at = np.flatnonzero((labels[i + 1 : end] != labels[i]) & (within | (own[i + 1 : end] != own[i]))) + i + 1
        differ = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64)
        at = at[differ <= _apart(sizes[at], sizes[i], percent)]
        if len(at):
            yield i, at


def _stars(crowded: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect the documents of a large bucket whose sizes and sketches allow a link: a stored table.

    Only rows of pieces that are not connected yet are compared, and an edge is kept if it connects more, so thousands of near copies
    give no more edges than there are copies.
    """
    kind = crowded.schema["id"].dataType.simpleString()

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "id"], kind="stable")
        ids, edges = frame["id"].to_numpy(), []
        labels = pd.factorize(ids)[0]
        for i, at in _alike(frame, labels, percent):
            joined, first = np.unique(labels[at], return_index=True)
            edges += [(ids[i], ids[j]) for j in at[first].tolist()]
            labels[np.isin(labels, joined)] = labels[i]
        return pd.DataFrame(edges, columns=["a", "b"])

    found = _met(crowded).groupBy("bucket", "low", "high").applyInPandas(compare, f"a {kind}, b {kind}")
    return written(found.distinct(), "bucket-stars")


def _open(crowded: DataFrame, percent: int) -> DataFrame:
    """The ids of rows (with their label) whose size and sketch allow a link to a row of their bucket under another label."""
    kind = crowded.schema["id"].dataType.simpleString()

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "id"], kind="stable")
        found = np.zeros(len(frame), dtype=bool)
        for i, at in _alike(frame, pd.factorize(frame["label"])[0], percent):
            found[i] = found[at] = True
        return frame.loc[found, ["id"]].drop_duplicates()

    found = _met(crowded).groupBy("bucket", "low", "high").applyInPandas(compare, f"id {kind}")
    return written(found.distinct(), "open-ids")


def _with_sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """``members`` (id and further columns) with their sets as a stored table: id, names and those columns."""
    more = [c for c in members.columns if c != "id"]
    rows = checked_join(docs, members.withColumnRenamed("id", "doc_id"), ["doc_id"], "inner").select("doc_id", "text", *more)

    def cut(frames):
        shingler = Shingler(size)
        for frame in frames:
            for some in (frame.iloc[i : i + SLICE] for i in range(0, len(frame), SLICE)):
                out = some.drop(columns="text").rename(columns={"doc_id": "id"})
                yield out.assign(names=[shingler(text).tobytes() for text in some["text"]])

    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ["id", *more]) + ", names binary"
    return written(rows.mapInPandas(cut, schema), "group-sets")


class InvertedLists:
    """Inverted lists of the documents of a task, for T-occurrence queries."""

    def __init__(self, sets: list[np.ndarray]):
        names = np.concatenate(sets)
        docs = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(names, kind="stable")
        self.docs = docs[order]  # ascending inside each list
        names = names[order]
        first = np.concatenate([[True], names[1:] != names[:-1]])
        self.starts = np.flatnonzero(first)
        self.ends = np.append(self.starts[1:], len(names))
        self.names = names[self.starts]
        self.total = len(sets)
        # List number and document in one number: ascending, for binary probes.
        self.keys = np.repeat(np.arange(len(self.starts)), self.ends - self.starts) * self.total + self.docs

    def search(self, query: np.ndarray, at_least: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents, among the ``wanted`` ones, on at least ``at_least`` lists of the query, and on how many."""
        lists = np.searchsorted(self.names, query)
        lengths = self.ends[lists] - self.starts[lists]
        lists = lists[np.argsort(lengths, kind="stable")]
        # So many long lists are left to probing that a document must be on ``least`` of the short ones.
        least = max(1, at_least // 10)
        short, long = np.split(lists, [len(lists) - (at_least - least)])
        merged = np.concatenate([self.docs[s:e] for s, e in zip(self.starts[short], self.ends[short])])
        counts = np.bincount(merged, minlength=self.total)
        found = np.flatnonzero((counts >= least) & wanted)
        counts = counts[found]
        for some in np.array_split(long, max(1, len(long) // 64)):
            if not len(found) or not len(some):
                break
            keys = some[None, :] * self.total + found[:, None]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            counts = counts + (self.keys[at] == keys).sum(axis=1)
        keep = counts >= at_least
        return found[keep], counts[keep]


def _search(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Edges that connect what links in a task: every ``query`` row is sought among the other rows.

    ``label`` tells which rows are known to be connected.
    """
    frame = frame.sort_values("id", kind="stable").reset_index(drop=True)
    ids, sizes = frame["id"].to_numpy(), frame["names"].map(len).to_numpy() // 8
    labels = pd.factorize(frame["label"])[0]
    edges: list[tuple] = []
    if len(frame) > 1:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in frame["names"]]
        lists = InvertedLists(sets)
        # A bit for each shingle of most sets.
        bits = max(SKETCH, 1 << int(np.median(sizes)).bit_length())
        sketches = np.frombuffer(b"".join(sketch(x, bits) for x in sets), dtype=np.uint64).reshape(len(sets), -1)
        for i in np.flatnonzero(frame["query"].to_numpy()).tolist():
            n = int(sizes[i])
            fits = (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)) & (labels != labels[i])
            at = np.flatnonzero(fits)
            differ = np.bitwise_count(sketches[at] ^ sketches[i]).sum(axis=1, dtype=np.int64)
            fits[at] = differ <= _apart(sizes[at], n, percent)
            if not fits.any():
                continue
            found, shared = lists.search(sets[i], needed(n, percent), fits)
            linked = found[100 * shared >= percent * (n + sizes[found] - shared)]
            for j in linked.tolist():
                if labels[i] != labels[j]:
                    edges.append((ids[i], ids[j]))
                    labels[labels == labels[j]] = labels[i]
    return pd.DataFrame(edges, columns=["a", "b"])


def _find_links(tasks: DataFrame, keys: list[str], percent: int) -> DataFrame:
    kind = tasks.schema["id"].dataType.simpleString()
    out = tasks.groupBy(*keys).applyInPandas(lambda frame: _search(frame, percent), f"a {kind}, b {kind}")
    return written(out, "links")


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (id and more) with the component that the links found so far put them in."""
    found = written(components(links).withColumnRenamed("node", "id"), "link-components")
    return rows.join(found, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")


def _dealt(rows: DataFrame, piece: int) -> DataFrame:
    """Rows (group, id, n) with the number of their piece inside the group, and the number of pieces."""
    most = F.greatest(F.count(F.lit(1)) / piece, F.sum("n") / PIECE_SHINGLES)
    sizes = rows.groupBy("group").agg(F.ceil(most).cast("int").alias("pieces"))
    dealt = rows.join(sizes, "group")
    return dealt.withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))


def _checked(pairs: DataFrame, names: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, counted exactly."""
    kinds = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(names.withColumnsRenamed({"id": "a", "names": "left"}), "a").join(names.withColumnsRenamed({"id": "b", "names": "right"}), "b")

    def check(frames):
        for frame in frames:
            keep = []
            for left, right in zip(frame["left"], frame["right"]):
                left, right = np.frombuffer(left, dtype=np.uint64), np.frombuffer(right, dtype=np.uint64)
                shared = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * shared >= percent * (len(left) + len(right) - shared))
            yield frame.loc[keep, ["a", "b"]]

    return written(both.select("a", "b", "left", "right").mapInPandas(check, f"a {kinds}, b {kinds}"), "checked-pairs")


def _links(docs: DataFrame, members: DataFrame, near: DataFrame, crowded: DataFrame, size: int, percent: int, piece: int) -> DataFrame:
    """Edges that connect whatever links connect; ``members`` are the rows (group, id, n) of the candidate groups.

    Names and numbers are dealt first; sets move once they have their place. Candidates are ``near`` pairs and the documents of
    a large bucket (``crowded``) whose sizes and sketches allow a link.
    """
    sets = _with_sets(docs, written(_dealt(members, piece), "candidate-groups"), size)
    rows = sets.withColumn("label", F.col("id")).withColumn("query", F.lit(True))
    links = _find_links(rows, ["group", "piece"], percent)
    large = sets.filter("pieces > 1").select("group", "id", "n", "names")
    if large.isEmpty():
        return links
    ids = large.select("group", "id", "n").distinct()
    # Rows under one id may have different sets.
    names = large.select("id", "names").distinct()
    while True:
        # One document of every component stands for it.
        heads = _dealt(_labelled(ids, links).filter("id = label"), piece)
        heads = heads.join(names, "id").withColumn("query", F.lit(True))
        more = _find_links(heads, ["group", "piece"], percent)
        if more.isEmpty():
            break
        both = written(links.union(more), "links")
        discard(links, more)
        links = both
    # Only candidates can link. A pair within one component has nothing left to find, and neither has such a bucket.
    labels = written(_labelled(ids, links).select("id", "label").distinct(), "labels")
    apart = near.join(labels.withColumnsRenamed({"id": "a", "label": "_a"}), "a").join(labels.withColumnsRenamed({"id": "b", "label": "_b"}), "b")
    more = _checked(apart.filter("_a <> _b").select("a", "b"), names, percent)
    if not more.isEmpty():
        links = written(links.union(more), "links")
    placed = written(crowded.join(_labelled(ids.select("id", "group"), links), "id"), "bucket-labels")
    place = F.xxhash64("id", "n", "sketch")
    kinds = placed.groupBy("bucket").agg(
        (F.min("label") < F.max("label")).alias("mixed"),
        F.struct(F.count(F.lit(1)), F.bit_xor(place), F.sum(F.shiftright(place, 24)), F.min("id"), F.max("id")).alias("same"),
    )
    # Of buckets with the same documents one is enough.
    open_ones = kinds.filter("mixed").groupBy("same").agg(F.min("bucket").alias("bucket")).select("bucket")
    opened = _open(placed.join(written(open_ones, "open-buckets"), "bucket").drop("group"), percent)
    if opened.isEmpty():
        return links
    rows = written(_dealt(_labelled(ids.join(opened, "id"), links), piece), "open-rows")
    sizes = rows.groupBy("group", "label").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("group").agg(F.max_by("label", F.struct("size", "label")).alias("largest"))
    rows = rows.join(largest, "group")
    # A query meets one piece of its group at a time, in tasks of one piece of queries and one of rows.
    asked = rows.filter("label <> largest").withColumn("target", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    asked = asked.withColumn("query", F.lit(True)).withColumn("source", F.col("piece"))
    sources = asked.select("group", "source").distinct()
    met = rows.withColumn("target", F.col("piece")).withColumn("query", F.lit(False)).join(sources, "group")
    wanted = asked.unionByName(met.select(asked.columns)).join(names, "id")
    return links.union(_find_links(wanted, ["group", "source", "target"], percent))


def link(
    docs: DataFrame,
    percent: int = PERCENT,
    size: int = SHINGLE,
    piece: int = PIECE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Component of every document under links of shingle sets with ``percent`` hundredths in common.

    Columns: doc_id, n_shingles, component_id (smallest doc_id reachable by links). Texts without words, null texts
    included, have no shingles and stand alone; fewer words than a shingle count as one shingle. Equal texts share a
    component; rows under one id are one node; a null id stands alone. Other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with scratch() as keep:
        return keep(_components(slim, percent, size, piece), "jaccard-components")


def _components(slim: DataFrame, percent: int, size: int, piece: int) -> DataFrame:
    sets = written(_sets(slim, size, percent), "shingle-sets")
    named = sets.filter("n > 0 and doc_id is not null")
    by_set = named.groupBy("n", "name_a", "name_b").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix"))
    prefixes = written(by_set, "shingle-prefixes")
    # Prefixes are no longer needed once the buckets are there.
    known = written(sets.drop("prefix", "sketch"), "set-names")
    discard(sets)
    sets, buckets = known, _buckets(prefixes, percent)
    classes = written(prefixes.drop("prefix"), "shingle-classes")
    discard(prefixes)
    near, crowded = _near(buckets, classes, percent), _crowded(buckets, classes)
    discard(buckets)
    groups = components(near.union(_stars(crowded, percent)))
    groups = groups.select(F.col("node").alias("rep"), F.col("component").alias("group"))
    # Rows repeated under an id carry the same label, so they are never compared.
    members = classes.join(groups, "rep").groupBy("group", F.col("rep").alias("id")).agg(F.max("n").alias("n"))
    found = components(_links(slim, members, near, crowded, size, percent, piece))
    known = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("n", "name_a", "name_b", F.coalesce("component", "rep").alias("component"))
    out = sets.join(known, ["n", "name_a", "name_b"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_first(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, that of the smallest id, of every component; of rows repeated under an id all stay."""
    kept = link(docs, percent, size, id_col=id_col, text_col=text_col)
    ids = written(kept.filter("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias("_kept")).distinct(), "kept-ids")
    discard(kept)
    own = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), F.col(id_col).alias("_id"))
    return checked_join(own, ids, F.col("_id").eqNullSafe(F.col("_kept")), "left_semi").select("_row.*")
