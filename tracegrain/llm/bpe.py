"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

A merge list lets a byte to come change tokens already formed, but only so far back. Take two texts with
a common beginning: a token boundary in it differs only because a merge of rank r took place next to a
boundary that differed before, with a rank above that one's. Following such chains through the merge list,
dearest rank last, gives the number of bytes behind which nothing can change any more
(``sufficient_lookahead``). Tokens that end farther back than that are stable: the transducer emits them
and forgets their bytes, so it keeps a bounded buffer for words of any length.

Texts are cut into words by the byte-level pattern. A blank between two other characters always
starts a word, so a text is fed in segments cut at such blanks; a segment seen before comes from a cache of
bounded size.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.common import sha256_hex

# The word pattern of the public byte-level vocabulary, with white space spelled out as Unicode defines it
# (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
# A blank inside a run of white space, or at the end of one, may belong to the word before it.
UNSAFE = rf"[{SPACE}] (?=[{SPACE}]|\Z)"

# Segments kept in the cache of a task, and bytes that the transducer reads between two emissions.
CACHE = 500_000
CHUNK = 4_096
# Characters of a text that are handled at a time.
PIECE = 1 << 18


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in a byte-level vocabulary: printable Latin-1 stands for itself."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """A vocabulary with its merge list: tokens as bytes, ids, and the rank of every pair of ids."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int]):
        self.vocab, self.special = vocab, special
        self.tokens = {i: t for t, i in vocab.items()} | {i: s.encode() for s, i in special.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.merged = [vocab[a + b] for a, b in merges]
        made: dict[bytes, int] = {}
        for rank, (a, b) in enumerate(merges):
            if max(made.get(a, -1), made.get(b, -1)) >= rank or a + b in made:
                raise ValueError("a merge must come after the merges that make its parts, and be the only one of its token")
            made[a + b] = rank
            self.pairs[vocab[a], vocab[b]] = rank
        self.bytes = [vocab.get(bytes([b])) for b in range(256)]
        if None in self.bytes:
            raise ValueError("every byte needs a token")
        self.lookahead = sufficient_lookahead(merges)

    @classmethod
    def from_file(cls, path: str) -> Merges:
        """Reads a tokenizer file with a byte-level BPE model."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        plain = lambda token: bytes(alphabet[c] for c in token)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {plain(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        return cls(vocab, [(plain(a), plain(b)) for a, b in merges], special)

    def bpe(self, data: bytes) -> list[int]:
        """Token ids of one word: the pair of lowest rank is merged, leftmost first, until none is left."""
        ids = [self.bytes[b] for b in data]
        rank, merged, none = self.pairs.get, self.merged, len(self.merged)
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i : i + 2] = [token] = [merged[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], token), none)
            if i < len(ranks):
                ranks[i] = rank((token, ids[i + 1]), none)
        return ids

    def stream(self, blocks: Iterator[bytes]) -> Iterator[list[int]]:
        """Token ids of one word that comes in blocks: emitted once stable, with a bounded buffer."""
        rest = b""
        for block in blocks:
            rest += block
            if len(rest) < self.lookahead + CHUNK:
                continue
            stable, out, end = len(rest) - self.lookahead, [], 0
            for token in self.bpe(rest):
                if end + len(self.tokens[token]) > stable:
                    break
                end += len(self.tokens[token])
                out.append(token)
            rest = rest[end:]
            yield out
        yield self.bpe(rest)


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes at the end of a known beginning whose tokens may still change.

    ``reach[x]`` is how far to the left of a token x, or of a token that grows from x to the right, a chain
    of merges of later ranks can carry a difference. Going through the merges from the last to the first,
    merge (a, b) carries a difference at its middle over a, and on from there.
    """
    reach: dict[bytes, int] = {}
    most = 0
    for a, b in reversed(merges):
        grown = reach.get(a + b, 0)
        far = len(a) + max(reach.get(a, 0), grown)
        reach[b] = max(reach.get(b, 0), far)
        reach[a] = max(reach.get(a, 0), grown)
        most = max(most, far)
    return most + 1


class Encoder:
    """Encodes texts piece by piece into strings of decimal ids, each followed by a comma."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.words = regex.compile(WORDS)
        self.unsafe = regex.compile(UNSAFE)
        self.special = regex.compile("(" + "|".join(map(regex.escape, merges.special)) + ")") if merges.special else None
        self.cache: dict[str, str] = {}  # by segment, without its blank
        self.known: dict[str, str] = {}  # by word

    def _word(self, word: str) -> str:
        data = word.encode()
        if len(data) <= CHUNK:
            ids = self.merges.bpe(data)
        else:
            blocks = (data[i : i + CHUNK] for i in range(0, len(data), CHUNK))
            ids = [i for part in self.merges.stream(blocks) for i in part]
        return "".join(f"{i}," for i in ids)

    def _plain(self, text: str) -> str:
        out = []
        for word in self.words.findall(text):
            ids = self.known.get(word)
            if ids is None:
                ids = self._word(word)
                if len(word) <= 64:
                    if len(self.known) >= CACHE:
                        self.known.clear()
                    self.known[word] = ids
            out.append(ids)
        return "".join(out)

    def _segment(self, key: str) -> str:
        """Ids of a segment with the blank that stands before it, from the cache or through the transducer."""
        out = self._plain(" " + key)
        if len(key) <= 64:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[key] = out
        return out

    def _pieces(self, text: str) -> Iterator[str]:
        """The text in pieces of bounded length, cut before blanks that start a word."""
        start = 0
        while len(text) - start > PIECE:
            cut = text.find(" ", start + PIECE)
            while cut > 0 and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace() or cut + 1 == len(text)):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield text[start:cut]
            start = cut
        yield text[start:]

    def encode(self, text: str) -> Iterator[str]:
        """Ids of a whole text, in parts."""
        runs = self.special.split(text) if self.special and self.special.search(text) else [text]
        for run in runs:
            if run in self.merges.special:
                yield f"{self.merges.special[run]},"
                continue
            for piece in self._pieces(run):
                if self.unsafe.search(piece):
                    yield self._plain(piece)
                    continue
                first, *segments = piece.split(" ")
                get = self.cache.get
                if first:
                    yield self._plain(first)
                yield "".join([get(s) or self._segment(s) for s in segments])


class Decoder:
    """Turns ids back into text, byte by byte: incomplete characters wait for the ids to come."""

    def __init__(self, merges: Merges):
        self.tokens = {str(i): t for i, t in merges.tokens.items()}

    def decode(self, parts: Iterator[str]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for part in parts:
            if part:
                yield machine.decode(b"".join(map(self.tokens.__getitem__, part[:-1].split(","))))
        yield machine.decode(b"", True)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Token ids of every whole text.

    Columns doc_id, ids (array<int>), decoded (the text that the ids give back); with ``digests`` instead doc_id,
    n_tokens, ids_sha256 and decoded_sha256, so that long results stay in the task. A null text counts as
    empty: no ids. Rows are independent of each other; repeated rows and ids come through one by one, and
    other columns are ignored. ``path`` names the tokenizer file on every executor.
    """

    def batches(frames):
        import hashlib

        merges = Merges.from_file(path)
        encoder, decoder = Encoder(merges), Decoder(merges)
        for frame in frames:
            rows = []
            for text in frame["text"]:
                if digests:
                    rows.append(_digests(encoder, decoder, text or "", hashlib))
                else:
                    parts = list(encoder.encode(text or ""))
                    ids = [int(i) for part in parts for i in part.split(",")[:-1]]
                    rows.append((ids, "".join(decoder.decode(iter(parts)))))
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    columns = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return slim.mapInPandas(batches, f"doc_id {kind}, {columns}")


def _digests(encoder: Encoder, decoder: Decoder, text: str, hashlib) -> tuple[int, str, str]:
    """Count and digests of one text, computed while its parts stream through encoder and decoder."""
    ids, decoded, state = hashlib.sha256(), hashlib.sha256(), [0, ""]

    def tee():
        for part in encoder.encode(text):
            state[0] += part.count(",")
            # The last comma of all is left out.
            ids.update((state[1] + part[:-1]).encode() if part else b"")
            state[1] = "," if part or state[1] else ""
            yield part

    for chars in decoder.decode(tee()):
        decoded.update(chars.encode())
    return state[0], ids.hexdigest(), decoded.hexdigest()
