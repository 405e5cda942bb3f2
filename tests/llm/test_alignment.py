"""Tokenizer alignment: whole texts through both libraries and a plain count of overlaps."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests import oracle
from tracegrain.llm import alignment, queries
from tracegrain.llm.bpe import byte_alphabet

SF_DIR = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    alphabet = byte_alphabet()
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])

    def tokens(text):
        if not text:
            return [], []
        x = a.encode(" " + text, add_special_tokens=False)
        first = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(x.ids, x.tokens)]
        second = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            second.append((i, bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if b"".join(t for _, t in first) != whole or b"".join(t for _, t in second) != whole:
            return [], []
        return first, second

    return tokens


def _spans(tokens):
    end = 0
    for i, t in tokens:
        yield i, end, end + len(t)
        end += len(t)


def _plain(texts, tokens):
    """The contract's columns, by walking over the ends of both sides."""
    count, rows = collections.Counter(), []
    for text in texts:
        a, b = (list(_spans(side)) for side in tokens(text))
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e] if len(a) < 500 else None
        if links is None:
            links, k = [], 0
            for i, s, e in a:
                while b[k][2] <= s:
                    k += 1
                m = k
                while m < len(b) and b[m][1] < e:
                    links.append((i, b[m][0]))
                    m += 1
        both = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for high in both:
            part = [",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in (a, b)] if len(a) < 500 else None
            groups.append("|".join(part) if part else (low, high))
            low = high
        rows.append((a, b, groups, links))
        count.update(links)
    best = collections.Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for a, b, groups, links in rows:
        text = ";".join(groups) if all(isinstance(g, str) for g in groups) else None
        digest = hashlib.sha256(text.encode()).hexdigest() if text else text
        facts = len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links)
        out.append((*facts, digest))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _same(df, ids, expected):
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}
    assert set(found) == set(ids)
    for doc, row in zip(ids, expected):
        assert found[doc][:6] == row[:6], doc
        assert row[6] is None or found[doc][6] == row[6], doc


def test_query_against_the_libraries(spark, sides):
    rows = oracle.connect(SF_DIR).execute("select doc_id, text from documents").fetchall()
    _same(queries.op12_alignment(spark, SF_DIR), [r[0] for r in rows], _plain([r[1] for r in rows], sides))


def test_odd_texts_and_rare_pairs(spark, sides, monkeypatch):
    pick = random.Random(5)
    parts = ["the", "naïve", "é", "日本語", "👍🏽", " ", "  ", "\n", "\r\n", "\t", "\x00", "\x1c", "\xa0", " ", "1234", "don't", "I'LL", "ﬁ", "…"]
    parts += ["<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", "!!", ".", "a", "Z", "\x85", "​", "ß"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randrange(1, 30))) for _ in range(300)]
    texts += [" ".join(pick.choice(parts) for _ in range(pick.randrange(1, 30))) for _ in range(300)]
    texts += [None, "", " ", "  ", "x", " x ", "x▁y ok", "\n", "ab" * 3_000, "word " * 5_000, texts[0], texts[0]]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id bigint, text string, n int, key int")
    expected = _plain(texts, sides)
    _same(alignment.token_alignment(df, *PATHS), range(len(texts)), expected)
    # Few pairs are broadcast, the others are joined in a shuffle; segments are forgotten between chunks.
    monkeypatch.setattr(alignment, "CHUNK", 500)
    monkeypatch.setattr(alignment, "SEGMENTS", 50)
    _same(alignment.token_alignment(df, *PATHS, broadcast_rows=100), range(len(texts)), expected)


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, None)], "doc_id bigint, text string")
    found = alignment.token_alignment(df, *PATHS).collect()
    assert sorted((r["doc_id"] is None, r["n_links"]) for r in found) == [(False, 0), (False, 2), (True, 2), (True, 2)]
    assert {r["count_sum"] for r in found} == {0, 6}
    assert alignment.token_alignment(df.filter("false"), *PATHS).collect() == []


def test_terminals_follow_chains():
    # One group of tokens that overlap like bricks, then two that end together.
    a_end, b_end = np.array([2, 4, 6, 8, 9]), np.array([1, 3, 5, 7, 8, 9])
    found = alignment.terminals(np.append(0, a_end[:-1]), a_end, np.append(0, b_end[:-1]), b_end)
    assert found.tolist() == [9, 9, 9, 9, 10, 9, 9, 9, 9, 9, 10]
