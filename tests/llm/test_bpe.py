"""The transducer gives the ids of the tokenizers library, its stream those of the whole word."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests import oracle
from tracegrain.llm import bpe, queries

SF_DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_query_against_the_library(spark, library):
    texts = dict(oracle.connect(SF_DIR).execute("select doc_id, text from documents").fetchall())
    rows = queries.op6_bpe(spark, SF_DIR).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for row in rows:
        ids, decoded = _expected(library, texts[row["doc_id"]] or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_texts(spark, library):
    pick = random.Random(7)
    parts = ["a", " ", "  ", "\n", "\t", "'s", "'LL", "1", "é", "日本", "　", "\x1f", "\x85", "😀", "#$", "<|endoftext|>"]
    texts = [None, "", " ", "x  ", "-" * 9_000, "ab" * 5_000, "the cat " * 40_000, "a" * 100 + "  " * 300]
    texts += ["".join(pick.choice(parts) for _ in range(pick.randrange(60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumnRenamed("doc_id", "n")
    rows = bpe.encode(df.selectExpr("n as doc_id", "text", "1 as ids"), PATH).collect()
    for row in rows:
        assert (row["ids"], row["decoded"]) == _expected(library, texts[row["doc_id"]] or "")
    assert bpe.encode(df.selectExpr("n as doc_id", "text").filter("false"), PATH).count() == 0


def test_every_kind_of_character(library):
    encoder = bpe.Encoder(bpe.Merges.from_file(PATH))
    for start in range(0, 0x30000, 16):
        chars = [chr(c) for c in range(start, start + 16) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c} {c}{c}" for c in chars)
        ids = [int(i) for part in encoder.encode(text) for i in part.split(",")[:-1]]
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_stable_tokens_of_random_merge_lists(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 3)
    pick = random.Random(3)
    for _ in range(150):
        tokens, merges = [b"a", b"b", b"c"], []
        for _ in range(pick.randrange(1, 25)):
            a, b = pick.choice(tokens), pick.choice(tokens)
            if a + b not in tokens and len(a + b) <= 12:
                tokens.append(a + b)
                merges.append((a, b))
        vocab = {bytes([i]): i for i in range(256)} | {a + b: 256 + i for i, (a, b) in enumerate(merges)}
        model = bpe.Merges(vocab, merges, {})
        for _ in range(20):
            word = bytes(pick.choice(b"abc") for _ in range(pick.randrange(60)))
            parts = model.stream(word[i : i + 2] for i in range(0, len(word), 2))
            assert [t for part in parts for t in part] == model.bpe(word)


def test_decoder_waits_for_whole_characters():
    decoder = bpe.Decoder(bpe.Merges.from_file(PATH))
    model = bpe.Merges.from_file(PATH)
    parts = [f"{model.bytes[b]}," for b in "é日\U0001f600".encode()]
    assert "".join(decoder.decode(iter(parts))) == "é日\U0001f600"
    assert "".join(decoder.decode(iter(parts[:1]))) == "�"
