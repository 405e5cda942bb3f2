"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its letter n-grams, each a row of a hashed embedding table; the bag is averaged and a
linear softmax turns the average into the probability that the word is toxic. Misspelt or unseen words share
n-grams, and so vectors, with words seen in training. A text is toxic if any of its words is: its score is
1 - product of (1 - p), a noisy-or over its distinct words, and embeddings and softmax are trained together
through it from labels of whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.common import written

BUCKETS = 1 << 16
WIDTH = 4
GRAMS = (3, 4, 5)
# Labelled texts that the model is fitted on, at most so many toxic and so many clean ones, chosen by a hash
# of the id.
TOXIC_ROWS = 1_200
CLEAN_ROWS = 2_400
# Words of toxic texts count from this share of them on.
MIN_SHARE = 0.01
EPOCHS = 40
RATE = 0.2
# Logit gap that words start from: nearly all words are harmless.
START = -6.0
SEED = 5
# Words whose probability a task remembers, and the letters of a word that n-grams are taken from at a time.
CACHE = 400_000
LETTERS = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.7


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, one after the other, and the number of n-grams of each word.

    A word stands between two marks; words too short for an n-gram give the whole of themselves.
    """
    joined = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(codes))
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        for size in GRAMS:
            keep = at[at + size <= ends]
            hashed = np.full(len(keep), size, dtype=np.uint64)
            for k in range(size):
                hashed = (hashed ^ codes[keep + k]) * np.uint64(0x100000001B3)
                hashed ^= hashed >> np.uint64(29)
            buckets.append((hashed % np.uint64(BUCKETS)).astype(np.int64))
            owners.append(owner[keep])
    buckets, owners = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.bincount(owners, minlength=len(words))


@dataclass
class Model:
    """Only what scoring needs: the logit difference that each bucket adds, and the bias."""

    pull: np.ndarray
    bias: float

    def words(self, words: list[str]) -> np.ndarray:
        """log(1 - p) of each word."""
        buckets, counts = grams(words)
        owner = np.repeat(np.arange(len(words)), counts)
        logits = np.bincount(owner, self.pull[buckets], minlength=len(words)) / np.maximum(counts, 1) + self.bias
        return -np.logaddexp(0.0, logits)


def words_in(text: str | None) -> list[str]:
    """Distinct lower-case words of letters of a whole text, in order of appearance."""
    return list(dict.fromkeys(LETTERS.findall(text.lower()))) if text else []


def fit(texts: list[list[str]], labels: np.ndarray) -> Model:
    """Embeddings and softmax from the distinct words of texts and the labels of the texts."""
    seen: dict[str, int] = {}
    for words, toxic in zip(texts, labels):
        for word in words if toxic else ():
            seen[word] = seen.get(word, 0) + 1
    # A word of few toxic texts may be there by chance; it gets no share in the blame.
    least = max(2, MIN_SHARE * int(labels.sum()))
    texts = [[w for w in words if not toxic or seen[w] >= least] for words, toxic in zip(texts, labels)]
    vocabulary: dict[str, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], dtype=np.int64) for words in texts]
    if not vocabulary:
        return Model(np.zeros(BUCKETS), -8.0)
    buckets, counts = grams(list(vocabulary))
    owner = np.repeat(np.arange(len(vocabulary)), counts)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    order = np.argsort(buckets, kind="stable")
    used, cuts = np.unique(buckets[order], return_index=True)
    by_bucket = owner[order]
    pick = np.random.default_rng(SEED)
    table = pick.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    head, bias = pick.normal(0, 0.3, (WIDTH, 2)).astype(np.float32), np.array([0.0, START], dtype=np.float32)
    word, text = np.concatenate(ids), np.repeat(np.arange(len(texts)), [len(i) for i in ids])
    weight = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((labels == 0).sum(), 1))
    size = np.maximum(counts, 1)[:, None].astype(np.float32)
    first = [np.zeros_like(p) for p in (table, head, bias)]
    second = [np.zeros_like(p) for p in (table, head, bias)]
    for epoch in range(1, EPOCHS + 1):
        bags = np.add.reduceat(table[buckets], firsts, axis=0) / size
        logits = bags @ head + bias
        gap = (logits[:, 1] - logits[:, 0]).astype(np.float64)
        clean = np.bincount(text, -np.logaddexp(0.0, gap)[word], minlength=len(texts))  # log of 1 - score
        # Derivative of the log-likelihood of a text by the logit gap of one of its words.
        score = np.maximum(-np.expm1(clean), 1e-9)
        outer = np.where(labels == 1, np.exp(clean) / score, -1.0) * weight
        slope = np.bincount(word, outer[text], minlength=len(counts)) / (1 + np.exp(-np.clip(gap, -50, 50)))
        both = np.stack([-slope, slope], axis=1).astype(np.float32)
        by_word = (both @ head.T) / size
        moved = np.zeros_like(table)
        moved[used] = np.add.reduceat(by_word[by_bucket], cuts, axis=0)
        rate = RATE * np.sqrt(1 - 0.999**epoch) / (1 - 0.9**epoch)
        for values, step, mean, square in zip((table, head, bias), (moved, bags.T @ both, both.sum(axis=0)), first, second):
            mean += 0.1 * (step - mean)
            square += 0.001 * (step * step - square)
            values += rate * mean / (np.sqrt(square) + 1e-9)
    pull = table @ (head[:, 1] - head[:, 0])
    return Model(pull, float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, usable: Column, toxic: int = TOXIC_ROWS, clean: int = CLEAN_ROWS) -> Model:
    """Fits the model on the labelled documents for which ``usable`` (over doc_id) holds.

    At most so many ``toxic`` and ``clean`` texts documents are used, those of the smallest hash of the id. A document with
    several labels counts as toxic if one of them says so; null labels are left out.
    """
    marked = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    # Ids are chosen first, so that only the chosen texts move.
    known = marked.join(docs.filter(usable & F.col("text").isNotNull()).select("doc_id"), "doc_id", "left_semi")
    place = F.xxhash64("doc_id", F.lit(SEED))
    chosen = [
        known.filter(F.col("toxic") == label).select("doc_id", "toxic").orderBy(place, "doc_id").limit(rows)
        for label, rows in ((0, clean), (1, toxic))
    ]
    # Bounded: ``toxic + clean`` ids.
    chosen = F.broadcast(chosen[0].unionAll(chosen[1]))
    texts = docs.filter(usable & F.col("text").isNotNull()).select("doc_id", "text").join(chosen, "doc_id")

    def cut(frames):
        for frame in frames:
            yield pd.DataFrame({"toxic": frame["toxic"], "words": [words_in(t) for t in frame["text"]]})

    sample = written(texts.select("toxic", "text"), "toxicity-sample")
    # Bounded: the words of ``toxic + clean`` texts.
    found = sample.mapInPandas(cut, "toxic int, words array<string>").collect()
    found.sort(key=lambda row: (row["toxic"], row["words"]))
    return fit([row["words"] for row in found], np.array([row["toxic"] for row in found]))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with the score of every whole text, from 0 to 1; null and empty texts score 0."""

    def scored(frames):
        known: dict[str, float] = {}
        for frame in frames:
            out = np.zeros(len(frame))
            for i, text in enumerate(frame["_text"]):
                words = words_in(text)
                fresh = [w for w in words if w not in known]
                if len(known) + len(fresh) > CACHE:
                    known.clear()
                    fresh = words
                if fresh:
                    known.update(zip(fresh, model.words(fresh).tolist()))
                out[i] = -np.expm1(sum(map(known.__getitem__, words)))
            yield frame.drop(columns="_text").assign(_score=np.clip(out, 0.0, 1.0))

    slim = docs.select(*keep, F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "_text")
    return slim.mapInPandas(scored, f"{kinds}, _score double").withColumnRenamed("_score", "score")
