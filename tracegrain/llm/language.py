"""Language identification by error-correcting output codes over hashed letter n-grams.

Every language gets a codeword of +1 and -1; one binary linear classifier per bit reads the letter n-grams of
a text and predicts that bit. Decoding is loss-weighted: the distance of a text to a codeword is the sum over
the bits of the logistic loss of bit times margin, weighted by how well that bit separates that language on
the training sample. The nearest codeword wins; a small lead over the second one is flagged as ambiguous.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.llm.common import written

BUCKETS = 1 << 13
# The classifiers are fitted on at most so many documents of each language, and so many in all: with more than 40
# languages each has fewer, but none is left out.
TRAIN_ROWS = 600
TRAIN_TOTAL = 24_000
# Up to so many languages get the exhaustive code; more get the best of some random ones.
EXHAUSTIVE = 5
TRIES = 50
EPOCHS = 120
RATE = 2.0
DECAY = 1e-5
LEAD = 0.2
# Score from which a language counts as found where documents are filtered.
LEAST = 0.3
SEED = 11
# Characters that are counted at a time.
PIECE = 1 << 20
# Texts whose counts a task holds at a time.
SLICE = 256


def codewords(languages: int, seed: int = SEED) -> np.ndarray:
    """A row of +1 and -1 per language, rows far apart from each other."""
    if languages <= EXHAUSTIVE:
        # Every split of the languages in two, once.
        rest = list(itertools.product((1, -1), repeat=max(languages - 1, 0)))[1:]
        return np.array([[1] * len(rest), *np.array(rest).T.tolist()] if rest else [[1]] * languages, dtype=np.int8)
    pick = np.random.default_rng(seed)
    bits, best, most = max(15, int(np.ceil(10 * np.log2(languages)))), None, -1
    for _ in range(TRIES):
        code = pick.choice(np.array([1, -1], dtype=np.int8), size=(languages, bits))
        apart = (bits - code.astype(int) @ code.T.astype(int)) // 2
        least = int((apart + bits * np.eye(languages, dtype=int)).min())
        split = bool((np.abs(code.astype(int).sum(axis=0)) < languages).all())
        if split and least > most:
            best, most = code, least
    return best


def letter_table() -> np.ndarray:
    """For every code point: the code point of its lower case if it is a letter, else 0."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            table[code] = ord(char.lower()[0])
    return table


def gram_counts(text: str, letters: np.ndarray) -> np.ndarray | None:
    """Normed counts of hashed n-grams of one to three letters, over the whole text; None without letters.

    Anything between letters counts as one word boundary.
    """
    counts, carry, any_letter = np.zeros(BUCKETS), np.zeros(1, dtype=np.uint32), False
    for start in range(0, len(text), PIECE):
        piece = text[start : start + PIECE].encode("utf-32-le", "surrogatepass")
        codes = letters[np.frombuffer(piece, dtype=np.uint32)]
        any_letter = any_letter or bool(codes.any())
        codes = np.concatenate([carry, codes, [0] if start + PIECE >= len(text) else []]).astype(np.uint32)
        codes = codes[(codes != 0) | (np.concatenate([[1], codes[:-1]]) != 0)]
        one = codes * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (one[1:] >> np.uint32(7))) * np.uint32(0x85EBCA6B)
        three = (two[:-1] ^ (one[2:] >> np.uint32(11))) * np.uint32(0xC2B2AE35)
        # The n-grams that lie in the letters carried over were counted before.
        old = len(carry) if start else 0
        for grams, skip in ((one, old), (two, max(old - 1, 0)), (three, max(old - 2, 0))):
            counts += np.bincount(grams[skip:] >> np.uint32(19), minlength=BUCKETS)
        carry = codes[-2:]
    if not any_letter:
        return None
    return np.sqrt(counts) / np.sqrt(counts.sum())


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # bucket by bit
    bias: np.ndarray
    trust: np.ndarray  # language by bit, rows add up to 1

    def distances(self, features: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each row to each codeword."""
        margins = features @ self.weights + self.bias
        losses = np.logaddexp(0.0, -margins[:, None, :] * self.code[None])
        return (losses * self.trust[None]).sum(axis=2)

    def predict(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest language, score from 0 to 1, and whether the lead is small."""
        far = self.distances(features)
        like = np.exp(-4 * (far - far.min(axis=1, keepdims=True)))
        share = like / like.sum(axis=1, keepdims=True)
        best = far.argmin(axis=1)
        score = share[np.arange(len(best)), best]
        second = np.partition(share, -2, axis=1)[:, -2] if share.shape[1] > 1 else np.zeros(len(best))
        return best, score, score - second < LEAD


def fit(features: np.ndarray, labels: list[str]) -> Model:
    """All bit classifiers at once, by gradient steps with momentum on the logistic loss."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    rows = np.array([languages.index(x) for x in labels])
    bits = code[rows].astype(np.float64)
    weights, bias = np.zeros((features.shape[1], code.shape[1])), np.zeros(code.shape[1])
    share = 1.0 / np.bincount(rows)[rows] / len(languages)
    speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
    x = features.astype(np.float32)
    for _ in range(EPOCHS):
        margin = bits * (x @ weights.astype(np.float32) + bias)
        pull = -bits * share[:, None] / (1 + np.exp(np.clip(margin, -50, 50)))
        speed_w = 0.9 * speed_w + x.T @ pull.astype(np.float32) + DECAY * weights
        speed_b = 0.9 * speed_b + pull.sum(axis=0)
        weights -= RATE * 4 * speed_w
        bias -= RATE * speed_b
    right = ((x @ weights + bias) * bits > 0).astype(np.float64)
    trust = np.stack([right[rows == i].mean(axis=0) for i in range(len(languages))]) + 1e-3
    return Model(languages, code, weights, bias, trust / trust.sum(axis=1, keepdims=True))


def training_sample(docs: DataFrame, usable: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` texts of each language, chosen by the hash of the text, among the ``usable`` rows.

    With many languages each has fewer rows, ``TRAIN_TOTAL`` in all; a label with more different values than that is
    no language and raises ValueError. The different texts of each language are counted first, so that only about the
    wanted number is ranked; copies count once, as they pass or fail together.
    """
    labelled = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    labelled = labelled.withColumn("_place", F.xxhash64("text", F.lit(SEED)))
    different = labelled.select("lang", "_place").distinct()
    counts = different.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = counts.count()
    if languages > TRAIN_TOTAL:
        raise ValueError(f"{languages} languages; a model of at most {TRAIN_TOTAL} can be fitted")
    rows = min(rows, TRAIN_TOTAL // max(languages, 1))
    share = F.least(F.lit(1.0), F.lit(2.0 * rows) / F.col("n"))
    near = labelled.join(F.broadcast(counts), "lang")  # a row per language, counted above
    near = near.filter(F.pmod("_place", F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["lang", "text"])
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_place", "text")))
    return ranked.filter(F.col("_rank") <= rows).select("lang", "text")


def train(docs: DataFrame, usable: Column, rows: int = TRAIN_ROWS) -> Model | None:
    """The model of the languages that ``usable`` rows name, or None if they name none."""

    def count(frames):
        letters = letter_table()
        for frame in frames:
            out = []
            for lang, text in zip(frame["lang"], frame["text"]):
                if (features := gram_counts(text, letters)) is not None:
                    at = np.flatnonzero(features)
                    out.append((lang, at.astype(np.int16).tobytes(), features[at].astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["lang", "at", "value"])

    sample = written(training_sample(docs, usable, rows), "language-sample")
    # Bounded: TRAIN_TOTAL rows, a few kB each.
    found = sample.mapInPandas(count, "lang string, at binary, value binary").orderBy("lang", "at", "value").collect()
    if not found:
        return None
    features = np.zeros((len(found), BUCKETS), dtype=np.float32)
    for i, row in enumerate(found):
        features[i, np.frombuffer(row["at"], dtype=np.int16)] = np.frombuffer(row["value"], dtype=np.float32)
    return fit(features, [row["lang"] for row in found])


def _judged(docs: DataFrame, model: Model | None, keep: list[str], text_col: str) -> DataFrame:
    """lang_pred, score and ambiguous of every row, with its ``keep`` columns in a struct ``row``."""

    def judge(frames):
        letters = letter_table()
        for batch in frames:
            texts = batch.column("text").to_pylist()
            best = np.array(["und"] * len(texts), dtype=object)
            score, unsure = np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
            # A few texts at a time: their dense counts are what takes memory.
            for start in range(0, len(texts) if model else 0, SLICE):
                some = [gram_counts(text, letters) if text else None for text in texts[start : start + SLICE]]
                at = [i for i, f in enumerate(some) if f is not None]
                if at:
                    rows = np.array(at) + start
                    number, score[rows], unsure[rows] = model.predict(np.stack([some[i] for i in at]))
                    best[rows] = np.array(model.languages, dtype=object)[number]
            columns = [batch.column("row"), pa.array(best, pa.string()), pa.array(score), pa.array(unsure)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "lang_pred", "score", "ambiguous"])

    slim = docs.select(F.struct(*map(F.col, keep)).alias("row"), F.col(text_col).alias("text"))
    kind = slim.schema["row"].dataType.simpleString()
    return slim.mapInArrow(judge, f"row {kind}, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with lang_pred, score and ambiguous for every whole text.

    A text that is null or has no letters, and any text without a model, gets ``und`` and score 0. Rows are judged
    one by one, so repeated rows agree.
    """
    found = _judged(docs, model, keep, text_col)
    return found.select(*(F.col("row")[c].alias(c) for c in keep), "lang_pred", "score", "ambiguous")


def keep_known(docs: DataFrame, least: float = LEAST, text_col: str = "text") -> DataFrame:
    """The documents whose language is found with a score of ``least`` or more, with their columns as they are.

    The model learns from the rows of ``docs`` that have a ``lang``; without any, no language is found.
    """
    model = train(docs, F.lit(True))
    found = _judged(docs, model, docs.columns, text_col)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
