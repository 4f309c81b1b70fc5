"""Toxicity of a text: a linear classifier over character n-grams scaled by naive Bayes log-count ratios (NB-LR).

Features are the distinct character n-grams of the lower-cased text (hashed code points). Each is scaled by the log ratio of its smoothed
frequencies among toxic and clean texts, and a logistic regression is fitted to the scaled features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import smallest_hashes

GRAMS = (3, 4, 5)
BITS = 19
SMOOTHING = 1.0
SAMPLE_PER_CLASS = 1200
LEAST_TEXTS = 3
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.3, 1e-4
PRIME = np.uint32(0x01000193)  # fixed values: FNV prime, Knuth's multiplicative constant
SPREAD = np.uint32(0x9E3779B1)


@dataclass
class Classifier:
    weights: np.ndarray  # by hashed n-gram, already scaled
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        seen = np.zeros(1 << BITS, np.int64)
        margins = np.array([float(self.weights[features(text, seen)].sum()) + self.bias for text in texts])
        return 1 / (1 + np.exp(-np.clip(margins, -500, 500)))


def features(text: str, seen: np.ndarray) -> np.ndarray:
    """Distinct hashed n-grams of a text. ``seen`` is scratch space: the last place of each hash stands for all its places."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    rolled, parts = raw.copy(), []
    for n in range(2, max(GRAMS) + 1):
        if len(raw) < n:
            break
        rolled = rolled[: len(raw) - n + 1] * PRIME + raw[n - 1 :]
        if n in GRAMS:
            parts.append(((rolled ^ np.uint32(n)) * SPREAD) >> np.uint32(32 - BITS))
    if not parts:
        return np.zeros(0, np.uint32)
    grams = np.concatenate(parts)
    place = np.arange(len(grams))
    seen[grams] = place
    return grams[seen[grams] == place]


def packed(row: np.ndarray) -> bytes:
    """The features of a text in ascending order, or one bit for each possible feature if that is shorter (64 kB)."""
    if 4 * len(row) < 1 << (BITS - 3):
        return np.sort(row).astype("<u4").tobytes()
    present = np.zeros(1 << BITS, bool)
    present[row] = True
    return np.packbits(present).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))) if len(raw) == 1 << (BITS - 3) else np.frombuffer(raw, "<u4")


def train(rows: list[bytes], toxic: list[int], seed: int = 3) -> Classifier:
    """Fit to the packed features of labelled texts, both classes with the same total weight, a few texts at a time (Adagrad)."""
    y, n = np.array(toxic, np.float32), len(rows)
    counts = np.zeros((2, 1 << BITS), np.int32)
    for row, label in zip(rows, toxic):
        counts[int(label), unpacked(row)] += 1
    p, q = counts[1] + SMOOTHING, counts[0] + SMOOTHING
    ratio = (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float32)
    ratio[counts.sum(axis=0) < LEAST_TEXTS] = 0
    ratio /= np.sqrt(max(1.0, float(np.mean([np.square(ratio[unpacked(row)]).sum() for row in rows]))))
    share = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum())) * n
    w, squares, bias, bias_squares = np.zeros(1 << BITS, np.float32), np.full(1 << BITS, 1e-8, np.float32), 0.0, 1e-8
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for begin in range(0, n, BATCH):
            some = order[begin : begin + BATCH]
            gradient, wrongs = np.zeros(1 << BITS, np.float32), 0.0
            for i in some:  # one text unpacked at a time
                at = unpacked(rows[i])
                x = ratio[at]
                margin = float(x @ w[at]) + bias
                wrong = share[i] * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y[i]) / len(some)
                gradient[at] += x * np.float32(wrong)
                wrongs += wrong
            squares += gradient * gradient
            w -= RATE * gradient / np.sqrt(squares)
            w *= 1 - DECAY
            bias_squares += wrongs**2
            bias -= RATE * wrongs / np.sqrt(bias_squares)
    return Classifier(w * ratio, float(bias))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_per_class: int = SAMPLE_PER_CLASS) -> Classifier | float:
    """Classifier from at most ``sample_per_class`` labelled texts of each class (by hash of the id), each read whole.

    Only the number of texts is bounded. Tasks take their features, so the driver gets 64 kB of a text at most, however long it is. With
    one class alone, the share of toxic texts among the labels (0 without labels) stands for the classifier; so it does when no labelled
    text is in ``documents``. An id labelled both ways is toxic; rows that repeat a labelled id all count. NULL texts count as empty.
    """
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    if not 0 < share < 1:
        return share
    sides = [smallest_hashes(known.where(F.col("toxic") == label), ["doc_id"], sample_per_class).collect() for label in (0, 1)]
    picked = documents.sparkSession.createDataFrame([tuple(r) for side in sides for r in side], "doc_id long, toxic int")
    texts = documents.select(documents[id_col].cast("long").alias("doc_id"), F.coalesce(documents[text_col].cast("string"), F.lit("")).alias("text"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "row": [packed(features(text, seen)) for text in batch["text"]]})

    # two samples of a stated size are broadcast
    sample = texts.join(F.broadcast(picked), "doc_id").mapInPandas(rows, "doc_id long, toxic int, row binary").toPandas()
    if sample["toxic"].nunique() < 2:
        return share
    sample["row"] = sample["row"].map(bytes)
    sample = sample.sort_values(["toxic", "doc_id", "row"])
    return train(sample["row"].tolist(), sample["toxic"].tolist())


def score_of(classifier: Classifier | float, text: Column) -> Column:
    """Probability that a text is toxic; NULL counts as the empty text."""
    if not isinstance(classifier, Classifier):
        return F.lit(float(classifier))

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(classifier.scores(batch.tolist()))

    return scores.asNondeterministic()(F.coalesce(text.cast("string"), F.lit("")))
