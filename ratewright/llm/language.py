"""Language of a text by a bidirectional gated recurrent network over its bytes.

Every byte of a text gets language probabilities from the states of a forward and a backward network; a document's
probabilities are their mean over all its bytes. Texts are read whole, in windows of ``WINDOW`` bytes that start from an empty
state, many windows at a time. The network is trained in numpy by backpropagation through time on windows of labelled texts,
with the document's language as the label of every byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.llm.common import hash_below
from ratewright.sources.tables import written

WINDOW = 64
HIDDEN = 10
PAD = 256
WINDOWS_AT_ONCE = 1024
SAMPLE_PER_LANGUAGE = 400
WINDOWS_PER_TEXT = 4
EPOCHS = 6
BATCH = 128
UNKNOWN = "und"
OVER_CHANCE, MOST_LEAST = 1.2, 0.9  # a text is unsure below so many times one over the number of languages


@dataclass
class Network:
    """Weights: input tables by byte (w), recurrent weights (u), biases of the candidate state (d), output (v, c)."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Sum over the bytes of each window (row) of the language probabilities."""
        at = by_position(windows)
        forward, backward = (_states(self.weights, side, at)[0] for side in ("f", "b"))
        total = np.zeros((len(self.languages), len(windows)), np.float32)
        for t in range(len(at)):
            p = _labels(self.weights, forward[t], backward[t])
            p *= at[t] != PAD
            total += p
        return total.T


def by_position(windows: np.ndarray) -> np.ndarray:
    """Bytes by place in the window, ready to index the input tables."""
    return np.ascontiguousarray(windows.T).astype(np.intp)


def _labels(w: dict[str, np.ndarray], forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Language probabilities (one row per language) of one place in each window."""
    x = (w["vf"].T @ forward.T) + (w["vb"].T @ backward.T) + w["c"][:, None]
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def _softsign(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), which stands for the hyperbolic tangent: as bounded, and far cheaper over every byte of a corpus."""
    below = np.abs(x)
    below += 1
    x /= below
    return x


def _states(w: dict[str, np.ndarray], side: str, at: np.ndarray, keep: bool = False) -> tuple[list[np.ndarray], list[tuple]]:
    """State after each byte (by place in the window) and, with ``keep``, what backpropagation needs."""
    steps, n = at.shape
    table, recurrent, bias = w["w" + side], w["u" + side], w["d" + side]
    size = recurrent.shape[0]
    h = np.zeros((n, size), np.float32)
    states: list[np.ndarray] = [h] * steps
    kept: list[tuple] = []
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        given = np.take(table, at[t], axis=0)
        inner = h @ recurrent
        gates = _softsign(given[:, : 2 * size] + inner[:, : 2 * size])
        gates *= 0.5
        gates += 0.5
        z, r = gates[:, :size], gates[:, size:]
        proposal = inner[:, 2 * size :] + bias
        new = r * proposal
        new += given[:, 2 * size :]
        new = _softsign(new)
        if keep:
            kept.append((t, h, z, r, proposal, new))
        h = h - new
        h *= z
        h += new
        states[t] = h
    return states, kept


def _start(n_languages: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    w: dict[str, np.ndarray] = {"c": np.zeros(n_languages)}
    for side in "fb":
        w["w" + side] = rng.normal(0, 0.3, (PAD + 1, 3 * hidden))
        w["u" + side] = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden))
        w["d" + side] = np.zeros(hidden)
        w["v" + side] = rng.normal(0, 0.5, (hidden, n_languages))
    return {k: v.astype(np.float32) for k, v in w.items()}


def _gradients(w: dict[str, np.ndarray], windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean cross entropy over all bytes, backwards through time."""
    at = by_position(windows)
    steps, n = at.shape
    size = w["uf"].shape[0]
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    runs = {side: _states(w, side, at, keep=True) for side in "fb"}
    scale = 1.0 / max(1, int((at != PAD).sum()))
    back = {side: [np.zeros(0)] * steps for side in "fb"}
    for t in range(steps):
        p = _labels(w, runs["f"][0][t], runs["b"][0][t])
        p[labels, np.arange(n)] -= 1
        p *= (at[t] != PAD) * np.float32(scale)
        grads["c"] += p.sum(axis=1)
        for side in "fb":
            grads["v" + side] += (p @ runs[side][0][t]).T
            back[side][t] = (w["v" + side] @ p).T
    for side in "fb":
        dh = np.zeros((n, size), np.float32)
        recurrent = w["u" + side]
        d_given = np.zeros((steps, n, 3 * size), np.float32)
        for t, h, z, r, proposal, new in reversed(runs[side][1]):
            dh = dh + back[side][t]
            dz = dh * (h - new) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dn = dh * (1 - z) * (1 - np.abs(new)) ** 2
            dr = dn * proposal * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            d_inner = np.concatenate([dz, dr, dn * r], axis=1)
            d_given[t] = np.concatenate([dz, dr, dn], axis=1)
            grads["u" + side] += h.T @ d_inner
            grads["d" + side] += (dn * r).sum(axis=0)
            dh = dh * z + d_inner @ recurrent.T
        np.add.at(grads["w" + side], at.ravel(), d_given.reshape(-1, 3 * size))
    return grads


def cut(raw: bytes, window: int = WINDOW) -> np.ndarray:
    """All bytes in rows of ``window``; the last row is filled up with ``PAD``."""
    n = max(1, -(-len(raw) // window))
    rows = np.full(n * window, PAD, np.int16)
    rows[: len(raw)] = np.frombuffer(raw, np.uint8)
    return rows.reshape(n, window)


def windows_of(text: str) -> np.ndarray:
    """Up to ``WINDOWS_PER_TEXT`` windows spread over the whole text, from its first to its last byte."""
    windows = cut(text.encode("utf-8", "replace"))
    return windows[np.unique(np.linspace(0, len(windows) - 1, WINDOWS_PER_TEXT).astype(int))]


def train(windows: list[np.ndarray], languages: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fit a network by Adam to windows of labelled texts (``windows_of`` each)."""
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    x = np.concatenate(windows)
    y = np.repeat([names.index(language) for language in languages], [len(rows) for rows in windows])
    w = _start(len(names), hidden, rng)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    steps = max(60, epochs * -(-len(x) // BATCH))
    while step < steps:
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            at = order[i : i + BATCH]
            step += 1
            for k, g in _gradients(w, x[at], y[at]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
                w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Network(names, w)


def predict(network: Network, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text; windows of many texts are read side by side."""
    sums = np.zeros((len(texts), len(network.languages)))
    waiting, owners, held = [], [], 0

    def flush() -> None:
        x, who = np.concatenate(waiting), np.concatenate(owners)
        for i in range(0, len(x), WINDOWS_AT_ONCE):
            np.add.at(sums, who[i : i + WINDOWS_AT_ONCE], network.probabilities(x[i : i + WINDOWS_AT_ONCE]))

    for k, text in enumerate(texts):
        rows = cut(text.encode("utf-8", "replace"))
        waiting.append(rows)
        owners.append(np.full(len(rows), k))
        held += len(rows)
        if held >= 4 * WINDOWS_AT_ONCE:
            flush()
            waiting, owners, held = [], [], 0
    if waiting:
        flush()
    means = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-12)
    best = means.argmax(axis=1)
    return [network.languages[b] for b in best], means[np.arange(len(best)), best]


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE
) -> Network | None:
    """Network of the non-NULL languages of ``labelled``, from at most ``sample_per_language`` texts each; None without any.

    The sample is the texts with the smallest hashes of id and text, so it is the same on any partitioning. Only their number is bounded:
    each is read whole in the tasks, which take its windows, so the driver holds a few hundred bytes of a text however long it is. Counts
    per language come first, so that tasks send on few more rows than the sample has.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("hash"))
    counts = written(rows.groupBy("lang").agg(F.count("*").alias("n")))
    share = F.least(F.lit(1.0), F.lit(2.0 * sample_per_language + 1000) / F.col("n"))
    some = rows.join(counts, "lang").where(hash_below(F.col("hash"), share))
    order = Window.partitionBy("lang").orderBy("hash", "text")
    picked = some.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample_per_language)

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [windows_of(text).astype("<i2").tobytes() for text in batch["text"]]
            yield batch

    taken = picked.select("lang", "hash", "text").mapInPandas(take, "lang string, hash long, text binary")
    sample = taken.toPandas().sort_values(["lang", "hash", "text"], kind="stable")
    windows = [np.frombuffer(raw, "<i2").reshape(-1, WINDOW) for raw in sample["text"]]
    return train(windows, sample["lang"].tolist()) if windows else None


def least_score(network: Network) -> float:
    """Below this a text's language is unsure. It follows the number of languages: chance alone gives one over it."""
    return min(OVER_CHANCE / len(network.languages), MOST_LEAST)


def language_of(network: Network | None, text: Column) -> Column:
    """Language of a text column: struct<lang_pred, score> (``und``, 0) without a network, else struct<lettered, found>, where ``found`` has
    lang_pred and score, and ``lettered`` is false for NULL and letterless texts, which ``with_language`` makes ``und``.
    """
    if network is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.pandas_udf("lang_pred string, score double")
    def labels(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = predict(network, batch.fillna("").tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    lettered = F.when(text.rlike(r"\p{L}"), text)
    found = labels.asNondeterministic()(lettered)
    return F.struct(lettered.isNotNull().alias("lettered"), found.alias("found"))


def with_language(documents: DataFrame, network: Network | None, text_col: str = "text", into: str = "language") -> DataFrame:
    """``documents`` with a struct column ``into``: lang_pred, score. One row per input row; other columns are kept as they are.

    A text that is NULL or has no letter is ``und`` with score 0, whatever the network says; so is every text when nothing was learned.
    """
    if network is None:
        return documents.withColumn(into, language_of(None, F.col(text_col)))
    scored = documents.withColumn(into, language_of(network, documents[text_col].cast("string")))
    known = F.col(f"{into}.lettered")
    return scored.withColumn(
        into,
        F.struct(
            F.when(known, F.col(f"{into}.found.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
            F.when(known, F.col(f"{into}.found.score")).otherwise(0.0).alias("score"),
        ),
    )
