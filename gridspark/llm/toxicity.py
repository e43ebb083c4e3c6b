"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram anywhere in the text.  Its value is the log ratio
of its smoothed shares among toxic and other training texts; a logistic regression on these
values learns how far to trust each.  Features that tell nothing (small ratios, few texts) have
no weight, so a long harmless text is not driven by noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fold, give_back, settle, short_batches, text_of

ORDERS = (3, 4, 5)
#: 2 ** BITS cells of the feature table: the model and all statistics sent to the driver are that small.
BITS = 20
#: Labelled rows of each class that the fit uses: those whose hashed id is smallest.
PER_CLASS = 20_000
#: Training texts a feature must occur in, and the least absolute log ratio of a feature.
MIN_TEXTS, MIN_RATIO = 5, 1.0
#: Features that the regression weighs: those of largest ratio times root of frequency.
FEATURES = 1 << 16
#: Penalty on squared weights, and steps of the fit.
PENALTY, STEPS = 1e-3, 150


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hashed n-gram) of every n-gram occurrence; white space is all the same.

    Texts are laid out between gaps as wide as the longest n-gram, so none spans two texts.
    """
    gap = " " * max(ORDERS)
    lowered = [t.lower() for t in texts]
    code = np.frombuffer((gap + gap.join(lowered) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where((code >= 9) & (code <= 13), np.uint32(32), code)
    sizes = np.array([len(t) + len(gap) for t in lowered])
    sizes[-1] += len(gap)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    cells, hashed = [], code * np.uint32(0x01000193)
    for n in range(2, max(ORDERS) + 1):
        hashed = (hashed[:-1] ^ (code[n - 1 :] + np.uint32(n))) * np.uint32(0x01000193)
        if n in ORDERS:
            cells.append(((hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    # a gap precedes each text: an n-gram that begins in it belongs to the text after it
    return np.concatenate([owner[: len(c)] for c in cells]), np.concatenate(cells)


def _present(texts: list[str], useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, n-gram) pairs, of the ``useful`` n-grams only if these are given."""
    owner, cell = features(texts)
    if useful is not None:
        hit = useful[cell]
        owner, cell = owner[hit], cell[hit]
    pairs = np.unique((owner.astype(np.int64) << BITS) | cell)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def training_rows(docs: DataFrame, labels: DataFrame, folds: int, per_class: int = PER_CLASS) -> DataFrame:
    """(toxic, text): at most ``per_class`` labelled texts of each class, none of fold 0.

    The bound is on labels, so their join with the texts is a bounded broadcast.  A text that
    repeats an id is represented by the smallest text of that id.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & (fold("doc_id", folds) != 0) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("key")).agg(F.max("toxic").alias("toxic"))
    parts = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("key"), "key").limit(per_class) for c in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    texts = docs.select(F.col("doc_id").alias("key"), text_of().alias("t")).join(F.broadcast(sample), "key")
    return texts.groupBy("key").agg(F.max("toxic").alias("toxic"), F.min("t").alias("text")).select("toxic", "text")


def count_ratios(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log ratio of every cell's smoothed shares in the two classes, and the texts it occurs in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 << BITS), np.int32)
        for pdf in batches:
            texts, toxic = pdf["text"].tolist(), pdf["toxic"].to_numpy()
            for lo, hi in chunks([len(t) for t in texts]):
                owner, cell = _present(texts[lo:hi])
                for c in (0, 1):
                    total[c] += np.bincount(cell[toxic[lo:hi][owner] == c], minlength=1 << BITS).astype(np.int32)
        give_back()
        at = np.flatnonzero(total.any(axis=0))
        yield pd.DataFrame({"cell": at, "n0": total[0, at], "n1": total[1, at]})

    summed = rows.mapInPandas(run, "cell int, n0 long, n1 long").groupBy("cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    got = summed.toPandas()  # 2 ** BITS rows at most
    counts = np.zeros((2, 1 << BITS))
    counts[0, got["cell"]], counts[1, got["cell"]] = got["n0"], got["n1"]
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 1)
    return np.log(share[1] / share[0]), counts.sum(axis=0)


def _fit(owner: np.ndarray, cell: np.ndarray, y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled features by gradient descent with adaptive steps."""
    x = ratio[cell] / 4
    w, b = np.zeros(len(ratio)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        margin = np.bincount(owner, x * w[cell], len(y)) + b
        error = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y
        g = np.bincount(cell, x * error[owner], len(ratio)) / len(y) + PENALTY * w / max(1, len(y)) ** 0.5
        gb = error.mean()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.05 * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
        b -= 0.05 * (mb / fix) / (np.sqrt(vb / fix2) + 1e-8)
    return w * ratio / 4, float(b)


class Model:
    """Weights of the cells and the intercept."""

    def __init__(self, weight: np.ndarray, intercept: float):
        self.weight, self.intercept, self.useful = weight.astype(np.float32), intercept, weight != 0

    def margins(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.intercept)
        for lo, hi in chunks([len(t) for t in texts]):
            owner, cell = _present(texts[lo:hi], self.useful)
            out[lo:hi] += np.bincount(owner, self.weight[cell], hi - lo)
        return out


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, per_class: int = PER_CLASS) -> Model:
    """Fit on labelled rows outside fold 0; with fewer than two classes every score is the share of toxic labels.

    The regression sees at most ``2 * per_class`` rows, as lists of the features they hold; it
    runs in one task.
    """
    short_batches(docs.sparkSession)
    rows = settle(training_rows(docs, labels, folds, per_class), "toxicity-sample")
    share = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = labels.filter(F.col("toxic").isin(0, 1) & (fold("doc_id", folds) != 0))
    prior = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = (prior.get(1, 0) + 0.5) / (prior.get(0, 0) + 0.5)
    if len(share) < 2:
        return Model(np.zeros(1 << BITS), float(np.log(odds)))
    ratio, texts = count_ratios(rows)
    value = np.where((texts >= MIN_TEXTS) & (np.abs(ratio) >= MIN_RATIO), np.abs(ratio) * np.sqrt(texts), 0.0)
    useful = np.zeros(1 << BITS, bool)
    useful[np.argsort(-value, kind="stable")[:FEATURES]] = True
    useful &= value > 0
    place = np.cumsum(useful) - 1
    kept = rows.sparkSession.sparkContext.broadcast((useful, ratio[useful], place))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in chunks([len(t) for t in texts]):
                owner, cell = _present(texts[lo:hi], kept.value[0])
                cuts = np.searchsorted(owner, np.arange(hi - lo + 1))
                cells = kept.value[2][cell].astype(np.int32)
                yield pd.DataFrame({"toxic": pdf["toxic"].to_numpy()[lo:hi], "cells": [cells[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]})
        give_back()

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(p["toxic"].to_numpy(float), p["cells"]) for p in batches]
        y = np.concatenate([p[0] for p in parts])
        cells = [c for p in parts for c in p[1]]
        owner = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
        w, b = _fit(owner, np.concatenate(cells).astype(np.int64) if len(owner) else owner, y, kept.value[1])
        yield pd.DataFrame({"w": [w], "b": [b]})
        give_back()

    held = rows.mapInPandas(find, "toxic int, cells array<int>").repartition(1)
    fitted = held.mapInPandas(fit, "w array<double>, b double").first()
    weight = np.zeros(1 << BITS)
    weight[useful] = fitted["w"]
    return Model(weight, fitted["b"] + float(np.log(odds * share[0] / share[1])))


def scorer(docs: DataFrame, model: Model):
    """Column function of a text: probability of being toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = pd.Series(1 / (1 + np.exp(-np.clip(shared.value.margins(texts.tolist()), -40, 40))))
        give_back()
        return out

    return score


def score_texts(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    Null and empty texts score by the intercept.  Rows without an id are held out.
    """
    score = scorer(docs, train(docs, labels, folds))
    out = docs.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), score(text_of()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more."""
    return docs.filter(scorer(docs, train(docs, labels, folds))(text_of()) < 0.5)
