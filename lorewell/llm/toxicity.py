"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are its distinct hashed character n-grams (lower case, a blank at both ends). Each feature is scaled by the log ratio of its
smoothed document counts among toxic and other training texts; a logistic regression with an L2 penalty is trained on the scaled features, and
the score is its probability.

Fitting takes at most ``max_train`` labelled texts of each label, drawn by a hash of id and text, and at most ``max_grams`` features of them. Spark finds
those texts; one task of an executor trains on them, and only the weights that aren't 0 come back. How far a log ratio must lie from 0 for
its feature to take part is a setting, chosen by cross-validation over training texts alone. Scoring covers every text in whole and is a projection: no
shuffle, one small weight array per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .work import read_table


@dataclass(frozen=True)
class Settings:
    sizes: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 20
    #: Training texts of each label, and features of them all (4 bytes each in the training task).
    max_train: int = 2500
    max_grams: int = 100_000_000
    #: Standard errors that a log ratio must lie from 0 for its feature to enter the regression. Of several, the one with the least cross-validated loss on
    #: the training texts is taken; the default is what that chose of 2.5 to 6 on two tables of different size.
    significance: tuple[float, ...] = (4.0,)
    folds: int = 4
    alpha: float = 1.0
    penalty: float = 1e-3
    steps: int = 120
    seed: int = 29


@dataclass(frozen=True)
class Model:
    """Weights of the features that have one (the log-count ratio is in them), the bias, and the significance that was chosen."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    significance: float

    def dense(self, bits: int) -> np.ndarray:
        out = np.zeros(1 << bits, np.float32)
        out[self.index] = self.weight
        return out


class Grams:
    """The distinct hashed n-grams of one text after another; the scratch array finds repeats without sorting."""

    def __init__(self, settings: Settings):
        self.sizes, self.shift = settings.sizes, np.uint64(64 - settings.bits)
        self.seen = np.zeros(1 << settings.bits, np.int64)

    def __call__(self, text: str | None) -> np.ndarray:
        c = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        found = []
        for n in self.sizes:
            if len(c) >= n:
                h = np.full(len(c) - n + 1, n, np.uint64)
                for k in range(n):
                    h = (h ^ c[k : len(c) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                found.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> self.shift).astype(np.int64))
        if not found:
            return np.empty(0, np.int64)
        h = np.concatenate(found)
        at = np.arange(len(h))
        self.seen[h] = at
        return h[self.seen[h] == at]


def label_counts(rows: list[np.ndarray], y: np.ndarray, dim: int) -> np.ndarray:
    """In how many texts of each label (0, 1) a feature stands."""
    counts = np.zeros((2, dim), np.int32)
    for label in (0, 1):
        own = [r for r, t in zip(rows, y) if t == label]
        for at in range(0, len(own), 128):
            counts[label] += np.bincount(np.concatenate(own[at : at + 128]), minlength=dim).astype(np.int32)
    return counts


def log_ratios(counts: np.ndarray, n: tuple[int, int], alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """The log-count ratio of each feature, and how many of its standard errors it lies from 0."""
    q, p = counts[0] + alpha, counts[1] + alpha
    ratio = np.log(p / (n[1] + 2 * alpha)) - np.log(q / (n[0] + 2 * alpha))
    return ratio, np.where(counts.any(axis=0), np.abs(ratio) / np.sqrt(1 / p + 1 / q), 0.0)


def regress(doc: np.ndarray, col: np.ndarray, scale: np.ndarray, y: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias of the regression of ``y`` on the scaled features; text doc[i] has feature col[i]. Both labels weigh the same in all."""
    x = scale[col]
    weight_of = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    k = len(scale)
    w, b = np.full(k, 0.05), 0.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, settings.steps + 1):
        z = np.bincount(doc, weights=x * w[col], minlength=len(y)) + b
        err = weight_of * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.r_[np.bincount(col, weights=x * err[doc], minlength=k) + settings.penalty * w, err.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def placed(rows: list[np.ndarray], used: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs of the features in ``used``, which are numbered in its order."""
    number = np.full(dim, -1, np.int32)
    number[used] = np.arange(len(used))
    found = [f[f >= 0] for f in (number[r] for r in rows)]
    return np.repeat(np.arange(len(rows), dtype=np.int32), [len(f) for f in found]), np.concatenate([np.empty(0, np.int32), *found])


def held_loss(rows: list[np.ndarray], y: np.ndarray, fold: np.ndarray, settings: Settings) -> list[float]:
    """Cross-validated log loss, both labels weighing the same, of each significance; counts, ratios and weights come from the other folds only."""
    dim, levels = 1 << settings.bits, sorted(settings.significance)
    loss = [0.0] * len(levels)
    for f in range(settings.folds):
        train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if not len(test) or len(set(y[train].tolist())) < 2:
            continue
        own = [rows[i] for i in train]
        ratio, spread = log_ratios(label_counts(own, y[train], dim), (int((1 - y[train]).sum()), int(y[train].sum())), settings.alpha)
        used = np.flatnonzero(spread > levels[0])
        (doc, col), (doc_t, col_t) = placed(own, used, dim), placed([rows[i] for i in test], used, dim)
        for k, level in enumerate(levels):
            scale = np.where(spread[used] > level, ratio[used], 0.0)
            w, b = regress(doc, col, scale, y[train], settings)
            z = np.bincount(doc_t, weights=(scale * w)[col_t], minlength=len(test)) + b
            t = y[test]
            loss[k] += float((np.logaddexp(0, np.where(t > 0, -z, z)) * np.where(t > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))).sum())
    return loss


def train(rows: list[np.ndarray], labels: np.ndarray, settings: Settings) -> Model:
    """The model of some texts' features and labels (0 or 1), in their order."""
    dim, y = 1 << settings.bits, labels.astype(float)
    if not len(rows) or y.min() == y.max():  # nothing to tell apart: the label's share is the score
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.empty(0, np.int64), np.empty(0, np.float32), float(np.log(share / (1 - share))), 0.0)
    levels = sorted(settings.significance)
    fold = np.empty(len(y), np.int64)
    for label in (0, 1):  # each fold has its share of both labels
        own = np.flatnonzero(y == label)
        fold[own] = np.arange(len(own)) % settings.folds
    level = levels[int(np.argmin(held_loss(rows, y, fold, settings)))] if len(levels) > 1 and min(y.sum(), (1 - y).sum()) >= settings.folds else levels[0]
    ratio, spread = log_ratios(label_counts(rows, y, dim), (int((1 - y).sum()), int(y.sum())), settings.alpha)
    used = np.flatnonzero(spread > level)
    w, b = regress(*placed(rows, used, dim), ratio[used], y, settings)
    return Model(used, (ratio[used] * w).astype(np.float32), float(b), level)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def training_texts(docs: DataFrame, labels: DataFrame, settings: Settings, label: str) -> DataFrame:
    """(place, y, text): at most ``max_train`` texts of each label. Ids with ``held_out``, null ids, null labels and labels without a document are left out;
    an id with contradicting labels counts as toxic; rows that repeat an id and a text are one."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col(label).cast("double") > 0).cast("int")).alias("y"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    drawn = texts.select("doc_id", F.xxhash64(F.lit(settings.seed), "doc_id", "text").alias("place")).join(marks, "doc_id").distinct()
    # top-k on each side: every task keeps max_train rows at most
    chosen = [drawn.filter(F.col("y") == y).orderBy("place", "doc_id").limit(settings.max_train) for y in (1, 0)]
    # at most 2 * max_train rows: a bounded side
    own = texts.withColumn("place", F.xxhash64(F.lit(settings.seed), "doc_id", "text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), ["doc_id", "place"])
    return own.groupBy("place", "doc_id", "y").agg(F.first("text").alias("text")).select("place", "y", "text")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "toxic") -> Model:
    """The model of ``training_texts``, trained in one task: the sample is bounded, whatever the tables' size."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, y, held = Grams(settings), [], [], 0
        for batch in batches:
            for label_, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                r = own(text.as_py()).astype(np.int32)
                if held + len(r) <= settings.max_grams:
                    rows.append(r), y.append(label_)
                    held += len(r)
        model = train(rows, np.array(y, np.int64), settings)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (model.index.astype("<i4").tobytes(), model.weight.astype("<f4").tobytes(), model.bias, model.significance)], ["index", "weight", "bias", "significance"])

    texts = training_texts(docs, labels, settings, label).repartition(1).sortWithinPartitions("place")
    found = texts.mapInArrow(learn, "index binary, weight binary, bias double, significance double").first()
    if found is None:
        return train([], np.empty(0), settings)
    return Model(np.frombuffer(found["index"], "<i4").astype(np.int64), np.frombuffer(found["weight"], "<f4"), found["bias"], found["significance"])


def score(docs: DataFrame, model: Model, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1). A null or empty text has the score of its two blanks, that is of the bias. Columns pass through; one named
    ``score`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as many entries as significant features

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Grams(settings)
        weights, bias = shared.value.dense(settings.bits), shared.value.bias
        for part in parts:
            z = np.array([float(weights[own(t)].sum()) + bias for t in part])
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))), dtype="float64")

    return docs.withColumn("score", F.pandas_udf(run, "double")(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.5) -> DataFrame:
    """``docs`` with held_out, score and predicted (1 from ``threshold`` on). Without labels, or with one kind only, every score is the label's share.

    ``labels``: doc_id and a column ``toxic`` of any number type, above 0 for toxic; further columns are of no effect. Only the text enters a score:
    repeated rows are scored each, and equal texts score alike. A null id is never held out and never learned from. Columns of ``docs`` pass through, but
    for those named held_out, score and predicted, which are replaced. An empty table gives an empty result.
    """
    scored = score(docs, fit(docs, labels, settings), settings)
    return scored.withColumns({"held_out": F.coalesce(held_out(F.col("doc_id")), F.lit(False)), "predicted": (F.col("score") >= threshold).cast("int")})


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
