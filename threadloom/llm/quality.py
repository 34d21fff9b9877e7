"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; the unlabelled side is a sample of documents of the training folds that have
no label. Labels of quality 0 are never looked at. The class prior is estimated from both sides alone: a classifier of positives
against unlabelled rows is fitted on one half of them, the other half is ordered by its scores, and the prior is the least ratio, over
the thresholds, of the shares of unlabelled and of positive rows above a threshold (the best bin, with its confidence bound). A network with one
hidden layer then minimises the non-negative unbiased risk

    prior * E_p[l(f, 1)] + max(0, E_u[l(f, 0)] - prior * E_p[l(f, 0)]),   l the logistic loss,

so that its sigmoid estimates P(positive). Inputs are statistics of the whole text alone.

The fit takes at most ``SAMPLE_ROWS`` documents on either side, the first by a hash of their id; every document is
scored. Cases: null and empty texts have statistics of zero words and so a score; where either side is empty every score is 0.5;
a null id is never held out and never sampled; repeated rows each give a row, and of rows of one id one is sampled;
labels of unknown documents are not used; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped

FOLDS, CUT, SEED = 5, 0.3, 7
#: Documents of the fit at most: positives, and as many unlabelled ones.
SAMPLE_ROWS = 6000
#: Chance that the bound of a bin is wrong, and least prior.
DOUBT, LEAST_PRIOR = 0.1, 0.05
HIDDEN, STEPS, BATCH, LEARNING_RATE, DECAY = 16, 1500, 512, 0.01, 1e-4

_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = 5
_CLASS[ord("!")] = 6
_CLASS[ord("|")] = 7
_CLASS[[ord(c) for c in "*#%$&@^~_=+<>[]{}\\/`"]] = 8
_CLASS[128:] = 9
_KINDS = 10


def statistics(text: str) -> list[float]:
    """Numbers that describe a text: shares of character classes, word shapes and repetition."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = _CLASS[raw]
    share = np.bincount(kinds, minlength=_KINDS) / max(1, len(raw))
    words = text.split()
    n = len(words)
    distinct = len(set(words))
    pairs = list(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x]
    gap = kinds == 1
    before_gap = kinds[:-1][gap[1:]] if len(raw) > 1 else kinds[:0]
    odd_ends = np.isin(before_gap, (6, 7, 8)).mean() if len(before_gap) else 0.0
    letters = share[3] + share[4] + share[9]
    upper = text[:1].isupper() if n == 1 else 0
    return [
        np.log1p(n), n and len(text) / n, share[2], share[3], share[4], share[5], share[6], share[7], share[8], share[9],
        share[3] / letters if letters else 0.0, float(odd_ends),
        distinct / n if n else 0.0, np.log1p(distinct) / np.log1p(n) if n else 0.0,
        sum(map(eq, words, words[1:])) / max(1, n - 1), len(set(pairs)) / max(1, len(pairs)),
        len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)) / 100, float(upper), float(n == 0),
    ]


WIDTH = len(statistics(""))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = SEED) -> Model:
    """Adam on the non-negative risk. Where its negative part falls under zero, a step follows that part's ascent instead.

    Without a prior it is fitted to tell positives from unlabelled rows."""
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 0.5, (unlabelled.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.5, HIDDEN), np.zeros(())]
    first, second = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    p_all, u_all = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    sigmoid = lambda f: 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    ones, zeros = np.ones(BATCH), np.zeros(BATCH)
    for step in range(1, STEPS + 1):
        p, u = p_all[rng.integers(0, len(p_all), BATCH)], u_all[rng.integers(0, len(u_all), BATCH)]
        x = np.concatenate((p, u))
        hidden = np.tanh(x @ w[0] + w[1])
        f = hidden @ w[2] + w[3]
        s = sigmoid(f)
        if prior is None:
            g = (s - np.concatenate((ones, zeros))) / BATCH
        else:
            as_zero = np.logaddexp(0, f)
            negative = as_zero[BATCH:].mean() - prior * as_zero[:BATCH].mean()
            g = np.concatenate((-prior * s[:BATCH], s[BATCH:])) / BATCH
            g = g + np.concatenate((prior * (s[:BATCH] - 1), zeros)) / BATCH if negative >= 0 else -g
        back = np.outer(g, w[2]) * (1 - hidden**2)
        rate = LEARNING_RATE * min(1, 2 * (1 - step / (STEPS + 1)))
        for i, d in enumerate((x.T @ back, back.sum(0), hidden.T @ g, g.sum())):
            d = d + DECAY * w[i]
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.999 * second[i] + 0.001 * d * d
            w[i] = w[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, tuple(w), 0.5 if prior is None else prior)


def best_bin(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior among the scores of unlabelled rows: the share of them over the share of positives above the threshold where
    the ratio, with the bound of its error, is least."""
    thresholds = np.unique(positive)
    above = lambda x: 1 - np.searchsorted(np.sort(x), thresholds) / len(x)
    p, u = above(positive), above(unlabelled)
    error = math.sqrt(math.log(4 / DOUBT) / 2 / len(positive)) + math.sqrt(math.log(4 / DOUBT) / 2 / len(unlabelled))
    best = int(np.argmin((u + error) / p))
    return float(np.clip(u[best] / p[best], LEAST_PRIOR, 0.99))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """best_bin over scores of halves that took no part in their classifier, the mean of both ways round."""
    halves = [(x[::2], x[1::2]) for x in (positive, unlabelled)]
    if min(len(h) for pair in halves for h in pair) == 0:
        return 0.5
    found = []
    for one in (0, 1):
        told = fit(halves[0][one], halves[1][one], None)
        found.append(best_bin(*(told.logits(h[1 - one]) for h in halves)))
    return sum(found) / 2


def fold(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS, F.lit(1))


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on documents of the training folds; what reaches the driver is at most 2 * sample_rows rows of statistics."""
    rated = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = documents.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id")
    pick = lambda df, side: df.distinct().orderBy(F.xxhash64(F.lit(side), "doc_id"), "doc_id").limit(sample_rows).select("doc_id", F.lit(side).alias("side"))
    sample = pick(ids.join(rated.where("quality = 1"), "doc_id", "left_semi"), 1).unionByName(pick(ids.join(rated, "doc_id", "left_anti"), 0))
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "side", "text")  # at most 2 * sample_rows ids
    kind = documents.select("doc_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[float(v) for v in statistics(t or "")] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "side", "x"])

    held = mapped(texts, run, f"doc_id {kind}, side int, x array<double>").groupBy("doc_id", "side").agg(F.min("x").alias("x"))
    rows = [(r["side"], r["x"]) for r in held.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    sides = [np.array([x for s, x in rows if s == side]) for side in (1, 0)]
    if not len(sides[0]) or not len(sides[1]):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), (), 0.5)
    return fit(*sides, estimated_prior(*sides))


def score_documents(documents: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                x = np.array([statistics(t or "") for t in part.column(2).to_pylist()], np.float64)
                score = np.round(model.scores(x), 6)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = documents.select("doc_id").schema[0].dataType.simpleString()
    rows = documents.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "text")
    return mapped(rows, run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_predicted(documents: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of documents, all columns, whose score reaches the cut; scored in place, so ids need not be unique."""
    names = documents.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                x = np.array([statistics(t or "") for t in part.column(at).to_pylist()], np.float64)
                yield part.filter(pa.array(np.round(model.scores(x), 6) >= cut))

    return mapped(documents, run, documents.schema)
