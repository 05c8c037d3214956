"""A quality classifier by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import crc32_remainder, window_hashes, word_spans
from loomstead.llm.divergence import class_counts

#: Documents sampled for learning, about, whatever the corpus' size.
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 24, 512, 0.01, 1e-4
FEATURES = 26


def features(text: str | None) -> np.ndarray:
    """Numbers of a whole text: shares of character classes, repetition of words, runs, windows and lines, lengths."""
    out = np.zeros(FEATURES, np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    starts, ends, words = word_spans(raw)
    n = len(words)
    if not n:
        return out
    classes = class_counts(raw)
    out[:8] = classes / classes.sum()
    lengths = (ends - starts).astype(np.float64)
    _, counts = np.unique(words, return_counts=True)
    triples = window_hashes(words, 3)
    lines = raw.split(b"\n")
    filled = [x for x in lines if x.strip()]
    out[8] = math.log1p(n)
    out[9] = math.log1p(classes.sum())
    out[10] = len(counts) / n
    out[11] = math.log(len(counts) + 1) / math.log(n + 1)
    out[12] = counts.max() / n
    out[13] = float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0
    out[14] = len(np.unique(triples)) / len(triples)
    out[15] = len(set(filled)) / max(1, len(filled))
    out[16] = math.log1p(len(filled))
    out[17] = math.log1p(n / max(1, len(filled)))
    out[18] = math.log1p(lengths.mean())
    out[19] = math.log1p(lengths.std())
    out[20] = math.log1p(lengths.max())
    out[21] = float((lengths <= 3).mean())
    out[22] = float((lengths == 1).mean())
    out[23] = float((lengths >= 12).mean())
    data = np.frombuffer(raw, np.uint8)
    heads, tails = data[starts], data[ends - 1]
    out[24] = float(((heads >= 65) & (heads <= 90)).mean())
    out[25] = float(((tails < 48) | (tails >= 58) & (tails < 65) | (tails >= 91) & (tails < 97) | (tails >= 123) & (tails < 128)).mean())
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _trained(xp: np.ndarray, xu: np.ndarray, prior: float | None, seed: int) -> list[np.ndarray]:
    """Weights that minimise the non-negative risk for a prior; without one, that tell trusted from unlabelled.

    The risk is prior * R+(P) + max(0, R-(U) - prior * R-(P)), with the
    logistic loss. Where a batch's second part is negative, the step goes up
    its gradient instead, as the non-negative estimator asks.
    """
    rng = np.random.default_rng(seed)
    d = xp.shape[1]
    w = [rng.normal(0, 1 / math.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    steps = max(1, math.ceil(len(xu) / BATCH)) * EPOCHS
    for step in range(steps):
        p, u = xp[rng.integers(len(xp), size=BATCH)], xu[rng.integers(len(xu), size=BATCH)]
        x = np.concatenate((p, u))
        h = np.tanh(x @ w[0] + w[1])
        z = h @ w[2] + w[3][0]
        zp, zu = z[:BATCH], z[BATCH:]
        if prior is None:
            g = np.concatenate((-_sigmoid(-zp), _sigmoid(zu))) / (2 * BATCH)
        else:
            rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            minus = np.concatenate((-prior * _sigmoid(zp), _sigmoid(zu))) / BATCH
            plus = np.concatenate((-prior * _sigmoid(-zp), np.zeros(BATCH))) / BATCH
            g = plus + minus if rest >= 0 else -minus
        gh = np.outer(g, w[2]) * (1 - h * h)
        grads = [x.T @ gh + DECAY * w[0], gh.sum(0), h.T @ g + DECAY * w[2], np.array([g.sum()])]
        t += 1
        rate = RATE * (1 - step / steps)
        for i, grad in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad * grad
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return w


def estimated_prior(trusted: np.ndarray, unlabelled: np.ndarray, certainty: float = 0.1) -> float:
    """Share of positives among the unlabelled, from scores of both: the least ratio of the shares above a cut, with its error bound."""
    slack = math.sqrt(math.log(4 / certainty) / (2 * len(trusted))) + math.sqrt(math.log(4 / certainty) / (2 * len(unlabelled)))
    trusted, unlabelled = np.sort(trusted), np.sort(unlabelled)
    cuts = trusted[: max(1, int(len(trusted) * 0.9))]
    above_p = 1 - np.arange(len(cuts)) / len(trusted)
    above_u = 1 - np.searchsorted(unlabelled, cuts) / len(unlabelled)
    best = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit(trusted: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> Model | None:
    """A model from the features of trusted positives and unlabelled texts; none without either."""
    if not len(trusted) or not len(unlabelled):
        return None
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    xp, xu = (np.clip((x - mean) / scale, -8, 8) for x in (trusted, unlabelled))
    order = np.random.default_rng(seed).permutation(len(xp))
    half, rest = order[: max(1, len(xp) // 2)], order[len(xp) // 2 :]
    one = Model(np.zeros(1), np.ones(1), _trained(xp[half], xu[::2], None, seed), 0.5)
    prior = estimated_prior(one.logits(xp[rest]), one.logits(xu[1::2] if len(xu) > 1 else xu))
    return Model(mean, scale, _trained(xp, xu, prior, seed + 1), prior)


def _as_features(batches):
    for batch in batches:
        rows = [features(t).tolist() for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("quality"), pa.array(rows, pa.list_(pa.float32()))], names=["quality", "x"])


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample: int = SAMPLE) -> Model | None:
    """A model from a sample of about `sample` documents, none of them of the held-out fold.

    The sample is a fixed share of hashes of doc_id. Its documents labelled 1
    are the trusted positives (a doc_id with differing labels counts by its
    least); all its documents, without their labels, are the unlabelled text.
    Only features of the sample go to the driver.
    """
    total = docs.count()
    share = min(1.0, sample / max(1, total))
    chosen = (F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))) & (crc32_remainder("doc_id", folds) != held_out)
    texts = docs.where(chosen).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where(chosen).groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.min("quality").cast("int").alias("quality"))
    rows = texts.join(known, texts.doc_id == known.of, "left").select("quality", "text").mapInArrow(_as_features, "quality int, x array<float>")
    found = rows.toArrow()
    if not found.num_rows:
        return None
    x = np.array(found["x"].to_pylist(), np.float64)
    y = np.array([q == 1 for q in found["quality"].to_pylist()])
    order = np.lexsort(x.T[::-1])  # the sample's rows come in any order; learning is the same for all
    return fit(x[order][y[order]], x[order])


def _scored(model: Model | None):
    def score(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = np.array([features(t) for t in texts], np.float64).reshape(-1, FEATURES)
            if model is None:
                scores = np.full(len(texts), 0.5)
            else:
                clipped = model.mean + model.scale * np.clip((x - model.mean) / model.scale, -8, 8)
                scores = np.where(x[:, 9] > 0, model.scores(clipped), 0.0)
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return score


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of every document; the text is the only input.

    Null, empty and blank texts score 0; without a model all others score 0.5.
    Null ids and repeated rows stay; other columns are ignored; an empty table
    gives none; whole texts count, however long.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scored(model), "doc_id long, score double")
