"""Language ID with a byte convolutional network, trained in numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import crc32_remainder

#: Bytes of a window, sizes of the filters, filters of each size, numbers for a byte.
WINDOW, WIDTHS, FILTERS, EMBEDDED = 160, (2, 3, 4, 5), 8, 8
#: Labelled documents sampled for learning, about, and windows of each.
SAMPLE, WINDOWS_EACH = 4_000, 4
STEPS, BATCH, RATE = 700, 96, 0.01


def windows(text: str, size: int = WINDOW) -> np.ndarray:
    """The windows of a whole text's bytes, in lower case, a row each; the last ends with the text; a shorter text is padded with zeros."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    if len(raw) < size:
        raw = np.concatenate((raw, np.zeros(size - len(raw), np.uint8)))
    whole = len(raw) // size
    rows = raw[: whole * size].reshape(whole, size)
    return rows if len(raw) == whole * size else np.concatenate((rows, raw[None, -size:]))


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDED
    filters: list[np.ndarray]  # width x EMBEDDED x FILTERS
    offsets: list[np.ndarray]
    dense: np.ndarray
    bias: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """For each width and place in it, what each byte adds to the filters."""
        return [np.stack([(self.embedding @ f[j]).astype(np.float32) for j in range(len(f))]) for f in self.filters]

    def probabilities(self, rows: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        """Softmax of each window: filters, max over places, dense layer."""
        tables = self.tables() if tables is None else tables
        out = []
        for at in range(0, len(rows), 64):
            some, pooled = rows[at : at + 64].astype(np.intp), []
            size = some.shape[1]
            part = np.empty((len(some), size, FILTERS), np.float32)
            for table, offset in zip(tables, self.offsets, strict=True):
                n = size - len(table) + 1
                total = np.take(table[0], some, axis=0, mode="clip")[:, :n]
                for j in range(1, len(table)):
                    total += np.take(table[j], some, axis=0, out=part, mode="clip")[:, j : n + j]
                pooled.append(np.maximum(total.max(axis=1) + offset, 0))
            out.append(np.concatenate(pooled, axis=1) @ self.dense + self.bias)
        z = np.concatenate(out)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(rows: np.ndarray, classes: np.ndarray, languages: list[str], seed: int = 3) -> Network:
    """A network from windows and the numbers of their languages: Adam on the cross-entropy, classes equally often."""
    rng = np.random.default_rng(seed)
    k, d = len(languages), FILTERS * len(WIDTHS)
    params = [rng.normal(0, 0.5, (256, EMBEDDED))]
    params += [rng.normal(0, 1 / math.sqrt(w * EMBEDDED), (w, EMBEDDED, FILTERS)) for w in WIDTHS]
    params += [np.zeros(FILTERS) for _ in WIDTHS]
    params += [rng.normal(0, 1 / math.sqrt(d), (d, k)), np.zeros(k)]
    members = [np.flatnonzero(classes == c) for c in range(k)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    nw = len(WIDTHS)
    for step in range(STEPS):
        y = rng.integers(k, size=BATCH)
        x = rows[[members[c][rng.integers(len(members[c]))] for c in y]].copy()
        x[rng.random(x.shape) < 0.02] = 32
        e = params[0][x]
        pooled, places, live = [], [], []
        for i, w in enumerate(WIDTHS):
            n = x.shape[1] - w + 1
            seen = np.lib.stride_tricks.sliding_window_view(e, w, axis=1)  # BATCH, n, EMBEDDED, w
            act = seen.transpose(0, 1, 3, 2).reshape(BATCH, n, -1) @ params[1 + i].reshape(-1, FILTERS)
            at = act.argmax(axis=1)
            top = np.take_along_axis(act, at[:, None], 1)[:, 0] + params[1 + nw + i]
            places.append(at)
            live.append(top > 0)
            pooled.append(np.maximum(top, 0))
        h = np.concatenate(pooled, axis=1)
        z = h @ params[-2] + params[-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(BATCH), y] -= 1
        p /= BATCH
        grads = [np.zeros_like(a) for a in params]
        grads[-2], grads[-1] = h.T @ p + 1e-4 * params[-2], p.sum(0)
        back = p @ params[-2].T
        for i, w in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS] * live[i]
            grads[1 + nw + i] = g.sum(0)
            for j in range(w):
                byte = x[np.arange(BATCH)[:, None], places[i] + j]  # BATCH, FILTERS
                grads[1 + i][j] = np.einsum("bfe,bf->ef", params[0][byte], g)
                np.add.at(grads[0], byte, g[:, :, None] * params[1 + i][j].T[None])
        rate = RATE * (1 - step / STEPS) + 1e-4
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[i] / (1 - 0.999 ** (step + 1))) + 1e-8)
    return Network(languages, params[0], params[1 : 1 + nw], [o.astype(np.float32) for o in params[1 + nw : 1 + 2 * nw]], params[-2].astype(np.float32), params[-1].astype(np.float32))


def _sampled(batches):
    for batch in batches:
        langs, ids, cut = [], [], []
        for text, lang, doc_id in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "doc_id")), strict=True):
            if any(map(str.isalpha, text)):
                rows = windows(text)
                for i in np.unique(np.linspace(0, len(rows) - 1, WINDOWS_EACH).astype(int)):
                    langs.append(lang)
                    ids.append(doc_id)
                    cut.append(rows[i].tobytes())
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(cut, pa.binary())], names=["doc_id", "lang", "window"])


def learn(docs: DataFrame, folds: int = 3, held_out: int = 1, sample: int = SAMPLE) -> Network | None:
    """A network from windows of about `sample` documents with a language, none of the held-out fold; none without such.

    The sample is a fixed share of hashes of doc_id; only its windows, at most
    WINDOWS_EACH of WINDOW bytes a document, go to the driver.
    """
    told = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc32_remainder("doc_id", folds) != held_out))
    total = docs.count()
    share = min(1.0, sample / max(1, total))
    chosen = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = told.where(chosen).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = sorted((r["lang"], bytes(r["window"])) for r in rows.mapInArrow(_sampled, "doc_id long, lang string, window binary").select("lang", "window").collect())
    if not found:
        return None
    languages = sorted({lang for lang, _ in found})
    return train(np.array([np.frombuffer(w, np.uint8) for _, w in found]), np.array([languages.index(lang) for lang, _ in found]), languages)


def _predicted(network: Network | None):
    def predict(batches):
        tables = network.tables() if network else None
        for batch in batches:
            texts, langs, scores = batch.column("text").to_pylist(), [], []
            for at in range(0, len(texts), 64):
                rows, sizes = [], []
                for text in texts[at : at + 64]:
                    judged = network is not None and text is not None and any(map(str.isalpha, text))
                    rows.append(windows(text) if judged else np.empty((0, WINDOW), np.uint8))
                    sizes.append(len(rows[-1]))
                p = network.probabilities(np.concatenate(rows), tables) if sum(sizes) else None
                stop = 0
                for n in sizes:
                    start, stop = stop, stop + n
                    mean = p[start:stop].mean(axis=0) if n else None
                    langs.append(network.languages[int(mean.argmax())] if n else "und")
                    scores.append(float(min(1.0, mean.max())) if n else 0.0)
            own = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.record_batch([*own, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "lang_score"])

    return predict


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, text, lang, source, n_chars, lang_pred, lang_score of every document.

    The text alone is judged: all its windows go through the network in
    batches, and their mean probabilities decide (ties: the first language by
    name). Texts that are null or have no letter, and all without a network,
    are `und` with score 0. Nulls and repeated rows stay; columns other than
    the five are ignored, missing ones are null; an empty table gives none.
    """
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    rows = docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    return rows.mapInArrow(_predicted(network), ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", lang_pred string, lang_score double")
