"""Document quality by a factorisation machine.

A document is a sparse vector: hashed words (by log count, of unit length), structure statistics, and its
length as metadata.  The machine adds to a linear score the interactions of all pairs of features through
``RANK`` latent factors; the sum-of-squares identity scores them in time linear in the features.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import common
from .toxicity import best_threshold

#: The fitting sample: texts of either label, their longest length, and the characters of either label in all.
PER_CLASS, MAX_CHARS, MAX_TOTAL = 4000, 20_000, 16_000_000
BUCKETS, RANK = 1 << 16, 8
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.05, 1e-5
THRESHOLD = 0.5
STATS = 16

_UPPER, _DIGIT, _SPACE, _STOP = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n", b".,;:!?"
_SIGN = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOP)


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Structure statistics and metadata of a text, each of about unit size."""
    raw = text.encode()
    n, w = max(len(raw), 1), max(len(words), 1)
    share = lambda cs: (len(raw) - len(raw.translate(None, cs))) / n
    lines = text.split("\n")
    filled = [x for x in lines if x.strip()] or [""]
    distinct = len(set(filled))
    upper, digit, sign, stop = share(_UPPER), share(_DIGIT), share(_SIGN), share(_STOP)
    top = max(counts.values(), default=0)
    return [
        1.0, min(1.0, 4 * upper), min(1.0, 8 * digit), min(1.0, 8 * sign), min(1.0, 8 * stop), float(sign > 0.05), float(upper > 0.3),
        min(1.0, len(text) / w / 20), len(counts) / w, min(1.0, 5 * top / w), 1 - distinct / len(filled), min(1.0, np.log1p(len(lines)) / 6),
        min(1.0, np.log1p(n / len(lines)) / 10), min(1.0, 20 * raw.count(b"|") / w), np.log1p(len(words)) / 10, np.log1p(len(text)) / 12,
    ]


def vector(text: str) -> tuple[list[int], list[float]]:
    """Feature indices and values of a text: first the statistics, then the hashed words."""
    words = text.split()
    counts = Counter(words)
    idx, val = list(range(STATS)), statistics(text, words, counts)
    if counts:
        made = np.log1p(np.fromiter(counts.values(), dtype=float, count=len(counts)))
        idx += [STATS + (zlib.crc32(w.encode()) & (BUCKETS - 1)) for w in counts]
        val += (made / np.sqrt((made * made).sum())).tolist()
    return idx, val


def stack(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of texts: indices, values, and where each row begins."""
    made = [vector(t) for t in texts]
    starts = np.cumsum([0, *(len(i) for i, _ in made[:-1])]) if made else np.zeros(0, int)
    return np.concatenate([np.array(i) for i, _ in made]), np.concatenate([np.array(v, dtype=np.float32) for _, v in made]), starts


@dataclass(frozen=True)
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def logits(model: Model, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Scores of sparse rows by the sum-of-squares identity: pairs = ((sum v x)^2 - sum (v x)^2) / 2."""
    vx = model.factors[idx] * val[:, None]
    sums = np.add.reduceat(vx, starts, axis=0)
    squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
    return model.bias + np.add.reduceat(model.linear[idx] * val, starts) + ((sums * sums).sum(axis=1) - squares) / 2


def fit_texts(sample: list[tuple[str, int]]) -> Model:
    """Fit by AdaGrad on logistic loss, both labels weighing the same; a fifth of the texts places the threshold.

    With fewer than 20 texts, or without texts of both labels, there is too little to fit: every text gets one score, near 1
    if most texts given are good, near 0 if most aren't, and 0.5 if as many are or there are none.
    """
    y = np.array([k for _, k in sample], dtype=float)
    rng = np.random.default_rng(5)
    n = STATS + BUCKETS
    linear, factors, bias = np.zeros(n, np.float32), rng.normal(0, 0.02, (n, RANK)).astype(np.float32), 0.0
    if len(set(y.tolist())) < 2 or len(y) < 20:
        return Model(float(30 * (2 * y.mean() - 1)) if len(y) else 0.0, linear, factors * 0)
    rows = [(np.array(i, np.int32), np.array(v, np.float32)) for i, v in (vector(t) for t, _ in sample)]
    train = np.array([i for i in range(len(rows)) if i % 5])
    check = np.array([i for i in range(len(rows)) if i % 5 == 0])
    weight = np.where(y > 0, 0.5 / max(y[train].mean(), 1e-9), 0.5 / max(1 - y[train].mean(), 1e-9))
    g_linear, g_factors, g_bias = np.full(n, 1e-6, np.float32), np.full((n, RANK), 1e-6, np.float32), 1e-6

    def batch(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = [len(rows[i][0]) for i in which]
        return (
            np.concatenate([rows[i][0] for i in which]), np.concatenate([rows[i][1] for i in which]),
            np.cumsum([0, *sizes[:-1]]), np.repeat(np.arange(len(which)), sizes),
        )

    for _ in range(EPOCHS):
        order = rng.permutation(train)
        for at in range(0, len(order), BATCH):
            which = order[at : at + BATCH]
            idx, val, starts, row = batch(which)
            f = factors[idx]
            vx = f * val[:, None]
            sums = np.add.reduceat(vx, starts, axis=0)
            z = bias + np.add.reduceat(linear[idx] * val, starts) + ((sums * sums).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts)) / 2
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[which]) * weight[which] / len(which)
            at_row = err[row] * val
            d_linear = np.bincount(idx, at_row, n).astype(np.float32)
            used = np.unique(idx)
            d_factor = at_row[:, None] * (sums[row] - vx)
            grad = np.zeros((len(used), RANK), np.float32)
            np.add.at(grad, np.searchsorted(used, idx), d_factor)
            d_lin = d_linear[used] + DECAY * linear[used]
            grad += DECAY * factors[used]
            g_linear[used] += d_lin * d_lin
            g_factors[used] += grad * grad
            g_bias += err.sum() ** 2
            linear[used] -= RATE * d_lin / np.sqrt(g_linear[used])
            factors[used] -= RATE * grad / np.sqrt(g_factors[used])
            bias -= RATE * err.sum() / np.sqrt(g_bias)
    model = Model(float(bias), linear, factors)
    z = logits(model, *batch(check)[:3])
    return Model(float(bias - _balanced(z, y[check])), linear, factors)


def _balanced(z: np.ndarray, y: np.ndarray) -> float:
    """The logit that rejects best: greatest F1 of the label 0."""
    if len(set(y.tolist())) < 2:
        return 0.0
    return -best_threshold(-z, 1 - y)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a bounded sample of labelled rows that are not held out, in one task of an executor.

    Null texts and labels take no part, of repeated ids one text does; without rows of both labels, empty
    tables too, the model gives every text one score.
    """
    return common.fit_sample(common.labelled_sample(docs, labels, "quality", per_class, max_chars, id_col, text_col), fit_texts, MAX_TOTAL)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every whole text: ``id_col``, the columns of ``keep``, ``score``, ``predicted``.

    Null texts count as empty; an empty text is scored by its statistics alone.  Repeated rows give
    repeated results; an empty table gives an empty result; columns not named are not read.
    """
    carry = tuple(dict.fromkeys([id_col, *keep]))
    shared = df.sparkSession.sparkContext.broadcast(model)  # of a size fixed by BUCKETS and RANK

    def fn(values: list[list]) -> dict:
        z = logits(shared.value, *stack([t or "" for t in values[0]]))
        made = (1 / (1 + np.exp(-np.clip(z, -30, 30).astype(float)))).tolist()
        return {"score": made, "predicted": [int(s >= THRESHOLD) for s in made]}

    return common.map_rows(df, [text_col], fn, "score double, predicted int", carry)
