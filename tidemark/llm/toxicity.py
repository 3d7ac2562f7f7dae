"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, and one on toxic text, namely on those parts of its
words that ordinary text all but lacks (trained on whole toxic texts it learns what all text shares).  Parts are
chosen one by one, the surest first, and each takes the words that it explains, so that the words of a small
language count as those of a large one do.  A document is cut into windows of whole words, and each window is
compressed with the ordinary dictionary and with both, the toxic one behind it; the bytes between the two are its
distance.  No match reaches over the end of a word, so neighbours never hide a word.  A logistic function of the
distances of all windows gives the score.  It is calibrated on distances to dictionaries that were trained without
the text in question, and placed so that the threshold of the best F-measure (with precision weighing more) lies
at ``THRESHOLD``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from math import lgamma, log

import numpy as np
import zstandard as zstd
from pyspark.sql import DataFrame

from . import common

#: The fitting sample: texts of either label, their longest length, and the characters of either label in all.
PER_CLASS, MAX_CHARS, MAX_TOTAL = 4000, 20_000, 16_000_000
#: Words of a window; least bytes of a match, bytes of the dictionaries; bytes of ordinary text to train on, whole texts only.
WINDOW, MATCH, ORDINARY_BYTES, TOXIC_BYTES, TRAIN_BYTES = 10, 6, 24_000, 4_000, 4_000_000
#: Parts that the sample is dealt into: each is calibrated on with dictionaries of the others.
FOLDS = 3
#: A toxic part of a word stands in this many toxic texts and is this many times as frequent there; it begins as an
#: n-gram of one of these lengths in bytes and grows to the longest length while this share of its texts remains.
LEAST_TEXTS, RATIO, GRAMS, LONGEST, GROWS = 5, 4, (5, 6), 16, 0.8
#: The logarithm of how often the part's spread over both labels would come by chance among all n-grams looked at.
CHANCE = -3.0
THRESHOLD = 0.7
EDGES = " \t\n\r.,;:!?%$#&*\"'()[]"
#: Precedes every window, so that zstandard always has something to compress and lengths stay comparable.
BALLAST = bytes(64)
#: Stands before and after every word; in windows a byte that no dictionary holds precedes it, another for each word.
BORDER = b" |"
STOPS = [bytes([i]) for i in range(1, 256) if i not in b"\t\n\r |"]


def normal(text: str) -> list[bytes]:
    return [w.encode() for w in (w.strip(EDGES) for w in text.lower().split()) if w]


def windows(words: list[bytes]) -> list[bytes]:
    return [BALLAST + b"".join(stop + BORDER + w + BORDER for stop, w in zip(STOPS, words[i : i + WINDOW], strict=False)) for i in range(0, len(words), WINDOW)]


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    bias: float


@lru_cache(maxsize=4)
def _compressor(content: bytes):  # noqa: ANN202
    # Rows of the hash table must not overflow, or what one dictionary adds pushes out what both have.
    params = zstd.ZstdCompressionParameters(
        window_log=17, hash_log=17, chain_log=15, search_log=5, min_match=MATCH, target_length=64, strategy=zstd.STRATEGY_GREEDY,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS,
    )
    book = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    book.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(compression_params=params, dict_data=book).compress


def window_distances(words: list[bytes], ordinary: bytes, toxic: bytes) -> list[int]:
    """For each window of a text's words, the bytes that it is shorter by under the toxic dictionary."""
    a, b = _compressor(ordinary), _compressor(toxic)
    return [len(a(w)) - len(b(w)) for w in windows(words)]


def distances(text: str, ordinary: bytes, toxic: bytes) -> list[int]:
    return window_distances(normal(text), ordinary, toxic)


def features(ds: list[int]) -> list[float]:
    """Of a document: the share of windows that are shorter, their mean and greatest gain, and how many there are."""
    n = len(ds)
    if not n:
        return [0.0] * 5
    hits = sum(d >= 2 for d in ds)
    return [float(np.sqrt(sum(d >= 1 for d in ds) / n)), float(np.sqrt(hits / n)), min(max(ds), 12) / 4, float(np.log1p(hits)), float(np.log1p(n)) / 4]


def _apart(texts: list[str]) -> list[str]:
    """Texts without near copies: of those that share one of their three least-hashed word 5-grams the first."""
    seen: set[int] = set()
    kept = []
    for t in texts:
        w = t.split()
        marks = sorted({zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4))})[:3]
        if not seen.intersection(marks):
            kept.append(t)
        seen.update(marks)
    return kept


def _grams(texts: list[list[bytes]], only: Counter | None = None) -> Counter:
    """In how many texts an n-gram (of ``only``) of a word, with the spaces around it, occurs."""
    found: Counter = Counter()
    of: dict[bytes, list[bytes]] = {}
    for t in texts:
        own: set[bytes] = set()
        for w in set(t):
            if w not in of:
                p = b" " + w + b" "
                of[w] = [g for n in GRAMS for i in range(len(p) - n + 1) if (g := p[i : i + n]) and (only is None or g in only)]
            own.update(of[w])
        found.update(own)
    return found


def chance(k: int, n: int, p: float) -> float:
    """A bound of the logarithm of the binomial tail: ``k`` or more of ``n`` texts are toxic where a share ``p`` is."""
    if k <= n * p:
        return 0.0
    most = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p)
    return most - log(1 - (n - k) / (k + 1) * p / (1 - p))


def _longer(part: bytes, words: list[bytes], texts: dict[bytes, int]) -> bytes:
    """The part with the neighbouring bytes that it has in nearly all its texts."""
    least = GROWS * _count(words, texts)
    while len(part) < LONGEST:
        wider: dict[bytes, list[bytes]] = {}
        for w in words:
            at = w.find(part)
            end = at + len(part)
            if at > 0:
                wider.setdefault(w[at - 1 : end], []).append(w)
            if 0 <= at and end < len(w):
                wider.setdefault(w[at : end + 1], []).append(w)
        n, best = max(((_count(ws, texts), g) for g, ws in wider.items()), default=(0, b""))
        if n < least:
            break
        part, words = best, wider[best]
    return part


def _count(words: list[bytes], texts: dict[bytes, int]) -> int:
    """In how many texts any of the words stands; ``texts`` has a bit for each."""
    held = 0
    for w in words:
        held |= texts[w]
    return held.bit_count()


def parts(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Parts of words, spaces around words included, that are toxic texts' own, the surest first.

    Each is an n-gram whose share of toxic texts isn't chance, grown to its longest form; words that hold it count
    for no later one.
    """
    p, found = len(toxic) / (len(toxic) + len(ordinary)), []
    ft = Counter({g: n for g, n in _grams(toxic).items() if n >= LEAST_TEXTS})
    fo = _grams(ordinary, ft)
    limit = CHANCE - log(max(1, len(ft)))
    sure = {g: c for g, n in ft.items() if n * len(ordinary) >= RATIO * (fo[g] + 0.5) * len(toxic) and (c := chance(n, n + fo[g], p)) < limit}
    texts: dict[bytes, int] = {}
    for i, t in enumerate(toxic):
        for w in set(t):
            texts[b" " + w + b" "] = texts.get(b" " + w + b" ", 0) | 1 << i
    of: dict[bytes, list[bytes]] = {}
    for w in texts:
        for g in {w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)} & sure.keys():
            of.setdefault(g, []).append(w)
    gone: set[bytes] = set()
    for g in sorted(sure, key=lambda g: (sure[g], g)):
        words = [w for w in of[g] if w not in gone]
        n = _count(words, texts)
        if n >= LEAST_TEXTS and chance(n, n + fo[g], p) < limit:
            found.append(_longer(g, words, texts))
            gone.update(w for w in words if found[-1] in w)
    return found


def _passages(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Of each toxic text the parts of its words that are toxic texts' own; texts without any are left out."""
    chosen = parts(toxic, ordinary)
    of: dict[bytes, list[bytes]] = {}
    found = []
    for t in toxic:
        own = []
        for w in t:
            if w not in of:
                of[w] = [c.replace(b" ", BORDER) for c in chosen if c in b" " + w + b" "]
            own += of[w]
        if own:
            found.append(b"\n".join(own) + b"\n")
    return found


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary that zstandard trains on the samples; of too little text, the text itself."""
    try:
        return zstd.train_dictionary(size, samples).as_bytes()[-size:]
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """The ordinary dictionary, and the same with the toxic one behind it, which is empty if toxic texts share nothing of their own."""
    plain, size = [], 0
    for t in ordinary:
        text = BORDER + (BORDER + b"\n" + BORDER).join(t) + BORDER
        size += len(text)
        if plain and size > TRAIN_BYTES:
            break
        plain.append(text)
    base, own = _trained(plain, ORDINARY_BYTES), _passages(toxic, ordinary)
    return base, base + (_trained(own, TOXIC_BYTES) if own else b"")


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w)) * 1e-2
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def best_threshold(logits: np.ndarray, y: np.ndarray, beta: float = 1.0) -> float:
    """The logit at or above which predicting 1 has the greatest F-measure (``beta`` under 1 weighs precision more)."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(y[order])
    f1 = (1 + beta * beta) * hits / (np.arange(1, len(y) + 1) + beta * beta * y.sum())
    f1[:-1][logits[order][:-1] == logits[order][1:]] = -1  # never between equal ones
    k = int(np.argmax(f1))
    below = logits[order][k + 1] if k + 1 < len(y) else logits[order][k] - 1
    return float((logits[order][k] + below) / 2)


def fit_texts(sample: list[tuple[str, int]]) -> Model:
    """Fit on labelled texts: each fold calibrates with dictionaries of the others, the model's are of all.

    With fewer than two texts of a label for each fold (``2 * FOLDS``, near copies once) there is nothing to compare, and
    every score is nearly 0; where toxic texts share nothing of their own, every score is their share.
    """
    words: dict[bytes, bytes] = {}
    by_label = [[[words.setdefault(w, w) for w in normal(t)] for t in _apart([t for t, y in sample if y == k])] for k in (0, 1)]
    if min(map(len, by_label)) < 2 * FOLDS:
        return Model(b"", b"", (0.0,) * 5, -30.0)
    x, y = [], []
    for fold in range(FOLDS):
        rest = [[t for i, t in enumerate(ts) if i % FOLDS != fold] for ts in by_label]
        ordinary, toxic = dictionaries(rest[1], rest[0])
        for k in (0, 1):
            mine = by_label[k][fold::FOLDS]
            x += [features(window_distances(t, ordinary, toxic)) for t in mine]
            y += [k] * len(mine)
    ordinary, toxic = dictionaries(by_label[1], by_label[0])
    if toxic == ordinary:  # too few toxic texts to share anything: every score is their share
        p = len(by_label[1]) / (len(by_label[0]) + len(by_label[1]))
        return Model(b"", b"", (0.0,) * 5, float(np.log(p / (1 - p))))
    x, y = np.array(x), np.array(y)
    w, b = _logistic(x, y)
    w = np.maximum(w, 0) if (w[:4] < 0).all() else w
    at = best_threshold(x @ w + b, y, 0.5)
    return Model(ordinary, toxic, tuple(float(v) for v in w), b - at + float(np.log(THRESHOLD / (1 - THRESHOLD))))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a bounded sample of labelled rows that are not held out, in one task of an executor.

    Null texts and labels take no part, of repeated ids one text does; without rows of both labels, empty
    tables too, the model gives every text one score.
    """
    return common.fit_sample(common.labelled_sample(docs, labels, "toxic", per_class, max_chars, id_col, text_col), fit_texts, MAX_TOTAL)


def score_text(text: str, model: Model) -> float:
    x = features(distances(text, model.ordinary, model.toxic)) if model.ordinary else [0.0] * 5
    return float(1 / (1 + np.exp(-(np.dot(x, model.weights) + model.bias))))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every whole text: ``id_col``, the columns of ``keep``, ``score``, ``predicted``.

    Null and empty texts have no windows and get the score of none.  Repeated rows give repeated
    results; an empty table gives an empty result; columns not named are not read.
    """
    carry = tuple(dict.fromkeys([id_col, *keep]))

    def fn(values: list[list]) -> dict:
        made = [score_text(t or "", model) for t in values[0]]
        return {"score": made, "predicted": [int(s >= THRESHOLD) for s in made]}

    return common.map_rows(df, [text_col], fn, "score double, predicted int", carry)
