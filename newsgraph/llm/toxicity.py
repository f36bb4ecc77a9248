"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD_BYTES, as_bytes, map_texts, remainder

#: Labelled rows of each class that the model is fitted on: those of smallest key hash.
SAMPLE = 4_000
#: Buckets of the hashed features.
FEATURES = 1 << 18
#: Features must be in this many sample documents, and in more toxic ones than chance gives by this many deviations.
LEAST = 3
DEVIATIONS = 3.5
THRESHOLD = 0.3
#: Words whose sums of weights a task remembers.
REMEMBERED = 400_000

_BREAKS = b".!?\n\r"
_TABLE = bytes(1 if b in _BREAKS else WORD_BYTES[b] for b in range(256))
_MARKS = {b"\0", b"\1"}
_SENTENCE = re.compile(rb"[^.!?\n\r]+")


def features(word: bytes) -> list[int]:
    """Hashed features of a word: itself and its beginnings of 4 to 6 bytes."""
    crc = zlib.crc32
    return [crc(b"w" + word) % FEATURES, *(crc(b"p" + word[:n]) % FEATURES for n in (4, 5, 6) if len(word) >= n)]


def lowered(column: pa.Array) -> list[bytes | None]:
    """Texts in lower case of all scripts, as bytes."""
    return as_bytes(pc.utf8_lower(column))


def split(texts: list[bytes | None]) -> list[bytes]:
    """Words of all texts in order, with the byte 1 where a sentence may end and the byte 0 after each text."""
    data = [(t or b"").translate(_TABLE).replace(b"\1", b" \1 ") for t in texts]
    return (b" \0 ".join(data) + b" \0").split() if data else []


def sentences(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words (mark 0), ends of sentences (1) and of texts (2): each word's sentence, and each sentence's text.

    Sentences without words do not count.
    """
    word = marks == 0
    start = word & np.concatenate(([True], marks[:-1] > 0))[: len(marks)]
    text = np.cumsum(marks == 2)
    return (np.cumsum(start) - 1)[word], text[start]


class Model:
    """Weights of hashed features and the bias of a sentence."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias


def fit(texts: list[str], labels: np.ndarray, importance: np.ndarray, rounds: int = 150, rate: float = 0.2, decay: float = 0.05) -> Model | None:
    """Noisy-or model by Adam on all the texts; None if a class is missing.

    A document is toxic unless all its sentences are clean: P = 1 - prod(1 - p), p the logistic of the summed weights.
    The gradient of -log P falls on the sentences of large p, which is how sentences are told apart without labels.
    Only features that toxic documents hold more often than chance take part, and no weight is negative: a sentence is
    toxic for what it says, and no clean words beside it make up for that.  A word counts once in a sentence.
    """
    if len(set(labels.tolist())) < 2:
        return None
    weight = importance * len(importance) / importance.sum()
    n, total, toxic = np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(FEATURES)
    for text, y, w in zip(texts, labels, weight):
        own = np.array(sorted({f for word in set(split(lowered(pa.array([text])))) - _MARKS for f in features(word)}), np.int64)
        n[own] += 1
        total[own] += w
        toxic[own] += w * (y > 0)
    share = (weight * (labels > 0)).sum() / len(labels)
    held = (n >= LEAST) & (toxic - share * total > DEVIATIONS * np.sqrt(share * (1 - share) * np.maximum(total, 1)))
    # held features by sentence; sentences by text
    where, feature, text = [], [], []
    for k, one in enumerate(texts):
        said = None
        for word in split(lowered(pa.array([one]))):
            if word in _MARKS:
                said = None
                continue
            if said is None:
                text.append(k)
                said = set()
            if word in said:
                continue
            said.add(word)
            found = [f for f in features(word) if held[f]]
            feature += found
            where += [len(text) - 1] * len(found)
    where, feature, text = (np.array(x, np.int64) for x in (where, feature, text))
    positive, count = labels[text] > 0, len(text)
    weights, bias = np.zeros(FEATURES), -5.0
    state = [np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0]
    for step in range(1, rounds + 1):
        s = bias + np.bincount(where, weights=weights[feature], minlength=count)
        s = np.clip(s, -30, 30)
        p, soft = 1 / (1 + np.exp(-s)), np.logaddexp(0, s)
        pull = 1 / np.expm1(np.maximum(np.bincount(text, weights=soft, minlength=len(labels)), 1e-9))
        g = importance[text] * np.where(positive, -p * pull[text], p) / len(labels)
        gb = g.sum()
        gw = np.bincount(feature, weights=g[where], minlength=FEATURES) + decay * weights / len(labels)
        state[0], state[1] = 0.9 * state[0] + 0.1 * gw, 0.99 * state[1] + 0.01 * gw**2
        state[2], state[3] = 0.9 * state[2] + 0.1 * gb, 0.99 * state[3] + 0.01 * gb**2
        a, b = 1 - 0.9**step, 1 - 0.99**step
        weights = np.maximum(weights - rate * (state[0] / a) / (np.sqrt(state[1] / b) + 1e-7), 0)
        bias -= rate * (state[2] / a) / (np.sqrt(state[3] / b) + 1e-7)
    weights[~held] = 0
    return Model(weights, bias)


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """Model fitted on up to ``sample`` labelled documents of each class, weighted to the classes' true shares.

    ``allowed`` (on ``key``) says which rows may be learned from.  Only keys are sorted to draw the sample; texts are
    fetched by a broadcast of the drawn keys.  Null keys, labels and texts are left out; of several labels of a key the
    highest counts.
    """
    known = labels.select(F.col(key), (F.col(label) > 0).cast("int").alias("y")).dropna().filter(allowed).groupBy(key).agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    drawn = [known.filter(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(sample) for y in (0, 1)]
    keys = drawn[0].unionByName(drawn[1])
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("t")).dropna().join(F.broadcast(keys), key).distinct().collect()
    rows = sorted((r[key], r["t"], r["y"]) for r in rows)
    y = np.array([r[2] for r in rows], np.int64)
    importance = np.array([sizes[c] / max(1, (y == c).sum()) for c in (0, 1) if c in sizes] + [1.0] * (2 - len(sizes)))
    importance = importance / importance.mean() if len(importance) else importance
    return fit([r[1] for r in rows], y, importance[y]) if len(rows) else None


class _Sums(dict):
    """Summed weights by word, computed when first asked for; infinite for marks."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights
        self.fresh()

    def fresh(self) -> None:
        self.clear()
        self[b"\1"], self[b"\0"] = np.inf, -np.inf

    def __missing__(self, word: bytes) -> float:
        if len(self) >= REMEMBERED:
            self.fresh()
        weights = self.weights
        value = self[word] = float(sum(weights[f] for f in features(word)))
        return value


def score(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep`` with ``score`` (0 to 1), ``n_sentences`` and ``offending`` of each whole text.

    ``offending`` lists the sentences that make a text toxic, as byte spans with their own scores: in texts of ``score``
    at least ``threshold`` those that reach it by themselves, or else the worst.  A null, empty or wordless text has no
    sentence and scores 0; so does every text if ``model`` is None.  Repeated rows score alike, a text of any length is
    read whole, and an empty table gives none.  Own columns replace kept ones of the same names.
    """
    weights, bias = (model.weights, model.bias) if model else (np.zeros(FEATURES), -np.inf)
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def make():
        weights, bias = shared.value
        sums = _Sums(weights.tolist())

        def kernel(column: pa.Array) -> list[pa.Array]:
            texts = as_bytes(column)
            words = split(lowered(column))
            values = np.fromiter(map(sums.__getitem__, words), np.float64, len(words))
            marks = np.where(values == -np.inf, 2, np.where(values == np.inf, 1, 0))
            sentence, owner = sentences(marks)
            own = values[marks == 0]
            told = np.flatnonzero(own > 0)  # few words; repeated in a sentence, one counts once
            numbers: dict[bytes, int] = {}
            number = np.fromiter((numbers.setdefault(words[i], len(numbers)) for i in np.flatnonzero(marks == 0)[told]), np.int64, len(told))
            order = np.lexsort((number, sentence[told]))
            told, number = told[order], number[order]
            once = np.ones(len(told), bool)
            once[1:] = (number[1:] != number[:-1]) | (sentence[told][1:] != sentence[told][:-1])
            told = told[once]
            s = np.clip(bias + np.bincount(sentence[told], weights=own[told], minlength=len(owner)), -60, 60)
            clean = np.bincount(owner, weights=np.logaddexp(0, s), minlength=len(texts))
            scores = -np.expm1(-clean)
            if bias == -np.inf:
                scores[:] = 0.0
            edges = np.searchsorted(owner, np.arange(len(texts) + 1))
            found = [[] for _ in texts]
            for k in np.flatnonzero(scores >= threshold):
                p = 1 / (1 + np.exp(-s[edges[k] : edges[k + 1]]))
                # the same sentences in the source: those that hold a word
                spans = [m.span() for m in _SENTENCE.finditer(texts[k]) if m.group().translate(WORD_BYTES).strip()]
                chosen = np.flatnonzero(p >= threshold) if (p >= threshold).any() else [p.argmax()] if len(p) else []
                found[k] = [{"start": spans[i][0], "stop": spans[i][1], "score": float(p[i])} for i in chosen]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
            return [pa.array(scores), pa.array(np.diff(edges), pa.int64()), pa.array(found, kind)]

        return kernel

    return map_texts(docs, make, "score double, n_sentences bigint, offending array<struct<start: int, stop: int, score: double>>", keep, text)


def trainable(key: str = "doc_id", modulus: int = 4, rest: int = 2) -> Column:
    """True for the rows that may be learned from; not for those held out or without a key."""
    return F.coalesce(remainder(F.col(key), modulus) != rest, F.lit(False))
