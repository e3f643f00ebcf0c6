"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct 64-bit hashes of its lower-cased words,
of their four-letter stems, of adjacent pairs and of pairs with one word
between them; each present feature has value one.  FTRL-proximal keeps one
learning rate per coordinate, and its L1 term sets most weights to exactly
zero, so the model is a short sorted array of (hash, weight) that is
broadcast.  Its length is bounded by ``max_weights``; training runs in one
task over a bounded sample of labelled rows (``sample_rows``).

Defined results: empty, null or wordless text scores the intercept;
documents without a label are scored but never learned from; a document with
several labels is learned from once per label; without any label every score
is 0.  Rows with null or repeated doc_id are scored like any other.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmeter.llm.common import GOLDEN, MIX_A, WordHashes, distinct_sample, fold_mod, word_pieces

_WORD, _GAP = re.compile(r"\w+"), re.compile(r"\W")
STEM = 4
#: Seed of the sample and of the order in which it is learned.
SEED = 5
#: Slots (one byte each) by which features are counted before they are held.
COUNT_BITS = 26


@dataclass(frozen=True)
class ToxicityModel:
    keys: np.ndarray       # sorted uint64
    weights: np.ndarray    # float64
    bias: float


class Features:
    """Hashes of words, stems, pairs and skip pairs of a text, in pieces of bounded size."""

    def __init__(self):
        self.words = WordHashes(stem=STEM)

    def pieces(self, text) -> Iterator[np.ndarray]:
        for words in word_pieces((text or "").lower(), _WORD.findall, _GAP, overlap=2):
            yield self._of(words)

    def _of(self, words: list) -> np.ndarray:
        w, stems = self.words(words)
        # word hashes are already mixed, so odd multiples of them keep every feature family apart
        parts = [w, stems * np.uint64(9)]
        if len(w) > 1:
            parts.append(w[:-1] * np.uint64(3) + w[1:] * GOLDEN)
        if len(w) > 2:
            parts.append(w[:-2] * np.uint64(5) + w[2:] * MIX_A)
        return np.concatenate(parts)

    def distinct(self, text) -> np.ndarray:
        got = [np.unique(p) for p in self.pieces(text)]
        return np.unique(np.concatenate(got)) if got else np.zeros(0, dtype=np.uint64)


_FEATURES: list = []


def features() -> Features:
    """The extractor of this Python worker; its table of words serves all of the worker's tasks."""
    if not _FEATURES:
        _FEATURES.append(Features())
    return _FEATURES[0]


def _frequent(texts: list, feats: Features, min_docs: int) -> np.ndarray:
    """Sorted features of at least ``min_docs`` texts, in two passes over the texts.

    The first pass counts texts by the low bits of a hash, never too few; the second counts exactly, but only the
    features whose slot has enough.  So the many features of one or two texts are never held together."""
    mask, enough = np.uint64((1 << COUNT_BITS) - 1), min(min_docs, 255)
    slots = np.zeros(1 << COUNT_BITS, dtype=np.uint8)
    for t in texts:
        at = (feats.distinct(t) & mask).astype(np.int64)
        slots[at] = np.minimum(slots[at], 254) + 1
    keys, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    held, size = [], 0
    for k, t in enumerate(texts):
        f = feats.distinct(t)
        held.append(f[slots[(f & mask).astype(np.int64)] >= enough])
        size += len(held[-1])
        if size >= 1 << 20 or k == len(texts) - 1:
            new, n = np.unique(np.concatenate(held), return_counts=True)
            at = np.searchsorted(keys, new)
            known = at < len(keys)
            known[known] = keys[at[known]] == new[known]
            counts[at[known]] += n[known]
            counts = np.insert(counts, at[~known], n[~known])
            keys = np.insert(keys, at[~known], new[~known])
            held, size = [], 0
    return keys[counts >= min_docs]


def fit(texts: list, labels: list, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0,
        l2: float = 0.1, min_docs: int = 3, max_weights: int = 200_000, seed: int = 5) -> ToxicityModel:
    """FTRL-proximal over the rows in a seeded order; features of fewer than ``min_docs`` rows are left out."""
    feats = Features()
    rows = [(t, float(y)) for t, y in zip(texts, labels) if y is not None and y == y]
    empty = ToxicityModel(np.zeros(0, dtype=np.uint64), np.zeros(0), -50.0)
    if not rows:
        return empty
    keys = _frequent([t for t, _ in rows], feats, min_docs)
    z, n = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    free = np.full(len(keys) + 1, l1)
    free[-1] = 0.0  # the intercept is not drawn to zero

    def indices(f: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, f)
        hit = at < len(keys)
        hit[hit] = keys[at[hit]] == f[hit]
        return np.concatenate((at[hit], [len(keys)])).astype(np.int32)

    coded = [(indices(feats.distinct(t)), y) for t, y in rows]
    rng = np.random.default_rng(seed)

    def weights(i) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * free[i]) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= free[i], 0.0, w)

    for _ in range(epochs):
        for k in rng.permutation(len(coded)):
            i, y = coded[k]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(len(keys) + 1))
    some = np.flatnonzero(w[:-1])
    if len(some) > max_weights:
        some = np.sort(some[np.argsort(-np.abs(w[some]), kind="stable")[:max_weights]])
    return ToxicityModel(keys[some], w[some], float(w[-1]))


def score_texts(texts: list, model: ToxicityModel, feats: Features) -> np.ndarray:
    low = np.zeros(1 << 20, dtype=bool)
    mask = np.uint64((1 << 20) - 1)
    low[(model.keys & mask).astype(np.int64)] = True
    out = np.zeros(len(texts))
    for k, t in enumerate(texts):
        found = []
        for f in feats.pieces(t):
            f = np.unique(f[low[(f & mask).astype(np.int64)]])
            at = np.searchsorted(model.keys, f)
            ok = at < len(model.keys)
            ok[ok] = model.keys[at[ok]] == f[ok]
            found.append(at[ok])
        hit = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        out[k] = model.bias + model.weights[hit].sum()
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def train(labelled: DataFrame, text: str = "text", label: str = "toxic", sample_rows: int = 20_000,
          seed: int = SEED) -> ToxicityModel:
    """Fit in one task on ``sample_rows`` different pairs of text and label, those with the smallest hashes."""
    rows = labelled.where(F.col(label).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("t"),
                                                           F.col(label).cast("double").alias("y"))
    return _fit_in_one_task(distinct_sample(rows, rows, sample_rows, seed), seed)


def labelled_sample(docs: DataFrame, known: DataFrame, size: int, seed: int) -> DataFrame:
    """(t, y): the rows that :func:`distinct_sample` has of the texts of ``docs`` joined with the labels ``known``
    (doc_id, toxic), but no text is shuffled before the sample is known.

    Hashes of a text with every value that labels take (two of them) are joined with the labels; the smallest hashes,
    each with one doc_id, are then broadcast to the texts.
    """
    labels = known.select("doc_id", F.col("toxic").cast("double").alias("y"))
    values = [r.y for r in labels.select("y").distinct().collect()]
    t = F.coalesce(F.col("text"), F.lit("")).alias("t")
    hashes = F.array(*[F.xxhash64(t, F.lit(y), F.lit(seed)) for y in values]).cast("array<long>").alias("_hashes")
    of_label = F.coalesce(F.lit(None).cast("long"), *[F.when(F.col("y") == y, F.col("_hashes")[i]) for i, y in enumerate(values)])
    hashed = docs.select("doc_id", hashes).join(labels, "doc_id").select("doc_id", "y", of_label.alias("_hash"))
    share = min(1.0, 4 * size / max(1, hashed.count()))
    if share < 1.0:
        hashed = hashed.where(F.col("_hash") < int((2 * share - 1) * (1 << 63)))
    one = hashed.groupBy("_hash").agg(F.min("doc_id").alias("doc_id"), F.first("y").alias("y")).orderBy("_hash").limit(size)
    found = docs.select("doc_id", t, hashes).join(F.broadcast(one), "doc_id").where(of_label == F.col("_hash"))
    return found.groupBy("_hash").agg(F.first("t").alias("t"), F.first("y").alias("y")).select("t", "y")


def _fit_in_one_task(chosen: DataFrame, seed: int) -> ToxicityModel:
    """The model of the rows (t, y), which one task holds."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches]
        pdf = pd.concat(got) if got else pd.DataFrame({"t": [], "y": []})
        pdf = pdf.sort_values(["t", "y"])
        yield pd.DataFrame({"m": [pickle.dumps(fit(pdf.t.tolist(), pdf.y.tolist(), seed=seed))]})

    got = chosen.repartition(1).mapInPandas(learn, "m binary").collect()
    return pickle.loads(got[0].m) if got else fit([], [])


def predict(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``df`` plus ``score`` (0 to 1) and ``predicted``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(score_texts([t if isinstance(t, str) else "" for t in s], shared.value, features()))

    out = df.withColumn("score", score(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(col: str = "doc_id"):
    """True where crc32 of the id as text is a multiple of 5; a null id counts as not held out."""
    return F.coalesce(fold_mod(col, 5) == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learns from the labelled rows not held out."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).select("doc_id", "toxic")
    model = _fit_in_one_task(labelled_sample(docs, known, sample_rows, SEED), SEED)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
