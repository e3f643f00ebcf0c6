"""Language identification: averaged hashed subword embeddings with a linear softmax.

A document is the mean of the embeddings of its hashed character pairs and
triples (lower-cased, runs outside words read as blanks); a linear layer and
a softmax give the language.  The model is trained by plain stochastic
gradient descent in numpy, in one task, on a bounded sample of labelled rows
(``sample_rows``).  A temperature fitted on a held-back tenth of the sample
calibrates the probabilities, and the rejection threshold is the score below
which at most ``reject_share`` of the correctly recognised calibration
documents lie, never above ``max_threshold``.

Because the layer after the mean is linear, embeddings and layer are folded
into one (bucket x language) table, 4 bytes a cell, which is broadcast: its
size is ``2**BITS * languages``, whatever the corpus.

Defined results: null text, or text without a letter, is ``und`` with score
0 and rejected; an empty training set predicts ``und`` for everything; rows
with null or repeated doc_id are scored like any other; extra columns are
ignored by :func:`predict`, which reads the text column only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmeter.llm.common import GOLDEN, distinct_sample, fold_mod, mix64

BITS = 17
#: Characters worked on at a time; longer texts are read in pieces that overlap by two characters.
PIECE = 1 << 19
_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x10000)), dtype=bool, count=0x10000)


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple
    table: np.ndarray          # (2**BITS, languages) float32: embedding times layer
    bias: np.ndarray
    temperature: float
    threshold: float


def _codes(text: str) -> np.ndarray:
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = np.minimum(a, 0xFFFF)
    return np.where(_LETTER[low] | (a > 0xFFFF), a, 0)


def _buckets(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the pair and the triple that start at each place but the last two."""
    a = codes.astype(np.uint64)
    pair = a[:-2] * np.uint64(0x1F123BB5) + a[1:-1] * np.uint64(0x5DEECE66D)
    three = pair + a[2:] * np.uint64(0x2545F4914F6CDD1D)
    shift = np.uint64(64 - BITS)
    return (pair * GOLDEN >> shift).astype(np.int64), (mix64(three) >> shift).astype(np.int64)


def _grams(text: str) -> np.ndarray:
    """All buckets of one text; those of pure blanks are left out."""
    c = np.concatenate(([0], _codes(text), [0, 0])).astype(np.uint32)
    p, t = _buckets(c)
    full = (c[:-2] > 0) | (c[1:-1] > 0)
    return np.concatenate((p[full], t[full]))


def has_letter(text) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _logit_sums(texts: list, model_table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed table rows and number of grams of each text, over whole texts in pieces of bounded size."""
    sums = np.zeros((len(texts), model_table.shape[1]))
    grams = np.zeros(len(texts))

    def work(group: list) -> None:
        codes, starts, at, ahead = [], [], 0, []
        for _, piece, last in group:
            starts.append(at)
            codes.append(piece)
            at += len(piece)
            if not last:  # its last two characters are the next piece's first
                ahead += [at - 2, at - 1]
        c = np.concatenate([*codes, np.zeros(2, dtype=np.uint32)])
        p, t = _buckets(c)
        full = ((c[:-2] > 0) | (c[1:-1] > 0))[:, None]
        full[ahead] = False
        rows = (model_table[p] + model_table[t]) * full
        part = np.add.reduceat(rows, starts, axis=0)
        count = np.add.reduceat(full[:, 0].astype(np.int64), starts) * 2
        for (i, _, _), s, n in zip(group, part, count):
            sums[i] += s
            grams[i] += n

    group, size = [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        for lo in range(0, len(text), PIECE):
            last = lo + PIECE >= len(text)
            piece = _codes(text[lo:lo + PIECE + 2 * (not last)])
            piece = np.concatenate(([0] if not lo else [], piece, [0, 0] if last else [])).astype(np.uint32)
            group.append((i, piece, last))
            size += len(piece)
            if size >= PIECE:
                work(group)
                group, size = [], 0
    if group:
        work(group)
    return sums, grams


def _probabilities(sums: np.ndarray, grams: np.ndarray, m: LanguageModel) -> np.ndarray:
    z = (sums / np.maximum(grams, 1)[:, None] + m.bias) / m.temperature
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list, labels: list, dim: int = 16, epochs: int = 3, rate: float = 8.0, seed: int = 7,
        reject_share: float = 0.002, max_threshold: float = 0.45) -> LanguageModel | None:
    """Stochastic gradient descent over whole texts and random word spans of them; None without usable rows."""
    rows = [(t, y) for t, y in zip(texts, labels) if y is not None and has_letter(t)]
    langs = tuple(sorted({y for _, y in rows}))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = [rows[i] for i in order[: len(rows) // 10]]
    train = [rows[i] for i in order[len(rows) // 10:]]
    at = {y: k for k, y in enumerate(langs)}
    emb = rng.normal(0, 0.1, (1 << BITS, dim)).astype(np.float32)
    layer = rng.normal(0, 0.1, (dim, len(langs)))
    bias = np.zeros(len(langs))

    def spans(text: str) -> list[str]:
        words = re.findall(r"\S+", text)
        out = [text]
        for _ in range(2):
            n = int(rng.integers(2, 24))
            lo = int(rng.integers(0, max(1, len(words) - n + 1)))
            out.append(" ".join(words[lo:lo + n]))
        return [s for s in out if has_letter(s)]

    total = max(1, epochs * len(train))
    step = 0
    for _ in range(epochs):
        for k in rng.permutation(len(train)):
            text, y = train[k]
            lr = rate * (1 - step / total) + 0.05
            step += 1
            for s in spans(text):
                u, c = np.unique(_grams(s), return_counts=True)
                if not len(u):
                    continue
                share = (c / c.sum())[:, None]
                hidden = (emb[u] * share).sum(axis=0)
                z = hidden @ layer + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[at[y]] -= 1
                back = layer @ p
                layer -= lr * 0.1 * np.outer(hidden, p)
                bias -= lr * 0.01 * p
                emb[u] -= (lr * share * back).astype(np.float32)
    table = (emb @ layer).astype(np.float32)
    plain = LanguageModel(langs, table, bias, 1.0, 0.0)
    if not held:
        return plain
    # calibration on whole texts and on short spans, both unseen
    check = [(s, y) for t, y in held for s in spans(t)]
    sums, grams = _logit_sums([s for s, _ in check], table)
    truth = np.array([at[y] for _, y in check])
    best = min((float(-np.log(np.maximum(_probabilities(sums, grams, LanguageModel(langs, table, bias, t, 0))
                                         [np.arange(len(truth)), truth], 1e-12)).mean()), t)
               for t in np.geomspace(0.1, 10, 41))[1]
    model = LanguageModel(langs, table, bias, float(best), 0.0)
    sums, grams = _logit_sums([t for t, _ in held], table)
    p = _probabilities(sums, grams, model)
    right = p.argmax(axis=1) == np.array([at[y] for _, y in held])
    cut = float(np.quantile(p.max(axis=1)[right], reject_share)) if right.any() else 0.0
    return LanguageModel(langs, table, bias, float(best), min(cut, max_threshold))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = 5000,
          seed: int = 7) -> LanguageModel | None:
    """Fit in one task on ``sample_rows`` different pairs of text and label, those with the smallest hashes."""
    import pickle

    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("t"), F.col(lang).alias("y"))
    chosen = distinct_sample(rows, rows, sample_rows, seed)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches]
        pdf = pd.concat(got) if got else pd.DataFrame({"t": [], "y": []})
        pdf = pdf.sort_values(["t", "y"])
        yield pd.DataFrame({"m": [pickle.dumps(fit(pdf.t.tolist(), pdf.y.tolist(), seed=seed))]})

    got = chosen.repartition(1).mapInPandas(learn, "m binary").collect()
    return pickle.loads(got[0].m) if got else None


def judge(texts: list, m: LanguageModel | None) -> tuple:
    """(language, score, rejected) of each text, as arrays."""
    lettered = np.array([has_letter(t) for t in texts], dtype=bool)
    if m is None or not lettered.any():
        return np.full(len(texts), "und", dtype=object), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
    p = _probabilities(*_logit_sums(texts, m.table), m)
    score = np.where(lettered, p.max(axis=1), 0.0)
    lang = np.where(lettered, np.array(m.langs, dtype=object)[p.argmax(axis=1)], "und")
    return lang, score, ~lettered | (score < m.threshold)


def predict(df: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """``df`` plus ``lang_pred``, ``score``, ``rejected`` (JVM columns stay; only the text crosses to Python)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def name(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            lang, score, rejected = judge([t if isinstance(t, str) else None for t in s], shared.value)
            yield pd.DataFrame({"lang_pred": lang, "score": score, "rejected": rejected})

    out = df.withColumn("_lid", name(F.col(text)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "_lid.lang_pred", "_lid.score", "_lid.rejected")


def held_out(col: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 modulo 4; a null id counts as not held out."""
    return F.coalesce(fold_mod(col, 4) == 2, F.lit(False))


def identify(docs: DataFrame, sample_rows: int = 5000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document; learns from the rows not held out."""
    model = train(docs.where(~held_out()), sample_rows=sample_rows)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def recognised(docs: DataFrame, sample_rows: int = 5000) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with their own columns only."""
    known = docs.select(F.col("doc_id"), F.col("text"), F.col("lang"))
    model = train(known.where(~held_out()), sample_rows=sample_rows)
    return accepted(docs, model)


def accepted(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """Rows that ``model`` does not reject; any column name of ``docs`` is kept as it is."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def fine(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(~judge([t if isinstance(t, str) else None for t in s], shared.value)[2], dtype=bool)

    return docs.where(fine(F.col(text)))
