"""The fitted scorer against numpy's least squares, and its edge cases."""

import math
import random
import re

import numpy as np

from inkmeter.functions import responses
from inkmeter.operators import quality, scoring


def rows(seed=2, n=200):
    rng = random.Random(seed)
    docs = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 60)))) for i in range(n)] + [(n, None)]
    labels = [(i, rng.randint(0, 1) if i % 11 else None, 0) for i in range(0, n, 2)] + [(10_000, 1, 0)]
    return docs, labels


def plain_features(t):
    t = "nan" if t is None else t
    n = len(re.findall("[^\x20\x09-\x0d]+", t))
    return math.log(1 + n), len(t) / max(n, 1)


def test_fit_is_least_squares(spark):
    docs, labels = rows()
    got = quality.fit(spark.createDataFrame(docs, "doc_id long, text string"),
                      spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    text = dict(docs)
    known = [(text[i], y) for i, y, _ in labels if y is not None and i in text]
    x = np.array([(1, *plain_features(t)) for t, _ in known])
    want, *_ = np.linalg.lstsq(x, np.array([y for _, y in known], dtype=float), rcond=None)
    assert np.allclose([got.intercept, got.w1, got.w2], want, atol=1e-9)


def test_scores_come_from_the_model(spark):
    model = quality.QualityModel(0.1, 0.2, -0.01)
    docs = [("a", None), ("b", ""), ("c", "one two"), ("d", "word " * 5000), ("e", "x" * 3000)]
    df = spark.createDataFrame(docs, "custom_id string, text string")
    lines = scoring.score_rows(df, quality.model_scorer(model))
    got = {r.custom_id: r.llm_score for r in responses.parse_lines(lines, "line").collect()}
    want = {}
    for c, t in docs:
        a, b = plain_features(t)
        want[c] = str(1 + min(4, max(0, math.floor(5 * round(0.1 + 0.2 * a - 0.01 * b, 9)))))
    assert got == want and len(set(got.values())) > 1


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, none) == quality.QualityModel(0.5, 0.0, 0.0)
    same = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.fit(docs, same) == quality.QualityModel(0.5, 0.0, 0.0)
