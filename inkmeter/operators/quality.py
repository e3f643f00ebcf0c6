"""A scorer that is a model: least squares on two features of a text, fitted on labelled texts (K2).

Features: x1 = ln(1 + words), x2 = characters per word (words are runs between
ASCII white space; a null text reads ``nan``, as in the request).  The fit
needs the first and second moments of (x1, x2, label) only, which one
aggregate over all labelled texts gives, so no sample is drawn and nothing
but eight numbers reaches the driver.  The two weights and the intercept travel with
the scoring function; texts are scored batch by batch.  A prediction p in
[0, 1) becomes the score 1 + floor(5 p).

Defined results: labels that are null, or have no text row, are not learnt
from; without labels, or where the features do not vary, the prediction is
the mean label (0.5 without any).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmeter.operators.scoring import Scorer, answer_line

# What separates words, the scale of scores, and decimals a prediction is rounded to.
WORD = "[^\\x20\\x09-\\x0D]+"
LEVELS = 5
DECIMALS = 9

_WORD = re.compile(WORD)


@dataclass(frozen=True)
class QualityModel:
    intercept: float
    w1: float
    w2: float

    def predict(self, text: str | None) -> float:
        text = "nan" if text is None else text
        words = len(_WORD.findall(text))
        p = self.intercept + self.w1 * math.log(1 + words) + self.w2 * len(text) / max(words, 1)
        return round(p, DECIMALS)

    def score(self, text: str | None) -> int:
        return 1 + min(LEVELS - 1, max(0, math.floor(LEVELS * self.predict(text))))


def features(text: str):
    """x1 and x2 as columns."""
    t = F.coalesce(F.col(text), F.lit("nan"))
    words = F.size(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    return F.log(1 + words).alias("x1"), (F.length(t) / F.greatest(words, F.lit(1))).alias("x2")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """Least squares over all labelled texts, from their moments."""
    known = labels.select(key, F.col(label).cast("double").alias("y")).filter("y IS NOT NULL")
    rows = docs.select(key, F.col(text).alias("t")).join(known, key).select("y", *features("t"))
    m = rows.agg(F.avg("y").alias("y"), F.avg("x1").alias("a"), F.avg("x2").alias("b"), F.var_pop("x1").alias("aa"),
                 F.var_pop("x2").alias("bb"), F.covar_pop("x1", "x2").alias("ab"), F.covar_pop("x1", "y").alias("ay"),
                 F.covar_pop("x2", "y").alias("by")).first()
    if m["y"] is None:
        return QualityModel(0.5, 0.0, 0.0)
    det = m["aa"] * m["bb"] - m["ab"] ** 2
    if det <= 1e-12:
        return QualityModel(m["y"], 0.0, 0.0)
    w1 = (m["bb"] * m["ay"] - m["ab"] * m["by"]) / det
    w2 = (m["aa"] * m["by"] - m["ab"] * m["ay"]) / det
    return QualityModel(m["y"] - w1 * m["a"] - w2 * m["b"], w1, w2)


def model_scorer(model: QualityModel) -> Scorer:
    """The scoring function of a model: answer lines for the texts of each batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [None if pd.isna(t) else t for t in pdf["text"]]
            lines = [answer_line(c, str(model.score(t))) for c, t in zip(pdf["custom_id"], texts)]
            yield pd.DataFrame({"custom_id": pdf["custom_id"], "line": pd.Series(lines, dtype=object, index=pdf.index)})

    return run
