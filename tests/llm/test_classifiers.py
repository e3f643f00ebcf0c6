"""op4 and op5: held-out accuracy, calibration and edge cases."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkmeter.llm import language as L, toxicity as T

SF01 = "/root/testdata/sf0.01"
LONG = "mot très long " * 40_000


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF01}/documents.parquet")


@pytest.fixture(scope="module")
def language_model(docs):
    fold = docs.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4)
    part = docs[fold != 2]
    return L.fit(part.text.tolist(), part.lang.tolist()), docs[fold == 2]


def test_held_out_language_accuracy(language_model):
    model, rest = language_model
    lang, score, rejected = L.judge(rest.text.tolist(), model)
    assert (lang == rest.lang.to_numpy()).mean() > 0.98
    assert rejected.mean() < 0.01 and ((score > 0) & (score <= 1)).all()


def test_language_edge_cases(spark, language_model):
    model, rest = language_model
    rows = [(1, None), (2, ""), (3, "12 34 %%"), (None, rest.text.iloc[0]), (4, rest.text.iloc[0]), (4, rest.text.iloc[0]),
            (5, LONG), (6, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = L.predict(d.select("doc_id", "text"), model).collect()
    assert len(got) == len(rows)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {1, 2, 3} and all(r.rejected and r.score == 0 for r in got if r.lang_pred == "und")
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id in (4, None)}) == 1
    kept = L.accepted(d, model)
    assert kept.columns == d.columns and {1, 2, 3}.isdisjoint({r.doc_id for r in kept.collect()})


def test_pieces_of_long_texts_add_up(language_model, monkeypatch):
    model, rest = language_model
    texts = rest.text.tolist()[:40] + [None, "", "a"]
    whole = L._logit_sums(texts, model.table)
    monkeypatch.setattr(L, "PIECE", 97)
    parts = L._logit_sums(texts, model.table)
    assert np.allclose(whole[0], parts[0], atol=1e-3) and (whole[1] == parts[1]).all()


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.identify(none).count() == 0
    unlabelled = spark.createDataFrame([(1, "words", None), (2, None, None)], none.schema)
    assert {r.lang_pred for r in L.identify(unlabelled).collect()} == {"und"}
    one = spark.createDataFrame([(i, "only one", "xx") for i in range(30)], none.schema)
    assert {r.lang_pred for r in L.identify(one).collect()} == {"xx"}


# --- op4 ------------------------------------------------------------------------------------------------------------

def labelled(n, seed, bad=("scum", "moron", "worthless")):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(800)]
    texts, labels = [], []
    for _ in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(1, 200))]
        y = rng.random() < 0.15
        for _ in range(rng.randint(1, 3) if y else 0):
            w.insert(rng.randrange(len(w) + 1), rng.choice(bad))
        texts.append(" ".join(w))
        labels.append(int(y))
    return texts, labels


def test_held_out_toxicity():
    model = T.fit(*labelled(3000, 1))
    texts, labels = labelled(600, 2)
    score = T.score_texts(texts, model, T.features())
    y = np.array(labels)
    assert ((score >= 0.5) == y).mean() > 0.99
    assert len(model.keys) < 2000 and (np.diff(model.keys.astype(object)) > 0).all()  # sparse and sorted
    clean = T.score_texts(["", None, "  ", LONG], model, T.features())
    assert len(set(clean[:3])) == 1 and (clean < 0.5).all()
    # one word far into a long text is seen
    assert T.score_texts(["nothing " * 200_000 + "you moron scum"], model, T.features())[0] > 0.5


def test_features_are_counted_in_bounded_memory(monkeypatch):
    import inspect
    import tracemalloc

    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(3000)) for _ in range(600)]
    tracemalloc.start()
    model = T.fit(texts, [k % 2 for k in range(600)], epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 130e6, peak
    feats = T.Features()
    keys, n = np.unique(np.concatenate([feats.distinct(t) for t in texts]), return_counts=True)
    monkeypatch.setattr(T, "COUNT_BITS", 22)  # slots shared by many features change nothing
    assert (T._frequent(texts, feats, 3) == keys[n >= 3]).all() and np.isin(model.keys, keys[n >= 3]).all()
    assert inspect.signature(T.classify).parameters["sample_rows"].default == 20_000


def test_pieces_see_every_feature():
    import re

    import inkmeter.llm.common as C

    text = " ".join(labelled(40, 3)[0])
    feats = T.Features()
    whole = feats.distinct(text)
    parts = [feats._of(w) for w in C.word_pieces(text, re.compile(r"\w+").findall, re.compile(r"\W"), 2, piece=50)]
    assert set(whole.tolist()) == set(np.concatenate(parts).tolist())


def test_toxicity_table(spark):
    texts, labels = labelled(400, 4)
    rows = list(enumerate(texts)) + [(None, "scum"), (7, "repeated id"), (1000, None), (1001, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    lab = [(i, y) for i, y in enumerate(labels)] + [(3, labels[3]), (None, 1), (5, None), (99_999, 1)]
    l = spark.createDataFrame(lab, "doc_id long, toxic long").withColumn("text", F.lit("clash"))  # noqa: E741
    got = T.classify(d, l).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    none = T.classify(d, l.limit(0)).collect()
    assert len(none) == len(rows) and max(r.score for r in none) < 1e-9
    assert T.classify(d.limit(0), l).count() == 0


def test_samples_do_not_depend_on_order_or_copies(spark):
    from inkmeter.llm.common import distinct_sample
    rows = [(f"text {i}", float(i % 2)) for i in range(200)]
    many = rows + [("one text many times", 1.0)] * 400
    got = []
    for order in (many, many[::-1]):
        d = spark.createDataFrame(order, "t string, y double").repartition(5)
        got.append(sorted((r.t, r.y) for r in distinct_sample(d, d, 60).collect()))
    assert got[0] == got[1] and len(got[0]) == 60 and len(set(got[0])) == 60
    d = spark.createDataFrame(many, "t string, y double")
    assert distinct_sample(d, d, 1000).count() == 201
    assert distinct_sample(d.limit(0), d, 10).count() == 0


def test_toxicity_sample_shuffles_no_texts(spark):
    """The sample of the joined texts, found by hashes: only chosen texts and narrow rows are shuffled."""
    from inkmeter.llm.common import distinct_sample

    d = spark.range(3_000).selectExpr("if(id % 100 = 0, null, id div 2) AS doc_id", "if(id % 11 = 0, null, concat('text ', id % 900)) AS text")
    known = spark.range(1_500).selectExpr("id AS doc_id", "cast(id % 3 = 0 as int) AS toxic").where("doc_id % 5 <> 0")
    known = known.unionByName(known.where("doc_id < 40").selectExpr("doc_id", "1 - toxic AS toxic"))
    joined = d.join(known, "doc_id").select(F.coalesce("text", F.lit("")).alias("t"), F.col("toxic").cast("double").alias("y"))
    for size in (40, 300, 5_000):
        want = sorted((r.t, r.y) for r in distinct_sample(joined, joined, size, 5).collect())
        assert sorted((r.t, r.y) for r in T.labelled_sample(d, known, size, 5).collect()) == want and len(want) > 30
    assert T.labelled_sample(d, known.limit(0), 10, 5).count() == 0 and T.labelled_sample(d.limit(0), known, 10, 5).count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = T.labelled_sample(d, known, 100, 5)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and sum("rightHint=(strategy=broadcast)" in line for line in joins) == 1
