"""op13: ranked lists against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmeter.llm import search as S

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_search(docs, items, k=50):
    tf = [(d, Counter(plain_terms(t))) for d, t in docs]
    tf = [(d, c) for d, c in tf if c]
    n_docs, length = len(tf), sum(c.total() for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in tf:
            m = 100 - 50 + (50 * c.total() * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(plain_terms(text)) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, d, -s))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(seed=3, n=400):
    rng = random.Random(seed)
    pool = [f"t{i}" for i in range(300)] + ["été", "漢字", "12"]
    weights = [1 / (i + 1) for i in range(len(pool))]
    docs = [(i, rng.choice([" ", ", ", "_", "\n"]).join(rng.choices(pool, weights, k=rng.randint(1, 80)))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1].upper()) for i in range(80)]  # ties
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 30)))) for i in range(25)]
    return docs, items


EDGES = [(None, "t1 t2 t3"), (None, None), (9001, ""), (9002, "!?"), (3, "t1 t1"), (3, "t1 t1"), (9003, "t5 " * 150_000)]


@pytest.mark.parametrize("k, block", [(50, 2_000_000), (5, 300)])
def test_ranks_match_plain_python(spark, monkeypatch, k, block):
    docs, items = corpus()
    docs, items = docs + EDGES, items + [(100, None), (101, ""), (102, "nowhere"), (None, "t7 T7"), (4, "t9 été"), (4, "t9 été")]
    monkeypatch.setattr(S, "POSTINGS", block)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("item_id", F.lit("x")).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5)).withColumn("rank", F.lit(5))
    assert rows_of(S.search(d, i, k)) == plain_search(docs, items, k)


def test_blocks_of_items_give_the_same_rows(spark):
    docs, items = corpus(8)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(S.search(d, i, size=120)) == plain_search(docs, items)


def test_limited_accumulators_lose_nothing():
    """Against adding up all lists, for many lists and thresholds; accumulators are in fact limited."""
    rng = np.random.default_rng(0)
    limited = 0
    for trial in range(60):
        n, v, k = int(rng.integers(5, 400)), 30, int(rng.integers(1, 12))
        sizes = rng.integers(0, 12, n)
        terms = np.concatenate([np.sort(rng.choice(v, s, replace=False)) for s in sizes]).astype(np.int64)
        tfs = rng.integers(1, 5, len(terms))
        weights = np.sort(rng.integers(0, 9000, v))[::-1].astype(np.int64)
        lists = S.Lists(rng.integers(50, 400, n), sizes, terms, tfs, weights)
        ranked = np.sort(rng.choice(v, 10, replace=False))
        full = np.zeros(n, dtype=np.int64)
        for t in ranked:
            at = np.flatnonzero(lists.known == t)
            for a in at:
                full[lists.docs[lists.start[a]:lists.end[a]]] += lists.scores[lists.start[a]:lists.end[a]]
        docs, score = lists.best(ranked, k, 0)
        assert (full[docs] == score).all()
        want = sorted(full[full > 0].tolist())[::-1][:k]
        assert sorted(score.tolist())[::-1][:k] == want
        if want:
            assert set(np.flatnonzero((full >= want[-1]) & (full > 0)).tolist()) <= set(docs.tolist()) or len(want) < k
        limited += len(docs) < (full > 0).sum()
    assert limited


def test_terms_of_long_texts():
    text = "abc,DEF " * 50_000 + "é" * 400_000
    assert S.terms_of(text) == {b"abc": 50_000, b"def": 50_000, ("é" * 400_000).encode(): 1}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert S.search(none, items).collect() == []
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert S.search(docs, items.limit(0)).collect() == []
    assert S.search(docs, items).count() == 1
