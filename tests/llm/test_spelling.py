"""op11: near words and forms against plain Python."""

import random
import zlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkmeter.llm import spelling as S


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_words(docs):
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 5}


def plain_variants(words):
    near = {w: [v for v in words if distance_one(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        if vs:
            best = min(vs, key=lambda v: (-words[v], v))
            if words[best] >= 5 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.append((w, n, len(near[w]), f, words[f] if f else None, root))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()), key=str)


def some_words(rng, n, letters="abcé", low=6, high=9):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)]


def some_docs(seed=5, n=60):
    rng = random.Random(seed)
    pool = some_words(rng, 120)
    weights = [1 / (i + 1) for i in range(len(pool))]
    docs = []
    for k in range(n):
        words = rng.choices(pool, weights, k=200)
        docs.append((k, rng.choice([" ", ", ", "1", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in words)))
    return docs


def test_search_finds_every_pair_once():
    rng = random.Random(1)
    for m in (6, 7, 11):
        words = sorted(set(some_words(rng, 400, "abÿ", m, m + 1)) | {"a" * m, "a" * (m + 1)})
        a, b = S.search(words, m, np.array([len(words)]))
        got = sorted((min(words[i], words[j]), max(words[i], words[j])) for i, j in zip(a, b))
        # words of length m + 1 are compared with each other in the group of m + 1
        want = sorted((v, w) for k, v in enumerate(words) for w in words[k + 1:]
                      if distance_one(v, w) and min(len(v), len(w)) == m)
        assert got == want


def test_search_keeps_groups_apart():
    words = ["aaaaaa", "aaaaab"] + ["aaaaac", "aaaaad"]
    a, b = S.search(words, 6, np.array([2, 2]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 1), (2, 3)]


@pytest.mark.parametrize("group", [8192, 8, 2])
def test_groups_lose_no_pair(spark, group):
    """Small groups are dealt out again and again; every pair is counted once all the same."""
    rng = random.Random(2)
    words = sorted(set(some_words(rng, 500, "ab", 6, 12) + some_words(rng, 300, "abcdé", 6, 8)))
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = {r.word: r.n_near for r in S.near_words(df, group).collect()}
    want = {w: sum(distance_one(w, v) for v in words) for w in words}
    assert got == {w: n for w, n in want.items() if n}


def test_variants_match_plain_python(spark):
    chain = [(900 + k, w) for k, w in enumerate(["sailing"] * 200 + ["sailin"] * 40 + ["sxilin"] * 6)]
    docs = some_docs() + chain + [(None, "abcabc " * 7), (None, None), (7, ""), (3, "abcabc abcabc"), (3, "abcabc abcabc")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    want = plain_variants(plain_words(docs))
    assert any(w[3] for w in want) and any(w[5] not in (w[0], w[3]) for w in want)
    assert rows_of(S.variants(df)) == want
    assert rows_of(S.variants(df, group=4)) == want


def test_words_of_long_texts_are_whole():
    text = "abcdefg " * 60_000 + "é" * 300_000
    got = Counter()
    for w, n in S.words_of("1", text):
        got[w] += n
    assert got == Counter({"abcdefg": 60_000, "é" * 300_000: 1})


def test_a_run_that_loses_a_letter():
    """crc32 of '<doc_id>:<run>' decides; the letter at crc32 % length goes."""
    doc_id = next(k for k in range(10_000) if zlib.crc32(f"{k}:spelling".encode()) % 199 == 0)
    h = zlib.crc32(f"{doc_id}:spelling".encode())
    cut = "spelling"[:h % 8] + "spelling"[h % 8 + 1:]
    assert list(S.words_of(str(doc_id), "Spelling SPELLING")) == [(cut, 1), (cut, 1)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.variants(empty).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")
    assert S.variants(nothing).collect() == []
