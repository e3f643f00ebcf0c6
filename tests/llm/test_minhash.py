"""op12: near-duplicate components against plain Python over full shingle sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmeter.llm import minhash as M


def plain_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def plain_result(docs):
    sets = [plain_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[top(i)] = min(least.get(top(i), k), k)
    out = []
    for i, (k, _) in enumerate(docs):
        c = k if not sets[i] else least.get(top(i))
        out.append((k, len(sets[i]), c, c is not None and c == k))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def mutated(rng, base, changes):
    out = list(base)
    for _ in range(changes):
        at = rng.randrange(len(out))
        out[at:at + rng.randint(0, 1)] = [f"x{rng.randrange(10_000)}"]
    return out


def corpus(seed=4):
    """Chains of edits around the threshold, short texts, a crowd of near copies, documents that share most of a passage."""
    rng = random.Random(seed)
    docs = []
    for n in (3, 8, 20, 45, 60, 70, 90, 300, 900):
        base = words(rng, n)
        for _ in range(6):
            docs.append(" ".join(base))
            base = mutated(rng, base, max(1, n // rng.choice([40, 70, 120])))
    crowd = words(rng, 200)
    docs += [" ".join(mutated(rng, crowd, rng.randint(1, 3))) for _ in range(60)]
    passage = words(rng, 150)
    for share in (0.5, 0.75, 0.9):
        docs += [" ".join(passage + words(rng, int(150 / share - 150), 100_000)) for _ in range(15)]
    docs += [docs[0]] * 5 + [docs[60].upper()] + [docs[61].replace(" ", "\t\n")]
    rng.shuffle(docs)
    return list(enumerate(docs))


EDGES = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "ONE"), (1005, "one two three four"), (1006, "One two three four "),
         (1007, "à" * 10), (1008, "À" * 10), (None, "one"), (None, None), (1003, "one"), (None, "nobody else has this"),
         (1009, " ".join(f"t{i % 9000}" for i in range(70_000))), (1010, " ".join(f"t{i % 9000}" for i in range(69_000)) + " end")]


@pytest.mark.parametrize("cell", [4096, 7])
def test_components_match_plain_python(spark, cell):
    docs = corpus() + EDGES
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    df = df.withColumn("id", F.lit(1)).withColumn("key", F.lit("k")).withColumn("n", F.lit(0)).withColumn("same", F.lit(None).cast("string"))
    assert rows_of(M.near_duplicates(df, cell=cell)) == plain_result(docs)


def test_piece_connects_what_is_linked():
    """Against all pairs; pairs of one root are not tried."""
    rng = random.Random(5)
    base = words(rng, 120)
    texts = [" ".join(mutated(rng, base, rng.randint(0, 4))) for _ in range(40)] + [" ".join(words(rng, 30)) for _ in range(5)]
    sets = [plain_set(t) for t in texts]
    links = M.Piece(texts).links(np.arange(len(texts)))
    assert all(100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) for i, j in links)
    want = plain_result(list(enumerate(texts)))
    assert len(links) == len(texts) - sum(kept for *_, kept in want)
    assert M.Piece(texts).links(np.zeros(len(texts), dtype=np.int64)) == []


def test_links_join_all_that_is_linked(spark):
    """Links between classes are exact and connect every linked pair."""
    docs = corpus(9)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    classes = M.kept(M.classes_of(M.sketched(df)), "test-classes")
    doc = {r.id: r.doc for r in classes.collect()}
    sets = {k: plain_set(t) for k, t in docs}
    got = [(doc[r.a], doc[r.b]) for r in M.links_of(classes, df).collect()]
    assert got and all(100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) for a, b in got)


def test_estimate_is_exact_for_whole_sketches():
    rng = random.Random(0)
    for _ in range(300):
        a = np.array(sorted(rng.sample(range(80), rng.randint(1, M.K))))
        b = np.array(sorted(rng.sample(range(80), rng.randint(1, M.K))))
        got = M.estimated(a, len(a), M._matrix([b]), np.array([len(b)]))[0]
        x, y = set(a.tolist()), set(b.tolist())
        assert got == (100 * len(x & y) >= 85 * len(x | y))


def test_estimate_counts_the_least_values_of_the_union():
    rng = random.Random(1)
    for _ in range(200):
        common = rng.sample(range(10 ** 9), rng.randint(100, 300))
        x = set(common + rng.sample(range(10 ** 9), rng.randint(0, 60)))
        y = set(common + rng.sample(range(10 ** 9), rng.randint(0, 60)))
        if 100 * min(len(x), len(y)) < 85 * max(len(x), len(y)):
            continue
        a, b = np.array(sorted(x))[:M.K], np.array(sorted(y))[:M.K]
        want = sum(v in x and v in y for v in sorted(x | y)[:M.K]) >= M.LEAST
        assert M.estimated(a, len(x), M._matrix([b]), np.array([len(y)]))[0] == want


def test_hashes_of_long_texts_are_those_of_the_whole():
    text = " ".join(f"word{i}" for i in range(60_000))
    assert len(M.hashes(text)) == len(plain_set(text)) and M.shingle_set(text) == {s.encode() for s in plain_set(text)}
    assert len(M.hashes("x" * 600_000 + " b c d")) == 1
    assert len(M.hashes("x" * 600_000 + " b c d e f")) == 2


def test_empty_table(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = rows_of(M.near_duplicates(spark.createDataFrame([(5, None), (6, "")], "doc_id long, text string")))
    assert got == [(5, 0, 5, True), (6, 0, 6, True)]
