"""op1 and op7: SimHash groups and document sketches against plain Python, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkmeter.llm import components, simhash_pivots as S, sketch

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
DOCS = [(1, "The quick brown fox jumps over the lazy dog again and again"), (2, "the QUICK brown fox jumps over the lazy dog again and again"),
        (3, None), (4, ""), (5, " \t\n "), (6, "one two"), (7, "ONE two"), (8, "one\ttwo"), (None, "lost row"), (9, LONG),
        (9, LONG), (10, "Él niño ÀÀ ß ü 漢字"), (11, "à" * 50), (None, None)]


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs, radius=4):
    """{doc_id: smallest id} from (id, fingerprint) pairs."""
    fps = sorted({f for _, f in pairs})
    parent = {f: f for f in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if bin(a ^ b).count("1") <= radius:
                parent[top(b)] = top(a)
    least = {}
    for k, f in pairs:
        if k is not None:
            least[top(f)] = min(least.get(top(f), k), k)
    return [(k, f, least.get(top(f))) for k, f in pairs]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_fingerprint_matches_definition():
    for _, t in DOCS:
        assert S.fingerprint(t) == plain_fingerprint(t)
    rng = random.Random(3)
    for _ in range(50):
        t = "".join(rng.choice("aB \n\x0b\x1c é") for _ in range(rng.randint(0, 60)))
        assert S.fingerprint(t) == plain_fingerprint(t)


def test_spark_xxhash64_is_the_same_hash(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("one two three four"))).first()[0]
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"one two three four", 42)


def test_groups_of_edge_cases(spark):
    got = S.near_duplicates(frame(spark, DOCS).withColumn("root", F.lit(1)).withColumn("fp", F.lit(2)))
    rows = sorted(map(str, [(r.doc_id, r.fingerprint, r.component_id) for r in got.collect()]))
    want = plain_components([(k, plain_fingerprint(t)) for k, t in DOCS])
    assert rows == sorted(str((k, f"{f:016x}", c)) for k, f, c in want)


def test_empty_table(spark):
    got = S.near_duplicates(frame(spark, []))
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.count() == 0
    assert S.one_of_each(frame(spark, [])).count() == 0


@pytest.mark.parametrize("cell", [4096, 16])
def test_links_connect_everything_within_the_radius(spark, cell, monkeypatch):
    """Random fingerprints, chains and a dense ball; small cells force the dealing into groups."""
    monkeypatch.setattr(S, "SHORT", 6)
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 1 << 62, 300)]
    centre = fps[0]
    for _ in range(150):  # ball
        x = centre
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            x ^= 1 << int(b)
        fps.append(x)
    x = fps[1]
    for k in range(12):  # chain whose ends are far apart
        for b in range(4):
            x ^= 1 << (k * 4 + b + 7)
        fps.append(x)
    fps = sorted(set(fps))
    signed = [(S._signed(x),) for x in fps]
    links = S.links(spark.createDataFrame(signed, "fp long"), cell=cell)
    for r in links.collect():
        assert bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 4
    roots = {r.node & (1 << 64) - 1: r.root for r in components.components(links).collect()}
    mine = {}
    for x in fps:
        mine.setdefault(roots.get(x, S._signed(x)), set()).add(x)
    want = {}
    for i, (_, f, c) in enumerate(plain_components(list(enumerate(fps)))):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_one_of_each_keeps_one_row_and_all_columns(spark):
    docs = frame(spark, DOCS).withColumn("key", F.lit("k")).withColumn("row", F.lit(3)).withColumn("hash", F.lit(4))
    got = S.one_of_each(docs)
    assert got.columns == docs.columns
    want = {}
    for k, f, c in plain_components([(k, plain_fingerprint(t)) for k, t in DOCS]):
        want.setdefault((f if c is None else None, c), k)
    ids = [r.doc_id for r in got.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({c for _, c in want if c is not None})
    assert ids.count(None) == len([1 for _, c in want if c is None])


def test_dense_group_gives_few_links(spark):
    """n near copies of one text link into one group without all n * n pairs."""
    rng = np.random.default_rng(2)
    fps = {0}
    while len(fps) < 400:
        x = 0
        for b in rng.choice(24, 2, replace=False):
            x ^= 1 << int(b)
        fps |= {x, x ^ 1 << int(rng.integers(0, 64))}
    n = S.links(spark.createDataFrame([(S._signed(x),) for x in sorted(fps)], "fp long")).count()
    assert n < 25 * len(fps)


# --- op7 ------------------------------------------------------------------------------------------------------------

def plain_edits(rows):
    """(doc_id, n_chars, sha256) in descending id order; ids distinct, nulls last."""
    rows = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    out = []
    for i, (k, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(t) // 3
        out.append((k, len(t), hashlib.sha256((t[:len(t) - cut] + nxt[:cut]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_edited_texts(spark, n):
    rng = random.Random(n)
    rows = [(i * 7 - 30, "".join(rng.choice("ab é漢\n") for _ in range(rng.randint(0, 90)))) for i in range(n)]
    rows += [(None, "no id")] if n == 40 else []
    got = sketch.fingerprint_documents(frame(spark, rows).withColumn("part", F.lit(1)).withColumn("key", F.lit("x")))
    assert sorted(map(str, [(r.doc_id, r.n_chars, r.edited_sha256) for r in got.collect()])) == sorted(
        map(str, plain_edits(rows)))


def test_sketch_properties(spark):
    rows = [(1, LONG), (2, LONG), (3, None), (4, ""), (5, "one"), (6, "one"), (6, "one"), (7, " ".join(LONG.split()[:9000]))]
    got = sketch.fingerprint_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by[1].fingerprint == by[2].fingerprint and by[5].fingerprint == by[6].fingerprint != ""
    assert by[3].fingerprint == by[4].fingerprint == ""
    assert by[2].near_next == 1.0 and by[4].near_next == 1.0 and by[5].near_next == 0.0
    assert sketch.fingerprint_documents(frame(spark, [])).count() == 0


def test_sketch_estimates_and_merges():
    s = sketch.Sketcher()
    words = [f"w{i}" for i in range(20_000)]
    a, b = s(" ".join(words[:16_000])), s(" ".join(words[8_000:]))
    assert abs(sketch.likeness(a, b) - 8 / 20) < 0.03
    small = s(" ".join(words[:1_000]))
    assert sketch.containment(a, small) > 0.95
    # the sketch of both texts is the union, up to the four shingles across the seam
    both = s(" ".join(words))
    assert len(np.setxor1d(sketch.merge(a, b), both)) <= 8
    assert (sketch.from_text(sketch.to_text(a)) == a).all()
    # long texts are read in pieces; the pieces lose no shingle
    import inkmeter.llm.common as C
    whole = list(C.word_pieces(" ".join(words), str.split, re.compile(r"\s"), 4, piece=1 << 30))
    parts = list(C.word_pieces(" ".join(words), str.split, re.compile(r"\s"), 4, piece=1000))
    grams = {tuple(p[i:i + 5]) for p in parts for i in range(len(p) - 4)}
    assert grams == {tuple(whole[0][i:i + 5]) for i in range(len(whole[0]) - 4)}
