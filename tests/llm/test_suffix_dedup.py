"""op10: removed bytes against brute force over every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmeter.llm import suffix_dedup as S


def brute(rows):
    data = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(b[i:i + 200] for _, b in data for i in range(len(b) - 199))
    out = []
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        keep = bytes(x for x, g in zip(b, gone) if not g)
        out.append((k, len(b), sum(gone), runs, hashlib.sha256(keep).hexdigest()))
    return sorted(map(str, out))


def run(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("len", F.lit("x"))
    return sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in S.deduplicate(d).collect())


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n, a="abcdefgh ": "".join(rng.choice(a) for _ in range(n))
    shared = [say(n) for n in (199, 200, 201, 260, 350, 700, 1500)]
    rows = []
    for i in range(50):
        text = ""
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(shared)
            lo = rng.randrange(max(1, len(p) - 150))
            text += say(rng.randint(0, 300)) + p[lo:lo + rng.randint(150, 900)]
        rows.append((i, text))
    rows += [(50, rows[3][1]), (51, rows[3][1] + "x"), (52, "é" * 150 + say(300) + "é" * 150), (53, "z" * 1200),
             (54, "ab" * 700), (55, None), (56, ""), (57, "z" * 199), (57, "z" * 199), (None, shared[4]), (58, say(60) * 8),
             (59, rows[5][1]), (59, rows[5][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_crowded_anchors_and_pieces(spark, monkeypatch):
    """One passage in many different surroundings, dealt into groups of four; texts read in short pieces."""
    monkeypatch.setattr(S, "CELL", 4)
    monkeypatch.setattr(S, "PIECE", 512)
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = say(420)
    rows = [(i, say(rng.randint(0, 400)) + passage[rng.randint(0, 60):] + say(rng.randint(0, 400))) for i in range(40)]
    rows += [(100, say(5000) + passage + say(3000))]
    assert run(spark, rows) == brute(rows)


def test_empty_and_short_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "short"), (2, "short")]) == brute([(1, "short"), (2, "short")])


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    at = rng.choice(3700, 600, replace=False)
    run_of = np.sort(rng.integers(0, 9, 600))
    s = S.Suffixes(data)
    got = S.merge_sort(at, run_of, s)
    for r in range(9):
        mine = [data[i:i + 200].tobytes() for i in got[run_of == r]]
        assert mine == sorted(mine) and sorted(got[run_of == r]) == sorted(at[run_of == r])
    x, y = at[:-1], at[1:]
    for i, j, e in zip(x, y, s.extension(x, y)):
        a, b = data[i:i + 200].tobytes(), data[j:j + 200].tobytes()
        assert e == next((k for k in range(200) if a[k] != b[k]), 200)


def test_lying_hashes_are_caught(monkeypatch):
    """With a hash that calls everything equal, the byte comparison still gives the right windows."""
    monkeypatch.setattr(S.Suffixes, "extension", lambda self, x, y: np.full(len(x), self.length))
    rng = random.Random(6)
    a, b = ("".join(rng.choice("xy") for _ in range(260)).encode() for _ in range(2))
    place, first = np.array([100, 100, 100]), np.array([0, 0, 0])
    got = S.repeated_windows([a, b, a], place, first, np.array([60, 60, 60]), np.array([0, 0, 0]))
    assert got.reshape(3, 61).all(axis=1).tolist() == [True, False, True] and not got.reshape(3, 61)[1].any()


def test_equal_windows_share_their_anchor():
    rng = random.Random(8)
    core = "".join(rng.choice("ab") for _ in range(260)).encode()

    def of(prefix):
        data = np.frombuffer(prefix + core + b"tail" * 30, dtype=np.uint8)
        place, first, last, gram, _ = S.anchors(data)
        return {w - len(prefix): (p - w, g) for p, f, l, g in zip(place, first, last, gram) for w in range(f, l + 1)
                if 0 <= w - len(prefix) <= 60}

    assert of(b"") == of(b"something else" * 9)
