"""op8: benchmark windows against brute force over every window."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from inkmeter.llm import decontam as D


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w, k):
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(docs, items):
    out = {}
    for n, (doc_id, text) in enumerate(docs):
        w = words(text)
        for item_id, t in items:
            b = words(t)
            if not b:
                continue
            k = min(5, len(b))
            mine, best = shingles(b, k), 0
            for s in range(max(1, len(w) - len(b) + 1)):
                ws = shingles(w[s:s + len(b)], k)
                union = sum((ws | mine).values())
                best = max(best, sum((ws & mine).values()) / union if union else 0)
            if best >= 0.8:
                out[n, item_id] = best
    return Counter((docs[n][0], i, round(v, 9)) for (n, i), v in out.items())


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("_h", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(d, b)
    return Counter((r.doc_id, r.item_id, round(r.similarity, 9)) for r in got.collect())


def cases():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([12, 20, 20, 33, 60, 9, 5, 4, 1])]
    items += [(9, "same words " * 6), (10, None), (11, "!!"), (12, items[3][1])]
    docs = []
    for i in range(60):
        text = say(rng.randint(0, 80)).split()
        if i % 2:
            piece = items[rng.randrange(9)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):  # changed, dropped or added words
                at = rng.randrange(len(piece)) if piece else 0
                what = rng.random()
                if what < 0.4 and piece:
                    piece[at] = rng.choice(vocabulary)
                elif what < 0.7 and len(piece) > 1:
                    piece.pop(at)
                else:
                    piece.insert(at, rng.choice(vocabulary))
            cut = rng.randrange(len(text) + 1)
            text[cut:cut] = piece
        docs.append((i, (", ".join(text) if i % 3 else " ".join(text).upper())))
    docs += [(100, None), (101, ""), (102, items[4][1]), (102, items[4][1]), (None, items[3][1]), (103, "same words " * 40),
             (104, "x " * 20_000 + items[2][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    want = brute(docs, items)
    assert sum(want.values()) > 20
    assert run(spark, docs, items) == want


def test_filter_drops_only_contaminated_rows(spark):
    docs, items = cases()
    bad = {k for k, _, _ in brute(docs, items)}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("_len", F.lit(9))
    out = D.without_contaminated(d, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == d.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(k for k, _ in docs if k not in bad)


def test_empty_tables(spark):
    docs, items = cases()
    assert run(spark, [], items) == Counter()
    assert run(spark, docs, []) == Counter()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert D.without_contaminated(d, spark.createDataFrame([], "item_id long, text string")).count() == len(docs)


def test_simhash_and_block_index(spark):
    rng = random.Random(5)
    hs = [rng.getrandbits(64) - (1 << 63) for _ in range(7)]
    fp = spark.createDataFrame([(hs,)], "h array<long>").select(D._simhash(F.col("h"))).first()[0]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hs) > len(hs))
    assert fp & (1 << 64) - 1 == want
    # every fingerprint within the radius meets the item in some block
    item = spark.createDataFrame([(1, 10, fp)], "item_id long, n int, item_fp long")
    index = {(r.block, r.value) for r in D.block_index(item).collect()}
    for _ in range(200):
        x = want
        for b in rng.sample(range(64), D.RADIUS):
            x ^= 1 << b
        assert any((i, x >> 8 * i & 255) in index for i in range(8))


def test_no_python_in_the_plan(spark):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert "Python" not in D._matches_of_size(d, b, 5, 0.8, 24)._jdf.queryExecution().toString()


def test_bitmaps_keep_every_row_that_is_there(spark):
    from inkmeter.llm.common import possible
    wanted = spark.range(0, 3000, 3).selectExpr("id as k")
    rows = spark.range(3000).selectExpr("cast(nullif(id, 7) as long) as k", "id as v")
    got = {r.v for r in possible(rows, wanted, ["k"]).collect()}
    assert got >= set(range(0, 3000, 3)) and len(got) < 1500
    assert possible(rows, wanted.limit(0), ["k"]).count() == 0


def test_items_that_share_a_common_shingle(spark):
    """Windows are held against the items they share words with; a shingle of every item is no special case."""
    common = "choose the one best answer"
    items = [(i, f"{common} " + " ".join(f"w{i}x{j}" for j in range(12))) for i in range(30)]
    docs = [(i, "before it " + items[i][1] + " behind") for i in range(10)] + [(50, common), (51, f"{common} and nothing else")]
    got = run(spark, docs, items)
    assert got == brute(docs, items) and {(k, i) for k, i, _ in got} == {(i, i) for i in range(10)}
