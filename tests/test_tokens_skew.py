"""BPE counting from a local rank file, and the hot-file layout of ordered scans."""

import base64
import os
import random
import tempfile

from pyspark.sql import functions as F

from inkmeter.functions import tokens
from inkmeter.operators import packing
from inkmeter.plans import ordered


def _rank_file() -> str:
    """A tiny byte-level BPE: all 256 bytes plus a few merges (written for the test)."""
    ranks = [bytes([i]) for i in range(256)] + [b"th", b"the", b"er", b" t", b" the"]
    path = os.path.join(tempfile.mkdtemp(prefix="inkmeter-bpe-"), "tiny.tiktoken")
    with open(path, "w") as fh:
        for i, tok in enumerate(ranks):
            fh.write(f"{base64.b64encode(tok).decode()} {i}\n")
    return path


def test_bpe_counter_matches_local_encoding(spark):
    path = _rank_file()
    texts = ["the other theme", "", None, "Ther the  the\nthe!"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.n for r in df.select(tokens.count_tokens("text", "bpe", path).alias("n")).collect()]
    enc = tokens._load_encoding(path)
    want = [len(enc.encode(t or "", disallowed_special=())) for t in texts]
    assert got == want and got[0] < len("the other theme")


def test_hot_file_spreads_over_partitions_and_packs_exactly(spark):
    rnd = random.Random(7)
    rows = [("hot", i, rnd.randint(1, 300)) for i in range(3000)]
    rows += [(f"f{i % 50}", 10_000 + i, rnd.randint(1, 300)) for i in range(6000)]
    df = spark.createDataFrame(rows, "file string, pos long, tok long")
    s = ordered.ordered_scan(df, ["file"], ["pos"], "greedy", pack=[("tok", 2000)], num_partitions=12)
    got = {(r.file, r.pos): r._part for r in s.collect()}
    hot_parts = s.filter(F.col("file") == "hot").select(F.spark_partition_id().alias("p")).distinct().count()
    assert hot_parts >= 3  # the hot file is not one task
    # exact against the sequential fold
    cur, part, want = 0, 1, []
    for _, _, t in rows[:3000]:
        if cur and cur + t > 2000:
            part, cur = part + 1, 0
        cur += t
        want.append(part)
    assert [got[("hot", i)] for i in range(3000)] == want
    assert packing.chunk_greedy(df, 2000).count() == len(rows)
