"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks (DataFrame functions only).

Texts are lower-cased and cut into words of letters and digits; shingles are
``WORDS`` consecutive words (an item with fewer words has one shingle, all of
them).  For every benchmark item of n words the documents' windows of n
words are compared with it:

1. Windows.  The similarity of a window that starts with a shingle the item
   lacks does not fall when the window moves on by one word, so the best
   window of an item starts at a shingle that an item of its size has (or
   ends with the document).  Only those windows are built; all others are
   matched or bettered by one of them.
2. Fingerprints.  Each window and each item has the 64-bit SimHash of its
   shingles, counted with multiplicity.
3. Multi-index.  The 64 bits are cut into ``BLOCKS`` blocks.  Within
   ``RADIUS`` differing bits, some block differs in at most RADIUS // BLOCKS
   bits; the item side is listed under every block value within that
   distance, so an equality join on (size, block, value) meets all pairs
   within the radius, and the exact distance removes the rest.
4. Verification.  The weighted Jaccard similarity of the two shingle lists
   (smaller count over larger count, summed) must reach ``SIMILARITY``.

Work is done once per distinct text (64-bit hash and length), so a text with
many copies costs one verification.  The item side is broadcast only while
its measured number of rows is small; past that it is joined like any table.

Defined results: null or wordless documents and items match nothing; a
document shorter than an item is one window; repeated rows and rows with
null doc_id come back once per row; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmeter.llm.common import kept, whole_row

WORDS = 5
SIMILARITY = 0.8
RADIUS = 24
BLOCKS = 8
#: Rows of a side that may be broadcast (a row is under 200 bytes).
BROADCAST_ROWS = 200_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once (a plain column would be put into every use of it)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _places(words: Column, k: int) -> Column:
    """Places where a shingle of k words starts; an empty array for fewer words."""
    n = F.size(words)
    return F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))


def _hashes(words: Column, k: int) -> Column:
    return F.transform(_places(words, k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def _shingles(words: Column, k: int) -> Column:
    return F.transform(_places(words, k), lambda i: F.concat_ws(" ", F.slice(words, i + 1, k)))


def _simhash(hashes: Column) -> Column:
    """Majority of each bit over an array of longs.  Two counters share a long: bit j and bit j + 32."""
    mask = F.lit(0x0000000100000001).cast("long")

    def counted(j: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, j).bitwiseAND(mask))

    sums = F.array(*[counted(j) for j in range(32)])
    low = F.lit(0xFFFFFFFF).cast("long")

    def bits(pair: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(64):
            count = F.shiftrightunsigned(F.get(pair["sums"], F.lit(b % 32)), 32 * (b // 32)).bitwiseAND(low)
            bit = F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")
            out = out.bitwiseOR(F.when(count * 2 > pair["n"], bit).otherwise(F.lit(0).cast("long")))
        return out

    return _let(F.struct(sums.alias("sums"), F.size(hashes).alias("n")), bits)


def _similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles."""
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(
        F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return _let(shared, lambda s: s / (F.size(a) + F.size(b) - s))


def benchmark_items(benchmark: DataFrame, k: int) -> DataFrame:
    """Items whose shingles have k words: item_id, n, hashes, shingles, fingerprint."""
    words = F.explode(F.array(_words(F.col("text")))).alias("words")
    rows = benchmark.where(F.col("text").isNotNull()).select("item_id", words)
    n = F.size("words")
    rows = rows.where(n >= WORDS if k == WORDS else n == k)
    return rows.select("item_id", n.alias("n"), _hashes(F.col("words"), k).alias("hashes"),
                       _shingles(F.col("words"), k).alias("shingles")).withColumn("item_fp", _simhash(F.col("hashes")))


def block_index(items: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(n, block, value) -> item, for every block value within radius // blocks bits of the item's."""
    width = 64 // blocks
    per_block = radius // blocks
    rows = items.select("item_id", "n", "item_fp", F.explode(_block_values(F.col("item_fp"), blocks)).alias("b"))
    rows = rows.select("item_id", "n", "item_fp", "b.block", F.col("b.value").alias("own"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << width) - 1).cast("long"))).alias("value"))
    return rows.where(F.bit_count(F.col("own").bitwiseXOR(F.col("value"))) <= per_block).drop("own")


def _block_values(fp: Column, blocks: int) -> Column:
    width = 64 // blocks
    mask = F.lit((1 << width) - 1).cast("long")
    return F.array(*[F.struct(F.lit(i).alias("block"),
                              F.shiftrightunsigned(fp, width * i).bitwiseAND(mask).alias("value"))
                     for i in range(blocks)])


def text_key() -> list[Column]:
    """What stands for a text: its hash and its length in bytes."""
    return [F.xxhash64("text").alias("_h"), F.octet_length("text").alias("_len")]


def _matches_of_size(docs: DataFrame, benchmark: DataFrame, k: int, similarity: float, radius: int) -> DataFrame:
    items = kept(benchmark_items(benchmark, k), "bench-items")
    shingles = kept(items.select("n", F.explode("hashes").alias("h")).distinct(), "bench-shingles")
    index = kept(block_index(items, radius), "bench-index")

    texts = docs.where(F.col("text").isNotNull()).select("text", *text_key())
    hashed = texts.select("_h", "_len", F.explode(F.transform(
        F.array(_words(F.col("text"))), lambda w: F.struct(F.size(w).alias("nw"), _hashes(w, k).alias("hs")))).alias("d"))
    places = hashed.select("_h", "_len", "d.nw", F.posexplode("d.hs").alias("pos", "h"))
    hits = places.join(_small(shingles, shingles.count()), "h")
    first = F.greatest(F.lit(0), F.least(F.col("pos"), F.col("nw") - F.col("n")))
    windows = kept(hits.groupBy("_h", "_len").agg(F.collect_set(F.struct(first.alias("s"), "n")).alias("wins")),
                   "bench-windows")

    found = texts.join(_small(windows, windows.select(F.coalesce(F.sum(F.size("wins")), F.lit(0))).first()[0]),
                       ["_h", "_len"]).dropDuplicates(["_h", "_len"])
    cut = found.select("_h", "_len", F.explode(F.get(F.transform(
        F.array(_words(F.col("text"))),
        lambda words: F.transform("wins", lambda w: F.struct(
            w["s"].alias("s"), w["n"].alias("n"), F.slice(words, w["s"] + 1, w["n"]).alias("words")))),
        F.lit(0))).alias("w")).select("_h", "_len", "w.*")
    prints = kept(cut.select("_h", "_len", "s", "n", "words", _let(_hashes(F.col("words"), k), _simhash).alias("fp")),
                  "bench-prints")
    probes = prints.select("_h", "_len", "s", "n", "words", "fp", F.explode(_block_values(F.col("fp"), BLOCKS)).alias("b"))
    probes = probes.select("_h", "_len", "s", "n", "words", "fp", "b.*")
    near = (probes.join(_small(index, index.count()), ["n", "block", "value"])
            .withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
            .where(F.col("distance") <= radius)
            .groupBy("_h", "_len", "s", "n", "words", "item_id", "distance").agg(F.count("*").alias("blocks_met")))
    checked = near.join(_small(items.select("item_id", "shingles"), items.count()), "item_id").withColumn(
        "similarity", _let(_shingles(F.col("words"), k), lambda mine: _similarity(F.col("shingles"), mine)))
    best = checked.where(F.col("similarity") >= similarity).groupBy("_h", "_len", "item_id", "n").agg(
        F.max(F.struct("similarity", (-F.col("s")).alias("s"), (-F.col("distance")).alias("d"))).alias("m"))
    return best.select("_h", "_len", "item_id", F.col("n").alias("n_words"), "m.similarity",
                       (-F.col("m.s")).alias("start_word"), (-F.col("m.d")).alias("distance"))


def matched_texts(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
                  radius: int = RADIUS) -> DataFrame:
    """One row per (distinct text, benchmark item) that match; the text is given by :func:`text_key`."""
    sizes = benchmark.where(F.col("text").isNotNull()).select(
        F.least(F.size(_words(F.col("text"))), F.lit(WORDS)).alias("k")).distinct().where("k > 0")
    ks = sorted(r.k for r in sizes.collect())  # at most WORDS rows
    out = None
    for k in ks or [WORDS]:
        got = _matches_of_size(docs, benchmark, k, similarity, radius)
        out = got if out is None else out.unionByName(got)
    return kept(out, "bench-matches")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
                 radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words, distance of every document row that holds an item."""
    matches = matched_texts(docs, benchmark, similarity, radius)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", *text_key())
    return rows.join(_small(matches, matches.count()), ["_h", "_len"]).select(
        "doc_id", "item_id", "similarity", "start_word", "n_words", "distance")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
                         radius: int = RADIUS) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item."""
    keys = matched_texts(docs, benchmark, similarity, radius).select("_h", "_len").distinct()
    rows = docs.select(whole_row(docs), *text_key())
    return rows.join(_small(keys, keys.count()), ["_h", "_len"], "left_anti").select("row.*")
