"""SimHash near-duplicates found through pivot distance tables.

Fingerprints.  The text is lower-cased (A-Z only) and cut into words at
ASCII white space; every four-word shingle (repeats count, fewer words: the
whole sequence) gives the XXH64 hash of its UTF-8 bytes, seed 42; a bit is
set if more than half the hashes set it.  No word: fingerprint zero.

Pairs.  Let r be the largest distance that links (4).  The 64 bits are cut
into ``BLOCKS`` = r + 2 blocks.  Reference fingerprints (pivots) are the zero
fingerprint, ``PER_BLOCK`` random patterns inside each block, and
``WIDE`` random patterns over all 64 bits.  The table holds, for each
distinct fingerprint x, its Hamming distances d(x, p) to all of them.

- The difference d(x, p) - d(x, 0) of a block pivot depends on that block
  alone.  At most r of the blocks differ between linked fingerprints, so two
  blocks agree, and so do all their coordinates: every linked pair shares
  the cell of at least one of the C(BLOCKS, 2) pairs of blocks.
- By the triangle inequality |d(x, p) - d(y, p)| <= d(x, y).  Pairs of a cell
  whose largest coordinate difference over the wide pivots exceeds r are
  discarded; survivors are verified by their exact distance.

Scale.  Equal fingerprints are one row of the table.  A cell is worked on
in pieces of at most ``CELL`` rows: larger cells are dealt at random into
groups, and every pair of groups is a piece of its own, so memory stays
bounded and no pair is lost.  Inside a piece small runs are compared by
shifting; larger ones are searched breadth first, each fingerprint against
those not reached yet, so that a dense group of n fingerprints gives n - 1
links and not n * n.  Links become components by alternating star steps;
nothing is collected to the driver.

Defined results: null text has fingerprint zero; a null doc_id keeps its row
and never becomes a component_id unless its component has no other id (then
null); repeated rows all come back; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmeter.llm.common import kept, whole_row
from inkmeter.llm.components import components

RADIUS = 4
WORDS = 4
SEED = 42
PER_BLOCK = 8
WIDE = 8
CELL = 4096
#: Runs up to this length are compared pair by pair.
SHORT = 24
#: Shingles hashed at a time.
PIECE = 1 << 15


def fingerprint(text, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of a text; whole text, counted in pieces of bounded size."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    gaps = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
    k = min(words, len(parts))
    starts = np.concatenate(([0], gaps + 1))[:len(parts) - k + 1].tolist()
    ends = np.concatenate((gaps, [len(line)]))[k - 1:].tolist()
    ones = np.zeros(64, dtype=np.int64)
    of = xxhash.xxh64_intdigest
    for lo in range(0, len(starts), PIECE):
        h = np.array([of(line[a:b], seed) for a, b in zip(starts[lo:lo + PIECE], ends[lo:lo + PIECE])], dtype="<u8")
        # column sums of the bit matrix, a byte lane at a time
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > len(starts)).tolist())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def with_fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` plus ``_fp``, the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t if isinstance(t, str) else None, words)) for t in s], dtype="int64")

    return docs.withColumn("_fp", of(F.col(text)))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def pivots(radius: int = RADIUS, per_block: int = PER_BLOCK, wide: int = WIDE, seed: int = 11):
    """(block pivots by block, wide pivots), as unsigned integers; the zero pivot goes without saying."""
    rng = np.random.default_rng(seed)
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    by_block = []
    for lo, hi in zip(edges, edges[1:]):
        mask = ((1 << hi) - 1) ^ ((1 << lo) - 1)
        by_block.append([int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2)) & mask for _ in range(per_block)])
    return by_block, [int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2)) for _ in range(wide)]


def pivot_table(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, cells, coords) of distinct fingerprints, from their distances to all pivots (JVM only).

    ``cells`` has one key for each pair of blocks, ``coords`` the wide distances, a byte each.
    """
    by_block, wide = pivots(radius)

    def distance(p: int) -> Column:
        return F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p))))

    table = fps.select("fp", F.bit_count("fp").alias("d0"),
                       *[distance(p).alias(f"b{i}_{j}") for i, ps in enumerate(by_block) for j, p in enumerate(ps)],
                       *[distance(p).alias(f"w{j}") for j, p in enumerate(wide)])
    relative = [[F.col(f"b{i}_{j}") - F.col("d0") for j in range(len(ps))] for i, ps in enumerate(by_block)]
    keys = [F.xxhash64(F.lit(i), F.lit(j), *relative[i], *relative[j])
            for i, j in combinations(range(len(by_block)), 2)]
    packed = F.lit(0).cast("long")
    for j in range(len(wide)):
        packed = packed.bitwiseOR(F.shiftleft(F.col(f"w{j}").cast("long"), 8 * j))
    return table.select("fp", F.array(*keys).alias("cells"), packed.alias("coords"))


def _near(x: np.ndarray, cx: np.ndarray, y: np.ndarray, cy: np.ndarray, radius: int) -> np.ndarray:
    """Where x and y are linked: largest coordinate difference first, exact distance for the survivors."""
    a, b = cx.view(np.uint8).reshape(-1, 8).astype(np.int8), cy.view(np.uint8).reshape(-1, 8).astype(np.int8)
    some = np.flatnonzero((np.abs(a - b) <= radius).all(axis=1))
    x, y = np.broadcast_to(x, len(a) if len(x) == 1 else len(x)), np.broadcast_to(y, len(b))
    return some[np.bitwise_count(x[some] ^ y[some]) <= radius]


def _short_runs(fp, co, start, length, radius, out) -> None:
    """All pairs inside runs of at most SHORT rows, every run at the same time."""
    run = np.repeat(np.arange(len(start)), length)
    place = np.concatenate([np.arange(n) for n in length]) if len(length) else np.zeros(0, int)
    at = np.repeat(start, length) + place
    x, c = fp[at], co[at]
    for shift in range(1, int(length.max(initial=0))):
        same = np.flatnonzero(run[shift:] == run[:-shift])
        if not len(same):
            break
        hit = same[_near(x[same], c[same], x[same + shift], c[same + shift], radius)]
        out.append((x[hit], x[hit + shift]))


def _long_run(fp, co, radius, out) -> None:
    """Breadth-first search of one run: a reached fingerprint is compared with those not reached yet."""
    left = np.arange(len(fp))
    queue: list = []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        i = queue.pop()
        if not len(left):
            break
        hit = _near(np.broadcast_to(fp[i:i + 1], len(left)), np.repeat(co[i:i + 1], len(left)), fp[left], co[left], radius)
        if len(hit):
            found = left[hit]
            out.append((np.repeat(fp[i:i + 1], len(found)), fp[found]))
            queue.extend(found.tolist())
            left = np.delete(left, hit)


def _links_of(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Links inside the runs of equal (cell, piece) of a sorted frame."""
    cell, piece = pdf["cell"].to_numpy(np.int64), pdf["piece"].to_numpy(np.int64)
    fp, co = pdf["fp"].to_numpy(np.int64).view(np.uint64), np.ascontiguousarray(pdf["coords"].to_numpy(np.int64))
    new = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (piece[1:] != piece[:-1]))))
    length = np.diff(np.concatenate((new, [len(cell)])))
    out: list = []
    small = (length > 1) & (length <= SHORT)
    _short_runs(fp, co, new[small], length[small], radius, out)
    for s, n in zip(new[length > SHORT].tolist(), length[length > SHORT].tolist()):
        _long_run(fp[s:s + n], co[s:s + n], radius, out)
    a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.uint64)
    b = np.concatenate([y for _, y in out]) if out else np.zeros(0, np.uint64)
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def link_batches(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Sorted batches in, links out; the last run of a batch waits for the next batch (at most 2 * CELL rows)."""
    rest = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = ((pdf["cell"] == pdf["cell"].iloc[-1]) & (pdf["piece"] == pdf["piece"].iloc[-1])).to_numpy()
        cut = len(pdf) - int(np.argmin(last[::-1])) if not last.all() else 0
        rest = pdf.iloc[cut:].reset_index(drop=True)
        if cut:
            yield _links_of(pdf.iloc[:cut], radius)
    if rest is not None:
        yield _links_of(rest, radius)


def links(fps: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps`` (fp: long): enough to connect all within ``radius``."""
    rows = kept(pivot_table(fps, radius), "pivot-table").select("fp", "coords", F.explode("cells").alias("cell"))
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    crowded = sizes.where(F.col("n") > cell).select("cell", F.ceil(F.col("n") / cell).cast("int").alias("groups"))
    rows = rows.join(sizes.select("cell"), "cell", "left_semi").join(crowded, "cell", "left")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("groups")).cast("long")
    pairs = F.transform(F.sequence(F.lit(0), F.col("groups") - 1),
                        lambda g: F.least(own, g) * F.col("groups") + F.greatest(own, g))
    pieces = rows.select("cell", "fp", "coords", F.explode(
        F.when(F.col("groups").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("piece"))
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(tasks, "cell", "piece").sortWithinPartitions("cell", "piece", "fp")
    found = dealt.mapInPandas(lambda it: link_batches(it, radius), "a long, b long")
    return found.distinct()


def _grouped(narrow: DataFrame, radius: int) -> DataFrame:
    """(_fp, component_id, root) of every distinct fingerprint of ``narrow`` (doc_id, _fp)."""
    distinct = kept(narrow.groupBy(F.col("_fp").alias("fp")).agg(F.min("doc_id").alias("first")), "distinct-fps")
    roots = components(links(distinct.select("fp"), radius))
    rooted = (distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
              .withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return kept(rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id", "root"), "components")


def near_duplicates(docs: DataFrame, text: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs`` (see the module's notes)."""
    narrow = kept(with_fingerprints(docs.select("doc_id", F.col(text).alias("_t")), "_t", words)
                  .select("doc_id", "_fp"), "fingerprints")
    return narrow.join(_grouped(narrow, radius), "_fp").select(
        "doc_id", hexadecimal(F.col("_fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """The row with the smallest doc_id of each component, with its own columns.

    Of several rows with that doc_id in the component the one whose text has the smallest hash stays, and of equal
    texts one; a component without any doc_id keeps its text with the smallest hash.
    """
    narrow = kept(with_fingerprints(docs.select("doc_id", "text"), "text", words)
                  .select("doc_id", "_fp", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_t")), "fingerprints")
    named = narrow.join(_grouped(narrow, radius), "_fp")
    chosen = kept(named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_t"))
                                            .alias("m")).select("m.doc_id", "m._t"), "chosen")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    chosen = chosen.select(key.alias("key"), F.col("_t").alias("hash")).distinct()
    rows = docs.select(whole_row(docs), key.alias("key"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("hash"))
    rows = rows.join(chosen, ["key", "hash"], "left_semi")
    repeated = narrow.groupBy("doc_id", "_t").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.limit(1).count():
        rows = rows.dropDuplicates(["key", "hash"])
    return rows.select("row.*")
