"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmeter.session import scratch_path, ship_package

#: Odd 64-bit multipliers of the mixing functions (fixed values).
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_row(df: DataFrame):
    """All columns of ``df`` as one struct ``row``, so that no helper column can clash with one of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, applied element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


def fold_mod(col: str, modulus: int):
    """crc32 of a key written as text, modulo ``modulus`` (null stays null)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus


def word_pieces(text: str, words_of, gap, overlap: int, piece: int = 1 << 18):
    """Lists of the words of a text, cut where ``gap`` matches; each list repeats the last ``overlap`` words."""
    lo, last = 0, []
    while lo < len(text):
        hi = lo + piece
        if hi < len(text):
            blank = gap.search(text, hi)
            hi = blank.start() if blank else len(text)
        words = last + words_of(text[lo:hi])
        if len(words) > len(last):
            yield words
        last, lo = words[len(words) - overlap:] if len(words) > overlap else words, hi


def cut_text(text: str, gap, piece: int = 1 << 18):
    """Pieces of a text, cut only where ``gap`` (one character that no run holds) matches."""
    lo = 0
    while lo < len(text):
        hi = lo + piece
        if hi < len(text):
            blank = gap.search(text, hi)
            hi = blank.start() if blank else len(text)
        yield text if lo == 0 and hi >= len(text) else text[lo:hi]
        lo = hi


class WordHashes:
    """64-bit hashes of words (and of their first ``stem`` letters), remembered in a table of bounded size."""

    def __init__(self, bound: int = 300_000, stem: int = 0):
        self.bound, self.stem = bound, stem
        self._clear()

    def _clear(self) -> None:
        self.known: dict = {}
        self.hashes = np.zeros(1024, dtype=np.uint64)
        self.stems = np.zeros(1024, dtype=np.uint64)

    @staticmethod
    def _hash(word) -> int:
        b = word.encode("utf-8", "surrogatepass") if isinstance(word, str) else word
        return zlib.crc32(b) | (zlib.adler32(b) + 31 * len(b) & 0xFFFFFFFF) << 32

    def _learn(self, new: list, first: int) -> None:
        size = max(1, len(self.hashes))
        while size < first + len(new):
            size *= 2
        for name, cut in (("hashes", None), ("stems", self.stem)):
            column = getattr(self, name)
            if size > len(column):
                column = np.concatenate((column, np.zeros(size - len(column), dtype=np.uint64)))
                setattr(self, name, column)
            if cut != 0:
                got = np.array([self._hash(w[:cut]) for w in new], dtype=np.uint64)
                column[first:first + len(new)] = mix64(got * GOLDEN)

    def __call__(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.bound:
            self._clear()
        known = self.known
        at = list(map(known.get, words))
        if None in at:
            new, first = [], len(known)
            for i, v in enumerate(at):
                if v is None:
                    w = words[i]
                    v = known.get(w)
                    if v is None:
                        v = known[w] = first + len(new)
                        new.append(w)
                    at[i] = v
            self._learn(new, first)
        at = np.array(at, dtype=np.int64)
        return self.hashes[at], self.stems[at]


LOWEST = -(1 << 63)


def range_parts(df: DataFrame, key: str, text: str, parts: int, edges=None, exact: bool = False) -> tuple[DataFrame, np.ndarray]:
    """``df`` plus ``part``: ascending ranges of the long column ``key``, about equal in rows.

    The ranges are cut at quantiles.  A key that fills several ranges is a cut
    several times over; its rows are spread over those ranges by a hash of ``text``.
    ``edges``: the cuts of an earlier call, to place other rows alike.  ``exact``: cuts by the keys' exact ranks, which
    depend on the rows only; approximate quantiles also depend on the order and the partitions the rows come in.
    """
    if edges is None:
        cuts = df.approxQuantile(key, [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
        edges = np.array(sorted(int(min(max(c, LOWEST), (1 << 63) - 1024)) for c in cuts), dtype=np.int64)
        if exact and len(edges):
            return range_parts(df, key, text, parts, _exact_edges(df, key, parts, edges))

    @F.pandas_udf("int")
    def part_of(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        k = keys.to_numpy(dtype=np.int64)
        low, high = np.searchsorted(edges, k, side="left"), np.searchsorted(edges, k, side="right")
        wide = np.maximum(high - low, 1)
        return pd.Series((low + hashes.to_numpy(dtype=np.int64) % wide).astype(np.int32))

    return df.withColumn("part", part_of(F.col(key), F.xxhash64(text))), edges


def _exact_edges(df: DataFrame, key: str, parts: int, edges: np.ndarray) -> np.ndarray:
    """The keys at the ranks i * rows / parts.  ``edges`` (about there) deal the keys, one row each, to tasks."""
    from pyspark.sql import Window

    counts = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).withColumn("text", F.lit(""))
    # equal cuts add nothing here: a key is one row
    dealt, _ = range_parts(counts, "key", "text", parts, np.unique(edges))
    dealt = kept(dealt.select("part", "key", "n"), "range-keys")
    base = prefix_sums(dealt.groupBy("part").agg(F.sum("n").alias("m")), "part", "m").select("part", "base")
    last = F.col("base") + F.sum("n").over(Window.partitionBy("part").orderBy("key"))
    ranked = dealt.join(base, "part").withColumn("last", last)
    total = F.lit(int(dealt.agg(F.sum("n")).first()[0]))

    def cut(rank):
        return F.least(F.floor(rank * parts / total), F.lit(parts - 1))

    found = ranked.select("key", cut(F.col("last") - F.col("n")).alias("a"), cut(F.col("last")).alias("b")).where("b > a")
    rows = found.select("key", F.explode(F.sequence(F.col("a") + 1, F.col("b")))).collect()  # one row a cut
    return np.array(sorted(r.key for r in rows), dtype=np.int64)


def tasks_for(df: DataFrame, rows_per_task: int = 20_000) -> int:
    """Number of shuffle partitions for a wide table: the session's, or more for many rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // rows_per_task)


def distinct_sample(rows: DataFrame, of: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """At most ``size`` different rows of ``rows``: those with the smallest hashes, whatever order the files have.

    Only hashes in the share of the range that holds about four times ``size`` of the rows of ``of`` are looked at, so
    fewer rows than ``size`` come back where copies (or rows of ``of`` that are not in ``rows``) are most of them.  Copies
    of a row are reduced to one in every task before the shuffle.
    """
    share = min(1.0, 4 * size / max(1, of.count()))
    hashed = rows.select(F.xxhash64(*[F.col(c) for c in rows.columns], F.lit(seed)).alias("_hash"), *rows.columns)
    if share < 1.0:
        hashed = hashed.where(F.col("_hash") < int((2 * share - 1) * (1 << 63)))
    one = hashed.groupBy("_hash").agg(*[F.first(c).alias(c) for c in rows.columns])
    return one.orderBy("_hash").limit(size).select(*rows.columns)


#: Bits of one bitmap of :func:`possible` (what ``bitmap_construct_agg`` holds), and the most bitmaps it makes.
MAP_BITS, MAPS = 1 << 15, 1 << 14


def possible(df: DataFrame, wanted: DataFrame, keys: list) -> DataFrame:
    """Rows of ``df`` whose ``keys`` may be among those of ``wanted``; every row that is there stays, a few others do too.

    The keys' hashes set bits of at most ``MAPS`` bitmaps (4 KB each, 64 MB in all), which are broadcast whatever the
    tables' sizes; with more keys than that has room for, fewer rows are kept back.  A shuffled join then decides.
    """
    maps = int(min(MAPS, max(1, 16 * wanted.count() // MAP_BITS + 1)))
    h = F.xxhash64(*keys)
    place = [F.pmod(h, F.lit(maps)).cast("int").alias("_map"), F.pmod(F.shiftright(h, 20), F.lit(MAP_BITS)).alias("_bit")]
    bits = wanted.select(*place).groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = df.select("*", *place).join(F.broadcast(bits), "_map")
    return found.where(F.getbit(byte, F.pmod("_bit", F.lit(8)).cast("int")) == 1).select(*df.columns)


class FileOutput:
    """A file written under a temporary name and moved to its final name when it is complete."""

    def __init__(self, folder: str, name: str):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.name, self.final = name, f"{base}/{name}"
        self.temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.temporary, compression=None)
        self.size, self.digest = 0, hashlib.sha256()

    def write(self, data: bytes) -> int:
        at = self.size
        self.stream.write(data)
        self.digest.update(data)
        self.size += len(data)
        return at

    def commit(self) -> None:
        self.stream.close()
        self.fs.move(self.temporary, self.final)


def read_file(folder: str, name: str) -> bytes:
    fs, base = filesystem(folder)
    with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
        return f.read()


def filesystem(uri: str):
    """(pyarrow file system, path) of a scratch URI; a plain path is local."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def prefix_sums(per_file: DataFrame, order: str, count: str) -> DataFrame:
    """One row per output file in; adds ``base``, the sum of ``count`` over all files before it."""
    from pyspark.sql import Window

    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return per_file.withColumn("base", F.coalesce(F.sum(count).over(w), F.lit(0)).cast("long"))
