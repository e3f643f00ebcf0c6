"""MinHash near-duplicates from bottom-k sketches.

Sets.  The text is lower-cased (A-Z only) and cut into words at ASCII white
space; a document's set is its distinct five-word shingles (fewer words: the
whole sequence; no word: empty, and linked with nothing).  Two documents are
linked if 100 * intersection >= ``PERCENT`` * union.

Sketches.  One hash function (XXH64) orders all shingles; a sketch retains
the ``K`` least hashes of a set.  Documents with the same set are one class,
found by a digest of all its hashes.

Inverted lists.  A linked pair shares at least ``LEAST`` of its retained
values: the K least hashes of the union are a random sample of it, and fewer
than LEAST of them are shared with probability 3e-10 at the least similarity
that links.  If all values are ordered by the number of classes that retain
them, two such sketches therefore share one of their K - LEAST + 1 rarest
values, and only those are listed: a value that many documents retain is
listed where little else is left.  Sets of at most ``PERCENT`` % of K
shingles are whole sketches, and so are their partners'; for these LEAST is
the overlap the threshold asks for, without any chance.

Groups.  The lists whose smallest class is the same form one group: near
copies share most of their lists, so a pair meets in few groups and not once
for every value it shares.  A group is compared inside one task:

- Estimate: the K least values of both sketches together are a sketch of the
  union; a pair stays if at least LEAST of them are in both (for whole
  sketches: if the exact ratio reaches the threshold).
- Verification: the whole sets are intersected, and a pair that links two
  parts of the group that were not connected before is verified once more on
  the shingles themselves.  Pairs that are connected already are not tried,
  so n near copies give n - 1 links and about as many comparisons.

Groups of more than ``CELL`` classes (or ``SHINGLES`` shingles) are compared
in parts, each with a few classes common to all parts.  Where that leaves
them in more than one component, the classes outside of the largest one are
compared with all of the group, again in parts.  So memory is bounded and no
link between components is lost.

Defined results: null and empty texts have n_shingles 0 and are their own
component; rows with a null doc_id keep their row, have no part in choosing
a component_id (null if no other row of the component has one) and are not
kept; repeated rows all come back; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmeter.llm.common import kept, possible, word_pieces
from inkmeter.llm.components import components

WORDS = 5
PERCENT = 85
K = 64
#: Of K values of a union, so many are shared by a linked pair at least (P of fewer: 3e-10; fixed by K and PERCENT).
LEAST = 34
#: Largest set whose linked partners are whole sketches, too.
WHOLE = K * PERCENT // 100
#: Classes, and shingles, of one part of a group; classes that all parts have in common (about).
CELL, SHINGLES, ANCHORS = 2048, 4_000_000, 16
_BLANK = re.compile("[\x20\x09-\x0d]")


def _words(text: str) -> list:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _shingles(words: list) -> list:
    """The shingles of a word sequence, as bytes."""
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
    k = min(WORDS, len(words))
    starts = np.concatenate(([0], gaps + 1))[:len(words) - k + 1].tolist()
    ends = np.concatenate((gaps, [len(line)]))[k - 1:].tolist()
    return [line[a:b] for a, b in zip(starts, ends)]


def _pieces(text: str) -> Iterator[list]:
    """Shingles of a whole text, some at a time; shingles across pieces are in one of them."""
    short = None
    for words in word_pieces(text or "", _words, _BLANK, overlap=WORDS - 1):
        if len(words) >= WORDS:
            short = None
            yield _shingles(words)
        else:
            short = words
    if short:
        yield _shingles(short)


def hashes(text: str) -> np.ndarray:
    """Ascending 63-bit hashes of the distinct shingles."""
    got = [np.array(list(map(xxhash.xxh64_intdigest, s)), dtype=np.uint64) >> np.uint64(1) for s in _pieces(text)]
    return np.unique(np.concatenate(got)).astype(np.int64) if got else np.zeros(0, dtype=np.int64)


def shingle_set(text: str) -> set:
    out: set = set()
    for s in _pieces(text):
        out.update(s)
    return out


# --------------------------------------------------------------------------
# sketches, classes, lists
# --------------------------------------------------------------------------

def _sketch_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        n, same, sketch = [], [], []
        for text in pdf["text"]:
            h = hashes(text)
            n.append(len(h))
            same.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
            sketch.append(h[:K])
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None), "key": pdf["key"].astype(object),
                            "n": np.array(n, dtype=np.int64), "same": pd.Series(same, dtype=object),
                            "sketch": pd.Series(sketch, dtype=object)})


def text_key(text: str):
    """What names a text: its md5 digest."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("key")


def sketched(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, key, n, same, sketch) of every row: set size, digest of the whole set (null if empty), K least hashes."""
    # ids travel as text: a null among longs would turn them into floats
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_key(text), F.coalesce(text, F.lit("")).alias("text"))
    out = rows.mapInPandas(_sketch_batches, "doc_id string, key string, n long, same binary, sketch array<long>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def classes_of(rows: DataFrame) -> DataFrame:
    """(id, same, first, key, doc, n, sketch): a row for each set; ``key`` and ``doc`` name one document that has it."""
    one = F.first(F.struct("key", "doc_id", "n", "sketch")).alias("one")
    grouped = rows.where("same IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("first"), one)
    return grouped.select(F.monotonically_increasing_id().alias("id"), "same", "first", "one.key",
                          F.col("one.doc_id").alias("doc"), "one.n", "one.sketch")


def lists_of(classes: DataFrame) -> DataFrame:
    """(v, id, n): of every class the rarest values that two linked sketches share one of, if another class retains it."""
    values = classes.select("id", F.explode("sketch").alias("v"))
    counts = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    several = values.join(counts, "v").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("several"))
    size = F.size("sketch")
    needed = F.when(F.col("n") <= WHOLE, F.ceil(F.col("n") * PERCENT / 100)).otherwise(F.lit(LEAST))
    # values that no other class retains are the rarest ones of all
    take = (size - needed + 1) - (size - F.size("several"))
    few = several.join(classes.select("id", "n", "sketch"), "id").select(
        "id", "n", F.explode(F.slice("several", F.lit(1), F.greatest(take, F.lit(0)).cast("int"))).alias("s"))
    return few.select("s.v", "id", "n")


def groups_of(lists: DataFrame, cell: int = CELL) -> DataFrame:
    """(a, id, size, parts): the classes of all lists whose smallest class is a, at least two, and the parts they make."""
    least = lists.groupBy("v").agg(F.min("id").alias("a"))
    members = kept(lists.join(least, "v").select("a", "id", "n").distinct(), "minhash-members")
    sizes = members.groupBy("a").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1")
    parts = F.greatest(F.ceil(F.col("size") / cell), F.ceil(F.col("shingles") / SHINGLES)).cast("int").alias("parts")
    return kept(members.join(sizes.select("a", "size", parts), "a").select("a", "id", "size", "parts"), "minhash-groups")


# --------------------------------------------------------------------------
# estimate
# --------------------------------------------------------------------------

def estimated(a: np.ndarray, na: int, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Which rows of the sketches ``b`` (padded with -1) may be linked with the sketch ``a``; na, nb: sizes of the sets."""
    nb = np.asarray(nb)
    out = 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)
    rows = np.flatnonzero(out)
    if not len(rows):
        return out
    b, nb = b[rows], nb[rows]
    at = np.searchsorted(a, b)
    both = (a[np.minimum(at, len(a) - 1)] == b) & (b >= 0)
    shared = np.cumsum(both, axis=1)
    # a shared value is among the K least of the union if fewer than K values of both come before it
    rank = at + np.arange(1, b.shape[1] + 1) + 1 - shared
    inside = (both & (rank <= K)).sum(axis=1)
    whole = (na <= K) & (nb <= K)
    union = na + nb - shared[:, -1]
    out[rows] = np.where(whole, 100 * shared[:, -1] >= PERCENT * union, inside >= LEAST)
    return out


def _matrix(sketches) -> np.ndarray:
    out = np.full((len(sketches), K), -1, dtype=np.int64)
    for row, s in zip(out, sketches):
        row[:len(s)] = s
    return out


# --------------------------------------------------------------------------
# comparison
# --------------------------------------------------------------------------

def linked(a: set, b: set) -> bool:
    shared = len(a & b)
    return bool(shared) and 100 * shared >= PERCENT * (len(a) + len(b) - shared)


class Piece:
    """Texts that are compared with each other."""

    def __init__(self, texts: list):
        self.texts = texts
        self.sets = [hashes(t) for t in texts]
        self.n = np.array([len(h) for h in self.sets], dtype=np.int64)
        self.sketch = _matrix([h[:K] for h in self.sets])

    def linked(self, i: int, other: np.ndarray) -> np.ndarray:
        """Which of ``other`` are linked with text i: by estimate, then by the whole sets of hashes."""
        mine = self.sets[i]
        other = other[estimated(mine[:K], int(self.n[i]), self.sketch[other], self.n[other])]
        if not len(other):
            return other
        flat = np.concatenate([self.sets[j] for j in other.tolist()])
        at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        shared = np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum(self.n[other]) - self.n[other])
        return other[100 * shared >= PERCENT * (self.n[i] + self.n[other] - shared)]

    def links(self, root: np.ndarray) -> list:
        """Verified links (i, j) that connect all that is linked; ``root``: what is connected already."""
        root, out = root.copy(), []
        for i in range(len(root) - 1):
            mine = None
            for j in self.linked(i, i + 1 + np.flatnonzero(root[i + 1:] != root[i])).tolist():
                if root[j] == root[i]:
                    continue
                mine = shingle_set(self.texts[i]) if mine is None else mine
                if linked(mine, shingle_set(self.texts[j])):
                    out.append((i, j))
                    root[root == root[j]] = root[i]
        return out


def _links_of(pdf: pd.DataFrame) -> pd.DataFrame:
    ids = pdf["id"].to_numpy(np.int64)
    found = Piece(pdf["text"].tolist()).links(pdf["root"].to_numpy(np.int64))
    a, b = (np.array([ids[p[k]] for p in found], dtype=np.int64) for k in (0, 1))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _link_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted batches in; a piece ends where (a, x, y) changes, the last one of a batch waits for the next batch."""
    held: list = []
    for pdf in batches:
        key = pdf[["a", "x", "y"]].to_numpy(np.int64)
        cuts = [0, *(1 + np.flatnonzero((key[1:] != key[:-1]).any(axis=1))).tolist(), len(pdf)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if held and held[0][0] != tuple(key[lo]):
                yield _links_of(pd.concat([p for _, p in held], ignore_index=True))
                held = []
            held.append((tuple(key[lo]), pdf.iloc[lo:hi]))
    if held:
        yield _links_of(pd.concat([p for _, p in held], ignore_index=True))


def _compared(pieces: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) found in the pieces (a, x, y, id, root)."""
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.join(texts, "id").repartition(tasks, "a", "x", "y").sortWithinPartitions("a", "x", "y", "id")
    return kept(dealt.select("a", "x", "y", "id", "root", "text").mapInPandas(_link_batches, "a long, b long"), "minhash-links")


def texts_of(ids: DataFrame, classes: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, text) of the classes ``ids`` (id); only texts that are asked for are moved."""
    wanted = classes.select("id", "key", F.coalesce(F.col("doc").cast("string"), F.lit("")).alias("doc")).join(ids, "id")
    wanted = kept(wanted.select("id", "key", "doc"), "minhash-wanted")
    rows = docs.select(text_key(text), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
                       F.coalesce(text, F.lit("")).alias("text"))
    found = possible(rows, wanted, ["key", "doc"]).join(wanted, ["key", "doc"]).dropDuplicates(["id"])
    return kept(found.select("id", "text"), "minhash-texts")


def links_of(classes: DataFrame, docs: DataFrame, text: str = "text", cell: int = CELL) -> DataFrame:
    """Verified links (a, b) between classes: enough to connect all that are linked."""
    groups = groups_of(kept(lists_of(classes), "minhash-lists"), cell)
    texts = texts_of(groups.select("id").distinct(), classes, docs, text)
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    common = (F.col("parts") > 1) & (F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("size") / ANCHORS)) == 0)
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    first = _compared(groups.select("a", "id", F.col("id").alias("root"), F.lit(0).alias("y"), F.explode(
        F.when(common, every).otherwise(F.array(part))).alias("x")), texts)

    # groups that were compared in parts and are not one component yet
    rooted = groups.where("parts > 1").join(components(first).withColumnRenamed("node", "id"), "id", "left")
    rooted = kept(rooted.withColumn("root", F.coalesce("root", "id")), "minhash-rooted")
    main = rooted.groupBy("a", "root").agg(F.count("*").alias("n"), F.max("size").alias("size")).groupBy("a").agg(
        F.max(F.struct("n", "root")).alias("m"), F.max("size").alias("size"))
    main = main.where("m.n < size").select("a", F.col("m.root").alias("main"),
                                           F.ceil((F.col("size") - F.col("m.n")) / cell).cast("int").alias("few"))
    split = rooted.join(main, "a")
    rest = F.sequence(F.lit(0), F.col("few") - 1)
    mine = F.pmod(F.xxhash64("id", F.lit(2)), F.col("few")).cast("int")
    place = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    # a class of the largest component meets all parts of the others; these meet all parts of it and each other
    with_main = F.when(F.col("root") == F.col("main"), F.transform(rest, lambda y: place(part, y))).otherwise(F.concat(
        F.transform(every, lambda x: place(x, mine)),
        F.transform(rest, lambda y: place(-1 - F.least(mine, y), F.greatest(mine, y)))))
    pieces = split.select("a", "id", "root", F.explode(with_main).alias("p")).select("a", "id", "root", "p.x", "p.y")
    return first.unionByName(_compared(pieces, texts))


def near_duplicates(docs: DataFrame, text: str = "text", cell: int = CELL) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (see the module's notes)."""
    rows = kept(sketched(docs, text), "minhash-sketches")
    classes = kept(classes_of(rows), "minhash-classes")
    rooted = (classes.select("id", "same", "first")
              .join(components(links_of(classes, docs, text, cell)).withColumnRenamed("node", "id"), "id", "left")
              .withColumn("root", F.coalesce("root", "id")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = kept(rooted.join(least, "root").select("same", "component_id"), "minhash-components")
    out = rows.select("doc_id", "n", "same").join(of_class, "same", "left")
    component = F.when(F.col("same").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
