"""Document fingerprints: threshold-scaled sketches of word shingles.

The sketch of a text keeps every hash of its five-word shingles (fewer
words: the whole sequence) that lies below ``FRACTION`` of the hash range.
Because the threshold is fixed, the union of two sketches is the sketch of
the two texts together, and shared hashes over the hashes of the smaller
side estimate containment between texts of very unequal length.  A text
whose shingles all lie above the threshold keeps its single smallest hash,
so that equal short texts still agree; a union drops that hash as soon as it
has one below the threshold.

A fingerprint is the ascending list of the kept hashes, twelve hexadecimal
digits each (the upper 48 bits), written without separators; a text without
a word has the empty fingerprint.

Defined results: null text counts as empty; two empty fingerprints have
likeness 1, an empty and a full one 0; rows with equal doc_id are ordered by
the hash of their text; null doc_ids come last in descending order; in a
table of one row the next document is that row itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmeter.llm.common import GOLDEN, LOWEST, MIX_A, MIX_B, WordHashes, mix64, range_parts, tasks_for, word_pieces

WORDS = 5
FRACTION = 1 / 4
DIGITS = 12
_CEILING = np.uint64(int(2 ** 64 * FRACTION))
_BLANK = re.compile(r"\s")
#: One odd multiplier for each place in a shingle.
_PLACES = [np.uint64(1), GOLDEN, MIX_A, MIX_B, np.uint64(0xD6E8FEB86659FD93)]


class Sketcher:
    """Kept hashes of texts; remembers word hashes in a table of bounded size."""

    def __init__(self):
        self.words = WordHashes()

    def _shingles(self, words: list) -> np.ndarray:
        w, _ = self.words(words)
        k = min(WORDS, len(w))
        total = np.full(len(w) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            total += w[j:len(w) - k + 1 + j] * _PLACES[j]
        return mix64(total)

    def __call__(self, text: str) -> np.ndarray:
        below, least = [], None
        for words in word_pieces(text, str.split, _BLANK, overlap=WORDS - 1):
            h = self._shingles(words)
            below.append(h[h < _CEILING])
            low = h.min()
            least = low if least is None or low < least else least
        if least is None:
            return np.zeros(0, dtype=np.uint64)
        got = np.unique(np.concatenate(below))
        return (got if len(got) else np.array([least], dtype=np.uint64)) >> np.uint64(16)


def to_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.array([int(fingerprint[i:i + DIGITS], 16) for i in range(0, len(fingerprint), DIGITS)], dtype=np.uint64)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of two texts together."""
    both = np.union1d(a, b)
    below = both[both < _CEILING >> np.uint64(16)]
    return below if len(below) else both[:1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes over all hashes of both (estimates the Jaccard similarity of the shingle sets)."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smaller sketch that the other holds."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def in_id_order(docs: DataFrame, parts_per_task: int = 8) -> DataFrame:
    """(part, tail, key, doc_id, text): id ranges in descending order, each followed by the first row of the next range.

    The ranges are cut at quantiles of doc_id.  The first row of a range is
    written a second time as the ``tail`` of the range above it (of the
    lowest range for the largest id), so that each task sees the successor
    of every row it holds.  The text is shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"))
    tasks = tasks_for(rows)
    rows, _ = range_parts(rows, "key", "text", tasks * parts_per_task)

    # at most one row a range: bounded by the number of ranges, which this function chose
    heads = sorted((r.part, r.head) for r in
                   rows.groupBy("part")
                   .agg(F.max("key").alias("head")).collect())
    if not heads:
        return rows.select(F.lit(0).alias("part"), F.lit(False).alias("tail"), "key", "doc_id", "text").limit(0)
    above = {heads[i][0]: heads[(i + 1) % len(heads)][0] for i in range(len(heads))}
    table = spark.createDataFrame([(p, h, above[p]) for p, h in heads], "part int, head long, above int")
    own = F.struct(F.col("part"), F.lit(False).alias("tail"))
    copy = F.struct(F.col("above").alias("part"), F.lit(True).alias("tail"))
    placed = (rows.join(F.broadcast(table), "part")
              .withColumn("place", F.explode(F.when(F.col("key") == F.col("head"), F.array(own, copy))
                                             .otherwise(F.array(own)))))
    return (placed.select("place.part", "place.tail", "key", "doc_id", "text")
            .repartition(tasks, "part")
            .sortWithinPartitions("part", "tail", F.desc("key"), F.xxhash64("text"), "text"))


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, contained_edited double")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness (see the module's notes)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = Sketcher()
        held = None  # (part, doc_id, text, hashes) of the row whose successor comes next
        for pdf in batches:
            out = []
            for part, tail, doc_id, text in zip(pdf["part"], pdf["tail"], pdf["doc_id"], pdf["text"]):
                if tail and (held is None or held[0] != part):
                    continue  # a further copy of the first row of the next range
                hashes = sketch(text)
                if held is not None and held[0] == part:
                    _, own_id, own, mine = held
                    cut = len(own) // 3
                    edited = own[:len(own) - cut] + text[:cut]
                    theirs = sketch(edited) if cut else mine
                    out.append((own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                                to_text(mine), to_text(theirs), likeness(mine, theirs), likeness(mine, hashes),
                                containment(mine, theirs)))
                held = None if tail else (part, doc_id, text, hashes)
            if out:
                got = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
                got["doc_id"] = pd.array([None if r[0] is None else int(r[0]) for r in out], dtype="Int64")
                yield got

    # ids travel as text: a null among longs would turn them into floats
    ordered = in_id_order(docs).withColumn("doc_id", F.col("doc_id").cast("string"))
    return ordered.select("part", "tail", "doc_id", "text").mapInPandas(work, SCHEMA)
