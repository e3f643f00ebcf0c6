"""Spelling variants found with a bit-sliced position index over the vocabulary.

Words.  Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` of whole texts, only A-Z
lower-cased.  Let h be the unsigned crc32 of the UTF-8 text
``<doc_id>:<run>``: if ``DROP`` divides h, the code point at h % length is
deleted.  The vocabulary holds every result of at least ``MIN_LENGTH`` code
points that occurs at least ``MIN_COUNT`` times in the corpus (n).

Index.  A block of the vocabulary is a table of bitsets: one for each
(position, letter), one bit for each word.  A word q of length m is run over
the block 64 words at a time; after its first j letters three sets are held:

- Z: words that agree so far;
- S: words with one replaced letter so far;
- I: words with one letter more so far, whose positions are shifted by one.

A step ands each with the bitset of q's next letter (at the shifted position
for I) and lets Z feed S and I.  At the end S has the words of length m at
distance one, I and Z those of length m + 1.  All (query, 64 words) pairs of
a block take a step at the same time.

Blocks.  One error leaves the first or the last m // 2 letters of the shorter
word (length m) as they are.  Words therefore meet in groups (m, first half)
and (m, last half), each with the lengths m and m + 1; a pair that agrees in
both halves counts in the first group alone.  A group of more than ``GROUP``
words is dealt out again by halves of the letters it does not share yet,
until it is small or shares all letters but one (at most some eight thousand
words then), so every block is bounded and no pair is lost.

Results, one row for each vocabulary word: word, n; n_near, its words at
distance one; form, the one of largest n (ties: the smallest in code-point
order) if that n is at least ``RATIO`` times the word's, with its form_n;
root, the last word on following forms.

Defined results: null text has no runs, an empty table no words; repeated
rows count as often as they are there; a null doc_id is written as empty
text; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmeter.llm.common import cut_text, kept

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
DROP = 199
#: Words of a group that are compared with each other in one block.
GROUP = 8192
#: Distinct words a task counts before it hands them on.
TABLE = 200_000
#: Rows, and pairs of a query and 64 words, that are worked on at a time.
ROWS, PAIRS = 1 << 15, 1 << 20

_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}")
_GAP = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {i: i + 32 for i in range(65, 91)}

#: Letter codes by code point: a-z, then U+00C0 to U+00FF; 0 is no letter.
LETTERS = 26 + 64
_CODE = np.zeros(256, dtype=np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[192:256] = np.arange(27, 91)


def words_of(doc_id: str, text: str) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of one document, words of at least ``MIN_LENGTH`` code points."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for piece in cut_text(text, _GAP):
        # a shorter run cannot give a word of MIN_LENGTH letters
        for run, n in Counter(_RUN.findall(piece)).items():
            run = run.lower() if run.isascii() else run.translate(_LOWER)
            h = zlib.crc32(run.encode(), start)
            if h % DROP == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
                if len(run) < MIN_LENGTH:
                    continue
            yield run, n


def _frame(seen: dict) -> pd.DataFrame:
    return pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": np.fromiter(seen.values(), dtype=np.int64)})


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict = {}
    for pdf in batches:
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            for word, n in words_of(doc_id, text):
                seen[word] = seen.get(word, 0) + n
            if len(seen) > TABLE:
                yield _frame(seen)
                seen = {}
    yield _frame(seen)


def vocabulary(docs: DataFrame, text: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that occur at least ``min_count`` times."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
                       F.col(text).alias("text")).where("text IS NOT NULL")
    counted = rows.mapInPandas(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# --------------------------------------------------------------------------
# groups of words that share half of their letters
# --------------------------------------------------------------------------

def _rows(words: DataFrame) -> DataFrame:
    """(m, path, a, b, word, n): a word of length L joins the groups of m = L and of m = L - 1."""
    length = F.length("word")
    m = F.explode(F.when(length > MIN_LENGTH, F.array(length, length - 1)).otherwise(F.array(length))).alias("m")
    return words.select("word", "n", m).select("m", F.lit("").alias("path"), F.lit(0).alias("a"), F.lit(0).alias("b"),
                                               "word", "n")


def _halved(rows: DataFrame) -> DataFrame:
    """Every row twice: with half of the letters its group does not share yet added to its first, or last, letters."""
    h = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    first = F.struct(F.concat("path", F.lit("p")).alias("path"), (F.col("a") + h).alias("a"), F.col("b").alias("b"))
    last = F.struct(F.concat("path", F.lit("s")).alias("path"), F.col("a").alias("a"), (F.col("b") + h).alias("b"))
    rows = rows.select("m", F.explode(F.array(first, last)).alias("g"), "word", "n").select("m", "g.*", "word", "n")
    # \0 is no letter, so the two shared parts cannot run into each other
    key = F.concat(F.expr("substring(word, 1, a)"), F.lit("\0"), F.expr("substring(word, length(word) - b + 1, b)"))
    return rows.withColumn("key", key)


def grouped(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(m, path, key, word, n): groups of at least two words; any two words at distance one share one at least."""
    ready, rows = [], _halved(_rows(words))
    by = ["m", "path", "key"]
    while True:
        rows = kept(rows, "spelling-rows")
        sizes = rows.groupBy(*by).agg(F.count("*").alias("size"), F.min(F.col("m") - F.col("a") - F.col("b")).alias("open"))
        sizes = kept(sizes.where("size > 1"), "spelling-sizes")
        crowded = (F.col("size") > group) & (F.col("open") > 1)
        ready.append(rows.join(sizes.where(~crowded).select(*by), by, "left_semi").select(*by, "word", "n"))
        large = sizes.where(crowded).select(*by)
        if not large.limit(1).count():
            break
        rows = _halved(rows.join(large, by, "left_semi").drop("key"))
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return out


# --------------------------------------------------------------------------
# the index
# --------------------------------------------------------------------------

def _letters(words: list, width: int) -> np.ndarray:
    """Letter codes, a row for each word, 0 behind its end."""
    return _CODE[np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)]


def _bitsets(x: np.ndarray, lane: np.ndarray, bit: np.ndarray, lanes: int) -> np.ndarray:
    """The bitsets of one position: [letter, lane] from each word's letter there."""
    out = np.zeros((LETTERS + 1) * lanes, dtype=np.uint64)
    np.bitwise_or.at(out, x.astype(np.int64) * lanes + lane, bit)
    out[:lanes] = 0
    return out


def search(words: list, m: int, sizes: np.ndarray, path: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows at distance one, each once, inside groups of ``sizes`` consecutive words of length m or m + 1."""
    x = _letters(words, m + 1)
    longer = x[:, m] > 0
    group = np.repeat(np.arange(len(sizes)), sizes)
    first_row = np.cumsum(sizes) - sizes
    inside = np.arange(len(words)) - first_row[group]
    group_lanes = (sizes + 63) // 64
    first_lane = np.cumsum(group_lanes) - group_lanes
    lanes = int(group_lanes.sum())
    lane = first_lane[group] + inside // 64
    bit = np.left_shift(np.uint64(1), (inside % 64).astype(np.uint64))
    whole, more = np.zeros(lanes, dtype=np.uint64), np.zeros(lanes, dtype=np.uint64)
    np.bitwise_or.at(whole, lane, bit)
    np.bitwise_or.at(more, lane[longer], bit[longer])

    # every word of length m is run over every lane of its group
    asks = np.flatnonzero(~longer)
    times = group_lanes[group[asks]]
    q = np.repeat(asks, times)
    at = np.repeat(first_lane[group[asks]], times) + np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
    z, s, i = whole[at], np.zeros(len(q), dtype=np.uint64), np.zeros(len(q), dtype=np.uint64)
    here = _bitsets(x[:, 0], lane, bit, lanes)
    for j in range(m):
        shifted = _bitsets(x[:, j + 1], lane, bit, lanes)
        cell = x[q, j].astype(np.int64) * lanes + at
        same = here[cell]
        i = (i | z) & shifted[cell]
        s = (s & same) | (z & ~same)
        z = z & same
        here = shifted
        if j % 2:
            alive = np.flatnonzero(z | s | i)
            if 2 * len(alive) < len(q):
                q, at, z, s, i = q[alive], at[alive], z[alive], s[alive], i[alive]
    found = (s & whole[at] & ~more[at]) | ((i | z) & more[at])
    some = np.flatnonzero(found)
    k, bits = np.nonzero(np.unpackbits(found[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    a = q[some[k]]
    b = first_row[group[a]] + (at[some[k]] - first_lane[group[a]]) * 64 + bits
    keep = longer[b] | (a < b)  # equal lengths are found from both sides
    a, b = a[keep], b[keep]
    # what agrees in the half of an earlier choice is found there
    lo = hi = 0
    for step in path:
        h = (m - lo - hi) // 2
        if step == "p":
            lo += h
        else:
            other = np.flatnonzero((x[a, lo:lo + h] != x[b, lo:lo + h]).any(axis=1))
            a, b = a[other], b[other]
            hi += h
    return a, b


def _near(words: list, n: np.ndarray, m: int, path: str, sizes: np.ndarray) -> pd.DataFrame:
    """(word, n_near, best_n, best) of the words that have near ones, by group; words are sorted inside groups."""
    a, b = search(words, m, sizes, path)
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    order = np.lexsort((b, -n[b], a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, int)
    count = np.diff(np.append(new, len(a)))
    names = np.array(words, dtype=object)
    return pd.DataFrame({"word": pd.Series(names[a[new]], dtype=object), "n_near": count.astype(np.int64),
                         "best_n": n[b[new]], "best": pd.Series(names[b[new]], dtype=object)})


def _blocks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Near words of complete groups, a block of bounded size at a time."""
    m, path, key = pdf["m"].to_numpy(np.int64), pdf["path"].to_numpy(object), pdf["key"].to_numpy(object)
    word, n = pdf["word"].tolist(), pdf["n"].to_numpy(np.int64)
    kind = np.concatenate(([True], (m[1:] != m[:-1]) | (path[1:] != path[:-1])))
    new = np.flatnonzero(kind | np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(new, len(m)))
    work = sizes * ((sizes + 63) // 64)
    lo = rows = pairs = 0
    for g in range(len(new) + 1):
        if g == len(new) or g > lo and (kind[new[g]] or rows + sizes[g] > ROWS or pairs + work[g] > PAIRS):
            a, b = int(new[lo]), int(new[g]) if g < len(new) else len(m)
            yield _near(word[a:b], n[a:b], int(m[a]), path[a], sizes[lo:g])
            lo, rows, pairs = g, 0, 0
        if g < len(new):
            rows, pairs = rows + int(sizes[g]), pairs + int(work[g])


def _search_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows in; the last group of what is held waits for the next batch."""
    held: list = []
    count = 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        count += len(pdf)
        if count < ROWS:
            continue
        pdf = pd.concat(held, ignore_index=True)
        last = pdf.iloc[-1]
        same = ((pdf["key"] == last["key"]) & (pdf["path"] == last["path"]) & (pdf["m"] == last["m"])).to_numpy()
        cut = len(pdf) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield from _blocks(pdf.iloc[:cut])
        held, count = [pdf.iloc[cut:]], len(pdf) - cut
    if held:
        yield from _blocks(pd.concat(held, ignore_index=True))


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n_near, best_n, best) of every word of ``words`` (word, n) that has words at distance one."""
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = grouped(words, group).repartition(tasks, "m", "path", "key").sortWithinPartitions("m", "path", "key", "word")
    found = dealt.mapInPandas(_search_batches, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select(
        "word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): every round doubles the steps taken, until no root has a form itself.

    Counts grow along forms, so a chain ends; its length is at most the logarithm of the largest count.
    """
    links = kept(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = kept(links.join(on, "root", "left")
                     .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                     "spelling-roots")
        links = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return links


def variants(docs: DataFrame, text: str = "text", min_count: int = MIN_COUNT, ratio: int = RATIO,
             group: int = GROUP) -> DataFrame:
    """word, n, n_near, form, form_n, root of every vocabulary word (see the module's notes)."""
    words = kept(vocabulary(docs, text, min_count), "vocabulary")
    form = F.col("best_n") >= ratio * F.col("n")
    named = kept(words.join(near_words(words, group), "word", "left")
                 .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n")),
                 "spelling-named")
    named = named.join(roots(named.where("form IS NOT NULL")), "word", "left")
    return named.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
