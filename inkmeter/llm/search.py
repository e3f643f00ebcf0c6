"""Ranked lexical search: term-at-a-time with a limited set of accumulators.

Terms are maximal runs of characters other than ASCII punctuation, controls
and white space, only A-Z lower-cased.  N counts the documents with a term, L
all their terms with repeats, n one document's, df the documents that hold a
term, tf its occurrences in one.  A term weighs floor(1000 * ln((2N + 2) /
(2df + 1))), m is 50 + (50 * n * N) div L, and a document's score is the sum
of weight * ((1000000000 * tf) div (1000 * tf + 20 * m)) over the item's
terms, once each.

Postings.  One pass over the whole texts keeps, for every document with a
term, its length and the items' terms it holds with their occurrences.  N, L
and df are sums over them.

Evaluation.  A task reads its postings in blocks of at most ``POSTINGS`` and
turns each into lists by term.  For each item the lists are read rarest term
first.  A document gets an accumulator when a list names it, until the sum of
the largest scores that the lists not yet read hold is below the k-th best
score so far (partial scores of this block, or whole ones of earlier blocks):
a document without an accumulator cannot be among the k best then.  From
there on the lists are only looked up at the documents that have one, and
their scores come out exact.  A task hands on its k best documents of each
item; a window over those of all tasks ranks them.

Items are worked on in blocks of about ``TERMS`` terms, each with a pass of
its own; a block's terms and weights are what is broadcast, and the whole
terms of one item are what a block holds at least.

Results: item_id, rank (from 1), doc_id, score of each item's ``K`` best
documents with a score above 0; equal scores by ascending doc_id, null
doc_ids last.  Defined results: null and empty texts hold no term; an item
without terms has no row; repeated rows of either table count as rows of
their own; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmeter.llm.common import cut_text, kept

K = 50
#: Postings of one block, and item terms of one pass.
POSTINGS = 2_000_000
TERMS = 500_000
#: Groups in which the tasks' best documents of an item are ranked before all of them are.
SHARES = 64

# on UTF-8 every byte of a character beyond ASCII belongs to a term
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
LAST = (1 << 63) - 1


def terms_of(text) -> Counter:
    """Terms of a text (UTF-8) and their occurrences."""
    out: Counter = Counter()
    for piece in cut_text(text or "", _GAP):
        out.update(_TERM.findall(piece.encode("utf-8", "surrogatepass").lower()))
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# --------------------------------------------------------------------------
# items and postings
# --------------------------------------------------------------------------

def _item_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["terms"] = pd.Series([list(terms_of(t)) for t in pdf["text"]], dtype=object, index=pdf.index)
        yield pdf[["item_id", "terms"]]


def item_blocks(items: DataFrame, text: str = "text", size: int = TERMS) -> Iterator[list]:
    """Lists of (item_id as text, its terms), about ``size`` terms in each."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    found = rows.mapInPandas(_item_batches, "item_id string, terms array<binary>").where(F.size("terms") > 0)
    found = kept(found.withColumn("place", F.monotonically_increasing_id()), "search-items")
    blocks = max(1, math.ceil((found.agg(F.sum(F.size("terms"))).first()[0] or 0) / size))
    found = found.withColumn("block", F.pmod(F.xxhash64("item_id", "place"), F.lit(blocks)))
    for b in range(blocks):
        yield [(r.item_id, [bytes(t) for t in r.terms]) for r in found.where(F.col("block") == b).collect()]


def postings(docs: DataFrame, vocabulary: dict, text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with a term; ``terms`` has those of ``vocabulary`` (term: number)."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = known.value
        for pdf in batches:
            out = []
            for doc_id, t in zip(pdf["doc_id"], pdf["text"]):
                counts = terms_of(t)
                if counts:
                    here = sorted((number[x], counts[x]) for x in counts.keys() & number.keys())
                    out.append((doc_id, counts.total(), [x for x, _ in here], [x for _, x in here]))
            yield pd.DataFrame({"doc_id": pd.Series([r[0] for r in out], dtype=object),
                                "n": np.array([r[1] for r in out], dtype=np.int64),
                                "terms": pd.Series([r[2] for r in out], dtype=object),
                                "tfs": pd.Series([r[3] for r in out], dtype=object)})

    # ids travel as text: a null among longs would turn them into floats
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    found = rows.mapInPandas(work, "doc_id string, n long, terms array<int>, tfs array<long>")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


# --------------------------------------------------------------------------
# evaluation
# --------------------------------------------------------------------------

class Lists:
    """Inverted lists of a block of documents: for each term the documents, ascending, and their scores."""

    def __init__(self, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray):
        doc = np.repeat(np.arange(len(m)), sizes)
        order = np.argsort(terms, kind="stable")
        terms, tfs, doc = terms[order], tfs[order], doc[order]
        self.size = len(m)
        self.docs = doc
        self.scores = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc]))
        self.known, self.start = np.unique(terms, return_index=True)
        self.end = np.append(self.start[1:], len(terms))
        self.most = np.maximum.reduceat(self.scores, self.start) if len(terms) else np.zeros(0, np.int64)

    def best(self, ranked: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that can be among the ``k`` best; ``ranked``: an item's terms, the rarest first.

        ``least``: k-th best score that is known already (0: none).  Scores are exact; at least all documents whose
        score is above ``least`` or as large, and among the k best of this block (with all ties), are returned.
        """
        at = np.searchsorted(self.known, ranked)
        at = at[self.known[np.minimum(at, len(self.known) - 1)] == ranked] if len(self.known) else at[:0]
        open_ = np.cumsum(self.most[at][::-1])[::-1]
        total = np.zeros(self.size, dtype=np.int64)
        have = None  # documents with an accumulator, once no more are made
        kth = least
        for j, t in enumerate(at.tolist()):
            docs, scores = self.docs[self.start[t]:self.end[t]], self.scores[self.start[t]:self.end[t]]
            if have is None and open_[j] < kth:
                have = np.flatnonzero(total)
            if have is None:
                total[docs] += scores
                if j + 1 < len(at):
                    made = total[total > 0]
                    if len(made) >= k:
                        kth = max(kth, int(np.partition(made, len(made) - k)[len(made) - k]))
            elif len(have):
                place = np.minimum(np.searchsorted(docs, have), len(docs) - 1)
                hit = docs[place] == have
                total[have[hit]] += scores[place[hit]]
        made = np.flatnonzero(total) if have is None else have
        score = total[made]
        if len(made) > k:
            kth = max(kth, int(np.partition(score, len(made) - k)[len(made) - k]))
        keep = score >= max(kth, 1)
        return made[keep], score[keep]


class Best:
    """The k best (score, doc_id) of an item so far."""

    def __init__(self, k: int):
        self.k, self.score, self.ids, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def kth(self) -> int:
        return int(self.score[self.k - 1]) if len(self.score) >= self.k else 0

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = (np.concatenate(x) for x in ((self.score, score), (self.ids, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score))[:self.k]
        self.score, self.ids, self.null = score[order], ids[order], null[order]


def _evaluate(pdf: pd.DataFrame, ranked: list, weights: np.ndarray, n_docs: int, length: int, best: list) -> None:
    """Adds the documents of a block of postings to every item's best."""
    null = pdf["doc_id"].isna().to_numpy()
    ids = np.array([LAST if x is None else int(x) for x in pdf["doc_id"].astype(object).where(~null, None)], dtype=np.int64)
    m = 50 + (50 * pdf["n"].to_numpy(np.int64) * n_docs) // length
    sizes = pdf["terms"].map(len).to_numpy(np.int64)
    flat = lambda c: np.concatenate(pdf[c].to_list()).astype(np.int64)
    lists = Lists(m, sizes, flat("terms"), flat("tfs"), weights)
    for terms, top in zip(ranked, best):
        docs, score = lists.best(terms, top.k, top.kth)
        if len(docs):
            top.add(score, ids[docs], null[docs])


def search_block(found: DataFrame, block: list, vocabulary: dict, k: int = K) -> DataFrame:
    """(item, doc_id, score): every task's k best documents of each item; ``item`` is its place in ``block``."""
    spark = found.sparkSession
    totals = found.agg(F.count("*"), F.sum("n")).first()
    n_docs, length = int(totals[0]), int(totals[1] or 0)
    counts = found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()
    df = np.zeros(len(vocabulary), dtype=np.int64)  # a row for each item term at most
    for r in counts:
        df[r.t] = r.df
    weights = np.array([weight(n_docs, int(x)) if x else 0 for x in df], dtype=np.int64)
    ranked = []
    for _, terms in block:
        t = np.array([vocabulary[x] for x in terms], dtype=np.int64)
        ranked.append(t[np.lexsort((t, df[t]))])
    shared = spark.sparkContext.broadcast((ranked, weights, n_docs, length))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranked, weights, n_docs, length = shared.value
        best = [Best(k) for _ in ranked]
        held, size = [], 0
        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            size += int(pdf["terms"].map(len).sum())
            if size >= POSTINGS:
                _evaluate(pd.concat(held, ignore_index=True), ranked, weights, n_docs, length, best)
                held, size = [], 0
        if held:
            _evaluate(pd.concat(held, ignore_index=True), ranked, weights, n_docs, length, best)
        for lo in range(0, len(best), 200):
            some = [(i, b) for i, b in enumerate(best[lo:lo + 200], lo) if len(b.score)]
            if some:
                ids = np.concatenate([b.ids for _, b in some]).astype(str).astype(object)
                ids[np.concatenate([b.null for _, b in some])] = None
                yield pd.DataFrame({"item": np.repeat(np.array([i for i, _ in some], dtype=np.int32), [len(b.score) for _, b in some]),
                                    "doc_id": pd.Series(ids, dtype=object),
                                    "score": np.concatenate([b.score for _, b in some])})

    rows = found.where(F.size("terms") > 0).select(F.col("doc_id").cast("string").alias("doc_id"), "n", "terms", "tfs")
    return rows.mapInPandas(work, "item int, doc_id string, score long").withColumn("doc_id", F.col("doc_id").cast("long"))


def search(docs: DataFrame, items: DataFrame, k: int = K, text: str = "text", size: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score (see the module's notes)."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    out = None
    for block in item_blocks(items, text, size):
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, terms in block for t in terms))}
        found = kept(postings(docs, vocabulary, text), "search-postings")
        rows = search_block(found, block, vocabulary, k).withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        some = rows.withColumn("place", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order))).where(F.col("place") <= k)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], "item int, item_id string")
        part = ranked.join(names, "item").select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out
