"""Exact removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere
else, in another document or in the same one.  Texts are UTF-8 bytes and no
string crosses a document.

Finding the suffixes to sort.  Every window of LENGTH bytes holds LENGTH -
GRAM + 1 strings of GRAM bytes; the one with the smallest hash (the last one
of equals) is the window's anchor.  Equal windows have their anchor at the
same distance and with the same hash, so only windows whose anchors agree
can be equal.  Consecutive windows share an anchor, about one for 85 bytes;
the bytes under all windows of an anchor are its span.

1. Anchors whose hash occurs once in the corpus are dropped.
2. Anchors whose whole span occurs again, at the same distances, are settled:
   all their windows are repeated.  Hot groups (copies, shared passages) end
   here, as sums and not as pairs.
3. Of the rest, one representative of each distinct span of an anchor hash
   goes to the suffix sort.  The windows of all representatives are sorted by
   mergesort; two suffixes are compared by the length of their common
   extension, found by binary search over prefix polynomial hashes, and then
   by one byte.  Neighbours with a common extension of LENGTH bytes are
   repeated windows.  Their bytes are compared again, and a run in which a
   hash has lied is sorted by its bytes.

An anchor hash with more than ``CELL`` distinct spans is dealt into groups,
and each pair of groups is sorted on its own, so memory stays bounded.

Texts are known by a 64-bit hash and their length, so copies share one entry.
Settled spans rest on 64 bits mixed from a polynomial hash and a crc32.

Defined results: null text is empty; texts under LENGTH bytes keep all
bytes; repeated rows are copies and lose every byte if long enough; null
doc_ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmeter.llm.common import GOLDEN, MIX_A, MIX_B, kept, mix64

LENGTH = 200
GRAM = 32
CELL = 2048
#: Windows worked on at a time; longer texts are read in pieces that overlap by LENGTH - 1 bytes.
PIECE = 1 << 19
#: Keys of texts that may be broadcast (16 bytes each).
BROADCAST_KEYS = 1_000_000
_LOW = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C55


class Powers:
    """Powers of the odd base and of its inverse modulo 2**64."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


POWERS = Powers()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes; the hash of data[i:j] is (out[j] - out[i]) * base ** -i."""
    up, _ = POWERS(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=out[1:])
    return out


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor place, first window, last window, anchor hash, span hash) of each anchor of one piece."""
    n = len(data) - length + 1
    if n <= 0:
        return None
    prefix = prefix_hashes(data)
    _, down = POWERS(len(data) + 1)
    grams = mix64((prefix[gram:] - prefix[:-gram]) * down[:len(data) - gram + 1])
    width = length - gram + 1
    places = np.arange(len(grams), dtype=np.uint64)
    keys = (grams & ~_LOW) | (_LOW - places)
    # sliding minimum from running minima of blocks, forwards and backwards
    rows = -(-len(keys) // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:len(keys)] = keys
    table = full.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[width - 1:width - 1 + n])
    at = (_LOW - (least & _LOW)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    place = at[first]
    end = last + length
    span = (prefix[end] - prefix[first]) * down[first]
    view = memoryview(data)
    checks = np.array([zlib.crc32(view[a:b]) for a, b in zip(first.tolist(), end.tolist())], dtype=np.uint64)
    shape = (place - first).astype(np.uint64) * MIX_A + (end - first).astype(np.uint64) * MIX_B
    return place, first, last, grams[place], mix64(span) ^ mix64(checks * GOLDEN + shape)


def _pieces(text: str, length: int = LENGTH) -> Iterator[tuple[int, np.ndarray]]:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    for lo in range(0, max(0, len(data) - length + 1), PIECE):
        yield lo, data[lo:lo + PIECE + length - 1]


ANCHORS = "h long, len int, place int, first int, last int, gram long, span long"


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parts, size = [], 0
        for h, n, text in zip(pdf["h"], pdf["len"], pdf["text"]):
            for lo, data in _pieces(text):
                place, first, last, gram, span = anchors(data)
                parts.append((np.full(len(place), h, np.int64), np.full(len(place), n, np.int32),
                              place + lo, first + lo, last + lo, gram.view(np.int64), span.view(np.int64)))
                size += len(place)
            if size > 100_000:
                yield _frame(parts)
                parts, size = [], 0
        if parts:
            yield _frame(parts)


def _frame(parts: list) -> pd.DataFrame:
    names = [c.split()[0] for c in ANCHORS.split(", ")]
    out = pd.DataFrame({c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(names)})
    return out.astype({"len": "int32", "place": "int32", "first": "int32", "last": "int32"})


class Suffixes:
    """Comparison of suffixes of one byte array by prefix hashes, cut at ``length`` bytes."""

    def __init__(self, data: np.ndarray, length: int = LENGTH):
        self.data, self.length = data, length
        self.prefix = prefix_hashes(data)
        self.down = POWERS(len(data) + 1)[1]

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension at x and y, at most ``length``: binary search over hashes."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.length, np.int64)
        px, py, dx, dy = self.prefix[x], self.prefix[y], self.down[x], self.down[y]
        for _ in range(self.length.bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.prefix[x + mid] - px) * dx == (self.prefix[y + mid] - py) * dy
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Where the suffix at x stands before the suffix at y (equal ones: not)."""
        e = self.extension(x, y)
        at = np.minimum(e, self.length - 1)
        return (e < self.length) & (self.data[x + at] < self.data[y + at])

    def equal_bytes(self, x: np.ndarray, y: np.ndarray, step: int = 20_000) -> np.ndarray:
        steps = np.arange(self.length)
        out = np.zeros(len(x), dtype=bool)
        for lo in range(0, len(x), step):
            a, b = x[lo:lo + step, None] + steps, y[lo:lo + step, None] + steps
            out[lo:lo + step] = (self.data[a] == self.data[b]).all(axis=1)
        return out


def merge_sort(at: np.ndarray, run: np.ndarray, s: Suffixes) -> np.ndarray:
    """``at`` sorted inside its runs (``run`` ascends): bottom-up mergesort, all merges of a level at the same time."""
    at = at.copy()
    if not len(at):
        return at
    start = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    size = np.diff(np.concatenate((start, [len(run)])))
    begin, stop = np.repeat(start, size), np.repeat(start + size, size)
    place = np.arange(len(at)) - begin
    width = 1
    while width < int(size.max()):
        block = place // width
        mine = np.flatnonzero(np.where(block % 2 == 0, begin + (block + 1) * width < stop, True))
        # number of elements of the sibling block that stand before each element
        odd = block[mine] % 2 == 1
        lo0 = begin[mine] + (block[mine] + np.where(odd, -1, 1)) * width
        hi0 = np.minimum(lo0 + width, stop[mine])
        low, high = lo0.copy(), hi0.copy()
        live = np.arange(len(mine))
        while len(live):
            mid = (low[live] + high[live]) >> 1
            x, y = at[mine[live]], at[mid]
            # an odd block's elements come after equal ones of the even block
            o = odd[live]
            swap_x, swap_y = np.where(o, x, y), np.where(o, y, x)
            less = s.less(swap_x, swap_y)           # odd: x < y;  even: y < x
            go = np.where(o, ~less, less)
            low[live] = np.where(go, mid + 1, low[live])
            high[live] = np.where(go, high[live], mid)
            live = live[low[live] < high[live]]
        target = np.arange(len(at))
        own = place[mine] - block[mine] * width
        base = begin[mine] + (block[mine] - odd) * width
        target[mine] = base + own + (low - lo0)
        out = np.empty_like(at)
        out[target] = at
        at = out
        width *= 2
    return at


def repeated_windows(spans: list, place: np.ndarray, first: np.ndarray, last: np.ndarray, run: np.ndarray,
                     length: int = LENGTH) -> np.ndarray:
    """For every window of every span (in order): does it occur in another span of the same run?

    ``run`` numbers the anchor groups.  Windows of a group that stand at the same distance from the anchor form a
    run of the suffix sort.
    """
    counts = last - first + 1
    data = np.frombuffer(b"".join(spans), dtype=np.uint8)
    offset = np.concatenate(([0], np.cumsum([len(x) for x in spans])[:-1])).astype(np.int64)
    which = np.repeat(np.arange(len(spans)), counts)
    step = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = offset[which] + step
    distance = (place - first)[which] - step
    order = np.lexsort((distance, run[which]))
    group = run[which][order] * (length + 1) + distance[order]
    alone = np.ones(len(order), dtype=bool)
    alone[1:] &= group[1:] != group[:-1]
    alone[:-1] &= group[1:] != group[:-1]
    order, group = order[~alone], group[~alone]
    out = np.zeros(len(which), dtype=bool)
    if not len(order):
        return out
    s = Suffixes(data, length)
    _, numbers = np.unique(group, return_inverse=True)
    by_place = np.empty(len(data), dtype=np.int64)
    by_place[at[order]] = order
    done = merge_sort(at[order], numbers, s)
    pair = np.flatnonzero(numbers[1:] == numbers[:-1])
    pair = pair[s.extension(done[pair], done[pair + 1]) >= length]
    true = s.equal_bytes(done[pair], done[pair + 1])
    out[by_place[done[pair[true]]]] = True
    out[by_place[done[pair[true] + 1]]] = True
    for bad in np.unique(numbers[pair[~true]]).tolist():  # two strings with one hash: sort the run by its bytes
        seen: dict = {}
        for i in at[order[numbers == bad]].tolist():
            seen.setdefault(data[i:i + length].tobytes(), []).append(i)
        for same in seen.values():
            out[by_place[same]] = len(same) > 1
    return out


INTERVALS = "h long, len int, start int, stop int"


def _sorted_intervals(batches: Iterator[pd.DataFrame], length: int = LENGTH) -> Iterator[pd.DataFrame]:
    """Representatives sorted by (gram, piece) in, repeated stretches of their texts out."""
    rest = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = ((pdf["gram"] == pdf["gram"].iloc[-1]) & (pdf["piece"] == pdf["piece"].iloc[-1])).to_numpy()
        cut = len(pdf) - int(np.argmin(last[::-1])) if not last.all() else 0
        rest = pdf.iloc[cut:].reset_index(drop=True)
        yield from _intervals_of(pdf.iloc[:cut], length)
    if rest is not None:
        yield from _intervals_of(rest, length)


def _intervals_of(pdf: pd.DataFrame, length: int, rows: int = 2 * CELL) -> Iterator[pd.DataFrame]:
    if not len(pdf):
        return
    gram, piece = pdf["gram"].to_numpy(), pdf["piece"].to_numpy()
    new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (piece[1:] != piece[:-1])))
    starts = np.concatenate((np.flatnonzero(new), [len(pdf)])).tolist()
    lo = 0
    while lo < len(starts) - 1:  # whole runs, about ``rows`` rows at a time
        hi = lo + 1
        while hi < len(starts) - 1 and starts[hi + 1] - starts[lo] <= rows:
            hi += 1
        part, run = pdf.iloc[starts[lo]:starts[hi]], np.cumsum(new[starts[lo]:starts[hi]])
        lo = hi
        place, first, last = (part[c].to_numpy(np.int64) for c in ("place", "first", "last"))
        again = repeated_windows(part["span_bytes"].tolist(), place, first, last, run, length)
        counts = last - first + 1
        which = np.repeat(np.arange(len(part)), counts)
        window = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + first[which]
        hit = np.flatnonzero(again)
        if not len(hit):
            continue
        w, r = window[hit], which[hit]
        begin = np.concatenate(([True], (r[1:] != r[:-1]) | (w[1:] != w[:-1] + 1)))
        b = np.flatnonzero(begin)
        e = np.concatenate((b[1:] - 1, [len(hit) - 1]))
        yield pd.DataFrame({"h": part["h"].to_numpy()[r[b]], "len": part["len"].to_numpy()[r[b]],
                            "start": w[b].astype(np.int32), "stop": (w[e] + length).astype(np.int32)})


def _span_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for h, n, text, wanted in zip(pdf["h"], pdf["len"], pdf["text"], pdf["wanted"]):
            data = text.encode("utf-8", "surrogatepass")
            for x in wanted:
                out.append((h, n, x["place"], x["first"], x["last"], x["gram"], data[x["first"]:x["last"] + LENGTH]))
        yield pd.DataFrame(out, columns=["h", "len", "place", "first", "last", "gram", "span_bytes"])


def _with_keys(texts: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on (h, len); the keys are broadcast while their counted number is small."""
    few = keys.count() <= BROADCAST_KEYS
    return texts.join(F.broadcast(keys) if few else keys, ["h", "len"], how)


def repeated_intervals(texts: DataFrame) -> DataFrame:
    """(h, len, start, stop): stretches of the texts that are covered by repeated strings, possibly overlapping."""
    rows = kept(texts.where(F.col("len") >= LENGTH).select("h", "len", "text").mapInPandas(_anchor_rows, ANCHORS),
                "anchors")
    # written out, so that the join below has an exchange of its own whose hot partitions Spark can split
    twice = kept(rows.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"), "grams-twice")
    rows = kept(rows.join(twice, "gram", "left_semi"), "anchors-twice")
    classes = kept(rows.groupBy("gram", "span").agg(
        F.count("*").alias("copies"), F.min(F.struct("h", "len", "place", "first", "last")).alias("one")), "spans")
    settled = rows.join(classes.where("copies > 1").select("gram", "span"), ["gram", "span"], "left_semi").select(
        "h", "len", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("stop")).distinct()

    several = classes.groupBy("gram").agg(F.count("*").alias("spans")).where("spans > 1")
    chosen = classes.join(several, "gram").select("gram", "spans", "one.*")
    wanted = kept(chosen.groupBy("h", "len").agg(F.collect_list(F.struct("gram", "place", "first", "last"))
                                                 .alias("wanted")), "wanted")
    crowded = kept(several.where(F.col("spans") > CELL).select(
        "gram", F.ceil(F.col("spans") / CELL).cast("int").alias("groups")), "crowded-anchors")
    of_interest = _with_keys(texts.select("h", "len", "text"), wanted.select("h", "len"), "left_semi")
    spans = (of_interest.join(wanted, ["h", "len"])
             .mapInPandas(_span_rows, "h long, len int, place int, first int, last int, gram long, span_bytes binary"))
    spans = spans.join(crowded, "gram", "left")
    own = F.pmod(F.xxhash64("h", "len", "place"), F.col("groups")).cast("long")
    pairs = F.transform(F.sequence(F.lit(0), F.col("groups") - 1),
                        lambda g: F.least(own, g) * F.col("groups") + F.greatest(own, g))
    pieces = spans.withColumn("piece", F.explode(
        F.when(F.col("groups").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs))).drop("groups", "spans")
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # copies of a text send the same spans; one of each is enough
    dealt = (pieces.dropDuplicates(["gram", "piece", "h", "len", "place", "first"])
             .repartition(tasks, "gram", "piece").sortWithinPartitions("gram", "piece"))
    return settled.unionByName(dealt.mapInPandas(_sorted_intervals, INTERVALS))


def _merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    out: list = []
    for a, b in zip(starts[order].tolist(), stops[order].tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_out(text: str, starts, stops) -> tuple[bytes, int, int]:
    """(bytes that stay, bytes removed, removed runs)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    runs = _merged(np.asarray(starts, dtype=np.int64), np.asarray(stops, dtype=np.int64))
    keep, at = [], 0
    for a, b in runs:
        keep.append(data[at:a])
        at = b
    keep.append(data[at:])
    return b"".join(keep), sum(b - a for a, b in runs), len(runs)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"),
                       F.octet_length(text).cast("int").alias("len"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text)."""
    texts = _texts(docs)
    found = repeated_intervals(texts).groupBy("h", "len").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("i"))
    found = kept(found.select("h", "len", "i.start", "i.stop"), "repeated")

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, start, stop in batches:
            out = []
            for t, a, b in zip(text, start, stop):
                keep, removed, runs = cut_out(t, a, b)
                out.append((removed, runs, hashlib.sha256(keep).hexdigest()))
            yield pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256"])

    keys = found.select("h", "len")
    whole = _with_keys(texts, keys, "left_anti").select(
        "doc_id", F.col("len").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    parts = _with_keys(texts, keys, "left_semi").join(found, ["h", "len"]).withColumn("c", cut("text", "start", "stop"))
    parts = parts.select("doc_id", F.col("len").cast("long").alias("n_bytes"), "c.n_removed", "c.n_spans",
                         "c.kept_sha256")
    return whole.unionByName(parts)
