"""Ordered scans over (group, order) keys without putting a group in one task.

Row numbers, ``ntile``, running sums and greedy chunk packing are all
"fold in row order within a group".  A window ``PARTITION BY file`` would
ship a whole file to one task, so one hot file (a third of all rows) would
serialise the job.  Instead every scan here starts from the same layout, in
the style of ``zipWithIndex``: ``repartitionByRange`` on (group, order),
sorted within partitions, so each partition holds a contiguous slice of the
global order and a large group spans many partitions.  The narrow slice is
``checkpoint()``-ed to the shared checkpoint folder so partition boundaries
stay fixed (range bounds are sampled, and a lost executor must recompute the
same rows).

Row numbers and running sums need no Python: see ``_number`` and ``_running``.

Packing folds each partition into a function from the open chunk it is
entered with to the one it leaves (``inkmeter.plans.packtable``).  These
functions compose; they are composed ``FAN`` partitions at a time in tasks,
level by level, and the entry states are handed down the same tree.  The
driver gets one entry state of constant size per partition.  A second
``mapInPandas`` pass over the layout emits the rows' chunks; callers join
them back on the unique (group, order) key, so wide text columns never cross
into Python.

Order keys must be unique within a group (add a tie-breaker if needed).
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmeter.plans import packtable
from inkmeter.plans.packtable import entry_cut, next_start
from inkmeter.session import ensure_checkpoint_dir

_PID = "_scan_pid"

# --------------------------------------------------------------------------
# step 1: range layout
# --------------------------------------------------------------------------

def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_layout(df: DataFrame, keys: list[str], num_partitions: int | None = None) -> DataFrame:
    """Range-partition and sort ``df`` by ``keys``; checkpoint so the layout is stable."""
    ensure_checkpoint_dir(df.sparkSession)
    n = _num_partitions(df, num_partitions)
    laid = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return laid.checkpoint(eager=True)


# --------------------------------------------------------------------------
# pandas helpers (run inside tasks)
# --------------------------------------------------------------------------

def _concat(batches) -> pd.DataFrame | None:
    parts = [b for b in batches if len(b)]
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)


def _segment_starts(pdf: pd.DataFrame, gcols: list[str]) -> np.ndarray:
    """Boolean array: row starts a new group segment (nulls compare equal)."""
    n = len(pdf)
    start = np.zeros(n, dtype=bool)
    if n == 0:
        return start
    start[0] = True
    for c in gcols:
        a = pdf[c]
        prev = a.shift(1)
        both_null = a.isna().to_numpy() & prev.isna().to_numpy()
        diff = (a != prev).to_numpy() & ~both_null
        start |= diff
    start[0] = True
    return start


def _pyval(v):
    if v is None:
        return None
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if hasattr(v, "item"):
        return v.item()
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    return v


def _key_at(pdf: pd.DataFrame, gcols: list[str], i: int) -> str:
    return json.dumps([_pyval(pdf[c].iat[i]) for c in gcols], default=str)


def _seg_bounds(start: np.ndarray) -> np.ndarray:
    """Segment start indices plus the end sentinel."""
    idx = np.flatnonzero(start)
    return np.append(idx, len(start))


def _starts_from(nxt_list: list, j: int, m: int) -> np.ndarray:
    marks = np.zeros(m, dtype=np.int64)
    s = j
    while s < m:
        marks[s] = 1
        s = nxt_list[s]
    return marks


def _prefix(pdf: pd.DataFrame, cols: list, lo: int, hi: int) -> np.ndarray:
    if not cols:
        return np.zeros((hi - lo + 1, 0), dtype=np.int64)
    vals = np.stack([pdf[c].iloc[lo:hi].fillna(0).to_numpy(dtype=np.int64) for c in cols], axis=1)
    if (vals < 0).any():
        raise ValueError(f"packing needs non-negative values in {cols}")
    return np.vstack([np.zeros((1, len(cols)), dtype=np.int64), np.cumsum(vals, axis=0)])


# --------------------------------------------------------------------------
# the scan
# --------------------------------------------------------------------------

class _Spec:
    def __init__(self, gcols, ocols, pack, row_limit, prepare=None):
        self.prepare = prepare or (lambda pdf: pdf)  # adds group columns that follow from the row's place
        self.gcols = gcols
        self.ocols = ocols
        self.pack_cols = [c for c, _ in pack]
        self.limits = packtable.Limits([lim for _, lim in pack], row_limit)


def _summarise(spec: _Spec):
    """One node per partition: its first and last group, and its packing table or exit state."""

    def fn(batches):
        pdf = _concat(batches)
        if pdf is None:
            return
        pdf = spec.prepare(pdf)
        bounds = _seg_bounds(_segment_starts(pdf, spec.gcols))
        lo, hi = int(bounds[-2]), int(bounds[-1])
        table = packtable.from_rows(_prefix(pdf, spec.pack_cols, lo, hi), spec.limits)
        keys = _key_at(pdf, spec.gcols, 0), _key_at(pdf, spec.gcols, len(pdf) - 1)
        yield packtable.to_frame([packtable.leaf(int(pdf[_PID].iat[0]), *keys, len(bounds) == 2, table, spec.limits)])

    return fn


#: Partitions, and nodes of each further level, that one task composes.
FAN = 16


def _entries(nodes: DataFrame, spec: _Spec, count: int) -> dict:
    """{partition: its entry state}, from the partitions' nodes; composed and handed down in tasks."""
    limits = spec.limits
    if count == 1:  # nothing stands before a single partition
        return {0: ([0] * len(limits.tops), 0, 0, 0)}

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        some = packtable.from_frame(pdf)
        return packtable.to_frame([packtable.compose(some, limits, int(some[0].node) // FAN)])

    def down(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        return packtable.entry_frame(packtable.enter(packtable.from_frame(pdf), packtable.entries_of(above), limits))

    parent = F.floor(F.col("node") / FAN).cast("long").alias("parent")
    levels = []
    while count > FAN:
        nodes = nodes.checkpoint(eager=True)
        levels.append(nodes)
        nodes = nodes.groupBy(parent).applyInPandas(up, packtable.NODE_SCHEMA)
        count = -(-count // FAN)

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        return packtable.entry_frame(packtable.enter(packtable.from_frame(pdf), (None, packtable.fresh(limits)), limits))

    at = nodes.groupBy(F.lit(0).alias("all")).applyInPandas(top, packtable.ENTRY_SCHEMA)
    for level in reversed(levels):
        at = level.groupBy(parent).cogroup(at.groupBy(F.col("node").alias("parent"))).applyInPandas(
            down, packtable.ENTRY_SCHEMA)
    return {r.node: (list(r.c), r.r, r.part, r.seen) for r in at.collect()}


def _emit(spec: _Spec, entries, extra: list[str]):
    """Second pass; ``entries`` is a broadcast of {partition id: entry state}."""
    gcols, limits = spec.gcols, spec.limits
    keep = gcols + spec.ocols + extra

    def fn(batches):
        pdf = _concat(batches)
        if pdf is None:
            return
        entry = entries.value[int(pdf[_PID].iat[0])]
        pdf = spec.prepare(pdf)
        n = len(pdf)
        bounds = _seg_bounds(_segment_starts(pdf, gcols))
        out = pdf[keep].copy()
        part = np.zeros(n, dtype=np.int64)
        rn = np.zeros(n, dtype=np.int64)
        for si in range(len(bounds) - 1):
            lo, hi = int(bounds[si]), int(bounds[si + 1])
            m = hi - lo
            S = _prefix(pdf, spec.pack_cols, lo, hi)
            nxt = next_start(S, limits).tolist()
            if si == 0:
                c, r, base, seen = entry
                j = entry_cut(S, c, r, limits)
            else:
                base, j, seen = 0, 0, 0
            marks = _starts_from(nxt, j, m)
            part[lo:hi] = base + np.cumsum(marks)
            rn[lo:hi] = seen + np.arange(1, m + 1)
        out["_part"] = part
        out["_rn"] = rn
        yield out

    return fn


def _running(laid: DataFrame, gcols: list[str], ocols: list[str], others: list[str], value_col: str, kind: str) -> DataFrame:
    """Running sum or maximum over a fixed layout, in the JVM and on two levels.

    A slice is the part of a group that one partition holds.  Inside a slice a window folds the rows in order; what
    the group's earlier slices amount to comes from a table of one row per slice.
    """
    fold = F.sum if kind == "sum" else F.max
    tagged = laid.withColumn(_PID, F.spark_partition_id())
    group = Window.partitionBy(*gcols)
    earlier = group.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    slices = tagged.groupBy(_PID, *gcols).agg(fold(value_col).alias("_all"))
    slices = slices.withColumn("_before", fold("_all").over(earlier))
    own = Window.partitionBy(_PID, *gcols).orderBy(*ocols).rowsBetween(Window.unboundedPreceding, 0)
    left, right = tagged.withColumn("_here", fold(value_col).over(own)).alias("_l"), slices.alias("_r")
    cond = F.col(f"_l.{_PID}") == F.col(f"_r.{_PID}")
    for c in gcols:
        cond = cond & F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}"))
    zero = F.lit(0).cast(laid.schema[value_col].dataType)
    run = (F.coalesce("_here", zero) + F.coalesce("_before", zero)) if kind == "sum" else F.greatest("_here", "_before")
    whole = isinstance(laid.schema[value_col].dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))
    return left.join(right, cond).select(*[F.col(f"_l.{c}") for c in gcols + ocols + others],
                                         run.cast("long" if whole else "double").alias("_run"))


def _number(laid: DataFrame, gcols: list[str], others: list[str]) -> DataFrame:
    """Row numbers and group sizes over a fixed layout, in the JVM.

    Inside a partition ``monotonically_increasing_id`` counts rows in layout order, so a row's place in its group is
    that id less the slice's first one, plus the rows of the group in earlier partitions.  The (partition, group)
    slices are a small table: at most one row per partition and one per group.
    """
    tagged = laid.withColumn(_PID, F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    slices = tagged.groupBy(_PID, *gcols).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_here"))
    group = Window.partitionBy(*gcols)
    earlier = group.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_here").over(earlier), F.lit(0))).withColumn(
        "_n", F.sum("_here").over(group))
    left, right = tagged.alias("_l"), slices.alias("_r")
    cond = F.col(f"_l.{_PID}") == F.col(f"_r.{_PID}")
    for c in gcols:
        cond = cond & F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}"))
    return left.join(right, cond).select(
        *[F.col(f"_l.{c}") for c in gcols + others],
        (F.col("_mid") - F.col("_first") + F.col("_before") + 1).cast("long").alias("_rn"),
        F.col("_n").cast("long").alias("_n"))


def ordered_scan(df: DataFrame, group_cols: list[str], order_cols: list[str], kind: str,
                 value_col: str | None = None, pack: list | None = None,
                 row_limit: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """Run one ordered scan; returns group + order columns plus the result column(s).

    kind: ``number`` (``_rn`` 1-based, ``_n`` group size), ``sum`` / ``max``
    (``_run`` inclusive running value) or ``greedy`` (``_part``: next-fit chunk
    index, and ``_rn``: 1-based position in the group; ``pack`` lists ``(column, limit)`` pairs that no chunk may exceed,
    together with at most ``row_limit`` rows; a single oversize row gets its
    own chunk).
    """
    if kind not in ("number", "sum", "max", "greedy"):
        raise ValueError(f"unknown scan kind {kind!r}")
    pack = [(c, lim) for c, lim in (pack or []) if lim is not None]
    if kind == "greedy" and not pack and row_limit is None:
        raise ValueError("greedy packing needs a token limit or a row limit")
    if row_limit is not None and int(row_limit) < 1:
        raise ValueError("row_limit must be >= 1")
    gcols, ocols = list(group_cols), list(order_cols)
    extra = ([value_col] if value_col else []) + [c for c, _ in pack]
    cols = gcols + ocols + [c for c in dict.fromkeys(extra) if c not in gcols + ocols]
    extra_out = [c for c in cols if c not in gcols + ocols]
    # The narrow projection is read several times (count, range-bound sampling, checkpoint
    # write); keep it so computed columns (e.g. token counts) run once.
    narrow = df.select(*cols).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if kind == "greedy" and not num_partitions:
            num_partitions = packing_partitions(narrow.count())
        laid = range_layout(narrow, gcols + ocols, num_partitions)
    finally:
        narrow.unpersist()
    if kind == "number":
        return _number(laid, gcols, ocols + extra_out)
    if kind != "greedy":
        return _running(laid, gcols, ocols, extra_out, value_col, kind)
    spec = _Spec(gcols, ocols, pack, row_limit)
    tagged = laid.withColumn(_PID, F.spark_partition_id())
    entries = _entries(tagged.mapInPandas(_summarise(spec), packtable.NODE_SCHEMA), spec, _num_partitions(laid, num_partitions))
    fields = [laid.schema[c] for c in gcols + ocols + extra_out]
    fields += [T.StructField("_part", T.LongType()), T.StructField("_rn", T.LongType())]
    # One entry per partition: shipped once per executor, not inside every task's closure.
    bc = laid.sparkSession.sparkContext.broadcast(entries)
    return tagged.mapInPandas(_emit(spec, bc, extra_out), T.StructType(fields))


#: Narrow rows of one packing partition, which its task holds.
ROWS_PER_PARTITION = 100_000


def packing_partitions(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_PARTITION))


# --------------------------------------------------------------------------
# even parts, and the large ones packed again: both from one layout
# --------------------------------------------------------------------------

_FORCED = "_forced"


def _even_parts(gcols: list[str], k: int, crossing):
    """Adds ``_forced``, the row's ``ntile(k)`` in its group.

    ``crossing`` is a broadcast of {partition: {group: (rows before the partition, rows in all)}} for the groups that
    cross its borders, two at most; the others are whole inside it.
    """
    def prepare(pdf: pd.DataFrame) -> pd.DataFrame:
        known = crossing.value.get(int(pdf[_PID].iat[0]), {})
        bounds = _seg_bounds(_segment_starts(pdf, gcols))
        part = np.zeros(len(pdf), dtype=np.int64)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            before, n = known.get(_key_at(pdf, gcols, lo), (0, hi - lo))
            at = before + np.arange(hi - lo)
            q, r = divmod(n, k)
            big = r * (q + 1)
            part[lo:hi] = np.where(at < big, at // (q + 1), r + (at - big) // max(q, 1)) + 1
        return pdf.assign(**{_FORCED: part})

    return prepare


def _border_sums(spec: _Spec, value_col: str):
    """Sum of the first and of the last group slice of a partition (of a single one: once)."""
    def fn(batches):
        pdf = _concat(batches)
        if pdf is None:
            return
        pdf = spec.prepare(pdf)
        bounds = _seg_bounds(_segment_starts(pdf, spec.gcols)).tolist()
        some = sorted({0, len(bounds) - 2})
        values = pdf[value_col].fillna(0)
        yield pd.DataFrame({"key": pd.Series([_key_at(pdf, spec.gcols, bounds[i]) for i in some], dtype=object),
                            "total": [int(values.iloc[bounds[i]:bounds[i + 1]].sum()) for i in some]})

    return fn


def _emit_hybrid(spec: _Spec, entries, totals, value_col: str, limit: int):
    """Rows with ``_forced`` and, where the part's total is above ``limit``, ``_part``: its place when packed again."""
    packed = _emit(spec, entries, [value_col])

    def fn(batches):
        for pdf in packed(batches):
            start = _segment_starts(pdf, spec.gcols)
            seg = np.cumsum(start) - 1
            bounds = _seg_bounds(start).tolist()
            sums = pdf[value_col].fillna(0).groupby(seg).sum().to_numpy(dtype=np.int64)
            for i in {0, len(bounds) - 2}:
                sums[i] = totals.value.get(_key_at(pdf, spec.gcols, bounds[i]), sums[i])
            yield pdf.assign(_part=pdf["_part"].astype("Int64").where((sums > limit)[seg])).drop(columns=["_rn"])

    return fn


def hybrid_scan(df: DataFrame, group_cols: list[str], order_cols: list[str], value_col: str, k: int, limit: int,
                num_partitions: int | None = None) -> DataFrame:
    """``_forced`` (``ntile(k)`` in group order) and ``_part`` (null unless the forced part's sum of ``value_col`` is
    above ``limit``: next-fit chunk inside the part), from one layout of the rows.

    A row's forced part follows from how many rows of its group earlier partitions hold, so the packing state is reset
    at the borders of parts while the same layout is read on.  The driver gets, for each partition, the sizes and
    sums of the groups and parts that cross its borders, and its entry state.
    """
    gcols, ocols = list(group_cols), list(order_cols)
    narrow = df.select(*gcols, *ocols, value_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n_parts = num_partitions or packing_partitions(narrow.count())
        laid = range_layout(narrow, gcols + ocols, n_parts)
    finally:
        narrow.unpersist()
    sc = laid.sparkSession.sparkContext
    tagged = laid.withColumn(_PID, F.spark_partition_id())
    group = Window.partitionBy(*gcols)
    slices = tagged.groupBy(_PID, *gcols).agg(F.count(F.lit(1)).alias("_here"))
    slices = slices.withColumn("_n", F.sum("_here").over(group)).withColumn("_before", F.coalesce(F.sum("_here").over(
        group.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    crossing: dict = {}
    for r in slices.filter(F.col("_n") > F.col("_here")).collect():  # at most two groups a partition
        key = json.dumps([_pyval(r[c]) for c in gcols], default=str)
        crossing.setdefault(r[_PID], {})[key] = (r["_before"], r["_n"])
    spec = _Spec([*gcols, _FORCED], ocols, [(value_col, limit)], None, _even_parts(gcols, k, sc.broadcast(crossing)))
    entries = _entries(tagged.mapInPandas(_summarise(spec), packtable.NODE_SCHEMA), spec, n_parts)
    sums = tagged.mapInPandas(_border_sums(spec, value_col), "key string, total long").groupBy("key").agg(
        F.sum("total").alias("total"))
    totals = {r.key: r.total for r in sums.collect()}  # at most two parts a partition
    fields = [laid.schema[c] for c in gcols] + [T.StructField(_FORCED, T.LongType())]
    fields += [laid.schema[c] for c in [*ocols, value_col]] + [T.StructField("_part", T.LongType())]
    return tagged.mapInPandas(_emit_hybrid(spec, sc.broadcast(entries), sc.broadcast(totals), value_col, limit), T.StructType(fields))


def attach(df: DataFrame, scanned: DataFrame, keys: list[str], result_cols: list[str]) -> DataFrame:
    """Join scan results back onto the full rows on the unique (group, order) key.

    Value columns the scan already carries (e.g. token counts) are taken from
    the scan side, so their expressions are not evaluated again.
    """
    shared = [c for c in scanned.columns if c in df.columns and c not in keys and c not in result_cols]
    result_cols = list(result_cols) + shared
    if shared:
        df = df.drop(*shared)
    left, right = df.alias("_l"), scanned.alias("_r")
    cond = None
    for k in keys:
        c = F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}"))
        cond = c if cond is None else cond & c
    return left.join(right, cond, "inner").select(
        "_l.*", *[F.col(f"_r.{c}") for c in result_cols])
