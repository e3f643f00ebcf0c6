"""Next-fit packing of a slice of rows as a function of the chunk that is open before it.

A state is (c, r, part, seen): sums and rows of the open chunk, its number in
the group, rows of the group so far.  What a slice of one group does to a
state depends on one thing only: before which of its rows the open chunk is
closed.  Its table lists these cuts in runs that leave the same chunk open:

- ``a``: first cut of the run (rows of the slice that still join the open chunk);
- ``s``: sums of those rows;
- ``inc``: chunks opened inside the slice;
- ``tl``, ``rl``: sums and rows of the chunk that is open at the end;

and the slice's sums and rows, for a slice that joins the open chunk whole.
Chains from different cuts soon meet, so runs are few; they can never be more
than the rows that fit in one chunk.  Two tables in order compose into the
table of both slices, which is what lets a tree of tasks replace a walk over
all partitions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd

NODE_SCHEMA = ("node long, first_key string, last_key string, single boolean, n long, total array<long>, "
               "a array<long>, s array<long>, inc array<long>, tl array<long>, rl array<long>, "
               "c array<long>, r long, part long, seen long")
ENTRY_SCHEMA = "node long, key string, c array<long>, r long, part long, seen long"


@dataclass
class Limits:
    """Largest sums of a chunk, one for each packed quantity, and its most rows (None: any)."""

    tops: list
    rows: int | None


@dataclass
class Table:
    n: int
    total: np.ndarray  # [d]
    a: np.ndarray      # [k]
    s: np.ndarray      # [k, d]
    inc: np.ndarray    # [k]
    tl: np.ndarray     # [k, d]
    rl: np.ndarray     # [k]


@dataclass
class State:
    c: list
    r: int
    part: int
    seen: int


@dataclass
class Node:
    """Neighbouring partitions: a table if they hold a single group, otherwise the state they leave."""

    node: int
    first_key: str
    last_key: str
    single: bool
    table: Table | None
    exit: State | None = field(default=None)


# --------------------------------------------------------------------------
# rows of one slice; S holds prefix sums, [m + 1, d]
# --------------------------------------------------------------------------

def next_start(S: np.ndarray, limits: Limits) -> np.ndarray:
    """Start of the next chunk, for every j, if a chunk starts at row j."""
    m = S.shape[0] - 1
    j = np.arange(m, dtype=np.int64)
    fits = np.full(m, m, dtype=np.int64)
    for d, top in enumerate(limits.tops):
        col = S[:, d]
        fits = np.minimum(fits, np.searchsorted(col, col[:-1] + top, side="right").astype(np.int64) - 1)
    nxt = np.maximum(j + 1, fits)
    if limits.rows is not None:
        nxt = np.minimum(nxt, j + int(limits.rows))
    return np.minimum(nxt, m)


def chase_all(nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointer doubling: for every j, the last chunk start reached and the hops to it."""
    m = len(nxt)
    real = nxt < m
    jump = np.where(real, nxt, np.arange(m, dtype=np.int64))
    hops = real.astype(np.int64)
    while True:
        nj = jump[jump]
        if np.array_equal(nj, jump):
            return jump, hops
        hops = hops + hops[jump]
        jump = nj


def entry_cut(S: np.ndarray, c: list, r: int, limits: Limits) -> int:
    """Rows [0, j) of a continuing group join the open chunk; row j opens the next."""
    if r == 0:
        return 0
    j = S.shape[0] - 1
    for d, top in enumerate(limits.tops):
        x = top - c[d]
        j = min(j, 0 if x < 0 else int(np.searchsorted(S[:, d], x, side="right")) - 1)
    if limits.rows is not None:
        j = min(j, int(limits.rows) - r)
    return max(0, j)


def from_rows(S: np.ndarray, limits: Limits) -> Table:
    m = S.shape[0] - 1
    jump, hops = chase_all(next_start(S, limits))
    last = m - 1
    for d, top in enumerate(limits.tops):
        last = min(last, int(np.searchsorted(S[:, d], top, side="right")) - 1)
    if limits.rows is not None:
        last = min(last, int(limits.rows) - 1)
    cuts = np.arange(max(last, 0) + 1)
    at = jump[cuts]
    return _runs(Table(m, S[m], cuts, S[cuts], hops[cuts] + 1, S[m][None, :] - S[at], m - at), limits)


def _runs(t: Table, limits: Limits) -> Table:
    """Drops cuts no open chunk (of at least one row) can reach, and joins neighbours that leave the same chunk."""
    use = np.ones(len(t.a), dtype=bool)
    for d, top in enumerate(limits.tops):
        use &= t.s[:, d] <= top
    if limits.rows is not None:
        use &= t.a < int(limits.rows)
    use[0] = True
    first = np.flatnonzero(use)
    same = (t.inc[first[1:]] == t.inc[first[:-1]]) & (t.rl[first[1:]] == t.rl[first[:-1]])
    same &= (t.tl[first[1:]] == t.tl[first[:-1]]).all(axis=1)
    first = first[np.concatenate(([True], ~same))]
    return Table(t.n, t.total, t.a[first], t.s[first], t.inc[first], t.tl[first], t.rl[first])


# --------------------------------------------------------------------------
# tables
# --------------------------------------------------------------------------

def apply(t: Table, c: np.ndarray, r: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the slice makes of open chunks (c: [k, d], r: [k]): (c, r, chunks opened)."""
    joins = r > 0
    run = np.full(len(r), len(t.a) - 1, dtype=np.int64)
    for d, top in enumerate(limits.tops):
        joins = joins & (c[:, d] + t.total[d] <= top)
        run = np.minimum(run, np.searchsorted(t.s[:, d], top - c[:, d], side="right") - 1)
    if limits.rows is not None:
        joins = joins & (r + t.n <= limits.rows)
        run = np.minimum(run, np.searchsorted(t.a, limits.rows - r, side="right") - 1)
    run = np.where(r > 0, np.maximum(run, 0), 0)
    return (np.where(joins[:, None], c + t.total, t.tl[run]), np.where(joins, r + t.n, t.rl[run]),
            np.where(joins, 0, t.inc[run]))


def after(t: Table, x: State, limits: Limits) -> State:
    c, r, more = apply(t, np.array([x.c], dtype=np.int64).reshape(1, len(limits.tops)), np.array([x.r]), limits)
    return State(c[0].tolist(), int(r[0]), x.part + int(more[0]), x.seen + t.n)


def both(x: Table, y: Table, limits: Limits) -> Table:
    """The table of two neighbouring slices of a group."""
    c, r, more = apply(y, x.tl, x.rl, limits)
    cat = np.concatenate
    return _runs(Table(x.n + y.n, x.total + y.total, cat((x.a, y.a + x.n)), cat((x.s, y.s + x.total)),
                       cat((x.inc + more, y.inc)), cat((c, y.tl)), cat((r, y.rl))), limits)


def fresh(limits: Limits) -> State:
    return State([0] * len(limits.tops), 0, 0, 0)


# --------------------------------------------------------------------------
# nodes of the tree
# --------------------------------------------------------------------------

def leaf(node: int, first_key: str, last_key: str, single: bool, table: Table, limits: Limits) -> Node:
    """``table`` is that of the partition's last group."""
    if single:
        return Node(node, first_key, last_key, True, table)
    return Node(node, first_key, last_key, False, None, after(table, fresh(limits), limits))


def leaves(x: Node, key: str | None, state: State, limits: Limits) -> State:
    """The state behind a node that is entered with ``state`` of group ``key``."""
    if not x.single:
        return x.exit
    return after(x.table, state if key == x.first_key else fresh(limits), limits)


def compose(nodes: list, limits: Limits, name: int) -> Node:
    """One node for neighbours in order."""
    out = nodes[0]
    for x in nodes[1:]:
        if out.single and x.single and out.last_key == x.first_key:
            out = Node(name, out.first_key, x.last_key, True, both(out.table, x.table, limits))
        else:
            # the group of x starts in it, or the state before it no longer depends on how the nodes are entered
            before = fresh(limits) if out.single else out.exit
            out = Node(name, out.first_key, x.last_key, False, None, leaves(x, out.last_key if not out.single else None, before, limits))
    return Node(name, out.first_key, out.last_key, out.single, out.table, out.exit)


def enter(nodes: list, entry: tuple, limits: Limits) -> list:
    """(node, key, state) each node is entered with, if the first one is entered with ``entry`` (key, state)."""
    key, state = entry
    out = []
    for x in nodes:
        out.append((x.node, key, state if key == x.first_key else fresh(limits)))
        state, key = leaves(x, key, state, limits), x.last_key
    return out


# --------------------------------------------------------------------------
# frames
# --------------------------------------------------------------------------

def _column(values: list) -> pd.Series:
    return pd.Series(values, dtype=object)


def to_frame(nodes: list) -> pd.DataFrame:
    t = [x.table for x in nodes]
    e = [x.exit for x in nodes]
    out = {"node": [x.node for x in nodes], "first_key": _column([x.first_key for x in nodes]),
           "last_key": _column([x.last_key for x in nodes]), "single": [x.single for x in nodes],
           "n": [0 if y is None else y.n for y in t], "total": _column([None if y is None else y.total for y in t])}
    for c in ("a", "s", "inc", "tl", "rl"):
        out[c] = _column([None if y is None else getattr(y, c).reshape(-1) for y in t])
    out["c"] = _column([None if y is None else y.c for y in e])
    for c in ("r", "part", "seen"):
        out[c] = [0 if y is None else getattr(y, c) for y in e]
    return pd.DataFrame(out)


def from_frame(pdf: pd.DataFrame) -> list:
    """Nodes in ascending order."""
    out = []
    for x in pdf.sort_values("node").itertuples():
        table = state = None
        if x.single:
            k, d = len(x.a), len(x.total)
            table = Table(int(x.n), np.asarray(x.total, dtype=np.int64), np.asarray(x.a), np.asarray(x.s).reshape(k, d),
                          np.asarray(x.inc), np.asarray(x.tl).reshape(k, d), np.asarray(x.rl))
        else:
            state = State([int(v) for v in x.c], int(x.r), int(x.part), int(x.seen))
        out.append(Node(int(x.node), x.first_key, x.last_key, bool(x.single), table, state))
    return out


def entry_frame(entries: list) -> pd.DataFrame:
    return pd.DataFrame({"node": [n for n, _, _ in entries], "key": _column([k for _, k, _ in entries]),
                         "c": _column([x.c for _, _, x in entries]), "r": [x.r for _, _, x in entries],
                         "part": [x.part for _, _, x in entries], "seen": [x.seen for _, _, x in entries]})


def entries_of(pdf: pd.DataFrame) -> tuple:
    """(key, state) of a frame of one entry."""
    x = next(pdf.itertuples())
    return (x.key if isinstance(x.key, str) else None, State([int(v) for v in x.c], int(x.r), int(x.part), int(x.seen)))
