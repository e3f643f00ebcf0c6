"""Ordered scans against a plain Python fold, with groups spanning partitions."""

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from inkmeter.plans import ordered, packtable
from inkmeter.plans.ordered import ordered_scan


def _greedy(toks, limits, row_limit):
    """Sequential next-fit fold: toks is a list of tuples (one entry per limit)."""
    parts, cur, rows, part = [], [0] * len(limits), 0, 1
    for t in toks:
        over = any(c + x > lim for c, x, lim in zip(cur, t, limits))
        if rows and (over or (row_limit is not None and rows >= row_limit)):
            part += 1
            cur, rows = [0] * len(limits), 0
        cur = [c + x for c, x in zip(cur, t)]
        rows += 1
        parts.append(part)
    return parts


def _data(seed, n=3000):
    rnd = random.Random(seed)
    rows = []
    sizes = {"hot": n // 2, "b": n // 6, "c": 3, "d": 1}
    for g, cnt in sizes.items():
        for i in range(cnt):
            rows.append((g, i * 7 + rnd.randint(0, 6), rnd.choice([0, 1, 5, 40, 90, 250]),
                         rnd.randint(1, 30)))
    for i in range(n - sum(sizes.values())):
        rows.append((f"g{i % 37}", 100000 + i, rnd.randint(0, 120), rnd.randint(1, 30)))
    return rows


SCHEMA = T.StructType([T.StructField("file", T.StringType()), T.StructField("pos", T.LongType()),
                       T.StructField("tok", T.LongType()), T.StructField("b", T.LongType())])


def _by_group(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_number_and_running(spark, parts):
    rows = _data(parts)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.file, r.pos): (r._rn, r._n) for r in
           ordered_scan(df, ["file"], ["pos"], "number", num_partitions=parts).collect()}
    run = {(r.file, r.pos): r._run for r in
           ordered_scan(df, ["file"], ["pos"], "sum", value_col="tok", num_partitions=parts).collect()}
    mx = {(r.file, r.pos): r._run for r in
          ordered_scan(df, ["file"], ["pos"], "max", value_col="tok", num_partitions=parts).collect()}
    for g, rs in _by_group(rows).items():
        acc, m = 0, None
        for i, r in enumerate(rs):
            acc += r[2]
            m = r[2] if m is None else max(m, r[2])
            assert got[(g, r[1])] == (i + 1, len(rs))
            assert run[(g, r[1])] == acc
            assert mx[(g, r[1])] == m


@pytest.mark.parametrize("parts,limit,row_limit", [(1, 300, None), (7, 300, None), (16, 500, 9),
                                                   (12, 60, 4), (9, None, 5), (16, 40, None)])
def test_greedy_matches_fold(spark, parts, limit, row_limit):
    rows = _data(parts * 31 + (limit or 0))
    df = spark.createDataFrame(rows, SCHEMA)
    pack = [("tok", limit)] if limit is not None else []
    res = ordered_scan(df, ["file"], ["pos"], "greedy", pack=pack, row_limit=row_limit,
                       num_partitions=parts).collect()
    got = {(r.file, r.pos): r._part for r in res}
    pos = {(r.file, r.pos): r._rn for r in res}
    lims = [limit] if limit is not None else []
    for g, rs in _by_group(rows).items():
        want = _greedy([(r[2],) if lims else () for r in rs], lims, row_limit)
        assert [got[(g, r[1])] for r in rs] == want, g
        assert [pos[(g, r[1])] for r in rs] == list(range(1, len(rs) + 1)), g


def test_greedy_two_limits(spark):
    rows = _data(99)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.file, r.pos): r._part for r in
           ordered_scan(df, ["file"], ["pos"], "greedy", pack=[("tok", 400), ("b", 50)], row_limit=20,
                        num_partitions=11).collect()}
    for g, rs in _by_group(rows).items():
        want = _greedy([(r[2], r[3]) for r in rs], [400, 50], 20)
        assert [got[(g, r[1])] for r in rs] == want, g


def _table(rows, limits):
    values = np.array(rows, dtype=np.int64).reshape(len(rows), len(limits.tops))
    return packtable.from_rows(np.vstack([np.zeros((1, len(limits.tops)), np.int64), np.cumsum(values, axis=0)]), limits)


def _fold(state, rows, limits):
    """The state after packing ``rows`` one by one."""
    c, r, part = list(state.c), state.r, state.part
    for t in rows:
        over = any(x + y > top for x, y, top in zip(c, t, limits.tops))
        if r == 0 or over or (limits.rows is not None and r >= limits.rows):
            c, r, part = [0] * len(c), 0, part + 1
        c, r = [x + y for x, y in zip(c, t)], r + 1
    return packtable.State(c, r, part, state.seen + len(rows))


def test_tables_compose_like_the_fold():
    """Any bracketing of neighbouring slices gives the state that packing row by row gives."""
    rnd = random.Random(1)
    for trial in range(200):
        dims = rnd.choice([0, 1, 2])
        limits = packtable.Limits([rnd.choice([20, 100, 400]) for _ in range(dims)],
                                  rnd.choice([2, 9, 50]) if dims == 0 else rnd.choice([None, 3, 25]))
        slices = [[tuple(rnd.choice([0, 1, 7, 30, 500]) for _ in range(dims)) for _ in range(rnd.randint(1, 30))]
                  for _ in range(rnd.randint(2, 6))]
        tables = [_table(s, limits) for s in slices]
        left = tables[0]
        for t in tables[1:]:
            left = packtable.both(left, t, limits)
        right = tables[-1]
        for t in reversed(tables[:-1]):
            right = packtable.both(t, right, limits)
        rows = [r for s in slices for r in s]
        before = [tuple(rnd.choice([0, 1, 7, 30]) for _ in range(dims)) for _ in range(rnd.randint(0, 12))]
        state = _fold(packtable.fresh(limits), before, limits)
        want = _fold(state, rows, limits)
        assert packtable.after(left, state, limits) == want
        assert packtable.after(right, state, limits) == want
        if limits.rows is not None:
            assert len(left.a) <= limits.rows


def test_nodes_of_many_groups_hand_down_entry_states():
    rnd = random.Random(2)
    limits = packtable.Limits([60], 8)
    for trial in range(100):
        rows = [(g, rnd.choice([0, 5, 20, 90])) for g in range(4) for _ in range(rnd.choice([1, 5, 60]))]
        cuts = sorted(rnd.sample(range(1, len(rows)), min(7, len(rows) - 1)))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        nodes, want, state, key = [], [], None, None
        for i, p in enumerate(parts):
            last = [(t,) for g, t in p if g == p[-1][0]]
            nodes.append(packtable.leaf(i, str(p[0][0]), str(p[-1][0]), p[0][0] == p[-1][0], _table(last, limits), limits))
            want.append(state if key == p[0][0] else packtable.fresh(limits))
            state = _fold(want[-1] if p[0][0] == p[-1][0] else packtable.fresh(limits), last, limits)
            key = p[-1][0]
        flat = packtable.enter(nodes, (None, packtable.fresh(limits)), limits)
        assert [x for _, _, x in flat] == want
        pairs = [packtable.compose(nodes[i:i + 2], limits, i) for i in range(0, len(nodes), 2)]
        pairs = packtable.from_frame(packtable.to_frame(pairs))  # as they travel between tasks
        tops = packtable.enter(pairs, (None, packtable.fresh(limits)), limits)
        assert [tops[i // 2][2] for i in range(0, len(nodes), 2)] == want[::2]


@pytest.mark.parametrize("parts", [5, 40])
def test_greedy_through_a_tree_of_tasks(spark, monkeypatch, parts):
    monkeypatch.setattr(ordered, "FAN", 3)
    rows = _data(parts)
    res = ordered_scan(spark.createDataFrame(rows, SCHEMA), ["file"], ["pos"], "greedy", pack=[("tok", 700), ("b", 90)],
                       row_limit=20, num_partitions=parts).collect()
    got = {(r.file, r.pos): r._part for r in res}
    for g, rs in _by_group(rows).items():
        assert [got[(g, r[1])] for r in rs] == _greedy([(r[2], r[3]) for r in rs], [700, 90], 20), g


def test_entry_states_are_of_constant_size(spark, monkeypatch):
    """At the service's limits the driver gets a few numbers per partition, whatever the tables hold."""
    seen = {}
    entries = ordered._entries
    monkeypatch.setattr(ordered, "_entries", lambda *a: seen.setdefault("entries", entries(*a)))
    rnd = random.Random(6)
    toks = [rnd.choice([0, 1, 3, 200]) for _ in range(150_000)]
    df = spark.createDataFrame([("hot", i, t) for i, t in enumerate(toks)], "file string, pos long, tok long")
    res = ordered_scan(df, ["file"], ["pos"], "greedy", pack=[("tok", 2_000_000)], row_limit=50_000, num_partitions=20)
    got = [r._part for r in res.orderBy("pos").collect()]
    assert got == _greedy([(t,) for t in toks], [2_000_000], 50_000)
    assert len(seen["entries"]) > 10 and all(len(str(e)) < 100 for e in seen["entries"].values())


def test_packing_partitions_follow_the_rows():
    assert [ordered.packing_partitions(n) for n in (0, 1, 100_000, 100_001, 30_000_000)] == [1, 1, 1, 2, 300]


def test_empty_table_packs_to_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ordered_scan(df, ["file"], ["pos"], "greedy", pack=[("tok", 5)]).collect() == []
    assert ordered_scan(df, ["file"], ["pos"], "sum", value_col="tok").collect() == []


def test_running_sum_has_no_python_stage(spark):
    df = spark.createDataFrame(_data(3), SCHEMA)
    plan = ordered_scan(df, ["file"], ["pos"], "sum", value_col="tok")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("parts,k,limit", [(1, 3, 200), (9, 3, 200), (16, 4, 1500), (16, 1, 90), (7, 5000, 60)])
def test_hybrid_matches_fold(spark, parts, k, limit):
    """Even parts, and those above the limit packed again, with groups and parts across partitions."""
    rows = _data(parts + k)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.file, r.pos): (r._forced, r._part) for r in
           ordered.hybrid_scan(df, ["file"], ["pos"], "tok", k, limit, num_partitions=parts).collect()}
    assert len(got) == len(rows)
    for g, rs in _by_group(rows).items():
        q, rest = divmod(len(rs), k)
        lo = 0
        for p in range(1, min(k, len(rs)) + 1):
            mine = rs[lo:lo + q + (p <= rest)]
            lo += len(mine)
            packed = _greedy([(r[2],) for r in mine], [limit], None)
            over = sum(r[2] for r in mine) > limit
            assert [got[(g, r[1])] for r in mine] == [(p, x if over else None) for x in packed], (g, p)
