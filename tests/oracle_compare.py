"""Run registered queries in Spark and their oracle SQL in DuckDB, compare results.

Mirrors the correctness gate: same column names, same row count, same
order-insensitive multiset of values.  Usage:

    python tests/oracle_compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _canon(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{round(v, 6):.6f}"
    if isinstance(v, decimal.Decimal):
        return f"{round(float(v), 6):.6f}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if hasattr(v, "tolist"):
        return str(v.tolist())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_canon(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def _digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(_canon(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return [columns[i] for i in order], h, lines


def duck_connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir, keys=None, verbose=True):
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck_connect(sf_dir)
    report = {}
    for key in keys or sorted(qs):
        t0 = time.time()
        try:
            sdf = qs[key](spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as exc:  # noqa: BLE001
            report[key] = ("SPARK-ERROR", repr(exc)[:300])
            if verbose:
                print(f"{key:28s} SPARK-ERROR {repr(exc)[:300]}")
            continue
        st = time.time() - t0
        if key not in sqls:
            report[key] = ("ROWS-ONLY", len(srows))
            if verbose:
                print(f"{key:28s} rows-only  rows={len(srows)} spark={st:.1f}s")
            continue
        try:
            res = con.execute(sqls[key])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as exc:  # noqa: BLE001
            report[key] = ("SQL-ERROR", repr(exc)[:300])
            if verbose:
                print(f"{key:28s} SQL-ERROR {repr(exc)[:300]}")
            continue
        sc, sh, sl = _digest(scols, srows)
        dc, dh, dl = _digest(dcols, drows)
        ok = sc == dc and len(srows) == len(drows) and sh == dh
        report[key] = ("OK" if ok else "MISMATCH", len(srows), len(drows))
        if verbose:
            print(f"{key:28s} {'OK' if ok else 'MISMATCH'} rows={len(srows)}/{len(drows)} spark={st:.1f}s")
            if not ok:
                if sc != dc:
                    print("   cols spark:", sc, "\n   cols duck: ", dc)
                else:
                    a, b = set(sl), set(dl)
                    for x in sorted(a - b)[:3]:
                        print("   spark-only:", x[:300])
                    for x in sorted(b - a)[:3]:
                        print("   duck-only: ", x[:300])
    return report


if __name__ == "__main__":
    from inkmeter.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = build_session("local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    rep = compare(spark, sf, keys)
    bad = [k for k, v in rep.items() if v[0] not in ("OK", "ROWS-ONLY")]
    print("FAILED:", bad)
