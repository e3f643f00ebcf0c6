"""Every registered query against its DuckDB oracle, plus the entry contract."""

import pytest

import __spark_entry__ as E
from conftest import SF001
from oracle_compare import compare


def test_contract_keys():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    rows_only = {k for k in set(q) - set(sql) if not k.startswith("op") and k != "pipeline"}
    assert not rows_only


def test_entry_smoke(spark):
    df = E.entry(spark)
    schema = df.schema
    n = df.count()
    assert n > 0
    assert E.entry(spark).schema == schema


@pytest.mark.slow
def test_all_queries_match_oracle(spark):
    keys = [k for k in sorted(E.queries()) if not k.startswith("op") and k != "pipeline"]  # those have tests of their own
    report = compare(spark, SF001, keys, verbose=False)
    bad = {k: v for k, v in report.items() if v[0] not in ("OK", "ROWS-ONLY")}
    assert not bad, bad
