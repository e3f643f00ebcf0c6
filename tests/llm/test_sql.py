"""Queries of the operators that SQL can express, against that SQL in DuckDB, over the whole small tables."""

import pytest

import __spark_entry__ as E
from conftest import SF001
from oracle_compare import compare

KEYS = sorted(k for k in E.oracle_sql() if k.startswith("op") and k[2].isdigit())


def test_keys():
    assert {k.split("_")[0] for k in KEYS} == {"op3", "op8", "op9", "op10", "op11", "op12", "op13"}


@pytest.mark.slow
@pytest.mark.parametrize("key", KEYS)
def test_query_matches_its_sql(spark, key):
    report = compare(spark, SF001, [key], verbose=False)
    assert report[key][0] == "OK", report
