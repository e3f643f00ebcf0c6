"""The package reaches Python workers even when the driver runs outside the repository."""

import os
import subprocess
import sys
import zipfile

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_shipped_zip_holds_the_package(spark):
    from inkmeter import session

    files = [f for f in spark.sparkContext.listFiles if f.endswith(".zip") and "inkmeter-" in f]
    assert files, "ship_package did not add the package"
    path = files[-1].replace("file:", "")
    names = zipfile.ZipFile(path).namelist()
    assert "inkmeter/__init__.py" in names and "inkmeter/plans/ordered.py" in names
    assert spark.sparkContext.applicationId in session._SHIPPED


@pytest.mark.slow
def test_entry_runs_from_another_directory(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
import __spark_entry__ as E
print("ROWS", len(E.entry(spark).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True,
                         text=True, timeout=600)
    assert "ROWS " in out.stdout, out.stderr[-2000:]
    assert int(out.stdout.split("ROWS ")[1].split()[0]) > 0
