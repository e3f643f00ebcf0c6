"""Runs as one commit: a manifest names everything a run has written, and readers follow manifests only.

A run writes below ``runs/run_ts=…`` as often as it takes; nothing there
counts until ``manifests/run_ts=…`` is complete, which is the last thing
written.  A run that was killed leaves no manifest and is repeated under the
same name: its sinks are written over, so each exists once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmeter.sources import readers

MANIFEST = "run_ts string, kind string, path string"


def folder(out: str, run_ts: str) -> str:
    return f"{out.rstrip('/')}/runs/run_ts={run_ts}"


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end."""
    return readers.path_exists(spark, f"{path}/_SUCCESS")


def _manifest(out: str, run_ts: str) -> str:
    return f"{out.rstrip('/')}/manifests/run_ts={run_ts}"


def open_run(spark: SparkSession, out: str, run_ts: str) -> str:
    """The folder of a run; a run that was committed is never written again."""
    if complete(spark, _manifest(out, run_ts)):
        raise FileExistsError(f"run {run_ts} is committed")
    return folder(out, run_ts)


def commit(spark: SparkSession, out: str, run_ts: str, paths: dict[str, str]) -> None:
    rows = [(run_ts, kind, path) for kind, path in sorted(paths.items())]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(_manifest(out, run_ts))


def committed(spark: SparkSession, out: str, kind: str) -> list[tuple[str, str]]:
    """(run, path) of what committed runs have written of a kind; a few rows for each run."""
    base = f"{out.rstrip('/')}/manifests"
    if not readers.path_exists(spark, base):
        return []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [f"{base}/{n}" for n in names if n.startswith("run_ts=") and complete(spark, f"{base}/{n}")]
    if not done:
        return []
    rows = spark.read.schema(MANIFEST).json(done).filter(F.col("kind") == kind).select("run_ts", "path").collect()
    return sorted((r.run_ts, r.path) for r in rows)


def read_results(spark: SparkSession, out: str) -> DataFrame | None:
    """Result rows of all committed runs, with ``run_ts``; None before the first."""
    parts = [spark.read.parquet(p).withColumn("run_ts", F.lit(run)) for run, p in committed(spark, out, "results")]
    if not parts:
        return None
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole


def read_usage(spark: SparkSession, out: str) -> DataFrame:
    """Usage events of all committed runs."""
    paths = [p for _, p in committed(spark, out, "usage")]
    if not paths:
        return spark.createDataFrame([], readers.USAGE_SCHEMA)
    return readers.usage_reader(spark.read).json(paths)


def read_daily(spark: SparkSession, out: str) -> DataFrame:
    """Tokens submitted per (date, key prefix): the sum of what committed runs have added."""
    paths = [p for _, p in committed(spark, out, "daily")]
    if not paths:
        return spark.createDataFrame([], readers.DAILY_SCHEMA)
    added = spark.read.schema(readers.DAILY_SCHEMA).json(paths)
    return added.groupBy("date", "api_key_prefix").agg(F.sum("tokens_submitted").cast("long").alias("tokens_submitted"))
