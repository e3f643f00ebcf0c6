"""Sinks (B1-B7).  Every write is a distributed Spark write; nothing is
gathered on the driver.  Results never overwrite: versioned paths use
``errorifexists``."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmeter.operators.results import broadcast_if_small
from inkmeter.session import ensure_checkpoint_dir
from inkmeter.sources.readers import ISO_TS

MAX_RECORDS_PER_REQUEST_FILE = 50_000


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """B1 (CSV): header row, RFC-4180 quoting so embedded quotes and newlines survive."""
    (df.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", False)
     .csv(path))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """B1 (JSON / JSON Lines): JSON output is always written as lines."""
    df.write.mode(mode).option("timestampFormat", ISO_TS).json(path)


def write_json_arrays(df: DataFrame, path: str, group_cols: list[str], mode: str = "errorifexists") -> None:
    """JSON-array files: one array per bounded group, one group per folder.

    ``group_cols`` must bound the group size (e.g. a chunk id); each folder
    then holds a single line with one array, readable with ``multiLine``.
    """
    payload = df.groupBy(*group_cols).agg(
        F.to_json(F.collect_list(F.struct(*[c for c in df.columns if c not in group_cols]))).alias("value"))
    payload.write.mode(mode).partitionBy(*group_cols).text(path)


def _sliced(df: DataFrame, keys: list[str], place: Column, max_rows: int) -> DataFrame:
    """``df`` dealt out by (chunk, slice): every chunk is cut into as many equal ranges of ``place`` as hold about
    ``max_rows`` rows each, so a large chunk is written by many tasks and a small one by one.

    The chunks' sizes and ranges are a table of one row a chunk, joined by broadcast while its bytes are few.
    """
    at = df.withColumn("_place", place.cast("long"))
    sizes = at.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / max_rows).cast("long").alias("_slices"),
                                  F.min("_place").alias("_low"), F.max("_place").alias("_high")).checkpoint(eager=True)
    wide = F.greatest(F.col("_high").cast("double") - F.col("_low").cast("double"), F.lit(1.0))
    share = (F.col("_place").cast("double") - F.col("_low").cast("double")) / wide
    slice_ = F.least(F.floor(share * F.col("_slices")), F.col("_slices") - 1)
    cut = at.join(broadcast_if_small(sizes), keys).withColumn("_slice", F.coalesce(slice_, F.lit(0)))
    return cut.repartition(*keys, "_slice").select(*df.columns)


def write_chunks(df: DataFrame, path: str, file_col: str = "file", part_col: str = "part",
                 fmt: str = "parquet", mode: str = "errorifexists", pos_col: str = "pos",
                 max_rows: int = MAX_RECORDS_PER_REQUEST_FILE) -> None:
    """B2: one folder per chunk (``file=…/part=…``), in files of at most ``max_rows`` rows; ``pos_col`` keeps the order."""
    ensure_checkpoint_dir(df.sparkSession)
    w = (_sliced(df, [file_col, part_col], F.col(pos_col), max_rows).write.mode(mode)
         .option("maxRecordsPerFile", max_rows).partitionBy(file_col, part_col))
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "jsonl":
        w.json(path)
    elif fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unsupported chunk format {fmt}")


def versioned_path(base: str, run_ts: str | None = None) -> str:
    """A new ``run_ts=`` folder per run."""
    ts = run_ts or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    return base.rstrip("/") + f"/run_ts={ts}"


def write_versioned(df: DataFrame, base: str, run_ts: str | None = None, fmt: str = "parquet") -> str:
    path = versioned_path(base, run_ts)
    df.write.mode("errorifexists").format(fmt).save(path)
    return path


def append_usage(events: DataFrame, path: str) -> None:
    """Append usage events as JSON Lines."""
    events.write.mode("append").option("timestampFormat", ISO_TS).json(path)


def write_requests(requests: DataFrame, path: str, chunk_col: str = "chunk_id",
                   max_records: int = MAX_RECORDS_PER_REQUEST_FILE) -> None:
    """Request JSON lines, one folder per chunk, at most ``max_records`` lines per file."""
    ensure_checkpoint_dir(requests.sparkSession)
    place = F.col("pos") if "pos" in requests.columns else F.xxhash64("request")
    lines = _sliced(requests.withColumn("_at", place), [chunk_col], F.col("_at"), max_records)
    (lines.select(chunk_col, F.col("request").alias("value"))
     .write.mode("errorifexists").option("maxRecordsPerFile", max_records)
     .partitionBy(chunk_col).text(path))


def append_rejects(rejects: DataFrame, path: str, run_ts: str | None = None) -> None:
    """Per-file failure records (file, stage, error, run_ts), appended."""
    ts = run_ts or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    (rejects.select("file", "stage", "error").withColumn("run_ts", F.lit(ts))
     .write.mode("append").parquet(path))
