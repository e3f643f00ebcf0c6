"""Per-file and per-chunk aggregates.

All are hash aggregates with partial (map-side) aggregation, so a hot file
is pre-reduced in every task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_stats(df: DataFrame, file_col: str = "file", tok_col: str = "tok") -> DataFrame:
    """Rows, total, mean, max tokens per file."""
    return df.groupBy(file_col).agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.sum(tok_col).cast("long").alias("total_tokens"),
        F.round(F.avg(tok_col), 6).alias("avg_tokens"),
        F.max(tok_col).cast("long").alias("max_tokens"),
    )


def chunk_totals(df: DataFrame, keys=("file", "part"), tok_col: str = "tok",
                 pos_col: str = "pos") -> DataFrame:
    """Rows and tokens per chunk, with the chunk's first and last position."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.sum(tok_col).cast("long").alias("chunk_tokens"),
        F.min(pos_col).alias("first_pos"),
        F.max(pos_col).alias("last_pos"),
    )


def file_token_totals(df: DataFrame, file_col: str = "file", in_col: str = "input_tokens",
                      out_col: str = "output_tokens") -> DataFrame:
    """Input and output tokens per file."""
    return df.groupBy(file_col).agg(
        F.sum(in_col).cast("long").alias("input_tokens"),
        F.sum(out_col).cast("long").alias("output_tokens"),
    )


def job_summary(status: DataFrame) -> DataFrame:
    """total/completed/failed/error chunk counts, token and cost sums."""
    return status.agg(
        F.count(F.lit(1)).cast("long").alias("total_jobs"),
        F.count_if(F.col("status") == "completed").cast("long").alias("completed"),
        F.count_if(F.col("status") == "failed").cast("long").alias("failed"),
        F.count_if(F.col("status") == "error").cast("long").alias("errored"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("output_tokens"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"),
    )


def error_counts(results: DataFrame, file_col: str = "file", is_error_col: str = "is_error") -> DataFrame:
    """Rows processed and rows in error per file."""
    return results.groupBy(file_col).agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.count_if(F.col(is_error_col)).cast("long").alias("n_errors"),
    )


def all_failed(results: DataFrame, file_col: str = "file", is_error_col: str = "is_error") -> DataFrame:
    """A file whose every row is an error."""
    return results.groupBy(file_col).agg(F.bool_and(F.col(is_error_col)).alias("all_failed"))
