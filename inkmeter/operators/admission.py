"""Admission gates: caps, halt-at-first-failure, daily budgets.

Per-file decisions are aggregates; decisions that depend on file order are
ordered scans over the per-file table (never a window without partition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmeter.operators.packing import number_rows
from inkmeter.plans.ordered import attach, ordered_scan

# Service limit on requests per batch, default daily token limit.
MAX_ROWS_PER_FILE = 50_000
DAILY_TOKEN_LIMIT = 2_000_000


def row_cap(df: DataFrame, cap: int = MAX_ROWS_PER_FILE, file_col: str = "file",
            pos_col: str = "pos") -> DataFrame:
    """Only the first ``cap`` rows of each file, in file order."""
    return number_rows(df, file_col, pos_col).filter(F.col("rn") <= cap).drop("rn", "n_in_file")


def admission_cap(df: DataFrame, token_limit: int, file_col: str = "file",
                  tok_col: str = "tok") -> DataFrame:
    """A file over the cap is rejected whole; rejected logs 0, admitted logs its total."""
    per = df.groupBy(file_col).agg(F.sum(tok_col).cast("long").alias("total_tokens"),
                                   F.count(F.lit(1)).cast("long").alias("n_rows"))
    rejected = F.col("total_tokens") > F.lit(token_limit)
    return (per.withColumn("status", F.when(rejected, F.lit("rejected")).otherwise(F.lit("admitted")))
            .withColumn("logged_tokens", F.when(rejected, F.lit(0).cast("long")).otherwise(F.col("total_tokens"))))


def admitted_rows(df: DataFrame, decisions: DataFrame, file_col: str = "file") -> DataFrame:
    return df.join(decisions.filter(F.col("status") == "admitted").select(file_col), file_col, "left_semi")


def halt_prefix(files: DataFrame, failed_col: str = "failed", order_col: str = "file") -> DataFrame:
    """Files after the first failed one (in ``order_col`` order) are not processed."""
    flagged = files.withColumn("_f", F.col(failed_col).cast("long")).withColumn("_g", F.lit(0))
    s = ordered_scan(flagged, ["_g"], [order_col], "sum", value_col="_f")
    out = attach(flagged, s, ["_g", order_col], ["_run"])
    return (out.withColumn("processed", (F.col("_run") - F.col("_f")) == 0)
            .drop("_f", "_g", "_run"))


def tokens_remaining(requests: DataFrame, daily_log: DataFrame, limit: int = DAILY_TOKEN_LIMIT) -> DataFrame:
    """limit minus tokens already submitted for (date, key prefix); absent -> 0 used."""
    used = daily_log.groupBy("date", "api_key_prefix").agg(
        F.sum("tokens_submitted").cast("long").alias("used"))
    j = requests.join(used, ["date", "api_key_prefix"], "left")
    return (j.withColumn("used", F.coalesce(F.col("used"), F.lit(0).cast("long")))
            .withColumn("remaining", (F.lit(limit) - F.col("used")).cast("long")))


def budget_admission(files: DataFrame, remaining: int, tok_col: str = "total_tokens",
                     order_col: str = "file") -> DataFrame:
    """Admit files in order while their running token total fits the remaining budget."""
    g = files.withColumn("_g", F.lit(0))
    s = ordered_scan(g, ["_g"], [order_col], "sum", value_col=tok_col)
    out = attach(g, s, ["_g", order_col], ["_run"])
    return (out.withColumnRenamed("_run", "running_tokens")
            .withColumn("admitted", F.col("running_tokens") <= F.lit(remaining)).drop("_g"))
