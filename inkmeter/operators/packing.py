"""Chunk packing over row order within a file.

Every operator here goes through ``inkmeter.plans.ordered`` so that a file
holding a third of all rows is still spread over many tasks.  Inputs carry
``file`` and a unique-within-file ``pos``; outputs add ``part`` (1-based).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmeter.functions.ids import chunk_name
from inkmeter.plans.ordered import attach, hybrid_scan, ordered_scan

# Batch service limits.
MAX_REQUESTS_PER_BATCH = 50_000
MAX_BATCH_BYTES = 200 * 1024 * 1024


def number_rows(df: DataFrame, file_col: str = "file", pos_col: str = "pos",
                num_partitions: int | None = None) -> DataFrame:
    """Add ``rn`` (1-based position in file order) and ``n_in_file``."""
    s = ordered_scan(df, [file_col], [pos_col], "number", num_partitions=num_partitions)
    s = s.withColumnRenamed("_rn", "rn").withColumnRenamed("_n", "n_in_file")
    return attach(df, s, [file_col, pos_col], ["rn", "n_in_file"])


def ntile_expr(k: int, rn="rn", n="n_in_file"):
    """SQL ``ntile(k)`` from a row number and the group size."""
    rn0 = F.col(rn) - 1
    q = F.floor(F.col(n) / k)
    r = F.col(n) % k
    big = r * (q + 1)
    return (F.when(rn0 < big, F.floor(rn0 / (q + 1)) + 1)
            .otherwise(r + F.floor((rn0 - big) / F.greatest(q, F.lit(1))) + 1)).cast("long")


def chunk_forced(df: DataFrame, k: int, file_col: str = "file", pos_col: str = "pos") -> DataFrame:
    """G1: k contiguous chunks per file whose sizes differ by at most one (= ``ntile(k)``)."""
    if k < 1:
        raise ValueError("k must be >= 1")
    numbered = number_rows(df, file_col, pos_col)
    return numbered.withColumn("part", ntile_expr(k)).drop("rn", "n_in_file")


def chunk_rows(df: DataFrame, row_limit: int, file_col: str = "file", pos_col: str = "pos") -> DataFrame:
    """Consecutive chunks of ``row_limit`` rows."""
    numbered = number_rows(df, file_col, pos_col)
    return numbered.withColumn("part", (F.floor((F.col("rn") - 1) / row_limit) + 1).cast("long")).drop(
        "rn", "n_in_file")


def chunk_greedy(df: DataFrame, token_limit: int | None, row_limit: int | None = None,
                 tok_col: str = "tok", file_col: str = "file", pos_col: str = "pos",
                 group_cols: list | None = None, extra_limits: list | None = None,
                 num_partitions: int | None = None, with_position: bool = False,
                 counter=None, text_col: str = "text") -> DataFrame:
    """Next-fit packing in file order (``with_position`` also adds ``rn``, the row's
    1-based place in its file, from the same scan).

    ``counter`` (K1), any ``Column -> Column``, counts the tokens of ``text_col`` into ``tok_col``.

    A chunk is closed when adding the next row would exceed ``token_limit``
    (or any ``extra_limits`` pair ``(column, limit)``) or the chunk already has
    ``row_limit`` rows; a single oversize row gets its own chunk.
    """
    if counter is not None:
        df = df.withColumn(tok_col, counter(F.col(text_col)).cast("long"))
    groups = list(group_cols) if group_cols else [file_col]
    pack = [(tok_col, token_limit)] + list(extra_limits or [])
    s = ordered_scan(df, groups, [pos_col], "greedy", pack=pack, row_limit=row_limit,
                     num_partitions=num_partitions)
    s = s.withColumnRenamed("_part", "part")
    if with_position:
        return attach(df, s.withColumnRenamed("_rn", "rn"), groups + [pos_col], ["part", "rn"])
    return attach(df, s.drop("_rn"), groups + [pos_col], ["part"])


def chunk_sums(df: DataFrame, keys=("file", "part"), tok_col: str = "tok") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(tok_col).cast("long").alias("chunk_tokens"))


def chunk_hybrid(df: DataFrame, k: int, token_limit: int, tok_col: str = "tok",
                 file_col: str = "file", pos_col: str = "pos") -> DataFrame:
    """Forced chunks; a chunk over ``token_limit`` is re-split greedily (no row limit).

    Adds ``part``, ``split_part`` (null unless re-split).
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    s = hybrid_scan(df, [file_col], [pos_col], tok_col, k, token_limit)
    s = s.withColumnRenamed("_forced", "part").withColumnRenamed("_part", "split_part")
    return attach(df, s, [file_col, pos_col], ["part", "split_part"])


def split_gate(df: DataFrame, limit: int, file_col: str = "file", tok_col: str = "tok") -> DataFrame:
    """Per file, split only if its total tokens exceed ``limit``."""
    return df.groupBy(file_col).agg(F.sum(tok_col).cast("long").alias("total_tokens")).withColumn(
        "needs_split", F.col("total_tokens") > F.lit(limit))


def pack_requests(df: DataFrame, token_limit: int, tok_col: str = "tok", bytes_col: str = "req_bytes",
                  max_requests: int = MAX_REQUESTS_PER_BATCH, max_bytes: int = MAX_BATCH_BYTES,
                  file_col: str = "file", pos_col: str = "pos") -> DataFrame:
    """Batches within all service limits at once (requests, bytes, tokens)."""
    return chunk_greedy(df, token_limit, max_requests, tok_col, file_col, pos_col,
                        extra_limits=[(bytes_col, max_bytes)])


def with_chunk_names(df: DataFrame, stem_col: str = "file", part_col: str = "part",
                     split_col: str | None = None) -> DataFrame:
    """Chunk id column from stem, part and optional re-split part."""
    return df.withColumn("chunk_id", chunk_name(stem_col, part_col, split_col))
