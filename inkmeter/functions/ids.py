"""Row identity, key masking and chunk naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def row_id(file_col="file", pos_col="pos") -> Column:
    """Deterministic request id ``md5(file || '|' || pos)``; stable across retries."""
    return F.md5(F.concat_ws("|", _c(file_col).cast("string"), _c(pos_col).cast("string")))


def normalise_id(df: DataFrame, file_col: str = "file", pos_col: str = "pos") -> DataFrame:
    """``custom_id`` kept, else ``id`` cast to string, else the C1 id."""
    cols = set(df.columns)
    parts = []
    if "custom_id" in cols:
        parts.append(F.col("custom_id").cast("string"))
    if "id" in cols:
        parts.append(F.col("id").cast("string"))
    parts.append(row_id(file_col, pos_col))
    return df.withColumn("custom_id", F.coalesce(*parts))


def restore_id(df: DataFrame) -> DataFrame:
    """Add ``id`` from ``custom_id`` when the input had none."""
    if "id" in df.columns or "custom_id" not in df.columns:
        return df
    return df.withColumn("id", F.col("custom_id"))


def drop_internal(df: DataFrame, cols=("custom_id",)) -> DataFrame:
    """C4: drop internal columns; missing ones are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def mask_key(key_col) -> Column:
    """Null or shorter than 10 chars -> ``****``; else first 10 chars + ten ``*``."""
    k = _c(key_col)
    return (F.when(k.isNull() | (F.length(k) < 10), F.lit("****"))
            .otherwise(F.concat(F.substring(k, 1, 10), F.lit("*" * 10))))


def chunk_name(stem_col, part_col, split_part_col=None) -> Column:
    """``{stem}_part{n}``; a re-split chunk is ``{stem}_part{n}_split_part{m}``."""
    base = F.concat(_c(stem_col).cast("string"), F.lit("_part"), _c(part_col).cast("string"))
    if split_part_col is None:
        return base
    return F.when(_c(split_part_col).isNull(), base).otherwise(
        F.concat(base, F.lit("_split_part"), _c(split_part_col).cast("string")))
