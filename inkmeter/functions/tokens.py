"""Token counting as Column expressions.

``regex`` and ``chars4`` stay inside the JVM (whole-stage codegen).  ``bpe``
is an Arrow ``pandas_udf`` that loads a byte-pair encoding from a local
``.tiktoken`` file once per Python worker; no encoding is downloaded.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the word/punctuation pattern used by the ``regex`` counter.
# A token is a run of ASCII word characters, or any single character that is
# neither a word character nor ASCII whitespace.
TOKEN_PATTERN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r\f]"

METHODS = ("regex", "chars4", "bpe")


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_tokens(col, method: str = "regex", encoding_file: str | None = None) -> Column:
    """Token count of a string column; null counts as 0."""
    c = _as_col(col)
    if method == "regex":
        return F.coalesce(F.regexp_count(c, F.lit(TOKEN_PATTERN)).cast("long"), F.lit(0).cast("long"))
    if method == "chars4":
        return F.coalesce(F.ceil(F.length(c) / F.lit(4)).cast("long"), F.lit(0).cast("long"))
    if method == "bpe":
        if not encoding_file:
            raise ValueError("bpe counting needs a local encoding file (no download is attempted)")
        return _bpe_udf(encoding_file)(c)
    raise ValueError(f"unknown token method {method!r}; choose one of {METHODS}")


def _bpe_udf(encoding_file: str):
    @F.pandas_udf(T.LongType())
    def bpe_count(s: pd.Series) -> pd.Series:
        enc = _load_encoding(encoding_file)
        return s.fillna("").map(lambda t: len(enc.encode(t, disallowed_special=()))).astype("int64")

    return bpe_count


_ENCODINGS: dict = {}


def _load_encoding(path: str):
    """Build a tiktoken Encoding from a local rank file, cached per worker."""
    if path in _ENCODINGS:
        return _ENCODINGS[path]
    import base64

    import tiktoken

    ranks = {}
    with open(path, "rb") as fh:
        for line in fh:
            if line.strip():
                tok, rank = line.split()
                ranks[base64.b64decode(tok)] = int(rank)
    # Fixed value: the split pattern published with the cl100k_base encoding.
    pat = (r"""(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}|"""
           r""" ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+""")
    enc = tiktoken.Encoding(name="local", pat_str=pat, mergeable_ranks=ranks, special_tokens={})
    _ENCODINGS[path] = enc
    return enc


def literal_tokens(spark, text: str, method: str = "regex") -> int:
    """Count a constant (e.g. the system prompt) once, with the same engine as rows."""
    if method == "chars4":
        return -(-len(text) // 4)
    row = spark.range(1).select(count_tokens(F.lit(text), method).alias("t")).first()
    return int(row["t"])


def submitted_tokens(text_col, system_tokens: int, method: str = "regex",
                     prefix: str = "", null_as: str | None = None,
                     system_chars: int | None = None) -> Column:
    """tokens(system prompt) + tokens(user message).

    For ``regex`` the counts are additive across a whitespace boundary, so the
    system prompt is counted once on the driver; ``chars4`` is computed on the
    concatenated length.
    """
    c = _as_col(text_col).cast("string")
    if null_as is not None:
        c = F.coalesce(c, F.lit(null_as))
    msg = F.concat(F.lit(prefix), c)
    if method == "chars4":
        return F.ceil((F.length(msg) + F.lit(system_chars or 0)) / F.lit(4)).cast("long")
    return (F.lit(system_tokens) + count_tokens(msg, method)).cast("long")


def row_text(columns: list, sep: str = " ") -> Column:
    """All non-null columns cast to string and joined by a space."""
    return F.concat_ws(sep, *[_as_col(c).cast("string") for c in columns])


def chunking_tokens(columns: list, system_prompt: str, method: str = "regex",
                    system_tokens: int | None = None) -> Column:
    """D3: tokens(system prompt + newline + all columns)."""
    body = row_text(columns)
    if method == "regex" and system_tokens is not None:
        return (F.lit(system_tokens) + count_tokens(body, method)).cast("long")
    return count_tokens(F.concat(F.lit(system_prompt + "\n"), body), method)


def completion_tokens(score_col, method: str = "regex") -> Column:
    """Tokens of the answer text, '' when absent."""
    return count_tokens(F.coalesce(_as_col(score_col).cast("string"), F.lit("")), method)


def request_bytes(json_col) -> Column:
    """Serialized request size in bytes."""
    return F.octet_length(_as_col(json_col)).cast("long")
