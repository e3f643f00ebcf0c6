"""Answer lines: parse, classify, dedupe.

A line is one JSON object.  Classification follows the service contract:

* ``response`` truthy and ``error`` not -> the answer at
  ``response.body.choices[0].message.content``; a missing path is
  ``Error: Malformed response data``; a JSON null answer stays null (the
  join-back turns it into the fallback error);
* else ``error`` truthy -> ``Error: {code} - {message}`` (defaults ``N/A``,
  ``Unknown error``);
* else ``Error: Unknown structure in output item``.

"Truthy" follows the contract's JSON semantics: null, ``{}``, ``[]``, ``""``,
``0`` and ``false`` count as absent, so the raw node text is inspected
(``from_json`` would turn ``{}`` into a non-null struct of nulls).
Everything is built-in JSON functions; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmeter.functions import keybits

# Error texts of the answer contract.
MALFORMED = "Error: Malformed response data"
UNKNOWN = "Error: Unknown structure in output item"
NOT_FOUND = "Error: Result not found in batch output"
FALLBACK = "Error: No result found for custom_id (fallback)"
UNREADABLE = "Error: Failed to retrieve/parse batch output file"
NO_OUTPUT = "Error: Batch completed with no output file"
STATUS_PREFIX = "Error: Batch job status - "

_FALSY = ["{}", "[]", "", "0", "0.0", "false"]


def _lookup(path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(F.col("_v"), path, kind)


def _as_text(node: str, path: str) -> Column:
    """A value as text, null for a JSON null: strings as they are, anything else as the line writes it (only then is
    the line read again)."""
    v = F.col(node)
    return (F.when(v.isNull() | F.is_variant_null(v), F.lit(None).cast("string"))
            .when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
            .otherwise(F.get_json_object("_line", path)))


def _present(node: str) -> Column:
    """Whether a JSON value counts as present.  The texts ``"0"``, ``"false"``, ``"{}"`` are told from the literals by
    their type, which is looked at only where the text leaves it open."""
    v = F.col(node)
    raw = F.try_variant_get(v, "$", "string")
    return (F.when(v.isNull() | F.is_variant_null(v), F.lit(False)).when(raw == "", F.lit(False))
            .when(raw.isin(*_FALSY), F.schema_of_variant(v) == "STRING").otherwise(F.lit(True)))


ANSWER = "$.response.body.choices[0].message.content"
FIELDS = ("custom_id", "llm_score", "error_type", "error_message", "corrupt")


def classified(df: DataFrame, line_col: str = "value") -> DataFrame:
    """``df`` plus custom_id, llm_score, error_type, error_message and corrupt of each line (as one struct ``_c``).

    The steps are projections of their own, so that a line is parsed once, every node is looked up once and every
    decision is made once, however often the next step refers to it.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    parsed = df.select(*keep, F.col(line_col).alias("_line"), F.try_parse_json(F.col(line_col)).alias("_v"))
    found = parsed.select(*keep, "_line", F.col("_v").isNull().alias("_bad_line"), _lookup("$.custom_id").alias("_id"),
                          _lookup("$.response").alias("_resp"), _lookup("$.error").alias("_err"), _lookup(ANSWER).alias("_ans"),
                          _lookup("$.error.code").alias("_code"), _lookup("$.error.message").alias("_msg"))
    held = found.select(*keep, "_line", "_bad_line", "_ans", "_code", "_msg", "_id", _present("_err").alias("_failed"),
                        # an answer that is there makes the response one that is not empty
                        F.when(F.col("_ans").isNotNull(), F.lit(True)).otherwise(_present("_resp")).alias("_answered"))

    def field(node: str, name: str, default: str) -> Column:
        """A field of the error object; a null value reads ``None``, a missing one the default."""
        return F.when(F.col(node).isNull(), F.lit(default)).otherwise(
            F.coalesce(_as_text(node, f"$.error.{name}"), F.lit("None")))

    bad = F.col("_failed")
    texts = held.select(*keep, "_bad_line", "_failed", (F.col("_answered") & ~bad).alias("_ok"), F.col("_ans").isNotNull().alias("_has"),
                        _as_text("_ans", ANSWER).alias("_content"), _as_text("_id", "$.custom_id").alias("_cid"),
                        F.when(bad, field("_code", "code", "N/A")).alias("_code"),
                        F.when(bad, field("_msg", "message", "Unknown error")).alias("_msg"))
    corrupt, ok, has, content = F.col("_bad_line"), F.col("_ok"), F.col("_has"), F.col("_content")
    score = (F.when(corrupt, F.lit(None).cast("string"))
             .when(ok & has, content)
             .when(ok, F.lit(MALFORMED))
             .when(bad, F.concat(F.lit("Error: "), F.col("_code"), F.lit(" - "), F.col("_msg")))
             .otherwise(F.lit(UNKNOWN)))
    etype = (F.when(corrupt, F.lit("CorruptLine"))
             .when(ok & has & content.isNull(), F.lit("NullContent"))
             .when(ok & has, F.lit(None).cast("string"))
             .when(ok, F.lit("Malformed"))
             .when(bad, F.lit("ApiError"))
             .otherwise(F.lit("UnknownStructure")))
    parts = (F.col("_cid"), score, etype, F.when(bad & ~ok, F.col("_msg")), corrupt)
    return texts.select(*keep, F.struct(*[c.alias(n) for c, n in zip(parts, FIELDS)]).alias("_c"))


def parse_lines(lines: DataFrame, line_col: str = "value", keep=()) -> DataFrame:
    """D6/D7 over every non-blank line; ``keep`` carries order columns."""
    nonblank = lines.filter(F.trim(F.col(line_col)) != "").select(*keep, F.col(line_col).alias("_text"))
    return classified(nonblank, "_text").select(*keep, "_c.*")


def with_id(parsed: DataFrame) -> DataFrame:
    """C14: lines without a usable ``custom_id`` are skipped (see ``no_id_audit``)."""
    return parsed.filter(F.col("custom_id").isNotNull() & (F.col("custom_id") != ""))


def no_id_audit(parsed: DataFrame) -> DataFrame:
    """Count of skipped lines, by reason."""
    reason = (F.when(F.col("corrupt"), F.lit("corrupt"))
              .when(F.col("custom_id").isNull(), F.lit("missing_id"))
              .when(F.col("custom_id") == "", F.lit("empty_id")))
    return (parsed.select(reason.alias("reason")).filter(F.col("reason").isNotNull())
            .groupBy("reason").agg(F.count(F.lit(1)).cast("long").alias("n_lines")))


def readability(parsed: DataFrame, batch_col: str) -> DataFrame:
    """Strict mode: an answer file with any unparsable line is unreadable as a whole.

    Output: ``batch_col``, ``output_readable`` (feeds ``results.batch_status_rows``).
    """
    return parsed.groupBy(batch_col).agg((~F.bool_or(F.col("corrupt"))).alias("output_readable"))


def dedupe_last(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """Last write wins per key in (order_cols) order.

    Most ids come once.  A hash aggregate counts the keys' 64-bit hashes; those that come more than once set bits of a
    bitmap of at most 16 MB, which is broadcast.  Rows whose bit is not set are the only ones of their key and pass
    through without a shuffle or a sort; only the others go to ``max_by``, which reduces them inside each task first.
    A bitmap that is too small for all repeated keys sends more rows that way and changes no result.

    ``df`` is read three times: hand over something cheap to read, such as a checkpointed table.  Null keys are a key.
    """
    others = [c for c in df.columns if c != key]
    hashed = df.select("*", F.xxhash64(F.col(key)).alias("_key_hash"))
    repeated = hashed.groupBy("_key_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_key_hash")
    marked = keybits.marked(hashed, "_key_hash", keybits.bitmaps(repeated, "_key_hash"), "_again")
    once = marked.filter(~F.col("_again")).select(key, *others)
    order = F.struct(*[F.col(c) for c in order_cols])
    picked = marked.filter("_again").groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in others]), order).alias("_w"))
    return once.unionByName(picked.select(key, *[F.col("_w")[c].alias(c) for c in others]))


# Forms of a score: a whole number, alone or after the label.
SCORE_FORM = r"^\s*(?:[Ss]core:\s*)?([0-9]+)\s*$"


def parse_score(col, low: int = 1, high: int = 5, error_type=None) -> Column:
    """An answer that is a whole number (or ``Score: n``) within [low, high]; signs, decimals and other text
    give null, as does a row with an ``error_type``."""
    c = F.col(col) if isinstance(col, str) else col
    v = F.regexp_extract(c, SCORE_FORM, 1).try_cast("int")
    ok = v.between(low, high)
    return F.when(ok if error_type is None else ok & F.col(error_type).isNull(), v)


def parse_score_lines(df: DataFrame, col: str, keys: list[str], low: int = 1, high: int = 5) -> DataFrame:
    """D10 multi-line form: one score per answer line -> (keys, line_no, score)."""
    exploded = df.select(*keys, F.posexplode(F.split(F.col(col), "\n")).alias("line_no", "line"))
    return exploded.select(*keys, (F.col("line_no") + 1).cast("long").alias("line_no"),
                           parse_score("line", low, high).alias("score"))
