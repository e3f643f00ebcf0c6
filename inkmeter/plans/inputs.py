"""How the driver's test tables map onto the grading data model.

* input files: ``documents`` with ``file = source``, ``pos = doc_id``,
  ``id = doc_id``, text column ``text``;
* a second input shape: ``conversations`` turns with
  ``file = conv_id``, ``pos = turn``;
* examples: every ``benchmark`` text, split into lines, in ``item_id`` order,
  EXAMPLES_PER_FILE items to an examples file;
* usage events: ``events`` (key, model, tokens derived per row).

Each helper reads only the columns it needs, so parquet scans stay pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmeter.functions import prompts, tokens

TEXT = "text"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input rows: file, pos, id, text (+ lang, n_chars carried along)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("file"), F.col("doc_id").alias("pos"),
                    F.col("doc_id").alias("id"), "text", "lang", "n_chars")


def conversations_as_files(spark: SparkSession, sf_dir: str, role: str | None = None) -> DataFrame:
    """Turns as input rows; ``role`` keeps one speaker (the token counter's setting is the assistant)."""
    c = table(spark, sf_dir, "conversations")
    c = c if role is None else c.filter(F.col("role") == role)
    return c.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("file"),
                    F.col("turn").alias("pos"), "text")


def example_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), "text")
    return prompts.example_lines(b, "text", ("pos",))


# Items per examples file: the ``benchmark`` table is read as many small examples files.
EXAMPLES_PER_FILE = 50


class Prompt:
    """The run's system prompt: the generic one, a constant, so requests do not grow with any table."""

    def __init__(self, method: str = "regex"):
        self.text = prompts.GENERIC_PROMPT
        self.tokens = prompts.constant_tokens(self.text, method)
        self.method = method

    def submitted(self, text_col="text") -> "F.Column":
        return tokens.submitted_tokens(text_col, self.tokens, self.method, prompts.USER_PREFIX,
                                       null_as="nan", system_chars=len(self.text))


def usage_events(spark: SparkSession, sf_dir: str, strict_models: bool = False) -> DataFrame:
    """Usage events derived from ``events``.

    key = ``sk-`` + user_id*7919 (short keys mask to ``****``), model from the
    event type (``error`` events use a model missing from the price list unless
    ``strict_models``), input = floor(value), output = event_id % 100.
    """
    e = table(spark, sf_dir, "events")
    model = (F.when(F.col("event_type") == "view", F.lit("gpt-4o-mini-2024-07-18"))
             .when(F.col("event_type") == "click", F.lit("gpt-4.1-2025-04-14"))
             .when(F.col("event_type") == "purchase", F.lit("o3-2025-04-16"))
             .when(F.col("event_type") == "signup", F.lit("gpt-4.1-nano-2025-04-14"))
             .otherwise(F.lit("o1-2024-12-17" if strict_models else "unpriced-model")))
    inp = F.floor(F.col("value")).cast("long")
    out = (F.col("event_id") % 100).cast("long")
    return e.select(
        F.col("event_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("sk-"), (F.col("user_id") * 7919).cast("string")).alias("api_key"),
        model.alias("model"),
        inp.alias("input_tokens"),
        out.alias("output_tokens"),
        (inp + out).alias("total_tokens"),
        F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"),
    )
