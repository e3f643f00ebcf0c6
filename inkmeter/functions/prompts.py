"""Prompt and request construction.

The system prompt is one value per run.  It is built from the examples
table with Spark (trim, drop blanks, order, join), checked against a size
bound, then used as a literal so Catalyst folds it and its token count is
computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prompt texts, message prefix and placeholder of the grading contract.
USER_PREFIX = "Please evaluate the following text: "
PLACEHOLDER = "{dynamic_examples}"
TEMPLATE_WITH_EXAMPLES = (
    "You are an evaluator trying to determins the closeness of a response to a given style, "
    "examples of which will follow. Given the following examples, evaluate whether or not the "
    "response matches the target style.\n\n"
    "Examples:\n{dynamic_examples}\n\n"
    "Scoring should be as follows:\n"
    "5 - Perfect match\n"
    "4 - Very close\n"
    "3 - Somewhat close\n"
    "2 - Not close\n"
    "1 - No match\n\n"
    "Output only the numerical scores, one per line, in the same order as inputs."
)
GENERIC_PROMPT = (
    "You are an evaluator. Given the following message, rate its overall quality on a scale of 1 to 5.\n\n"
    "The scale is as follows:\n"
    "5 - Excellent\n"
    "4 - Good\n"
    "3 - Average\n"
    "2 - Poor\n"
    "1 - Very poor\n\n"
    "Output only the numerical score."
)
DEFAULT_EXAMPLES_TEXT = ("This file would contain examples of the target style. If you want it to be "
                         "used in the prompt, add it to the config.yaml file.")
DEFAULT_ENDPOINT = "/v1/chat/completions"
DEFAULT_MODEL = "gpt-4o-mini-2024-07-18"
DEFAULT_MAX_TOKENS = 1000

# Whitespace removed around example lines.
STRIP_CHARS = " \t\n\r\f\x0b"

# Upper bound for the examples block: it is sent with every request.
MAX_EXAMPLES_BYTES = 1 << 20


def user_prompt(text_col, null_as: str | None = "nan") -> Column:
    """The user message; a null text becomes ``null_as`` (``nan`` = parity)."""
    c = (F.col(text_col) if isinstance(text_col, str) else text_col).cast("string")
    if null_as is not None:
        c = F.coalesce(c, F.lit(null_as))
    return F.concat(F.lit(USER_PREFIX), c)


def example_lines(text_df: DataFrame, text_col: str = "value", order_cols=("pos",)) -> DataFrame:
    """A10: examples as ordered lines; strip each line and drop blank ones.

    ``text_df`` holds one or more lines per row; embedded newlines split lines.
    Output: order columns + ``line_no`` + ``line``.
    """
    exploded = text_df.select(*order_cols, F.posexplode(F.split(F.col(text_col), "\n")).alias(
        "line_no", "raw"))
    return (exploded.select(*order_cols, "line_no", F.btrim(F.col("raw"), F.lit(STRIP_CHARS)).alias("line"))
            .filter(F.col("line") != ""))


def examples_block(lines: DataFrame, order_cols=("pos",), group_cols=()) -> DataFrame:
    """``block``: ``- `` + line, joined by newline, in order; plus size stats.

    One row, or one per group: a large examples table is many examples files, each a group of bounded size.
    """
    ordered = F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in order_cols], F.col("line_no"),
                                                     F.col("line"))))
    return lines.groupBy(*group_cols).agg(
        F.array_join(F.transform(ordered, lambda s: F.concat(F.lit("- "), s["line"])), "\n").alias("block"),
        F.count("*").alias("n_lines"),
        F.coalesce(F.sum(F.octet_length("line") + 3), F.lit(0)).cast("long").alias("n_bytes"),
    )


def check_examples_size(lines: DataFrame, max_bytes: int = MAX_EXAMPLES_BYTES) -> None:
    """Refuse an examples table larger than one prompt may carry (checked before collecting)."""
    stats = lines.agg(F.count("*").alias("n"),
                      F.coalesce(F.sum(F.octet_length("line") + 3), F.lit(0)).alias("b")).first()
    if stats["b"] > max_bytes:
        raise ValueError(f"examples block of {stats['b']} bytes exceeds the {max_bytes}-byte bound")


def render_system_prompt(block: str | None, template: str = TEMPLATE_WITH_EXAMPLES,
                         is_default: bool = False) -> str:
    """Generic prompt when examples are absent/default, else the filled template."""
    if block is None or is_default:
        return GENERIC_PROMPT
    if block == "":
        raise ValueError("no examples found")
    if PLACEHOLDER not in template:
        raise ValueError(f"'{PLACEHOLDER}' placeholder missing in prompt template.")
    # Plain replacement: other braces in a template are kept as they are.
    return template.replace(PLACEHOLDER, block)


def system_prompt_from_lines(lines: DataFrame | None, template: str = TEMPLATE_WITH_EXAMPLES,
                             order_cols=("pos",), max_bytes: int = MAX_EXAMPLES_BYTES) -> str:
    """Build the system prompt string from an examples-lines DataFrame (bounded size)."""
    if lines is None:
        return GENERIC_PROMPT
    check_examples_size(lines, max_bytes)
    row = examples_block(lines, order_cols).first()
    if row["n_lines"] == 0:
        raise ValueError("no examples found")
    block = row["block"]
    is_default = block == "- " + DEFAULT_EXAMPLES_TEXT
    return render_system_prompt(block, template, is_default)


def system_prompt_and_tokens(lines: DataFrame | None, method: str = "regex", order_cols=("pos",),
                             template: str = TEMPLATE_WITH_EXAMPLES,
                             max_bytes: int = MAX_EXAMPLES_BYTES) -> tuple[str, int]:
    """The system prompt and its token count: a size check, then one aggregation."""
    from inkmeter.functions.tokens import count_tokens

    if lines is None:
        text = GENERIC_PROMPT
        return text, int(constant_tokens(text, method))
    check_examples_size(lines, max_bytes)
    blk = examples_block(lines, order_cols)
    row = blk.select("block", "n_lines",
                     count_tokens(system_prompt_column("block", template), method).alias("t")).first()
    if row["n_lines"] == 0:
        raise ValueError("no examples found")
    block = row["block"]
    text = render_system_prompt(block, template, block == "- " + DEFAULT_EXAMPLES_TEXT)
    return text, int(row["t"])


def constant_tokens(text: str, method: str) -> int:
    """Token count of a constant prompt computed on the driver for the built-in counters."""
    import re

    from inkmeter.functions.tokens import TOKEN_PATTERN

    if method == "chars4":
        return -(-len(text) // 4)
    if method == "regex":
        return len(re.findall(TOKEN_PATTERN, text))
    raise ValueError("bpe counting of a constant needs a Spark session; use tokens.literal_tokens")


def system_prompt_column(block_col, template: str = TEMPLATE_WITH_EXAMPLES) -> Column:
    """C7 as an expression over a block column (for one-row tables)."""
    b = F.col(block_col) if isinstance(block_col, str) else block_col
    if PLACEHOLDER not in template:
        raise ValueError(f"'{PLACEHOLDER}' placeholder missing in prompt template.")
    return (F.when(b.isNull() | (b == F.lit("- " + DEFAULT_EXAMPLES_TEXT)), F.lit(GENERIC_PROMPT))
            .otherwise(F.replace(F.lit(template), F.lit(PLACEHOLDER), b)))


def request_struct(custom_id_col, text_col, system_prompt: str, model: str = DEFAULT_MODEL,
                   endpoint: str = DEFAULT_ENDPOINT, max_tokens: int = DEFAULT_MAX_TOKENS,
                   null_as: str | None = "nan") -> Column:
    """The request as a struct (custom_id, method, url, body{model, messages, max_tokens})."""
    cid = F.col(custom_id_col) if isinstance(custom_id_col, str) else custom_id_col
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
        F.struct(F.lit("user").alias("role"), user_prompt(text_col, null_as).alias("content")),
    )
    body = F.struct(F.lit(model).alias("model"), messages.alias("messages"),
                    F.lit(max_tokens).alias("max_tokens"))
    return F.struct(cid.alias("custom_id"), F.lit("POST").alias("method"),
                    F.lit(endpoint).alias("url"), body.alias("body"))


def request_json(custom_id_col, text_col, system_prompt: str, **kw) -> Column:
    """C8 serialized: one JSON line per request."""
    return F.to_json(request_struct(custom_id_col, text_col, system_prompt, **kw))


def escaped_length(spark, text: str) -> int:
    """Bytes ``text`` occupies inside a JSON string (after escaping), counted by Spark's own writer."""
    row = spark.range(1).select(F.octet_length(F.to_json(F.struct(F.lit(text).alias("c")))).alias("n")).first()
    return int(row["n"]) - len('{"c":""}')


def request_bytes_column(custom_id_col, text_col, system_prompt: str, system_escaped_len: int, **kw) -> Column:
    """D5 without building the full request: the JSON with an empty system message plus the
    escaped prompt's length (the prompt is identical in every request, so it is measured once)."""
    return (F.octet_length(request_json(custom_id_col, text_col, "", **kw))
            + F.lit(system_escaped_len)).cast("long")
