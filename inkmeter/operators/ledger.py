"""Cost and usage ledger.

Prices are a small dimension (one row per model); Spark broadcasts them by
their size.  Usage aggregates are hash aggregates with partial
aggregation; the three report breakdowns come from one ``GROUPING SETS``
pass instead of three scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmeter.functions.ids import mask_key

def _prices(pricing: DataFrame) -> DataFrame:
    return pricing.select(F.col("Model").alias("model"), F.col("Input").alias("_p_in"),
                          F.col("Output").alias("_p_out"))


def cost_expr(in_col="input_tokens", out_col="output_tokens", p_in="_p_in", p_out="_p_out"):
    """(in * p_in + out * p_out) / 1e6, rounded to 6 places."""
    return F.round((F.col(in_col) * F.col(p_in) + F.col(out_col) * F.col(p_out)) / F.lit(1_000_000.0), 6)


def cost_lenient(events: DataFrame, pricing: DataFrame) -> DataFrame:
    """unknown model costs 0.0."""
    j = events.join(_prices(pricing), "model", "left")
    return (j.withColumn("cost", cost_expr(p_in="_p_in", p_out="_p_out"))
            .withColumn("cost", F.coalesce(F.col("cost"), F.lit(0.0))).drop("_p_in", "_p_out"))


def price_of(pricing: DataFrame, model: str) -> tuple[float, float] | None:
    """Point lookup of one model's (input, output) price; None when unpriced."""
    row = pricing.filter(F.col("Model") == model).select("Input", "Output").first()
    return None if row is None else (float(row["Input"]), float(row["Output"]))


def with_model_cost(df: DataFrame, pricing: DataFrame, model: str, strict: bool = False) -> DataFrame:
    """Lenient/strict cost when every row uses the same model: a scalar lookup, no join."""
    price = price_of(pricing, model)
    if price is None:
        if strict:
            raise ValueError(f"Model '{model}' not found in pricing table.")
        return df.withColumn("cost", F.lit(0.0))
    p_in, p_out = price
    return df.withColumn("cost", F.round((F.col("input_tokens") * F.lit(p_in) + F.col("output_tokens")
                                          * F.lit(p_out)) / F.lit(1_000_000.0), 6))


def cost_strict(events: DataFrame, pricing: DataFrame) -> DataFrame:
    """an unknown model raises (``raise_error`` inside the plan)."""
    j = events.join(_prices(pricing), "model", "left")
    missing = F.concat(F.lit("Model '"), F.col("model"), F.lit("' not found in pricing table."))
    c = F.when(F.col("_p_in").isNull() | F.col("_p_out").isNull(), F.raise_error(missing).cast("double")) \
        .otherwise((F.col("input_tokens") / F.lit(1_000_000.0)) * F.col("_p_in")
                   + (F.col("output_tokens") / F.lit(1_000_000.0)) * F.col("_p_out"))
    return j.withColumn("cost", c).drop("_p_in", "_p_out")


def usage_events(events: DataFrame, pricing: DataFrame) -> DataFrame:
    """B4 payload: timestamp, masked key, model, tokens, cost (lenient), request id."""
    priced = cost_lenient(events, pricing)
    return priced.select(
        "timestamp", mask_key("api_key").alias("api_key_prefix"), "model", "input_tokens",
        "output_tokens", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        "cost", "request_id")


def in_range(events: DataFrame, start: str | None = None, end: str | None = None,
             ts_col: str = "timestamp") -> DataFrame:
    """Inclusive day range on the event timestamp; either bound optional."""
    d = F.to_date(F.col(ts_col))
    out = events
    if start:
        out = out.filter(d >= F.to_date(F.lit(start)))
    if end:
        out = out.filter(d <= F.to_date(F.lit(end)))
    return out


def _sums():
    return [F.sum("total_tokens").cast("long").alias("tokens"),
            F.round(F.sum("cost"), 6).alias("cost"),
            F.count(F.lit(1)).cast("long").alias("count")]


def usage_total(events: DataFrame, start=None, end=None) -> DataFrame:
    """Grand totals over a range (0 tokens / 0.0 cost when empty)."""
    e = in_range(events, start, end)
    return e.agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("total_tokens"),
                 F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("total_cost"),
                 F.count(F.lit(1)).cast("long").alias("count"))


def usage_by(events: DataFrame, group_by: str = "day", start=None, end=None) -> DataFrame:
    """Breakdown by ``day``, ``model`` or ``all``."""
    e = in_range(events, start, end)
    if group_by == "day":
        key = F.date_format(F.col("timestamp"), "yyyy-MM-dd")
    elif group_by == "model":
        key = F.col("model")
    elif group_by == "all":
        key = F.lit("all")
    else:
        raise ValueError("group_by must be day, model or all")
    return e.groupBy(key.alias("key")).agg(*_sums())


def usage_grouping_sets(events: DataFrame, start=None, end=None) -> DataFrame:
    """Day, model and grand-total breakdowns in one aggregation pass."""
    e = in_range(events, start, end).withColumn("day", F.date_format(F.col("timestamp"), "yyyy-MM-dd"))
    g = F.grouping_id("day", "model")
    return (e.groupingSets([["day"], ["model"], []], "day", "model")
            .agg(g.alias("_gid"), *_sums())
            .select(F.when(F.col("_gid") == 1, F.lit("day")).when(F.col("_gid") == 2, F.lit("model"))
                    .otherwise(F.lit("all")).alias("grouping"),
                    F.coalesce("day", "model", F.lit("all")).alias("key"), "tokens", "cost", "count"))


def breakdowns(per: DataFrame) -> DataFrame:
    """E8 over a table already summed to (day, model): tokens, cost, count."""
    g = F.grouping_id("day", "model")
    return (per.groupingSets([["day"], ["model"], []], "day", "model")
            .agg(g.alias("_gid"), F.sum("tokens").cast("long").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"),
                 F.sum("count").cast("long").alias("count"))
            .select(F.when(F.col("_gid") == 1, F.lit("day")).when(F.col("_gid") == 2, F.lit("model"))
                    .otherwise(F.lit("all")).alias("grouping"),
                    F.coalesce("day", "model", F.lit("all")).alias("key"), "tokens", "cost", "count"))


def total_cost(events: DataFrame, start=None, end=None) -> DataFrame:
    """E9."""
    return usage_total(events, start, end).select("total_cost")


def daily_submitted(events: DataFrame, tokens_col: str = "input_tokens") -> DataFrame:
    """Tokens submitted per (day, key prefix)."""
    return (events.groupBy(F.to_date("timestamp").alias("date"), mask_key("api_key").alias("api_key_prefix"))
            .agg(F.sum(tokens_col).cast("long").alias("tokens_submitted")))


def usage_for_day(lookups: DataFrame, daily_log: DataFrame) -> DataFrame:
    """Tokens submitted for each looked-up (date, key prefix); 0 when absent."""
    log = daily_log.groupBy("date", "api_key_prefix").agg(F.sum("tokens_submitted").alias("_t"))
    return (lookups.join(log, ["date", "api_key_prefix"], "left")
            .withColumn("tokens_submitted", F.coalesce(F.col("_t"), F.lit(0)).cast("long")).drop("_t"))


def daily_upsert(old_log: DataFrame, delta: DataFrame) -> DataFrame:
    """Add a delta to (date, key prefix); insert when absent."""
    cols = ["date", "api_key_prefix", "tokens_submitted"]
    return (old_log.select(*cols).unionByName(delta.select(*cols))
            .groupBy("date", "api_key_prefix")
            .agg(F.sum("tokens_submitted").cast("long").alias("tokens_submitted")))
