"""Mixing sources to target weights by temperature (DataFrame functions only).

A source with token share p gets a weight in proportion to p ** a.  The
exponent a lies between 1 (natural shares) and 0 (equal weights) and is
found by bisection, folded inside one SQL expression over the per-source
totals: the smallest a whose most repeated source is read at most
``max_epochs`` times, the largest a whose weights reach ``target_entropy``
(as a share of the entropy of equal weights); given both, the repetition
limit prevails.

``budget`` is the number of tokens of the mixture.  Without one the budget is
the smallest that reads every source at least once, so nothing is dropped.

Realisation.  The documents of a source are dealt into ``BLOCKS`` blocks by a
hash.  A source's quota of tokens is met by whole passes over its blocks,
each pass in another seeded permutation, and by the head of one further
permutation, as many blocks as fit into what is left.  ``mix_key`` (0 to 1)
places each block in the mixture at the share of its source's quota that was
read before its middle; in that order every stretch of the mixture keeps the
weights.  Only sums per (source, block) are shuffled; the documents meet the
plan, one row per (source, block), in a broadcast join while it is small.

Defined results: null text has no tokens; a null source is a source of its
own; a source without tokens has weight 0 and is read once; repeated rows
count as often as they occur; an empty table gives an empty mixture; extra
columns are kept by :func:`mixed` and ignored by :func:`mixture`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmeter.llm.common import kept, whole_row

BLOCKS = 256
SEED = "mix-1"
STEPS = 60
#: Rows of the plan that may be broadcast (a row is under 100 bytes an epoch).
BROADCAST_ROWS = 200_000


def tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash32(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def _block(doc_id: Column, text: Column, blocks: int) -> Column:
    return _hash32(F.concat_ws("|", F.lit(SEED), doc_id.cast("string"), text)) % blocks


def _source(source: Column) -> Column:
    """Sources as text, null apart from every name."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("?"))


def _weights(shares: Column, a: Column) -> Column:
    powers = F.transform(shares, lambda p: F.pow(p, a))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.get(F.transform(F.array(F.struct(powers.alias("p"), total.alias("t"))),
                             lambda z: F.transform(z["p"], lambda x: x / z["t"])), F.lit(0))


def _entropy(shares: Column, a: Column) -> Column:
    return F.aggregate(_weights(shares, a), F.lit(0.0), lambda s, w: s - F.when(w > 0, w * F.log(w)).otherwise(0.0))


def _repetition(shares: Column, a: Column, scale: Column) -> Column:
    """Passes over the most repeated source; ``scale`` is budget / tokens, or null for the smallest whole budget."""
    passes = F.get(F.transform(F.array(_weights(shares, a)),
                               lambda w: F.transform(F.arrays_zip(w.alias("w"), shares.alias("p")),
                                                     lambda z: z["w"] / z["p"])), F.lit(0))
    return F.coalesce(scale * F.array_max(passes), F.array_max(passes) / F.array_min(passes))


def _bisect(goes_up, below: float = 0.0, above: float = 1.0) -> Column:
    """(lo, hi) after STEPS halvings; ``goes_up(mid)`` is true where the answer lies above mid."""
    start = F.struct(F.lit(below).alias("lo"), F.lit(above).alias("hi"))

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        up = goes_up(mid)
        return F.struct(F.when(up, mid).otherwise(acc["lo"]).alias("lo"),
                        F.when(up, acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)


def source_weights(totals: DataFrame, max_epochs: float | None = None, target_entropy: float | None = None,
                   budget: int | None = None) -> DataFrame:
    """(src, tokens, weight, quota, exponent) from (src, tokens); the totals are one row per source."""
    one = totals.where("tokens > 0").agg(F.array_sort(F.collect_list(F.struct("src", "tokens"))).alias("all"),
                                         F.sum("tokens").cast("double").alias("total"))
    shares = F.col("shares")
    scale = F.lit(None).cast("double") if budget is None else F.lit(float(budget)) / F.col("total")
    one = one.where(F.size("all") > 0).select(
        "all", "total", F.explode(F.array(F.transform("all", lambda x: x["tokens"] / F.col("total")))).alias("shares"))
    a = F.lit(0.0) if max_epochs is None and target_entropy is None else None
    if target_entropy is not None:
        goal = F.lit(float(target_entropy)) * F.log(F.size(shares).cast("double"))
        a = F.when(_entropy(shares, F.lit(1.0)) >= goal, F.lit(1.0)).otherwise(
            _bisect(lambda mid: _entropy(shares, mid) >= goal)["lo"])
    if max_epochs is not None:
        least = _bisect(lambda mid: _repetition(shares, mid, scale) > float(max_epochs))["hi"]
        a = least if a is None else F.greatest(a, least)
    one = one.select("all", "total", "shares", F.explode(F.array(F.round(a, 9))).alias("a"))
    one = one.select("all", "total", "a", F.explode(F.array(_weights(shares, F.col("a")))).alias("w"))
    rows = one.select("total", "a", F.explode(F.arrays_zip("all", "w")).alias("z"), "w", "all")
    whole = F.array_max(F.transform(F.arrays_zip("all", "w"), lambda z: z["all"]["tokens"] / z["w"]))
    size = whole if budget is None else F.lit(float(budget))
    return rows.select(F.col("z.all.src").alias("src"), F.col("z.all.tokens").alias("tokens"),
                       F.col("z.w").alias("weight"), (F.col("z.w") * size).alias("quota"), F.col("a").alias("exponent"))


def block_plan(parts: DataFrame, weights: DataFrame) -> DataFrame:
    """(src, block, epochs): for each block the passes that read it, with its place in the mixture.

    ``parts`` has the tokens of each (src, block); the windows run over the blocks of one source, at most BLOCKS rows
    a pass.
    """
    passes = weights.withColumn("full", F.floor(F.col("quota") / F.col("tokens") + 1e-9).cast("long"))
    passes = passes.select("src", "tokens", "quota", "full", F.explode(F.sequence(F.lit(0).cast("long"), "full")).alias("epoch"))
    rows = parts.withColumnRenamed("tokens", "size").join(passes, "src").withColumn(
        "turn", F.md5(F.concat_ws("|", F.lit(SEED), "src", "epoch", "block")))
    upto = Window.partitionBy("src", "epoch").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(upto))
    left = F.col("quota") - F.col("full") * F.col("tokens") + F.lit(1e-6)
    rows = rows.where((F.col("epoch") < F.col("full")) | (F.col("upto") <= left))
    key = (F.col("epoch") * F.col("tokens") + F.col("upto") - F.col("size") / 2) / F.col("quota")
    rows = rows.select("src", "block", F.struct("epoch", F.round(F.least(key, F.lit(1.0)), 9).alias("mix_key")).alias("e"))
    planned = rows.groupBy("src", "block").agg(F.array_sort(F.collect_list("e")).alias("epochs"))
    once = F.array(F.struct(F.lit(0).cast("long").alias("epoch"), F.lit(0.0).alias("mix_key")))
    weightless = parts.groupBy("src").agg(F.sum("tokens").alias("t")).where("t = 0").select("src")
    free = parts.join(weightless, "src", "left_semi").select("src", "block", once.alias("epochs"))
    return planned.unionByName(free)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _plan(docs: DataFrame, limits: dict, blocks: int) -> tuple[DataFrame, DataFrame]:
    """(narrow rows, plan), both written once."""
    narrow = kept(docs.select("doc_id", "source", _source(F.col("source")).alias("src"),
                              _block(F.col("doc_id"), F.col("text"), blocks).alias("block"),
                              tokens(F.col("text")).alias("n_tokens")), "mix-rows")
    parts = kept(narrow.groupBy("src", "block").agg(F.sum("n_tokens").alias("tokens")), "mix-blocks")
    totals = parts.groupBy("src").agg(F.sum("tokens").alias("tokens"))
    weights = kept(source_weights(totals, **limits), "mix-weights")
    return narrow, kept(block_plan(parts, weights), "mix-plan")


def mixture(docs: DataFrame, max_epochs: float | None = 1.5, target_entropy: float | None = None,
            budget: int | None = None, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, mix_key: one row per reading of a document."""
    limits = {"max_epochs": max_epochs, "target_entropy": target_entropy, "budget": budget}
    narrow, plan = _plan(docs, limits, blocks)
    out = narrow.join(_small(plan), ["src", "block"]).withColumn("e", F.explode("epochs"))
    return out.select("doc_id", "source", "n_tokens", "e.epoch", "block", "e.mix_key")


def mixed(docs: DataFrame, max_epochs: float | None = 1.5, target_entropy: float | None = None,
          budget: int | None = None, blocks: int = BLOCKS) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture reads it."""
    limits = {"max_epochs": max_epochs, "target_entropy": target_entropy, "budget": budget}
    _, plan = _plan(docs, limits, blocks)
    plan = plan.select("src", "block", F.size("epochs").alias("times"))
    rows = docs.select(whole_row(docs), _source(F.col("source")).alias("src"),
                       _block(F.col("doc_id"), F.col("text"), blocks).alias("block"))
    out = rows.join(_small(plan), ["src", "block"]).select("row", F.explode(F.sequence(F.lit(1), "times")))
    return out.select("row.*")
