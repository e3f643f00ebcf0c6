"""Scoring rows as distributed Python batches.

A scorer is any function ``Iterator[pd.DataFrame] -> Iterator[pd.DataFrame]``
taking ``custom_id, text`` (the text to evaluate; the run's system prompt and
model are the scorer's own configuration) and yielding ``custom_id, line``:
answer lines in the service's JSON shape.  A network scorer would write the
request lines (``prompts.request_json``) itself; that client is out of scope
here, and tests use the deterministic offline scorer below.  Answer lines
are parsed back in the JVM (``responses``), never in Python.

``score_chunks`` emits exactly one row per request (plus pass-through
columns), so the result needs no join back to the input and the Python stage
is consumed once.
"""

from __future__ import annotations

import json
import traceback
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmeter.functions import responses as R
from inkmeter.operators.packing import MAX_REQUESTS_PER_BATCH
from inkmeter.operators.results import broadcast_if_small
from inkmeter.plans.ordered import ordered_scan, packing_partitions
from inkmeter.session import ensure_checkpoint_dir, scratch_path

ANSWER_SCHEMA = T.StructType([T.StructField("custom_id", T.StringType()),
                              T.StructField("line", T.StringType())])

#: Bytes of ids and text that a task reads in one wave where ``concurrency`` limits the tasks, and of a row's other columns.
WAVE_BYTES, ROW_BYTES = 64 * 1024 * 1024, 32

#: Column of ``with_bytes``.
SIZE_COL = "_row_bytes"

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def answer_line(cid: str, content: str) -> str:
    return json.dumps({"id": f"batch_req_{cid}", "custom_id": cid,
                       "response": {"status_code": 200,
                                    "body": {"choices": [{"message": {"content": content}}]}},
                       "error": None})


def length_scorer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Offline scorer: score = 1 + (characters of the evaluated text) mod 5."""
    for pdf in batches:
        scores = pdf["text"].fillna("nan").str.len().mod(5).add(1).astype(str)
        lines = [answer_line(c, s) for c, s in zip(pdf["custom_id"], scores)]
        yield pd.DataFrame({"custom_id": pdf["custom_id"], "line": lines})


def score_rows(requests: DataFrame, scorer: Scorer = length_scorer) -> DataFrame:
    """K2: (custom_id, text) -> answer lines, batched through Arrow."""
    return requests.select("custom_id", "text").mapInPandas(scorer, ANSWER_SCHEMA)


def _out_schema(src: DataFrame, chunk_cols: list[str], carry: list[str]) -> T.StructType:
    fields = [src.schema[c] for c in [*chunk_cols, "custom_id", *carry]]
    fields += [T.StructField("line", T.StringType()), T.StructField("status", T.StringType()),
               T.StructField("error_message", T.StringType()), T.StructField("error_details", T.StringType())]
    return T.StructType(fields)


def _score_call(frames: list, asked: list[str], scorer: Scorer) -> tuple:
    """One scorer call over ``frames``; returns (lines by id, status, error_message, error_details)."""
    by_id: dict = {}
    try:
        for ans in scorer(iter([f[asked] for f in frames])):
            # last answer per id wins (G9); ids without an answer get no line
            by_id.update(zip(ans["custom_id"], ans["line"]))
        if not by_id:
            return by_id, "error", "ERROR: scorer returned no answers", None
        return by_id, "completed", None, None
    except Exception as exc:  # noqa: BLE001 - failure is data here
        return {}, "failed", f"ERROR: {exc}", traceback.format_exc()


def with_bytes(rows: DataFrame) -> DataFrame:
    """``rows`` (custom_id, text) plus ``SIZE_COL``, what a row weighs where calls are dealt by bytes.

    Taken before the rows are joined with their chunks, it spares ``score_chunks`` a shuffle of the texts.
    """
    held = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in ("custom_id", "text")]
    return rows.withColumn(SIZE_COL, (held[0] + held[1] + F.lit(ROW_BYTES)).cast("long"))


def score_chunks(requests: DataFrame, scorer: Scorer = length_scorer, concurrency: int | None = None,
                 carry: tuple | list = (), chunk_cols: tuple | list = ("file", "part"),
                 max_rows: int = MAX_REQUESTS_PER_BATCH) -> DataFrame:
    """K3/K4: one scorer call per chunk with failure capture; one output row per request.

    ``requests``: ``chunk_cols`` (what names a chunk), custom_id, text (+ ``carry`` columns passed through).
    Rows are hash-partitioned by chunk and sorted, so every chunk is a
    contiguous run inside one partition; a single Python call per partition
    walks the runs (a run may straddle Arrow batches) and calls the scorer
    once per chunk.  The scorer receives an iterator over the chunk's frames
    (chunk columns, custom_id, text).  A chunk with more than ``max_rows``
    rows, the service's limit, is sent as several calls, so memory is bounded
    whatever the packer did; status and error belong to the call.
    An exception marks every row of the call ``failed`` (message +
    traceback); no answers at all marks it ``error``.  Duplicate answers for an
    id keep the last one (G9); ids the scorer did not answer get a null line.
    ``concurrency`` = number of tasks, i.e. at most that many chunks in flight;
    by default at least the cluster's parallelism (the partition count is
    explicit, so AQE does not fold the Python stage into a few tasks).  Few
    tasks would read ever more of a growing input, so above ``WAVE_BYTES``
    each gets an even share of the bytes, and above ``WAVE_BYTES`` for each of
    them the shares are scored in waves, one after the other, before this
    function returns (:func:`_score_in_waves`).  The bytes are read from the
    column of :func:`with_bytes` if ``requests`` has it, else from the texts.
    """
    carry, chunk_cols = list(carry), list(chunk_cols)
    spark = requests.sparkSession
    numbers = [F.col(c).cast("long").alias(c) if c != "file" else F.col(c) for c in chunk_cols]
    src = requests.select(*numbers, "custom_id", "text", *carry)
    schema = _out_schema(src, chunk_cols, carry)
    names = [f.name for f in schema.fields]
    asked = [*chunk_cols, "custom_id", "text"]
    n = int(concurrency) if concurrency else max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                                                 spark.sparkContext.defaultParallelism)

    def call(frames: list) -> pd.DataFrame:
        by_id, status, message, details = _score_call(frames, asked, scorer)
        out = pd.concat([f[[*chunk_cols, "custom_id", *carry]] for f in frames], ignore_index=True)
        return out.assign(line=[by_id.get(c) for c in out["custom_id"]], status=status, error_message=message,
                          error_details=details)[names]

    def run(batches):
        held, rows, key, done, ready = [], 0, None, [], 0
        for pdf in batches:
            if pdf.empty:
                continue
            new = np.zeros(len(pdf), dtype=bool)
            for c in chunk_cols:
                new |= pdf[c].ne(pdf[c].shift()).to_numpy()
            starts = np.flatnonzero(new).tolist()
            for lo, hi in zip(starts, [*starts[1:], len(pdf)]):
                mine = tuple(pdf[c].iat[lo] for c in chunk_cols)
                if held and mine != key:
                    done.append(call(held))
                    ready += rows
                    held, rows = [], 0
                key = mine
                while lo < hi:
                    take = min(hi - lo, max_rows - rows)
                    held.append(pdf.iloc[lo:lo + take])
                    rows, lo = rows + take, lo + take
                    if rows == max_rows:
                        done.append(call(held))
                        ready += rows
                        held, rows = [], 0
            if ready >= 5_000:
                yield pd.concat(done, ignore_index=True)
                done, ready = [], 0
        if held:
            done.append(call(held))
        if done:
            yield pd.concat(done, ignore_index=True)

    if concurrency:
        ensure_checkpoint_dir(spark)
        sized = requests if SIZE_COL in requests.columns else with_bytes(requests)
        sizes = sized.select(*numbers, SIZE_COL).groupBy(*chunk_cols).agg(
            F.sum(SIZE_COL).cast("long").alias("_bytes"),
            F.ceil(F.count(F.lit(1)) / max_rows).cast("long").alias("_slices")).checkpoint(eager=True)
        total, chunks = sizes.agg(F.coalesce(F.sum("_bytes"), F.lit(0)), F.count(F.lit(1))).first()
        if total > WAVE_BYTES:
            starts = ordered_scan(sizes.withColumn("_whole", F.lit(0)), ["_whole"], [*chunk_cols, "_slices"], "sum", "_bytes",
                                  num_partitions=packing_partitions(chunks)).drop("_whole")
            return _score_in_waves(src, starts, total, chunk_cols, n, run, schema)
    laid = src.repartition(n, *chunk_cols).sortWithinPartitions(*chunk_cols)
    return laid.mapInPandas(run, schema)


def _score_in_waves(src: DataFrame, starts: DataFrame, total: int, chunk_cols: list[str], n: int, run, schema) -> DataFrame:
    """Score ``src`` with at most ``n`` tasks at a time: its calls are dealt to waves, and each wave is a job of ``n`` tasks.

    ``starts`` has a running sum of the chunks' bytes in their order (``_run``, of ``total``).  A call goes to the share of
    the bytes that it starts in, so a task gets one share of at most ``WAVE_BYTES``, and the rest of the last call.  A chunk
    of ``_slices`` calls is dealt by call, rows of one id together, so that no wave has to hold a large chunk.  The rows of
    several waves are laid out by wave once, and each wave reads its own folder only.
    """
    spark = src.sparkSession
    waves = -(-total // (n * WAVE_BYTES))
    share = F.expr(f"(_run - _bytes + pmod(xxhash64(_l.custom_id), _slices) * _bytes div _slices) div {total // (n * waves) + 1}")
    same = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in chunk_cols]
    dealt = src.alias("_l").join(broadcast_if_small(starts).alias("_r"), same, "left").select(
        "_l.*", F.coalesce(share, F.lit(0)).cast("int").alias("_share"))

    def laid_out(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(n, F.col("_share")).sortWithinPartitions(*chunk_cols).select(*src.columns)

    if waves == 1:
        return laid_out(dealt).mapInPandas(run, schema)
    base = scratch_path(spark, "waves")
    dealt = dealt.withColumn("_wave", F.floor(F.col("_share") / n).cast("int"))
    dealt.repartitionById(n * waves, F.col("_share")).write.partitionBy("_wave").parquet(f"{base}/in")
    laid = spark.read.schema(dealt.schema).parquet(f"{base}/in")
    done = [r[0] for r in laid.select("_wave").distinct().orderBy("_wave").collect()]
    for wave in done:
        laid_out(laid.filter(F.col("_wave") == wave)).mapInPandas(run, schema).write.parquet(f"{base}/out/wave={wave}")
    return spark.read.schema(schema).parquet(*[f"{base}/out/wave={w}" for w in done])


def scored_answer(scored: DataFrame) -> DataFrame:
    """``scored`` plus llm_score and error_type of each row (F1 + F4 rules, each line parsed once in the JVM)."""
    score, etype = F.col("_c.llm_score"), F.col("_c.error_type")
    failed = F.col("status").isin("failed", "error")
    llm = (F.when(failed, F.coalesce(F.col("error_message"), F.lit("Error during job preparation")))
           .when(F.col("line").isNull(), F.lit(R.NOT_FOUND))
           .otherwise(F.coalesce(score, F.lit(R.FALLBACK))))
    et = (F.when(failed, F.concat(F.lit("Chunk:"), F.col("status")))
          .when(F.col("line").isNull(), F.lit("NotFound"))
          .otherwise(etype))
    return R.classified(scored, "line").select(*scored.columns, llm.alias("llm_score"), et.alias("error_type"))


def chunk_status(scored: DataFrame) -> DataFrame:
    """One row per chunk: status and error."""
    return scored.groupBy("file", "part").agg(
        F.first("status").alias("status"), F.first("error_message", ignorenulls=True).alias("error_message"))


def policy_continue(scored: DataFrame) -> DataFrame:
    """Every row returned; rows of failed chunks carry the chunk error."""
    return scored_answer(scored)


def policy_halt(scored: DataFrame, keys=("file",), part_cols=("part",)) -> DataFrame:
    """G11, deterministic: per file keep completed chunks before the first failed part.

    The table of first failures has one row per failed file; it is broadcast when its measured bytes are few.
    """
    part = F.struct(*[F.col(c) for c in part_cols])
    first_bad = (scored.filter(F.col("status").isin("failed", "error"))
                 .groupBy(*keys).agg(F.min(part).alias("_first_bad")))
    j = scored.join(broadcast_if_small(first_bad), list(keys), "left")
    kept = j.filter(F.col("_first_bad").isNull() | (part < F.col("_first_bad"))).drop("_first_bad")
    return scored_answer(kept)
