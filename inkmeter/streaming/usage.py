"""Structured Streaming jobs.

Every job is stateless: a micro-batch is reduced on its own and written to
``updates/batch_id=N`` (overwriting that one folder, so a replayed batch is
idempotent), and the table is put together from the newest base and the
batches after it.  No watermark decides what counts, so an event is never
lost for being late, and no state store grows with the keys.  A base
``base/upto=N`` holds all batches up to N; only folders that were written to
their end count, and those that a base covers may be deleted.

* J1 live usage per day and model, J2 daily quota per key: each batch writes
  its partial sums; the current table is their sum (``summed_table``).
  ``compact_sums`` folds all batches so far into one base.
* J3 answer ingestion as files land: classify lines, keep the last answer per
  ``custom_id``: by file time, path and place inside a batch, then by batch.
  The current answers are a keyed table (``keyed_table``): rows of the base
  pass through unless a later batch may hold their key, which a bitmap tells.
  Every ``compact_every`` batches a run writes a new base.
* J4 requests unanswered within the window become ``batch_expired``: a run
  takes what is new on both sides, the requests that are open and the answers
  that wait for a request, closes what can be closed, and leaves the rest
  open.  Closed requests are a keyed table by day; a run looks only at those
  of the days that its new rows can concern.

All checkpoints and outputs live under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmeter.functions import keybits, responses
from inkmeter.session import ensure_checkpoint_dir
from inkmeter.sources.readers import ISO_TS, path_exists, usage_reader

EXPIRED = "Error: batch_expired - Batch expired before the request was processed"


def _run(stream: DataFrame, out: str, reduce, name: str = "") -> None:
    """One pass over what has landed; ``reduce`` turns a micro-batch into the rows that are kept of it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{out}/updates{name}/batch_id={batch_id}")

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/_checkpoint{name}")
     .trigger(availableNow=True).start().awaitTermination())


def _read_stream(spark: SparkSession, max_files: int | None):
    r = spark.readStream
    return r if max_files is None else r.option("maxFilesPerTrigger", max_files)


def _numbered(spark: SparkSession, folder: str, name: str) -> dict[int, str]:
    """Sub-folders ``name=N`` that were written to their end, by N (a listing; no data is read)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = {}
    for status in fs.listStatus(path) if fs.exists(path) else ():
        sub = status.getPath()
        kind, _, number = sub.getName().partition("=")
        if kind == name and number.isdigit() and path_exists(spark, f"{folder}/{sub.getName()}/_SUCCESS"):
            out[int(number)] = f"{folder}/{sub.getName()}"
    return out


def _read(spark: SparkSession, folder: str, paths: list[str], schema) -> DataFrame:
    """The given sub-folders of ``folder``; an empty table for none."""
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", folder).parquet(*paths)


def _updates(spark: SparkSession, out: str, schema: str, name: str = "", after: int = -1) -> DataFrame:
    """Batches written after batch ``after`` (with ``batch_id``)."""
    found = _numbered(spark, f"{out}/updates{name}", "batch_id")
    df = _read(spark, f"{out}/updates{name}", [p for n, p in sorted(found.items()) if n > after], f"{schema}, batch_id long")
    return df.select(*[c.split()[0] for c in schema.split(", ")], F.col("batch_id").cast("long").alias("batch_id"))


def _last(spark: SparkSession, out: str, name: str = "") -> int:
    return max(_numbered(spark, f"{out}/updates{name}", "batch_id"), default=-1)


def _base(spark: SparkSession, out: str, schema: str, name: str = "") -> tuple[int, DataFrame]:
    """(last batch it holds, rows) of the newest base; (-1, no rows) without one."""
    found = _numbered(spark, f"{out}/base{name}", "upto")
    upto = max(found, default=-1)
    rows = _read(spark, f"{out}/base{name}", [found[upto]] if found else [], schema)
    return upto, rows.select(*[c.split()[0] for c in schema.split(", ")])


def summed_table(spark: SparkSession, out: str, keys: list[str], schema: str) -> DataFrame:
    """Sum of all partial sums per key: the newest base, and the batches after it."""
    sums = [c.split()[0] for c in schema.split(", ") if c.split()[0] not in keys]
    upto, base = _base(spark, out, schema)
    parts = _updates(spark, out, schema, after=upto).select(*keys, *sums).unionByName(base.select(*keys, *sums))
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def compact_sums(spark: SparkSession, out: str, keys: list[str], schema: str) -> None:
    """Fold every batch written so far into one base table; readers then skip those batches."""
    last = _last(spark, out)
    if last > _base(spark, out, schema)[0]:
        summed_table(spark, out, keys, schema).write.mode("overwrite").parquet(f"{out}/base/upto={last}")


def keyed_table(spark: SparkSession, out: str, key: str, schema: str, name: str = "", where: Column | None = None) -> DataFrame:
    """The last row of every key: the newest base, overruled by the batches after it, the latest batch first of all.

    Base rows are neither shuffled nor sorted unless a later batch may hold their key.  ``where`` restricts both (to
    some days, say) before anything is joined.
    """
    cols = [c.split()[0] for c in schema.split(", ")]
    upto, base = _base(spark, out, schema, name)
    recent = _updates(spark, out, schema, name, after=upto)
    if where is not None:
        base, recent = base.filter(where), recent.filter(where)
    newest = responses.dedupe_last(recent, key, ["batch_id"]).select(*cols)
    if upto < 0:
        return newest
    bits = keybits.bitmaps(newest.select(F.xxhash64(key).alias("_h")), "_h")
    marked = keybits.marked(base.withColumn("_h", F.xxhash64(key)), "_h", bits, "_again")
    untouched = marked.filter(~F.col("_again")).select(*cols)
    perhaps = marked.filter("_again").select(*cols).join(newest.select(key), key, "left_anti")
    return untouched.unionByName(perhaps.select(*cols)).unionByName(newest)


def compact_keyed(spark: SparkSession, out: str, key: str, schema: str, name: str = "", by: tuple = ()) -> None:
    """Write the current rows as a new base; readers then skip the batches it holds, which may be deleted."""
    last = _last(spark, out, name)
    if last > _base(spark, out, schema, name)[0]:
        current = keyed_table(spark, out, key, schema, name)
        current.write.mode("overwrite").partitionBy(*by).parquet(f"{out}/base{name}/upto={last}")


def _compact_if_due(spark: SparkSession, out: str, key: str, schema: str, every: int, name: str = "", by: tuple = ()) -> None:
    upto = _base(spark, out, schema, name)[0]
    if sum(n > upto for n in _numbered(spark, f"{out}/updates{name}", "batch_id")) >= every:
        compact_keyed(spark, out, key, schema, name, by)


def usage_stream(spark: SparkSession, source_dir: str, max_files: int | None = None) -> DataFrame:
    return usage_reader(_read_stream(spark, max_files)).json(source_dir)


USAGE_KEYS, USAGE_SUMS = ["day", "model"], "day string, model string, tokens long, cost double, count long"
QUOTA_KEYS, QUOTA_SUMS = ["date", "api_key_prefix"], "date date, api_key_prefix string, tokens_submitted long"


def run_usage_daily(spark: SparkSession, source_dir: str, out: str, max_files: int | None = None) -> DataFrame:
    """Tokens, cost and count per day and model, maintained as events arrive, in any order."""
    _run(usage_stream(spark, source_dir, max_files), out, lambda b: b.groupBy(
        F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "model").agg(
        F.sum("total_tokens").cast("long").alias("tokens"), F.sum("cost").alias("cost"),
        F.count(F.lit(1)).cast("long").alias("count")))
    t = summed_table(spark, out, USAGE_KEYS, USAGE_SUMS)
    return t.select("day", "model", "tokens", F.round("cost", 6).alias("cost"), "count")


def run_daily_quota(spark: SparkSession, source_dir: str, out: str, max_files: int | None = None) -> DataFrame:
    """Tokens submitted per (date, key prefix), updated as submissions arrive."""
    _run(usage_stream(spark, source_dir, max_files), out, lambda b: b.groupBy(
        F.to_date("timestamp").alias("date"), "api_key_prefix").agg(
        F.sum("input_tokens").cast("long").alias("tokens_submitted")))
    return summed_table(spark, out, QUOTA_KEYS, QUOTA_SUMS)


ANSWERS = "custom_id string, llm_score string, error_type string"
#: Batches after which a run folds a keyed table into a new base.
COMPACT_EVERY = 16


def run_responses(spark: SparkSession, source_dir: str, out: str, max_files: int | None = None,
                  compact_every: int = COMPACT_EVERY) -> DataFrame:
    """One pass over newly landed answer files (call again when more land); returns the current answers.

    A run reads the new files; the answers of earlier ones come from the base and the few batches after it.
    """
    meta = ["file_modification_time", "file_path", "file_block_start"]
    lines = _read_stream(spark, max_files).text(source_dir).select(
        "value", *[F.col(f"_metadata.{m}").alias(m) for m in meta])

    def reduce(batch: DataFrame) -> DataFrame:
        placed = batch.withColumn("_row", F.monotonically_increasing_id())
        parsed = responses.with_id(responses.parse_lines(placed, "value", keep=(*meta, "_row")))
        kept = parsed.drop("corrupt", "error_message").checkpoint(eager=True)
        return responses.dedupe_last(kept, "custom_id", [*meta, "_row"]).select("custom_id", "llm_score", "error_type")

    ensure_checkpoint_dir(spark)
    _run(lines, out, reduce)
    _compact_if_due(spark, out, "custom_id", ANSWERS, compact_every)
    return keyed_table(spark, out, "custom_id", ANSWERS)


REQ_SCHEMA = T.StructType([T.StructField("custom_id", T.StringType()),
                           T.StructField("req_ts", T.TimestampType())])
RESP_SCHEMA = T.StructType([T.StructField("custom_id", T.StringType()),
                            T.StructField("resp_ts", T.TimestampType()),
                            T.StructField("llm_score", T.StringType())])


LANDED_REQ = "custom_id string, req_ts timestamp"
LANDED_RESP = "custom_id string, resp_ts timestamp, llm_score string"
CLOSED = "custom_id string, req_ts timestamp, resp_ts timestamp, llm_score string, status string, day date"
MARKS = "req_upto long, resp_upto long, clock timestamp"


def run_expired(spark: SparkSession, req_dir: str, resp_dir: str, out: str, now: str | None = None,
                window: str = "24 hours", max_files: int | None = None, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """Land what is new on both sides, close what can be closed, and return the status of every request.

    ``answered``: an answer came within ``window`` (the first one counts);
    ``batch_expired``: none did and the window is over; ``pending``: it is not
    over at ``now`` (default: the newest time seen on either side).  An answer
    that lands after its request was closed still counts if its own time is
    inside the window, and replaces the request's status.
    """
    for name, schema, folder in (("-req", REQ_SCHEMA, req_dir), ("-resp", RESP_SCHEMA, resp_dir)):
        stream = (_read_stream(spark, max_files).schema(schema).option("timestampFormat", ISO_TS).json(folder))
        _run(stream, out, lambda b: b, name)
    run = _close(spark, out, now, window)
    _compact_if_due(spark, out, "custom_id", CLOSED, compact_every, "-closed", ("day",))
    score = F.when(F.col("status") == "batch_expired", F.lit(EXPIRED)).otherwise(F.col("llm_score"))
    closed = keyed_table(spark, out, "custom_id", CLOSED, "-closed").select("custom_id", "status", score.alias("llm_score"))
    pending = _state(spark, out, run, "open", LANDED_REQ).select(
        "custom_id", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("llm_score"))
    return closed.unionByName(pending)


def _state(spark: SparkSession, out: str, run: int, table: str, schema: str) -> DataFrame:
    """A table that a run left for the next one; empty before the first."""
    folder = f"{out}/state/run={run}/{table}"
    return _read(spark, folder, [folder] if run >= 0 else [], schema)


def _close(spark: SparkSession, out: str, now: str | None, window: str) -> int:
    """One step of J4; returns its number.

    Read are the batches that landed since the last step, the open requests, the answers without a request, and the
    closed requests of the days that the new rows can concern.  The step's marks are written last, and a step without
    marks is done again, so a step that was cut short leaves nothing that counts twice.
    """
    done = _numbered(spark, f"{out}/marks", "run")
    last = max(done, default=-1)
    mark = spark.read.parquet(done[last]).first() if done else None
    req_upto, resp_upto = (mark["req_upto"], mark["resp_upto"]) if mark else (-1, -1)
    req_now, resp_now = _last(spark, out, "-req"), _last(spark, out, "-resp")
    new_req = _updates(spark, out, LANDED_REQ, "-req", after=req_upto).drop("batch_id")
    new_resp = _updates(spark, out, LANDED_RESP, "-resp", after=resp_upto).drop("batch_id")
    times = new_req.select(F.col("req_ts").alias("t")).unionByName(new_resp.select(F.col("resp_ts").alias("t")))
    clock = now or max((x for x in (mark and mark["clock"], times.agg(F.max("t")).first()[0]) if x is not None), default=None)
    wide = F.expr(f"interval {window}")

    # closed requests that a new row may concern: repeated request lines, and answers from inside the window
    days = new_req.select(F.to_date("req_ts").alias("lo"), F.to_date("req_ts").alias("hi")).unionByName(
        new_resp.select(F.to_date(F.col("resp_ts") - wide).alias("lo"), F.to_date("resp_ts").alias("hi")))
    days = days.distinct().select(F.explode(F.sequence("lo", "hi")).alias("d")).distinct()
    asked = [r.d for r in days.collect()]  # one row a day
    touched = keyed_table(spark, out, "custom_id", CLOSED, "-closed", F.col("day").isin(asked) if asked else F.lit(False))
    new_ids = new_req.select("custom_id").unionByName(new_resp.select("custom_id"))
    bits = keybits.bitmaps(new_ids.select(F.xxhash64("custom_id").alias("_h")), "_h")
    touched = keybits.marked(touched.withColumn("_h", F.xxhash64("custom_id")), "_h", bits, "_again").filter("_again")
    touched = touched.join(new_ids, "custom_id", "left_semi").checkpoint(eager=True)

    req = (_state(spark, out, last, "open", LANDED_REQ).unionByName(new_req).unionByName(touched.select("custom_id", "req_ts"))
           .groupBy("custom_id").agg(F.min("req_ts").alias("req_ts")))
    resp = _state(spark, out, last, "waiting", LANDED_RESP).unionByName(new_resp).unionByName(
        touched.filter("status = 'answered'").select("custom_id", "resp_ts", "llm_score"))
    end = F.col("req_ts") + wide
    both = req.join(resp, "custom_id", "full").withColumn(
        "ok", F.coalesce((F.col("resp_ts") >= F.col("req_ts")) & (F.col("resp_ts") <= end), F.lit(False)))
    one = both.filter("req_ts IS NOT NULL").groupBy("custom_id").agg(
        F.first("req_ts").alias("req_ts"), F.max("ok").alias("ok"),
        F.min(F.when(F.col("ok"), F.struct("resp_ts", "llm_score"))).alias("a"))
    status = (F.when(F.col("ok"), F.lit("answered"))
              .when(F.lit(clock).cast("timestamp") > end, F.lit("batch_expired")).otherwise(F.lit("pending")))
    judged = one.withColumn("status", status).checkpoint(eager=True)
    closed = judged.filter("status <> 'pending'").select(
        "custom_id", "req_ts", "a.resp_ts", "a.llm_score", "status", F.to_date("req_ts").alias("day"))
    run = last + 1
    state = f"{out}/state/run={run}"
    closed.write.mode("overwrite").partitionBy("day").parquet(f"{out}/updates-closed/batch_id={run}")
    judged.filter("status = 'pending'").select("custom_id", "req_ts").write.mode("overwrite").parquet(f"{state}/open")
    waiting = resp.join(closed.select("custom_id"), "custom_id", "left_anti").select("custom_id", "resp_ts", "llm_score")
    waiting.write.mode("overwrite").parquet(f"{state}/waiting")
    spark.createDataFrame([(req_now, resp_now, None)], MARKS).withColumn("clock", F.lit(clock).cast("timestamp")).coalesce(1).write.mode(
        "overwrite").parquet(f"{out}/marks/run={run}")
    return run
