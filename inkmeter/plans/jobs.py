"""End-to-end jobs (L1-L4) composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmeter.functions import prompts, tokens
from inkmeter.functions.ids import mask_key
from inkmeter.operators import admission, aggregates, ledger, packing, results, scoring
from inkmeter.session import ensure_checkpoint_dir
from inkmeter.sources import readers, runs, writers

# Fixed value: tokens a chunk may hold by default.
SPLIT_TOKEN_LIMIT = 500_000


def grade(rows: DataFrame, prompt, token_limit: int | None = None, split_token_limit: int = SPLIT_TOKEN_LIMIT,
          chunk_rows: int = packing.MAX_REQUESTS_PER_BATCH, scorer: scoring.Scorer = scoring.length_scorer,
          concurrency: int | None = None, force_chunk_count: int = 0,
          halt_on_chunk_failure: bool = True) -> DataFrame:
    """L1: grade every admitted file.

    ``rows``: file, pos, id, text, custom_id.  Steps: submitted tokens (D2) ->
    per-file admission cap (G6, only with a ``token_limit``) -> next-fit
    chunks under ``split_token_limit`` tokens and ``chunk_rows`` rows (G3; a
    file under both is one chunk, which is the split gate G5) -> one scorer
    call per chunk with failure capture (K3) -> classify answers (D7) and
    chunk errors (F4).  No row is dropped by size: more rows make more chunks.

    ``force_chunk_count > 1`` packs k even chunks per file and re-splits any
    chunk over ``split_token_limit`` (G4, chunk ids ``…_partN_split_partM``).
    ``halt_on_chunk_failure`` keeps only chunks before a file's first failed
    chunk (G11); without it every admitted row comes back exactly once.
    """
    chunks = packed_rows(rows, prompt, token_limit, split_token_limit, chunk_rows, force_chunk_count)
    # Score once: a real scorer is a billed external call, so later actions (and the
    # two reads of the halt policy) use this snapshot instead of calling it again.
    # The snapshot holds answers and ids only, never the input text.
    scored = scored_rows(rows, chunks, scorer, concurrency).checkpoint(eager=True)
    return graded_rows(scored, halt_on_chunk_failure)


def packed_rows(rows: DataFrame, prompt, token_limit: int | None = None, split_token_limit: int = SPLIT_TOKEN_LIMIT,
                chunk_rows: int = packing.MAX_REQUESTS_PER_BATCH, force_chunk_count: int = 0) -> DataFrame:
    """(file, pos, tok, part, split_part, chunk_id) of every admitted row: what will be sent, and in which chunk."""
    # Token counts are the expensive column and are read by the cap and the
    # packer: compute them once into a narrow checkpointed table.
    ensure_checkpoint_dir(rows.sparkSession)
    toks = rows.select("file", "pos", prompt.submitted("text").alias("tok")).checkpoint(eager=True)
    if token_limit is not None:
        toks = admission.admitted_rows(toks, admission.admission_cap(toks, token_limit))
    if force_chunk_count and force_chunk_count > 1:
        packed = packing.chunk_hybrid(toks, force_chunk_count, split_token_limit)
        packed = packing.with_chunk_names(packed, "file", "part", "split_part")
        packed = packed.withColumn("split_part", F.coalesce("split_part", F.lit(0).cast("long")))
    else:
        packed = packing.with_chunk_names(packing.chunk_greedy(toks, split_token_limit, chunk_rows))
        packed = packed.withColumn("split_part", F.lit(0).cast("long"))
    return packed.select("file", "pos", "tok", "part", "split_part", "chunk_id")


def scored_rows(rows: DataFrame, packed: DataFrame, scorer: scoring.Scorer, concurrency: int | None = None) -> DataFrame:
    """Answer lines and chunk status of every packed row."""
    # The scorer sees the text to evaluate (null -> 'nan', as in the request); the
    # system prompt and model are its configuration (see prompts.request_json).
    asked = rows.drop("tok").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("nan")))
    req = scoring.with_bytes(asked).join(packed, ["file", "pos"])
    return scoring.score_chunks(req, scorer, concurrency=concurrency, carry=("pos", "id", "chunk_id", "tok"),
                                chunk_cols=("file", "part", "split_part"))


def graded_rows(scored: DataFrame, halt_on_chunk_failure: bool = True) -> DataFrame:
    """Scores, errors and token counts from a snapshot of :func:`scored_rows`."""
    out = (scoring.policy_halt(scored, part_cols=("part", "split_part")) if halt_on_chunk_failure
           else scoring.policy_continue(scored))
    return out.select(
        "file", "pos", "id", "chunk_id", "llm_score", "error_type",
        results.error_flag("llm_score").alias("is_error"),
        F.col("tok").alias("input_tokens"),
        tokens.completion_tokens("llm_score").alias("output_tokens"))


def grade_usage(graded: DataFrame, pricing: DataFrame, api_key: str | None,
                model: str = prompts.DEFAULT_MODEL, timestamp: str | None = None) -> DataFrame:
    """The per-file usage event logged after grading (tokens in/out, lenient cost, masked key)."""
    per = graded.groupBy("file").agg(F.sum("input_tokens").cast("long").alias("input_tokens"),
                                     F.sum("output_tokens").cast("long").alias("output_tokens"))
    ts = F.lit(timestamp).cast("timestamp") if timestamp else F.current_timestamp()
    priced = ledger.with_model_cost(per, pricing, model)
    return priced.select(
        "file", ts.alias("timestamp"), mask_key(F.lit(api_key).cast("string")).alias("api_key_prefix"),
        F.lit(model).alias("model"), "input_tokens", "output_tokens",
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), "cost",
        F.concat(F.lit("file:"), F.col("file")).alias("request_id"))


#: Waves of files a run is divided into if it is not told how many files make one.
WAVES = 16


def file_waves(rows: DataFrame, wave_files: int | None = None) -> DataFrame:
    """(file, wave): files in order, ``wave_files`` to a wave (by default as many as make ``WAVES`` waves)."""
    ensure_checkpoint_dir(rows.sparkSession)
    files = rows.select("file").distinct().withColumn("_g", F.lit(0)).checkpoint(eager=True)
    size = wave_files or max(1, -(-files.count() // WAVES))
    numbered = packing.number_rows(files, "_g", "file")
    return numbered.select("file", F.floor((F.col("rn") - 1) / size).cast("int").alias("wave")).checkpoint(eager=True)


def run_job(rows: DataFrame, prompt, out: str, pricing: DataFrame, api_key: str | None, run_ts: str,
            halt_on_file_failure: bool = True, model: str = prompts.DEFAULT_MODEL, wave_files: int | None = None,
            scorer: scoring.Scorer = scoring.length_scorer, concurrency: int | None = None,
            halt_on_chunk_failure: bool = True, **packing_args) -> dict[str, str]:
    """L1 to the end: files are scored in waves, then results, daily tokens and usage events are committed at once.

    A file whose every row is an error has failed.  With ``halt_on_file_failure`` the waves after the one with the
    first failed file are never packed nor sent to the scorer, and files after the failed one leave no result and no
    event; ``wave_files=1`` sends nothing at all after a failed file.  The failed file's own result is kept, but it
    has no usage event.  The daily log counts every token that was sent: a wave's tokens are written before its first
    call, later files of a failed wave included.

    A scored wave is written to its end before the next one is admitted.  A run that is repeated under its ``run_ts``
    after it was killed goes on behind the last such wave and commits one copy of each sink; a committed run raises.
    Returns the paths that the run's manifest names (``sources.runs`` reads them).
    """
    spark = rows.sparkSession
    work = runs.open_run(spark, out, run_ts)
    day = F.to_date(F.lit(run_ts), "yyyyMMdd'T'HHmmss")
    waves = file_waves(rows, wave_files if halt_on_file_failure else 1 << 62)
    done: list[str] = []
    for wave in range((waves.agg(F.max("wave")).first()[0] or 0) + 1):
        path = f"{work}/scored/wave={wave}"
        if not runs.complete(spark, path):
            mine = rows.join(waves.filter(F.col("wave") == wave).select("file"), "file", "left_semi")
            packed = packed_rows(mine, prompt, **packing_args).checkpoint(eager=True)
            sent = packed.agg(F.coalesce(F.sum("tok"), F.lit(0)).cast("long").alias("tokens_submitted"))
            sent.write.mode("overwrite").parquet(f"{work}/sent/wave={wave}")
            scored_rows(mine, packed, scorer, concurrency).write.mode("overwrite").parquet(path)
        done.append(path)
        if halt_on_file_failure:
            last = graded_rows(spark.read.parquet(path), halt_on_chunk_failure)
            if aggregates.all_failed(last).filter("all_failed").limit(1).count():
                break
    graded = graded_rows(spark.read.parquet(*done), halt_on_chunk_failure)
    files = aggregates.all_failed(graded).withColumnRenamed("all_failed", "failed").checkpoint(eager=True)
    if halt_on_file_failure:
        files = admission.halt_prefix(files).filter("processed").drop("processed").checkpoint(eager=True)
    kept = graded.join(results.broadcast_if_small(files), "file")
    paths = {k: f"{work}/{k}" for k in ("results", "daily", "usage")}
    kept.drop("failed").write.mode("overwrite").parquet(paths["results"])
    sent = spark.read.parquet(*[p.replace("/scored/", "/sent/") for p in done])
    sent.agg(F.sum("tokens_submitted").cast("long").alias("tokens_submitted")).select(
        day.alias("date"), mask_key(F.lit(api_key).cast("string")).alias("api_key_prefix"), "tokens_submitted").write.mode(
        "overwrite").json(paths["daily"])
    events = grade_usage(spark.read.parquet(paths["results"]).join(files.filter(~F.col("failed")), "file", "left_semi"),
                         pricing, api_key, model, str(day_time(run_ts))).drop("file")
    events.write.mode("overwrite").option("timestampFormat", readers.ISO_TS).json(paths["usage"])
    runs.commit(spark, out, run_ts, paths)
    return paths


def day_time(run_ts: str):
    """The time that a run's ``yyyymmddThhmmss`` name stands for."""
    import datetime as dt

    return dt.datetime.strptime(run_ts, "%Y%m%dT%H%M%S")


def split_parts(rows: DataFrame, token_limit, chunk_tokens: int) -> DataFrame:
    """(file, pos, tok, part, needs_split): files whose total exceeds ``token_limit`` are packed greedily; others stay whole.

    Only (file, pos, tok) is needed: it is checkpointed once so the token
    expression is not re-evaluated by the gate, the packer and the totals.
    ``token_limit`` may be a function of that table.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    narrow = rows.select("file", "pos", "tok").checkpoint(eager=True)
    limit = token_limit(narrow) if callable(token_limit) else token_limit
    gate = packing.split_gate(narrow, limit).select("file", "needs_split").checkpoint(eager=True)
    tagged = narrow.join(results.broadcast_if_small(gate), "file")
    split = packing.chunk_greedy(tagged.filter(F.col("needs_split")), chunk_tokens)
    return split.unionByName(tagged.filter(~F.col("needs_split")).withColumn("part", F.lit(1).cast("long")))


def split_report(rows: DataFrame, token_limit, chunk_tokens: int) -> DataFrame:
    """L3: totals of every chunk of :func:`split_parts`."""
    parts = split_parts(rows, token_limit, chunk_tokens)
    return aggregates.chunk_totals(parts, ("file", "part", "needs_split"))


def costs_report(usage: DataFrame, day: str | None = None) -> DataFrame:
    """L4: day/model/all breakdowns for all time and for one day (the latest logged one by default).

    The events are aggregated once to (day, model); every breakdown is a sum over that small table.
    """
    per = (usage.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "model")
           .agg(F.sum("total_tokens").cast("long").alias("tokens"), F.sum("cost").alias("cost"),
                F.count(F.lit(1)).cast("long").alias("count"))).cache()  # a row per day and model
    day = day or per.agg(F.max("day").alias("d")).first()["d"]
    all_time = ledger.breakdowns(per).withColumn("scope", F.lit("all_time"))
    if day is None:
        return all_time
    one = ledger.breakdowns(per.filter(F.col("day") == day)).withColumn("scope", F.lit("latest_day"))
    return all_time.unionByName(one)


class FilePrompt:
    """System prompt from an examples text file (A10 -> C6/C7); generic when no file is given."""

    def __init__(self, spark, examples_path: str | None = None, method: str = "regex"):
        from inkmeter.sources import readers

        if examples_path:
            lines = prompts.example_lines(readers.read_lines(spark, examples_path), "value",
                                          ("file", "_block", "_row"))
            self.text = prompts.system_prompt_from_lines(lines, order_cols=("file", "_block", "_row"))
        else:
            self.text = prompts.GENERIC_PROMPT
        self.method = method
        self.tokens = tokens.literal_tokens(spark, self.text, method)

    def submitted(self, text_col="text"):
        return tokens.submitted_tokens(text_col, self.tokens, self.method, prompts.USER_PREFIX,
                                       null_as="nan", system_chars=len(self.text))


def ingest_dir(spark, input_dir: str, text_col: str = "response", schema=None,
               recursive: bool = False) -> DataFrame | None:
    """A5 + row identity: every .csv/.json/.jsonl row with ``file`` (path), ``pos`` and ``custom_id``.

    Files carry no position key, so the order inside each file is derived
    once: (split offset, place in split) is ranked per file with an ordered
    scan and the result is checkpointed, so later stages see fixed ids.
    """
    from inkmeter.functions import ids
    from inkmeter.plans.ordered import attach, ordered_scan
    from inkmeter.sources import readers

    ensure_checkpoint_dir(spark)
    raw = readers.read_input_dir(spark, input_dir, schema, recursive)
    if raw is None:
        return None
    located = raw.checkpoint(eager=True)
    ranks = ordered_scan(located, ["file"], ["_block", "_row"], "number")
    rows = attach(located, ranks, ["file", "_block", "_row"], ["_rn"]).withColumnRenamed("_rn", "pos")
    rows = rows.drop("_block", "_row", "_n").withColumn("text", F.col(text_col).cast("string"))
    return ids.restore_id(ids.normalise_id(rows)).checkpoint(eager=True)


def grade_files(spark, input_dir: str, examples_path: str | None = None, text_col: str = "response",
                schema=None, recursive: bool = False, **kw) -> DataFrame | None:
    """L1 over a folder of input files, as the command-line tool runs it; None when nothing matches."""
    rows = ingest_dir(spark, input_dir, text_col, schema, recursive)
    if rows is None:
        return None
    graded = grade(rows, FilePrompt(spark, examples_path), **kw)
    extra = [c for c in rows.columns if c not in ("file", "pos", "id", "text", "custom_id")]
    return graded.join(rows.select("file", "pos", *extra), ["file", "pos"])


def count_files(spark, input_dir: str, examples_path: str | None = None, text_col: str = "response",
                schema=None) -> DataFrame | None:
    """L2 over a folder: submitted tokens per row, total / mean / max per input file."""
    rows = ingest_dir(spark, input_dir, text_col, schema)
    if rows is None:
        return None
    p = FilePrompt(spark, examples_path)
    return aggregates.token_stats(rows.withColumn("tok", p.submitted("text")), "file", "tok")


def split_files(spark, input_dir: str, output_dir: str, token_limit: int, chunk_tokens: int,
                examples_path: str | None = None, text_col: str = "response", schema=None,
                fmt: str = "jsonl", recursive: bool = False) -> DataFrame | None:
    """L3 over a folder: files over ``token_limit`` are packed greedily and written one folder
    per chunk (B2); returns the per-chunk report."""
    rows = ingest_dir(spark, input_dir, text_col, schema, recursive)
    if rows is None:
        return None
    p = FilePrompt(spark, examples_path)
    rows = rows.withColumn("tok", p.submitted("text"))
    parts = split_parts(rows, token_limit, chunk_tokens).checkpoint(eager=True)
    packed = parts.filter("needs_split").select("file", "pos", "part")
    # a chunk folder is named after the file's path below the input folder, so equal names in two folders stay apart
    root = readers.absolute_path(spark, input_dir)
    path = F.regexp_replace("file", "^file:/+", "file:/")  # metadata has local files with one slash or three
    below = F.when(F.startswith(path, F.lit(root + "/")), F.substring(path, F.lit(len(root) + 2), F.length(path))).otherwise(
        F.regexp_extract("file", r"([^/]+)$", 1))
    writers.write_chunks(rows.join(packed, ["file", "pos"]).withColumn("file", below).drop("tok"), output_dir, fmt=fmt)
    return aggregates.chunk_totals(parts, ("file", "part", "needs_split"))
