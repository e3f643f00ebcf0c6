"""Invariants on the driver's tables: conservation, limits, order, partition independence."""

from pyspark.sql import functions as F

from conftest import SF001
from inkmeter.operators import ledger, packing
from inkmeter.plans import catalog, derived, inputs
from inkmeter.plans.ordered import ordered_scan


def test_greedy_chunks_respect_limits_and_order(spark):
    limit, rows = 20_000, 25
    out = catalog.Q["chunk_greedy"](spark, SF001).collect()
    by_file = {}
    for r in out:
        by_file.setdefault(r.file, []).append(r)
    n_in = derived.docs(spark, SF001).count()
    assert len(out) == n_in  # every row kept once
    for f, rs in by_file.items():
        rs.sort(key=lambda r: r.pos)
        parts = [r.part for r in rs]
        assert parts == sorted(parts) and parts[0] == 1  # contiguous in pos order
        assert set(parts) == set(range(1, max(parts) + 1))
        chunks = {}
        for r in rs:
            chunks.setdefault(r.part, []).append(r.tok)
        for p, toks in chunks.items():
            assert len(toks) <= rows
            assert sum(toks) <= limit or len(toks) == 1
            if p + 1 in chunks:  # next chunk's first row would not have fitted
                nxt = chunks[p + 1][0]
                assert sum(toks) + nxt > limit or len(toks) == rows


def test_scan_independent_of_partition_count(spark):
    d = derived.docs(spark, SF001).withColumn("tok", F.length("text").cast("long"))
    results = []
    for n in (1, 4, 16):
        s = ordered_scan(d, ["file"], ["pos"], "greedy", pack=[("tok", 30_000)], row_limit=7, num_partitions=n)
        results.append(sorted((r.file, r.pos, r._part) for r in s.collect()))
    assert results[0] == results[1] == results[2]


def test_grade_conserves_rows(spark):
    g = catalog.Q["grade"](spark, SF001)
    n = derived.docs(spark, SF001).count()
    assert g.count() == n
    assert g.select("file", "pos").distinct().count() == n
    assert g.filter(F.col("llm_score").isNull()).count() == 0


def test_breakdowns_sum_to_the_same_total(spark):
    u = catalog._usage(spark, SF001)
    gs = ledger.usage_grouping_sets(u).groupBy("grouping").agg(F.sum("tokens").alias("t")).collect()
    totals = {r.grouping: r.t for r in gs}
    assert totals["day"] == totals["model"] == totals["all"]


def test_forced_chunks_balanced(spark):
    out = catalog.Q["chunk_forced"](spark, SF001)
    sizes = out.groupBy("file", "part").count().groupBy("file").agg(
        (F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r.spread <= 1 for r in sizes)


def test_system_prompt_per_examples_file(spark):
    rows = catalog.Q["system_prompt"](spark, SF001).collect()
    n = inputs.table(spark, SF001, "benchmark").count()
    assert len(rows) == -(-n // inputs.EXAMPLES_PER_FILE)
    assert all("{dynamic_examples}" not in r.system_prompt and r.system_prompt.count("\n- ") > 0
               and r.system_tokens > 0 for r in rows)


def test_grade_forced_chunks_and_halt(spark):
    from inkmeter.plans.jobs import grade

    rows = derived.docs(spark, SF001)
    p = inputs.Prompt()
    n = rows.count()
    first_file = rows.agg(F.min("file")).first()[0]
    forced = grade(rows, p, split_token_limit=10**9, force_chunk_count=3,
                   scorer=derived.failing_scorer(first_file, 2), halt_on_chunk_failure=False)
    out = forced.collect()
    assert len(out) == n
    ids = {r.chunk_id for r in out if r.file == first_file}
    assert ids == {f"{first_file}_part1", f"{first_file}_part2", f"{first_file}_part3"}
    assert all(r.is_error for r in out if r.chunk_id == f"{first_file}_part2")
    halted = grade(rows, p, split_token_limit=10**9, force_chunk_count=3,
                   scorer=derived.failing_scorer(first_file, 2)).collect()
    kept = {r.chunk_id for r in halted if r.file == first_file}
    assert kept == {f"{first_file}_part1"}
    assert len(halted) == n - sum(1 for r in out if r.file == first_file and r.chunk_id != f"{first_file}_part1")


def test_grade_resplits_oversize_forced_chunk(spark):
    from inkmeter.plans.jobs import grade

    rows = derived.docs(spark, SF001)
    p = inputs.Prompt()
    out = grade(rows, p, split_token_limit=p.tokens * 3, force_chunk_count=2).collect()
    assert len(out) == rows.count()
    assert any("_split_part" in r.chunk_id for r in out)


def test_same_answer_under_1_4_16_shuffle_partitions(spark):
    keys = ["grade", "join_results", "chunk_hybrid", "usage_grouping_sets", "halt_prefix"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    seen = {}
    try:
        for n in (1, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            for k in keys:
                rows = sorted(tuple(str(v) for v in r) for r in catalog.Q[k](spark, SF001).collect())
                seen.setdefault(k, []).append(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for k, runs in seen.items():
        assert runs[0] == runs[1] == runs[2], k


def test_concurrency_sets_scoring_tasks(spark):
    from inkmeter.operators import scoring

    d = packing.chunk_forced(derived.docs(spark, SF001), 3)
    assert scoring.score_chunks(d, concurrency=2).rdd.getNumPartitions() == 2
    assert scoring.score_chunks(d, concurrency=5).rdd.getNumPartitions() == 5


def test_grade_has_no_size_cap(spark):
    """One file of 60,000 rows and more than 6M tokens: more rows make more chunks, and none is lost."""
    from inkmeter.plans.jobs import grade

    rows = spark.range(60_000).selectExpr("'big' AS file", "id AS pos", "id", "repeat('word ', 130) AS text",
                                          "md5(cast(id as string)) AS custom_id")
    p = inputs.Prompt()
    out = grade(rows, p, split_token_limit=10**9)
    sizes = {r.chunk_id: r["count"] for r in out.groupBy("chunk_id").count().collect()}
    assert sizes == {"big_part1": 50_000, "big_part2": 10_000}
    assert out.agg(F.sum("input_tokens")).first()[0] > 6_000_000
    assert out.filter("is_error").count() == 0


def test_scoring_calls_are_bounded(spark):
    from inkmeter.operators import scoring

    def counting(batches):
        frames = list(batches)
        n = sum(len(f) for f in frames)
        for f in frames:
            yield f[["custom_id"]].assign(line=[scoring.answer_line(c, str(n)) for c in f["custom_id"]])

    rows = spark.range(2_500).selectExpr("'f' AS file", "1 AS part", "cast(id as string) AS custom_id", "'x' AS text")
    scored = scoring.policy_continue(scoring.score_chunks(rows, counting, max_rows=1_000))
    got = {r.llm_score: r["count"] for r in scored.groupBy("llm_score").count().collect()}
    assert got == {"1000": 2_000, "500": 500}


def test_scoring_in_waves_reads_bounded_tasks(spark, monkeypatch):
    """More text than ``concurrency`` tasks may hold: same rows in waves, in which no task reads it all."""
    import os

    from inkmeter.operators import scoring
    from inkmeter.session import local_path

    def call_sizes(batches):
        frames = list(batches)
        n = sum(len(f) for f in frames)
        for f in frames:
            yield f[["custom_id"]].assign(line=[scoring.answer_line(c, str(n)) for c in f["custom_id"]])

    rows = spark.range(4_000).selectExpr("if(id < 3000, 'hot', if(id % 50 = 0, null, concat('f', id % 20))) AS file", "id % 2 AS part",
                                         "cast(id as string) AS custom_id", "if(id % 7 = 0, null, repeat('x', 100)) AS text", "id")
    rows = rows.unionByName(rows.filter("id = 5"))  # an id asked for twice
    plain = scoring.score_chunks(rows, concurrency=2, carry=("id",), max_rows=100)
    assert plain.rdd.getNumPartitions() == 2
    monkeypatch.setattr(scoring, "WAVE_BYTES", 20_000)
    scored = scoring.score_chunks(rows, concurrency=2, carry=("id",), max_rows=100)
    assert sorted(map(str, scored.collect())) == sorted(map(str, plain.collect())) and scored.columns == plain.columns
    out = os.path.dirname(local_path(scored.inputFiles()[0]))
    waves = [w for w in os.listdir(os.path.dirname(out)) if w.startswith("wave=")]
    assert len(waves) > 5
    for w in waves:
        files = [f for f in os.listdir(f"{os.path.dirname(out)}/{w}") if f.startswith("part-")]
        assert 1 <= len(files) <= 2
        assert spark.read.parquet(f"{os.path.dirname(out)}/{w}").count() < 2_000
    sizes = scoring.policy_continue(scoring.score_chunks(rows, call_sizes, concurrency=2, max_rows=100))
    assert max(int(r.llm_score) for r in sizes.select("llm_score").distinct().collect()) <= 100


def test_scoring_tasks_hold_one_share_and_one_call(spark, monkeypatch):
    """What a task reads is dealt by bytes, not by chance: at most its share and the rest of one call."""
    from inkmeter.operators import scoring
    from inkmeter.session import local_path

    per_row = 100 + 4 + scoring.ROW_BYTES
    rows = spark.range(1_000, 5_000).selectExpr("concat('f', id % 10) AS file", "id div 10 % 8 AS part", "cast(id as string) AS custom_id",
                                                "repeat('x', 100) AS text")  # 80 chunks of 50 rows
    monkeypatch.setattr(scoring, "WAVE_BYTES", 200 * per_row)
    scored = scoring.score_chunks(rows, concurrency=2)
    folders = {local_path(f).rsplit("/", 1)[0] for f in scored.inputFiles()}
    assert scored.count() == scored.select("custom_id").distinct().count() == 4_000 and len(folders) == 10
    tasks = [spark.read.parquet(local_path(f)).count() for f in scored.inputFiles()]
    assert max(tasks) <= 250 and len([t for t in tasks if t]) == 20

    one = rows.select(F.lit("f").alias("file"), F.lit(1).alias("part"), "custom_id", "text")  # one chunk of many calls
    monkeypatch.setattr(scoring, "WAVE_BYTES", 2_500 * per_row)
    scored = scoring.score_chunks(one, concurrency=2, max_rows=100)
    tasks = scored.groupBy(F.spark_partition_id()).count().collect()
    assert sum(t["count"] for t in tasks) == 4_000 and max(t["count"] for t in tasks) <= 2_500

    empty = rows.withColumn("text", F.lit(None).cast("string"))  # rows without text are not free
    monkeypatch.setattr(scoring, "WAVE_BYTES", 200 * (per_row - 100))
    assert len({local_path(f).rsplit("/", 1)[0] for f in scoring.score_chunks(empty, concurrency=2).inputFiles()}) == 10


def test_sizing_chunks_shuffles_no_text(spark, tmp_path, monkeypatch):
    """The chunks' bytes are summed from a column taken beside the text: the join with the chunks moves no text for them."""
    import contextlib
    import io
    import re

    from inkmeter.operators import scoring

    spark.range(600).selectExpr("id AS doc_id", "if(id % 9 = 0, null, repeat('x', 100)) AS text", "'en' AS lang",
                                "concat('s', id % 4) AS source", "100L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    plain = sorted(map(str, catalog.Q["score_concurrency"](spark, str(tmp_path)).collect()))
    plans, checkpoint = [], type(spark.range(1)).checkpoint

    def seen(df, *args, **kwargs):
        if "_slices" in df.columns and "_run" not in df.columns:
            with contextlib.redirect_stdout(io.StringIO()) as out:
                df.explain("formatted")
            plans.append(out.getvalue())
        return checkpoint(df, *args, **kwargs)

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", seen)
    monkeypatch.setattr(scoring, "WAVE_BYTES", 30_000)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables that no broadcast holds
        got = sorted(map(str, catalog.Q["score_concurrency"](spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == plain and len(plain) == 12
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plans[0])
    assert len(moved) >= 2 and not any(re.search(r"\btext#", m) for m in moved)


def test_bytes_taken_before_the_join_are_those_of_the_texts(spark, monkeypatch):
    from inkmeter.operators import scoring

    rows = spark.range(500).selectExpr("if(id % 50 = 0, null, 'f') AS file", "id % 3 AS part", "if(id = 7, null, cast(id as string)) AS custom_id",
                                       "if(id % 7 = 0, null, repeat('\u00e9', 90)) AS text")
    assert scoring.with_bytes(rows).agg(F.sum(scoring.SIZE_COL)).first()[0] == rows.agg(F.sum(
        F.expr(f"coalesce(octet_length(custom_id), 0) + coalesce(octet_length(text), 0) + {scoring.ROW_BYTES}"))).first()[0]
    plain = scoring.score_chunks(rows, concurrency=2, max_rows=100)
    monkeypatch.setattr(scoring, "WAVE_BYTES", 40_000)
    for some in (rows, scoring.with_bytes(rows)):
        scored = scoring.score_chunks(some, concurrency=2, max_rows=100)
        assert scored.columns == plain.columns and sorted(map(str, scored.collect())) == sorted(map(str, plain.collect()))
