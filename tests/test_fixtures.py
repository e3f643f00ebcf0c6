"""Literal-row tests on the fixture shapes listed in FIXTURES.md."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from inkmeter.functions import ids, prompts, responses, tokens
from inkmeter.operators import admission, ledger, packing, results, scoring
from inkmeter.plans import derived
from inkmeter.sources import readers, writers


def _rows(spark, texts, file="f"):
    return spark.createDataFrame([(file, i, t) for i, t in enumerate(texts)], "file string, pos long, text string")


def _parts(df):
    return [r.part for r in df.orderBy("pos").collect()]


# ---- splitter ------------------------------------------------------------------

def test_forced_three_chunks_of_ten_rows(spark):
    df = _rows(spark, [f"row {i}" for i in range(10)])
    parts = _parts(packing.chunk_forced(df, 3))
    assert parts == [1, 1, 1, 1, 2, 2, 2, 3, 3, 3]


def test_forced_more_chunks_than_rows_gives_one_row_each(spark):
    parts = _parts(packing.chunk_forced(_rows(spark, ["a", "b"]), 3))
    assert parts == [1, 2]


def test_token_limit_thirty_packs_three_rows_of_ten(spark):
    df = _rows(spark, ["x" * 10] * 12).withColumn("tok", F.length("text").cast("long"))
    out = packing.chunk_greedy(df, 30)
    assert _parts(out) == [1] * 3 + [2] * 3 + [3] * 3 + [4] * 3
    sums = {r.part: r.chunk_tokens for r in packing.chunk_sums(out, ("file", "part")).collect()}
    assert all(v <= 30 for v in sums.values())
    assert out.count() == 12


def test_forced_two_then_resplit_oversize_chunk(spark):
    df = _rows(spark, ["y" * 50] * 5).withColumn("tok", F.length("text").cast("long"))
    out = packing.chunk_hybrid(df, 2, 100).orderBy("pos").collect()
    assert [r.part for r in out] == [1, 1, 1, 2, 2]
    # first forced chunk has 150 tokens > 100 -> re-split 2 + 1 rows; second stays
    assert [r.split_part for r in out] == [1, 1, 2, None, None]
    names = packing.with_chunk_names(packing.chunk_hybrid(df, 2, 100), "file", "part", "split_part")
    got = [r.chunk_id for r in names.orderBy("pos").collect()]
    assert got == ["f_part1_split_part1", "f_part1_split_part1", "f_part1_split_part2", "f_part2", "f_part2"]


def test_oversize_single_row_gets_own_chunk(spark):
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate([5, 500, 5, 5])], "file string, pos long, tok long")
    assert _parts(packing.chunk_greedy(df, 100)) == [1, 2, 3, 3]


def test_row_limit_two_rows_per_chunk(spark):
    assert _parts(packing.chunk_rows(_rows(spark, list("abcde")), 2)) == [1, 1, 2, 2, 3]


# ---- answer parsing ------------------------------------------------------------------

def _line(cid, content=None, error=None, response="default"):
    d = {"id": "x", "custom_id": cid}
    if response == "default":
        d["response"] = {"status_code": 200, "body": {"choices": [{"message": {"content": content}}]}}
    else:
        d["response"] = response
    d["error"] = error
    return json.dumps(d)


def _parse(spark, lines):
    df = spark.createDataFrame([(i, ln) for i, ln in enumerate(lines)], "pos long, value string")
    return {(r.custom_id if r.custom_id is not None else f"#{r.pos}"): r
            for r in responses.parse_lines(df, "value", keep=("pos",)).collect()}


def test_two_good_lines_map_by_id(spark):
    got = _parse(spark, [_line("a", "5"), _line("b", "3")])
    assert got["a"].llm_score == "5" and got["b"].llm_score == "3"
    assert got["a"].error_type is None


def test_api_error_line(spark):
    got = _parse(spark, [_line("e", error={"code": "test_err_code", "message": "This is a test error"},
                               response=None)])
    assert got["e"].llm_score == "Error: test_err_code - This is a test error"
    assert got["e"].error_type == "ApiError"


def test_error_defaults_and_shapes(spark):
    got = _parse(spark, [
        _line("nocode", error={"message": "m"}, response=None),
        _line("empty", response={"status_code": 200, "body": {"choices": []}}),
        _line("unknown", response={}, error={}),
        _line("nullc", None),
        json.dumps({"response": {"body": {}}}),
        '{"custom_id": "broken", "response": ',
    ])
    assert got["nocode"].llm_score == "Error: N/A - m"
    assert got["empty"].llm_score == responses.MALFORMED
    assert got["unknown"].llm_score == responses.UNKNOWN
    assert got["nullc"].llm_score is None and got["nullc"].error_type == "NullContent"
    assert got["#4"].custom_id is None  # no custom_id: skipped by with_id
    assert got["#5"].corrupt is True


def test_join_back_fills_defaults(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "custom_id string")
    ans = spark.createDataFrame([("a", "4", None), ("b", None, "NullContent")],
                                "custom_id string, llm_score string, error_type string")
    got = {r.custom_id: r.llm_score for r in results.join_results(rows, ans).collect()}
    assert got == {"a": "4", "b": responses.FALLBACK, "c": responses.NOT_FOUND}


def test_duplicate_answer_last_wins(spark):
    df = spark.createDataFrame([("k", 1, "first"), ("k", 2, "second"), ("j", 1, "only")],
                               "custom_id string, pos long, llm_score string")
    got = {r.custom_id: r.llm_score for r in responses.dedupe_last(df, "custom_id", ["pos"]).collect()}
    assert got == {"k": "second", "j": "only"}


def test_parse_score_bounds(spark):
    df = spark.createDataFrame([("4",), ("Score: 5",), ("9",), ("none",), (None,), ("-2",), ("4.7",), (" 3\n",),
                                ("Error: 3 - bad",), ("",)], "s string")
    got = [r.v for r in df.select(responses.parse_score("s").alias("v")).collect()]
    assert got == [4, 5, None, None, None, None, None, 3, None, None]
    typed = spark.createDataFrame([("4", None), ("4", "ApiError")], "s string, e string")
    assert [r.v for r in typed.select(responses.parse_score("s", error_type="e").alias("v")).collect()] == [4, None]


def test_error_objects_with_null_and_text_values(spark):
    lines = ['{"custom_id": "a", "response": null, "error": {"code": null}}',
             '{"custom_id": "b", "response": null, "error": {"message": null}}',
             '{"custom_id": "c", "response": null, "error": "0"}', '{"custom_id": "d", "response": null, "error": 0}',
             '{"custom_id": "e", "response": null, "error": ""}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {r.custom_id: (r.llm_score, r.error_type) for r in responses.parse_lines(df).collect()}
    assert got["a"] == ("Error: None - Unknown error", "ApiError")
    assert got["b"] == ("Error: N/A - None", "ApiError")
    assert got["c"][1] == "ApiError"
    assert got["d"][1] == got["e"][1] == "UnknownStructure"


# ---- scoring with failure capture ---------------------------------------------------

def _docs(spark, n, file="large_chunk"):
    return spark.createDataFrame([(file, i, str(i), f"text number {i}") for i in range(n)],
                                 "file string, pos long, custom_id string, text string")


def test_chunk_with_failure_keeps_every_row(spark):
    df = packing.chunk_forced(_docs(spark, 20), 3)
    scored = scoring.score_chunks(df, derived.failing_scorer("large_chunk", 1), carry=("pos",))
    out = scoring.policy_continue(scored).orderBy("pos").collect()
    assert len(out) == 20
    sizes = [sum(1 for r in out if r.part == p) for p in (1, 2, 3)]
    assert sizes == [7, 7, 6]
    assert all(r.llm_score.startswith("ERROR: Simulated failure") for r in out if r.part == 1)
    assert all(r.status == "completed" and r.llm_score in "12345" for r in out if r.part != 1)


def test_halt_policy_keeps_chunks_before_first_failure(spark):
    df = packing.chunk_forced(_docs(spark, 20), 3)
    scored = scoring.score_chunks(df, derived.failing_scorer("large_chunk", 2), carry=("pos",))
    kept = scoring.policy_halt(scored).collect()
    assert sorted({r.part for r in kept}) == [1] and len(kept) == 7


def test_scorer_without_answers_marks_chunk_error(spark):
    def silent(batches):
        for pdf in batches:
            yield pdf.iloc[0:0][["custom_id"]].assign(line=[])

    df = packing.chunk_forced(_docs(spark, 5), 1)
    st = scoring.chunk_status(scoring.score_chunks(df, silent)).collect()
    assert [r.status for r in st] == ["error"]


def test_row_level_error_counted(spark):
    df = spark.createDataFrame([(1, "ok 1"), (2, "ok 2"), (3, "Error: rate_limit - slow"), (4, "4"), (5, "5")],
                               "id long, llm_score string").withColumn("file", F.lit("f"))
    flagged = df.withColumn("is_error", results.error_flag("llm_score"))
    from inkmeter.operators import aggregates
    row = aggregates.error_counts(flagged).collect()[0]
    assert (row.n_rows, row.n_errors) == (5, 1)


# ---- prompts and ids ------------------------------------------------------------------

def test_default_examples_use_generic_prompt():
    assert prompts.render_system_prompt("- " + prompts.DEFAULT_EXAMPLES_TEXT, is_default=True) == prompts.GENERIC_PROMPT
    assert prompts.render_system_prompt(None) == prompts.GENERIC_PROMPT


def test_missing_placeholder_raises():
    with pytest.raises(ValueError, match="placeholder"):
        prompts.render_system_prompt("- a", template="no slot here")


def test_template_with_other_braces_is_kept():
    out = prompts.render_system_prompt("- a", template="Ex:\n{dynamic_examples}\nText: {input}")
    assert out == "Ex:\n- a\nText: {input}"


def test_examples_block_strips_and_drops_blanks(spark):
    df = spark.createDataFrame([(1, "  first  \n\n second"), (2, "   ")], "pos long, text string")
    lines = prompts.example_lines(df, "text", ("pos",))
    assert prompts.examples_block(lines, ("pos",)).collect()[0].block == "- first\n- second"


def test_mask_key(spark):
    df = spark.createDataFrame([("sk-short",), ("sk-1234567890abc",), (None,)], "k string")
    got = [r.m for r in df.select(ids.mask_key("k").alias("m")).collect()]
    assert got == ["****", "sk-1234567**********", "****"]


def test_request_json_shape(spark):
    df = spark.createDataFrame([("c1", "hi"), ("c2", None)], "custom_id string, text string")
    reqs = [json.loads(r.j) for r in df.select(prompts.request_json("custom_id", "text", "SYS").alias("j")).collect()]
    assert reqs[0]["body"]["messages"][1]["content"] == prompts.USER_PREFIX + "hi"
    assert reqs[1]["body"]["messages"][1]["content"] == prompts.USER_PREFIX + "nan"
    assert reqs[0]["url"] == "/v1/chat/completions" and reqs[0]["body"]["max_tokens"] == 1000


def test_regex_tokens_are_additive_over_newline(spark):
    a, b = "You are an evaluator.", "Is it, really?"
    row = spark.range(1).select(tokens.count_tokens(F.lit(a + "\n" + b)).alias("ab"),
                                tokens.count_tokens(F.lit(a)).alias("a"),
                                tokens.count_tokens(F.lit(b)).alias("b")).collect()[0]
    assert row.ab == row.a + row.b == 10


# ---- ledger ---------------------------------------------------------------------------

def _prices(spark):
    return spark.createDataFrame([("m1", 1.0, 4.0), ("m2", 0.5, 2.0)], "Model string, Input double, Output double")


def test_cost_strict_raises_on_unknown_model(spark):
    ev = spark.createDataFrame([("m9", 10, 10)], "model string, input_tokens long, output_tokens long")
    with pytest.raises(Exception, match="not found in pricing table"):
        ledger.cost_strict(ev, _prices(spark)).collect()


def test_cost_lenient_unknown_is_zero(spark):
    ev = spark.createDataFrame([("m9", 10, 10), ("m1", 1_000_000, 500_000)],
                               "model string, input_tokens long, output_tokens long")
    got = {r.model: r.cost for r in ledger.cost_lenient(ev, _prices(spark)).collect()}
    assert got == {"m9": 0.0, "m1": 3.0}


def test_pricing_files_strict_and_lenient(spark):
    d = tempfile.mkdtemp(prefix="inkmeter-price-")
    p = os.path.join(d, "pricing.csv")
    with open(p, "w") as fh:
        fh.write("Model,Input,Output\nm1,1.00,4.00\nm2,bad,2.00\nm1,2.00,8.00\n")
    lenient = readers.latest_prices(readers.read_pricing_lenient(spark, p)).collect()
    assert [(r.Model, r.Input, r.Output) for r in lenient] == [("m1", 2.0, 8.0)]
    with pytest.raises(Exception):
        readers.read_pricing_strict(spark, p).collect()


def test_usage_ranges_and_absent_day(spark):
    import datetime as dt
    ev = spark.createDataFrame([(dt.datetime(2024, 1, d, 12), "m1", 10, 5, 15, 0.5) for d in (1, 2, 3)],
                               "timestamp timestamp, model string, input_tokens long, output_tokens long, "
                               "total_tokens long, cost double")
    assert ledger.usage_total(ev, None, "2024-01-02").collect()[0].total_tokens == 30
    assert ledger.usage_total(ev, "2024-01-03", None).collect()[0].total_tokens == 15
    assert ledger.usage_total(ev, "2024-02-01", None).collect()[0].total_cost == 0.0
    log = spark.createDataFrame([(dt.date(2024, 1, 1), "****", 7)], "date date, api_key_prefix string, tokens_submitted long")
    look = spark.createDataFrame([(dt.date(2024, 1, 1), "****"), (dt.date(2024, 1, 5), "****")],
                                 "date date, api_key_prefix string")
    got = {str(r.date): r.tokens_submitted for r in ledger.usage_for_day(look, log).collect()}
    assert got == {"2024-01-01": 7, "2024-01-05": 0}


def test_admission_and_halt_prefix(spark):
    df = spark.createDataFrame([("a", 1, 10), ("b", 1, 500), ("c", 1, 10)], "file string, pos long, tok long")
    dec = admission.admission_cap(df, 100)
    st = {r.file: (r.status, r.logged_tokens) for r in dec.collect()}
    assert st == {"a": ("admitted", 10), "b": ("rejected", 0), "c": ("admitted", 10)}
    files = dec.select("file", (F.col("status") == "rejected").alias("failed"))
    got = {r.file: r.processed for r in admission.halt_prefix(files).collect()}
    assert got == {"a": True, "b": True, "c": False}


# ---- sources ----------------------------------------------------------------------------

def test_unsupported_extension_raises(spark):
    with pytest.raises(ValueError, match="Unsupported file type"):
        readers.read_by_extension(spark, "/tmp/whatever.xlsx")


def test_csv_header_only_and_unbalanced_quote(spark):
    d = tempfile.mkdtemp(prefix="inkmeter-csv-")
    empty = os.path.join(d, "empty.csv")
    with open(empty, "w") as fh:
        fh.write("text\n")
    assert readers.read_csv(spark, empty, "text string").count() == 0
    bad = os.path.join(d, "corrupt.csv")
    with open(bad, "w") as fh:
        fh.write('text\n"one"\n"two" tail\n"three\n')
    assert readers.read_csv(spark, bad, "text string").count() >= 2


def test_csv_roundtrip_keeps_quotes_and_newlines(spark):
    d = tempfile.mkdtemp(prefix="inkmeter-rt-")
    df = spark.createDataFrame([(1, 'say "hi",\nthen go'), (2, "plain")], "id long, text string")
    writers.write_csv(df, os.path.join(d, "out.csv"))
    back = readers.read_csv(spark, os.path.join(d, "out.csv"), "id long, text string")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_ingest_dir_derives_exact_file_order_across_splits(spark):
    from inkmeter.plans.jobs import ingest_dir

    d = tempfile.mkdtemp(prefix="inkmeter-ingest-")
    with open(os.path.join(d, "a.jsonl"), "w") as fh:
        for i in range(400):
            fh.write(json.dumps({"response": f"line {i} " + "x" * (i % 37), "n": i}) + "\n")
    with open(os.path.join(d, "b.csv"), "w") as fh:
        fh.write("response,n\n" + "".join(f"row {i},{i}\n" for i in range(50)))
    with open(os.path.join(d, "skip.txt"), "w") as fh:
        fh.write("not an input\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        rows = ingest_dir(spark, d, "response", "response string, n long")
        got = rows.select("file", "pos", "n", "custom_id", "id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 450
    for name, count in (("a.jsonl", 400), ("b.csv", 50)):
        mine = sorted((r.pos, r.n) for r in got if r.file.endswith(name))
        assert mine == [(i + 1, i) for i in range(count)]
    assert len({r.custom_id for r in got}) == 450 and all(r.id == r.custom_id for r in got)


def test_count_and_split_files(spark):
    from inkmeter.plans.jobs import count_files, split_files

    d = tempfile.mkdtemp(prefix="inkmeter-split-")
    with open(os.path.join(d, "big.csv"), "w") as fh:
        fh.write("response\n" + "".join(f"word {i} " * 20 + "\n" for i in range(30)))
    with open(os.path.join(d, "small.jsonl"), "w") as fh:
        fh.write(json.dumps({"response": "tiny"}) + "\n")
    stats = {r.file.split("/")[-1]: r for r in count_files(spark, d).collect()}
    assert stats["big.csv"].n_rows == 30 and stats["small.jsonl"].n_rows == 1
    limit = stats["small.jsonl"].total_tokens + 1
    out = os.path.join(d, "_chunked")
    rep = split_files(spark, d, out, token_limit=limit, chunk_tokens=stats["big.csv"].max_tokens * 4).collect()
    big = [r for r in rep if r.file.endswith("big.csv")]
    assert all(r.needs_split for r in big) and sum(r.n_rows for r in big) == 30 and len(big) == 8
    assert [r.part for r in rep if r.file.endswith("small.jsonl")] == [1]
    back = spark.read.json(out)
    assert back.count() == 30 and back.select("part").distinct().count() == 8


def test_daily_log_and_usage_log_readers(spark):
    d = tempfile.mkdtemp(prefix="inkmeter-logs-")
    log = os.path.join(d, "token_usage_log.json")
    with open(log, "w") as fh:
        json.dump([{"date": "2024-01-01", "api_key_prefix": "****", "tokens_submitted": 5},
                   {"date": "2024-01-02", "api_key_prefix": "sk-1234567**********", "tokens_submitted": 7}],
                  fh, indent=2)
    rows = readers.read_daily_log(spark, log).collect()
    assert sorted((str(r.date), r.tokens_submitted) for r in rows) == [("2024-01-01", 5), ("2024-01-02", 7)]
    assert readers.read_daily_log(spark, os.path.join(d, "missing.json")).count() == 0
    ev = os.path.join(d, "events.jsonl")
    with open(ev, "w") as fh:
        fh.write(json.dumps({"timestamp": "2024-01-01T10:00:00.000000", "api_key_prefix": "****", "model": "m",
                             "input_tokens": 1, "output_tokens": 2, "total_tokens": 3, "cost": 0.1}) + "\n\n")
        fh.write(json.dumps({"timestamp": "2024-01-02T10:00:00.000000", "api_key_prefix": "****", "model": "m",
                             "input_tokens": 4, "output_tokens": 5, "total_tokens": 9, "cost": 0.2,
                             "request_id": "r2"}) + "\n")
    usage = readers.read_usage_events(spark, ev)
    assert usage.count() == 2 and usage.filter(F.col("request_id").isNull()).count() == 1
    assert readers.read_usage_events(spark, os.path.join(d, "none.jsonl")).count() == 0


@pytest.mark.parametrize("node", [0, False, [], "", {}])
def test_falsy_response_nodes_are_absent(spark, node):
    got = _parse(spark, [json.dumps({"custom_id": "z", "response": node, "error": None}),
                         json.dumps({"custom_id": "y", "response": node,
                                     "error": {"code": "c", "message": "m"}})])
    assert got["z"].llm_score == responses.UNKNOWN
    assert got["y"].llm_score == "Error: c - m"


def test_strict_mode_voids_a_file_with_a_broken_line(spark):
    lines = spark.createDataFrame([("b1", _line("a", "5")), ("b1", '{"custom_id": "x", "resp'),
                                   ("b2", _line("c", "4"))], "chunk_id string, value string")
    parsed = responses.parse_lines(lines, "value", keep=("chunk_id",))
    ok = {r.chunk_id: r.output_readable for r in responses.readability(parsed, "chunk_id").collect()}
    assert ok == {"b1": False, "b2": True}
    rows = spark.createDataFrame([("a", "b1", "5"), ("c", "b2", "4")], "custom_id string, chunk_id string, llm_score string")
    batches = responses.readability(parsed, "chunk_id").select(
        "chunk_id", F.lit("completed").alias("status"), F.lit(True).alias("has_output"), "output_readable")
    got = {r.custom_id: r.llm_score for r in results.batch_status_rows(rows, batches).collect()}
    assert got == {"a": responses.UNREADABLE, "c": "4"}


def test_negative_pack_values_are_refused(spark):
    df = spark.createDataFrame([("f", 1, 5), ("f", 2, -1)], "file string, pos long, tok long")
    with pytest.raises(Exception, match="non-negative"):
        packing.chunk_greedy(df, 10).collect()


# ---- documents without a language ------------------------------------------------

def test_documents_without_language_reach_every_file_query(spark, tmp_path):
    import pandas as pd

    from conftest import SF001
    from oracle_compare import compare

    for name in os.listdir(SF001):
        if name != "documents.parquet":
            os.symlink(f"{SF001}/{name}", tmp_path / name)
    d = pd.read_parquet(f"{SF001}/documents.parquet").head(200)
    d.loc[::5, "lang"] = None
    d.to_parquet(tmp_path / "documents.parquet", index=False)
    report = compare(spark, str(tmp_path), ["src_dispatch", "src_dir_union", "grade_files"], verbose=False)
    assert report == {k: ("OK", 200, 200) for k in report} and len(report) == 3


# --------------------------------------------------------------------------
# last write wins through the bitmap of repeated ids
# --------------------------------------------------------------------------

def test_dedupe_last_with_many_and_no_repeats(spark, monkeypatch):
    import random

    from inkmeter.functions import keybits

    rng = random.Random(3)
    rows = [(f"k{rng.randrange(3000)}", i, f"v{i}") for i in range(4000)] + [("hot", 5000 + i, f"h{i}") for i in range(900)]
    rows += [(None, 9000, "n0"), (None, 9001, "n1"), ("null value", 9002, "x"), ("null value", 9003, None)]
    rng.shuffle(rows)
    want = {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        want[k] = (i, v)
    df = spark.createDataFrame(rows, "custom_id string, pos long, llm_score string").checkpoint()
    for maps in (keybits.MAPS, 1):  # one bitmap is crowded: more rows take the long way, the result is the same
        bits, mark = keybits.bitmaps, keybits.marked
        with monkeypatch.context() as m:
            m.setattr(keybits, "bitmaps", lambda k, h: bits(k, h, maps))
            m.setattr(keybits, "marked", lambda d, h, t, n: mark(d, h, t, n, maps))
            got = responses.dedupe_last(df, "custom_id", ["pos"]).collect()
        assert {r.custom_id: (r.pos, r.llm_score) for r in got} == want and len(got) == len(want)
    plan = responses.dedupe_last(df, "custom_id", ["pos"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_a_line_is_parsed_once(spark):
    """Fields are looked up in the parsed value; only nested answers are read from the line again."""
    df = spark.createDataFrame([("{}",)], "value string")
    plan = responses.parse_lines(df)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parsejson") + plan.count("parse_json") <= 1


def test_nested_and_literal_lookalikes(spark):
    def line(**k):
        return json.dumps(k)

    body = {"body": {"choices": [{"message": {"content": {"b": 1, "a": [2]}}}]}}
    cases = [(line(custom_id="1", response=body, error=None), '{"b":1,"a":[2]}', None),
             (line(custom_id="2", response="{}", error=None), responses.MALFORMED, "Malformed"),
             (line(custom_id="3", response={}, error="false"), "Error: N/A - Unknown error", "ApiError"),
             (line(custom_id="4", response=0, error=False), responses.UNKNOWN, "UnknownStructure"),
             (line(custom_id="5", response={}, error={"code": None}), "Error: None - Unknown error", "ApiError")]
    df = spark.createDataFrame([(c[0],) for c in cases], "value string")
    got = {r.custom_id: (r.llm_score, r.error_type) for r in responses.parse_lines(df).collect()}
    assert got == {str(i): c[1:] for i, c in enumerate(cases, 1)}
