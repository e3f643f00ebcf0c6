"""Streams lose nothing: late, repeated and many-file input against the plain result."""

import json
import os

from inkmeter.streaming import usage as st


def _write(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("".join(json.dumps(r) + "\n" for r in rows))


def _event(day, tokens, model="m"):
    return {"timestamp": f"2024-01-{day:02d}T10:00:00.000000", "api_key_prefix": "k", "model": model,
            "input_tokens": tokens, "output_tokens": 0, "total_tokens": tokens, "cost": 0.5, "request_id": "r"}


def test_late_usage_is_counted(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    _write(src, "a.json", [_event(20, 5)])
    st.run_usage_daily(spark, src, out)
    _write(src, "b.json", [_event(2, 7), _event(20, 1)])
    _write(src, "c.json", [_event(1, 3)])
    got = {r.day: (r.tokens, r["count"]) for r in st.run_usage_daily(spark, src, out, max_files=1).collect()}
    assert got == {"2024-01-20": (6, 2), "2024-01-02": (7, 1), "2024-01-01": (3, 1)}
    st.compact_sums(spark, out, st.USAGE_KEYS, st.USAGE_SUMS)
    _write(src, "d.json", [_event(1, 10)])
    got = {r.day: r.tokens for r in st.run_usage_daily(spark, src, out).collect()}
    assert got == {"2024-01-20": 6, "2024-01-02": 7, "2024-01-01": 13}


def test_daily_quota_over_several_batches(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for i, day in enumerate((20, 1, 20)):
        _write(src, f"{i}.json", [_event(day, 5)])
    got = {str(r.date): r.tokens_submitted for r in st.run_daily_quota(spark, src, out, max_files=1).collect()}
    assert got == {"2024-01-20": 10, "2024-01-01": 5}


def _answer(cid, score):
    return {"custom_id": cid, "response": {"body": {"choices": [{"message": {"content": score}}]}}, "error": None}


def test_last_answer_wins(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    _write(src, "a.jsonl", [_answer("x", "1"), _answer("y", "2"), _answer("x", "3")])
    assert {r.custom_id: r.llm_score for r in st.run_responses(spark, src, out).collect()} == {"x": "3", "y": "2"}
    _write(src, "b.jsonl", [_answer("y", "5")])
    assert {r.custom_id: r.llm_score for r in st.run_responses(spark, src, out).collect()} == {"x": "3", "y": "5"}


def test_every_request_has_one_status(spark, tmp_path):
    req, resp, out = (str(tmp_path / d) for d in ("req", "resp", "out"))

    def at(hour):
        return f"2024-01-{1 + hour // 24:02d}T{hour % 24:02d}:00:00.000000"

    _write(req, "a.json", [{"custom_id": "late", "req_ts": at(100)}, {"custom_id": "twice", "req_ts": at(90)}])
    _write(resp, "a.json", [{"custom_id": "twice", "resp_ts": at(92), "llm_score": "4"},
                            {"custom_id": "twice", "resp_ts": at(91), "llm_score": "3"}])
    got = {r.custom_id: (r.status, r.llm_score) for r in st.run_expired(spark, req, resp, out).collect()}
    assert got == {"late": ("pending", None), "twice": ("answered", "3")}
    # requests far behind the newest time still get their status
    _write(req, "b.json", [{"custom_id": "old", "req_ts": at(1)}, {"custom_id": "older", "req_ts": at(0)}])
    _write(resp, "b.json", [{"custom_id": "older", "resp_ts": at(30), "llm_score": "5"},
                            {"custom_id": "late", "resp_ts": at(124), "llm_score": "2"}])
    got = {r.custom_id: (r.status, r.llm_score) for r in st.run_expired(spark, req, resp, out).collect()}
    assert got == {"late": ("answered", "2"), "twice": ("answered", "3"), "old": ("batch_expired", st.EXPIRED),
                   "older": ("batch_expired", st.EXPIRED)}


def _paths_read(monkeypatch):
    """Records every folder of a table that is read."""
    seen, read = [], st._read

    def recorded(spark, folder, paths, schema):
        seen.extend(p.split("/out/")[-1] for p in paths)
        return read(spark, folder, paths, schema)

    monkeypatch.setattr(st, "_read", recorded)
    return seen


def test_answers_are_read_from_the_base_and_new_batches_only(spark, tmp_path, monkeypatch):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    want = {}
    for i in range(5):
        rows = [(f"k{j}", f"{i}-{j}") for j in range(i, 40, i + 1)] + [(f"only{i}", "1")]
        _write(src, f"{i}.jsonl", [_answer(k, v) for k, v in rows])
        want |= dict(rows)
        seen = _paths_read(monkeypatch)
        got = st.run_responses(spark, src, out, compact_every=2).collect()
        assert {r.custom_id: r.llm_score for r in got} == want and len(got) == len(want)
        assert sum(p.startswith("updates/") for p in set(seen)) <= 2  # never all batches that ever landed
    assert sorted(os.listdir(os.path.join(out, "base"))) == ["upto=1", "upto=3"]


def test_a_base_that_was_not_finished_does_not_count(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    _write(src, "a.jsonl", [_answer("x", "1")])
    st.run_responses(spark, src, out)
    os.makedirs(os.path.join(out, "base", "upto=0"))
    assert [tuple(r) for r in st.run_responses(spark, src, out).collect()] == [("x", "1", None)]


def _hour(h):
    return f"2024-01-{1 + h // 24:02d}T{h % 24:02d}:00:00.000000"


def test_statuses_step_by_step_equal_one_join(spark, tmp_path, monkeypatch):
    """Requests and answers land in any order over several runs; the last run's statuses are those of all rows at once."""
    import random

    rng = random.Random(11)
    reqs = [(f"r{i}", rng.randrange(200)) for i in range(60)]
    resps = [(f"r{rng.randrange(70)}", h, str(h % 5)) for h in (rng.randrange(260) for _ in range(90))]
    drops = 4
    req, resp, out = (str(tmp_path / d) for d in ("req", "resp", "out"))
    place = [(rng.randrange(drops), "q", r) for r in reqs] + [(rng.randrange(drops), "a", r) for r in resps]
    for d in range(drops):
        q = [r for k, kind, r in place if k == d and kind == "q"]
        a = [r for k, kind, r in place if k == d and kind == "a"]
        _write(req, f"{d}.json", [{"custom_id": i, "req_ts": _hour(h)} for i, h in q])
        _write(resp, f"{d}.json", [{"custom_id": i, "resp_ts": _hour(h), "llm_score": s} for i, h, s in a])
        seen = _paths_read(monkeypatch)
        got = st.run_expired(spark, req, resp, out, compact_every=2).collect()
        known = {r[0] for k, kind, r in place if k <= d and kind == "q"}
        assert sorted(r.custom_id for r in got) == sorted(known)  # exactly one status each
        landed = {p for p in seen if p.startswith(("updates-req/", "updates-resp/"))}
        assert landed == {f"updates-req/batch_id={d}", f"updates-resp/batch_id={d}"}  # new rows only
    clock = max([h for _, h in reqs] + [h for _, h, _ in resps])
    want = {}
    for i, h in reqs:
        ok = sorted((t, s) for j, t, s in resps if j == i and h <= t <= h + 24)
        want[i] = ("answered", ok[0][1]) if ok else ("batch_expired", st.EXPIRED) if clock > h + 24 else ("pending", None)
    assert {r.custom_id: (r.status, r.llm_score) for r in got} == want


def test_a_step_that_was_cut_short_is_done_again(spark, tmp_path, monkeypatch):
    req, resp, out = (str(tmp_path / d) for d in ("req", "resp", "out"))
    _write(req, "a.json", [{"custom_id": "x", "req_ts": _hour(0)}, {"custom_id": "y", "req_ts": _hour(90)}])
    _write(resp, "a.json", [{"custom_id": "x", "resp_ts": _hour(3), "llm_score": "4"}])
    st.run_expired(spark, req, resp, out)
    os.remove(os.path.join(out, "marks", "run=0", "_SUCCESS"))  # as if the step had died before its end
    got = st.run_expired(spark, req, resp, out).collect()
    assert sorted((r.custom_id, r.status) for r in got) == [("x", "answered"), ("y", "pending")]
