"""The whole run: waves of files, what is sent and logged, and one commit of all sinks."""

import os
import uuid

import pytest

from inkmeter.functions import prompts, tokens
from inkmeter.operators.scoring import length_scorer
from inkmeter.plans import jobs
from inkmeter.sources import runs


class Prompt:
    text, tokens = "p", 1

    def submitted(self, col="text"):
        return tokens.submitted_tokens(col, 1, "chars4", "", null_as="nan", system_chars=1)


def files(spark, names="abcdef", rows=4):
    data = [(f, i, i, "some text " * (i + 1), f"{f}-{i}") for f in names for i in range(rows)]
    return spark.createDataFrame(data, "file string, pos long, id long, text string, custom_id string").repartition(3)


def prices(spark):
    return spark.createDataFrame([(prompts.DEFAULT_MODEL, 1.0, 2.0)], "Model string, Input double, Output double")


def noting_scorer(folder, bad=()):
    """Notes the file of every call; calls for the files ``bad`` raise."""
    def run(batches):
        for pdf in batches:
            with open(os.path.join(folder, f"{pdf['file'].iloc[0]}.{uuid.uuid4().hex}"), "w"):
                pass
            if pdf["file"].isin(list(bad)).any():
                raise RuntimeError("no service")
            yield from length_scorer(iter([pdf]))
    return run


def called(folder):
    return sorted(n.split(".")[0] for n in os.listdir(folder))


def total(spark, rows, names):
    return {f: t for f, t in rows.withColumn("tok", Prompt().submitted("text")).groupBy("file").sum("tok").collect() if f in names}


@pytest.mark.parametrize("wave_files, sent", [(1, "abc"), (2, "abcd"), (4, "abcd"), (None, "abc")])
def test_files_after_a_failed_wave_are_not_sent(spark, tmp_path, wave_files, sent):
    notes, out = str(tmp_path / "notes"), str(tmp_path / "out")
    os.makedirs(notes)
    rows = files(spark)
    jobs.run_job(rows, Prompt(), out, prices(spark), "sk-test-0123456789", "20240201T000000", wave_files=wave_files,
                 scorer=noting_scorer(notes, "c"), halt_on_chunk_failure=False)
    assert called(notes) == sorted(sent)
    got = runs.read_results(spark, out)
    assert sorted(r.file for r in got.select("file").distinct().collect()) == ["a", "b", "c"]
    assert sorted(r.request_id for r in runs.read_usage(spark, out).collect()) == ["file:a", "file:b"]
    daily = runs.read_daily(spark, out).collect()
    assert [r.tokens_submitted for r in daily] == [sum(total(spark, rows, sent).values())]  # every token that was sent


def test_without_halting_every_file_is_sent(spark, tmp_path):
    notes, out = str(tmp_path / "notes"), str(tmp_path / "out")
    os.makedirs(notes)
    jobs.run_job(files(spark), Prompt(), out, prices(spark), None, "20240201T000000", halt_on_file_failure=False,
                 scorer=noting_scorer(notes, "c"), halt_on_chunk_failure=False)
    assert called(notes) == list("abcdef")
    assert runs.read_results(spark, out).count() == 24


def test_a_killed_run_is_repeated_without_second_copies(spark, tmp_path, monkeypatch):
    notes, out = str(tmp_path / "notes"), str(tmp_path / "out")
    os.makedirs(notes)
    args = (files(spark, "abcd"), Prompt(), out, prices(spark), "sk-test-0123456789", "20240201T000000")

    def die(*a, **k):
        raise KeyboardInterrupt("killed between the sinks")

    with monkeypatch.context() as m:
        m.setattr(jobs, "grade_usage", die)  # results and daily tokens are written, events are not
        with pytest.raises(KeyboardInterrupt):
            jobs.run_job(*args, wave_files=2, scorer=noting_scorer(notes))
    assert os.path.isdir(os.path.join(out, "runs", "run_ts=20240201T000000", "results"))
    assert runs.read_results(spark, out) is None and runs.read_daily(spark, out).count() == 0  # nothing counts yet
    jobs.run_job(*args, wave_files=2, scorer=noting_scorer(notes))
    assert called(notes) == list("abcd")  # nothing is paid for twice
    assert runs.read_results(spark, out).count() == 16 and runs.read_usage(spark, out).count() == 4
    assert len(runs.read_daily(spark, out).collect()) == 1
    with pytest.raises(FileExistsError):
        jobs.run_job(*args, wave_files=2, scorer=noting_scorer(notes))
    # a second run adds to the day
    first = runs.read_daily(spark, out).first().tokens_submitted
    jobs.run_job(*args[:-1], "20240201T120000", wave_files=4, scorer=noting_scorer(notes))
    assert runs.read_daily(spark, out).first().tokens_submitted == 2 * first
    assert runs.read_results(spark, out).groupBy("run_ts").count().count() == 2


def test_empty_input(spark, tmp_path):
    out = str(tmp_path / "out")
    jobs.run_job(files(spark).limit(0), Prompt(), out, prices(spark), None, "20240201T000000")
    assert runs.read_results(spark, out).count() == 0 and runs.read_usage(spark, out).count() == 0
