"""Spark-native batch text grading and token accounting.

Everything is a ``DataFrame -> DataFrame`` function; the common entry points:

    from inkmeter import build_session, grade, grade_files, count_files, split_files
    from inkmeter.operators import packing, admission, scoring, results, ledger
    from inkmeter.functions import tokens, prompts, responses, ids
    from inkmeter.sources import readers, writers
    from inkmeter.streaming import usage as streams
"""

from inkmeter.session import build_session, ensure_checkpoint_dir, scratch_path


def __getattr__(name):
    # Jobs import pyspark SQL functions; load them on first use.
    if name in ("grade", "grade_files", "grade_usage", "count_files", "split_files", "split_report",
                "costs_report", "ingest_dir", "run_job", "FilePrompt"):
        from inkmeter.plans import jobs

        return getattr(jobs, name)
    raise AttributeError(name)


__all__ = ["build_session", "ensure_checkpoint_dir", "scratch_path", "grade", "grade_files", "grade_usage",
           "count_files", "split_files", "split_report", "costs_report", "ingest_dir", "run_job", "FilePrompt"]
