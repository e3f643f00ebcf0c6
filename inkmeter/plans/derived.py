"""Data Spark derives from the driver's tables for the grading flow.

Answer lines stand in for the scoring service's output file.  They are a
pure function of each ``documents`` row, so they grow with the table, and
they cover every shape of the answer contract:

* ``doc_id % 23 = 0``: no line (unanswered request);
* ``% 17``: API error object; ``% 19``: empty ``choices``;
  ``% 37``: ``response`` and ``error`` both ``{}``; ``% 41``: null content;
  ``% 13``: a two-line answer; otherwise the answer ``1 + n_chars % 5``;
* ``% 29``: a second, later answer for the same id (last one wins);
* ``% 31``: an extra line without ``custom_id``; ``% 43``: a truncated line;
* ``% 47``: an answer whose id matches no request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmeter.functions import ids, responses
from inkmeter.plans import inputs
from inkmeter.session import ensure_checkpoint_dir

# Line templates of the answer file (service JSON shape).
OK_LINE = ('{"id": "batch_req_%d", "custom_id": "%s", "response": {"status_code": 200, "body": '
           '{"choices": [{"message": {"content": "%s"}}]}}, "error": null}')
ERR_LINE = ('{"id": "batch_req_%d", "custom_id": "%s", "response": null, "error": '
            '{"code": "rate_limit_exceeded", "message": "Too many requests"}}')
EMPTY_LINE = ('{"id": "batch_req_%d", "custom_id": "%s", "response": {"status_code": 200, "body": '
              '{"choices": []}}, "error": null}')
UNKNOWN_LINE = '{"id": "batch_req_%d", "custom_id": "%s", "response": {}, "error": {}}'
NULL_LINE = ('{"id": "batch_req_%d", "custom_id": "%s", "response": {"status_code": 200, "body": '
             '{"choices": [{"message": {"content": null}}]}}, "error": null}')
NOID_LINE = ('{"id": "batch_req_%d", "response": {"status_code": 200, "body": '
             '{"choices": [{"message": {"content": "1"}}]}}, "error": null}')
BROKEN_LINE = '{"custom_id": "%s-broken", "response": '

FAILED_CHUNK = ("src1", 2)


def failing_scorer(file: str, part: int | None = None, scorer=None):
    """The offline scorer, but the call for one designated chunk (or for every chunk of a file) raises."""
    from inkmeter.operators.scoring import length_scorer

    scorer = scorer or length_scorer

    def run(batches):
        for pdf in batches:
            if ((pdf["file"] == file) & (part is None or pdf["part"] == part)).any():
                raise RuntimeError(f"Simulated failure for {file}_part{part}")
            yield from scorer(iter([pdf]))
    return run


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Input rows with their deterministic request id."""
    return inputs.documents_as_files(spark, sf).withColumn("custom_id", ids.row_id("file", "pos"))


def answer_lines(spark: SparkSession, sf: str) -> DataFrame:
    """pos (doc_id), k (line order within a document), line."""
    d = inputs.table(spark, sf, "documents").select(
        "doc_id", "n_chars", ids.row_id("source", "doc_id").alias("cid"),
        F.md5(F.concat(F.lit("orphan|"), F.col("doc_id").cast("string"))).alias("orphan"))
    i, cid = F.col("doc_id"), F.col("cid")
    ans = (F.lit(1) + F.col("n_chars") % 5).cast("string")
    alt = (F.lit(5) - F.col("n_chars") % 5).cast("string")
    main = (F.when(i % 23 == 0, F.lit(None).cast("string"))
            .when(i % 17 == 0, F.format_string(ERR_LINE, i, cid))
            .when(i % 19 == 0, F.format_string(EMPTY_LINE, i, cid))
            .when(i % 37 == 0, F.format_string(UNKNOWN_LINE, i, cid))
            .when(i % 41 == 0, F.format_string(NULL_LINE, i, cid))
            .when(i % 13 == 0, F.format_string(OK_LINE, i, cid, F.concat(ans, F.lit("\\n"), alt)))
            .otherwise(F.format_string(OK_LINE, i, cid, ans)))
    dup = F.when((i % 29 == 0) & (i % 23 != 0),
                 F.format_string(OK_LINE, i, cid, F.concat(F.lit("Score: "), alt)))
    noid = F.when(i % 31 == 0, F.format_string(NOID_LINE, i))
    broken = F.when(i % 43 == 0, F.format_string(BROKEN_LINE, cid))
    orphan = F.when(i % 47 == 0, F.format_string(OK_LINE, i, F.col("orphan"), ans))
    lines = F.array(*[F.struct(F.lit(k).alias("k"), c.alias("line"))
                      for k, c in enumerate([main, dup, noid, broken, orphan])])
    return (d.select(F.col("doc_id").alias("pos"), F.explode(lines).alias("l"))
            .select("pos", F.col("l.k").alias("k"), F.col("l.line").alias("line"))
            .filter(F.col("line").isNotNull()))


def parsed_answers(spark: SparkSession, sf: str) -> DataFrame:
    return responses.parse_lines(answer_lines(spark, sf), "line", keep=("pos", "k"))


def final_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Usable answers, one per id, last line wins.  Lines are parsed once, into a checkpointed table."""
    ensure_checkpoint_dir(spark)
    usable = responses.with_id(parsed_answers(spark, sf)).drop("corrupt").checkpoint(eager=True)
    return responses.dedupe_last(usable, "custom_id", ["pos", "k"])
