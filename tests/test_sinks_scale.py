"""Large chunks are written by many tasks, folders of equal names stay apart, malformed usage lines raise and are listed."""

import json
import os

import pytest
from pyspark.sql import functions as F

from inkmeter.plans import jobs
from inkmeter.sources import readers, writers


def test_a_large_chunk_is_cut_by_position(spark, tmp_path):
    df = spark.range(1000).repartition(3).select(F.lit("f").alias("file"), F.when(F.col("id") < 990, 1).otherwise(2).alias("part"),
                                  F.col("id").alias("pos"), F.col("id").alias("x"))
    out = str(tmp_path / "chunks")
    writers.write_chunks(df, out, max_rows=100)
    big = [os.path.join(out, "file=f", "part=1", n) for n in os.listdir(os.path.join(out, "file=f", "part=1")) if n.startswith("part-")]
    held = [[r.pos for r in spark.read.parquet(f).collect()] for f in big]
    assert len(held) >= 10 and all(len(p) <= 100 for p in held)
    assert len([n for n in os.listdir(os.path.join(out, "file=f", "part=2")) if n.startswith("part-")]) == 1
    assert spark.read.parquet(out).count() == 1000


def test_positions_at_the_ends_of_the_range(spark, tmp_path):
    lo, hi = -(1 << 63), (1 << 63) - 1
    df = spark.createDataFrame([("f", 1, p) for p in (lo, lo, 0, hi, hi)] + [("f", 1, None)], "file string, part int, pos long")
    writers.write_chunks(df, str(tmp_path / "c"), max_rows=2)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 6


def test_request_files_hold_at_most_so_many_lines(spark, tmp_path):
    df = spark.range(95).select(F.lit("c").alias("chunk_id"), F.col("id").cast("string").alias("request"), F.col("id").alias("pos"))
    out = str(tmp_path / "req")
    writers.write_requests(df, out, max_records=20)
    names = [os.path.join(out, "chunk_id=c", n) for n in os.listdir(os.path.join(out, "chunk_id=c")) if n.startswith("part-")]
    lines = [open(n).read().split() for n in names]
    assert len(lines) == 5 and max(map(len, lines)) <= 20 and sorted(int(x) for f in lines for x in f) == list(range(95))


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for folder, word in (("a", "apple"), ("b", "berry")):
        os.makedirs(tmp_path / "in" / folder)
        with open(tmp_path / "in" / folder / "x.jsonl", "w") as f:
            f.write("".join(json.dumps({"response": f"{word} {i}"}) + "\n" for i in range(12)))
    out = str(tmp_path / "out")
    report = jobs.split_files(spark, str(tmp_path / "in"), out, token_limit=0, chunk_tokens=100, recursive=True).collect()
    assert {r.file.rsplit("/in/")[-1] for r in report} == {"a/x.jsonl", "b/x.jsonl"} and all(r.needs_split for r in report)
    back = spark.read.json(out)
    assert back.groupBy("file").count().count() == 2 and back.count() == 24
    first = {r.file: set(r.words) for r in back.groupBy("file").agg(F.collect_set(F.split("text", " ")[0]).alias("words")).collect()}
    assert sorted(map(tuple, first.values())) == [("apple",), ("berry",)]


def test_malformed_usage_lines(spark, tmp_path):
    path = str(tmp_path / "u.jsonl")
    good = {"timestamp": "2024-01-01T10:00:00.000000", "api_key_prefix": "k", "model": "m", "input_tokens": 1,
            "output_tokens": 2, "total_tokens": 3, "cost": 0.5, "request_id": "r"}
    with open(path, "w") as f:
        f.write(json.dumps(good) + "\n\n")
    assert readers.read_usage_events(spark, path).count() == 1
    assert readers.rejected_usage_lines(spark, path).count() == 0
    with open(path, "a") as f:
        f.write('{"timestamp": "2024-01-01T1\n')
    with pytest.raises(Exception):
        readers.read_usage_events(spark, path).collect()
    assert [r[0] for r in readers.rejected_usage_lines(spark, path).collect()] == ['{"timestamp": "2024-01-01T1']
