"""Readers for text tables, answers, prices and usage logs.

File order matters for "last wins" and chunking.  When the data carries no
position key, ``with_file_order`` derives one from the file path, the split
offset and the row's place inside its split, which is stable for a given
set of files.
"""

from __future__ import annotations

import os
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmeter.sources import splitread

SUPPORTED = (".csv", ".json", ".jsonl")

PRICING_SCHEMA = T.StructType([T.StructField("Model", T.StringType()),
                               T.StructField("Input", T.DoubleType()),
                               T.StructField("Output", T.DoubleType())])
PRICING_TEXT_SCHEMA = T.StructType([T.StructField("Model", T.StringType()),
                                    T.StructField("Input", T.StringType()),
                                    T.StructField("Output", T.StringType())])
USAGE_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()), T.StructField("api_key_prefix", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()), T.StructField("total_tokens", T.LongType()),
    T.StructField("cost", T.DoubleType()), T.StructField("request_id", T.StringType())])
DAILY_SCHEMA = T.StructType([T.StructField("date", T.DateType()),
                             T.StructField("api_key_prefix", T.StringType()),
                             T.StructField("tokens_submitted", T.LongType())])
ISO_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def with_file_order(df: DataFrame) -> DataFrame:
    """Add ``file`` (path), ``_block`` (split offset) and ``_row`` (order in the split)."""
    return (df.withColumn("file", F.col("_metadata.file_path"))
            .withColumn("_block", F.col("_metadata.file_block_start"))
            .withColumn("_row", F.monotonically_increasing_id()))


def read_csv(spark: SparkSession, path: str, schema=None, split: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """A1: header row; explicit schema preferred, inference optional.

    Malformed rows raise (``mode="PERMISSIVE"`` turns them into nulls).  A large file is read by many tasks, quoted line
    breaks included; ``split=False`` gives every file to one task, for quoting that is not RFC 4180.
    """
    if split:
        return splitread.parsed_csv(spark, path, schema, mode).select("r.*")
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", mode)
    return (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(path)


def read_json_array(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A2: files that hold one JSON array of objects, read by many tasks; malformed input raises."""
    return splitread.parsed_json(spark, path, schema).select("r.*")


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A3: JSON Lines (splittable); malformed lines raise."""
    r = spark.read.option("mode", "FAILFAST")
    return (r.schema(schema) if schema is not None else r).json(path)


def read_by_extension(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A4: choose the reader from the extension; anything else is an error."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".csv":
        return read_csv(spark, path, schema)
    if ext == ".json":
        return read_json_array(spark, path, schema)
    if ext == ".jsonl":
        return read_jsonl(spark, path, schema)
    raise ValueError(f"Unsupported file type: {ext} for file {path}")


def file_extensions(spark: SparkSession, directory: str, recursive: bool = False) -> set:
    """Extensions of the files in a folder (a listing of names; no file is read)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return set()
    out, files = set(), fs.listFiles(path, recursive)
    while files.hasNext():
        out.add(os.path.splitext(files.next().getPath().getName())[1].lower())
    return out


def absolute_path(spark: SparkSession, path: str) -> str:
    """A folder with its scheme, local ones as ``file:/…``, without a slash at its end."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub("^file:/+", "file:/", fs.makeQualified(hpath).toString().rstrip("/"))


def read_input_dir(spark: SparkSession, directory: str, schema=None, recursive: bool = False) -> DataFrame | None:
    """Every .csv/.json/.jsonl in a folder (``recursive``: and below), unioned by column name.

    Each source row keeps its file path as ``file``, its split offset as ``_block`` and its place in the split as
    ``_row`` (for file order); None when nothing matches.  Malformed input raises.
    """
    parts = []
    found = file_extensions(spark, directory, recursive)
    if ".csv" in found:
        parts.append(splitread.read_csv(spark, directory, schema, recursive=recursive, glob="*.csv"))
    if ".json" in found:
        parts.append(splitread.read_json_array(spark, directory, schema, recursive, "*.json"))
    if ".jsonl" in found:
        reader = spark.read.option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", recursive)
        try:
            parts.append(with_file_order((reader if schema is None else reader.schema(schema)).json(directory)))
        except AnalysisException as exc:  # files without a line have no schema
            if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_pricing_strict(spark: SparkSession, path: str) -> DataFrame:
    """Non-numeric prices fail the read (FAILFAST); order columns kept for last-wins."""
    df = (spark.read.option("header", True).option("mode", "FAILFAST")
          .schema(PRICING_SCHEMA).csv(path))
    return with_file_order(df)


def read_pricing_lenient(spark: SparkSession, path: str) -> DataFrame:
    """Rows whose prices do not parse are skipped."""
    raw = spark.read.option("header", True).schema(PRICING_TEXT_SCHEMA).csv(path)
    typed = raw.select("Model", F.col("Input").try_cast("double").alias("Input"),
                       F.col("Output").try_cast("double").alias("Output"))
    return with_file_order(typed.filter(F.col("Input").isNotNull() & F.col("Output").isNotNull()))


def latest_prices(prices: DataFrame) -> DataFrame:
    """G9 on prices: a model listed twice takes its last row."""
    from inkmeter.functions.responses import dedupe_last

    return dedupe_last(prices.select("Model", "Input", "Output", "file", "_block", "_row"),
                       "Model", ["file", "_block", "_row"]).select("Model", "Input", "Output")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def read_usage_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines usage events; blank lines skipped, malformed lines raise; a missing log is empty.

    :func:`rejected_usage_lines` lists what raises.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], USAGE_SCHEMA)
    return usage_reader(spark.read).json(path)


def usage_reader(reader):
    """The reader, or stream reader, of usage events: J1 and J2 raise on a malformed line, too."""
    return reader.schema(USAGE_SCHEMA).option("timestampFormat", ISO_TS).option("mode", "FAILFAST")


CORRUPT = "_corrupt_record"


def rejected_usage_lines(spark: SparkSession, path: str) -> DataFrame:
    """A8 audit: the text of every line that is no usage event."""
    schema = T.StructType([*USAGE_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"timestampFormat": ISO_TS, "columnNameOfCorruptRecord": CORRUPT}
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, options).getField(CORRUPT).alias(CORRUPT)).filter(F.col(CORRUPT).isNotNull())


def read_daily_log(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Daily usage log, one (indented) JSON array per file; missing -> empty, corrupt input skipped.

    ``multi_line=False`` reads one array per line.  :func:`rejected_daily_rows` lists what was skipped.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], DAILY_SCHEMA)
    return _daily_rows(spark, path, multi_line).filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def _daily_rows(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    schema = T.StructType([*DAILY_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", multi_line).json(path)


def rejected_daily_rows(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A9 audit: the text of every record that :func:`read_daily_log` skipped."""
    return _daily_rows(spark, path, multi_line).select("*").filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One text line per row with its file order."""
    return with_file_order(spark.read.text(path))
