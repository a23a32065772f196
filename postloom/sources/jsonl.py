"""Line-delimited JSON: tolerant scans, raw replay and append-only logs."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from postloom.functions import answers as A
from postloom.functions import text as T

APPEND_ID, APPEND_POSITION = "append_id", "append_position"
RAW_SCHEMA = (
    "event_id STRING, pubkey STRING, created_at BIGINT, content STRING, relay ARRAY<STRING>"
)


def _read_lines(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Text lines of ``path``; an absent path gives an empty table."""
    try:
        return spark.read.text(path, wholetext=whole)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error.getCondition()):
            return spark.createDataFrame([], "value STRING")
        raise


def ordered_lines(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Text lines with ``line_order``, a struct that sorts files by name and lines by their place in the file."""
    empty = "value STRING, line_order STRUCT<file: STRING, start: BIGINT, line: BIGINT>"
    try:
        lines = spark.read.text(path, wholetext=whole)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error.getCondition()):
            return spark.createDataFrame([], empty)
        raise
    # Within one split of one file the generated id grows from line to line.
    order = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )
    return lines.select("value", order.alias("line_order"))


def variant_fields(rows: DataFrame, schema: str | t.StructType, variant: str = "record") -> DataFrame:
    """Typed columns out of a VARIANT; a value of another type becomes null."""
    struct = schema if isinstance(schema, t.StructType) else t.StructType.fromDDL(schema)
    extra = [c for c in rows.columns if c != variant]
    fields = [
        F.try_variant_get(F.col(variant), f"$.{f.name}", f.dataType.simpleString()).alias(f.name)
        for f in struct.fields
    ]
    return rows.select(*extra, *fields)


def scan_jsonl_records(spark: SparkSession, path: str) -> DataFrame:
    """One VARIANT ``record`` per parseable, non-blank line."""
    lines = _read_lines(spark, path).select(T.strip_spaces(F.col("value")).alias("line"))
    parsed = lines.filter(F.col("line") != "").select(A.parse_json_text(F.col("line")).alias("record"))
    return parsed.filter(F.col("record").isNotNull())


def scan_log_records(spark: SparkSession, path: str) -> DataFrame:
    """``record`` of each usable log line and ``record_order``, which sorts lines as they were appended.

    Lines of :func:`append_log` carry the number of their append and their position in it. Lines of
    other writers come before those, by file name and place in the file: a log that others split over
    several files has to name them in order.
    """
    lines = ordered_lines(spark, path).withColumn("line", T.strip_spaces(F.col("value"))).filter(F.col("line") != "")
    parsed = lines.select(A.parse_json_text(F.col("line")).alias("record"), "line_order").filter(F.col("record").isNotNull())
    place = F.struct(
        F.coalesce(F.try_variant_get("record", f"$.{APPEND_ID}", "bigint"), F.lit(-1)).alias("append"),
        F.coalesce(F.try_variant_get("record", f"$.{APPEND_POSITION}", "bigint"), F.lit(-1)).alias("position"),
        "line_order",
    )
    return parsed.select("record", place.alias("record_order"))


def scan_jsonl(spark: SparkSession, path: str, schema: str | t.StructType) -> DataFrame:
    """Typed rows of a JSONL file; blank and broken lines are skipped, an absent file is empty."""
    return variant_fields(scan_jsonl_records(spark, path), schema)


def raw_replay(spark: SparkSession, path: str, schema: str = RAW_SCHEMA) -> DataFrame:
    """Stored raw posts with a usable event id."""
    return scan_jsonl(spark, path, schema).filter(F.coalesce("event_id", F.lit("")) != "")


def raw_replay_stream(
    spark: SparkSession, path: str, schema: str = RAW_SCHEMA, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Streaming replay of a folder of JSONL files; ``max_files_per_trigger`` bounds the intake."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    lines = reader.load(path).select(A.parse_json_text(T.strip_spaces(F.col("value"))).alias("record"))
    rows = variant_fields(lines.filter(F.col("record").isNotNull()), schema)
    return rows.filter(F.coalesce("event_id", F.lit("")) != "")


def append_log(rows: DataFrame, path: str, order: str | None = None) -> None:
    """Append outcomes to a JSONL log, one object per row, null fields left out.

    Each row also carries the time of its append in nanoseconds and its position in it (the number in column ``order``,
    or its place in ``rows``), so that "the last one wins" does not depend on how files are named or split.
    """
    position = F.monotonically_increasing_id() if order is None else F.col(order).cast("bigint")
    marked = rows.withColumns({APPEND_ID: F.lit(time.time_ns()), APPEND_POSITION: position})
    marked.write.mode("append").json(path)
