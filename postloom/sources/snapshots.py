"""JSON document snapshots, label maps and all-or-nothing snapshot tables."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import answers as A
from postloom.operators.keyed import last_per_key, side_by_side
from postloom.sources.jsonl import ordered_lines, scan_log_records
from postloom.sources.large_documents import document_entries


def scan_snapshot_records(
    spark: SparkSession, path: str, array: str = "items", document_per_line: bool = False, split: bool = False, range_bytes: int | None = None
) -> DataFrame:
    """Entries of the ``array`` field of JSON documents, with position and the document's model.

    Columns ``record`` (VARIANT), ``source_record_index``, ``record_order``, ``fallback_model`` and ``source_file``.
    Documents follow each other by their number ``document_order`` if they have one, then by file name and
    line; ``record_order`` sorts all entries that way. A missing or corrupt document gives no rows. A document is one file, read by one task, or one
    line with ``document_per_line``, which lets many documents share splittable files. With ``split`` each file is
    one document of any size, which many tasks read in ranges of ``range_bytes``.
    """
    if split:
        found = document_entries(spark, path, array, range_bytes)
        line = F.struct(F.col("file"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("line"))
        place = F.struct(F.col("rank").alias("append"), F.lit(-1).cast("bigint").alias("position"), line.alias("line_order"))
        return found.select(
            F.col("source_record_index").cast("int").alias("source_record_index"), "record", F.col("model").alias("fallback_model"),
            F.lit(_base_name(path)).alias("source_file"), place.alias("record_order"),
        )
    listed = _documents(spark, path, document_per_line).filter(A.kind_of(F.col("doc"), f"$.{array}") == "array")
    rank = F.coalesce(F.try_variant_get("doc", "$.document_order", "bigint"), F.lit(-1))
    entries = listed.select(
        F.posexplode(F.try_variant_get("doc", f"$.{array}", "array<variant>")).alias("source_record_index", "record"),
        A.string_field(F.col("doc"), "$.model").alias("fallback_model"),
        F.lit(_base_name(path)).alias("source_file"),
        rank.alias("_rank"),
        "line_order",
    )
    # The same shape as in logs: the document's place before the place in the document.
    place = F.struct(F.col("_rank").alias("append"), F.lit(-1).cast("bigint").alias("position"), "line_order")
    return entries.withColumn("record_order", place).drop("_rank", "line_order")


def _documents(spark: SparkSession, path: str, document_per_line: bool) -> DataFrame:
    texts = ordered_lines(spark, path, whole=not document_per_line)
    return texts.select(F.try_parse_json(F.col("value")).alias("doc"), "line_order").filter(F.col("doc").isNotNull())


def document_present(spark: SparkSession, path: str, document_per_line: bool = False) -> bool:
    """Whether the path holds a readable document, with or without entries."""
    return not _documents(spark, path, document_per_line).isEmpty()


def _base_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def source_records(
    spark: SparkSession, snapshot_path: str, log_path: str, document_per_line: bool = False
) -> DataFrame:
    """Source records of one side: snapshot items first, then successful log rows.

    Log rows take the snapshot's model as their fallback. ``record_order`` is the order in which records
    overwrite each other; ``source_record_index`` is an entry's index in its document, and a log row's
    position in its append.
    """
    snapshot = scan_snapshot_records(spark, snapshot_path, document_per_line=document_per_line)
    snapshot = snapshot.withColumn("file_rank", F.lit(0))
    model = snapshot.agg(F.max("fallback_model").alias("fallback_model"))
    log = scan_log_records(spark, log_path).filter(A.true_field(F.col("record"), "$.ok"))
    log = log.withColumns(
        {
            "source_record_index": F.col("record_order.position"),
            "source_file": F.lit(_base_name(log_path)),
            "file_rank": F.lit(1),
        }
    )
    log = side_by_side(log, model)
    return snapshot.withColumn("source_record_index", F.col("source_record_index").cast("long")).unionByName(log)


def write_label_map(dim: DataFrame, path: str) -> None:
    """The label dimension as a label-map document: ``labels[]`` of id, char, def, and ``qa``."""
    entry = F.struct(F.col("label_id").alias("id"), F.col("label").alias("char"), F.col("definition").alias("def"))
    doc = dim.agg(
        F.array_sort(F.collect_list(F.when(~F.col("is_qa"), entry))).alias("labels"),
        F.max(F.when(F.col("is_qa"), entry)).alias("qa"),
    )
    doc.coalesce(1).write.mode("overwrite").json(path)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """Label dimension from a label-map document (``labels[]`` of id, char, def, plus ``qa``).

    A char that is listed twice keeps its last entry. Raises when the document lists no label.
    """
    entry = "struct<id:int,char:string,def:string>"
    docs = spark.read.schema(f"labels array<{entry}>, qa {entry}").option("multiLine", True).json(path)
    labels = docs.select(F.posexplode("labels").alias("pos", "e"), F.lit(False).alias("is_qa"))
    qa = docs.select(F.lit(-1).alias("pos"), F.col("qa").alias("e"), F.lit(True).alias("is_qa"))
    listed = labels.unionByName(qa).filter("e.id is not null and e.char is not null").withColumn("char", F.col("e.char"))
    dim = last_per_key(listed, ["char", "is_qa"], "pos").select(
        F.col("e.id").alias("label_id"),
        F.col("e.char").alias("label"),
        F.coalesce("e.def", F.lit("")).alias("definition"),
        "is_qa",
    )
    if dim.filter(~F.col("is_qa")).isEmpty():
        raise ValueError(f"no labels found in {path}")
    return dim


def num_labels(dim: DataFrame) -> DataFrame:
    """One row: the width of a classification head that fits every label id."""
    return dim.agg((F.max("label_id") + 1).alias("num_labels"), F.count(F.lit(1)).alias("labels"))


def write_snapshot(rows: DataFrame, root: str, fmt: str = "parquet") -> int:
    """Write a new version of a snapshot table; readers see it only once it is whole.

    Data go to a fresh version folder. A one-row commit entry is appended after the write
    succeeded, so a failed or half-moved write is never read.
    """
    version = time.time_ns() // 1000
    rows.write.format(fmt).save(f"{root}/data/version={version}")
    spark = rows.sparkSession
    spark.range(1).select(F.lit(version).alias("version")).write.mode("append").json(f"{root}/commits")
    return version


def read_snapshot(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame | None:
    """The latest committed version, or None when nothing was committed yet."""
    try:
        commits = spark.read.schema("version BIGINT").json(f"{root}/commits")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error.getCondition()):
            return None
        raise
    latest = commits.agg(F.max("version")).first()[0]
    return None if latest is None else spark.read.format(fmt).load(f"{root}/data/version={latest}")
