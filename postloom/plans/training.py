"""Training export and subset files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators.export import (
    export_order,
    merge_sources,
    merge_training,
    normalize_records,
    training_label_counts,
    training_summary,
)
from postloom.operators.keyed import side_by_side
from postloom.operators.labels import LABEL_SET_VERSION
from postloom.operators.sampling import coverage_subset
from postloom.session import materialize
from postloom.sources.snapshots import document_present, source_records


@dataclass
class TrainingSet:
    normalized: DataFrame
    rows: DataFrame

    def summary(self) -> DataFrame:
        return training_summary(self.normalized)

    def label_counts(self) -> DataFrame:
        return training_label_counts(self.rows)


def build_training_set(real: DataFrame, synthetic: DataFrame, dim: DataFrame) -> TrainingSet:
    """Merged training rows of real and synthetic source records, later records winning.

    Normalized records feed the merge and the summary, so they are written once.
    """
    normalized = materialize(normalize_records(merge_sources(real, synthetic), dim), "normalized")
    return TrainingSet(normalized, merge_training(normalized))


def manifest(
    built: TrainingSet,
    real: DataFrame,
    synthetic: DataFrame,
    dim: DataFrame,
    present: dict[str, bool] | None = None,
    label_version: str = LABEL_SET_VERSION,
) -> DataFrame:
    """One row: label set, records seen per input file kind, and the output counts.

    ``present`` tells per kind (real, synthetic) whether its snapshot document exists; without it a document
    counts as there if it has entries. ``label_version`` names the label map that ``dim`` was read from.
    """

    def seen(df: DataFrame, name: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias(f"{name}_records_seen"),
            (F.lit(present[name]) if present else F.coalesce(F.bool_or(F.col("file_rank") == 0), F.lit(False))).alias(f"{name}_snapshot_present"),
            F.coalesce(F.bool_or(F.col("file_rank") == 1), F.lit(False)).alias(f"{name}_log_present"),
        )

    labels = dim.agg(F.count_if(~F.col("is_qa")).alias("label_map_count")).withColumn(
        "label_map_version", F.lit(label_version)
    )
    counts = built.summary().select(
        "total_count",
        "real_count",
        "synthetic_count",
        "duplicate_event_ids_overwritten",
        "missing_event_ids_assigned",
    )
    return side_by_side(labels, seen(real, "real"), seen(synthetic, "synthetic"), counts)


def export_training_set(
    spark: SparkSession, data_dir: str, out_dir: str, dim: DataFrame, document_per_line: bool = False
) -> TrainingSet:
    """Read both sides below ``data_dir``, merge, and write dataset, summary and manifest.

    Layout: ``{real,synthetic}-labels.json`` snapshots and ``{real,synthetic}-log`` line logs.
    The dataset is range-sorted, so its part files in name order are the export order.
    """
    real, synthetic = (
        source_records(
            spark, f"{data_dir}/{kind}-labels.json", f"{data_dir}/{kind}-log", document_per_line
        )
        for kind in ("real", "synthetic")
    )
    built = build_training_set(real, synthetic, dim)
    export_order(built.rows).write.mode("overwrite").json(f"{out_dir}/dataset")
    built.summary().write.mode("overwrite").json(f"{out_dir}/summary")
    built.label_counts().write.mode("overwrite").json(f"{out_dir}/label_counts")
    present = {
        kind: document_present(spark, f"{data_dir}/{kind}-labels.json", document_per_line) for kind in ("real", "synthetic")
    }
    manifest(built, real, synthetic, dim, present).write.mode("overwrite").json(f"{out_dir}/manifest")
    return built


def uncovered_labels(rows: DataFrame, subset: DataFrame, num_labels: int) -> DataFrame:
    """In-range labels of the data that the subset misses."""
    seen = rows.filter(F.col("label_id").between(0, int(num_labels) - 1)).select("label_id").distinct()
    return seen.join(subset.select("label_id").distinct(), "label_id", "left_anti")


def subset_meta(
    rows: DataFrame, num_labels: int, per_label: int = 2, max_total: int = 64, max_chars: int = 512
) -> DataFrame:
    """One row about a coverage-first subset: sizes, coverage and the selection parameters."""
    in_range = F.col("label_id").between(0, int(num_labels) - 1)
    data = rows.agg(
        F.count_distinct(F.when(in_range, F.col("label_id"))).alias("labels_in_dataset"),
        F.count_if(~in_range).alias("skipped_out_of_range"),
    )
    subset = coverage_subset(rows, num_labels, per_label, max_total, max_chars).agg(
        F.count(F.lit(1)).alias("count"), F.count_distinct("label_id").alias("labels_covered")
    )
    return side_by_side(data, subset).withColumns(
        {
            "labels_not_in_subset": F.col("labels_in_dataset") - F.col("labels_covered"),
            "num_labels": F.lit(int(num_labels)),
            "per_label": F.lit(int(per_label)),
            "max_total": F.lit(int(max_total)),
            "max_chars": F.lit(int(max_chars)),
        }
    )


def subset_label_counts(subset: DataFrame) -> DataFrame:
    """Rows of the subset per label; a label without rows is not listed."""
    return subset.groupBy("label_id").agg(F.count(F.lit(1)).alias("count"))


def write_subset(rows: DataFrame, num_labels: int, path: str, **options: int) -> None:
    """Subset rows (``content, label_id``), their meta row, rows per label, and labels that are not covered."""
    subset = coverage_subset(rows, num_labels, **options)
    subset.select("content", "label_id").write.mode("overwrite").json(f"{path}/subset")
    subset_meta(rows, num_labels, **options).write.mode("overwrite").json(f"{path}/subset_meta")
    subset_label_counts(subset).write.mode("overwrite").json(f"{path}/subset_label_counts")
    uncovered_labels(rows, subset, num_labels).write.mode("overwrite").json(f"{path}/subset_uncovered")
