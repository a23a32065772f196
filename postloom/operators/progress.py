"""Label counts, deficits, completion, confidence reports and synthesis planning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions import text as T
from postloom.operators.keyed import side_by_side
from postloom.operators.labels import QA_LABEL, checked_labels

MIN_PER_LABEL = 50
HUMAN_CONFIDENCE = 0.6


def label_counts_full(labeled: DataFrame, dim: DataFrame) -> DataFrame:
    """``label_id, label, count`` for every target label, zeros included."""
    counts = labeled.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    targets = dim.filter(~F.col("is_qa")).select("label_id", "label")
    return targets.join(counts, "label", "left").select(
        "label_id", "label", F.coalesce("count", F.lit(0)).alias("count")
    )


def other_counts(labeled: DataFrame, dim: DataFrame) -> DataFrame:
    """Counts of labels that are no target (QA and unknown ones)."""
    targets = dim.filter(~F.col("is_qa")).select("label")
    counts = labeled.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    return counts.join(targets, "label", "left_anti")


def labels_below(counts: DataFrame, minimum: int = MIN_PER_LABEL) -> DataFrame:
    """Labels under the minimum, lowest first."""
    return counts.filter(F.col("count") < int(minimum)).orderBy("count", "label_id")


def lowest_labels(counts: DataFrame, minimum: int = MIN_PER_LABEL, n: int = 10) -> DataFrame:
    """The ``n`` lowest labels below the minimum (progress report)."""
    return labels_below(counts, minimum).limit(int(n))


def completion(counts: DataFrame, minimum: int = MIN_PER_LABEL) -> DataFrame:
    """One row: how many labels are below the minimum and whether none is."""
    return counts.agg(
        F.count_if(F.col("count") < int(minimum)).alias("labels_below_count"),
        (F.count_if(F.col("count") < int(minimum)) == 0).alias("complete"),
    )


def progress_report(
    labeled: DataFrame, seen_failures: DataFrame | None, dim: DataFrame, minimum: int = MIN_PER_LABEL
) -> DataFrame:
    """One row with totals, QA count, labels below target and the completion flag."""
    counts = label_counts_full(labeled, dim)
    parts = [completion(counts, minimum)]
    totals = labeled.agg(
        F.count(F.lit(1)).alias("total_labeled"),
        F.count_if(F.col("label") == QA_LABEL).alias("qa_count"),
    )
    if seen_failures is not None:
        parts.append(seen_failures.agg(F.count(F.lit(1)).alias("failures")))
    return side_by_side(totals, *parts).withColumn("min_per_label", F.lit(int(minimum)))


def pipeline_report(
    labeled: DataFrame,
    seen_failures: DataFrame | None,
    dim: DataFrame,
    minimum: int = MIN_PER_LABEL,
    stats: dict[str, int] | None = None,
    model: str | None = None,
) -> DataFrame:
    """One row: :func:`progress_report` with its lists, the run's counters ``stats`` and the model.

    ``label_counts`` lists every target label by id, ``qa_counts`` all other labels that occur, and
    ``labels_below_target`` those under the minimum, lowest first. A list has one entry a label.
    """
    counts = label_counts_full(labeled, dim)
    others = other_counts(labeled, dim).filter(F.col("label").isNotNull())
    entry = F.struct("label_id", "label", "count")
    below = F.struct("count", "label_id", "label")
    lists = (
        counts.agg(F.array_sort(F.collect_list(entry)).alias("label_counts")),
        others.agg(F.array_sort(F.collect_list(F.struct("label", "count"))).alias("qa_counts")),
        counts.filter(F.col("count") < int(minimum)).agg(F.array_sort(F.collect_list(below)).alias("labels_below_target")),
    )
    report = side_by_side(progress_report(labeled, seen_failures, dim, minimum), *lists)
    known = [F.lit(x) for name, n in (stats or {}).items() for x in (name, int(n))]
    return report.withColumns(
        {"stats": F.create_map(*known).cast("map<string, bigint>"), "model": F.lit(model).cast("string")}
    )


def label_deficits(
    counts: DataFrame, minimum: int = MIN_PER_LABEL, labels: Sequence[str] | None = None
) -> DataFrame:
    """``label_id, label, have, need``, largest need first.

    Without ``labels`` only labels in need are listed; an explicit list keeps all its labels and
    raises on an unknown one.
    """
    have = counts.select(
        "label_id",
        "label",
        F.col("count").alias("have"),
        F.greatest(F.lit(0).cast("long"), F.lit(int(minimum)) - F.col("count")).alias("need"),
    )
    kept = have.filter("need > 0") if labels is None else have.filter(F.col("label").isin(*checked_labels(labels)))
    return kept.orderBy(F.col("need").desc(), "label_id")


def synthesis_plan(deficits: DataFrame, batch: int = 10, max_rounds: int = 12) -> DataFrame:
    """Add ``planned_rounds = min(max_rounds, ceil(need / batch))``."""
    rounds = F.least(F.lit(int(max_rounds)), F.ceil(F.col("need") / F.lit(int(batch))))
    return deficits.withColumn("planned_rounds", rounds.cast("int"))


def combined_status(
    real: DataFrame, synthetic: DataFrame, dim: DataFrame, minimum: int = MIN_PER_LABEL
) -> DataFrame:
    """Real, synthetic and total count per target label with ``OK`` or ``need N``."""
    real_counts = label_counts_full(real, dim).withColumnRenamed("count", "real")
    synth_counts = label_counts_full(synthetic, dim).select("label", F.col("count").alias("synthetic"))
    joined = real_counts.join(synth_counts, "label").withColumn("total", F.col("real") + F.col("synthetic"))
    missing = F.lit(int(minimum)) - F.col("total")
    return joined.withColumn(
        "status", F.when(missing > 0, F.concat(F.lit("need "), missing.cast("string"))).otherwise("OK")
    ).select("label_id", "label", "real", "synthetic", "total", "status")


def needs_refinement(minimum: float = HUMAN_CONFIDENCE) -> Column:
    """Low confidence (null counts as 0) or flagged uncertain."""
    return (F.coalesce("confidence", F.lit(0.0)) < float(minimum)) | F.coalesce("is_uncertain", F.lit(False))


def refine_candidates(labeled: DataFrame, minimum: float = HUMAN_CONFIDENCE) -> DataFrame:
    return labeled.filter(needs_refinement(minimum))


def confidence_report(labeled: DataFrame, human_threshold: float = HUMAN_CONFIDENCE) -> DataFrame:
    """One row: mean, minimum, three confidence buckets and review counters."""
    conf = F.coalesce("confidence", F.lit(0.0))
    return labeled.agg(
        F.count(F.lit(1)).alias("labeled"),
        F.coalesce(F.avg(conf), F.lit(0.0)).alias("confidence_mean"),
        F.coalesce(F.min(conf), F.lit(0.0)).alias("confidence_min"),
        F.count_if(conf < 0.6).alias("bucket_low"),
        F.count_if((conf >= 0.6) & (conf < 0.8)).alias("bucket_mid"),
        F.count_if(conf >= 0.8).alias("bucket_high"),
        F.count_if("is_uncertain").alias("uncertain_count"),
        F.count_if(F.col("pass") == 2).alias("pass2_count"),
        F.count_if(needs_refinement(human_threshold)).alias("needs_human_review_count"),
    )


def label_share(predictions: DataFrame) -> DataFrame:
    """``id, char, def, count, share`` of predictions, most frequent first.

    The share divides by a window total over the already grouped rows, one per label.
    """
    counts = predictions.groupBy("id", "char", "def").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("share", F.col("count") / total).orderBy(F.col("count").desc(), "id")


def accuracy(predictions: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    return predictions.agg(
        F.avg((F.col(predicted) == F.col(gold)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("rows"),
    )


def skip_reason_counts(rows: DataFrame) -> DataFrame:
    """Rows per ``skip_reason``; kept rows count as ``kept``."""
    return rows.groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("skip_reason")).agg(
        F.count(F.lit(1)).alias("count")
    )


def select_approved(samples: DataFrame, limit: int = 0, order: str = "first_seq") -> DataFrame:
    """Approved samples; a positive ``limit`` keeps the first ones in order."""
    approved = samples.filter(F.col("review_status") == "approved")
    return approved.orderBy(order).limit(int(limit)) if limit > 0 else approved


def with_normalized_label(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.withColumn("normalized_label", T.normalize_label(F.col(label)))
