"""Evaluation of predictions, and the steps between labeled rows and a training run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.operators.keyed import cap_per_key
from postloom.operators.labels import QA_LABEL

SPLITS = (("train", 0.8), ("val", 0.1), ("test", 0.1))
MAX_QA_RATE = 0.03


def group_split(rows: DataFrame, group: str = "pubkey", splits: tuple = SPLITS, seed: int = 42) -> DataFrame:
    """Add ``split`` so that all rows of one group fall into the same part.

    The part follows from the md5 of seed and group alone, so no row is moved and the parts are
    right in expectation over groups. A null group counts as one group with an empty name.
    """
    name = F.coalesce(F.col(group).cast("string"), F.lit(""))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 8)
    place = F.conv(digits, 16, 10).cast("bigint") / F.lit(float(16**8))
    part, bound = F.lit(splits[-1][0]), 0.0
    bounds = []
    for label, share in splits[:-1]:
        bound += share
        bounds.append((label, round(bound, 9)))
    for label, upper in reversed(bounds):
        part = F.when(place < upper, F.lit(label)).otherwise(part)
    return rows.withColumn("split", part)


def drop_qa(rows: DataFrame, label: str = "label", reassign: Column | None = None) -> DataFrame:
    """Rows without the "cannot be classified" label, or with ``reassign`` in its place where that is not null."""
    is_qa = F.coalesce(F.col(label) == QA_LABEL, F.lit(False))
    if reassign is None:
        return rows.filter(~is_qa)
    kept = rows.filter(~is_qa | reassign.isNotNull())
    return kept.withColumn(label, F.when(is_qa, reassign).otherwise(F.col(label)))


def class_weights(rows: DataFrame, label: str = "label_id") -> DataFrame:
    """Per label ``count`` and the inverse-frequency weight ``rows / (labels * count)``; one row a label."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    every = Window.partitionBy()
    return counts.withColumn("weight", F.sum("count").over(every) / (F.count(F.lit(1)).over(every) * F.col("count")))


def confusion_matrix(predictions: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """``gold, predicted, count`` of every pair that occurs."""
    return predictions.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("count"))


def class_report(predictions: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Per label ``support``, ``precision``, ``recall`` and ``f1``; a ratio over nothing is 0.

    Every label that occurs as gold or prediction has a row. The pairs are counted first, so a
    frequent label is a few rows when the counts meet.
    """
    pairs = confusion_matrix(predictions, gold, predicted)
    right = F.when(F.col("gold") == F.col("predicted"), F.col("count")).otherwise(0)
    sides = F.array(
        F.struct(F.col("gold").alias("label"), F.col("count").alias("support"), F.lit(0).cast("bigint").alias("named"), right.cast("bigint").alias("right")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("count").alias("named"), F.lit(0).cast("bigint").alias("right")),
    )
    totals = pairs.select(F.inline(sides)).filter(F.col("label").isNotNull()).groupBy("label").agg(*(F.sum(c).alias(c) for c in ("support", "named", "right")))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return totals.select(
        "label",
        "support",
        ratio(F.col("right"), F.col("named")).alias("precision"),
        ratio(F.col("right"), F.col("support")).alias("recall"),
        ratio(2 * F.col("right"), F.col("support") + F.col("named")).alias("f1"),
    )


def macro_f1(predictions: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """One row: mean F1, precision and recall over the labels of :func:`class_report`, and how many there are."""
    report = class_report(predictions, gold, predicted)
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("f1", "precision", "recall")]
    return report.agg(*means, F.count(F.lit(1)).alias("labels"))


def top_k_accuracy(predictions: DataFrame, top: str = "top", gold: str = "gold") -> DataFrame:
    """One row: share of rows whose gold label is among the listed ones (array ``top``), and the rows."""
    hit = F.coalesce(F.array_contains(F.col(top), F.col(gold)), F.lit(False))
    return predictions.agg(F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("rows"))


def reliability(predictions: DataFrame, confidence: str = "confidence", correct: str = "correct", bins: int = 10) -> DataFrame:
    """Per bin of equal width ``bin, rows, confidence, accuracy``; a confidence of 1 belongs to the last bin."""
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(confidence) * bins).cast("int")))
    known = predictions.filter(F.col(confidence).isNotNull())
    return known.groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(confidence).alias("confidence"),
        F.avg(F.coalesce(F.col(correct), F.lit(False)).cast("double")).alias("accuracy"),
    )


def calibration_error(predictions: DataFrame, confidence: str = "confidence", correct: str = "correct", bins: int = 10) -> DataFrame:
    """One row: expected calibration error over the bins of :func:`reliability`, its largest gap, and the rows."""
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    return reliability(predictions, confidence, correct, bins).agg(
        F.coalesce(F.sum(gap * F.col("rows")) / F.sum("rows"), F.lit(0.0)).alias("ece"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("largest_gap"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
    )


def review_sample(rows: DataFrame, per_label: int = 20, seed: int = 42, label: str = "label", row_id: str = "event_id") -> DataFrame:
    """``per_label`` rows of each label for human review, with their ``rank``; chosen by the md5 of seed and id."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))
    return cap_per_key(rows.withColumn("_digest", digest), [label], [F.col("_digest"), F.col(row_id)], per_label, rank="rank").drop("_digest")


def qa_rate(rows: DataFrame, label: str = "label", maximum: float = MAX_QA_RATE) -> DataFrame:
    """One row: rows, how many cannot be classified, their share, and whether that exceeds ``maximum``."""
    counted = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == QA_LABEL).alias("qa_count"))
    rate = F.when(F.col("rows") > 0, F.col("qa_count") / F.col("rows")).otherwise(F.lit(0.0))
    return counted.withColumn("qa_rate", rate).withColumn("too_high", F.col("qa_rate") > maximum)


def oversample(rows: DataFrame, label: str = "label_id", split: str | None = "split", max_factor: int = 10) -> DataFrame:
    """Training rows of rare labels repeated, with ``copy`` counted from 0.

    A label is repeated ``round(largest / count)`` times, at least once and at most ``max_factor`` times. Rows of
    other splits stay single; with ``split`` null all rows are training rows. Counts of labels are
    one small row each.
    """
    is_train = F.lit(True) if split is None else F.coalesce(F.col(split) == "train", F.lit(False))
    counts = rows.filter(is_train).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    factors = counts.select(
        F.col(label).alias("_label"),
        F.least(F.lit(int(max_factor)), F.greatest(F.lit(1), F.round(F.max("_n").over(Window.partitionBy()) / F.col("_n")).cast("int"))).alias("_factor"),
    )
    joined = rows.join(factors, rows[label].eqNullSafe(F.col("_label")), "left")
    factor = F.when(is_train, F.coalesce("_factor", F.lit(1))).otherwise(F.lit(1))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(0), factor - 1))).drop("_label", "_factor")
