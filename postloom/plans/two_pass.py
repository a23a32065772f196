"""Batch labeling with resume and a second pass for doubtful rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import prompts as P
from postloom.operators.labeling import Labeler, OutcomeLog, label_with
from postloom.operators.progress import HUMAN_CONFIDENCE, confidence_report, refine_candidates
from postloom.operators.resume import ITEM_COLUMNS, item_shape, last_ok, pass2_overlay, remaining_retry_failed
from postloom.session import materialize
from postloom.sources.jsonl import scan_log_records, variant_fields

OUTCOME_SCHEMA = (
    "event_id STRING, pubkey STRING, created_at BIGINT, content STRING, label STRING, label_id INT, "
    "confidence DOUBLE, rationale STRING, is_uncertain BOOLEAN, pass INT, source STRING, ok BOOLEAN, reason STRING"
)


@dataclass
class TwoPassResult:
    """Final items, both outcome tables and the failures of the first pass."""

    items: DataFrame
    pass1: DataFrame
    pass2: DataFrame | None

    def failures(self) -> DataFrame:
        return self.pass1.filter(~F.col("ok")).select("event_id", "reason", "attempts")

    def report(self, human_threshold: float = HUMAN_CONFIDENCE) -> DataFrame:
        return confidence_report(self.items, human_threshold)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes of a log, with ``ord`` in the order of their appends; no rows if there is no log yet."""
    records = scan_log_records(spark, path)
    return variant_fields(records.withColumnRenamed("record_order", "ord"), OUTCOME_SCHEMA)


def label_two_pass(
    approved: DataFrame,
    labeler: Labeler,
    model: str,
    log: DataFrame | None = None,
    refiner: Labeler | None = None,
    min_confidence: float = HUMAN_CONFIDENCE,
    refine: bool = True,
    max_retries: int = 5,
    max_parallel_calls: int | None = None,
    log_path: str | None = None,
    flush_rows: int = 1,
) -> TwoPassResult:
    """Label approved posts, then ask again about low-confidence or uncertain ones.

    Events with a success in ``log`` keep their last item and are not asked again in pass 1; they
    do take part in refinement. Each pass is written once before it is used, so no call repeats.

    With ``log_path`` every outcome is in that log as soon as it is there (every ``flush_rows`` of a task), and a later call reads
    it back: whatever breaks off, an event that was answered is not asked again. The texts to ask about are written first,
    so that a task that starts again has the same ones. Two copies of a task that run at once (speculation) would both ask.
    """
    if log_path is not None:
        stored = read_outcomes(approved.sparkSession, log_path)
        log = stored if log is None else log.unionByName(stored, allowMissingColumns=True)
    base = approved.select("event_id", "pubkey", "created_at", "content")
    todo = base if log is None else remaining_retry_failed(base, log)
    options = {"max_retries": max_retries, "max_parallel_calls": max_parallel_calls}

    def log_of() -> OutcomeLog | None:
        return None if log_path is None else OutcomeLog(log_path, flush_rows)

    if log_path is not None:
        todo = materialize(todo, "to-ask")
    pass1 = materialize(label_with(todo, labeler, model, log=log_of(), **options), "pass1")
    items = item_shape(pass1.filter("ok"))
    if log is not None:
        items = items.unionByName(last_ok(log).select(*ITEM_COLUMNS))
    if not refine:
        return TwoPassResult(items, pass1, None)
    doubtful = refine_candidates(items, min_confidence).select(
        "event_id", "pubkey", "created_at", "content", F.col("label").alias("first_label")
    )
    prompt = P.refinement_prompt(F.col("content"), F.col("first_label"))
    if log_path is not None:
        doubtful = materialize(doubtful, "to-ask-again")
    pass2 = materialize(
        label_with(doubtful, refiner or labeler, model, prompt=prompt, pass_number=2, log=log_of(), **options).drop("first_label"),
        "pass2",
    )
    return TwoPassResult(pass2_overlay(items, item_shape(pass2.filter("ok"))), pass1, pass2)
