"""Checkpoint semantics: outcomes, last-ok-wins, resume policies, overlays and seeding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.keyed import exclude_keys, last_per_key

ITEM_COLUMNS = (
    "event_id", "pubkey", "created_at", "content", "label", "label_id",
    "confidence", "rationale", "is_uncertain", "pass", "source",
)

# Rows of a log that one task sorts; files and shuffles are split by compressed bytes, which say little about them.
ROWS_A_TASK = 250_000


def dealt_tasks(rows: DataFrame) -> int:
    """How many tasks ``rows`` are dealt to."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))


def ok_rows(log: DataFrame) -> DataFrame:
    """Successful outcomes without the ``ok`` column."""
    return log.filter("ok").drop("ok")


def item_shape(rows: DataFrame) -> DataFrame:
    """The eleven canonical item columns."""
    return rows.select(*ITEM_COLUMNS)


def last_ok(log: DataFrame, order: str = "ord") -> DataFrame:
    """Latest successful row per event."""
    return last_per_key(ok_rows(log), ["event_id"], order)


def remaining_retry_failed(todo: DataFrame, log: DataFrame) -> DataFrame:
    """Resume policy A: skip events with a success; failed ones are tried again."""
    return exclude_keys(todo, ok_rows(log), "event_id")


def remaining_unseen(todo: DataFrame, log: DataFrame) -> DataFrame:
    """Resume policy B: skip every event that was attempted, successful or not."""
    return exclude_keys(todo, log, "event_id")


def merge_existing(current: DataFrame, snapshot: DataFrame, order: str | None = None) -> DataFrame:
    """Current rows plus snapshot rows of events not present yet (the current side wins).

    A snapshot that repeats an event keeps its last row when ``order`` names a position column.
    """
    extra = snapshot if order is None else last_per_key(snapshot, ["event_id"], order)
    return current.unionByName(exclude_keys(extra, current, "event_id"), allowMissingColumns=True)


def pass2_overlay(pass1: DataFrame, pass2: DataFrame) -> DataFrame:
    """Pass-2 rows replace their pass-1 rows; events without one keep pass 1.

    ``pass2`` holds at most one successful row per event. All columns but ``event_id`` are
    switched together.
    """
    columns = [c for c in pass1.columns if c != "event_id"]
    second = pass2.select("event_id", F.struct(*columns).alias("_second"))
    joined = pass1.select("event_id", F.struct(*columns).alias("_first")).join(second, "event_id", "left")
    return joined.select("event_id", F.coalesce("_second", "_first").alias("_row")).select(
        "event_id", *[F.col(f"_row.{c}").alias(c) for c in columns]
    )


def seed_state(log: DataFrame, snapshot: DataFrame | None, count_existing: bool, order: str = "ord") -> DataFrame:
    """Seed rows ``event_id, label, counted`` from a checkpoint log and an optional snapshot.

    Every attempted event is listed once, so it is never labeled again. Successful ones carry
    their last label; ``counted`` tells whether they count toward completion, which is only so
    in the seeding mode (``count_existing``). Rows are counted and dealt by event, so that what a task sorts
    and holds stays the same however many there are.
    """
    tasks = dealt_tasks(log)
    ordering = F.struct(F.col("ok").cast("int"), F.col(order)).alias("_ord")
    dealt = log.select("event_id", "ok", "label", ordering).repartition(tasks, "event_id")
    latest = last_per_key(dealt, ["event_id"], "_ord").select(
        "event_id", F.when(F.col("ok"), F.col("label")).alias("label")
    )
    if snapshot is not None:
        labeled = latest.filter(F.col("label").isNotNull())
        extra = exclude_keys(snapshot.select("event_id", "label").repartition(tasks, "event_id"), labeled, "event_id")
        failed = exclude_keys(latest.filter(F.col("label").isNull()), extra, "event_id")
        latest = labeled.unionByName(extra).unionByName(failed)
    return latest.withColumn("counted", F.col("label").isNotNull() & F.lit(bool(count_existing)))
