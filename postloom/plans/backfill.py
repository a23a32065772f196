"""Backfill planning and execution for labels short of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import prompts as P
from postloom.functions import text as T
from postloom.functions.answers import with_generated_posts
from postloom.operators.sampling import shortest_examples
from postloom.operators.synthesis import candidate_filter, fill_in_order, synthetic_records
from postloom.session import materialize


def synthesis_prompts(deficits: DataFrame, labeled: DataFrame, dim: DataFrame, batch: int = 10) -> DataFrame:
    """One prompt per label in need, with up to three short real posts as style examples."""
    examples = (
        shortest_examples(labeled)
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("example_rank", "content"))).alias("ranked"))
        .select("label", F.col("ranked.content").alias("examples"))
    )
    known = dim.select("label", "definition")
    return (
        deficits.filter("need > 0")
        .join(known, "label")
        .join(examples, "label", "left")
        .withColumn(
            "prompt",
            P.synthesis_prompt(F.col("label"), F.col("definition"), int(batch), F.col("examples")),
        )
        .select("label_id", "label", "need", "prompt")
    )


def candidates_from_answers(answers: DataFrame) -> DataFrame:
    """One row per generated post from parsed answers (``label, label_id, need, round, answer``)."""
    parsed = with_generated_posts(answers).filter(F.col("error").isNull())
    return parsed.select(
        "label", "label_id", "need", "round", F.posexplode("posts").alias("pos", "content")
    )


def with_processing_order(candidates: DataFrame) -> DataFrame:
    """Add ``seq``, the order in which a run meets candidates: need desc, label id, round, position."""
    return candidates.withColumn("seq", F.struct(-F.col("need"), "label_id", "round", "pos"))


def fill_quotas(
    candidates: DataFrame,
    known: DataFrame,
    verify: Column,
    max_rounds: int = 12,
) -> DataFrame:
    """Filter candidates, verify the accepted ones and fill each label's quota in order.

    ``known`` holds the contents already in the corpus; ``verify`` is a boolean column (a
    verifier's label equal to the target). The filtered candidates are written once. A text counts
    as a duplicate only of contents in ``known``, of texts that an earlier label examined, and of copies in
    its own label.
    """
    seen = known.select(T.content_hash(F.col("content")).alias("content_hash"))
    ordered = with_processing_order(candidates.filter(F.col("round") <= int(max_rounds)))
    filtered = candidate_filter(ordered, seen, within=["label"]).withColumns(
        {"verified": F.coalesce(verify, F.lit(False)), "label_rank": F.struct(-F.col("need"), "label_id")}
    )
    return fill_in_order(materialize(filtered, "candidates"), max_rounds).drop("label_rank")


def generated_records(filled: DataFrame, model: str, created_at: int) -> DataFrame:
    """Synthetic records of the taken candidates."""
    return synthetic_records(
        filled.filter(F.col("outcome") == "taken"), model, created_at, verified=F.col("verified")
    )
