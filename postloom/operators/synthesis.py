"""Backfill of under-filled labels: candidate filter, verification, quota fill, records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions import gates as G
from postloom.functions import text as T
from postloom.operators.export import SYNTHETIC_PREFIX, synthetic_event_id
from postloom.operators.keyed import first_per_key, side_by_side
from postloom.operators.labels import label_id_of
from postloom.session import materialize

MIN_LENGTH = 5
MAX_LENGTH = 200

# --- fixed values: defaults of generated records --------------------------------------------
DEFAULT_CONFIDENCE = 0.9
DEFAULT_RATIONALE = "逆生成（synthetic）"
SYNTHETIC_AUTHOR = "synthetic"
# -------------------------------------------------------------------------------------------


def seen_hash_anti(candidates: DataFrame, *known: DataFrame) -> DataFrame:
    """Candidates whose content hash occurs in none of the ``known`` tables (``content`` column)."""
    hashed = candidates.withColumn("content_hash", T.content_hash(F.col("content")))
    for table in known:
        seen = table.filter(F.col("content").isNotNull()).select(
            T.content_hash(F.col("content")).alias("content_hash")
        )
        hashed = hashed.join(seen.distinct(), "content_hash", "left_anti")
    return hashed


def candidate_filter(
    candidates: DataFrame,
    seen: DataFrame | None = None,
    min_length: int = MIN_LENGTH,
    max_length: int = MAX_LENGTH,
    row_id: str = "seq",
    within: Sequence[str] = (),
) -> DataFrame:
    """Add ``content_hash`` and ``reason`` (null = accepted) to every candidate.

    First failing check of too_short, too_long, the language reason, duplicate. A duplicate
    repeats an earlier passing candidate (order of the unique ``row_id``; only one with the same
    values in the columns ``within``, if given) or a hash in ``seen`` (``content_hash`` column). The first passing copy per hash is found with a per-task cut, and
    only those firsts meet the seen hashes, so a text repeated in a third of all rows never
    gathers in one task. The winners come back to the candidates by row id.
    """
    trimmed = candidates.withColumn("content", T.strip_spaces(F.coalesce("content", F.lit(""))))
    sized = trimmed.withColumn("utf16_length", T.utf16_length(F.col("content")))
    gated = G.with_language_gate(sized, min_length=min_length)
    basic = gated.withColumns(
        {
            "_basic": F.when(F.col("utf16_length") < int(min_length), F.lit("too_short"))
            .when(F.col("utf16_length") > int(max_length), F.lit("too_long"))
            .otherwise(F.col("exclude_reason")),
            "content_hash": F.sha2(T.normalize_cleaned(F.col("clean")), 256),
        }
    )
    kept = basic.select(*candidates.columns, "content_hash", "_basic")
    passing = kept.filter(F.col("_basic").isNull()).select(row_id, "content_hash", *within)
    winners = first_per_key(passing, [*within, "content_hash"], [F.col(row_id)])
    if seen is not None:
        winners = winners.join(seen.select("content_hash").distinct(), "content_hash", "left_anti")
    flagged = kept.join(winners.select(row_id, F.lit(True).alias("_won")), row_id, "left")
    return flagged.withColumn(
        "reason", F.coalesce("_basic", F.when(F.col("_won").isNull(), F.lit("duplicate")))
    ).drop("_basic", "_won")


def verify_roundtrip(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates whose verifier label equals their target label."""
    votes = verdicts.select("event_id", F.col("label").alias("_verdict"))
    return candidates.join(votes, "event_id").filter(F.col("_verdict") == F.col("label")).drop("_verdict")


def quota_fill(filtered: DataFrame, max_rounds: int) -> DataFrame:
    """Mark each candidate's ``outcome`` while filling label quotas in order.

    Input: filtered candidates with ``label, need, round, pos, reason, verified``. Rounds above
    ``max_rounds`` are not run; a round is one model response. Within a label the accepted
    candidates are examined in (round, pos) order until ``need`` verified ones are taken:
    ``taken``, ``verify_rejected`` (examined, not verified), ``filter_rejected`` (failed the
    filter in a round that was run), ``unused`` (not examined any more).

    Verified counts are summed per (label, round) first; running totals over these few sums give
    each round its start, and only single rounds are ordered, so a large label is never one group.

    Copies within a label and copies of texts that an earlier label examined must be marked in
    ``reason`` already, see :func:`fill_in_order`.
    """
    run = filtered.filter(F.col("round") <= int(max_rounds))
    passed = F.col("reason").isNull()
    verified = (passed & F.col("verified")).cast("long")
    per_round = run.groupBy("label", "round").agg(F.sum(verified).alias("_v"))
    earlier = Window.partitionBy("label").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_round.select(
        "label", "round", F.coalesce(F.sum("_v").over(earlier), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy("label", "round").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = run.join(starts, ["label", "round"]).withColumn(
        "_before", F.col("_start") + F.coalesce(F.sum(verified).over(within), F.lit(0))
    )
    outcome = (
        F.when(F.col("_start") >= F.col("need"), F.lit("unused"))
        .when(~passed, F.lit("filter_rejected"))
        .when(F.col("_before") >= F.col("need"), F.lit("unused"))
        .when(F.col("verified"), F.lit("taken"))
        .otherwise(F.lit("verify_rejected"))
    )
    return placed.withColumn("outcome", outcome).drop("_start", "_before")


def fill_in_order(filtered: DataFrame, max_rounds: int) -> DataFrame:
    """:func:`quota_fill` where a label gives up a text only if an earlier label examined it.

    ``filtered`` is deduplicated within labels (``candidate_filter(within=["label"])``) and has the
    order of labels in ``label_rank``. A text that several labels generated belongs to the first of
    them that examines it; one that was left over stays free for the next. What a label
    examines depends on earlier labels only, so marking the copies of examined texts and filling
    again settles at least one more label each time, and it ends when the marks stay the same.
    Only texts of several labels take part, as narrow rows (label, hash).
    """
    accepted = filtered.filter(F.col("reason").isNull()).select("label", "label_rank", "content_hash")
    several = accepted.groupBy("content_hash").agg(F.min("label_rank").alias("first_rank"), F.count(F.lit(1)).alias("_labels"))
    shared = accepted.join(several.filter("_labels > 1"), "content_hash").select("label", "label_rank", "content_hash", "first_rank")
    shared = materialize(shared, "shared-texts")
    blocked = shared.filter("label_rank > first_rank").select("label", "content_hash")
    before = None
    while True:
        blocked = materialize(blocked, "blocked-texts")
        now = tuple(blocked.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("label", "content_hash")), F.lit(0))).first())
        marks = blocked.withColumn("_blocked", F.lit(True))
        marked = filtered.join(marks, ["label", "content_hash"], "left").withColumn(
            "reason", F.coalesce("reason", F.when(F.col("_blocked"), F.lit("duplicate")))
        )
        done = quota_fill(marked.drop("_blocked"), max_rounds)
        if now == before or not now[0]:
            return done
        before = now
        examined = done.filter(F.col("outcome").isin("taken", "verify_rejected")).join(shared.select("content_hash").distinct(), "content_hash", "left_semi")
        owners = examined.groupBy("content_hash").agg(F.min("label_rank").alias("owner_rank"))
        blocked = shared.join(owners, "content_hash").filter("label_rank > owner_rank").select("label", "content_hash")


def synthesis_report(filled: DataFrame, deficits: DataFrame) -> DataFrame:
    """Per label in need: have_before, generated, both reject counts and have_after."""

    def hits(name: str) -> Column:
        return F.count_if(F.col("outcome") == name)

    counts = filled.groupBy("label").agg(
        hits("taken").alias("generated"),
        hits("verify_rejected").alias("verified_rejected"),
        hits("filter_rejected").alias("filter_rejected"),
    )
    joined = deficits.filter("need > 0").join(counts, "label", "left").fillna(
        0, ["generated", "verified_rejected", "filter_rejected"]
    )
    return joined.select(
        "label_id",
        "label",
        F.col("have").alias("have_before"),
        "generated",
        "verified_rejected",
        "filter_rejected",
        (F.col("have") + F.col("generated")).alias("have_after"),
    )


def synthesis_totals(filled: DataFrame, deficits: DataFrame, synthetic_before: DataFrame) -> DataFrame:
    """One row of totals over all labels in need, and the synthetic rows there are after the run."""
    sums = synthesis_report(filled, deficits).agg(
        F.count(F.lit(1)).alias("deficit_labels"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("generated", "verified_rejected", "filter_rejected")),
    )
    before = synthetic_before.agg(F.count(F.lit(1)).alias("_before"))
    return side_by_side(sums, before).select("*", (F.col("_before") + F.col("generated")).alias("synthetic_total")).drop("_before")


def synthetic_records(
    rows: DataFrame,
    model: str,
    created_at: Column | int,
    confidence: str | None = None,
    rationale: str | None = None,
    verified: Column | bool = False,
) -> DataFrame:
    """Labeled-record shape of generated posts (``content, label``) with the synthetic marks."""
    label = T.normalize_label(F.col("label"))
    conf = F.lit(None).cast("double") if confidence is None else F.col(confidence).cast("double")
    text = F.lit(None).cast("string") if rationale is None else F.col(rationale)
    stamp = F.lit(created_at) if isinstance(created_at, int) else created_at
    flag = F.lit(verified) if isinstance(verified, bool) else F.coalesce(verified, F.lit(False))
    return rows.select(
        synthetic_event_id(F.col("content")).alias("event_id"),
        F.lit(SYNTHETIC_AUTHOR).alias("pubkey"),
        stamp.cast("long").alias("created_at"),
        "content",
        label.alias("label"),
        label_id_of(label).alias("label_id"),
        F.coalesce(conf, F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
        F.coalesce(F.when(text != "", text), F.lit(DEFAULT_RATIONALE)).alias("rationale"),
        F.lit(False).alias("is_uncertain"),
        F.lit(1).alias("pass"),
        F.lit(SYNTHETIC_PREFIX + model).alias("source"),
        F.lit(True).alias("synthetic"),
        flag.alias("verified"),
    )
