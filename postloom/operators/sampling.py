"""Author-balanced sampling, coverage-first subsets, stratified split and style examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions import text as T
from postloom.operators.keyed import cap_per_key, hash_order_cut, kth_value
from postloom.session import materialize

TARGET = 2000
AUTHOR_CAP = 10


def _picks(posts: DataFrame, target: int, author_cap: int) -> DataFrame:
    """Narrow pick list ``event_id, tier, rn, author_ord`` for tiers 0 and 1.

    Round ``rn`` takes each author's ``rn``-th newest post, authors in order of first appearance
    within the tier. Tier 1 starts only once tier 0 is exhausted, at which point each author has
    used ``least(cap, n0)`` slots; so the first ``target`` rows by (tier, round, author) are exact. Rows
    are counted per (tier, round), at most two times the cap, which names the round that holds the last
    pick; earlier rounds are taken whole and only that one is cut, at a value of the author order.

    The list is written, so joining it back to the full posts is a broadcast by measured size
    (no shuffle of the texts), or a sort-merge join when the target is large.
    """
    narrow = posts.select("event_id", "pubkey", "created_at", "seq", "tier")
    ranked = cap_per_key(
        narrow, ["tier", "pubkey"], [F.col("created_at").desc(), F.col("seq")], author_cap
    )
    authors = narrow.groupBy("pubkey").agg(
        F.min(F.when(F.col("tier") == 0, F.col("seq"))).alias("_ord0"),
        F.min(F.when(F.col("tier") == 1, F.col("seq"))).alias("_ord1"),
        F.count_if(F.col("tier") == 0).alias("_n0"),
    )
    room = F.when(F.col("tier") == 0, F.lit(int(author_cap))).otherwise(
        F.lit(int(author_cap)) - F.least(F.lit(int(author_cap)), F.col("_n0"))
    )
    ordered = (
        ranked.join(authors, "pubkey")
        .filter(F.col("rn") <= room)
        .select(
            "event_id",
            "tier",
            "rn",
            F.when(F.col("tier") == 0, F.col("_ord0")).otherwise(F.col("_ord1")).alias("author_ord"),
        )
    )
    ordered = materialize(ordered, "ranked-picks")
    left, last = int(target), None
    for tier, rn, count in sorted(tuple(r) for r in ordered.groupBy("tier", "rn").count().collect()):
        if count >= left:
            last = (tier, rn)
            break
        left -= count
    if last is None:
        return ordered
    tier, rn = F.col("tier"), F.col("rn")
    at = (tier == last[0]) & (rn == last[1])
    cut = kth_value(ordered.filter(at), "author_ord", left) if left > 0 else None
    earlier = (tier < last[0]) | ((tier == last[0]) & (rn < last[1]))
    kept = earlier if cut is None else earlier | (at & (F.col("author_ord") <= F.lit(cut)))
    return materialize(ordered.filter(kept), "picks")


def round_robin_sample(posts: DataFrame, target: int = TARGET, author_cap: int = AUTHOR_CAP) -> DataFrame:
    """Author-balanced sample with ``rn`` (round) and ``author_ord`` as pick order."""
    picks = _picks(posts.withColumn("tier", F.lit(0)), target, author_cap)
    return posts.join(picks.drop("tier"), "event_id")


def sample_with_backfill(
    classified: DataFrame, target: int = TARGET, author_cap: int = AUTHOR_CAP
) -> DataFrame:
    """Final review status of every non-excluded cluster.

    Approved posts are sampled first; review posts fill what is missing under the same author
    caps. Picked posts become ``approved``, all others ``review``; ``backfilled`` marks picks
    taken from the review tier. ``classified`` feeds several branches, so pass a materialized
    table when it is costly.
    """
    pool = (
        classified.filter(F.col("status") != "excluded")
        .withColumn("tier", F.when(F.col("status") == "approved", F.lit(0)).otherwise(F.lit(1)))
    )
    picks = _picks(pool.withColumnRenamed("first_seq", "seq"), target, author_cap)
    return (
        pool.join(picks.select("event_id", F.lit(True).alias("_picked")), "event_id", "left")
        .withColumns(
            {
                "review_status": F.when(F.col("_picked"), F.lit("approved")).otherwise(F.lit("review")),
                "backfilled": F.coalesce(F.col("_picked"), F.lit(False)) & (F.col("tier") == 1),
            }
        )
        .drop("_picked", "tier")
    )


def first_n_posts(posts: DataFrame, n: int = 200, author: str = "pubkey") -> DataFrame:
    """The newest ``n`` posts of each author with their zero-based ``source_index``."""
    ranked = cap_per_key(posts, [author], [F.col("created_at").desc(), F.col("seq")], n)
    return ranked.withColumn("source_index", F.col("rn") - 1).drop("rn")


def coverage_subset(
    rows: DataFrame, num_labels: int, per_label: int = 2, max_total: int = 64, max_chars: int = 512
) -> DataFrame:
    """Coverage-first subset of ``content, label_id`` rows (``seq`` is file order).

    The first ``per_label`` rows of each label, emitted rank by rank in label order and stopped
    at ``max_total``; text stripped and cut to ``max_chars`` code points.
    """
    ranked = cap_per_key(
        rows.filter(F.col("label_id").between(0, int(num_labels) - 1)),
        ["label_id"],
        [F.col("seq")],
        per_label,
    )
    return (
        ranked.orderBy("rn", "label_id")
        .limit(int(max_total))
        .select(
            F.substring(T.strip_spaces(F.col("content")), 1, int(max_chars)).alias("content"),
            "label_id",
            F.col("rn").alias("rank"),
            "seq",
        )
    )


def stratified_split(
    rows: DataFrame, val_ratio: float = 0.1, seed: int = 42, label: str = "label_id", row_id: str = "seq"
) -> DataFrame:
    """Add ``split`` (train or val), stratified by label and fixed by ``seed``.

    Labels with fewer than two rows stay in train; otherwise ``round-half-even(n * ratio)`` rows,
    at least one and at most ``n - 1``, go to val. Membership follows the md5 of seed and row id.
    Per label only the digest at the cut is needed, one small row, so the rows themselves are
    split by comparison without a shuffle.
    """
    keyed = rows.withColumn(
        "_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))
    )
    n = F.col("n")
    take = F.when(
        n >= 2,
        F.least(F.greatest(F.bround(n * F.lit(float(val_ratio))).cast("long"), F.lit(1)), n - 1),
    )
    cuts = hash_order_cut(keyed, label, "_key", take)
    return (
        keyed.join(cuts.select(label, "cut_key"), label, "left")
        .withColumn(
            "split",
            F.when(F.col("_key") <= F.col("cut_key"), F.lit("val")).otherwise(F.lit("train")),
        )
        .drop("_key", "cut_key")
    )


def shortest_examples(labeled: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` shortest non-blank posts per label, first seen on ties."""
    usable = labeled.filter(~T.is_blank(F.col("content")))
    return cap_per_key(
        usable.withColumn("utf16_length", T.utf16_length(F.col("content"))),
        ["label"],
        [F.col("utf16_length"), F.col("seq")],
        n,
        rank="example_rank",
    )
