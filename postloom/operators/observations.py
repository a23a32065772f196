"""Fold event-by-relay observations into one row per event, with author caps and resume."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions import text as T
from postloom.operators.keyed import cap_per_key, exclude_keys, side_by_side

RAW_AUTHOR_CAP = 25


def in_time_range(df: DataFrame, since: int | None, until: int | None, ts: str = "created_at") -> DataFrame:
    """Rows with a numeric time inside ``[since, until]``; a time written as text is no number and drops its row."""
    value = F.col(ts)
    if dict(df.dtypes)[ts] == "string":
        return df.filter(F.lit(False))
    kept = df.filter(value.isNotNull())
    if since is not None:
        kept = kept.filter(value >= F.lit(int(since)))
    if until is not None:
        kept = kept.filter(value <= F.lit(int(until)))
    return kept


def drop_blank(df: DataFrame, content: str = "content") -> DataFrame:
    return df.filter(~T.is_blank(F.col(content)))


def drop_mention_only(df: DataFrame, content: str = "content") -> DataFrame:
    return df.filter(~T.is_mention_only(F.col(content)))


def admissible(observations: DataFrame, since: int | None, until: int | None) -> DataFrame:
    """Rows inside the time range with a text of their own. A blank text is mention-only as well, so one predicate covers both."""
    return drop_mention_only(in_time_range(observations, since, until))


def _fold(observations: DataFrame) -> DataFrame:
    """One row per event: fields of its first observation, relays in first-seen order.

    Only ids, relays and positions are aggregated, first per (event, relay), so an event seen a billion
    times shrinks in every task before the shuffle. Author, time and text come back from the first
    observation by event and position, so no text is ever sorted. ``seq`` is unique within an event.
    """
    per_relay = observations.groupBy("event_id", "relay").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n_obs"))
    folded = per_relay.groupBy("event_id").agg(
        F.min("seq").alias("seq"),
        F.sum("n_obs").alias("n_obs"),
        F.array_sort(F.collect_list(F.struct("seq", "relay"))).alias("seen_on"),
    )
    first = observations.select("event_id", "seq", "pubkey", "created_at", "content")
    return first.join(folded, ["event_id", "seq"]).select(
        "event_id", "pubkey", "created_at", "content", F.array_compact(F.col("seen_on.relay")).alias("relay"), "seq", "n_obs"
    )


def fold_observations(
    observations: DataFrame,
    since: int | None = None,
    until: int | None = None,
    author_cap: int | None = RAW_AUTHOR_CAP,
) -> DataFrame:
    """Raw posts from observations (``event_id, pubkey, created_at, content, relay, seq``).

    Keeps admissible observations, folds them per event and admits the first ``author_cap``
    events of each author in arrival order.
    """
    folded = _fold(admissible(observations, since, until))
    if author_cap is None:
        return folded
    return cap_per_key(folded, ["pubkey"], [F.col("seq")], author_cap).drop("rn")


def ingest_skips(
    observations: DataFrame,
    since: int | None = None,
    until: int | None = None,
    author_cap: int = RAW_AUTHOR_CAP,
) -> DataFrame:
    """One row of skip counters: empty, mention-only and over the author cap.

    The over-cap count is all admissible observations minus those of admitted events, so only
    the capped prefix of an author is ever ranked.
    """
    timed = in_time_range(observations, since, until)
    content = F.col("content")
    blank, mention = T.is_blank(content), T.is_mention_only(content)
    totals = timed.agg(
        F.count_if(blank).alias("skipped_empty"),
        F.count_if(mention & ~blank).alias("skipped_mention_only"),
        F.count_if(~mention).alias("_usable"),
    )
    admitted = fold_observations(timed, None, None, author_cap).agg(
        F.coalesce(F.sum("n_obs"), F.lit(0)).alias("_admitted")
    )
    return side_by_side(totals, admitted).select(
        "skipped_empty",
        "skipped_mention_only",
        (F.col("_usable") - F.col("_admitted")).alias("skipped_author_cap"),
    )


def resume_append(
    existing: DataFrame,
    observations: DataFrame,
    since: int | None = None,
    until: int | None = None,
    author_cap: int = RAW_AUTHOR_CAP,
) -> DataFrame:
    """New raw posts to append when some are already stored.

    Stored events count toward their author's cap and are never appended again.
    """
    fresh = exclude_keys(admissible(observations, since, until), existing, "event_id")
    ranked = cap_per_key(_fold(fresh), ["pubkey"], [F.col("seq")], author_cap)
    stored = existing.groupBy("pubkey").agg(F.count(F.lit(1)).alias("_stored"))
    return (
        ranked.join(stored, "pubkey", "left")
        .filter(F.col("rn") + F.coalesce("_stored", F.lit(0)) <= int(author_cap))
        .select("event_id", "pubkey", "created_at", "content", "relay", "seq", "n_obs")
    )


def resume_merge(
    existing: DataFrame,
    observations: DataFrame,
    appended: DataFrame,
    since: int | None = None,
    until: int | None = None,
) -> DataFrame:
    """Stored posts, their relays widened by later admissible observations, together with the new posts.

    Stored relays keep their order; relays that are new follow in the order in which they were first seen.
    """
    stored = existing.select("event_id", F.posexplode("relay").alias("pos", "relay")).select(
        "event_id", "relay", F.lit(0).alias("later"), F.col("pos").cast("long").alias("met")
    )
    again = admissible(observations, since, until).select("event_id", "relay", F.lit(1).alias("later"), F.col("seq").cast("long").alias("met"))
    again = again.join(existing.select("event_id").distinct(), "event_id", "left_semi")
    # One row per relay and side, then its stored place if it has one.
    sides = stored.unionByName(again).filter(F.col("relay").isNotNull()).groupBy("event_id", "relay", "later").agg(F.min("met").alias("met"))
    places = sides.groupBy("event_id", "relay").agg(
        F.min("later").alias("later"), F.min(F.when(F.col("later") == 0, F.col("met"))).alias("kept"), F.min("met").alias("seen")
    )
    order = F.struct("later", F.coalesce("kept", "seen").alias("met"), "relay")
    known = places.groupBy("event_id").agg(F.array_sort(F.collect_list(order)).alias("listed"))
    widened = existing.drop("relay").join(known, "event_id", "left")
    widened = widened.withColumn("relay", F.coalesce(F.col("listed.relay"), F.array().cast("array<string>")))
    shape = ["event_id", "pubkey", "created_at", "content", "relay"]
    return widened.select(*shape).unionByName(appended.select(*shape))


def concat_sources(*sources: DataFrame | None) -> DataFrame:
    """Ordered union; ``source_rank`` keeps the order of the inputs, missing ones are skipped."""
    ranked = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(sources) if df is not None]
    if not ranked:
        raise ValueError("concat_sources needs at least one source")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
