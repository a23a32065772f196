"""Author digest: recent posts, predicted label tally, active days and display name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions import calendar as C
from postloom.operators.activity import active_day_stats, display_name, latest_profiles
from postloom.operators.dedup import distinct_ids
from postloom.operators.labeling import classify_posts
from postloom.session import materialize


def author_digest(
    posts: DataFrame,
    profile_events: DataFrame,
    dim: DataFrame,
    backend_factory: Callable[[], Callable[[list[str]], list[list[float]]]],
    now_sec: int,
    days: int = 7,
    max_posts: int = 200,
) -> DataFrame:
    """One row per author and predicted label over the recent-day window.

    ``count`` and ``share`` tally the author's classified posts; active days and the first and
    last second come from all posts of the window. The tally is written once, a row per author and label, so
    every post is classified once; the totals are a window over it. Day statistics deduplicate ids without texts.
    """
    recent = distinct_ids(posts.filter(C.in_recent_days(F.col("created_at"), now_sec, days)))
    predicted = classify_posts(recent, dim, backend_factory, max_posts)
    tally = materialize(predicted.groupBy("pubkey", "id", "char").agg(F.count(F.lit(1)).alias("count")), "tally")
    tally = tally.withColumn("posts", F.sum("count").over(Window.partitionBy("pubkey")))
    narrow = posts.filter(C.in_recent_days(F.col("created_at"), now_sec, days)).select("event_id", "seq", "pubkey", "created_at")
    stats = active_day_stats(distinct_ids(narrow), by="pubkey")
    named = (
        stats.join(tally.select("pubkey").distinct(), "pubkey", "left_semi")
        .join(latest_profiles(profile_events), "pubkey", "left")
        .withColumn("display_name", display_name(F.col("pubkey"), F.col("profile")))
        .drop("profile")
    )
    return tally.join(named, "pubkey").withColumn("share", F.col("count") / F.col("posts"))
