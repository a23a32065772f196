"""Author activity: recent posts, active days, profiles and trailing request rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions import calendar as C
from postloom.operators.dedup import distinct_ids
from postloom.operators.keyed import last_per_key

PROFILE_SCHEMA = "name STRING, display_name STRING"


def recent_posts(posts: DataFrame, now_sec: int, days: int) -> DataFrame:
    """Posts of the recent-day window, one copy per id, newest first."""
    return distinct_ids(posts.filter(C.in_recent_days(F.col("created_at"), now_sec, days))).orderBy(
        F.col("created_at").desc(), "seq"
    )


def active_day_stats(posts: DataFrame, by: str | None = None) -> DataFrame:
    """Distinct local days and first and last second, per author or overall (no row when empty)."""
    days = posts.filter(F.col("created_at").isNotNull())
    grouped = days.groupBy(by) if by else days.groupBy()
    stats = grouped.agg(
        F.count_distinct(C.local_day(F.col("created_at"))).alias("active_days"),
        F.min("created_at").alias("first_sec"),
        F.max("created_at").alias("last_sec"),
    )
    return stats.filter(F.col("active_days") > 0)


def latest_profiles(profile_events: DataFrame) -> DataFrame:
    """Latest profile event per author with its parsed ``profile`` (null when it is no JSON)."""
    latest = last_per_key(
        profile_events.select("pubkey", "created_at", "seq", "content"), ["pubkey"], ["created_at", "seq"]
    )
    return latest.select("pubkey", F.from_json("content", PROFILE_SCHEMA).alias("profile"))


def display_name(pubkey: Column, profile: Column) -> Column:
    """display_name, else name, else the first twelve characters of the key with an ellipsis."""
    return F.coalesce(
        F.nullif(profile["display_name"], F.lit("")),
        F.nullif(profile["name"], F.lit("")),
        F.concat(F.substring(pubkey, 1, 12), F.lit("…")),
    )


def profile_join(posts: DataFrame, profile_events: DataFrame) -> DataFrame:
    """Posts with their author's profile and ``display_name``.

    The profile side has one row per author; a prolific author's posts are split by AQE's skew
    join when the profile table is too large to broadcast.
    """
    return (
        posts.join(latest_profiles(profile_events), "pubkey", "left")
        .withColumn("display_name", display_name(F.col("pubkey"), F.col("profile")))
    )


def author_stats(samples: DataFrame) -> DataFrame:
    """Approved rows per author with ``first_seq``, the input of the two reports below."""
    return (
        samples.filter(F.col("review_status") == "approved")
        .groupBy("pubkey")
        .agg(F.count(F.lit(1)).alias("count"), F.min("first_seq").alias("first_seq"))
    )


def top_authors(stats: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent authors, first seen on ties."""
    return stats.orderBy(F.col("count").desc(), "first_seq").limit(int(n)).select("pubkey", "count")


def author_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count(F.lit(1)).alias("unique_authors"),
        F.coalesce(F.max("count"), F.lit(0)).alias("max_per_author"),
    )


def rate_window_audit(
    requests: DataFrame, limit_per_window: int = 60, window_seconds: int = 60, key: str | None = None
) -> DataFrame:
    """Requests in the trailing window ending at each request time, and whether it is over the limit.

    A request leaves the window exactly ``window_seconds`` after it was made. Equal times are
    counted first; the counts are then tiled by window length, each tile also receiving the
    counts of the tile before it, so a busy key is cut along time and no task sees more than two
    windows of it.
    """
    micros = window_seconds * 1_000_000
    keyed = requests.withColumn("_key", F.col(key) if key else F.lit(""))
    counts = keyed.groupBy("_key", F.unix_micros("ts").alias("ts_micros")).agg(
        F.count(F.lit(1)).alias("requests")
    )
    own = F.floor(F.col("ts_micros") / micros)
    tiled = counts.withColumn("_own", own).withColumn("_tile", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    frame = (
        Window.partitionBy("_key", "_tile").orderBy("ts_micros").rangeBetween(-(micros - 1), Window.currentRow)
    )
    audited = tiled.withColumn("in_window", F.sum("requests").over(frame)).filter(F.col("_tile") == F.col("_own"))
    return audited.select(
        F.col("_key").alias("key"),
        "ts_micros",
        "requests",
        "in_window",
        (F.col("in_window") > int(limit_per_window)).alias("over_limit"),
    )
