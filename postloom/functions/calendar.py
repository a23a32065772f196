"""Time slices, recent-day windows and local-day keys over unix seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86400


def slice_count(window_days: int, slice_days: int) -> int:
    window, step = max(1, int(window_days)), max(1, int(slice_days))
    return -(-window // step)


def slice_bounds(now_sec: int, window_days: int, slice_days: int) -> Column:
    """Array of ``(slice, since_sec, until_sec)``, newest first, the last one clipped."""
    window, step = max(1, int(window_days)), max(1, int(slice_days))
    start = int(now_sec) - window * DAY_SECONDS
    span = step * DAY_SECONDS

    def bounds(i: Column) -> Column:
        until = F.lit(int(now_sec)) - i * span
        return F.struct(
            i.cast("int").alias("slice"),
            F.greatest(F.lit(start), until - span).cast("long").alias("since_sec"),
            until.cast("long").alias("until_sec"),
        )

    last = slice_count(window_days, slice_days) - 1
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")), bounds)


def slices_of(ts: Column, now_sec: int, window_days: int, slice_days: int) -> Column:
    """Indexes of the slices that contain ``ts``; a shared boundary second belongs to two.

    Pure arithmetic, so tagging posts with their slices needs no range join.
    """
    window, step = max(1, int(window_days)), max(1, int(slice_days))
    span = step * DAY_SECONDS
    age = F.lit(int(now_sec)).cast("long") - ts
    newest = F.floor(age / span).cast("int")
    last = slice_count(window_days, slice_days) - 1
    hits = F.array(newest - F.when(age % span == 0, 1), newest)
    inside = (age >= 0) & (age <= window * DAY_SECONDS)
    return F.when(
        inside, F.filter(hits, lambda i: i.isNotNull() & (i >= 0) & (i <= last))
    ).otherwise(F.array().cast("array<int>"))


def local_day(ts: Column) -> Column:
    """Calendar day of a unix second in the session time zone."""
    return F.to_date(F.timestamp_seconds(ts))


def local_day_key(ts: Column) -> Column:
    """Day key without zero padding, such as ``2026-6-12``."""
    return F.date_format(F.timestamp_seconds(ts), "y-M-d")


def recent_days_start(now_sec: Column | int, days: int | float | None) -> Column:
    """Unix second of local midnight ``days - 1`` days before ``now_sec`` (at least one day)."""
    try:
        n = max(1, int(float(days or 1)))
    except (TypeError, ValueError, OverflowError):
        n = 1
    now = F.lit(now_sec) if isinstance(now_sec, int) else now_sec
    return F.unix_timestamp(F.date_sub(local_day(now), n - 1).cast("timestamp"))


def in_recent_days(ts: Column, now_sec: int, days: int) -> Column:
    """``ts`` lies in the window that ends at ``now_sec``, both ends included."""
    return (ts >= recent_days_start(now_sec, days)) & (ts <= F.lit(now_sec))


def day_range_label(now_sec: Column | int, days: int) -> Column:
    """Label of the requested window, ``first 〜 last``."""
    now = F.lit(now_sec) if isinstance(now_sec, int) else now_sec
    first = recent_days_start(now, days)
    return F.concat(
        F.date_format(F.timestamp_seconds(first), "y/M/d"),
        F.lit(" 〜 "),
        F.date_format(F.timestamp_seconds(now), "y/M/d"),
    )
