"""Keyed tables: first or last row per key, caps and exact distributed ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.session import materialize

GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in ``order``.

    ``row_number() = 1`` lets Spark keep one row per key in every task before the shuffle, so a
    key with many copies never meets in one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def last_per_key(df: DataFrame, keys: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """The last row per key (later rows overwrite earlier ones)."""
    names = [order] if isinstance(order, str) else list(order)
    return first_per_key(df, keys, [F.col(n).desc() for n in names])


def cap_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int, rank: str = "rn"
) -> DataFrame:
    """The first ``cap`` rows per key with their rank; cut per task before the shuffle.

    Spark makes that cut for ranks up to a threshold of its settings only, which is raised here to
    ``cap`` where it is lower.
    """
    conf = df.sparkSession.conf
    if int(conf.get(GROUP_LIMIT, "1000")) < int(cap):
        conf.set(GROUP_LIMIT, str(int(cap)))
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= int(cap))


def flag_first_copies(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], row_id: str, flag: str = "is_first"
) -> DataFrame:
    """Keep every row and flag the first one per key in ascending ``order``.

    The firsts are found with the per-task cut of :func:`first_per_key` and joined back on the
    unique ``row_id``. Neither side of that join is skewed by a key with many copies.
    """
    narrow = df.select(*dict.fromkeys([row_id, *keys, *order]))
    firsts = first_per_key(narrow, keys, [F.col(name) for name in order]).select(
        row_id, F.lit(True).alias(flag)
    )
    return df.join(firsts, row_id, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def exclude_keys(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` does not occur in ``seen``; Spark picks broadcast or sort-merge by size."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def side_by_side(rows: DataFrame, *single: DataFrame) -> DataFrame:
    """``rows`` widened by the columns of one-row tables, read as scalar subqueries."""
    out, added = rows, []
    for i, one in enumerate(single):
        out = out.withColumn(f"_s{i}", one.select(F.struct(*one.columns)).scalar())
        added += [F.col(f"_s{i}.{c}").alias(c) for c in one.columns]
    return out.select(*rows.columns, *added)


def hash_order_cut(
    df: DataFrame, group: str, key: str, take: Column, digits: int = 3
) -> DataFrame:
    """Per ``group``, the value of ``key`` at position ``take`` in ascending key order.

    ``key`` is a hex digest, unique per row. ``take`` is an expression over ``n``, the group's
    row count. Rows are counted per digest prefix (at most ``16 ** digits`` buckets per group,
    summed map-side); a running sum over these counts names the one bucket that holds the cut,
    and only that bucket's rows are ranked. No group is ever sorted as a whole, and the caller
    can split with a plain comparison instead of shuffling its rows.

    Both small results (one row per group) are written, so their joins with the large input are
    broadcast by measured size, or sorted and merged if there are too many groups for that.
    """
    keyed = df.select(group, key).withColumn("_bucket", F.substring(key, 1, digits))
    counts = keyed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    up_to = Window.partitionBy(group).orderBy("_bucket")
    whole = Window.partitionBy(group)
    located = (
        counts.withColumns(
            {"_end": F.sum("_n").over(up_to), "n": F.sum("_n").over(whole)}
        )
        .withColumn("take", take.cast("long"))
        .filter((F.col("take") > F.col("_end") - F.col("_n")) & (F.col("take") <= F.col("_end")))
        .select(
            group, "_bucket", "n", "take", (F.col("take") - F.col("_end") + F.col("_n")).alias("_k")
        )
    )
    located = materialize(located, "cut-buckets")
    ranked = keyed.join(located, [group, "_bucket"]).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(key))
    )
    cuts = ranked.filter("_rn = _k").select(group, "n", "take", F.col(key).alias("cut_key"))
    return materialize(cuts, "cuts")


def kth_value(df: DataFrame, column: str, k: int, buckets: int = 1024) -> int | None:
    """The ``k``-th smallest value of an integer column (from 1), null if there are fewer rows.

    Rows are counted per bucket of values, and the bucket that holds the k-th is cut again until it is one
    value: a few passes that group to ``buckets`` rows each, and no sort.
    """
    low, high, rows = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if rows < k:
        return None
    while low < high:
        width = (high - low) // buckets + 1
        inside = df.filter(F.col(column).between(low, high))
        counts = inside.groupBy(F.floor((F.col(column) - F.lit(low)) / F.lit(width)).alias("b")).count().collect()
        for bucket, count in sorted((r[0], r[1]) for r in counts):
            if count >= k:
                low = low + bucket * width
                high = min(high, low + width - 1)
                break
            k -= count
    return low
