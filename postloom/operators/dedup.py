"""Near-duplicate clusters by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions import text as T
from postloom.operators.keyed import first_per_key
from postloom.session import materialize


def near_dup_clusters(posts: DataFrame, keep_empty_forms_apart: bool = False) -> DataFrame:
    """One row per content hash.

    The strictly oldest copy (first seen on ties) supplies ``event_id, pubkey, created_at,
    content``; ``dup_count``, ``author_count``, ``first_seq`` (position of the first copy) and
    the relays in encounter order describe the cluster.

    Posts without any kept character share one empty normal form and hence one cluster;
    ``keep_empty_forms_apart`` leaves each of them alone instead.

    Hashes are computed once and written with the few narrow columns that the counts need. A hash that
    holds a third of all posts is counted per task before any shuffle, authors are counted without
    building a set, and the oldest copy is cut per task. Its text comes back by ``seq`` and id, which name
    a post, so no text is ever sorted or grouped.
    """
    form = T.normalize_content(F.col("content"))
    digest = F.sha2("_form", 256)
    if keep_empty_forms_apart:
        digest = F.when(F.col("_form") == "", F.concat(F.lit("empty-"), "event_id")).otherwise(digest)
    keyed = posts.withColumn("_form", form).select(
        digest.alias("content_hash"), "event_id", "pubkey", "created_at", "seq", F.coalesce("relay", F.array().cast("array<string>")).alias("relay")
    )
    keyed = materialize(keyed, "cluster-keys")
    oldest = first_per_key(keyed.select("content_hash", "created_at", "seq", "event_id"), ["content_hash"], [F.col("created_at"), F.col("seq")])
    totals = keyed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("dup_count"), F.min("seq").alias("first_seq"))
    authors = keyed.select("content_hash", "pubkey").distinct().groupBy("content_hash").agg(F.count(F.lit(1)).alias("author_count"))
    met = keyed.select("content_hash", "seq", F.posexplode("relay").alias("pos", "relay")).filter(F.col("relay").isNotNull())
    relays = (
        first_per_key(met, ["content_hash", "relay"], [F.col("seq"), F.col("pos")])
        .groupBy("content_hash")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "pos", "relay"))).alias("seen_on"))
        .select("content_hash", F.col("seen_on.relay").alias("relay"))
    )
    narrow = (
        oldest.join(totals, "content_hash")
        .join(authors, "content_hash")
        .join(relays, "content_hash", "left")
        .withColumn("relay", F.coalesce("relay", F.array().cast("array<string>")))
    )
    texts = posts.select("event_id", "seq", "pubkey", "content")
    return texts.join(narrow, ["event_id", "seq"]).select(
        "content_hash", "event_id", "pubkey", "created_at", "content", "dup_count", "author_count", "first_seq", "relay"
    )


def distinct_ids(posts: DataFrame, key: str = "event_id", order: str = "seq") -> DataFrame:
    """First copy per id in arrival order."""
    return first_per_key(posts, [key], [F.col(order)])
