"""Text rules, gates, posts, curation and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sql as Q
from checks import views as V
from checks.registry import query
from postloom.functions import calendar as C
from postloom.functions import gates as G
from postloom.functions import text as T
from postloom.operators import activity, dedup, keyed, observations, progress, sampling
from postloom.plans import curate as curation

W = V.with_views


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


@query("clean_text", W("jposts") + f"SELECT event_id, {Q.clean('content')} AS clean FROM jposts")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.jposts(spark, sf_dir).select("event_id", T.clean_text(F.col("content")).alias("clean"))


@query("normalize_content", W("jposts") + f"SELECT event_id, {Q.norm('content')} AS form FROM jposts")
def normalize_content(spark, sf_dir):
    return V.jposts(spark, sf_dir).select("event_id", T.normalize_content(F.col("content")).alias("form"))


@query("content_hash", W("posts") + f"SELECT event_id, {Q.chash('content')} AS content_hash FROM posts")
def content_hash(spark, sf_dir):
    return V.posts(spark, sf_dir).select("event_id", T.content_hash(F.col("content")).alias("content_hash"))


@query(
    "normalize_for_classifier",
    W("jposts") + f"SELECT event_id, {Q.collapse(Q.clean('content'))} AS norm FROM jposts",
)
def normalize_for_classifier(spark, sf_dir):
    return V.jposts(spark, sf_dir).select("event_id", T.normalize_for_classifier(F.col("content")).alias("norm"))


@query(
    "url_hashtag_counts",
    W("jposts") + f"""SELECT event_id, {Q.count_matches('content', Q.URLS)} AS urls,
      {Q.count_matches('content', Q.TAGS)} AS hashtags FROM jposts""",
)
def url_hashtag_counts(spark, sf_dir):
    return V.jposts(spark, sf_dir).select(
        "event_id",
        T.url_count(F.col("content")).cast("long").alias("urls"),
        T.hashtag_count(F.col("content")).cast("long").alias("hashtags"),
    )


@query("drop_blank", W("observations") + f"SELECT event_id, seq FROM observations WHERE NOT {Q.blank('content')}")
def drop_blank(spark, sf_dir):
    return observations.drop_blank(V.observations(spark, sf_dir)).select("event_id", "seq")


@query(
    "drop_mention_only",
    W("observations") + f"SELECT event_id, seq FROM observations WHERE NOT {Q.blank(Q.clean('content'))}",
)
def drop_mention_only(spark, sf_dir):
    return observations.drop_mention_only(V.observations(spark, sf_dir)).select("event_id", "seq")


@query(
    "time_range_filter",
    W("posts") + "SELECT event_id, created_at FROM posts WHERE created_at BETWEEN 1700500000 AND 1702500000",
)
def time_range_filter(spark, sf_dir):
    return observations.in_time_range(V.posts(spark, sf_dir), 1700500000, 1702500000).select("event_id", "created_at")


@query(
    "char_ratios",
    W("jposts") + f"""SELECT event_id, length, round(kana_ratio, 6) AS kana_ratio, round(cjk_ratio, 6) AS cjk_ratio,
      round(latin_ratio, 6) AS latin_ratio FROM ({Q.gate('jposts')})""",
)
def char_ratios(spark, sf_dir):
    rated = G.with_char_ratios(V.jposts(spark, sf_dir))
    return rated.select(
        "event_id", F.col("length").cast("long").alias("length"), r6("kana_ratio"), r6("cjk_ratio"), r6("latin_ratio")
    )


@query(
    "language_gate",
    W("jposts") + f"""SELECT event_id, detected, is_japanese, borderline, coalesce(exclude_reason, '') AS exclude_reason
      FROM ({Q.gate('jposts')})""",
)
def language_gate(spark, sf_dir):
    return G.with_language_gate(V.jposts(spark, sf_dir)).select(
        "event_id", "detected", "is_japanese", "borderline",
        F.coalesce("exclude_reason", F.lit("")).alias("exclude_reason"),
    )


@query(
    "spam_reasons",
    W("jposts") + f"""SELECT event_id, {Q.SPAM} AS reasons FROM (
      SELECT *, {Q.spam_flags()} FROM (SELECT *, {Q.clean('content')} AS clean FROM jposts))""",
)
def spam_reasons(spark, sf_dir):
    return G.with_spam_reasons(V.jposts(spark, sf_dir)).select(
        "event_id", F.array_join("spam_reasons", ",").alias("reasons")
    )


# One row per hash: oldest copy, counts, first position and relays in encounter order.
def clusters_sql(source: str) -> str:
    return f"""SELECT content_hash, event_id, pubkey, created_at, content, dup_count, author_count, first_seq, relays
      FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY created_at, seq) AS rn FROM hashed_{source})
      JOIN (SELECT content_hash, count(*) AS dup_count, count(DISTINCT pubkey) AS author_count, min(seq) AS first_seq
            FROM hashed_{source} GROUP BY content_hash) USING (content_hash)
      JOIN (SELECT content_hash, string_agg(relay, ',' ORDER BY met) AS relays FROM
            (SELECT content_hash, relay, min(seq) AS met FROM hashed_{source} GROUP BY ALL) GROUP BY content_hash)
        USING (content_hash)
      WHERE rn = 1"""


def hashed_sql(source: str) -> str:
    return f"SELECT *, {Q.chash('content')} AS content_hash FROM {source}"


def status_sql(clusters: str) -> str:
    dup = "dup_count > 1"
    boiler = "(dup_count >= 5 AND author_count >= 3)"
    soft = Q.joined(
        (dup, "near_dup_representative"), (boiler, "boilerplate_high_freq"), ("borderline", "borderline_language"),
        ("s_urls", "too_many_urls"), ("s_tags", "too_many_hashtags"),
        ("s_short", "too_short_after_clean"), ("s_promo", "promo_boilerplate"),
    )
    return f"""SELECT *, CASE WHEN NOT is_japanese OR s_promo OR s_urls THEN 'excluded'
        WHEN {dup} OR {boiler} OR borderline OR s_tags OR s_short THEN 'review' ELSE 'approved' END AS status,
      CASE WHEN NOT is_japanese THEN exclude_reason WHEN s_promo OR s_urls THEN {Q.SPAM} ELSE {soft} END AS reasons
    FROM (SELECT *, {Q.spam_flags()} FROM ({Q.gate(clusters)}))"""


@query(
    "near_dup_clusters",
    W("posts", hashed_posts=hashed_sql("posts")) + f"""SELECT content_hash, event_id, pubkey, created_at, dup_count,
      author_count, first_seq, relays FROM ({clusters_sql('posts')})""",
)
def near_dup_clusters(spark, sf_dir):
    return dedup.near_dup_clusters(V.posts(spark, sf_dir)).select(
        "content_hash", "event_id", "pubkey", "created_at", "dup_count", "author_count", "first_seq",
        F.array_join("relay", ",").alias("relays"),
    )


@query(
    "distinct_ids",
    W("observations") + """SELECT event_id, pubkey, seq FROM observations
      QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq) = 1""",
)
def distinct_ids(spark, sf_dir):
    return dedup.distinct_ids(V.observations(spark, sf_dir)).select("event_id", "pubkey", "seq")


CURATED = dict(
    hashed_jposts=hashed_sql("jposts"),
    clusters=clusters_sql("jposts"),
    classified=status_sql("clusters"),
)
TARGET, CAP = 120, 8


def curated_sql() -> dict[str, str]:
    def tier(status: str, room: str) -> str:
        return f"""SELECT * FROM (SELECT event_id, pubkey, row_number() OVER (PARTITION BY pubkey
            ORDER BY created_at DESC, first_seq) AS rn, min(first_seq) OVER (PARTITION BY pubkey) AS author_ord
          FROM classified WHERE status = '{status}') LEFT JOIN taken USING (pubkey) WHERE rn <= {room}"""

    return {
        **CURATED,
        "taken": f"""SELECT pubkey, least({CAP}, count(*)) AS used FROM classified
          WHERE status = 'approved' GROUP BY pubkey""",
        "tier0": tier("approved", str(CAP)) + f" ORDER BY rn, author_ord LIMIT {TARGET}",
        "tier1": tier("review", f"{CAP} - coalesce(used, 0)")
        + f" ORDER BY rn, author_ord LIMIT greatest(0, {TARGET} - (SELECT count(*) FROM tier0))",
        "samples": """SELECT c.*, CASE WHEN a.event_id IS NOT NULL OR b.event_id IS NOT NULL THEN 'approved'
            ELSE 'review' END AS review_status, b.event_id IS NOT NULL AS backfilled
          FROM classified c LEFT JOIN tier0 a USING (event_id) LEFT JOIN tier1 b USING (event_id)
          WHERE status <> 'excluded'""",
    }


@query(
    "classify_status",
    W("jposts", **CURATED) + "SELECT event_id, content_hash, status, reasons, dup_count FROM classified",
)
def classify_status(spark, sf_dir):
    return curation.classify_posts_status(V.jposts(spark, sf_dir)).select(
        "event_id", "content_hash", "status", F.array_join("reasons", ",").alias("reasons"), "dup_count"
    )


@query(
    "curate_sample",
    W("jposts", **curated_sql())
    + """SELECT event_id, pubkey, created_at, sha256(content) AS content_digest, relays, review_status
      FROM samples""",
)
def curate_sample(spark, sf_dir):
    done = curation.curate(V.jposts(spark, sf_dir), TARGET, CAP)
    return done.sample_rows().select(
        "event_id", "pubkey", "created_at", F.sha2("content", 256).alias("content_digest"),
        F.array_join("relay", ",").alias("relays"), "review_status",
    )


@query(
    "curate_report",
    W("jposts", **curated_sql())
    + """SELECT * FROM (SELECT CAST(sum(dup_count) AS BIGINT) AS after_event_dedup, count(*) AS after_content_dedup,
        count(*) FILTER (NOT is_japanese) AS language_excluded,
        count(*) FILTER (is_japanese AND (s_urls OR s_tags OR s_short OR s_promo)) AS spam_excluded,
        count(*) FILTER (status = 'excluded') AS excluded_total,
        count(*) FILTER (detected = 'jpn') AS detected_jpn, count(*) FILTER (detected = 'und') AS detected_und,
        count(*) FILTER (detected NOT IN ('jpn', 'und')) AS detected_other FROM classified),
      (SELECT count(*) FILTER (review_status = 'approved') AS approved, count(*) FILTER (review_status = 'review') AS review,
        count(*) FILTER (backfilled) AS approved_backfilled FROM samples),
      (SELECT count(*) AS unique_authors, coalesce(max(n), 0) AS max_per_author FROM
        (SELECT pubkey, count(*) AS n FROM samples WHERE review_status = 'approved' GROUP BY pubkey))""",
)
def curate_report(spark, sf_dir):
    return curation.curate(V.jposts(spark, sf_dir), TARGET, CAP).report()


@query(
    "language_tally",
    W("jposts", **CURATED) + """SELECT count(*) FILTER (detected = 'jpn') AS detected_jpn,
      count(*) FILTER (detected = 'und') AS detected_und,
      count(*) FILTER (detected NOT IN ('jpn', 'und')) AS detected_other FROM classified""",
)
def language_tally(spark, sf_dir):
    return curation.language_tally(G.with_language_gate(dedup.near_dup_clusters(V.jposts(spark, sf_dir))))


@query(
    "author_stats",
    W("jposts", **curated_sql()) + """SELECT pubkey, count(*) AS count FROM samples WHERE review_status = 'approved'
      GROUP BY pubkey ORDER BY count(*) DESC, min(first_seq) LIMIT 10""",
)
def author_stats(spark, sf_dir):
    samples = curation.curate(V.jposts(spark, sf_dir), TARGET, CAP).samples
    return activity.top_authors(activity.author_stats(samples))


@query(
    "select_approved",
    W("jposts", **curated_sql()) + "SELECT event_id, first_seq FROM samples WHERE review_status = 'approved'",
)
def select_approved(spark, sf_dir):
    samples = curation.curate(V.jposts(spark, sf_dir), TARGET, CAP).samples
    return progress.select_approved(samples).select("event_id", "first_seq")


@query(
    "select_approved_first_n",
    W("jposts", **curated_sql()) + "SELECT event_id, first_seq FROM samples WHERE review_status = 'approved' ORDER BY first_seq LIMIT 25",
)
def select_approved_first_n(spark, sf_dir):
    rows = curation.curate(V.jposts(spark, sf_dir), TARGET, CAP).sample_rows()
    return progress.select_approved(rows, 25).select("event_id", "first_seq")


@query(
    "author_cap",
    W("posts") + """SELECT event_id, pubkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY seq) AS rn
      FROM posts) WHERE rn <= 25""",
)
def author_cap(spark, sf_dir):
    return keyed.cap_per_key(V.posts(spark, sf_dir), ["pubkey"], [F.col("seq")], 25).select(
        "event_id", "pubkey", F.col("rn").cast("long").alias("rn")
    )


@query(
    "round_robin_sample",
    W("posts") + """SELECT event_id, pubkey, rn, author_ord FROM (SELECT *, row_number() OVER (PARTITION BY pubkey
        ORDER BY created_at DESC, seq) AS rn, min(seq) OVER (PARTITION BY pubkey) AS author_ord FROM posts)
      WHERE rn <= 10 ORDER BY rn, author_ord LIMIT 150""",
)
def round_robin_sample(spark, sf_dir):
    return sampling.round_robin_sample(V.posts(spark, sf_dir), 150, 10).select(
        "event_id", "pubkey", F.col("rn").cast("long").alias("rn"), "author_ord"
    )


FOLDED = dict(
    usable=f"SELECT * FROM observations WHERE NOT {Q.blank(Q.clean('content'))}",
    firsts="SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq) = 1",
    relays="""SELECT event_id, string_agg(relay, ',' ORDER BY met) AS relays, CAST(sum(n) AS BIGINT) AS n_obs FROM
      (SELECT event_id, relay, min(seq) AS met, count(*) AS n FROM usable GROUP BY ALL) GROUP BY event_id""",
    folded="""SELECT event_id, pubkey, created_at, content, relays, seq, n_obs,
      row_number() OVER (PARTITION BY pubkey ORDER BY seq) AS rn FROM firsts JOIN relays USING (event_id)""",
)


@query(
    "fold_observations",
    W("observations", **FOLDED)
    + "SELECT event_id, pubkey, created_at, relays, seq, n_obs FROM folded WHERE rn <= 25",
)
def fold_observations(spark, sf_dir):
    return observations.fold_observations(V.observations(spark, sf_dir)).select(
        "event_id", "pubkey", "created_at", F.array_join("relay", ",").alias("relays"), "seq", "n_obs"
    )


@query(
    "ingest_skips",
    W("observations", **FOLDED) + f"""SELECT * FROM (SELECT count(*) FILTER ({Q.blank('content')}) AS skipped_empty,
        count(*) FILTER ({Q.blank(Q.clean('content'))} AND NOT {Q.blank('content')}) AS skipped_mention_only
        FROM observations), (SELECT CAST(coalesce(sum(n_obs), 0) AS BIGINT) AS skipped_author_cap FROM folded WHERE rn > 25)""",
)
def ingest_skips(spark, sf_dir):
    return observations.ingest_skips(V.observations(spark, sf_dir))


@query(
    "resume_raw_append",
    W(
        "observations",
        stored="SELECT * FROM posts WHERE lang = 'fr'",
        usable=f"""SELECT * FROM observations WHERE NOT {Q.blank(Q.clean('content'))}
          AND event_id NOT IN (SELECT event_id FROM stored)""",
        firsts=FOLDED["firsts"],
        ranked="SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY seq) AS rn FROM firsts",
    )
    + """SELECT event_id, r.pubkey, seq FROM ranked r
      LEFT JOIN (SELECT pubkey, count(*) AS n FROM stored GROUP BY pubkey) s ON r.pubkey = s.pubkey
      WHERE rn + coalesce(n, 0) <= 25""",
)
def resume_raw_append(spark, sf_dir):
    stored = V.posts(spark, sf_dir).filter(F.col("lang") == "fr")
    return observations.resume_append(stored, V.observations(spark, sf_dir)).select("event_id", "pubkey", "seq")


@query(
    "resume_raw_merge",
    W(
        "observations",
        stored="SELECT event_id, seq, ['z', 'r1'] AS relay FROM posts WHERE lang = 'fr'",
        again=f"""SELECT event_id, relay, min(seq) AS met FROM observations WHERE NOT {Q.blank(Q.clean('content'))}
          AND event_id IN (SELECT event_id FROM stored) AND relay NOT IN ('z', 'r1') GROUP BY ALL""",
    )
    + """SELECT event_id, array_to_string(list_concat(relay, coalesce((SELECT list(relay ORDER BY met) FROM again a WHERE a.event_id = s.event_id), [])), ',') AS relays
      FROM stored s""",
)
def resume_raw_merge(spark, sf_dir):
    stored = V.posts(spark, sf_dir).filter(F.col("lang") == "fr").withColumn("relay", F.array(F.lit("z"), F.lit("r1")))
    merged = observations.resume_merge(stored, V.observations(spark, sf_dir), stored.limit(0))
    return merged.select("event_id", F.array_join("relay", ",").alias("relays"))


@query(
    "concat_sources",
    W("posts", "chats") + """SELECT event_id, pubkey, created_at, 0 AS source_rank, lang FROM posts
      UNION ALL SELECT event_id, pubkey, created_at, 1, NULL FROM chats""",
)
def concat_sources(spark, sf_dir):
    both = observations.concat_sources(V.posts(spark, sf_dir), None, V.chats(spark, sf_dir).withColumn("relay", F.array(F.lit("c"))))
    return both.select(
        "event_id", "pubkey", "created_at", (F.col("source_rank") / 2).cast("int").alias("source_rank"), "lang"
    )


SLICE = "(1703888000 - created_at)"


@query(
    "time_slices",
    W(
        "posts",
        slices="""SELECT i AS slice, greatest(1703888000 - 45 * 86400, 1703888000 - (i + 1) * 4 * 86400) AS since_sec,
          1703888000 - i * 4 * 86400 AS until_sec FROM (SELECT unnest(range(0, 12)) AS i)""",
    )
    + """SELECT slice, since_sec, until_sec, count(created_at) AS posts FROM slices
      LEFT JOIN posts ON created_at BETWEEN since_sec AND until_sec GROUP BY ALL""",
)
def time_slices(spark, sf_dir):
    now, window, step = 1703888000, 45, 4
    tagged = V.posts(spark, sf_dir).select(
        F.explode(C.slices_of(F.col("created_at"), now, window, step)).alias("slice")
    )
    counts = tagged.groupBy("slice").agg(F.count(F.lit(1)).alias("posts"))
    plan = spark.range(1).select(F.inline(C.slice_bounds(now, window, step)))
    return plan.join(counts, "slice", "left").select(
        F.col("slice").cast("long").alias("slice"), "since_sec", "until_sec", F.coalesce("posts", F.lit(0)).alias("posts")
    )


@query(
    "first_n_posts",
    W("posts") + """SELECT event_id, pubkey, rn - 1 AS source_index FROM (SELECT *, row_number() OVER
      (PARTITION BY pubkey ORDER BY created_at DESC, seq) AS rn FROM posts) WHERE rn <= 30""",
)
def first_n_posts(spark, sf_dir):
    return sampling.first_n_posts(V.posts(spark, sf_dir), 30).select(
        "event_id", "pubkey", F.col("source_index").cast("long").alias("source_index")
    )
