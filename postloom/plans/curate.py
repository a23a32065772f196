"""Curation: near-duplicate clusters, status, author-balanced sample with backfill, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from postloom.functions import gates as G
from postloom.operators.activity import author_stats, author_totals, top_authors
from postloom.operators.dedup import near_dup_clusters
from postloom.operators.keyed import side_by_side
from postloom.operators.sampling import AUTHOR_CAP, TARGET, sample_with_backfill
from postloom.session import materialize

SAMPLE_COLUMNS = ("event_id", "pubkey", "created_at", "content", "relay", "review_status", "first_seq")


# What the gates of :mod:`postloom.functions.gates` do, in words for the policy row.
LANGUAGE_RULES = (
    "at least 5 characters of text",
    "kana share of 0.12 or more, or kana and kanji share of 0.35 or more",
    "a detector that says Chinese excludes texts without kana",
)
EXCLUSION_RULES = ("promotion", "too many links or tags", "texts in other languages", "mentions only")

CLASSIFIED_COLUMNS = (
    "content_hash", "event_id", "pubkey", "created_at", "content", "relay", "dup_count",
    "author_count", "first_seq", "detected", "is_japanese", "spam_reasons", "status", "reasons",
)


CLASSIFIED_COUNTERS = (
    "after_event_dedup", "after_content_dedup", "language_excluded", "spam_excluded", "excluded_total",
    "detected_jpn", "detected_und", "detected_other",
)


def classify_posts_status(posts: DataFrame) -> DataFrame:
    """Clusters of raw posts with their gate verdicts and three-way status."""
    return G.with_status(near_dup_clusters(posts)).select(*CLASSIFIED_COLUMNS)


def _classified_counters() -> list[Column]:
    """Counters over the classified clusters; ``spam_excluded`` counts every language-passing cluster with any spam reason."""
    status, lang = F.col("status"), F.col("detected")
    return [
        F.coalesce(F.sum("dup_count"), F.lit(0)).alias("after_event_dedup"),
        F.count(F.lit(1)).alias("after_content_dedup"),
        F.count_if(~F.col("is_japanese")).alias("language_excluded"),
        F.count_if(F.col("is_japanese") & (F.size("spam_reasons") > 0)).alias("spam_excluded"),
        F.count_if(status == "excluded").alias("excluded_total"),
        *_language_counters(lang),
    ]


def _language_counters(lang: Column) -> list[Column]:
    return [
        F.count_if(lang == "jpn").alias("detected_jpn"),
        F.count_if(lang == "und").alias("detected_und"),
        F.count_if(~lang.isin("jpn", "und")).alias("detected_other"),
    ]


def language_tally(classified: DataFrame) -> DataFrame:
    """Representatives detected as Japanese, undetermined or other."""
    return classified.agg(*_language_counters(F.col("detected")))


def curate_report(classified: DataFrame, samples: DataFrame, counted: dict[str, int] | None = None) -> DataFrame:
    """One row of funnel, author and language counters.

    ``counted`` are the counters of ``classified`` if they were taken while it was written; else it is read for them.
    """
    sampled = samples.agg(
        F.count_if(F.col("review_status") == "approved").alias("approved"),
        F.count_if(F.col("review_status") == "review").alias("review"),
        F.count_if("backfilled").alias("approved_backfilled"),
    )
    authors = author_totals(author_stats(samples))
    names = [*(n for n in CLASSIFIED_COUNTERS if not n.startswith("detected_")), *sampled.columns, *authors.columns, *(n for n in CLASSIFIED_COUNTERS if n.startswith("detected_"))]
    if counted is None:
        counters = classified.agg(*_classified_counters())
    else:
        counters = samples.sparkSession.range(1).select(*(F.lit(counted[n]).cast("bigint").alias(n) for n in CLASSIFIED_COUNTERS))
    return side_by_side(counters, sampled, authors).select(*names)


@dataclass
class Curation:
    """Classified clusters (materialized), the sampled posts derived from them, and the counters taken while the clusters were written."""

    classified: DataFrame
    samples: DataFrame
    target: int = TARGET
    author_cap: int = AUTHOR_CAP
    counted: dict[str, int] | None = None

    def sample_rows(self) -> DataFrame:
        return self.samples.select(*SAMPLE_COLUMNS)

    def report(self) -> DataFrame:
        return curate_report(self.classified, self.samples, self.counted)

    def policy(self) -> DataFrame:
        """One row: how samples were chosen."""
        return self.samples.sparkSession.range(1).select(
            F.lit(self.target).alias("target"),
            F.lit(self.author_cap).alias("per_author_cap"),
            F.array(F.lit("event_id"), F.lit("normalized_content")).alias("dedupe"),
            F.array(*(F.lit(x) for x in LANGUAGE_RULES)).alias("language_heuristics"),
            F.array(*(F.lit(x) for x in EXCLUSION_RULES)).alias("exclusions"),
        )

    def top_authors(self, n: int = 10) -> DataFrame:
        """Authors with the most approved samples."""
        return top_authors(author_stats(self.samples), n)

    def write(self, path: str, raw_skips: DataFrame | None = None) -> None:
        """Samples, selection policy, top authors and the one-row report, with the counters of the intake if given."""
        self.sample_rows().write.mode("overwrite").parquet(f"{path}/samples")
        self.policy().write.mode("overwrite").json(f"{path}/policy")
        self.top_authors().write.mode("overwrite").json(f"{path}/top_authors")
        report = self.report() if raw_skips is None else side_by_side(self.report(), raw_skips)
        report.write.mode("overwrite").json(f"{path}/report")


def curate(posts: DataFrame, target: int = TARGET, author_cap: int = AUTHOR_CAP) -> Curation:
    """Run curation over raw posts (``event_id, pubkey, created_at, content, relay, seq``).

    The classified clusters are written once, and counted as they are written; ranking, author order and backfill read only their
    narrow columns, and the text is read again only for the final rows.
    """
    counters = Observation()
    classified = materialize(classify_posts_status(posts).observe(counters, *_classified_counters()), "classified")
    # Nothing is observed where Spark sees beforehand that there are no rows.
    counted = dict.fromkeys(CLASSIFIED_COUNTERS, 0) | counters.get
    return Curation(classified, sample_with_backfill(classified, target, author_cap), target, author_cap, counted)
