"""Language gate and spam rules.

Both are staged: cheap shared columns (the cleaned text, its lengths and script counts) are
projected once and the verdicts are ``CASE`` expressions over them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import text as T

# --- fixed values --------------------------------------------------------------------------
CONFIDENT_OTHER_LANGUAGES = (
    "cmn", "kor", "eng", "rus", "spa", "fra", "deu", "por", "ita", "tha", "vie", "ind",
)
MIN_LENGTH = 5
KANA_MIN = 0.12
CJK_MIN = 0.35
BORDER_WIDTH = 0.04
MAX_URLS = 2
MAX_HASHTAGS = 5
MIN_CLEAN_LENGTH = 4
# -------------------------------------------------------------------------------------------

DETECTOR_MIN_LENGTH = 10


def script_detector(content: Column) -> Column:
    """Default language code from scripts alone: ``und``, ``jpn``, ``cmn`` or ``oth``.

    A text with fewer than ten non-space characters stays undetermined. Pass another
    ``Column -> Column`` function (a pandas UDF, say) to :func:`with_language_gate` to replace it.
    The counts are taken once per text and the rule reads them from a bound struct.
    """
    text = F.coalesce(content, F.lit(""))
    spaces = F.length(F.regexp_replace(text, f"[{T.NOT_SPACE}]+", ""))
    counts = F.struct(
        (F.length(text) - spaces).alias("size"),
        T.count_chars(text, T.KANA_RANGES).alias("kana"),
        T.count_chars(text, T.KANJI_RANGES).alias("han"),
    )

    def verdict(c: Column) -> Column:
        return (
            F.when(c["size"] < DETECTOR_MIN_LENGTH, F.lit("und"))
            .when((c["kana"] > 0) & ((c["kana"] + c["han"]) * 2 >= c["size"]), F.lit("jpn"))
            .when((c["kana"] == 0) & (c["han"] * 3 >= c["size"]), F.lit("cmn"))
            .otherwise(F.lit("oth"))
        )

    return F.element_at(F.transform(F.array(counts), verdict), 1)


def with_char_ratios(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``clean``, ``length``, ``kana_ratio``, ``cjk_ratio`` and ``latin_ratio``."""
    staged = df.withColumn("clean", T.clean_text(F.col(content)))
    staged = staged.withColumns(
        {
            "length": T.utf16_length(F.col("clean")),
            "_kana": T.count_chars(F.col("clean"), T.KANA_RANGES),
            "_kanji": T.count_chars(F.col("clean"), T.KANJI_RANGES),
            "_latin": T.count_chars(F.lower("clean"), T.LATIN_RANGES),
        }
    )

    def share(count: Column) -> Column:
        return F.when(F.col("length") > 0, count / F.col("length")).otherwise(F.lit(0.0))

    return staged.withColumns(
        {
            "kana_ratio": share(F.col("_kana")),
            "cjk_ratio": share(F.col("_kana") + F.col("_kanji")),
            "latin_ratio": share(F.col("_latin")),
        }
    ).drop("_kana", "_kanji", "_latin")


def with_language_gate(
    df: DataFrame,
    content: str = "content",
    min_length: int = MIN_LENGTH,
    kana_min: float = KANA_MIN,
    cjk_min: float = CJK_MIN,
    detector: Callable[[Column], Column] = script_detector,
) -> DataFrame:
    """Add the ratio columns plus ``detected``, ``is_japanese``, ``borderline``, ``exclude_reason``.

    ``too_short`` is checked first on the untrimmed cleaned text, then the script shares, then
    the detector, which only speaks where no kana is present.
    """
    rated = with_char_ratios(df, content).withColumn("detected", detector(F.col(content)))
    accepted = (F.col("kana_ratio") >= kana_min) | (F.col("cjk_ratio") >= cjk_min)
    reason = (
        F.when(F.col("length") < min_length, F.lit("too_short"))
        .when(~accepted, F.lit("not_japanese"))
        .when(
            (F.col("kana_ratio") == 0) & F.col("detected").isin(*CONFIDENT_OTHER_LANGUAGES),
            F.lit("franc_non_jp"),
        )
    )
    return (
        rated.withColumn("exclude_reason", reason)
        .withColumn("is_japanese", F.col("exclude_reason").isNull())
        .withColumn(
            "borderline",
            F.coalesce(~F.col("exclude_reason").isin("too_short", "not_japanese"), F.lit(True))
            & (F.abs(F.col("kana_ratio") - kana_min) <= BORDER_WIDTH),
        )
    )


def with_gate_verdict(
    df: DataFrame,
    content: str = "content",
    min_length: int = MIN_LENGTH,
    kana_min: float = KANA_MIN,
    cjk_min: float = CJK_MIN,
    detector: Callable[[Column], Column] = script_detector,
) -> DataFrame:
    """Add ``is_japanese`` alone, as :func:`with_language_gate` has it.

    Kanji are counted only where kana do not decide, and the detector is asked only where it may speak.
    """
    staged = T.with_clean_text(df, "_gate_clean", content)
    staged = staged.withColumns(
        {"_gate_length": T.utf16_length(F.col("_gate_clean")), "_gate_kana": T.count_chars(F.col("_gate_clean"), T.KANA_RANGES)}
    )
    length, kana = F.col("_gate_length"), F.col("_gate_kana")

    def share(count: Column) -> Column:
        return F.when(length > 0, count / length).otherwise(F.lit(0.0))

    scripts = kana + T.count_chars(F.col("_gate_clean"), T.KANJI_RANGES)
    verdict = (
        F.when(length < min_length, F.lit(False))
        .when((kana > 0) & (share(kana) >= kana_min), F.lit(True))
        .when((share(kana) < kana_min) & (share(scripts) < cjk_min), F.lit(False))
        .when(kana > 0, F.lit(True))
        .otherwise(F.coalesce(~detector(F.col(content)).isin(*CONFIDENT_OTHER_LANGUAGES), F.lit(True)))
    )
    return staged.withColumn("is_japanese", verdict).drop("_gate_clean", "_gate_length", "_gate_kana")


def spam_reasons(content: Column, cleaned: Column) -> Column:
    """Array of spam reasons in rule order; empty when the post is fine."""
    return F.array_compact(
        F.array(
            F.when(T.url_count(content) > MAX_URLS, F.lit("too_many_urls")),
            F.when(T.hashtag_count(content) > MAX_HASHTAGS, F.lit("too_many_hashtags")),
            F.when(
                T.utf16_length(T.strip_spaces(cleaned)) < MIN_CLEAN_LENGTH,
                F.lit("too_short_after_clean"),
            ),
            F.when(T.has_promo_words(content), F.lit("promo_boilerplate")),
        )
    )


def with_spam_reasons(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``spam_reasons``, reusing a ``clean`` column when the gate already made one."""
    if "clean" not in df.columns:
        df = df.withColumn("clean", T.clean_text(F.col(content)))
    return df.withColumn("spam_reasons", spam_reasons(F.col(content), F.col("clean")))


def with_status(df: DataFrame, content: str = "content") -> DataFrame:
    """Three-way status of cluster representatives.

    Needs ``dup_count`` and ``author_count``; adds ``status`` (approved, review, excluded),
    ``reasons`` and the gate columns. A language exclusion replaces all reasons, a hard spam
    exclusion (promo words or too many URLs) keeps only the spam reasons.
    """
    gated = with_spam_reasons(with_language_gate(df, content), content)
    spam = F.col("spam_reasons")
    copied = F.col("dup_count") > 1
    boilerplate = (F.col("dup_count") >= 5) & (F.col("author_count") >= 3)
    hard_spam = F.array_contains(spam, "promo_boilerplate") | F.array_contains(spam, "too_many_urls")
    soft = copied | boilerplate | F.col("borderline") | (F.size(spam) > 0)
    kept_reasons = F.concat(
        F.array_compact(
            F.array(
                F.when(copied, F.lit("near_dup_representative")),
                F.when(boilerplate, F.lit("boilerplate_high_freq")),
                F.when(F.col("borderline"), F.lit("borderline_language")),
            )
        ),
        spam,
    )
    return gated.withColumns(
        {
            "status": F.when(~F.col("is_japanese") | hard_spam, F.lit("excluded"))
            .when(soft, F.lit("review"))
            .otherwise(F.lit("approved")),
            "reasons": F.when(~F.col("is_japanese"), F.array("exclude_reason"))
            .when(hard_spam, spam)
            .otherwise(kept_reasons),
        }
    )
