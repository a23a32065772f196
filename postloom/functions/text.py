"""Text rules for short posts, all built from JVM-side expressions.

Whitespace, word boundaries and string lengths follow ECMAScript: one explicit whitespace
class, ASCII word boundaries and UTF-16 lengths.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: character ranges (inclusive code points), words and literals ------------
SPACE_RANGES = (
    (0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
    (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF),
)
KANA_RANGES = ((0x3040, 0x30FF), (0xFF66, 0xFF9F))
KANJI_RANGES = ((0x4E00, 0x9FAF),)
LATIN_RANGES = ((0x61, 0x7A),)
KEPT_RANGES = (
    (0x30, 0x39), (0x61, 0x7A), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xFF66, 0xFF9F),
)
PROMO_WORDS = (
    "アフィリエイト", "期間限定", "今すぐ", "クリック", "登録はこちら", "無料登録", "稼げる", "副業で",
)
PROMO_MARK = "(?i)PR(?<![0-9A-Za-z_]PR)(?![0-9A-Za-z_])"  # also inside [PR] and 【PR】
# -------------------------------------------------------------------------------------------

LAST_CODE_POINT = 0x10FFFF


def char_class(ranges: Sequence[tuple[int, int]]) -> str:
    """Body of a regex class for code point ranges."""
    return "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges)


def other_chars(ranges: Sequence[tuple[int, int]]) -> str:
    """Body of the class of all other characters, spelled as ranges.

    Java evaluates a plain class of several ranges about five times faster than ``[^...]``.
    """
    gaps, start = [], 0
    for lo, hi in sorted(ranges):
        if lo > start:
            gaps.append((start, lo - 1))
        start = hi + 1
    return char_class([*gaps, (start, LAST_CODE_POINT)])


SPACE, NOT_SPACE = char_class(SPACE_RANGES), other_chars(SPACE_RANGES)
SPACE_TEXT = "".join(chr(c) for lo, hi in SPACE_RANGES for c in range(lo, hi + 1))
URL_PATTERN = f"https?://[{NOT_SPACE}]+"
# The word boundary is looked up behind the literal, so it is tested only where that occurs.
LINK_PATTERN = f"(?i)nostr:(?<![0-9A-Za-z_]nostr:)[{NOT_SPACE}]+"
MENTION_PATTERN = "(?i)npub1(?<![0-9A-Za-z_]npub1)[a-z0-9]+"
HASHTAG_PATTERN = f"[#＃][{other_chars((*SPACE_RANGES, (0x23, 0x23), (0xFF03, 0xFF03)))}]+"


def strip_spaces(col: Column) -> Column:
    """Trim the full whitespace class on both ends."""
    return F.trim(col, F.lit(SPACE_TEXT))


def collapse_spaces(col: Column) -> Column:
    """Every whitespace run becomes one blank; both ends trimmed."""
    return F.trim(F.regexp_replace(col, f"[{SPACE}]+", " "))


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 code units (a supplementary character counts twice)."""
    return (F.octet_length(F.encode(col, "UTF-16BE")) / 2).cast("int")


def is_blank(col: Column) -> Column:
    """Null, empty or whitespace only."""
    return F.coalesce(strip_spaces(col) == "", F.lit(True))


def clean_text(col: Column) -> Column:
    """Replace URLs, protocol links and key mentions by one blank each, in that order."""
    out = F.coalesce(col, F.lit(""))
    for pattern in (URL_PATTERN, LINK_PATTERN, MENTION_PATTERN):
        out = F.regexp_replace(out, pattern, " ")
    return out


def with_clean_text(df: DataFrame, name: str, content: str = "content") -> DataFrame:
    """Add :func:`clean_text` of ``content`` as ``name``; patterns are only looked for in texts that hold their mark, in either case."""
    staged = df.withColumn(name, F.regexp_replace(F.coalesce(F.col(content), F.lit("")), URL_PATTERN, " "))
    for pattern, mark in ((LINK_PATTERN, "r:"), (MENTION_PATTERN, "b1")):
        marked = F.contains(F.col(name), F.lit(mark)) | F.contains(F.col(name), F.lit(mark.upper()))
        staged = staged.withColumn(name, F.when(marked, F.regexp_replace(F.col(name), pattern, " ")).otherwise(F.col(name)))
    return staged


def is_mention_only(col: Column) -> Column:
    """Nothing readable is left once links and mentions are removed."""
    return is_blank(clean_text(col))


def normalize_cleaned(cleaned: Column) -> Column:
    """Normal form of an already cleaned text."""
    return F.trim(F.regexp_replace(F.lower(cleaned), f"[{other_chars(KEPT_RANGES)}]+", " "))


def normalize_content(col: Column) -> Column:
    """Near-duplicate normal form: clean, lower, keep only alphanumerics, kana and Han."""
    return normalize_cleaned(clean_text(col))


def content_hash(col: Column) -> Column:
    """SHA-256 hex of :func:`normalize_content`."""
    return F.sha2(normalize_content(col), 256)


def normalize_for_classifier(col: Column) -> Column:
    """Classifier input: clean, collapse whitespace, trim."""
    return collapse_spaces(clean_text(col))


def count_chars(col: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    """Number of characters of ``col`` in the ranges; drops whole runs of other text."""
    return F.length(F.regexp_replace(col, f"[{other_chars(ranges)}]+", ""))


def url_count(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(URL_PATTERN)), F.lit(0))


def hashtag_count(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(HASHTAG_PATTERN)), F.lit(0))


def has_promo_words(col: Column) -> Column:
    found = reduce(or_, [F.contains(col, F.lit(word)) for word in PROMO_WORDS])
    return F.coalesce(found | F.rlike(col, F.lit(PROMO_MARK)), F.lit(False))


def normalize_label(col: Column) -> Column:
    """Label character: null becomes empty, trimmed, full-width H becomes H."""
    return F.translate(strip_spaces(F.coalesce(col, F.lit(""))), "Ｈ", "H")


def hex_key(col: Column) -> Column:
    """Lower-case 64-digit hex key, or null when the trimmed input is no such key."""
    key = F.lower(strip_spaces(col))
    return F.when(F.rlike(key, F.lit("^[0-9a-f]{64}$")), key)
