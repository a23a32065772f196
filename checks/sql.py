"""DuckDB spellings of the text rules, as functions that build SQL expressions."""

from __future__ import annotations

WS = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
KANA = r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{FF66}-\x{FF9F}"
KANJI = r"\x{4E00}-\x{9FAF}"
KEPT = r"0-9a-z\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{FF66}-\x{FF9F}"
PROMO = (
    r"(?i)アフィリエイト|期間限定|今すぐ|クリック|登録はこちら|無料登録|稼げる|副業で|\bPR\b|\[PR\]|【PR】"
)
HEX = "0123456789abcdef"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def clean(x: str) -> str:
    out = f"coalesce({x}, '')"
    for pattern in (rf"https?://[^{WS}]+", rf"(?i)\bnostr:[^{WS}]+", r"(?i)\bnpub1[a-z0-9]+"):
        out = sub(out, pattern, " ")
    return out


def norm_clean(c: str) -> str:
    return f"trim({sub(f'lower({c})', f'[^{KEPT}]+', ' ')})"


def norm(x: str) -> str:
    return norm_clean(clean(x))


def chash(x: str) -> str:
    return f"sha256({norm(x)})"


def strip(x: str) -> str:
    return sub(x, f"^[{WS}]+|[{WS}]+$")


def collapse(x: str) -> str:
    return f"trim({sub(x, f'[{WS}]+', ' ')})"


def blank(x: str) -> str:
    return f"(NOT regexp_matches(coalesce({x}, ''), '[^{WS}]'))"


def u16(x: str) -> str:
    return f"(length({x}) + length({sub(x, '[^\\x{10000}-\\x{10FFFF}]+')}))"


def count_chars(x: str, cls: str) -> str:
    return f"length({sub(x, f'[^{cls}]+')})"


def count_matches(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


URLS = rf"https?://[^{WS}]+"
TAGS = rf"[#＃][^#＃{WS}]+"


def hexval(digest: str, start: int, digits: int = 1) -> str:
    """Integer value of hex digits of a digest string (1-based start)."""
    parts = [
        f"(instr('{HEX}', substr({digest}, {start + i}, 1)) - 1) * {16 ** (digits - 1 - i)}"
        for i in range(digits)
    ]
    return "(" + " + ".join(parts) + ")"


def gate(source: str, min_length: int = 5) -> str:
    """SELECT adding the language-gate columns to a relation with ``content``."""
    c = "clean"
    return f"""
      SELECT *, (exclude_reason IS NULL) AS is_japanese,
        (coalesce(exclude_reason NOT IN ('too_short', 'not_japanese'), true)
         AND abs(kana_ratio - 0.12) <= 0.04) AS borderline
      FROM (
        SELECT *, CASE WHEN length < {min_length} THEN 'too_short'
          WHEN NOT (kana_ratio >= 0.12 OR cjk_ratio >= 0.35) THEN 'not_japanese'
          WHEN kana_ratio = 0 AND detected = 'cmn' THEN 'franc_non_jp' END AS exclude_reason
        FROM (
          SELECT *, CASE WHEN length > 0 THEN kana / length::DOUBLE ELSE 0 END AS kana_ratio,
            CASE WHEN length > 0 THEN (kana + kanji) / length::DOUBLE ELSE 0 END AS cjk_ratio,
            CASE WHEN length > 0 THEN latin / length::DOUBLE ELSE 0 END AS latin_ratio,
            CASE WHEN length(solid) < 10 THEN 'und'
              WHEN {count_chars('solid', KANA)} > 0 AND
                ({count_chars('solid', KANA)} + {count_chars('solid', KANJI)}) * 2 >= length(solid) THEN 'jpn'
              WHEN {count_chars('solid', KANA)} = 0 AND {count_chars('solid', KANJI)} * 3 >= length(solid) THEN 'cmn'
              ELSE 'oth' END AS detected
          FROM (
            SELECT *, {u16(c)} AS length, {count_chars(c, KANA)} AS kana, {count_chars(c, KANJI)} AS kanji,
              {count_chars(f'lower({c})', 'a-z')} AS latin, {sub('content', f'[{WS}]+')} AS solid
            FROM (SELECT *, {clean('content')} AS clean FROM {source})
          )
        )
      )"""


def spam_flags() -> str:
    """Boolean columns of the four spam rules over ``content`` and ``clean``."""
    return f"""{count_matches('content', URLS)} > 2 AS s_urls, {count_matches('content', TAGS)} > 5 AS s_tags,
        {u16(strip('clean'))} < 4 AS s_short, regexp_matches(content, '{PROMO}') AS s_promo"""


def joined(*parts: tuple[str, str]) -> str:
    """Comma-joined names whose condition holds, in order ('' when none does)."""
    items = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for cond, name in parts)
    return f"concat_ws(',', {items})"


SPAM = joined(
    ("s_urls", "too_many_urls"), ("s_tags", "too_many_hashtags"),
    ("s_short", "too_short_after_clean"), ("s_promo", "promo_boilerplate"),
)
