from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from postloom.functions import gates as G
from postloom.functions import text as T

IDEOGRAPHIC = chr(0x3000)


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "content string").select(column(F.col("content"))).first()[0]


def test_classifier_normal_form(spark):
    cases = [
        ("https://example.com/path こんにちは", "こんにちは"),
        ("見て https://t.co/x すごい https://a.b/c ね", "見て すごい ね"),
        ("nostr:npub1abc 好き", "好き"),
        ("メンション npub1QWErty123 へ", "メンション へ"),
        (f"ねこ  と{IDEOGRAPHIC}いぬ", "ねこ と いぬ"),
        ("  leading and trailing  ", "leading and trailing"),
        ("プレーンテキスト", "プレーンテキスト"),
        ("", ""),
        (f"https://a.b/c{IDEOGRAPHIC}あ", "あ"),
        ("あnostr:note1x い", "あ い"),
        ("xnostr:note1x", "xnostr:note1x"),
        ("_npub1abc", "_npub1abc"),
    ]
    rows = spark.createDataFrame(cases, "content string, expected string")
    wrong = rows.filter(T.normalize_for_classifier(F.col("content")) != F.col("expected"))
    assert wrong.collect() == []


def test_hash_ignores_links_case_and_spaces(spark):
    def h(text):
        return one(spark, text, T.content_hash)

    assert h("おなかすいた https://example.com/x") == h("おなかすいた https://example.com/different-url")
    assert h("Hello World") == h("hello   world")
    assert h("Hello World") == hashlib.sha256(b"hello world").hexdigest()
    assert one(spark, "  Foo   BAR  ", T.normalize_content) == "foo bar"
    assert h("😀 !!") == hashlib.sha256(b"").hexdigest()


def test_ratios_and_lengths(spark):
    rows = spark.createDataFrame([("あいうカキ漢字abc",), ("",), ("😀あ",)], "content string")
    got = [tuple(r) for r in G.with_char_ratios(rows).select("length", "kana_ratio", "cjk_ratio", "latin_ratio").collect()]
    assert got == [(10, 0.5, 0.7, 0.3), (0, 0.0, 0.0, 0.0), (3, 1 / 3, 1 / 3, 0.0)]


def test_language_gate(spark):
    cases = [
        ("おなかすいた、ごはん食べたい", None),
        ("hello world this is plain english text", "not_japanese"),
        ("あ", "too_short"),
        ("我们今天去公园散步看风景非常开心", "franc_non_jp"),
        ("ねむいなあ", None),
    ]
    rows = spark.createDataFrame([(c,) for c, _ in cases], "content string")
    assert [r[0] for r in G.with_language_gate(rows).select("exclude_reason").collect()] == [e for _, e in cases]
    # A replaced detector decides kana-free text.
    never = G.with_language_gate(rows, detector=lambda c: F.lit("und")).select("exclude_reason").collect()
    assert never[3][0] is None


def test_spam_reasons(spark):
    cases = [
        ("https://a.b https://a.b https://a.b ふつうの文", ["too_many_urls"]),
        ("https://a.b https://a.b ふつうの文", []),
        ("#a #b #c #d #e ＃f ふつう", ["too_many_hashtags"]),
        ("abc", ["too_short_after_clean"]),
        ("この商品は【PR】です", ["promo_boilerplate"]),
        ("APRIL showers", []),
        ("これはpr です", ["promo_boilerplate"]),
        ("今すぐ登録してね", ["promo_boilerplate"]),
        ("https://a.b https://a.b https://a.b", ["too_many_urls", "too_short_after_clean"]),
    ]
    rows = spark.createDataFrame([(c,) for c, _ in cases], "content string")
    assert [r[0] for r in G.with_spam_reasons(rows).select("spam_reasons").collect()] == [e for _, e in cases]


def test_keys_and_labels(spark):
    key = "AB" * 32
    assert one(spark, f"\t{key}\n", T.hex_key) == key.lower()
    assert one(spark, key[:-1], T.hex_key) is None
    assert one(spark, " Ｈ ", T.normalize_label) == "H"
    assert one(spark, None, T.normalize_label) == ""


def test_char_classes_are_complements():
    import re

    for ranges in (T.SPACE_RANGES, T.KANA_RANGES, T.KEPT_RANGES):
        def to_python(body):
            return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\U%08X" % int(m[1], 16), body)

        inside = re.compile(f"[{to_python(T.char_class(ranges))}]")
        outside = re.compile(f"[{to_python(T.other_chars(ranges))}]")
        edges = {p for lo, hi in ranges for p in (lo - 1, lo, hi, hi + 1)} | {0, 0x1F600, 0x10FFFF}
        for point in edges:
            assert bool(inside.match(chr(point))) != bool(outside.match(chr(point))), hex(point)


def test_gate_verdict_asks_no_more_than_it_needs(spark):
    from postloom.functions import gates as G

    texts = [None, "", "abc", "plain words of no script here", "かな", "かなだけのとても長い文章です", "漢字文章漢字文章漢字文章", "漢字 with many latin letters behind it", "え among many latin letters, long enough",
             "かなかな mixed with some latin", "https://ex.example/かなかなかな 漢字漢字漢字漢字漢字", "nostr:かなかな", "漢字漢字漢字漢字漢字え", "  　 ", "𠮷𠮷𠮷𠮷𠮷漢字漢字"]
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id int, content string, length string")

    def unknown(c):
        return F.when(c.contains("字"), F.lit(None).cast("string")).otherwise(F.lit("cmn"))

    for options in ({}, {"min_length": 0, "kana_min": 0.0, "cjk_min": 0.0}, {"kana_min": 0.9, "cjk_min": 0.5}, {"detector": unknown}):
        want = {r.id: r.is_japanese for r in G.with_language_gate(rows.drop("length"), **options).collect()}
        found = G.with_gate_verdict(rows, **options)
        assert found.columns == [*rows.columns, "is_japanese"]
        assert {r.id: r.is_japanese for r in found.collect()} == want
        assert {r.length for r in found.collect()} == {"kept"}

    def asked(c):
        return F.when(c.rlike("[ぁ-ん]") | (F.length(c) < 5), F.raise_error(F.lit("asked")).cast("string")).otherwise(G.script_detector(c))

    rows = rows.filter("content IS NOT NULL AND content NOT LIKE '%://%' AND content NOT LIKE 'nostr%'")
    assert {r.id for r in G.with_gate_verdict(rows, detector=asked).filter("is_japanese").collect()} == {r.id for r in G.with_language_gate(rows).filter("is_japanese").collect()}


def test_staged_clean_text_equals_the_plain_one(spark):
    parts = ["nostr:", "NOSTR:", "NoStr:x1 ", "npub1", "NPUB1ab", "nPuB1zz9", "https://a.example/nostr:x ", "http://", " ", "_", "かな", ":", "b1", "R:", "x"]
    texts = [None, ""] + [a + b + c for a in parts for b in parts for c in parts]
    rows = spark.createDataFrame([(t,) for t in texts], "content string")
    found = T.with_clean_text(rows, "clean").withColumn("plain", T.clean_text(F.col("content")))
    assert found.filter("clean IS NULL OR clean <> plain").count() == 0
    assert found.filter("clean <> content").count() > 1000
