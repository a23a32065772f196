"""Operators on single texts against plain versions."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from postloom.llm import bpe, language, licenses, quality, secret_scan, toxicity, urls
from tests.llm import cases


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.ByteBpe(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def test_bpe_equals_the_public_library(tokenizer):
    import random

    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokenizer.ids, special_tokens={})
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab cdeéß漢🙂\n\t  0123..--\"'<|endoftext|>thing") for _ in range(rnd.randint(0, 400))) for _ in range(300)]
    texts += ["a" * 20_000, " " * 5_001, "ab" * 9_000, "=+" * 3_000, "é" * 5_000, "\x00\x01" * 40, "<|endoftext|>"]
    for text in texts:
        ids, raw = tokenizer.round_trip(text)
        assert np.frombuffer(ids, np.int32).tolist() == reference.encode_ordinary(text)
        assert raw == text.encode()


def test_bpe_memos_may_overflow(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES_KEPT", 5)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 5)
    text = cases.prose(3, 300)
    ids = np.frombuffer(tokenizer.round_trip(text)[0], np.int32).tolist()
    assert ids == [i for piece in tokenizer.pattern.findall(text) for i in tokenizer.encode_piece(piece.encode())]


def test_bpe_on_awkward_rows(spark):
    docs = cases.docs(spark, extra="token_ids string, decoded int")
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe.encode_decode(docs, path, pattern).select("doc_id", "text", "token_ids", "decoded").collect()
    assert len(rows) == len(cases.ROWS)
    for row in rows:
        assert bytes(row.decoded) == (row.text or "").encode()
        assert (row.token_ids == []) == (not row.text)
    assert bpe.encode_decode(docs.limit(0), path, pattern).count() == 0


def test_matching_statistics_of_the_suffix_automaton():
    import random

    rnd = random.Random(3)
    for _ in range(200):
        known = [[rnd.choice("abc").encode() for _ in range(rnd.randint(1, 12))] for _ in range(rnd.randint(1, 4))]
        automaton, words = licenses.SuffixAutomaton(known), [rnd.choice("abcd").encode() for _ in range(30)]

        def places(run):
            return {(k, i + len(run)) for k, s in enumerate(known) for i in range(len(s) - len(run) + 1) if s[i:i + len(run)] == run}

        longest = [max(n for n in range(e + 1) if not n or places(words[e - n:e])) for e in range(1, 31)]
        wanted = [(e - longest[e - 1], e) for e in range(1, 31) if longest[e - 1] and (e == 30 or longest[e] <= longest[e - 1])]
        found = automaton.runs(words, 1)
        assert [(first, end) for _, first, end in found] == wanted
        for state, first, end in found:
            assert sorted(automaton.ends[state]) == sorted(places(words[first:end]))


def test_licence_phrases_and_spans(spark):
    notice = licenses.TEMPLATES[1][1]
    broken = notice.replace("You may obtain a copy", "Kindly fetch one copy")
    rows = [*cases.ROWS, (20, f"{cases.prose(20, 40)} All rights reserved. CC-BY: cc by all rights RESERVED", "en"), (21, f"{cases.prose(21, 60)}\n{broken}", "en"), (22, "all rights", "en")]
    docs = cases.docs(spark, rows, extra="license_words string, license_spans int")
    found = licenses.scan(docs).select("doc_id", "text", "license_words", "license_places", "license_spans").collect()
    assert len(found) == len(rows)
    for row in found:
        words = cases.alnum_words(row.text)
        wanted = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split())
        assert row.license_words == len(words)
        assert [tuple(p) for p in row.license_places] == wanted
    by_id = {r.doc_id: r for r in found}
    (span,) = [s for s in by_id[21].license_spans if s.covered > 0.75 and s.end_word - s.first_word > 20]
    assert span.label == "apache-2.0" and span.first_word == 60 and 0.8 < span.covered < 1
    assert by_id[22].license_spans == []
    assert licenses.scan(docs.limit(0)).count() == 0


BASE_PATTERNS = {
    "assign": re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def base_secrets(text: str | None) -> list[tuple[str, int, int]]:
    found = []
    for rank, (kind, pattern) in enumerate(BASE_PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            if len(m[1] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                found.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_secrets_against_plain_patterns():
    import random

    rnd, scanner = random.Random(8), secret_scan.SecretScanner()
    parts = ["token", "PassWord", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "abcdef", "x", "AKIA", "ABCDEFGH", "0123456789abcdef", "é", "İ", "ſecret"]
    for text in ["".join(rnd.choice(parts) for _ in range(60)) for _ in range(2_000)] + [r[1] for r in cases.ROWS]:
        assert [s for s in scanner.spans(text) if s[0] in secret_scan.BASE_KINDS] == base_secrets(text)


def test_checksums_decide_and_masks_replace(spark):
    body = "Zx81" * 7 + "Qw"
    good, bad = f"ghp_{body}{secret_scan.checksum_digits(body)}", f"ghp_{body}000000"
    pem = "-----BEGIN PRIVATE KEY-----\n" + "QUJD" * 20 + "\n-----END PRIVATE KEY-----"
    scanner = secret_scan.SecretScanner()
    assert scanner.spans(f"x {good} y") == [("github", 2, 2 + len(good))]
    assert scanner.spans(f"x {bad} y") == []
    assert scanner.spans(pem)[0][0] == "pem"
    rows = [*cases.ROWS, (30, f'a token = "{"0a" * 20}" b', "en")]
    docs = cases.docs(spark, rows, extra="secret_spans string")
    masked = secret_scan.mask_secrets(docs)
    assert masked.columns == docs.columns
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts[30] == 'a [SECRET]" b' and texts[3] is None and texts[13] == "x" * 200_000
    spans = {r.doc_id: r.secret_spans for r in secret_scan.find_secrets(docs).collect()}
    assert [tuple(s) for s in spans[30]] == [("assign", 2, 51), ("hex", 11, 51)] and spans[4] == []
    assert secret_scan.find_secrets(docs.limit(0)).count() == 0


def test_language_profiles_tell_languages_apart(spark):
    rows = [(i, cases.prose(i, 150, cases.ENGLISH), "en") for i in range(40)] + [(100 + i, cases.prose(i + 500, 150, cases.GERMAN), "de") for i in range(30)]
    docs = cases.docs(spark, rows + [(300, None, "en"), (301, "12 34 !", "en"), (302, "", None)], extra="lang_pred int, rank int, ngram int")
    profiles = language.learn_profiles(docs.filter("doc_id % 4 <> 2"))
    assert profiles.groupBy("lang").count().filter(F.col("count") > language.PROFILE_SIZE).count() == 0
    judged = {r.doc_id: r for r in language.identify(docs, profiles).collect()}
    right = sum(judged[i].lang_pred == lang for i, _, lang in rows if i % 4 == 2)
    assert right >= 0.95 * sum(i % 4 == 2 for i, _, _ in rows)
    assert all((judged[i].lang_pred, judged[i].lang_score) == ("und", 0.0) for i in (300, 301, 302))
    empty = language.identify(docs, profiles.limit(0)).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in empty] == ["und"]


def test_ngrams_and_distance_by_hand():
    counts = Counter()
    for word in ("ab", "abc"):
        padded = f" {word} "
        counts.update(c for c in word)
        counts.update(padded[i:i + n] for n in (2, 3) for i in range(len(padded) - n + 1))

    def number(gram: str) -> int:
        value = 0
        for char in gram:
            value = value << 21 | ord(char)
        return value

    keys, n = language.counted(language.ngram_keys("Ab, abc!"))
    assert dict(zip(keys.tolist(), n.tolist())) == {number(g): c for g, c in counts.items()}
    profiles = language.Profiles([("x", 0, number("a")), ("x", 1, number("b")), ("y", 0, number("b")), ("y", 1, number("a"))], 2)
    assert profiles.judge("a a a b") [0] == "x"


def plain_counts(text: str | None) -> tuple:
    words = cases.SOLID.findall(text or "")
    runs, inside = Counter(zip(words, words[1:], words[2:])), set()
    for k in range(len(words) - 2):
        if runs[tuple(words[k:k + 3])] > 1:
            inside |= {k, k + 1, k + 2}
    lines = [line for line in (text or "").split("\n") if cases.SOLID.search(line)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), failed


def test_quality_counts_and_verdicts(spark):
    clean = [(100 + i, cases.prose(100 + i, 150), "en") for i in range(40)]
    junk = [(200 + i, " ".join(f"{w}%%%" for w in cases.prose(200 + i, 150).split()), "en") for i in range(4)]
    odd = [(300, "a b c " * 100, "en"), (301, "one two three\n" * 3 + cases.prose(5, 60) + "\none two three", "en"), (302, "a b a b a b", "en")]
    rows = cases.ROWS + clean + junk + odd
    docs = cases.docs(spark, rows, extra="q_words string, q_text int")
    judged = quality.apply_rules(docs, keep=["doc_id", "text"]).collect()
    assert len(judged) == len(rows)
    for r in judged:
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words, r.q_base_failed) == plain_counts(r.text)
        assert not (r.q_base_failed and r.q_kept)
    kept = {r.doc_id for r in judged if r.q_kept}
    assert {i for i, _, _ in clean} <= kept and not kept & {i for i, _, _ in junk} and 300 not in kept
    alone = quality.apply_rules(docs.filter("doc_id = 1"), keep=["doc_id"]).first()
    assert alone.q_kept and alone.q_char_distance is None
    assert quality.apply_rules(docs.limit(0), keep=["doc_id"]).count() == 0


def test_quality_keeps_clean_texts_of_rare_languages(spark):
    clean = [(100 + i, cases.prose(100 + i, 150), "en") for i in range(40)]
    rare = [(200 + i, cases.prose(200 + i, 150, cases.GERMAN), "de" if i % 2 else None) for i in range(16)]
    junk = [(300 + i, " ".join(f"{w}%%%" for w in cases.prose(300 + i, 150).split()), "en") for i in range(4)]
    bad = [(400, "a b c " * 100, "de"), (401, "a b c", "de")]
    docs = cases.docs(spark, clean + rare + junk + bad)
    judged = {r.doc_id: r for r in quality.apply_rules(docs, keep=["doc_id"]).collect()}
    assert {i for i, r in judged.items() if r.q_kept} == {i for i, _, _ in clean + rare}
    assert all(judged[i].q_char_distance is None for i, _, _ in rare + bad)


def test_divergence_by_hand(spark):
    def distance(p, q):
        half = [(a + b) / 2 for a, b in zip(p, q)]
        return np.sqrt(sum(sum(x * np.log2(x / m) for x, m in zip(side, half) if x) for side in (p, q)) / 2)

    shares = [0.0] * quality.WORD_BINS
    shares[3], shares[9], shares[20] = 0.2, 0.1, 0.05
    reference = quality.Reference("x", [0.2, 0.6, 0.05, 0.05, 0.05, 0.0, 0.05], [*shares, 0.65])
    row = spark.sql("select array(10L, 50L, 5L, 0L, 2L, 3L, 0L) c, array(struct(3 bin, 4L n), struct(7 bin, 2L n)) w, 20L n")
    got = row.select(quality.char_distance(F.col("c"), reference).alias("c"), quality.word_distance(F.col("w"), F.col("n"), reference).alias("w")).first()
    assert got.c == pytest.approx(distance([x / 70 for x in (10, 50, 5, 0, 2, 3, 0)], reference.chars))
    mine = [0.0] * quality.WORD_BINS
    mine[3], mine[7] = 0.2, 0.1
    assert got.w == pytest.approx(distance([*mine, 0.7], reference.words))


def test_quality_has_no_python_in_its_plan(spark):
    plan = quality.measure(cases.docs(spark).select("doc_id", "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


INSULTS = ("grotnak", "blimfus", "wazzock")


def test_toxicity_learns_and_reads_disguises(spark):
    def insult(seed: int) -> str:
        words = cases.prose(seed, 80).split()
        for k, word in enumerate(INSULTS):
            words.insert(10 * k + seed % 7, word)
        return " ".join(words)

    rows = [(i, cases.prose(i, 80), "en") for i in range(200)] + [(1000 + i, insult(i), "en") for i in range(60)]
    marks = [(i, int(i >= 1000)) for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    more = [(2000, "You gr0tnak and bl1mfus", "en"), (2001, "you w a z z o c k, you blimfuuuuus", "en"), (2002, None, "en"), (2003, "", "en"), (2004, cases.prose(9_999, 20_000), "en")]
    docs = cases.docs(spark, rows + more + rows[:1], extra="label int, body string, toxic_score int")
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int").withColumn("text", F.lit("x"))
    model = toxicity.learn(docs, labels)
    assert set(model.log_odds) == set(INSULTS)
    scored = {r.doc_id: r.toxic_score for r in toxicity.score(docs, model).collect()}
    assert all((scored[i] >= toxicity.PREDICT_AT) == (i >= 1000) for i, _, _ in rows)
    assert scored[2000] >= 0.7 and scored[2001] >= 0.7 and scored[2002] == scored[2003] < 0.7 and scored[2004] < 0.7
    restored = {r.doc_id: r.restored for r in toxicity.restore_texts(docs, model).collect()}
    assert restored[2000] == "you grotnak and blimfus"
    blank = toxicity.learn(docs, labels.limit(0))
    assert toxicity.score(docs, blank).select("toxic_score").distinct().count() == 1
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_moves_texts_once(spark, monkeypatch):
    texts = [cases.prose(i, 40) for i in range(30)]
    # Rows and ids that come twice, an id with two texts, copies under other ids, null and empty texts.
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(0, texts[0], "en"), (1, "another text of one", "en"), (100, texts[2], "en"), (101, None, "en"), (102, None, "en"), (103, "", "en"), (None, "no id", "en")]
    labels = spark.createDataFrame([(i, 0) for i in range(30)] + [(100, 0), (101, 1), (102, 1), (103, 1), (3, 1), (104, 1), (None, 1), (4, None)], "doc_id bigint, toxic int")
    written, plans = {}, {}

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        table = stored(df, name)
        written[name] = [tuple(r) for r in table.collect()]
        return table

    stored = toxicity.stored
    monkeypatch.setattr(toxicity, "stored", watched)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        toxicity.learn(cases.docs(spark, rows), labels)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    bodies = [(b or "", label) for b, label in written["toxic-rows"]]
    assert sorted(bodies) == sorted([(t, int(i == 3)) for i, t in enumerate(texts)] + [("another text of one", 0), ("", 1)])
    assert len(re.findall(r"(?<!Broadcast)Exchange", plans["toxic-rows"])) == 1


def test_toxicity_learns_from_every_labelled_row(spark):
    n = 24_000
    text = F.concat(F.lit("quo "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.when(F.col("id") % 3 == 0, " wazzock").otherwise(" tulip"))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    model = toxicity.learn(docs, labels)
    assert (model.char_counts["^^q"], model.char_counts["ock"], model.char_counts["tul"]) == (n, n / 3, n * 2 / 3)
    odds = math.log((n / 3 + 0.5) / 0.5 / (0.5 / (n * 2 / 3 + 0.5)))
    assert model.log_odds == pytest.approx({"wazzock": odds})


def test_toxicity_counts_copies_and_near_copies_as_rows(spark):
    def several(first: int, number: int, label: int, *words: str):
        """Rows of one text each, and 60 words that the first toxic ones share."""
        return [(first + i, " ".join(("quo", chr(97 + i % 26) + 2 * chr(97 + i // 26) + "q", *words)), label) for i in range(number)]

    shared = cases.prose(1, 60).lower()
    near = [(1000 + i, f"{shared} grotnak {chr(97 + i) * 2}x", 1) for i in range(20)]
    same = [(2000 + i, "you grotnak", 1) for i in range(15)] + [(3000 + i, "a tulip", 0) for i in range(25)]
    rows = several(0, 60, 1, "grotnak") + several(100, 200, 0, "tulip") + near + same + same[:1] + same[-1:] + [(4000, None, 0), (4001, "", 0), (4002, "you grotnak", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, label) for i, _, label in dict.fromkeys(rows)], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels)
    grams = Counter(g for _, text, _ in rows for w in toxicity.WORDS.findall(text or "") if not toxicity.REPEATED.search(w) for g in toxicity.CharModel.grams(w))
    assert model.char_counts == grams and (grams["tna"], grams["tul"]) == (60 + 20 + 15 + 1 + 1, 200 + 25 + 1)
    # Every row with the word counts in its odds; words of the text that twenty near copies share are not listed.
    toxic, clean, t, c = 60 + 20 + 15 + 1, 200 + 25 + 1 + 2 + 1, 60 + 20 + 15 + 1, 1
    assert model.log_odds == pytest.approx({"grotnak": math.log(((t + 0.5) / (toxic - t + 0.5)) / ((c + 0.5) / (clean - c + 0.5)))})
    # The layer is fitted to as many rows: its chances add up to the toxic ones.
    restorer = toxicity.Restorer(toxicity.CharModel(model.char_counts))
    assert sum(model.score(model.evidence(restorer.restore(text))) for _, text, _ in rows) == pytest.approx(toxic, rel=1e-3)


def test_viterbi_finds_the_best_path():
    model = toxicity.CharModel(Counter(g for w in ("idiot", "stone", "tulip") for g in toxicity.CharModel.grams(w)))
    written, best = "1d10t", []

    def walk(k: int, word: str, score: float) -> None:
        if k == len(written):
            best.append((score + model.log10(("^^" + word)[-2:], "$"), word))
            return
        char = written[k]
        for letter in toxicity.LOOKALIKES.get(char, ""):
            walk(k + 1, word + letter, score + toxicity.COST_LOOKALIKE + model.log10(("^^" + word)[-2:], letter))
        if char.isalpha():
            walk(k + 1, word + char, score + model.log10(("^^" + word)[-2:], char))
        else:
            walk(k + 1, word, score + toxicity.COST_DROPPED)

    walk(0, "", 0.0)
    assert toxicity.Restorer(model).decode(written) == max(best)[1] == "idiot"


def test_disguises_of_every_kind_are_decoded():
    words = Counter(g for w in 50 * ("idiot", "clown", "ass", "you", "are", "stone", "tulip") for g in toxicity.CharModel.grams(w))
    restorer = toxicity.Restorer(toxicity.CharModel(words))
    for written in ("!diot", "|diot", "i d 1 o t", "i.d.i.0.t", "i   d   i   o   t", "i/d/i/o/t", "iiddiioott", "1d10t", "id!ot!"):
        assert "idiot" in toxicity.WORDS.findall(restorer.restore(f"so {written}, yes")), written
    for written, word in (("(lown", "clown"), ("a s s", "ass"), ("(ass", "ass"), ("@ss", "ass"), ("aassss", "ass")):
        assert word in toxicity.WORDS.findall(restorer.restore(f"so {written} yes")), written
    assert restorer.restore("y o u i d i o t") == "you idiot"
    for plain in ("1 2 3 4", "so, yes!", "100 200", "coffee success", "1" * 50_000, "so!! $$$ (2) yes$$$!"):
        assert restorer.restore(plain) == plain


RULES = (urls.Rule("allow", "org", "/"), urls.Rule("block", "bad.org", "/x"), urls.Rule("block", "com", "/de/"), urls.Rule("allow", "com", "/fr/"))


def test_urls_by_rule_and_model(spark):
    many = [(i, f"https://a{i}.com/{'de' if i % 2 else 'fr'}/{i}?p={i}") for i in range(60)]
    odd = [
        (100, "HTTP://Sub.BAD.org/x/y?z#f"), (101, "http://bad.org/y"), (102, "no scheme"), (103, None), (104, ""), (105, "x://notorg/"),
        (106, "http://com?/de/"), (107, "a://b.com/de/://c.org/"), (108, "http://org"), (109, "http://x.net/de/" + "q" * 100_000), (109, "http://x.net/de/" + "q" * 100_000),
    ]
    pages = spark.createDataFrame(many + odd, "page_id bigint, url string").withColumn("html", F.lit("h")).withColumn("host", F.lit("h")).withColumn("label", F.lit(3))
    found = urls.judge(pages, RULES)
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}
    assert found.count() == len(many) + len(odd)
    assert rows[100] == ("sub.bad.org", "/x/y", "bad.org/x", "block") and rows[101] == ("bad.org", "/y", "org/", "allow")
    assert rows[102][:3] == rows[103][:3] == rows[104][:3] == ("", "", None)
    assert rows[105][:3] == ("notorg", "/", None) and rows[106][:3] == ("com", "", None) and rows[108][:3] == ("org", "", None)
    assert rows[107] == ("b.com", "/de/://c.org/", "com/de/", "block")
    assert all(rows[i][2:] == (("com/de/", "block") if i % 2 else ("com/fr/", "allow")) for i, _ in many)
    assert {r[3] for r in rows.values()} <= {"allow", "block"}
    none = urls.judge(pages, ()).select("verdict").distinct().collect()
    assert [r.verdict for r in none] == ["allow"]
    only = {r.verdict for r in urls.judge(pages, RULES[2:3]).collect()}
    assert only == {"block"}
    assert urls.judge(pages.limit(0), RULES).count() == 0


def test_long_hostile_texts_take_linear_time():
    import random
    import time

    secrets, notices = secret_scan.SecretScanner(), licenses.LicenseScanner()
    for text in ("eyJ" * 350_000, "eyJa." * 200_000, "token " * 170_000, "-----BEGIN A " * 80_000, "EYJ" * 350_000):
        start = time.process_time()
        secrets.spans(text)
        assert time.process_time() - start < 10, text[:20]
    words = licenses.words_of("all rights reserved foo " * 40_000)
    start = time.process_time()
    assert len(notices.phrases(words)) == 40_000
    notices.spans(words)
    assert time.process_time() - start < 20

    # Skipped places are those that could not match.
    rnd = random.Random(11)
    header = "eyJhbGciOiJIUzI1NiJ9"
    for _ in range(400):
        text = "".join(rnd.choice(["eyJ", header, ".", "a", " ", "EYJ", f"{header}.{header}.x"]) for _ in range(rnd.randint(0, 12)))
        want, free = [], 0
        for at in range(len(text)):
            match = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+").match(text, at)
            if at >= free and match:
                free = match.end()
                want += [("jwt", at, free)] * secret_scan.VALID["jwt"](match)
        assert [s for s in secrets.spans(text) if s[0] == "jwt"] == want
    # Chains that overlap: the best ones stay, as comparing all with all finds them.
    for _ in range(60):
        runs = sorted((rnd.randrange(60), rnd.randrange(40), rnd.randint(6, 14)) for _ in range(rnd.randint(1, 14)))
        kept = notices._chains(0, runs)
        assert all(a[2] <= b[1] or b[2] <= a[1] for k, a in enumerate(kept) for b in kept[k + 1 :])
