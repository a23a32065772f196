"""Quality rules: divergence of a document's histograms from those of its language.

Two histograms are compared with references by Jensen-Shannon distance: classes of characters, and
common (function) words. A document is kept when it is near the reference of at least one
language in both. Short documents, and documents whose own language has no reference, are not judged by
histograms. Beside these stand plain
limits on the number of words and on repeated windows of words.

Everything here is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.session import materialize

#: White space that ends a word, and the symbols that are counted.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages judged; one bin of the word histogram each.
COMMON_WORDS = {
    "en": "the of and to in a is that for was with as are this on be at by it an he his from or had not but they which you were their one all we can her has there been if more when will would who so no",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux mais comme ou si leur y dont elle deux ces cette être nous ont fait sa",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué",
}

#: Classes of characters, beside blanks, a-z and all that is not listed.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = "0123456789"
_STOPS = ".,;:?'\"()-"
_OTHER_ASCII = "!" + SYMBOLS + "+/=@[\\]^_`{}~"


# Common words fall into this many bins by hash; words that share a bin are judged together. One more bin holds all others.
WORD_BINS = 1021


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules.

    A distance may exceed its limit by ``slack / sqrt(events)``, since a histogram of few events is far from
    any reference by chance. A text with fewer than ``min_judged`` words is not judged by its histograms.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    max_char_distance: float = 0.20
    max_word_distance: float = 0.25
    char_slack: float = 1.0
    word_slack: float = 1.2
    min_judged: int = 50
    min_reference_docs: int = 20


@dataclass(frozen=True)
class Reference:
    """Shares of a language: one per class of characters, one per bin of words."""

    lang: str
    chars: list[float]
    words: list[float]


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _stage(df: DataFrame, *columns: Column) -> DataFrame:
    """Rows with new columns that are computed once: a generator keeps Catalyst from repeating them in later uses."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def measure(df: DataFrame, text: str = "text", prefix: str = "q_") -> DataFrame:
    """``df`` with counts of each text, in columns that start with ``prefix``.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` (words inside
    windows of three words that stand twice or more in the text), ``char_classes`` (array of counts)
    and ``common`` (array of structs ``bin``, ``n`` of the common words that occur). A null text counts as
    empty. Repeated windows are told apart by 64-bit hashes.
    """
    p = prefix
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if not c.startswith(p)))
    df = _stage(df, whole.alias(f"{p}text"))
    body = F.col(f"{p}text")
    # Characters are counted on what is left once the most frequent classes are gone.
    df = _stage(df, F.array_remove(F.split(body, f"[{BLANKS}]+"), "").alias(f"{p}words"), F.regexp_replace(body, "[a-z]+", "").alias(f"{p}rest"))
    df = _stage(df, F.translate(f"{p}rest", BLANKS, "").alias(f"{p}marks"))
    words, rest, marks = F.col(f"{p}words"), F.col(f"{p}rest"), F.col(f"{p}marks")
    size = F.size(words)
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(f"[^{BLANKS}]"))
    windows = F.when(size >= 3, F.transform(F.sequence(F.lit(1), size - 2), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))).otherwise(F.array().cast("array<bigint>"))
    names = list(dict.fromkeys(f(w) for ws in COMMON_WORDS.values() for w in ws.split() for f in (str, str.capitalize, str.upper)))
    hits = F.transform(F.filter(words, lambda w: w.isin(*names)), lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(WORD_BINS)).cast("int"))
    df = _stage(
        df,
        windows.alias(f"{p}windows"),
        lines.alias(f"{p}lines"),
        F.sort_array(hits).alias(f"{p}hits"),
    )
    windows, lines, hits = F.col(f"{p}windows"), F.col(f"{p}lines"), F.col(f"{p}hits")
    # Only texts with a window that comes back need the places of their windows sorted.
    places = F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h: bigint, i: int>>"))
    df = _stage(df, places.alias(f"{p}places"))
    places = F.col(f"{p}places")

    def comes_back(x: Column, k: Column) -> Column:
        return (F.get(places, k - 1)["h"] == x["h"]) | (F.get(places, k + 1)["h"] == x["h"])

    again = F.sort_array(F.transform(F.filter(places, lambda x, k: F.coalesce(comes_back(x, k), F.lit(False))), lambda x: x["i"]))
    # Ends of the runs of equal words in the sorted hits.
    ends = F.filter(
        F.transform(hits, lambda b, i: F.struct(b.alias("bin"), (i + 1).alias("end"))),
        lambda x: F.coalesce(F.get(hits, x["end"]) != x["bin"], F.lit(True)),
    )
    df = _stage(df, again.alias(f"{p}again"), ends.alias(f"{p}ends"))
    again, ends = F.col(f"{p}again"), F.col(f"{p}ends")
    repeat_words = F.aggregate(
        F.transform(again, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(again, k + 1) - at, F.lit(3)))),
        F.lit(0),
        lambda total, n: total + n,
    )
    listed = [F.length(rest) - F.length(marks), F.length(body) - F.length(rest), *(_count(marks, c) for c in (_UPPER, _DIGITS, _STOPS, _OTHER_ASCII))]
    df = _stage(df, F.array(*listed).cast("array<bigint>").alias(f"{p}listed"))
    listed = F.col(f"{p}listed")
    others = F.length(body) - F.aggregate(listed, F.lit(0).cast("bigint"), lambda total, n: total + n)
    out = df.select(
        *(F.col(f"`{c}`") for c in df.columns if not c.startswith(p)),
        size.cast("long").alias(f"{p}n_words"),
        (F.length(body) - F.get(listed, F.lit(0))).alias(f"{p}word_chars"),
        _count(marks, SYMBOLS).cast("long").alias(f"{p}n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(f"{p}n_dup_lines"),
        repeat_words.cast("long").alias(f"{p}n_repeat_words"),
        F.concat(listed, F.array(others)).alias(f"{p}char_classes"),
        F.transform(
            ends, lambda x, k: F.struct(x["bin"].alias("bin"), (x["end"] - F.coalesce(F.get(ends, k - 1)["end"], F.lit(0))).cast("bigint").alias("n"))
        ).alias(f"{p}common"),
    )
    return out


def learn_references(measured: DataFrame, lang: str = "lang", prefix: str = "q_", limits: Limits = Limits()) -> list[Reference]:
    """Histograms of all rows of each language, one row per language and bin at most.

    Languages with fewer than ``min_reference_docs`` rows, and a null language, give no reference. What
    is collected is bounded by the number of languages times ``WORD_BINS``, whatever the rows.
    """
    p = prefix
    rows = measured.filter(F.col(lang).isNotNull())
    classes = [F.sum(F.get(f"{p}char_classes", F.lit(i))).alias(f"c{i}") for i in range(7)]
    totals = rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("docs"), F.sum(f"{p}n_words").alias("n_words"), *classes).collect()
    counts: dict[str, dict[int, int]] = {}
    common = rows.select(F.col(lang).alias("lang"), F.inline(f"{p}common")).groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    for row in common.collect():
        counts.setdefault(row.lang, {})[row.bin] = row.n
    found = []
    for row in sorted(totals, key=lambda r: r.lang):
        letters = [row[f"c{i}"] or 0 for i in range(7)]
        if row.docs < limits.min_reference_docs or not sum(letters) or not row.n_words:
            continue
        bins = counts.get(row.lang, {})
        words = [bins.get(b, 0) / row.n_words for b in range(WORD_BINS)]
        found.append(Reference(row.lang, [n / sum(letters) for n in letters], [*words, 1 - sum(words)]))
    return found


def _part(p: Column, q: Column) -> Column:
    """What one bin adds to twice the Jensen-Shannon divergence."""
    half = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / half)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(q / half)).otherwise(F.lit(0.0))


def _distance(twice: Column) -> Column:
    return F.sqrt(F.greatest(twice / 2, F.lit(0.0)))


def char_distance(counts: Column, reference: Reference) -> Column:
    total = F.greatest(F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, n: a + n), F.lit(1))
    parts = [_part(F.get(counts, F.lit(i)) / total, F.lit(q)) for i, q in enumerate(reference.chars)]
    return _distance(sum(parts[1:], parts[0]))


def word_distance(common: Column, n_words: Column, reference: Reference) -> Column:
    """Bins that the text lacks add their whole share of the reference."""
    shares = F.split(F.lit(",".join(map(repr, reference.words[:-1]))), ",").cast("array<double>")
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("seen"), F.lit(0.0).alias("mine"))

    def add(state: Column, x: Column) -> Column:
        p, q = x["n"] / F.greatest(n_words, F.lit(1)), F.get(shares, x["bin"])
        return F.struct((state["sum"] + _part(p, q)).alias("sum"), (state["seen"] + q).alias("seen"), (state["mine"] + p).alias("mine"))

    other = F.lit(max(0.0, reference.words[-1]))

    def finish(state: Column) -> Column:
        return state["sum"] + (1 - other - state["seen"]) + _part(F.greatest(1 - state["mine"], F.lit(0.0)), other)

    return _distance(F.aggregate(common, start, add, finish))


def judge(measured: DataFrame, references: list[Reference], lang: str = "lang", prefix: str = "q_", limits: Limits = Limits()) -> DataFrame:
    """``measured`` with ``q_base_failed``, ``q_char_distance``, ``q_word_distance`` and ``q_kept``.

    The distances are those to the language that exceeds its limits least. They are null, and such a text is kept
    unless the plain limits fail it, where it has fewer than ``min_judged`` words or its own language has no
    reference: clean texts of a rare or unknown language cannot meet those of others.
    """
    p = prefix
    n_words, chars = F.col(f"{p}n_words"), F.col(f"{p}char_classes")
    failed = (n_words < limits.min_words) | (100 * F.col(f"{p}n_repeat_words") > limits.max_repeat_percent * n_words)
    judged = (n_words >= limits.min_judged) & F.col(lang).isin([r.lang for r in references])
    events = F.greatest(F.aggregate(chars, F.lit(0).cast("bigint"), lambda a, n: a + n), F.lit(1))
    char_limit = limits.max_char_distance + limits.char_slack / F.sqrt(events)
    word_limit = limits.max_word_distance + limits.word_slack / F.sqrt(F.greatest(n_words, F.lit(1)))
    each = F.array(
        *(
            F.struct(F.lit(k).alias("k"), char_distance(chars, r).alias("char"), word_distance(F.col(f"{p}common"), n_words, r).alias("word"))
            for k, r in enumerate(references)
        )
    )
    df = _stage(measured, (F.when(judged, each) if references else F.lit(None).cast("array<struct<k: int, char: double, word: double>>")).alias(f"{p}each"))
    excess = F.array_min(F.transform(F.col(f"{p}each"), lambda x: F.struct(F.greatest(x["char"] / char_limit, x["word"] / word_limit).alias("over"), x["char"], x["word"])))
    df = _stage(df, excess.alias(f"{p}best"))
    best = F.col(f"{p}best")
    return df.withColumns(
        {
            f"{p}base_failed": failed,
            f"{p}char_distance": best["char"],
            f"{p}word_distance": best["word"],
            f"{p}kept": ~failed & F.coalesce(best["over"] <= 1, F.lit(True)),
        }
    ).drop(f"{p}each", f"{p}best")


def apply_rules(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", prefix: str = "q_", limits: Limits = Limits()) -> DataFrame:
    """Measures and verdict of every row, beside the columns ``keep``.

    The measures, a few hundred bytes a row, are written once to the shared scratch folder; references are
    learned from them and all rows judged by them. Repeated rows are judged alike and all returned; an empty
    table gives no rows. Columns of ``docs`` whose names start with ``prefix`` are left out.
    """
    wanted = [*keep, *(c for c in (text, lang) if c not in keep)]
    measured = measure(docs.select(*(F.col(f"`{c}`") for c in wanted)), text, prefix)
    dropped = [c for c in (text,) if c not in keep]
    measured = materialize(measured.drop(*dropped), "quality")
    judged = judge(measured, learn_references(measured, lang, prefix, limits), lang, prefix, limits)
    return judged.drop(lang) if lang not in keep else judged
