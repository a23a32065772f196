"""Benchmark decontamination by winnowing.

Runs of ``GRAM`` words are hashed, and from every ``WINDOW`` words in a row the smallest hash is kept.
Two equal windows keep the same hash, so a document without a kept hash of the benchmark shares
no window with it. Documents with one are compared word by word: around every run of words that both
share, the windows that contain it are looked up among those of the benchmark, and the words of
equal windows are hit.

Everything here is DataFrame expressions. The fingerprints of all documents are only passed through
a semi-join; what is stored are the counts of words and the keys of documents that pass it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.rows import small_side
from postloom.session import materialize

# Words of a window, and of the runs hashed: a window holds WINDOW - GRAM + 1 runs.
WINDOW = 10
GRAM = 5

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows with new columns that are computed once: a generator keeps Catalyst from repeating them in later uses."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z only; null has none."""
    whole = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(whole) == F.length(whole)
    return F.array_remove(F.split(F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, _UPPER, _LOWER)), _SPLIT), "")


def _each(start: int, stop: Column, make) -> Column:
    """``make(i)`` for i from ``start`` to ``stop``, none if stop is smaller."""
    return F.when(stop >= start, F.transform(F.sequence(F.lit(start), stop), make))


def _grams(words: Column, length: int) -> Column:
    """Hash of every run of ``length`` words; null if there are fewer words."""
    return _each(0, F.size(words) - length, lambda i: F.xxhash64(F.lit(length), *(F.get(words, i + k) for k in range(length))))


def _winnowed(grams: Column) -> Column:
    """The smallest hash of every window, each value once; null if there is no whole window."""
    span = WINDOW - GRAM + 1
    return F.array_distinct(_each(0, F.size(grams) - span, lambda i: F.least(*(F.get(grams, i + k) for k in range(span)))))


def _no_hashes() -> Column:
    return F.array().cast("array<bigint>")


def _whole_runs(words: Column, length: int) -> Column:
    """Hash of every run as long as a short item, marked apart from other hashes; null if there is none."""
    return _each(0, F.size(words) - length, lambda i: F.xxhash64(F.lit(-length), *(F.get(words, i + k) for k in range(length))))


def fingerprints(df: DataFrame, words: str, short: list[int], out: str) -> DataFrame:
    """``df`` with the kept hashes of ``words``: of whole windows, and of all runs of the lengths ``short``.

    Windows shorter than ``WINDOW`` come from short items only; winnowing promises nothing for them.
    """
    df = _stage(df, _grams=_grams(F.col(words), GRAM))
    kept = [_winnowed(F.col("_grams")), *(F.array_distinct(_whole_runs(F.col(words), n)) for n in short)]
    return _stage(df, **{out: F.concat(*(F.coalesce(k, _no_hashes()) for k in kept))}).drop("_grams")


def _windows(words: Column, starts: Column, wide: int) -> Column:
    """Structs of start, width and the words of each window, joined by blanks (which no word has)."""
    return F.transform(starts, lambda at: F.struct(at.alias("at"), F.lit(wide).alias("wide"), F.array_join(F.slice(words, at + 1, F.lit(wide)), " ").alias("window")))


def _met_at(hashes: Column, met: Column) -> Column:
    """Places of hashes that are among ``met``."""
    places = F.transform(F.coalesce(hashes, _no_hashes()), lambda h, i: F.when(F.array_contains(met, h), i))
    return F.filter(places, lambda i: i.isNotNull())


def benchmark_windows(benchmark: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """Distinct windows with the sorted ids of their items, distinct fingerprints, and the lengths of short items."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), words_of(F.col(item_text)).alias("words"))
    items = materialize(items.filter(F.size("words") > 0), "benchmark-words")
    short = [r[0] for r in items.filter(F.size("words") < WINDOW).select(F.size("words")).distinct().collect()]
    words, size = F.col("words"), F.size("words")
    windows = items.select("item", F.explode(F.coalesce(
        *(F.when(size == n, _windows(words, F.array(F.lit(0)), n)) for n in short),
        F.when(size >= WINDOW, _windows(words, F.sequence(F.lit(0), size - WINDOW), WINDOW)),
    ))).select("item", "col.window")
    windows = windows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    prints = fingerprints(items, "words", [], "prints").select(F.explode("prints").alias("print"))
    for n in short:
        prints = prints.unionAll(items.filter(size == n).select(F.explode(_whole_runs(words, n)).alias("print")))
    return materialize(windows, "benchmark-windows"), materialize(prints.distinct(), "benchmark-prints"), sorted(short)


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``row_key``, ``n_words``, ``n_hit``, ``windows`` (sorted array of structs ``at``, ``wide``:
    the hit windows) and ``items`` (sorted array of the ids, as text, of items with a hit window).

    A window is ``WINDOW`` consecutive words of an item, or all of them if it has fewer; items without
    words have none. A null text has no words; where nothing is hit the arrays are empty. ``row_key`` is a
    64-bit hash of id and text: rows that repeat both are judged alike and all returned. A null item id
    counts as the text ``null``, items of one id as one. Other columns of both tables are not read.
    """
    item_windows, item_prints, short = benchmark_windows(benchmark, item_id, item_text)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("body"))
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "body"))
    printed = fingerprints(_stage(rows, words=words_of(F.col("body"))), "words", short, "prints")
    # A few bytes a word, written once: read for the semi-join, and again without the hashes for the result.
    printed = materialize(printed.select("doc_id", "row_key", F.size("words").cast("long").alias("n_words"), "prints"), "document-prints")
    shared = printed.select("doc_id", "row_key", F.explode("prints").alias("print")).join(item_prints, "print", "left_semi")
    suspects = materialize(shared.groupBy("doc_id", "row_key").agg(F.collect_set("print").alias("met")), "suspects")

    def same(a: str, b: str) -> Column:
        return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.row_key") == F.col(f"{b}.row_key"))

    met = rows.alias("d").join(suspects.alias("s"), same("d", "s")).select("d.doc_id", "d.row_key", "s.met", words_of(F.col("d.body")).alias("words"))
    words, size = F.col("words"), F.size("words")
    met = _stage(met.dropDuplicates(["doc_id", "row_key"]), runs=_met_at(_grams(words, GRAM), F.col("met")))
    reach = WINDOW - GRAM
    starts = F.flatten(F.transform("runs", lambda i: F.sequence(F.greatest(i - reach, F.lit(0)), i)))
    found = [_windows(words, F.filter(F.array_distinct(starts), lambda at: at + WINDOW <= size), WINDOW)]
    found += [_windows(words, _met_at(_whole_runs(words, n), F.col("met")), n) for n in short]
    places = met.select("doc_id", "row_key", F.explode(F.concat(*found))).select("doc_id", "row_key", "col.*")
    hits = places.join(item_windows, "window").groupBy("doc_id", "row_key").agg(
        F.array_sort(F.collect_set(F.struct("at", "wide"))).alias("windows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def cover(state: Column, w: Column) -> Column:
        end = F.greatest(state["end"], w["at"] + w["wide"])
        return F.struct(end.alias("end"), (state["n"] + end - F.greatest(w["at"], state["end"])).alias("n"))

    hits = hits.withColumn("n_hit", F.aggregate("windows", start, cover, lambda state: state["n"]))
    return printed.alias("p").join(hits.alias("h"), same("p", "h"), "left").select(
        "p.doc_id",
        "p.row_key",
        "p.n_words",
        F.coalesce("h.n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("h.windows", F.array().cast("array<struct<at: int, wide: int>>")).alias("windows"),
        F.coalesce("h.items", F.array().cast("array<string>")).alias("items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows in which a window of the benchmark stands; columns stay as they are."""
    hit = find_overlaps(docs, benchmark, doc_id, text).filter("n_hit > 0").select(F.col("row_key").alias("hit_key")).distinct()
    hit = materialize(hit, "contaminated")
    keyed = docs.withColumn("__row_key", F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    return keyed.join(small_side(hit), F.col("__row_key") == F.col("hit_key"), "left_anti").drop("__row_key")
