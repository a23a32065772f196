"""Language ID by rank-order profiles: out-of-place distance of a document's most frequent n-grams."""

from __future__ import annotations

from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postloom.llm.rows import add_python, flat_python

# N-grams of one to three characters inside blank-padded words; a profile ranks this many of them.
PROFILE_SIZE = 300
UNKNOWN = "und"
# A task merges what it has counted once this many keys wait.
MERGE_AT = 4_000_000


@cache
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for start, stop in ((0, 0xD800), (0xE000, 0x110000)):
        table[start:stop] = [chr(c).isalpha() for c in range(start, stop)]
    return table


def ngram_keys(text: str | None) -> np.ndarray:
    """All n-grams of a text as numbers (21 bits a character); empty if it has no letter.

    Letters are lower-cased, everything between words counts as one blank.
    """
    if not text:
        return np.empty(0, np.uint64)
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _letters()[chars]
    kept = word.copy()
    kept[1:] |= word[:-1]
    kept[0] = True
    if not word.any():
        return np.empty(0, np.uint64)
    chars, word = np.where(word, chars, 32)[kept].astype(np.uint64), word[kept]
    pairs = (chars[:-1] << np.uint64(21)) | chars[1:]
    triples = ((pairs[:-1] << np.uint64(21)) | chars[2:])[word[1:-1]]
    return np.concatenate([chars[word], pairs, triples])


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and their counts."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    if weights is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def ranked(keys: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by key."""
    keys, counts = counted(keys)
    return keys[np.argsort(-counts, kind="stable")[:size]]


def learn_profiles(df: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE) -> DataFrame:
    """Rows (lang, rank from 0, ngram as a number): the ``size`` most frequent n-grams of each language.

    Counts cover every row with a language and a letter; rows without either are left out. Tasks
    pre-aggregate, so one language may hold any share of the rows.
    """

    def make():
        kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        waiting: dict[str, int] = defaultdict(int)

        def merge(name: str) -> None:
            parts = kept[name]
            kept[name] = [counted(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))]
            waiting[name] = 0

        def work(texts: list[str | None] | None, langs: list[str | None] | None):
            if texts is None:
                for name in kept:
                    merge(name)
                    keys, counts = kept[name][0]
                    yield [pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))]
                return
            found = defaultdict(list)
            for value, name in zip(texts, langs):
                if name is not None:
                    found[name].append(ngram_keys(value))
            for name, keys in found.items():
                kept[name].append(counted(np.concatenate(keys)))
                waiting[name] += len(kept[name][-1][0])
                if waiting[name] >= MERGE_AT:
                    merge(name)

        return work

    counts = flat_python(df, [text, lang], "lang string, ngram bigint, n bigint", make)
    order = W.partitionBy("lang").orderBy(F.desc("n"), "ngram")
    return (
        counts.groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
        # Compared as it is, the row number lets every task keep its first ``size`` rows before one task orders a language.
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= size)
        .select("lang", (F.col("place") - 1).alias("rank"), "ngram")
    )


class Profiles:
    """Ranks of all languages, with a document's distance to each."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int) -> None:
        self.size = size
        self.langs = sorted({lang for lang, _, _ in rows})
        self.known = np.array(sorted({ngram for _, _, ngram in rows}), np.uint64)
        # One more column for n-grams that no profile has: out of place by the full size.
        self.rank = np.full((len(self.langs), len(self.known) + 1), size, np.int64)
        for lang, rank, ngram in rows:
            self.rank[self.langs.index(lang), np.searchsorted(self.known, np.uint64(ngram))] = rank

    def judge(self, text: str | None) -> tuple[str, float]:
        top = ranked(ngram_keys(text), self.size)
        if not len(top) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.known, top)
        at[at < len(self.known)] = np.where(self.known[at[at < len(self.known)]] == top[at < len(self.known)], at[at < len(self.known)], len(self.known))
        ranks = self.rank[:, at]
        distance = np.where(ranks == self.size, self.size, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
        order = np.argsort(distance, kind="stable")
        best = int(distance[order[0]])
        other = int(distance[order[1]]) if len(order) > 1 else self.size * len(top)
        return self.langs[order[0]], other / (best + other) if best + other else 1.0


def identify(df: DataFrame, profiles: DataFrame, text: str = "text", size: int = PROFILE_SIZE) -> DataFrame:
    """``df`` with ``lang_pred`` and ``lang_score``.

    The language of the smallest distance wins, ties go to the first name. The score is the share of
    the second distance in both: 0.5 for a tie, nearer to 1 the clearer. A text that is null or has no
    letter, or an empty set of profiles, gives ``und`` and 0. Profiles are ``size`` rows a language and
    are collected; columns with the new names are replaced.
    """
    # A row is a rank of a language: bounded by the number of languages, whatever the corpus holds.
    learned = [tuple(r) for r in profiles.select("lang", "rank", "ngram").collect()]

    def make():
        judge = Profiles(learned, size).judge

        def work(texts: list[str | None]) -> list[pa.Array]:
            made = [judge(t) for t in texts]
            return [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]

        return work

    return add_python(df, [text], "lang_pred string, lang_score double", make)
