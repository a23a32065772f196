"""Toxicity of texts whose words may be disguised.

A noisy channel stands between a word and what is written: letters become look-alike digits or
symbols, are repeated, or are set apart by blanks and marks. Suspicious stretches are decoded by the
Viterbi algorithm over the lattice of letters each character may stand for, under a character
trigram model, and the restored text is scored by a log-linear model of its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.rows import add_python, discard, flat_python, small_side, stored

# Words or trigrams that a task counts before it hands them on.
WORDS_HELD = 200_000
# A word enters the model when it stands in this many toxic rows, in this share of them, and in so
# many standard deviations more of them than chance would give.
MIN_TOXIC_ROWS = 5
MIN_TOXIC_SHARE = 0.005
MIN_Z = 5.0
PREDICT_AT = 0.7
# Rows that speak for their equals which are sent to every task, about 100 bytes each; more are joined by shuffling.
SPEAKERS_SENT = 250_000
# Decoded stretches a worker remembers; a full memo is emptied, results do not change.
DECODED_KEPT = 100_000

#: Letters that a character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Log10 costs of the channel: a letter for its look-alike, a look-alike or mark left out, a repeated letter left out.
COST_LOOKALIKE, COST_DROPPED, COST_REPEATED = -0.5, -4.0, -0.4
#: Cost of a word that ends between letters set apart.
COST_BORDER = -0.7

_MARKS = re.escape("".join(LOOKALIKES))
_L = r"[^\W\d_]"
_X = rf"(?:{_L}|[{_MARKS}])"
_BETWEEN = r"[ \t.\-_*/\\~=]{1,3}"
#: What is decoded: a word with look-alikes anywhere in it, a letter three times or more in a row or all letters of a word
#: twice or more, and three or more single letters and look-alikes set apart.
MIXED = re.compile(rf"(?<!{_L})(?<![{_MARKS}])(?:[{_MARKS}]++{_L}|{_L}++[{_MARKS}]){_X}*+")
REPEATED = re.compile(rf"(?<!{_L})(?:{_L}*?({_L})\1\1{_L}*|(?:({_L})\2+){{2,}}(?!{_L}))")
SPACED = re.compile(rf"(?<!\w){_X}(?:{_BETWEEN}{_X}){{2,}}(?!\w)")
#: Marks that end a stretch as punctuation do not belong to it, nor do three or more ``$``; those that begin it may be punctuation.
_TAIL, _LEAD = "!|+(", "!|+(¡"
WORDS = re.compile(r"[^\W\d_]+")
_TWICE = re.compile(rf"({_L})\1(?:\1|({_L})\2)")
_APART = re.compile(rf"(?<!\w){_X}{_BETWEEN}{_X}{_BETWEEN}{_X}(?!\w)")


@dataclass
class CharModel:
    """Character trigrams of words, interpolated with lower orders; ``^`` before and ``$`` after a word."""

    counts: dict[str, int]
    memo: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.totals: Counter[str] = Counter()
        for gram, n in self.counts.items():
            self.totals[gram[:-1]] += n
        self.letters = max(2, sum(len(g) == 1 for g in self.counts))

    @staticmethod
    def grams(word: str) -> list[str]:
        padded = f"^^{word}$"
        return [padded[i - k:i + 1] for i in range(2, len(padded)) for k in range(3)]

    def log10(self, before: str, char: str) -> float:
        gram = before + char
        known = self.memo.get(gram)
        if known is None:
            chance = 1 / (self.letters + 1)
            for k in (2, 1, 0):
                history = gram[k:-1]
                chance = (self.counts.get(gram[k:], 0) + 3 * chance) / (self.totals[history] + 3)
            known = self.memo[gram] = math.log10(chance)
        return known


class Restorer:
    """Decodes suspicious stretches of a text."""

    def __init__(self, model: CharModel) -> None:
        self.model = model
        self.memo: dict[str, str] = {}

    def decode(self, written: str) -> str:
        """The likeliest word, or words set apart, behind a stretch. State of the lattice: the last two letters."""
        known = self.memo.get(written)
        if known is not None:
            return known
        best: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
        log10, before = self.model.log10, ""
        for char in written:
            options = [(c, COST_LOOKALIKE) for c in LOOKALIKES.get(char, "")] + ([(char, 0.0)] if char.isalpha() else [])
            dropped = COST_REPEATED if char == before and char.isalpha() else None if char.isalpha() else COST_DROPPED if char in LOOKALIKES else 0.0
            following: dict[str, tuple[float, str]] = {}
            for state, (score, word) in best.items():
                steps = [(state[1] + c, score + cost + log10(state, c), word + c) for c, cost in options]
                if dropped is not None:
                    steps.append((state, score + dropped, word))
                if dropped == 0.0 and state != "^^":
                    steps.append(("^^", score + COST_BORDER + log10(state, "$"), word + " "))
                for to, value, text in steps:
                    if to not in following or value > following[to][0]:
                        following[to] = (value, text)
            best, before = following, char
        word = max((score + log10(state, "$"), word) for state, (score, word) in best.items())[1]
        if len(self.memo) >= DECODED_KEPT:
            self.memo.clear()
        self.memo[written] = word
        return word

    def restore(self, text: str | None) -> str:
        """The text in lower case with suspicious stretches decoded; null counts as empty."""
        lower = (text or "").lower()
        if _APART.search(lower):
            lower = SPACED.sub(lambda m: self.decode(m[0]) if WORDS.search(m[0]) else m[0], lower)
        if any(mark in lower for mark in LOOKALIKES):
            lower = MIXED.sub(self._mixed, lower)
        if _TWICE.search(lower):
            lower = REPEATED.sub(lambda m: self.decode(m[0]), lower)
        return lower

    def _mixed(self, match: re.Match) -> str:
        body = match[0].rstrip(_TAIL)
        while body.endswith("$$$"):
            body = body.rstrip("$").rstrip(_TAIL)
        rest = body.lstrip(_LEAD)
        if body.isalpha():
            return match[0]
        # Before a word a mark may be punctuation, which no trigram tells: both readings stay.
        plain = rest if rest.isalpha() else self.decode(rest)
        read = plain if rest == body else self.decode(body)
        return read if read == plain else f"{read} {plain}"


@dataclass
class ToxicModel:
    """Character counts, log-odds of words, and a logistic layer over what the words of a text add up to."""

    char_counts: dict[str, int]
    log_odds: dict[str, float]
    layer: list[float]

    def evidence(self, restored: str) -> tuple[float, float, float]:
        """Sum of log-odds of distinct listed words, number of listed words, and their share."""
        words = WORDS.findall(restored)
        hits = [w for w in words if w in self.log_odds]
        return sum(self.log_odds[w] for w in set(hits)), math.log1p(len(hits)), len(hits) / max(1, len(words))

    def score(self, evidence: tuple[float, float, float]) -> float:
        z = self.layer[0] + sum(a * b for a, b in zip(self.layer[1:], evidence))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_layer(measured: DataFrame, ridge: float = 1.0, rounds: int = 50) -> list[float]:
    """Weights of a logistic regression of ``label`` on three columns ``x1`` to ``x3`` with a ridge penalty, by Newton's method;
    all zero without both labels. A row counts ``n`` times. Each round sums slopes and curvatures over all rows and sends their
    fourteen numbers."""
    times = F.col("n")
    n, toxic = measured.agg(F.coalesce(F.sum(times), F.lit(0)), F.coalesce(F.sum(F.col("label") * times), F.lit(0)).cast("double")).first()
    weights = np.zeros(4)
    if toxic in (0, n):
        # Nothing to tell apart: the share of toxic rows, half a row of each kind added.
        weights[0] = math.log((toxic + 0.5) / (n - toxic + 0.5)) if n else -2.0
        return weights.tolist()
    x = [F.lit(1.0), F.col("x1"), F.col("x2"), F.col("x3")]
    pairs = [(i, j) for i in range(4) for j in range(i + 1)]
    penalty = np.diag([1e-6, ridge, ridge, ridge])
    for _ in range(rounds):
        z = sum((F.lit(float(w)) * column for w, column in zip(weights, x)), F.lit(0.0))
        row = measured.withColumn("chance", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))
        change, curve = times * (F.col("label") - F.col("chance")), times * F.col("chance") * (1 - F.col("chance"))
        sums = row.agg(*(F.sum(column * change) for column in x), *(F.sum(x[i] * x[j] * curve) for i, j in pairs)).first()
        slope, bend = np.array(sums[:4]) - penalty @ weights, penalty.copy()
        for (i, j), value in zip(pairs, sums[4:]):
            bend[i, j] += value
            bend[j, i] += value if i != j else 0.0
        step = np.linalg.solve(bend, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return weights.tolist()


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicModel:
    """Learn from all rows of ``docs`` whose id has a label (0 or 1, not null).

    Equal texts of one label are kept once with their number ``n`` and count as so many rows in every sum. Whether a word is listed
    is a test of chance that holds for rows independent of each other: there, a row weighs one over the number of rows that have
    its smallest shingle, as copies and near copies mostly do. What is collected does not grow with the rows: character trigrams,
    which are as many as the alphabets give, words that pass ``MIN_TOXIC_SHARE`` and ``MIN_Z``, and sums. Without labelled rows
    every text scores alike.
    """
    marked = labels.filter(F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("label"))
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    key = [F.xxhash64("body").alias("hash"), F.length("body").alias("size")]
    words = F.inline(F.array(F.struct(F.split("body", r"\s+").alias("w"))))
    shingles = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    # Hashes of each text go to its label, so that only texts that are kept are moved, once.
    hashes = texts.select("id", *key, words).select("id", "hash", "size", F.array_min(shingles).alias("least"))
    met = hashes.join(marked.withColumnRenamed(doc_id, "id"), "id").groupBy("hash", "size", "label")
    speakers = stored(met.agg(F.min("id").alias("id"), F.min("least").alias("least"), F.count("*").alias("n")), "toxic-speakers")
    spoken = texts.select("*", *key).join(small_side(speakers.select("id", "hash", "size", "label"), SPEAKERS_SENT), ["id", "hash", "size"])
    rows = stored(spoken.dropDuplicates(["id", "hash", "size", "label"]).select("body", "label"), "toxic-rows")
    kin = stored(speakers.groupBy("least").agg(F.sum("n").alias("kin")).filter("kin > 1"), "toxic-kin")
    several = speakers.join(small_side(kin, SPEAKERS_SENT), "least").select("hash", "size", "label", "n", (F.col("n") / F.col("kin")).alias("weight"))
    several = stored(several, "toxic-copies")
    discard(speakers)
    discard(kin)
    counted = rows.select("*", *key).join(small_side(several, SPEAKERS_SENT), ["hash", "size", "label"], "left").select(
        "body", "label", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("weight", F.lit(1.0)).alias("weight")
    )

    def count_words():
        found: Counter[str] = Counter()

        def work(bodies: list[str] | None, numbers: list[int] | None):
            for body, n in zip(bodies or (), numbers or ()):
                words = WORDS.findall(body.lower())
                if n == 1:
                    found.update(words)
                else:
                    for word in words:
                        found[word] += n
            if found and (bodies is None or len(found) >= WORDS_HELD):
                yield [pa.array(list(found.keys()), pa.string()), pa.array(list(found.values()), pa.int64())]
                found.clear()

        return work

    def count_grams():
        found: Counter[str] = Counter()

        def work(words: list[str] | None, numbers: list[int] | None):
            for word, n in zip(words or (), numbers or ()):
                if not REPEATED.search(word):
                    for gram in CharModel.grams(word):
                        found[gram] += n
            if found and (words is None or len(found) >= WORDS_HELD):
                yield [pa.array(list(found.keys()), pa.string()), pa.array(list(found.values()), pa.int64())]
                found.clear()

        return work

    written = flat_python(counted, ["body", "n"], "word string, n bigint", count_words).groupBy("word").agg(F.sum("n").alias("n"))
    grams = flat_python(written, ["word", "n"], "gram string, n bigint", count_grams).groupBy("gram").agg(F.sum("n").alias("n"))
    char_counts = {r.gram: r.n for r in grams.collect()}

    def restored():
        restorer = Restorer(CharModel(char_counts))
        return lambda bodies: [pa.array([restorer.restore(b) for b in bodies], pa.string())]

    texts = stored(add_python(counted, ["body"], "restored string", restored, keep=["label", "n", "weight"]), "toxic-restored")
    discard(rows)
    discard(several)
    sums = {r.label: (r.n, r.weight) for r in texts.groupBy("label").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).collect()}
    (toxic, toxic_weight), (clean, clean_weight) = sums.get(1, (0, 0.0)), sums.get(0, (0, 0.0))
    words = texts.select("label", "n", "weight", F.explode(F.array_distinct(F.split("restored", r"[\P{L}]+"))).alias("word")).filter("word <> ''")
    # Sums of fractions depend on their order in the last digits, which must not decide.
    t, c, tw, cw, share = F.col("t"), F.col("c"), F.round("tw", 6), F.round("cw", 6), toxic_weight / max(1.0, toxic_weight + clean_weight)
    least = max(MIN_TOXIC_ROWS, MIN_TOXIC_SHARE * toxic_weight)
    counts = (F.sum(kind * F.col(of)).alias(name) for name, kind, of in (
        ("t", F.col("label"), "n"), ("c", 1 - F.col("label"), "n"), ("tw", F.col("label"), "weight"), ("cw", 1 - F.col("label"), "weight")
    ))
    rows_with = words.groupBy("word").agg(*counts).filter(tw >= least)
    chance = (tw + cw) * share
    clearer = (tw - chance) / F.sqrt(chance * (1 - share)) >= MIN_Z
    odds = F.log(((t + 0.5) / (toxic - t + 0.5)) / ((c + 0.5) / (clean - c + 0.5)))
    log_odds = {r.word: r.odds for r in rows_with.filter(clearer).select("word", odds.alias("odds")).collect()} if toxic and clean else {}
    model = ToxicModel(char_counts, log_odds, [])

    def evidence():
        def work(bodies: list[str | None]) -> list[pa.Array]:
            return [pa.array(column, pa.float64()) for column in zip(*(model.evidence(b or "") for b in bodies))] if bodies else 3 * [pa.array([], pa.float64())]

        return work

    measured = stored(add_python(texts, ["restored"], "x1 double, x2 double, x3 double", evidence, keep=["label", "n"]), "toxic-evidence")
    discard(texts)
    model.layer = fit_layer(measured)
    return model


def score(df: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """``df`` with ``toxic_score`` (0 to 1).

    Whole texts are read; a null counts as empty and scores as a text without listed words. Columns of
    those names are replaced, others and repeated rows stay.
    """

    def make():
        restorer = Restorer(CharModel(model.char_counts))

        def work(texts: list[str | None]) -> list[pa.Array]:
            return [pa.array([model.score(model.evidence(restorer.restore(t))) for t in texts], pa.float64())]

        return work

    return add_python(df, [text], "toxic_score double", make)


def restore_texts(df: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """``df`` with ``restored``: each text in lower case with disguised words decoded."""

    def make():
        restorer = Restorer(CharModel(model.char_counts))
        return lambda texts: [pa.array([restorer.restore(t) for t in texts], pa.string())]

    return add_python(df, [text], "restored string", make)
