"""Awkward rows that every operator has to take, and plain versions of what words are."""

from __future__ import annotations

import random
import re

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}

ENGLISH = "the of and to in a is that was for with as are this on be at by it".split()
GERMAN = "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split()


def prose(seed: int, words: int, common: list[str] = ENGLISH) -> str:
    """Invented sentences: common words and random ones, new for each seed."""
    rnd = random.Random(seed)
    made = [rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choice("abdeghilmnorstu") for _ in range(rnd.randint(3, 9))) for _ in range(words)]
    return " ".join(w + "." if k % 12 == 11 else w for k, w in enumerate(made)).capitalize()


def edited(text: str, seed: int, edits: int) -> str:
    rnd, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"edit{rnd.randrange(10**6)}"
    return " ".join(words)


def alnum_words(text: str | None) -> list[str]:
    return ALNUM.findall((text or "").translate(LOWER))


def solid_words(text: str | None) -> list[str]:
    return SOLID.findall((text or "").translate(LOWER))


#: (doc_id, text, lang): nulls in each column, empty, blank and very long texts, one row twice, and an id with two texts.
ROWS = [
    (1, prose(1, 120), "en"),
    (2, prose(2, 80), "en"),
    (3, None, "en"),
    (4, "", None),
    (5, " \t\n\r\x0b\x0c ", "en"),
    (6, prose(6, 30_000), "en"),
    (7, prose(7, 90), None),
    (8, prose(8, 70), "en"),
    (8, prose(8, 70), "en"),
    (9, prose(9, 60), "en"),
    (9, prose(10, 60), "en"),
    (None, prose(11, 60), "en"),
    (None, None, None),
    (12, "Ä ö Ü — ÉTÉ \u2028 İstanbul 漢字 🙂 x\u0000y", "de"),
    (13, "x" * 200_000, "en"),
    (14, "!!! ??? ...", "en"),
]
SCHEMA = "doc_id bigint, text string, lang string"


def docs(spark, rows=ROWS, extra: str | None = "words string, prints int, node string, spans int"):
    """The rows as a table, with more columns whose names clash with inner ones of the operators."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("bigint"))
    for column in extra.split(", ") if extra else ():
        name, kind = column.split(" ")
        df = df.withColumn(name, F.lit("7").cast(kind))
    return df


def plain(rows):
    """Rows that sort with nulls."""
    return sorted(tuple(r) for r in rows) if not any(None in tuple(r) for r in rows) else sorted((tuple(r) for r in rows), key=repr)
