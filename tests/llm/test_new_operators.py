"""Word BPE, conversation repair and whitening against plain versions."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postloom.llm import conversations, queries, whitening, word_bpe
from tests.llm import cases

WORDS = public_tokenizers.path("word_bpe_49k.json")


# --- word BPE ----------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def tokenizer():
    with open(WORDS, "rb") as file:
        return word_bpe.WordBpe(file.read())


def same(tokenizer, library, text):
    ids, names = tokenizer.round_trip(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, np.int32).tolist() == want, text[:80]
    assert names.decode() == library.decode(want, skip_special_tokens=False), text[:80]


def test_word_bpe_equals_the_public_library(tokenizer, library):
    rnd = random.Random(5)
    parts = ["a", "b", " d", "é", "é", "ß", "漢", "🙂", "\n", "\t", " ", "0", "12", "³", "..", '"', "'s", "'LL", "<|endoftext|>", "<|startoftext|>",
             "<|", "thing", "Σ", "İ", "\x1c", "\x85", "\xa0", "Ᲊ", "՘", " "]
    for _ in range(800):
        same(tokenizer, library, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))))
    for text in ("a" * 30_000, "haha" * 9_000, "=" * 20_000, "é" * 9_000, cases.prose(3, 2_000)):
        same(tokenizer, library, text)


def test_every_character_is_split_and_folded_alike(tokenizer, library):
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(chars), 400):
        same(tokenizer, library, " ".join(chars[k : k + 400]))
        same(tokenizer, library, "".join(chars[k : k + 400]))


def test_joined_halves_equal_one_merge(tokenizer, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "LEAF", 6)
    rnd = random.Random(6)
    for _ in range(600):
        same(tokenizer, library, "".join(rnd.choice("abthingerso"[: rnd.choice([1, 2, 3, 11])]) for _ in range(rnd.randint(0, 200))))
        same(tokenizer, library, "".join(rnd.choice("=-!?#*"[: rnd.choice([1, 2, 6])]) for _ in range(rnd.randint(0, 200))))


def test_memo_of_runs_may_overflow(tokenizer, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "RUNS_KEPT", 4)
    same(tokenizer, library, cases.prose(8, 300))


def test_word_bpe_of_awkward_rows_and_leaves_in_parallel(spark, library):
    long_run = "".join(random.Random(9).choice("ab漢thing=") for _ in range(40_000))
    rows = [*cases.ROWS, (50, f"Two words {long_run} and <|endoftext|> more {long_run[:9_000]}", "en")]
    docs = cases.docs(spark, rows, extra="token_ids string, decoded int, row int, leaf int")
    for run in (word_bpe.LONG_RUN, 9_000):  # all texts in one task each, or long ones in leaves
        found = word_bpe.encode_decode(docs, WORDS, long_run=run).select("doc_id", "text", "row", "token_ids", "decoded").collect()
        assert len(found) == len(rows) and all(r["row"] == 7 for r in found)
        for row in found:
            want = library.encode(row.text or "", add_special_tokens=False).ids
            assert row.token_ids == want
            assert row.decoded == library.decode(want, skip_special_tokens=False)
    assert word_bpe.encode_decode(docs.limit(0), WORDS).count() == 0


# --- conversations -----------------------------------------------------------------------------
def cheapest(initials, faults):
    """(cost, audit) by walking the grammar's states, without targets, bands or stretches."""
    onward = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    @functools.cache
    def walk(at, state, inserted):
        ways = [(0, "")] if at == len(initials) and state in (0, 3) else []
        if at < len(initials):
            ways += [(c + 2, "D" + rest) for c, rest in walk(at + 1, state, 0)]
            if faults[at] not in "BD":
                extra = 5 if faults[at] == "T" else 0
                for letter, then in onward[state].items():
                    if initials[at] == letter:
                        ways += [(c + extra, "K" + rest) for c, rest in walk(at + 1, then, 0)]
                    if letter != "s":
                        ways += [(c + 1 + extra, "R" + rest) for c, rest in walk(at + 1, then, 0)]
        if inserted < 4:
            ways += [(c + 5, "I" + rest) for letter, then in onward[state].items() if letter != "s" for c, rest in walk(at, then, inserted + 1)]
        return [min(ways)] if ways else []

    return walk(0, 0, 0)[0]


ROLES = {"u": "user", "a": "assistant"}


def plain_audit(rows):
    out, by_conv = {}, {}
    for conv, turn, role, text in rows:
        kept = by_conv.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        kept += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    for conv, turns in by_conv.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, initials, faults = set(), "", ""
        for _, role, text in turns:
            solid = text.strip(" \t\n\x0b\x0c\r")
            faults += "B" if not solid else "D" if (role, text) in seen else "T" if solid[-1] not in ".!?" else "-"
            seen.add((role, text))
            initials += role[:1] or "-"
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit = cheapest(initials, faults)
        lines, rest, last = [], iter(turns), ""
        for edit in audit:
            wanted = "a" if last == "u" else "u"
            if edit == "I":
                lines.append(f"{ROLES[wanted]}:")
                last = wanted
                continue
            _, role, text = next(rest)
            if edit != "D":
                lines.append(f"{role if edit == 'K' else ROLES[wanted]}:{text}")
                last = role[0] if edit == "K" else wanted
        illegal = sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in "BDT"), illegal, cost, audit, digest)
    return out


TURNS = "conv_id bigint, turn bigint, role string, text string"


@pytest.fixture(scope="module")
def turns():
    rnd = random.Random(12)
    rows = [
        (conv, rnd.choice([None, rnd.randint(-20, 60)]), rnd.choice([None, "", "user", "assistant", "system", "tool"]), rnd.choice([None, "", "a.", "b", "c!\n", "d.  ", "Ä?"]))
        for conv, size in ((None, 30), (1, 1), (2, 70), (3, 12), (4, 5))
        for _ in range(size)
    ]
    alternating = [(9, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(120)]
    return rows + rows[:4] + alternating + [(n, 0, "user", "x.") for n in range(100, 160)]


def test_alignment_equals_a_walk_of_the_grammar():
    rnd = random.Random(2)
    for _ in range(1_500):
        size = rnd.randint(0, 9)
        initials = "".join(rnd.choice("uuaast-") for _ in range(size))
        faults = "".join(rnd.choice("----BDT") for _ in range(size))
        assert min(conversations.align(initials, faults, conversations.START, True).values()) == cheapest(initials, faults)
        for stretch in (1, 3):
            ways = {conversations.START: conversations.Way()}
            for at in range(0, size, stretch):
                part = initials[at : at + stretch], faults[at : at + stretch]
                ways = conversations.onward(ways, lambda entry: conversations.align(*part, entry, False))
            best = conversations.final(ways)
            assert (best.cost, "".join(a for _, a in best.parts())) == cheapest(initials, faults)


@pytest.mark.parametrize("block", [4_096, 8])
def test_repair_equals_the_plain_version(spark, turns, block, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK_TURNS", block)
    df = spark.createDataFrame(turns, TURNS).withColumns({"block": F.lit(1), "conv": F.lit("x"), "there": F.lit(2), "initial": F.lit(3)})
    damaged = queries.damaged(df)
    got = {r[0]: tuple(r)[1:] for r in conversations.audit(damaged, present="present").collect()}
    want = plain_audit(turns)
    assert got == want
    assert any(w[6] == "" and not w[5] for w in want.values())  # a conversation that lost all its rows
    repaired = conversations.repaired_turns(damaged, present="present").collect()
    for conv, (*_, audit, digest) in want.items():
        own = sorted((r.block, r.place, r.edit, r.role, r.text) for r in repaired if r.conv_id == conv)
        assert "".join(r[2] for r in own) == audit
        kept = "\n".join(f"{r[3]}:{r[4]}" for r in own if r[2] != "D")
        assert hashlib.sha256(kept.encode()).hexdigest() == digest


def test_repair_of_empty_tables(spark):
    df = spark.createDataFrame([], TURNS)
    assert conversations.audit(df).count() == 0
    assert conversations.repaired_turns(df).count() == 0


# --- whitening ---------------------------------------------------------------------------------
def test_polynomial_roots_and_vectors_are_exact(spark):
    rnd = random.Random(1)
    base = [[rnd.randint(-9, 9) for _ in range(6)] for _ in range(4)]  # rank 4 of 6: eigenvalue 0 twice
    matrix = [[sum(r[i] * r[j] for r in base) for j in range(6)] for i in range(6)]
    found = whitening.characteristic_polynomial(spark, matrix)
    for x in (Fraction(0), Fraction(3), Fraction(-7, 2)):
        rows = [[(x if i == j else 0) - matrix[i][j] for j in range(6)] for i in range(6)]
        det = Fraction(1)
        for k in range(6):
            pivot = next((i for i in range(k, 6) if rows[i][k]), None)
            if pivot is None:
                det = Fraction(0)
                break
            if pivot != k:
                rows[k], rows[pivot], det = rows[pivot], rows[k], -det
            det *= rows[k][k]
            for i in range(k + 1, 6):
                factor = Fraction(rows[i][k]) / rows[k][k]
                rows[i] = [a - factor * b for a, b in zip(rows[i], rows[k])]
        assert sum(c * x**k for k, c in enumerate(found)) == det
    roots = whitening.greatest_roots(found, 6)
    want = np.linalg.eigvalsh(np.array(matrix, float))[::-1]
    assert [m for _, m in roots] == [1] * 4
    assert np.allclose([float(r) for r, _ in roots], want[:4], rtol=1e-12)


def test_equal_eigenvalues_give_orthonormal_vectors(spark):
    matrix = [[5, 0, 0, 0], [0, 5, 0, 0], [0, 0, 5, 0], [0, 0, 0, 2]]
    roots = whitening.greatest_roots(whitening.characteristic_polynomial(spark, matrix), 8)
    assert [(round(float(r), 12), m) for r, m in roots] == [(5.0, 3), (2.0, 1)]
    vectors = np.array([[float(a) for a in v] for v in whitening.null_space(matrix, roots[0][0], 3)])
    assert np.allclose(vectors @ vectors.T, np.eye(3), atol=1e-14) and np.allclose(vectors[:, 3], 0, atol=1e-14)


def plain_whitening(vectors):
    """Deviations in whole numbers, and the subspace projections by a library routine."""
    x = [[int(np.floor(1024 * np.float64(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for v in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1]
    return deviation, values[order], centred @ axes[:, order] / np.sqrt(np.maximum(values[order], 1e-300))


def whitened_rows(spark, rows, kind="float", extra=True):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").repartition(3)
    return whitening.whiten(df.withColumns({"n": F.lit("x"), "component": F.lit("y")}) if extra else df, "vec_id")


def test_whitening_equals_the_plain_version(spark):
    rnd = np.random.default_rng(3)
    sound = [[float(np.float32(c)) for c in v] for v in rnd.normal(size=(60, 10)) * np.arange(1, 11) / 9]
    rows = [(k, v) for k, v in enumerate(sound)]
    bad = [(90, None), (91, [None] + sound[0][1:]), (92, [float("nan")] + sound[0][1:]), (93, [float("inf")] + sound[0][1:]), (94, []), (95, sound[0][:3]), (96, [3e38] + sound[0][1:])]
    rows += [(0, sound[0]), (None, sound[5])]  # a repeated row and a null id
    got = whitened_rows(spark, rows + bad).collect()
    deviation, values, scores = plain_whitening([v for _, v in rows])
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {len(rows)}
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    assert sorted(r.deviation for r in got) == sorted(d for d in deviation for _ in range(8))
    assert all(int(r.deviation_exact) == r.deviation for r in got)
    for k in range(8):
        mine = {r.vec_id: r for r in got if r.component == k + 1 and r.vec_id is not None and r.vec_id > 0}
        ours, theirs = np.array([mine[i].whitened for i in range(1, 60)]), scores[1:60, k]
        assert np.allclose(ours, theirs, atol=1e-8) or np.allclose(ours, -theirs, atol=1e-8)
        assert abs(mine[1].explained / (values[k] / values.sum()) - 1) < 1e-9


def test_whitening_of_little_and_large(spark):
    for rows in ([], [(1, [0.5, 2.0])], [(1, [0.5, 2.0]), (2, [0.5, 2.0])], [(1, None)]):
        assert whitened_rows(spark, rows).count() == 0
    line = whitened_rows(spark, [(k, [float(k), 2.0 * k, -1.0]) for k in range(5)], "double").collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12  # one direction only
    far = [(k, [1e9 * k, 3.0 + k * k, -2.0**49 + 1e6 * k**3]) for k in range(7)]
    got = whitened_rows(spark, far, "double").collect()
    deviation, *_ = plain_whitening([v for _, v in far])
    assert {r.vec_id: int(r.deviation_exact) for r in got} == dict(enumerate(deviation))
    assert any(r.deviation is None for r in got) and got[0].identity_error < 1e-4
