"""BPE over words with word ends, by tree concatenation.

A word is a sequence of symbols, one for each byte, the last one marked as the end of the word. Short
words are merged at once. A long unsplit word is halved down to leaves that are encoded apart; two
encodings are joined by encoding a window around the border anew. The window grows until its first
and last token are those that stood there before: then every token fits its neighbours, and a sequence
of tokens in which all neighbours fit is the encoding of its text. Leaves of very long words are rows
of their own and are encoded by as many tasks.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postloom.llm.rows import add_python, flat_python
from postloom.session import materialize

# Symbols that are merged at once; longer words are halved.
LEAF = 8_192
# Symbols up to which the next merge is found by looking at all pairs.
FEW = 64
# A pair of ids, or a rank and an id, as one number.
BITS = 20
MASK, NONE = (1 << BITS) - 1, 1 << (2 * BITS)
# Characters without a blank from which the leaves of a text's words are encoded by several tasks.
LONG_RUN = 8 * LEAF
# Runs between blanks remembered by one worker; a full memo becomes the older one, from which those still in use are taken over.
RUNS_KEPT = 400_000
# Tokens on each side of a border that the first window holds.
FIRST_REACH = 4


# Fixed value: the vocabulary's splitting rule, for folded text. Separators of ASCII are no blanks to it.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\x09-\x0D\x20\x85\p{Z}\p{L}\p{N}]+")
SEPARATORS = re.compile("[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself, or one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        model = spec["model"]
        end, vocabulary = model["end_of_word_suffix"], model["vocab"]
        self.names = {i: f"{name} ".encode() for name, i in vocabulary.items()}
        letters = _byte_letters()
        self.inside = [vocabulary[c] for c in letters]
        self.last = [vocabulary[c + end] for c in letters]
        byte_of = {c: b for b, c in enumerate(letters)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # By pair of ids, the rank and the merged id, each as one number that sorts by rank.
        self.merges = {vocabulary[a] << BITS | vocabulary[b]: rank << BITS | vocabulary[a + b] for rank, (a, b) in enumerate(pairs)}
        self._raw = {i: (bytes(byte_of[c] for c in name.removesuffix(end)), name.endswith(end) and len(name) > len(end)) for name, i in vocabulary.items()}
        marks = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.names |= {i: f"{mark} ".encode() for mark, i in marks.items()}
        self.marks = {mark: self._packed([i]) for mark, i in marks.items()}
        self.split_marks = re.compile("(" + "|".join(sorted(map(re.escape, marks), key=len, reverse=True)) + ")").split
        self.library = Tokenizer.from_str(content.decode())
        self.byte_of = byte_of
        self._settled: set[str] = set()
        self._runs: dict[str, tuple[bytes, bytes]] = {}
        self._older: dict[str, tuple[bytes, bytes]] = {}

    # --- words of a text ---

    def _is_settled(self, text: str) -> bool:
        """Whether all characters are assigned in this Python's Unicode; rules for them do not change any more."""
        if text.isascii():
            return True
        fresh = set(text) - self._settled
        if any(unicodedata.category(c) == "Cn" for c in fresh):
            return False
        self._settled |= fresh
        return True

    def words(self, text: str) -> list[str | bytes]:
        """The words of a text in order: folded strings, or bytes where the text holds unassigned characters.

        Special tokens stand as words of their own. Folding is composition and lower case letter by letter.
        """
        found: list[str | bytes] = []
        parts = self.split_marks(text) if "<|" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                found.append(part)
            elif self._is_settled(part):
                found += WORD.findall(_folded(part))
            else:
                folded = self.library.normalizer.normalize_str(part)
                found += [bytes(self.byte_of[c] for c in word) for word, _ in self.library.pre_tokenizer.pre_tokenize_str(folded)]
        return found

    def symbols(self, word: bytes) -> list[int]:
        made = [self.inside[b] for b in word]
        made[-1] = self.last[word[-1]]
        return made

    def spelled(self, ids: list[int]) -> list[int]:
        """The symbols that tokens are made of."""
        made = []
        for i in ids:
            raw, ends = self._raw[i]
            made += [self.inside[b] for b in raw]
            if ends:
                made[-1] = self.last[raw[-1]]
        return made

    # --- merging ---

    def merge(self, symbols: list[int]) -> list[int]:
        """The encoding of symbols: the pair of lowest rank is merged first, of equal ones the leftmost."""
        return self._merge_few(list(symbols)) if len(symbols) <= FEW else self._merge_many(list(symbols))

    def _merge_few(self, ids: list[int]) -> list[int]:
        find = self.merges.get
        found = [find(a << BITS | b, NONE) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != NONE:
            at, made = found.index(best), best & MASK
            ids[at : at + 2] = [made]
            del found[at]
            if at:
                found[at - 1] = find(ids[at - 1] << BITS | made, NONE)
            if at < len(found):
                found[at] = find(made << BITS | ids[at + 1], NONE)
        return ids

    def _merge_many(self, ids: list[int]) -> list[int]:
        size, find = len(ids), self.merges.get
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(found, at, ids[at], ids[at + 1]) for at in range(size - 1) if (found := find(ids[at] << BITS | ids[at + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            best, at, left, right = heapq.heappop(heap)
            then = after[at]
            if ids[at] != left or then >= size or ids[then] != right:
                continue
            made = best & MASK
            ids[at], ids[then] = made, -1
            after[at] = then = after[then]
            if then < size:
                before[then] = at
                if (found := find(made << BITS | ids[then])) is not None:
                    heapq.heappush(heap, (found, at, made, ids[then]))
            if (prior := before[at]) >= 0 and (found := find(ids[prior] << BITS | made)) is not None:
                heapq.heappush(heap, (found, prior, ids[prior], made))
        return [i for i in ids if i >= 0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two texts written one after the other, from their encodings."""
        if not left or not right:
            return left or right
        reach = FIRST_REACH
        while True:
            start, stop = max(0, len(left) - reach), min(len(right), reach)
            window = self.merge(self.spelled(left[start:]) + self.spelled(right[:stop]))
            if (start == 0 or window[0] == left[start]) and (stop == len(right) or window[-1] == right[stop - 1]):
                return [*left[:start], *window, *right[stop:]]
            reach *= 2

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """The encoding of texts written one after the other: neighbours are joined until one is left."""
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def encode(self, symbols: list[int]) -> list[int]:
        if len(symbols) <= LEAF:
            return self.merge(symbols)
        half = len(symbols) // 2
        return self.join(self.encode(symbols[:half]), self.encode(symbols[half:]))

    # --- texts ---

    def _packed(self, ids: list[int]) -> tuple[bytes, bytes]:
        """Ids as 32-bit numbers, and the tokens they stand for, each with a blank behind it."""
        return array("i", ids).tobytes(), b"".join([self.names[i] for i in ids])

    def _word(self, word: str | bytes) -> tuple[bytes, bytes]:
        if (mark := self.marks.get(word)) is not None:
            return mark
        return self._packed(self.encode(self.symbols(word.encode() if isinstance(word, str) else word)))

    def _run(self, run: str) -> tuple[bytes, bytes]:
        """The encoding of what stands between two blanks. Short runs are remembered, and the words in them."""
        known = self._runs
        if len(known) >= RUNS_KEPT:
            self._older, self._runs = known, {}
            known = self._runs
        made = self._older.get(run)
        if made is None:
            words = WORD.findall(run)
            parts = []
            for word in words:
                part = known.get(word) or self._older.get(word) or self._word(word)
                if len(word) <= 64:
                    known[word] = part
                parts.append(part)
            made = parts[0] if len(parts) == 1 else (b"".join([m[0] for m in parts]), b"".join([m[1] for m in parts]))
        if len(run) <= 64:
            known[run] = made
        return made

    def round_trip(self, text: str) -> tuple[bytes, bytes]:
        """Ids as 32-bit numbers and the decoded text in UTF-8."""
        if "<|" in text or not self._is_settled(text) or SEPARATORS.search(text):
            made = list(map(self._word, self.words(text)))
        else:
            runs = _folded(text).split()
            made = list(map(self._runs.get, runs))
            if None in made:
                made = [found or self._run(run) for found, run in zip(made, runs)]
        return b"".join([m[0] for m in made]), b"".join([m[1] for m in made])[:-1]

    def leaves(self, text: str) -> Iterator[tuple[int, int, bytes | None, bytes | None]]:
        """(place, leaf, symbols, ids) of a text in order: a leaf of a long word has symbols, words between them ids."""
        place = 0
        for is_long, words in groupby(self.words(text), key=lambda w: len(w) > LEAF):
            if not is_long:
                yield place, 0, None, b"".join([self._word(w)[0] for w in words])
                place += 1
                continue
            for word in words:
                symbols = self.symbols(word.encode() if isinstance(word, str) else word)
                for leaf, start in enumerate(range(0, len(symbols), LEAF)):
                    yield place, leaf, array("i", symbols[start : start + LEAF]).tobytes(), None
                place += 1


def _folded(text: str) -> str:
    """Composed, in lower case letter by letter: a sigma at a word's end is one like others."""
    return (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()


@cache
def _tokenizer(content: bytes) -> WordBpe:
    return WordBpe(content)


def _ints(raw: bytes) -> list[int]:
    return np.frombuffer(raw, np.int32).tolist()


def _arrays(made: list[tuple[bytes, bytes]]) -> list[pa.Array]:
    ends = np.cumsum([0, *(len(ids) // 4 for ids, _ in made)], dtype=np.int32)
    flat = np.frombuffer(b"".join([ids for ids, _ in made]), np.int32)
    return [pa.ListArray.from_arrays(ends, flat), pa.array([raw for _, raw in made], pa.binary()).cast(pa.string())]


FOUND = "token_ids array<int>, decoded string"


def encode_decode(df: DataFrame, vocabulary_path: str, text: str = "text", long_run: int = LONG_RUN) -> DataFrame:
    """``df`` with ``token_ids`` (array of int) and ``decoded`` (the tokens, joined by blanks).

    The file describes the vocabulary, the merges and the special tokens, which stand for themselves in a text.
    It is read on the driver and sent to the workers (a fixed file of about 4 MB). A null text counts as empty: no
    ids, an empty string. Columns named ``token_ids`` or ``decoded`` are replaced; other columns and repeated
    rows stay as they are. Texts with a run of ``long_run`` characters without a blank are cut into leaves that
    all tasks share; the others are encoded where they are. Both give the same ids.
    """
    with open(vocabulary_path, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())
    kept = df.drop("token_ids", "decoded")

    def make():
        tokenizer = _tokenizer(shared.value)
        return lambda texts: _arrays([tokenizer.round_trip(t or "") for t in texts])

    is_long = has_run(F.col(f"`{text}`"), long_run)
    direct = add_python(kept.filter(~is_long), [text], FOUND, make)
    return direct.unionByName(_in_parallel(kept.filter(is_long), text, shared, kept.columns))


def has_run(text: Column, length: int) -> Column:
    """Whether a text holds ``length`` characters in a row without a blank; short texts are not searched."""
    bounded = min(length, 65_535)
    return F.coalesce((F.length(text) >= length) & text.rlike(f"[^\\x09-\\x0D\\x20]{{{bounded}}}"), F.lit(False))


def _in_parallel(df: DataFrame, text: str, shared, columns: list[str]) -> DataFrame:
    """The rows of ``df`` with their leaves encoded by all tasks. The numbered rows are written, so numbers stay."""
    row = "_row"
    while row in columns:
        row += "_"
    rows = materialize(df.withColumn(row, F.monotonically_increasing_id()), "long-texts")

    def cut():
        tokenizer = _tokenizer(shared.value)

        def work(numbers, texts):
            for number, one in zip(numbers or (), texts or ()):
                block = []
                for found in tokenizer.leaves(one):
                    block.append((number, *found))
                    if len(block) == 256:
                        yield _leaf_arrays(block)
                        block = []
                if block:
                    yield _leaf_arrays(block)

        return work

    def merge():
        tokenizer = _tokenizer(shared.value)

        def work(symbols, ids):
            merged = [i if s is None else array("i", tokenizer.merge(_ints(s))).tobytes() for s, i in zip(symbols, ids)]
            return [pa.array(merged, pa.binary())]

        return work

    def join():
        tokenizer = _tokenizer(shared.value)

        def work(pieces):
            made = []
            for places in pieces:
                joined = []
                for _, leaves in groupby(places, key=lambda p: p["place"]):
                    joined += tokenizer.join_all([_ints(p["done"]) for p in leaves])
                ids, names = tokenizer._packed(joined)
                made.append((ids, names[:-1]))
            return _arrays(made)

        return work

    leaves = flat_python(rows, [row, text], "row bigint, place int, leaf int, symbols binary, ids binary", cut)
    dealt = leaves.repartition("row", "place", "leaf")
    done = add_python(dealt, ["symbols", "ids"], "done binary", merge, keep=["row", "place", "leaf"])
    whole = done.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "leaf", "done"))).alias("pieces"))
    encoded = add_python(whole, ["pieces"], FOUND, join, keep=["row"]).withColumnRenamed("row", row)
    filled = rows.join(encoded, row, "left").withColumns(
        {"token_ids": F.coalesce("token_ids", F.array().cast("array<int>")), "decoded": F.coalesce("decoded", F.lit(""))}
    )
    return filled.select(*(F.col(f"`{c}`") for c in columns), "token_ids", "decoded")


def _leaf_arrays(block: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return [pa.array(values, kind) for values, kind in zip(zip(*block), kinds)]
