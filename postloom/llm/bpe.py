"""Byte-level BPE: exact merges in linear time by backtracking over longest matches.

Bytes are read as Latin-1 characters, so that one Aho-Corasick automaton finds the longest
vocabulary entry from every position of a piece. The encoder takes the longest entry, asks whether
BPE would leave the border to the entry before it standing, and otherwise tries shorter entries or
steps back. Whether two neighbours fit depends on the two entries alone and is memoised.
"""

from __future__ import annotations

import base64
from array import array
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from postloom.llm.rows import add_python

# Memo sizes of one worker: a full memo of pairs is emptied; a full memo of pieces becomes the older one, from
# which pieces still in use are taken over. Results do not change.
PIECES_KEPT = 120_000
PAIRS_KEPT = 200_000


def read_ranks(path: str) -> bytes:
    """The content of a vocabulary file: lines of a base64 entry and its rank."""
    with open(path, "rb") as file:
        return file.read()


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        rows = (line.split() for line in vocabulary.splitlines() if line.strip())
        self.ids = {base64.b64decode(entry): int(rank) for entry, rank in rows}
        self.entries = {rank: entry for entry, rank in self.ids.items()}
        self.size = {rank: len(entry) for rank, entry in self.entries.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for entry, rank in self.ids.items():
            self.automaton.add_word(entry.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter = {rank: self._longest_prefix(entry) for rank, entry in self.entries.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self._memo: dict[tuple[int, int], bool] = {}
        for rank in sorted(self.entries):
            self.parts[rank] = self._split(rank)
        self._pieces: dict[str, tuple[bytes, bytes]] = {}
        self._older: dict[str, tuple[bytes, bytes]] = {}
        self._memo.clear()

    def _longest_prefix(self, entry: bytes) -> int | None:
        for end in range(len(entry) - 1, 0, -1):
            if (rank := self.ids.get(entry[:end])) is not None:
                return rank
        return None

    def _split(self, rank: int) -> tuple[int, int] | None:
        """The two entries whose merge makes this one; ``None`` for single bytes."""
        entry, left = self.entries[rank], self.shorter[rank]
        while left is not None:
            right = self.ids.get(entry[self.size[left]:])
            if right is not None and left < rank and right < rank and self._stands(left, right):
                self.merged[left, right] = rank
                return left, right
            left = self.shorter[left]
        return None

    def _stands(self, left: int, right: int) -> bool:
        """Whether no merge across the border of two neighbours comes before those inside them.

        The later of the two merges is undone step by step. A pair of then touching parts that
        merges at a lower rank than the merge just undone would have crossed the border first.
        """
        bound = None
        while True:
            across = self.merged.get((left, right))
            if across is not None and (bound is None or across < bound):
                return False
            inner_left, inner_right = self.parts.get(left), self.parts.get(right)
            if inner_left is not None and (inner_right is None or left > right):
                bound, left = left, inner_left[1]
            elif inner_right is not None:
                bound, right = right + 1, inner_right[0]
            else:
                return True

    def fits(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self._memo.get(key)
        if known is None:
            if len(self._memo) >= PAIRS_KEPT:
                self._memo.clear()
            known = self._memo[key] = self._stands(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        size, shorter, known, fits, length = self.size, self.shorter, self._memo.get, self.fits, len(piece)
        longest: list[int | None] = [None] * (length + 1)
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size[rank]] = rank  # a later end from the same start is longer
        dead, tokens, at, token, before = bytearray(length + 1), [], 0, longest[0], None
        while at < length:
            while token is not None:
                end = at + size[token]
                if not dead[end]:
                    if before is None:
                        break
                    stands = known((before, token))
                    if fits(before, token) if stands is None else stands:
                        break
                token = shorter[token]
            if token is not None:
                tokens.append(token)
                at, before, token = end, token, longest[end]
            elif before is None:
                raise ValueError("the vocabulary lacks single bytes of the text")
            else:
                dead[at] = 1
                token = tokens.pop()
                at -= size[token]
                before = tokens[-1] if tokens else None
        return tokens

    def _piece(self, piece: str) -> tuple[bytes, bytes]:
        """Ids as 32-bit numbers, and the bytes that they decode to."""
        if len(self._pieces) >= PIECES_KEPT:
            self._older, self._pieces = self._pieces, {}
        made = self._older.get(piece)
        if made is None:
            ids = self.encode_piece(piece.encode())
            made = (array("i", ids).tobytes(), self.decode(ids))
        self._pieces[piece] = made
        return made

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))

    def round_trip(self, text: str) -> tuple[bytes, bytes]:
        pieces = self.pattern.findall(text)
        made = list(map(self._pieces.get, pieces))
        if None in made:
            made = [found or self._piece(piece) for found, piece in zip(made, pieces)]
        return b"".join([m[0] for m in made]), b"".join([m[1] for m in made])


@cache
def _tokenizer(vocabulary: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(vocabulary, pattern)


def encode_decode(df: DataFrame, vocabulary_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``token_ids`` (array of int) and ``decoded`` (binary: the bytes those ids stand for).

    Each match of ``pattern`` is encoded alone, without special tokens. The vocabulary file is read
    on the driver and sent to the workers (a fixed file of about 1 MB). A null text counts as empty:
    no ids, no bytes. Columns named ``token_ids`` or ``decoded`` are replaced; other columns and
    repeated rows stay as they are.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path))

    def make():
        tokenizer = _tokenizer(shared.value, pattern)

        def work(texts: list[str | None]) -> list[pa.Array]:
            made = [tokenizer.round_trip(text or "") for text in texts]
            ends = np.cumsum([0, *(len(ids) // 4 for ids, _ in made)], dtype=np.int32)
            flat = np.frombuffer(b"".join([ids for ids, _ in made]), np.int32)
            return [pa.ListArray.from_arrays(ends, flat), pa.array([raw for _, raw in made], pa.binary())]

        return work

    return add_python(df, [text], "token_ids array<int>, decoded binary", make)
