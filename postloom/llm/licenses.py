"""License scan: matching statistics against licence templates, chained into covered spans.

All templates go into one generalised suffix automaton over words. A document is streamed through
it once: for every word the automaton holds the longest run of words ending there that occurs in
some template. Maximal runs are chained per template in reading order, and a chain that covers
enough of its template gives the template's label.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from postloom.llm.rows import add_python

#: Phrases that give a label wherever they stand.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Customary notices of well-known licences.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("reserved", "All rights reserved"),
)

# A run shorter than this many words is kept only if it is a whole template.
MIN_RUN = 4
# Two runs of one chain are at most this many words apart, in the document and in the template.
MAX_GAP = 12
# A chain counts when it covers this share of its template.
MIN_COVERED = 0.75

#: Bytes A-Z in lower case; ASCII other than digits and letters as blanks.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class SuffixAutomaton:
    """Generalised suffix automaton of several word sequences.

    ``ends[state]`` lists (sequence, end) of every place where the runs of a state end.
    """

    def __init__(self, sequences: list[list[bytes]]) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for end, word in enumerate(sequence, 1):
                last = self._extend(last, word)
                self.ends[last].append((number, end))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]].extend(self.ends[state])

    def _new(self, length: int, link: int, following: dict[bytes, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, word, known)
        fresh, at = self._new(self.length[last] + 1, 0, {}), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = fresh
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            self.link[fresh] = target if self.length[target] == self.length[at] + 1 else self._clone(at, word, target)
        return fresh

    def _clone(self, at: int, word: bytes, target: int) -> int:
        copy = self._new(self.length[at] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def runs(self, words: list[bytes], least: int) -> list[tuple[int, int, int]]:
        """Maximal runs (state, first word, end) of at least ``least`` words that occur in a sequence."""
        following, link, lengths, found = self.next, self.link, self.length, []
        state = length = 0
        for at, word in enumerate(words):
            step = following[state].get(word)
            if step is None:
                if length >= least:
                    found.append((state, at - length, at))
                while state and step is None:
                    state = link[state]
                    length = lengths[state]
                    step = following[state].get(word)
                if step is None:
                    continue
            state, length = step, length + 1
        if length >= least:
            found.append((state, len(words) - length, len(words)))
        return found


class LicenseScanner:
    def __init__(self, templates=TEMPLATES) -> None:
        self.labels = [label for label, _ in templates]
        sequences = [words_of(text) for _, text in templates]
        self.sizes = [len(s) for s in sequences]
        self.least = min([MIN_RUN, *self.sizes])
        self.automaton = SuffixAutomaton(sequences)

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, covered share) of each chain that covers enough of a template."""
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for state, first, end in self.automaton.runs(words, self.least):
            length = end - first
            for number, at in self.automaton.ends[state]:
                if length >= MIN_RUN or length == self.sizes[number]:
                    pieces.setdefault(number, []).append((first, at - length, length))
        found = []
        for number, runs in pieces.items():
            found += self._chains(number, sorted(runs))
        return sorted(found, key=lambda s: (s[1], s[2], s[0]))

    def _chains(self, number: int, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Best chains in reading order: open chains are those whose last run is near enough to be continued."""
        size, chains, live = self.sizes[number], [], []
        for first, at, length in runs:
            live = [c for c in live if first - c[1] <= MAX_GAP]
            best = None
            for chain in live:
                begin, end, template_end, covered = chain
                overlap = max(0, end - first, template_end - at)
                if overlap < length and at + length > template_end and first + length > end and at - template_end <= MAX_GAP:
                    gained = covered + length - overlap
                    if best is None or gained > best[3]:
                        best = [begin, first + length, at + length, gained]
            made = best or [first, first + length, at + length, length]
            chains.append(made)
            live.append(made)
        chains = [c for c in chains if c[3] >= MIN_COVERED * size]
        # Those kept are apart from each other, so only the neighbours of a chain can overlap it.
        kept: list[list[int]] = []
        for chain in sorted(chains, key=lambda c: (-c[3], c[0])):
            at = bisect_left(kept, chain[0], key=lambda k: k[0])
            if (at == 0 or kept[at - 1][1] <= chain[0]) and (at == len(kept) or chain[1] <= kept[at][0]):
                kept.insert(at, chain)
        return [(self.labels[number], begin, end, min(1.0, covered / size)) for begin, end, _, covered in kept]

    @staticmethod
    def phrases(words: list[bytes]) -> list[tuple[int, str]]:
        """(first word, label) of each place of a fixed phrase."""
        joined, found = b" " + b" ".join(words) + b" ", []
        for phrase, label in PHRASES.items():
            wanted = f" {phrase} ".encode()
            at, before, counted = joined.find(wanted), 0, 0
            while at >= 0:
                before, counted = before + joined.count(b" ", counted, at), at
                found.append((before, label))
                at = joined.find(wanted, at + 1)
        return sorted(found)


@cache
def _scanner() -> LicenseScanner:
    return LicenseScanner()


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``license_words`` (number of words), ``license_places`` (array of structs ``first_word``, ``label``:
    the fixed phrases, in reading order) and ``license_spans`` (array of structs ``label``, ``first_word``,
    ``end_word``, ``covered``: chained template matches).

    A null or empty text has no words and empty arrays. Columns with those names are replaced, all
    others and repeated rows stay. Texts of any length are streamed; several spans may overlap when
    they belong to different templates.
    """
    out = (
        "license_words bigint, license_places array<struct<first_word: bigint, label: string>>, "
        "license_spans array<struct<label: string, first_word: bigint, end_word: bigint, covered: double>>"
    )
    place = pa.list_(pa.struct([("first_word", pa.int64()), ("label", pa.string())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.float64())]))

    def make():
        scanner = _scanner()

        def work(texts: list[str | None]) -> list[pa.Array]:
            counts, places, spans = [], [], []
            for text in texts:
                words = words_of(text)
                counts.append(len(words))
                places.append([dict(zip(("first_word", "label"), p)) for p in scanner.phrases(words)])
                spans.append([dict(zip(("label", "first_word", "end_word", "covered"), s)) for s in scanner.spans(words)])
            return [pa.array(counts, pa.int64()), pa.array(places, place), pa.array(spans, span)]

        return work

    return add_python(df, [text], out, make)
