"""Secret scan: a keyword automaton, anchored patterns near its hits, then embedded checksums."""

from __future__ import annotations

import base64
import binascii
import json
import re
import string
import zlib
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from postloom.llm.rows import add_python

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE_KINDS = KINDS[:3]
MASK = "[SECRET]"

#: What the automaton looks for (in lower case) and the pattern tried at such a place.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
}
PATTERNS = {
    "assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]++)\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"),
    "pem": re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----([A-Za-z0-9+/=\s]{64,}?)-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
}
HEX = re.compile(r"[0-9a-f]{24,}")
#: What the parts of a token of this kind consist of.
JWT_PART = re.compile(r"eyJ[A-Za-z0-9_-]++")
MIN_ASSIGNED, MIN_ACCESS = 6, 20
_DIGITS = string.digits + string.ascii_uppercase + string.ascii_lowercase


def checksum_digits(body: str) -> str:
    """crc32 of ``body`` as six base-62 digits, the tail of the tokens checked here."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        digits = _DIGITS[rest] + digits
    return digits


def _json_header(part: str) -> bool:
    try:
        header = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(header, dict) and "alg" in header


def _base64_body(body: str) -> bool:
    """A key body: base64 whose padding closes it (the PEM form of a checked length)."""
    try:
        return len(base64.b64decode("".join(body.split()), validate=True)) >= 32
    except binascii.Error:
        return False


#: Whether a match counts. A match that does not still takes its place in the text.
VALID = {
    "assign": lambda m: len(m[1]) >= MIN_ASSIGNED,
    "access": lambda m: len(m[0]) >= MIN_ACCESS,
    "github": lambda m: checksum_digits(m[1][:30]) == m[1][30:],
    "npm": lambda m: checksum_digits(m[1][:30]) == m[1][30:],
    "jwt": lambda m: _json_header(m[1]),
    "pem": lambda m: _base64_body(m[1]),
}


class SecretScanner:
    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for keyword, kind in KEYWORDS.items():
            self.automaton.add_word(keyword, (len(keyword), kind))
        self.automaton.make_automaton()

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start and then by the order of kinds."""
        if not text:
            return []
        found = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
        # Only A-Z change, so that positions stay.
        lower = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        hits = sorted((end + 1 - length, kind) for end, (length, kind) in self.automaton.iter(lower))
        free = dict.fromkeys(KINDS, 0)
        for start, kind in hits:
            if start < free[kind]:
                continue
            if match := PATTERNS[kind].match(text, start):
                free[kind] = match.end()
                if VALID[kind](match):
                    found.append((kind, start, match.end()))
            elif kind == "jwt" and (part := JWT_PART.match(text, start)):
                # Other places in this part go to its end as well and fail at what comes behind it.
                free[kind] = part.end()
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))

    def masked(self, text: str | None) -> str | None:
        """The text with every run of overlapping spans replaced by ``MASK``."""
        spans = self.spans(text)
        if not spans:
            return text
        parts, done, end = [], 0, -1
        for _, start, stop in spans:
            if start >= end:
                if end >= 0:
                    done = end
                parts += [text[done:start], MASK]
            end = max(end, stop)
        return "".join([*parts, text[end:]])


@cache
def _scanner() -> SecretScanner:
    return SecretScanner()


def find_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``secret_spans`` (array of structs ``kind``, ``start``, ``end``; code points, end exclusive).

    Spans of one kind do not overlap, spans of different kinds may. A null or empty text has none.
    A column of that name is replaced; others and repeated rows stay. Texts are scanned whole.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        scanner = _scanner()

        def work(texts: list[str | None]) -> list[pa.Array]:
            return [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in scanner.spans(t)] for t in texts], kind)]

        return work

    return add_python(df, [text], "secret_spans array<struct<kind: string, start: bigint, end: bigint>>", make)


def mask_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the secrets of ``text`` replaced by ``[SECRET]``; nulls, other columns and column order stay."""

    def make():
        scanner = _scanner()
        return lambda texts: [pa.array([scanner.masked(t) for t in texts], pa.string())]

    return add_python(df, [text], f"`{text}` string", make).select(*(f"`{c}`" for c in df.columns))
