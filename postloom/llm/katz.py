"""Language-model scores: Katz backoff over word bigrams with Good-Turing discounts.

Every word of the training texts is a class of its own, and so are the start and the end of a text and the words
never seen. A bigram has its discounted relative frequency; one that was never seen falls back on the unigram
chance of its second word, (count + 1) / (tokens + words + 1), times the weight of the first that makes all chances
add up to one. So the log chance of a text is that of its unigrams, plus the weights of all its histories, plus what
each seen bigram gains over falling back.

Bigrams of all words are counted. They are shuffled and stored as blocks: one row holds the bigrams of a bucket,
sorted by first word, with each first word once. A bucket takes the bigrams of whole histories; those of a history
with many places are spread over several by their second word, so buckets stay even. Counts alone are stored, gains
and weights are computed from a block when it is read. Words and bigrams of a given share of all tokens, of which
there can be no more than the inverse of that share, are looked up inside the tasks. First words are told apart by 64-bit
hashes, followers of one word by 39-bit ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.rows import discard, flat_python, stored

# Words and bigrams with this share of all tokens or more, a million of each at most, are looked up inside the tasks.
LOCAL_SHARE = 1e-6
# Counts up to this are discounted.
DISCOUNTED = 5
# Different words that a worker counts before it hands them on, and words that it hashes at once.
WORDS_KEPT = 400_000
WORDS_TOGETHER = 200_000
# A task merges bigrams once this many wait, and hands them on if half as many are left.
MERGE_AT = 3_000_000
# Bigrams of texts that a task gathers before it hands them on, and characters whose words it looks up at once.
TEXTS_AT = 750_000
CHARS_AT = 1_000_000
# Tokens for each bucket, and places of a history in one bucket.
BUCKET_TOKENS = 1_000_000
SPLIT_PLACES = 100_000
# Shuffle partitions for each bucket, so that hardly two meet in a task.
PARTITIONS = 2

#: The end of a text and its start, among the hashes of words.
END_HASH, START = (np.uint64(xxhash.xxh3_64_intdigest(name)) for name in (b" end", b" start"))

#: What a row of blocks holds: bigrams with a second word that tasks hold, on the way to their history; bigrams of
#: other second words, on the way to that word; the same with its count, on the way to their history; a stored
#: bucket; sums of histories that tasks hold; frequent bigrams; numbers of bigrams by count; bigrams of texts; totals of texts.
DIRECT, TO_SECOND, COUNTED, BUCKET, HISTORIES, FREQUENT, TIMES, TEXTS, TOTALS = range(9)
BLOCKS = "bucket int, kind int, firsts binary, sizes binary, seconds binary, counts binary, extra binary, rows binary, flush bigint"
# What a bucket tells of the texts of one block.
SUMS = "flush bigint, rows binary, whole binary, known binary, base binary, score binary"
PARTS = ("firsts", "sizes", "seconds", "counts", "extra", "rows")
SCORES = "row bigint, copies bigint, tokens bigint, known bigint, base double, score double"
# Bytes of a second word: its whole hash, or the one that tells followers apart.
WHOLE, SHORT = 8, 5
# Bytes of the number of a text among those that a task hands on together, and how many these may be.
NUMBER, TEXTS_TOGETHER = 3, 1_000_000


def words_of(text: str | None) -> list[bytes]:
    """Words between white space, A-Z in lower case; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _distinct(words: list[bytes]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Hashes of the different words of a list, and the list in their terms."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    found = coded.dictionary.to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)), coded


def _in_lots(texts: Iterable[str | None]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Words of some texts together, and how many each has, so that little is held at once."""
    words, sizes = [], []
    for text in texts:
        own = words_of(text)
        words += own
        sizes.append(len(own))
        if len(words) >= WORDS_TOGETHER:
            yield words, sizes
            words, sizes = [], []
    if sizes:
        yield words, sizes


def hashed(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, each text followed by its end, and the number of tokens of each."""
    made, counts = [], []
    for words, sizes in _in_lots(texts):
        hashes, coded = _distinct(words)
        own = np.array(sizes, np.int64)
        ends = np.cumsum(own + 1) - 1
        found = np.empty(len(words) + len(own), np.uint64)
        inner = np.ones(len(found), bool)
        inner[ends] = False
        found[ends] = END_HASH
        found[inner] = hashes[coded.indices.to_numpy()]
        made.append(found)
        counts.append(own + 1)
    if not made:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(made), np.concatenate(counts)


def discounts(counts_of_counts: dict[int, int], most: int = DISCOUNTED) -> list[float]:
    """Factors for counts 0 to ``most`` by Good and Turing as Katz scales them; 1 beyond.

    Where too few counts are known for a factor between 0 and 1, half a count is taken off instead.
    """
    n = [0] + [counts_of_counts.get(r, 0) for r in range(1, most + 2)]
    spare = (most + 1) * n[most + 1] / n[1] if n[1] else 1.0
    factors = [1.0]
    for r in range(1, most + 1):
        factor = ((r + 1) * n[r + 1] / (r * n[r]) - spare) / (1 - spare) if n[r] and spare < 1 else 0.0
        factors.append(factor if 0 < factor < 1 else (r - 0.5) / r)
    return factors


def _lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted array, and which of them are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _none(kind: type = np.float64):
    return field(default_factory=lambda: np.empty(0, kind))


@dataclass
class KatzModel:
    """What the tasks hold (arrays of bounded size) and the table of all else.

    ``words`` (sorted hashes, the start of a text among them), ``counts`` (as tokens) and ``places`` (as histories) are of the words
    that tasks hold. ``table`` has one ``BUCKET`` row a bucket: the bigrams of its histories with their counts.
    """

    tokens: int
    distinct: int
    buckets: int
    words: np.ndarray
    counts: np.ndarray
    places: np.ndarray
    docs: int
    factors: list[float] = field(default_factory=lambda: [1.0] * (DISCOUNTED + 1))
    history_log: np.ndarray = _none()
    history_scale: np.ndarray = _none()
    pair_keys: np.ndarray = _none(np.uint64)
    pair_log: np.ndarray = _none()
    table: DataFrame | None = None

    def __post_init__(self) -> None:
        keys = self.short(self.words, np.ones(len(self.words), bool))
        order = np.argsort(keys)
        self.short_keys, self.short_counts = keys[order], self.counts[order]

    def local(self) -> KatzModel:
        """The model without its table, which tasks cannot hold."""
        return KatzModel(**{k: v for k, v in self.__dict__.items() if k not in ("table", "short_keys", "short_counts")})

    @property
    def classes(self) -> int:
        """Words, the end, and the class of words never seen."""
        ends = self.counts[self.words == END_HASH].sum() > 0
        return self.distinct - int(ends) + 2

    @property
    def whole(self) -> float:
        return float(self.tokens + self.classes)

    @staticmethod
    def short(words: np.ndarray, local: np.ndarray) -> np.ndarray:
        """Hashes that tell followers apart; the lowest bit says whether tasks hold the word."""
        return ((words >> np.uint64(24)) & ~np.uint64(1)) | local.astype(np.uint64)

    def bucket(self, first: np.ndarray, second: np.ndarray | None = None, held: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The bucket of each bigram, or of words as histories. ``held`` is where the first words stand, if that is known."""
        part = np.zeros(len(first), np.uint64)
        if second is not None:
            at, local = _lookup(self.words, first) if held is None else held
            parts = np.where(local, 1 + self.places[at] // SPLIT_PLACES, 1).astype(np.uint64)
            part = (second >> np.uint64(20)) % parts
        mixed = (first ^ (part * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed >> np.uint64(33)) % np.uint64(self.buckets)).astype(np.int64)

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return counts * np.array([*self.factors, 1.0])[np.minimum(counts, DISCOUNTED + 1)]

    def weigh(self, n: np.ndarray, kept: np.ndarray, followers_n: np.ndarray, followers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Factor for all discounted counts of each history, and log10 of its weight.

        A history that was followed by every class has nothing to hand on. One whose followers are all too frequent for
        a discount hands on half a count.
        """
        full = followers >= self.classes
        scale = np.where(full, n / kept, np.where(kept >= n, 1 - 0.5 / n, 1.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.log10((1 - kept * scale / n) / ((self.whole - followers_n) / self.whole))
        return scale, np.where(full, 0.0, weight)

    def second_counts(self, seconds: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Counts of short second words; ``others`` are those of words that tasks do not hold, in order."""
        at, held = _lookup(self.short_keys, seconds)
        found = np.where(held, self.short_counts[at], 0)
        found[(seconds & np.uint64(1)) == 0] = others
        return found


def _small(values: np.ndarray) -> bytes:
    """Numbers of a byte each; those from 255 on follow in eight."""
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype(np.int64).tobytes()


def _read_small(data: bytes, n: int) -> np.ndarray:
    values = np.frombuffer(data, np.uint8, n).astype(np.int64)
    values[values == 255] = np.frombuffer(data, np.int64, offset=n)
    return values


def _cut(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _read_cut(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    values = np.zeros((len(raw), 8), np.uint8)
    values[:, :width] = raw
    return values.view("<u8").ravel()


def _row_width(rows: int) -> int:
    return 1 if rows <= 1 << 8 else 2 if rows <= 1 << 16 else 4


def _blocks(kind: int, width: int, buckets: np.ndarray, first: np.ndarray, second: np.ndarray, n: np.ndarray, extra=None, rows=None) -> Iterator[dict]:
    """One row for each bucket with its bigrams by first; those of ``BUCKET`` come sorted by first and second."""
    order = np.arange(len(first)) if kind == BUCKET else np.argsort(first)
    # Numpy sorts numbers of two bytes by radix.
    narrow = buckets.astype(np.uint16) if len(buckets) and buckets.max() < 1 << 16 else buckets
    order = order[np.argsort(narrow[order], kind="stable")]
    buckets, first, second, n = buckets[order], first[order], second[order], n[order]
    extra, rows = (None if a is None else a[order] for a in (extra, rows))
    starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else []
    for start, end in zip(starts, [*starts[1:], len(buckets)]):
        part = slice(start, end)
        own = first[part]
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        made = {
            "bucket": int(buckets[start]), "kind": kind, "firsts": own[at].tobytes(), "sizes": _small(np.diff(np.append(at, len(own)))),
            "seconds": _cut(second[part], width), "counts": _small(n[part]),
        }
        if extra is not None:
            made["extra"] = _small(extra[part])
        if rows is not None:
            ids, places = np.unique(rows[part], return_inverse=True)
            made |= {"rows": _cut(ids.astype(np.uint64), NUMBER), "extra": _cut(places.astype(np.uint64), _row_width(len(ids)))}
        yield made


def _read(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words, number of bigrams of each, second words and counts of a block."""
    firsts = np.frombuffer(row["firsts"], np.uint64)
    seconds = _read_cut(row["seconds"], width)
    return firsts, _read_small(row["sizes"], len(firsts)), seconds, _read_small(row["counts"], len(seconds))


def _columns(rows: list[dict]) -> list[pa.Array]:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * len(PARTS), pa.int64()]
    return [pa.array([r.get(name) for r in rows], kind) for name, kind in zip(("bucket", "kind", *PARTS, "flush"), kinds)]


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_arrays(_columns(rows), names=["bucket", "kind", *PARTS, "flush"])


def _gather(rows: list[dict], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, second words and counts of the bigrams of some blocks, one after the other."""
    parts = [_read(r, width) for r in rows]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate([np.repeat(f, s) for f, s, _, _ in parts]), np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])


def _merged(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal bigrams added up."""
    if not len(first):
        return first, second, n
    order = np.argsort(_pair_keys(first, second))
    first, second, n = first[order], second[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
    return first[at], second[at], np.add.reduceat(n, at)


def _count_words(docs: DataFrame, text: str) -> DataFrame:
    """Rows (word, n): counts by hash of all words and ends."""

    def make():
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = ends = 0

        def merge():
            keys, n = (np.concatenate(column) for column in zip(*parts))
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            parts[:] = [(keys[at], np.add.reduceat(n, at))]

        def flush():
            keys, counts = parts.pop()
            return [pa.array(keys.view(np.int64)), pa.array(counts)]

        def work(texts):
            nonlocal waiting, ends
            if texts is None:
                if ends:
                    parts.append((np.array([END_HASH], np.uint64), np.array([ends], np.int64)))
                    merge()
                    yield flush()
                return
            ends += len(texts)
            for words, _ in _in_lots(texts):
                if not words:
                    continue
                hashes, coded = _distinct(words)
                parts.append((hashes, np.bincount(coded.indices.to_numpy(), minlength=len(hashes))))
                waiting += len(hashes)
                if waiting >= 2 * WORDS_KEPT:
                    merge()
                    waiting = len(parts[0][0])
                    if waiting >= WORDS_KEPT:
                        yield flush()
                        waiting = 0

        return work

    return flat_python(docs, [text], "word bigint, n bigint", make).groupBy("word").agg(F.sum("n").alias("n"))


def _before(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    first = np.roll(words, 1)
    first[starts] = START
    return first


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return ((first << np.uint64(21)) | (first >> np.uint64(43))) ^ second


def _count_pairs(docs: DataFrame, text: str, shared) -> DataFrame:
    """Blocks ``DIRECT`` and ``TO_SECOND``: all bigrams and their counts, merged within each task."""

    def make():
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0

        def merge():
            parts[:] = [_merged(*(np.concatenate([p[i] for p in parts]) for i in range(3)))]

        def flush():
            model = shared.value
            first, second, n = parts.pop()
            local = _lookup(model.words, second)[1]
            f, s = first[local], second[local]
            rows = list(_blocks(DIRECT, SHORT, model.bucket(f, s), f, model.short(s, local[local]), n[local]))
            f, s = first[~local], second[~local]
            return _columns(rows + list(_blocks(TO_SECOND, WHOLE, model.bucket(s), f, s, n[~local])))

        def work(texts):
            nonlocal waiting
            if texts is None:
                if parts:
                    merge()
                    yield flush()
                return
            if not texts:
                return
            second, sizes = hashed(texts)
            first = _before(second, np.cumsum(sizes) - sizes)
            parts.append(_merged(first, second, np.ones(len(first), np.int64)))
            waiting += len(parts[-1][0])
            if waiting >= MERGE_AT:
                merge()
                waiting = len(parts[0][0])
                if waiting >= MERGE_AT // 2:
                    yield flush()
                    waiting = 0

        return work

    return flat_python(docs, [text], BLOCKS, make)


def _of_kind(rows: list[dict], kind: int) -> list[dict]:
    return [r for r in rows if r["kind"] == kind]


def _send_on(shared):
    """Adds up the bigrams of a bucket; those that came to their second word go on with its count."""

    def work(table: pa.Table) -> pa.Table:
        model, rows = shared.value, table.to_pylist()
        first, second, n = _merged(*_gather(_of_kind(rows, DIRECT), SHORT))
        out = list(_blocks(DIRECT, SHORT, np.full(len(first), rows[0]["bucket"]), first, second, n))
        first, second, n = _merged(*_gather(_of_kind(rows, TO_SECOND), WHOLE))
        _, group = np.unique(second, return_inverse=True)
        total = np.bincount(group, n).astype(np.int64)[group] if len(group) else n
        short = model.short(second, np.zeros(len(second), bool))
        return _table(out + list(_blocks(COUNTED, SHORT, model.bucket(first, second), first, short, n, total)))

    return work


def _put_down(shared, least: float):
    """Puts the bigrams of a bucket together: its block, and what tasks have to hold of it."""

    def work(table: pa.Table) -> pa.Table:
        model, rows = shared.value, table.to_pylist()
        bucket = rows[0]["bucket"]
        direct, counted = _gather(_of_kind(rows, DIRECT), SHORT), _of_kind(rows, COUNTED)
        more = _gather(counted, SHORT)
        others = [_read_small(r["extra"], len(r["seconds"]) // SHORT) for r in counted]
        first, second, n = (np.concatenate(p) for p in zip(direct, more))
        others = np.concatenate([np.zeros(len(direct[0]), np.int64), *others])
        order = np.lexsort((second, first))
        first, second, n, others = first[order], second[order], n[order], others[order]
        rare = (second & np.uint64(1)) == 0
        block = next(_blocks(BUCKET, SHORT, np.full(len(first), bucket), first, second, n))
        out = [block | {"extra": _small(others[rare])}]
        out.append({"bucket": bucket, "kind": TIMES, "counts": np.bincount(np.minimum(n, DISCOUNTED + 2), minlength=DISCOUNTED + 3).astype(np.int64).tobytes()})
        seconds = model.second_counts(second, others[rare])
        at = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        held = _lookup(model.words, first[at])[1]
        # Of a history: bigrams by count up to the last discounted one, places of all others, counts of followers, followers.
        sums = [np.add.reduceat((n == r).astype(np.int64), at) for r in range(1, DISCOUNTED + 1)]
        sums += [np.add.reduceat(np.where(n > DISCOUNTED, n, 0), at), np.add.reduceat(seconds + 1, at), np.diff(np.append(at, len(first)))]
        if held.any():
            out.append({"bucket": bucket, "kind": HISTORIES, "firsts": first[at][held].tobytes(), "counts": np.column_stack(sums)[held].astype(np.int64).tobytes()})
        often = (n >= least) & _lookup(model.words, first)[1]
        if often.any():
            out.extend(_blocks(FREQUENT, SHORT, np.full(often.sum(), bucket), first[often], second[often], n[often]))
        return _table(out)

    return work


def _gains(model: KatzModel, n, history_n, scale, weight, seconds) -> np.ndarray:
    """What the log10 chance of bigrams gains over falling back."""
    return np.log10(model.kept(n) * scale / history_n) - np.log10((seconds + 1) / model.whole) - weight


def train(docs: DataFrame, text: str = "text") -> KatzModel:
    """Learn from all rows of ``docs``; a null text counts as empty, so its end alone is a token.

    Nothing is sampled. Collected are words and bigrams of ``LOCAL_SHARE`` of the tokens or more, a few numbers a
    word of these, and counts of counts. Without rows every word belongs to the class of unseen ones.
    """
    spark = docs.sparkSession
    words = stored(_count_words(docs, text), "katz-words")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = words.filter((F.col("n") >= LOCAL_SHARE * tokens) | (F.col("word") == int(END_HASH.astype(np.int64)))).toArrow()
    discard(words)
    found = dict(zip(frequent["word"].to_numpy().view(np.uint64).tolist(), frequent["n"].to_numpy().tolist()))
    ends = found.setdefault(int(END_HASH), 0)
    found[int(START)] = 0
    hashes = np.sort(np.fromiter(found, np.uint64, len(found)))
    counts = np.array([found[int(w)] for w in hashes], np.int64)
    places = np.where(hashes == START, ends, counts)
    model = KatzModel(tokens, distinct, 1 + tokens // BUCKET_TOKENS, hashes, counts, places, ends)
    shared = spark.sparkContext.broadcast(model.local())
    parts = PARTITIONS * model.buckets
    sent = stored(_count_pairs(docs, text, shared).repartition(parts, "bucket").groupBy("bucket").applyInArrow(_send_on(shared), BLOCKS), "katz-sent")
    least = LOCAL_SHARE * tokens
    model.table = stored(sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_put_down(shared, least), BLOCKS), "katz-table")
    discard(sent)
    small = model.table.filter(F.col("kind").isin(TIMES, HISTORIES, FREQUENT)).select("kind", *PARTS).toArrow().to_pylist()
    times = sum((np.frombuffer(r["counts"], np.int64) for r in _of_kind(small, TIMES)), np.zeros(DISCOUNTED + 3, np.int64))
    model.factors = discounts({r: int(times[r]) for r in range(1, DISCOUNTED + 2)})
    # Parts of one history in several buckets are added up.
    sums = np.zeros((len(hashes), DISCOUNTED + 3), np.int64)
    for row in _of_kind(small, HISTORIES):
        at, _ = _lookup(hashes, np.frombuffer(row["firsts"], np.uint64))
        sums[at] += np.frombuffer(row["counts"], np.int64).reshape(-1, DISCOUNTED + 3)
    by_count, rest, followers_n, followers = sums[:, :DISCOUNTED], sums[:, -3], sums[:, -2], sums[:, -1]
    steps = np.arange(1, DISCOUNTED + 1)
    there = followers > 0
    scale, weight = np.ones(len(hashes)), np.zeros(len(hashes))
    kept = by_count @ (steps * np.array(model.factors[1:])) + rest
    scale[there], weight[there] = model.weigh((by_count @ steps + rest)[there], kept[there], followers_n[there], followers[there])
    model.history_scale, model.history_log = scale, weight
    first, second, n = _gather(_of_kind(small, FREQUENT), SHORT)
    # A frequent bigram has a frequent second word.
    at, _ = _lookup(hashes, first)
    gain = _gains(model, n, places[at], scale[at], weight[at], model.second_counts(second, np.empty(0, np.int64))) if len(first) else np.empty(0)
    keys = _pair_keys(first, second)
    order = np.argsort(keys)
    model.pair_keys, model.pair_log = keys[order], gain[order]
    return model


def _occurrences(docs: DataFrame, text: str, key: str, shared) -> DataFrame:
    """Blocks ``TEXTS`` (bigrams that tasks do not hold, of each text) and ``TOTALS`` (what tasks could sum up of it).

    A task takes each text once, whatever its copies there.
    """

    def make():
        taken: set[int] = set()
        waiting: list[list[np.ndarray]] = [[], [], [], [], []]
        totals: list[tuple] = []
        size = 0

        def flush():
            nonlocal size
            model = shared.value
            rows = []
            if waiting[0]:
                buckets, first, second, n, row = (np.concatenate(w) for w in waiting)
                rows += _blocks(TEXTS, SHORT, buckets, first, second, n, rows=row)
            ids = np.array([t[0] for t in totals], np.int64)
            rows.append({
                "bucket": int(ids[0]) % model.buckets, "kind": TOTALS, "rows": ids.tobytes(), "extra": np.array([t[1:3] for t in totals], np.int64).tobytes(),
                "counts": np.array([t[3:] for t in totals], np.float64).tobytes(),
            })
            # A task that runs again gives its blocks the same number.
            number = int(np.array(xxhash.xxh3_64_intdigest(ids.tobytes()), np.uint64).astype(np.int64))
            rows = [r | {"flush": number} for r in rows]
            for column in waiting:
                column.clear()
            totals.clear()
            size = 0
            return _columns(rows)

        def measure(texts: dict[int, str | None]):
            nonlocal size
            model = shared.value
            (words, sizes), ids = hashed(texts.values()), np.fromiter(texts, np.int64, len(texts))
            numbers = len(totals) + np.arange(len(ids))
            of, starts = np.repeat(np.arange(len(ids)), sizes), np.cumsum(sizes) - sizes
            at, local = _lookup(model.words, words)
            # The word before is known by the place of the one that follows it.
            first, before, held = _before(words, starts), np.roll(at, 1), np.roll(local, 1)
            before[starts], held[starts] = _lookup(model.words, first[:1])

            def per_text(where, values):
                return np.bincount(of[where], values, len(ids))

            base = per_text(local, np.log10(model.counts + 1.0)[at[local]])
            chance = base - math.log10(model.whole) * sizes + per_text(held, model.history_log[before[held]])
            known = per_text(local, (model.counts > 0)[at[local]])
            second = model.short(words, local)
            order = np.argsort(_pair_keys(first, words) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            columns = [c[order] for c in (first, words, second, of)]
            before, held = before[order], held[order]
            changes = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            cuts = np.flatnonzero(np.concatenate([[True], changes]))
            n = np.diff(np.append(cuts, len(words)))
            first, words, second, of = (c[cuts] for c in columns)
            before, held = before[cuts], held[cuts]
            where, there = _lookup(model.pair_keys, _pair_keys(first, second))
            chance += per_text(there, model.pair_log[where[there]] * n[there])
            rest = ~there
            first, words = first[rest], words[rest]
            for column, part in zip(waiting, (model.bucket(first, words, (before[rest], held[rest])).astype(np.int32), first, second[rest], n[rest].astype(np.int32), numbers[of[rest]].astype(np.int32))):
                column.append(part)
            size += len(first)
            totals.extend(zip(ids.tolist(), sizes.tolist(), known.astype(np.int64).tolist(), base.tolist(), chance.tolist()))

        def work(rows, bodies):
            nonlocal size
            if rows is None:
                if totals:
                    yield flush()
                return
            texts, n_chars = {}, 0
            for row, body in zip(rows, bodies):
                if row in taken:
                    continue
                taken.add(row)
                texts[row] = body
                n_chars += len(body or "") + 1
                if n_chars >= CHARS_AT:
                    measure(texts)
                    texts, n_chars = {}, 0
                if size >= TEXTS_AT or len(totals) >= TEXTS_TOGETHER:
                    yield flush()
            if texts:
                measure(texts)

        return work

    return flat_python(docs, [key, text], BLOCKS, make)


def _evaluate(shared):
    """Looks up the bigrams of texts in the block of their bucket: one row of sums for each block of texts."""

    def work(table: pa.Table) -> pa.Table:
        model, rows = shared.value, table.to_pylist()
        made = []
        for row in _of_kind(rows, TOTALS):
            whole = np.frombuffer(row["extra"], np.int64).reshape(-1, 2)
            sums = np.frombuffer(row["counts"], np.float64).reshape(-1, 2)
            made.append({"flush": row["flush"], "rows": row["rows"], "whole": whole[:, 0].tobytes(), "known": _small(whole[:, 1]), "base": sums[:, 0].tobytes(), "score": sums[:, 1].tobytes()})
        blocks = _of_kind(rows, BUCKET)
        # Without a block no bigram of the bucket was seen, which adds nothing.
        if blocks:
            firsts, sizes, seconds, n = _read(blocks[0], SHORT)
            starts, group = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(firsts)), sizes)
            rare = (seconds & np.uint64(1)) == 0
            second_n = model.second_counts(seconds, _read_small(blocks[0]["extra"], int(rare.sum())))
            at, held = _lookup(model.words, firsts)
            # Histories that tasks do not hold stand here whole.
            history_n = np.where(held, model.places[at], np.add.reduceat(n, starts))
            scale, weight = model.weigh(np.add.reduceat(n, starts), np.add.reduceat(model.kept(n), starts), np.add.reduceat(second_n + 1, starts), sizes)
            scale, weight = np.where(held, model.history_scale[at], scale), np.where(held, model.history_log[at], weight)
            gains = _gains(model, n, history_n[group], scale[group], weight[group], second_n)
            keys = (group.astype(np.uint64) << np.uint64(40)) | seconds
            # Places of words that tasks hold are summed up there.
            word_n, word_log = np.where(held, 0, history_n), np.where(held, 0.0, np.log10(history_n + 1.0))
            word_weight = np.where(held, 0.0, weight)
            for row in _of_kind(rows, TEXTS):
                first, size, second, times = _read(row, SHORT)
                texts = len(row["rows"]) // NUMBER
                of = _read_cut(row["extra"], _row_width(texts)).astype(np.int64)
                at, seen = (np.repeat(a, size) for a in _lookup(firsts, first))
                where, there = _lookup(keys, (at.astype(np.uint64) << np.uint64(40)) | second)
                score = np.where(seen, word_log[at] + word_weight[at], 0.0) + np.where(there & seen, gains[where], 0.0)
                parts = (np.where(seen & (word_n[at] > 0), 1, 0), np.where(seen, word_log[at], 0.0), score)
                known, base, score = (np.bincount(of, p * times, texts) for p in parts)
                # Few texts have words here that tasks do not hold.
                some = base.tobytes() if base.any() else b""
                made.append({"flush": row["flush"], "rows": row["rows"], "known": _small(known.astype(np.int64)), "base": some, "score": score.tobytes()})
        names = [p.split()[0] for p in SUMS.split(", ")]
        kinds = [pa.int64(), *[pa.binary()] * (len(names) - 1)]
        return pa.Table.from_arrays([pa.array([r.get(k) for r in made], kind) for k, kind in zip(names, kinds)], names=names)

    return work


def _add_up(table: pa.Table) -> pa.Table:
    """One row for each text of a block that a task handed on, with its sums over all buckets."""
    rows = table.to_pylist()
    # The row of totals names the texts, others give their numbers there.
    totals = [r["whole"] is not None for r in rows]
    texts = np.frombuffer(rows[totals.index(True)]["rows"], np.int64)
    of = [np.arange(len(texts)) if t else _read_cut(r["rows"], NUMBER).astype(np.int64) for r, t in zip(rows, totals)]
    known = [_read_small(r["known"], len(i)) for r, i in zip(rows, of)]
    base = [np.frombuffer(r["base"]) if r["base"] else np.zeros(len(i)) for r, i in zip(rows, of)]
    score = [np.frombuffer(r["score"]) for r in rows]
    tokens = [np.frombuffer(r["whole"], np.int64) if t else np.zeros(len(i), np.int64) for r, i, t in zip(rows, of, totals)]
    copies = [np.full(len(i), int(t)) for i, t in zip(of, totals)]
    places = np.concatenate(of)
    sums = (np.bincount(places, np.concatenate(part), len(texts)) for part in (copies, tokens, known, base, score))
    names, kinds = zip(*(p.split() for p in SCORES.split(", ")))
    arrow = {"bigint": pa.int64(), "double": pa.float64()}
    return pa.Table.from_arrays([pa.array(c.astype(np.int64) if k == "bigint" else c, arrow[k]) for c, k in zip((texts, *sums), kinds)], names=list(names))


def score(docs: DataFrame, model: KatzModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lm_tokens``, ``lm_known`` (tokens seen in training), ``lm_base`` (log10 chance by add-one unigrams)
    and ``lm_score`` (log10 chance by the Katz model); columns of those names are replaced.

    Every text is scored whole; a null counts as empty and has its end as only token. Texts that repeat are
    scored once a task and get equal values, all rows are returned. Where there are more rows than the model
    was trained on, texts of a bucket are dealt to several copies of its block.
    """
    names = ("lm_tokens", "lm_known", "lm_base", "lm_score")
    shared = docs.sparkSession.sparkContext.broadcast(model.local())
    named = docs.select(F.xxhash64(text).alias("row"), F.col(f"`{text}`").alias("body"))
    deals = 1 + docs.count() // (2 * max(1, model.docs))
    texts = _occurrences(named, "body", "row", shared)
    texts = texts.withColumn("deal", F.pmod(F.xxhash64("flush"), F.lit(deals)))
    table = model.table.filter(F.col("kind") == BUCKET).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(deals - 1).cast("bigint"))))
    dealt = texts.unionByName(table).repartition(PARTITIONS * model.buckets, "bucket", "deal").groupBy("bucket", "deal")
    found = dealt.applyInArrow(_evaluate(shared), SUMS).groupBy("flush").applyInArrow(_add_up, SCORES)
    sums = found.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("copies", "tokens", "known", "base", "score")))
    scale = math.log10(model.tokens + model.distinct + 1)
    tokens, known = ((F.col(c) / F.col("copies")).cast("bigint") for c in ("tokens", "known"))
    base, chance = (F.col(c) / F.col("copies") for c in ("base", "score"))
    made = sums.select(F.col("row").alias("lm_row"), *(c.alias(k) for k, c in zip(names, (tokens, known, base - tokens * scale, chance))))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*kept, F.xxhash64(text).alias("lm_row")).join(made, "lm_row", "left").drop("lm_row")
