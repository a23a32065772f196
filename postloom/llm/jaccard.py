"""Exact self-join of sets of word n-grams by Jaccard similarity, down to connected groups.

Sets of one size band are cut into segments by hashing their members. Sets that link differ in few
members, so by the pigeonhole principle they agree in many segments. How much a band spends on
whole segments and how much on segments that match up to one missing member is chosen by cost.

Whole segments: of the ``m`` segments of a band, two sets that link agree in ``m - D`` or more, where D bounds their
difference. Each set leaves out its ``m - D - 1`` lightest segments, in an order that depends on a segment's
content alone. Of the segments that two sets share, the last in that order is left out by neither.
Light segments, which unrelated sets share, are thus never indexed.

One-deletion segments: with ``k`` segments and D < 2k, some segment differs in one member at most, so it meets
through its own hash or the hash of it less one member.

Each set also has a bitmap in which every member flips one bit. The bits in which two bitmaps differ
are no more than the members in which the sets differ, so a pair with too many of them is dropped
without a look at its members, and no pair that links is.

Buckets of equal hashes are worked off in two rounds. The first compares each member with the bucket's
smallest and with the one before it, and merges what links. The second compares all pairs of a bucket
that are not connected by then, tile by tile, so that large groups of copies cost little.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.graph import components
from postloom.llm.rows import add_python, small_side
from postloom.session import materialize

SHINGLE = 4
PERCENT = 85
# Sizes within a band differ by this factor at most.
BAND_RATIO = 1.6
# Segments beyond those that the bound asks for, as a share: so many light ones can be left out.
SLACK = 0.10
# Cost of one comparison of two sets, counted in index entries.
COMPARE_COST = 20.0
# Bits of a set's bitmap, in 64-bit words.
BITMAP_WORDS = 16
# Members of a bucket that the second round compares in one piece; larger buckets are cut into pairs of such pieces.
TILE = 4096
# Words whose hashes a worker remembers.
WORDS_KEPT = 250_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def shingle_set(text: str | None, length: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``length`` words, of all words if there are fewer; empty without words.

    Words are what stands between white space, A-Z in lower case.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(length, len(words))
    runs = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        runs = mix(runs * np.uint64(0x9E3779B97F4A7C15) + hashes[k:len(words) - width + 1 + k])
    return np.unique(runs)


def most_apart(a: int, b: int, percent: int = PERCENT) -> int:
    """How many members two linked sets of these sizes can have that are not in both."""
    return (100 - percent) * (a + b) // (100 + percent)


def largest_partner(size: int, percent: int = PERCENT) -> int:
    return size * 100 // percent


@dataclass(frozen=True)
class Band:
    """Sets of ``low`` to ``high`` members: ``segments`` parts, matched whole or up to one deletion."""

    number: int
    low: int
    high: int
    segments: int
    deletion: bool

    def salt(self) -> np.uint64:
        return np.uint64((self.number + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)


def allocate(number: int, low: int, high: int, rows: int, percent: int = PERCENT) -> Band:
    """The cheaper layout of a band that may hold ``rows`` sets.

    An index entry costs 1 and a comparison ``COMPARE_COST``. Unrelated sets are taken to share a given
    member with chance 1/50, so they meet in a segment of w members with chance 50 ** -w.
    """
    bound = most_apart(high, largest_partner(high, percent), percent)
    whole = bound + 1 + int(np.ceil(SLACK * bound))
    halves = bound // 2 + 1
    members = (low + high) / 2
    whole_cost = (bound + 1) * (1 + COMPARE_COST * rows * 50.0 ** -max(1.0, members / whole))
    deletion_cost = halves + members + halves * COMPARE_COST * rows * 50.0 ** -max(1.0, members / halves - 1)
    return Band(number, low, high, halves if deletion_cost < whole_cost else whole, deletion_cost < whole_cost)


@cache
def bands(rows: int, percent: int = PERCENT) -> tuple[Band, ...]:
    """Bands of all sizes that can link to another set; below the first, only equal sets link."""
    low = next(n for n in range(1, 1000) if most_apart(n, largest_partner(n, percent), percent) > 0)
    found = []
    while low < 2**31:
        high = max(low, int(low * BAND_RATIO) - 1)
        found.append(allocate(len(found), low, high, rows, percent))
        low = high + 1
    return tuple(found)


def entries(members: np.ndarray, layout: tuple[Band, ...], percent: int = PERCENT) -> np.ndarray:
    """Index entries of a set: those of its band, and of a smaller band that may hold partners."""
    size, made = len(members), []
    least = -(-size * percent // 100)
    for band in layout:
        if band.low > size:
            break
        if band.high < least:
            continue
        # In a smaller band the partner has at most the band's largest size.
        partner = min(band.high, size) if band.high < size else largest_partner(size, percent)
        bound = min(most_apart(size, partner, percent), most_apart(band.high, largest_partner(band.high, percent), percent))
        made.append(_band_entries(members, band, bound))
    return np.concatenate(made) if made else np.empty(0, np.uint64)


def _band_entries(members: np.ndarray, band: Band, bound: int) -> np.ndarray:
    scrambled = mix(members ^ band.salt())
    segment = (scrambled >> np.uint64(32)) % np.uint64(band.segments)
    order = np.argsort(segment, kind="stable")
    inside, values = segment[order], scrambled[order]
    first = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]]))
    counts = np.diff(np.append(first, len(inside)))
    sums = np.add.reduceat(values, first)
    place = mix(inside[first] + band.salt())
    if band.deletion:
        full = np.zeros(band.segments, np.uint64)
        full[inside[first]] = sums
        places = mix(np.arange(band.segments, dtype=np.uint64) + band.salt())
        less_one = full[inside] - values
        return np.concatenate([mix(full ^ places), mix(less_one ^ places[inside])])
    hashes = mix(sums ^ place)
    wanted = min(band.segments, bound + 1)
    if len(hashes) < wanted:
        empty = np.setdiff1d(np.arange(band.segments, dtype=np.uint64), inside[first])
        hollow = mix(mix(empty + band.salt()))
        hashes, counts = np.concatenate([hashes, hollow]), np.concatenate([counts, np.zeros(len(hollow), counts.dtype)])
    if len(hashes) > wanted:
        weight = (np.minimum(counts, 65535).astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16))
        hashes = hashes[np.argpartition(weight, len(weight) - wanted)[len(weight) - wanted:]]
    return hashes


def bitmap(members: np.ndarray) -> np.ndarray:
    """Parity of the members that fall on each bit."""
    bits = BITMAP_WORDS * 64
    place = (mix(members ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def sketch(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """Rows (doc_id, row_key, size, node, bits, entries): one per document, ``node`` standing for its set.

    ``node`` is a 64-bit hash of the set, null for an empty one; ``row_key`` hashes id and text.
    """
    rows = docs.count()
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("body"))
    base = base.withColumn("row_key", F.xxhash64("doc_id", "body"))

    def make():
        layout = bands(rows, percent)

        def work(bodies: list[str | None]) -> list[pa.Array]:
            sizes, nodes, parts, maps = [], [], [], []
            for body in bodies:
                members = shingle_set(body)
                sizes.append(len(members))
                nodes.append(int(mix(np.array([mix(members).sum(dtype=np.uint64) + np.uint64(len(members))])).view(np.int64)[0]) if len(members) else None)
                parts.append(entries(members, layout, percent))
                maps.append(bitmap(members))
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            flat = _longs(np.concatenate(parts)) if parts else pa.array([], pa.int64())
            bits = pa.ListArray.from_arrays(np.arange(len(maps) + 1, dtype=np.int32) * BITMAP_WORDS, pa.array(np.concatenate(maps) if maps else np.empty(0, np.int64)))
            return [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), bits, pa.ListArray.from_arrays(ends, flat)]

        return work

    return add_python(base, ["body"], "size bigint, node bigint, bits array<bigint>, entries array<bigint>", make, keep=["doc_id", "row_key"])


def _buckets(indexed: DataFrame) -> DataFrame:
    """Rows (entry, node, leader, previous, rank) for each node but the smallest of every entry; from rows sorted by both."""

    def run(batches):
        entry = leader = last = rank = None
        for batch in batches:
            keys, nodes = (batch.column(i).to_numpy() for i in range(2))
            if not len(keys):
                continue
            carried = entry is not None
            if carried:  # the last row seen goes before the batch
                keys, nodes = np.concatenate([[entry], keys]), np.concatenate([[last], nodes])
            fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])
            keys, nodes = keys[fresh], nodes[fresh]
            start = np.concatenate([[True], keys[1:] != keys[:-1]])
            head = np.maximum.accumulate(np.where(start, np.arange(len(keys)), 0))
            leaders, ranks = nodes[head], np.arange(len(keys)) - head
            if carried:
                leaders[head == 0], ranks = leader, ranks + np.where(head == 0, rank, 0)
            entry, leader, last, rank = keys[-1], leaders[-1], nodes[-1], ranks[-1]
            member = ~start
            if member.any():
                before = np.concatenate([nodes[:1], nodes[:-1]])
                columns = [keys[member], nodes[member], leaders[member], before[member], ranks[member]]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["entry", "node", "leader", "previous", "rank"])

    return indexed.mapInArrow(run, "entry bigint, node bigint, leader bigint, previous bigint, rank bigint")


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def _near(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and bitmaps leave room for a link."""
    one, two = (maps.select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab")
    met = pairs.join(one, "a").join(two, "b")
    met = met.filter(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
    differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return met.filter(differ * (100 + percent) <= (100 - percent) * (F.col("size_a") + F.col("size_b"))).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough, compared member by member."""
    one = sets.select(F.col("node").alias("a"), F.col("members").alias("one"))
    two = sets.select(F.col("node").alias("b"), F.col("members").alias("two"))
    met = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("one", "two"))
    return met.filter(100 * common >= percent * (F.size("one") + F.size("two") - common)).select("a", "b")


def _apart(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one bucket with different roots, whose sizes and bitmaps leave room for a link.

    ``members`` has rows (entry, node, rank, root, size, bits, pieces); a bucket of several pieces is compared as all
    pairs of its pieces, each in a group of its own.
    """
    piece = F.floor(F.col("rank") / TILE)
    tiles = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1),
        lambda other: F.struct(F.least(piece, other).alias("low"), F.greatest(piece, other).alias("high")),
    )
    rows = members.select("entry", F.inline(tiles), piece.alias("piece"), "node", "root", "size", "bits")
    rows = rows.repartition("entry", "low", "high").sortWithinPartitions("entry", "low", "high", "root")

    def compare(parts: list[list[np.ndarray]]) -> pa.RecordBatch | None:
        piece, node, root, size, bits = (np.concatenate([p[i] for p in parts]) for i in range(3, 8))
        two_pieces = piece[0] != piece[-1] or (piece != piece[0]).any()
        # Smaller groups of connected members first: each is compared with all that come after it.
        _, group, count = np.unique(root, return_inverse=True, return_counts=True)
        order = np.lexsort((group, count[group]))
        piece, node, group, size, bits = (x[order] for x in (piece, node, group, size, bits))
        ends = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
        ends = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
        found = []
        for k in range(len(node)):
            rest = slice(ends[k], len(node))
            if ends[k] == len(node):
                break
            apart = np.bitwise_count(bits[k] ^ bits[rest]).sum(axis=1, dtype=np.int64)
            near = apart * (100 + percent) <= (100 - percent) * (size[k] + size[rest])
            near &= 100 * np.minimum(size[k], size[rest]) >= percent * np.maximum(size[k], size[rest])
            if two_pieces:
                near &= piece[rest] != piece[k]
            if near.any():
                other = node[rest][near]
                found.append(np.stack([np.minimum(node[k], other), np.maximum(node[k], other)]))
        if not found:
            return None
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def run(batches):
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(7)] + [batch.column(7).flatten().to_numpy().view(np.uint64).reshape(-1, BITMAP_WORDS)]
            fresh = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
            if held and any(held[-1][i][-1] != columns[i][0] for i in range(3)):
                fresh = np.concatenate([[0], fresh])
            for start, stop in zip(np.concatenate([[0], fresh]), np.append(fresh, batch.num_rows)):
                if start in fresh and held:
                    if (made := compare(held)) is not None:
                        yield made
                    held = []
                if stop > start:
                    held.append([c[start:stop] for c in columns])
        if held and (made := compare(held)) is not None:
            yield made

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _rows_with_roots(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """Rows (doc_id, row_key, size, node, root): ``root`` is equal for sets that reach each other, null for empty sets."""
    rows = materialize(sketch(docs, doc_id, text, percent), "sketches")
    # Copies become one row a node in every task, so a set that a third of all rows share sends its entries once a task.
    once = rows.filter("node IS NOT NULL").groupBy("node").agg(F.first("entries").alias("entries"))
    indexed = once.select(F.explode("entries").alias("entry"), "node")
    buckets = materialize(_buckets(indexed.repartition("entry").sortWithinPartitions("entry", "node")), "buckets")
    nodes = buckets.select(F.explode(F.array("node", "leader")).alias("node")).distinct()
    picked = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("row_key").alias("row_key")).join(nodes, "node")
    picked = materialize(picked, "picked")
    bodies = docs.select(F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("row_key"), F.col(f"`{text}`").alias("body")).join(small_side(picked), "row_key").dropDuplicates(["row_key"])

    def make():
        def work(texts: list[str | None]) -> list[pa.Array]:
            parts = [shingle_set(t) for t in texts]
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            return [pa.ListArray.from_arrays(ends, _longs(np.concatenate(parts)) if parts else pa.array([], pa.int64()))]

        return work

    sets = materialize(add_python(bodies, ["body"], "members array<bigint>", make, keep=["node"]), "sets")
    maps = rows.filter("node IS NOT NULL").groupBy("node").agg(F.first("size").alias("size"), F.first("bits").alias("bits")).join(picked, "node")
    maps = materialize(maps.select("node", "size", "bits"), "bitmaps")
    first = _pairs(buckets, "leader", "node").unionAll(_pairs(buckets, "previous", "node")).distinct()
    tried = materialize(_near(first, maps, percent), "pairs")
    groups = materialize(components(_linked(tried, sets, percent)), "groups")
    members = buckets.select("entry", "node", "rank").unionAll(
        buckets.filter("rank = 1").select("entry", F.col("leader").alias("node"), F.lit(0).cast("bigint").alias("rank"))
    )
    known = members.join(groups, "node", "left").select("entry", "node", "rank", F.coalesce("root", "node").alias("root"))
    open_buckets = known.groupBy("entry").agg(F.max("rank").alias("last"), (F.min("root") != F.max("root")).alias("apart"))
    # In buckets of two the first round has compared all there is.
    open_buckets = open_buckets.filter(F.col("apart") & (F.col("last") > 1)).select("entry", (F.floor(F.col("last") / TILE) + 1).alias("pieces"))
    left = known.join(open_buckets, "entry").join(maps, "node")
    pairs = materialize(_apart(left, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    found = materialize(_linked(pairs, sets, percent), "links")
    if not found.isEmpty():
        stars = groups.select(F.col("node").alias("a"), F.col("root").alias("b"))
        groups = materialize(components(stars.unionAll(found)), "groups")
    joined = rows.select("doc_id", "row_key", "size", "node").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return materialize(joined, "rows-with-roots")


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``row_key``, ``size`` (of its set) and ``component_id``.

    Sets link when 100 * intersection >= ``percent`` * union; ``component_id`` is the smallest id that a row
    reaches over links, its own included. Rows without words have size 0 and link with nothing; equal sets, so
    repeated rows too, always link. Null ids are passed over in the minimum. Other columns are not read.
    """
    joined = _rows_with_roots(docs, doc_id, text, percent)
    smallest = joined.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    own = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.join(smallest, "root", "left").select("doc_id", "row_key", "size", own.alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, null ids last; of a row that repeats, one.

    Rows without words belong to no group and all stay. Columns stay as they are.
    """
    joined = _rows_with_roots(docs, doc_id, text, percent).filter("root IS NOT NULL")
    first = joined.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("first"))
    dropped = joined.join(first, "root").filter("row_key <> first.row_key").select("row_key").distinct()
    dropped = materialize(dropped.withColumnRenamed("row_key", "dropped_key"), "dropped-rows")
    keyed = docs.withColumn("__row_key", F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    kept = keyed.join(small_side(dropped), F.col("__row_key") == F.col("dropped_key"), "left_anti")
    repeated = joined.groupBy("row_key").count().filter("count > 1").select(F.col("row_key").alias("repeated_key"))
    repeated = materialize(repeated, "repeated-rows")
    if not repeated.isEmpty():
        again = F.col("__row_key") == F.col("repeated_key")
        kept = kept.join(repeated, again, "left_anti").unionByName(kept.join(repeated, again, "left_semi").dropDuplicates(["__row_key"]))
    return kept.drop("__row_key")
