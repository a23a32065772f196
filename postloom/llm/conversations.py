"""Repair of conversation structure by target alignment.

A conversation should read, by the first letters of its roles, as nothing or as ``s?(ua)+``. Its turns are
aligned (Wagner and Fischer) to the target string of every feasible length; cells that no alignment within the
best cost so far can pass are left out (Ukkonen's band). Of all cheapest alignments the one with the least
audit, the string of its edits, is taken.

Turns stream through the tasks in order, in stretches of ``STRETCH`` turns. What the grammar expects next is one of
four states, so a stretch is aligned from each live state to each state behind it, and the cheapest way to
each is carried on. A conversation of up to ``STRETCH`` turns is a single alignment. Conversations of many turns
are cut by turn number; their blocks are aligned by different tasks for every state they may begin in, and
short summaries are chained. No task holds a conversation's texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.rows import prepare, small_side
from postloom.session import materialize

# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# Turns that are aligned at once.
STRETCH = 32
# Turn numbers of one block, and rows beyond which a conversation of one block counts as long.
BLOCK_TURNS = 4_096
LONG_ROWS = 100_000

# What the grammar has read: nothing, only s, a u last, an a last. It may end after nothing or after an a.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

# Faults of a row: none, blank, duplicate, truncated.
FINE, BLANK, DUPLICATE, CUT = "-BDT"
BLANKS = r"\x20\x09-\x0D"
INFINITE = 10**9


# --- alignment of a stretch ---


def targets(entry: int, length: int) -> list[str]:
    """The strings of ``length`` letters that the grammar may read from ``entry``."""
    first = "au" if entry == USER else "ua"
    plain = (first * (length // 2 + 1))[:length]
    return [plain, "s" + plain[:-1]] if entry == START and length else [plain]


def exit_of(entry: int, target: str) -> int:
    return AFTER[target[-1]] if target else entry


def _spare(entry: int, leave: int, turns: int) -> int:
    """The cost of deleting all turns and inserting what leads from one state to the other."""
    if entry == leave:
        return DELETE * turns
    if leave in (START, SYSTEM):
        return INFINITE
    inserts = 1 if leave == USER or entry == USER else 2
    return DELETE * turns + INSERT * inserts


def _least_cost(turns: int, undeletable: int, length: int) -> int:
    """A bound from below for the cost of a target of ``length``; ``undeletable`` turns may stay."""
    if length <= undeletable:
        return DELETE * (turns - length)
    return DELETE * (turns - undeletable) + INSERT * (length - undeletable)


def align_to(initials: str, faults: str, target: str, most: int) -> tuple[int, str] | None:
    """The least cost of turning the turns into ``target`` and the least audit of that cost; None above ``most``."""
    turns, length = len(initials), len(target)
    off = length - turns
    # On diagonal d = letters - turns, the way there costs at least 5d or -2d, and the way on likewise.
    low = max(-turns, -((most - INSERT * off) // (INSERT + DELETE)))
    high = min(length, (most + DELETE * off) // (INSERT + DELETE))
    if low > min(0, off) or high < max(0, off):
        return None
    insert = [INFINITE if letter == "s" else INSERT for letter in target]
    blank_row = [INFINITE] * (length + 2)
    table = [blank_row] * (turns + 1)
    for i in range(turns, -1, -1):
        row = table[i] = list(blank_row)
        below = table[i + 1] if i < turns else blank_row
        fault = faults[i] if i < turns else BLANK
        for j in range(min(length, i + high), max(0, i + low) - 1, -1):
            best = below[j] + DELETE if i < turns else (0 if j == length else INFINITE)
            if j < length:
                best = min(best, row[j + 1] + insert[j])
                if fault not in (BLANK, DUPLICATE) and (step := _change(initials[i], target[j])) is not None:
                    best = min(best, below[j + 1] + step + (TRUNCATED if fault == CUT else 0))
            row[j] = best
    if table[0][0] > most:
        return None
    audit, i, j = [], 0, 0
    while i < turns or j < length:
        here = table[i][j]
        if i < turns and table[i + 1][j] + DELETE == here:
            audit.append("D")
            i += 1
        elif j < length and table[i][j + 1] + insert[j] == here:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if initials[i] == target[j] else "R")
            i, j = i + 1, j + 1
    return table[0][0], "".join(audit)


def _change(initial: str, letter: str) -> int | None:
    return 0 if initial == letter else REROLE if letter != "s" else None


@lru_cache(maxsize=50_000)
def align(initials: str, faults: str, entry: int, last: bool) -> dict[int, tuple[int, str]]:
    """For each state that the grammar can be in behind these turns (where it may end, if they are the ``last``), the
    least cost and the least audit of it."""
    turns = len(initials)
    may_stay = sum(f not in (BLANK, DUPLICATE) for f in faults)
    leaves = ENDS if last else (START, SYSTEM, USER, ASSISTANT)
    best: dict[int, tuple[int, str]] = {}
    most = {leave: _spare(entry, leave, turns) for leave in leaves}
    lengths = [(cost, n) for n in range(turns * 2 + 3) if (cost := _least_cost(turns, may_stay, n)) <= max(most.values())]
    for cost, length in sorted(lengths):
        for target in targets(entry, length):
            leave = exit_of(entry, target)
            if leave not in most or cost > most[leave]:
                continue
            found = align_to(initials, faults, target, min(most[leave], DELETE * turns + INSERT * length))
            if found is not None and (leave not in best or found < best[leave]):
                best[leave] = found
                most[leave] = found[0]
    return best


def repaired(rows: Iterable[tuple[str, str, str]], audit: str, state: int) -> Iterator[tuple[str, str, str, str | None]]:
    """(edit, role, text, former role) of the edits of ``audit``, deleted turns too; rows are (initial, role, text)."""
    rows = iter(rows)
    for edit in audit:
        letter = "a" if state == USER else "u"
        if edit == "I":
            yield edit, ROLE[letter], "", None
        else:
            initial, role, text = next(rows)
            if edit == "D":
                yield edit, role, text, role
                continue
            if edit == "K":
                letter = initial
            yield edit, role if edit == "K" else ROLE[letter], text, role
        state = AFTER[letter]


# --- chains of stretches ---


class Way:
    """The cheapest way to a state: its cost, the way before it, and the audit of the last stretch or block."""

    __slots__ = ("cost", "before", "audit", "entry", "hashed", "lines")

    def __init__(self, cost: int = 0, before: Way | None = None, audit: str = "", entry: int = START) -> None:
        self.cost, self.before, self.audit, self.entry = cost, before, audit, entry
        self.hashed, self.lines = (before.hashed, before.lines) if before else (None, 0)

    def is_better(self, other: Way) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        mine, theirs, one, two = [], [], self, other
        while one is not two:  # both have as many parts
            mine.append(one.audit)
            theirs.append(two.audit)
            one, two = one.before, two.before
        return "".join(reversed(mine)) < "".join(reversed(theirs))

    def write(self, rows: list[tuple[str, str, str]]) -> None:
        """Go on with the digest of the repaired lines."""
        self.hashed = self.hashed.copy()
        for edit, role, text, _ in repaired(rows, self.audit, self.entry):
            if edit != "D":
                self.hashed.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
                self.lines += 1

    def parts(self) -> list[tuple[int, str]]:
        """(entry state, audit) of all parts in order."""
        made, way = [], self
        while way.before is not None:
            made.append((way.entry, way.audit))
            way = way.before
        return made[::-1]


Costs = dict[int, dict[int, tuple[int, str]]]


def onward(ways: dict[int, Way], costs: Callable[[int], dict[int, tuple[int, str]]]) -> dict[int, Way]:
    """The cheapest ways behind the next part, given its (cost, audit) by entry and exit."""
    made: dict[int, Way] = {}
    for entry, way in ways.items():
        for leave, (cost, audit) in costs(entry).items():
            new = Way(way.cost + cost, way, audit, entry)
            if leave not in made or new.is_better(made[leave]):
                made[leave] = new
    return made


def final(ways: dict[int, Way]) -> Way:
    best = None
    for state in ENDS:
        if state in ways and (best is None or ways[state].is_better(best)):
            best = ways[state]
    return best


class Counts:
    """Faults, gaps and breaks of a run of rows, and what joins them to the next run."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = self.rows = 0
        self.lowest = self.highest = None
        self.first = self.final = ""

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        self.rows += 1
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == CUT
        self.illegal += bool(self.final) and self.final + initial not in LEGAL
        self.first, self.final = self.first or initial, initial
        if turn is not None and turn != self.highest:
            self.lowest, self.highest, self.distinct = turn if self.lowest is None else self.lowest, turn, self.distinct + 1

    def extend(self, blank, duplicate, truncated, illegal, distinct, lowest, highest, first, last) -> None:
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.illegal += illegal + (bool(self.final) and bool(first) and self.final + first not in LEGAL)
        self.final, self.distinct = last or self.final, self.distinct + distinct
        if highest is not None:
            self.lowest, self.highest = lowest if self.lowest is None else self.lowest, highest

    @property
    def gaps(self) -> int:
        return 0 if self.highest is None else self.highest - self.lowest + 1 - self.distinct

    def summary(self) -> tuple:
        return self.blank, self.duplicate, self.truncated, self.illegal, self.distinct, self.lowest, self.highest, self.first, self.final


def _stretches(rows: Iterable[tuple], counts: Counts, repeats: bool) -> Iterator[tuple[list[tuple], bool]]:
    """Lists of (initial, role, text, fault) and whether they are the last; sets duplicates if ``repeats`` is to be found."""
    seen: set[bytes] = set()

    def judged() -> Iterator[tuple[str, str, str, str]]:
        for turn, role, text, initial, fault, there in rows:
            if not there:
                continue
            if repeats and fault != BLANK:
                digest = hashlib.md5(f"{len(role)}:{role}{text}".encode(), usedforsecurity=False).digest()
                if digest in seen:
                    fault = DUPLICATE
                seen.add(digest)
            counts.add(turn, initial, fault)
            yield initial, role, text, fault

    turns = judged()
    ahead = list(islice(turns, STRETCH))
    while ahead:
        now, ahead = ahead, list(islice(turns, STRETCH))
        yield now, not ahead


def _shape(stretch: list[tuple]) -> tuple[str, str]:
    return "".join(r[0] for r in stretch), "".join(r[3] for r in stretch)


# --- tables ---


def _rows(turns: DataFrame, conv_id: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    """(conv, turn, block, role, text, initial, fault, there); nulls of role and text are one blank."""
    known = turns.select(
        F.col(f"`{conv_id}`").alias("conv"),
        F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
        (F.coalesce(F.col(f"`{present}`"), F.lit(False)) if present else F.lit(True)).alias("there"),
    )
    blank = ~F.col("text").rlike(f"[^{BLANKS}]")
    cut = ~F.col("text").rlike(rf"[.!?][{BLANKS}]*\z")
    return known.withColumns(
        {
            "text": F.when(F.col("there"), F.col("text")).otherwise(""),
            "block": F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(2**62))),
            "initial": F.when(F.col("role") == "", "-").otherwise(F.substring("role", 1, 1)),
            "fault": F.when(blank, BLANK).when(cut, CUT).otherwise(FINE),
        }
    )


def _in_order(df: DataFrame, deal: list[str], order: list[str], out: str | T.StructType, work: Callable) -> DataFrame:
    """Rows of ``out`` that ``work`` yields as tuples from the rows of each group of ``deal``, read in ``order`` as a stream."""
    prepare(df.sparkSession)
    schema = T.StructType.fromDDL(out) if isinstance(out, str) else out
    width, columns = len(deal), [*deal, *(c for c in df.columns if c not in deal)]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        made = (row for key, group in groupby(rows, key=lambda r: r[:width]) for row in work(key, (r[width:] for r in group)))
        while block := list(islice(made, 512)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), arrow)], schema=arrow)

    dealt = df.select(*columns).repartition(*deal).sortWithinPartitions(*deal, *order)
    return dealt.mapInArrow(run, schema)


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_READ = ["conv", "turn", "role", "text", "initial", "fault", "there"]


def _result(counts: Counts, cost: int, audit: str, digest: str) -> tuple:
    return counts.gaps, counts.blank, counts.duplicate, counts.truncated, counts.illegal, cost, audit, digest


def _short(rows: DataFrame, conv_type: T.DataType) -> DataFrame:
    """Results of conversations that one task reads in order, turn by turn."""

    def work(key, group):
        counts, start = Counts(), Way()
        start.hashed, ways = hashlib.sha256(), {START: start}
        for stretch, last in _stretches(group, counts, repeats=True):
            initials, faults = _shape(stretch)
            ways = onward(ways, lambda entry: align(initials, faults, entry, last))
            if last:
                ways = {START: final(ways)}
            for way in ways.values():
                way.write([r[:3] for r in stretch])
        way = final(ways)
        yield *key, *_result(counts, way.cost, "".join(a for _, a in way.parts()), way.hashed.hexdigest())

    schema = T.StructType([T.StructField("conv", conv_type), *T.StructType.fromDDL(RESULT)])
    return _in_order(rows.select(*_READ), ["conv"], ["turn", "role", "text"], schema, work)


def _long(rows: DataFrame, conv_type: T.DataType) -> tuple[DataFrame, DataFrame]:
    """Results of conversations of many blocks, and (conv, block, entry, audit) of each block.

    Duplicates are numbered per role and text. Every block is aligned from each state it may be entered in; the
    summaries of a conversation's blocks are chained in order. Then the blocks are repaired apart and the lines
    of a conversation are hashed as a stream, in order: a digest can only be taken by one task.
    """
    from pyspark.sql import Window

    same = Window.partitionBy("conv", "role", "text", "there").orderBy("turn")
    repeat = F.col("there") & (F.col("fault") != BLANK) & (F.row_number().over(same) > 1)
    rows = materialize(rows.withColumn("fault", F.when(repeat, DUPLICATE).otherwise(F.col("fault"))), "long-conversations")

    def summarize(key, group):
        counts, starts = Counts(), (START, SYSTEM, USER, ASSISTANT)
        ways = {entry: {entry: Way(entry=entry)} for entry in starts}
        for stretch, _ in _stretches(group, counts, repeats=False):
            initials, faults = _shape(stretch)
            ways = {entry: onward(now, lambda state: align(initials, faults, state, False)) for entry, now in ways.items()}
        found = [
            {"entry": entry, "leave": leave, "cost": way.cost, "audit": "".join(a for _, a in way.parts())}
            for entry, now in ways.items()
            for leave, way in now.items()
        ]
        yield *key, *counts.summary(), found

    conv = T.StructField("conv", conv_type)
    summary = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, distinct bigint, lowest bigint, highest bigint, first string, last string"
    ways = "ways array<struct<entry: int, leave: int, cost: bigint, audit: string>>"
    schema = T.StructType([conv, *T.StructType.fromDDL(f"block bigint, {summary}, {ways}")])
    blocks = _in_order(rows.select(*_READ, "block"), ["conv", "block"], ["turn", "role", "text"], schema, summarize)

    def chain(key, group):
        counts, ways, names = Counts(), {START: Way()}, []
        for block, *numbers, found in group:
            counts.extend(*numbers)
            by_entry: Costs = {}
            for w in found:
                by_entry.setdefault(w["entry"], {})[w["leave"]] = (w["cost"], w["audit"])
            ways = onward(ways, by_entry.__getitem__)
            names.append(block)
        way = final(ways)
        parts = [{"block": block, "entry": entry, "audit": audit} for block, (entry, audit) in zip(names, way.parts())]
        yield *key, *_result(counts, way.cost, "".join(a for _, a in way.parts()), ""), parts

    schema = T.StructType([conv, *T.StructType.fromDDL(f"{RESULT}, parts array<struct<block: bigint, entry: int, audit: string>>")])
    chained = materialize(_in_order(blocks, ["conv"], ["block"], schema, chain), "chained-conversations")
    audits = chained.select("conv", F.inline("parts"))

    def digest(key, group):
        hashed, lines = hashlib.sha256(), 0
        for _, _, role, text in group:
            if role is not None:
                hashed.update((("\n" if lines else "") + f"{role}:{text}").encode())
                lines += 1
        yield *key, hashed.hexdigest()

    kept = _edited(rows, audits, conv_type).filter("edit <> 'D'").select("conv", "block", "place", "role", "text")
    named = chained.select("conv", F.lit(-(2**63)).alias("block"), F.lit(-1).cast("bigint").alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    hashes = _in_order(kept.unionByName(named), ["conv"], ["block", "place"], T.StructType([conv, T.StructField("sha", T.StringType())]), digest)
    joined = chained.drop("parts").join(hashes.withColumnRenamed("conv", "other"), F.col("conv").eqNullSafe(F.col("other")), "left")
    return joined.withColumn("repaired_sha256", F.col("sha")).drop("other", "sha"), audits


def _edited(rows: DataFrame, audits: DataFrame, conv_type: T.DataType) -> DataFrame:
    """(conv, block, place, edit, role, text, former role) of all edits; the audit of a block streams in before its rows."""
    lead = audits.select(
        "conv", "block", F.lit(0).alias("kind"), F.col("entry").cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("initial")
    )
    body = rows.filter("there").select("conv", "block", F.lit(1).alias("kind"), "turn", "role", "text", "initial")

    def work(key, group):
        _, entry, _, audit, _ = next(group)
        turns = ((initial, role, text) for _, _, role, text, initial in group)
        for place, (edit, role, text, former) in enumerate(repaired(turns, audit, entry)):
            yield *key, place, edit, role, text, former

    schema = T.StructType([T.StructField("conv", conv_type), *T.StructType.fromDDL("block bigint, place bigint, edit string, role string, text string, former_role string")])
    return _in_order(lead.unionByName(body), ["conv", "block"], ["kind", "turn", "role", "text"], schema, work)


def _long_ids(rows: DataFrame) -> DataFrame:
    """Conversations of several blocks or very many rows; found from their ids and turn numbers alone."""
    by_conv = rows.groupBy("conv").agg(F.min("block").alias("low"), F.max("block").alias("high"), F.count("*").alias("rows"))
    return materialize(by_conv.filter((F.col("low") != F.col("high")) | (F.col("rows") > LONG_ROWS)).select(F.col("conv").alias("long")), "long-ids")


def audit(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None
) -> DataFrame:
    """One row per conversation: its id, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``
    and ``repaired_sha256``.

    Turns are read by number, nulls first; rows of one number by role and text, so repeated rows stand side by
    side. A null role or text counts as one blank, a null id as an id like others. A role is known by its first
    letter; an empty role fits no letter and has to change. Rows in which the boolean column ``present`` is
    not true only name their conversation; a conversation without other rows has zeros, an empty audit and the
    digest of an empty text. An empty table gives an empty result; columns not named are left out.
    """
    rows = _rows(turns, conv_id, turn, role, text, present)
    conv_type = turns.schema[conv_id].dataType
    long_ids = _long_ids(rows)
    if not long_ids.count():
        found = _short(rows, conv_type)
    else:
        is_long = F.col("conv").eqNullSafe(F.col("long"))
        some = small_side(long_ids)
        found = _short(rows.join(some, is_long, "left_anti"), conv_type).unionByName(_long(rows.join(some, is_long, "left_semi"), conv_type)[0])
    return found.withColumnRenamed("conv", conv_id)


def repaired_turns(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None
) -> DataFrame:
    """The turns after repair: the id, ``block`` and ``place`` (their order), ``edit`` (K, R, I, or D for what goes), ``role``,
    ``text`` and ``former_role`` (null for inserted turns). Rules as for :func:`audit`."""
    rows = _rows(turns, conv_id, turn, role, text, present)
    conv_type = turns.schema[conv_id].dataType
    long_ids = _long_ids(rows)
    some, is_long = small_side(long_ids), F.col("conv").eqNullSafe(F.col("long"))
    short = rows.join(some, is_long, "left_anti").withColumn("block", F.lit(0).cast("bigint"))
    whole = _short(short, conv_type).select("conv", F.lit(0).cast("bigint").alias("block"), F.lit(START).alias("entry"), "audit")
    edited = _edited(short, whole, conv_type)
    if long_ids.count():
        long = rows.join(some, is_long, "left_semi")
        edited = edited.unionByName(_edited(long, _long(long, conv_type)[1], conv_type))
    return edited.withColumnRenamed("conv", conv_id)
