"""Stateful stream operators: relabel counts, seeded dedup, and the live fold with author caps.

State lives in the RocksDB store of :mod:`postloom.session` and is keyed, so it grows with the ids and not with
the rows. A seed enters as initial state in the first batch and is not read again.
"""

from __future__ import annotations

import heapq
import json
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from postloom.operators.observations import RAW_AUTHOR_CAP, admissible
from postloom.session import use_state_store

# Spark starts a Python process on the driver that loads a processor to ask for its state. Shipped packages do not reach
# it, so what is defined here travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED_ORDER = -1
# Groups that a task holds before it hands them on.
GROUPS_HELD = 20_000
# Rows that a task packs by bucket before it hands them on.
ROWS_PACKED = 500_000
# Buckets of events whose labels are kept together; a checkpoint holds for one number.
EVENT_BUCKETS = 65_536
DELTA = Row("label", "delta")

Merge = Callable[[dict[str, Any], dict[str, Any]], dict[str, Any]]


def reduce_in_tasks(rows: DataFrame, keys: list[str], merge: Merge) -> DataFrame:
    """Rows of one key that a task meets become one by ``merge(earlier, later)``, so a busy key is a few rows per task.

    A task that holds many keys hands them on and starts anew; what follows has to merge again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[str, Any]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                held[key] = merge(held[key], row) if key in held else row
            if len(held) >= GROUPS_HELD:
                yield pa.RecordBatch.from_pylist(list(held.values()), schema)
                held = {}
        if held:
            yield pa.RecordBatch.from_pylist(list(held.values()), schema)

    return rows.mapInArrow(run, rows.schema)


class _Processor(StatefulProcessor):
    def close(self) -> None:
        pass


class _FirstOfKey(_Processor):
    """Emits the first row of a key, unless its initial state says that it was seen."""

    def __init__(self, columns: list[str], order: str | None) -> None:
        self.columns, self.order = columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if self.seen.exists():
            return
        self.seen.update((True,))
        first = next(rows) if self.order is None else min(rows, key=lambda r: r[self.order])
        yield Row(*self.columns)(*(first[c] for c in self.columns))

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self.seen.update((True,))


def first_of_key(stream: DataFrame, key: str, seed: DataFrame, order: str | None = None) -> DataFrame:
    """First row per ``key`` over the whole life of the stream, except keys of ``seed``.

    ``seed`` (a column ``key``) becomes the operator's state in the first batch of a checkpoint; later batches and
    restarts neither read nor join it. ``order`` names the column that decides between rows of one batch.
    """
    use_state_store(stream.sparkSession)
    known = seed.select(key).distinct().groupBy(key)
    processor = _FirstOfKey(stream.columns, order)

    def earlier(one: dict[str, Any], two: dict[str, Any]) -> dict[str, Any]:
        return two if order is not None and two[order] < one[order] else one

    return reduce_in_tasks(stream, [key], earlier).groupBy(key).transformWithState(processor, stream.schema, "Append", "None", initialState=known)


def _packed(answers: DataFrame) -> DataFrame:
    """Rows (``bucket, event_id, ord, label``) as one row a bucket and task, ``rows`` being JSON with lists of the other columns: the
    latest answer of each event a task meets; a task that holds many rows hands them on and starts anew."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        order = [(c, "ascending") for c in ("bucket", "event_id", "ord")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start")).combine_chunks()
        events = rows.column("event_id")
        one, two = events[:-1], events[1:]
        same = pc.coalesce(pc.equal(one, two), pc.and_(pc.is_null(one), pc.is_null(two)))
        rows = rows.filter(pa.chunked_array([*pc.invert(same).chunks, pa.array([True])], pa.bool_())).combine_chunks()
        buckets = rows.column("bucket").to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1])
        ends = pa.array(np.append(starts, len(buckets)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays(rows.column(c).chunks)) for c in ("event_id", "ord", "label")]
        return pa.RecordBatch.from_arrays([pa.array(buckets[starts], pa.int32()), *lists], names=["bucket", "event_id", "ord", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= ROWS_PACKED:
                yield pack(held)
                held, rows = [], 0
        if held:
            yield pack(held)

    lists = "bucket int, event_id array<string>, ord array<bigint>, label array<string>"
    packed = answers.select("bucket", "event_id", "ord", "label").mapInArrow(run, lists)
    return packed.select("bucket", F.to_json(F.struct("event_id", "ord", "label")).alias("rows"))


class _RelabelDeltas(_Processor):
    """Holds the latest successful labels of the events of a bucket and emits what changes of them do to the counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Lists of events, of their ord and of their labels, as JSON.
        self.latest = handle.getValueState("latest", "held string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        stored = self.latest.get()
        events, orders, labels = json.loads(stored[0]) if stored else ((), (), ())
        held = dict(zip(events, zip(orders, labels)))
        deltas: Counter[str | None] = Counter()
        for row in rows:
            met = json.loads(row["rows"])
            for event, order, label in zip(met["event_id"], met["ord"], met["label"]):
                known = held.get(event)
                if known is not None:
                    if order < known[0]:
                        continue  # an older answer that arrives late changes nothing
                    deltas[known[1]] -= 1
                held[event] = (order, label)
                deltas[label] += 1
        self._hold(list(held), *zip(*held.values()))
        for label, delta in deltas.items():
            if delta:
                yield DELTA(label, delta)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        met = json.loads(initialState["rows"])
        self._hold(met["event_id"], [SEED_ORDER] * len(met["event_id"]), met["label"])

    def _hold(self, *lists: Any) -> None:
        self.latest.update((json.dumps(lists, ensure_ascii=False, separators=(",", ":")),))


def relabel_deltas(outcomes: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """(label, delta) of a stream of outcomes (``event_id, ord, ok, label``): +1 for the label an event gets, -1 for the one it had.

    Failures change nothing. Of answers to one event the greatest ``ord`` counts (none counts as the least), however they are
    spread over batches; several in one batch are one change. State is kept for ``EVENT_BUCKETS`` buckets of events, since a call
    for the state of a key costs as much as reading hundreds of events; changes within a bucket and batch come summed.
    ``seed`` (``event_id, label``) holds the labels events have before the stream.
    """
    use_state_store(outcomes.sparkSession)
    bucket = F.pmod(F.xxhash64("event_id"), F.lit(EVENT_BUCKETS)).cast("int").alias("bucket")
    order = F.coalesce(F.col("ord").cast("bigint"), F.lit(SEED_ORDER).cast("bigint")).alias("ord")
    answered = _packed(outcomes.filter("ok").select(bucket, F.col("event_id").cast("string"), order, F.col("label").cast("string"))).groupBy("bucket")
    before = None
    if seed is not None:
        known = seed.filter(F.col("label").isNotNull()).groupBy(F.col("event_id").cast("string").alias("event_id")).agg(F.max("label").alias("label"))
        known = known.groupBy(bucket).agg(F.collect_list(F.struct("event_id", "label")).alias("rows"))
        lists = F.to_json(F.struct(F.col("rows.event_id").alias("event_id"), F.col("rows.label").alias("label")))
        before = known.select("bucket", lists.alias("rows")).groupBy("bucket")
    return answered.transformWithState(_RelabelDeltas(), "label string, delta int", "Append", "None", initialState=before)


class RelabelCounts:
    """Running label counts of an outcome stream, with relabels taken back.

    Each micro-batch adds one small file of summed changes under the ids of run and batch, so a replay
    overwrites its own file. ``counted`` tells whether seeded labels count (they always give way when an event of
    theirs is labeled anew).
    """

    def __init__(self, path: str, checkpoint: str, seed: DataFrame | None = None, counted: bool = True) -> None:
        self.path, self.checkpoint, self.seed, self.counted = path, checkpoint, seed, counted

    def run(self, outcomes: DataFrame, **trigger: Any) -> None:
        """Take in what is available, or what ``trigger`` says."""

        def add(batch: DataFrame, batch_id: int) -> None:
            sums = batch.groupBy("label").agg(F.sum("delta").alias("delta")).filter("delta <> 0")
            sums.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

        query = (
            relabel_deltas(outcomes, self.seed).writeStream.foreachBatch(add)
            .option("checkpointLocation", self.checkpoint).trigger(**(trigger or {"availableNow": True})).start()
        )
        query.awaitTermination()

    def counts(self, outcomes: DataFrame) -> DataFrame:
        """(label, count) so far; labels that fell back to nothing are left out. ``outcomes`` names the session."""
        spark = outcomes.sparkSession
        changes = spark.read.schema("label string, delta bigint").parquet(f"{self.path}/batch_id=*")
        if self.seed is not None and self.counted:
            known = self.seed.filter(F.col("label").isNotNull()).groupBy("event_id").agg(F.max("label").alias("label"))
            changes = changes.unionByName(known.select("label", F.lit(1).cast("bigint").alias("delta")))
        return changes.groupBy("label").agg(F.sum("delta").alias("count")).filter("count <> 0")


FOLD_COLUMNS = ("kind", "event_id", "pubkey", "created_at", "content", "relay", "seq", "sightings")
ADMITTED, CHANGE = Row(*FOLD_COLUMNS), Row("kind", "deal", *FOLD_COLUMNS[1:])
_FIELDS = "event_id string, pubkey string, created_at bigint, content string, relay string, seq bigint, sightings bigint"


class _EventFold(_Processor):
    """Of an event: its first observation, then one row per new relay and batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.relays = handle.getMapState("relays", "relay string", "seen boolean")
        self.event = handle.getValueState("event", "known boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # Per relay: its first place and the number of sightings.
        places: dict[str | None, list] = {}
        first = None
        for row in rows:
            if first is None or row["seq"] < first["seq"]:
                first = row
            held = places.setdefault(row["relay"], [row["seq"], 0])
            held[0], held[1] = min(held[0], row["seq"]), held[1] + row["sightings"]
        if not self.event.exists():
            self.event.update((True,))
            yield CHANGE("event", first["pubkey"], key[0], first["pubkey"], first["created_at"], first["content"], None, first["seq"], 0)
        for relay, (seq, sightings) in sorted(places.items(), key=lambda p: p[1]):
            # Relays known before are listed for their sightings alone.
            name = "" if relay is None else "r" + relay
            fresh = not self.relays.containsKey((name,))
            if fresh:
                self.relays.updateValue((name,), (True,))
            yield CHANGE("relay", key[0], key[0], None, None, None, relay if fresh else None, seq, sightings)


class _AuthorCap(_Processor):
    """Admits the first events of an author; rows about relays pass."""

    def __init__(self, cap: int | None) -> None:
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.admitted = handle.getValueState("admitted", "events int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        kind = key[0]
        if kind == "relay" or self.cap is None:
            for row in rows:
                yield ADMITTED(*(row[c] for c in FOLD_COLUMNS))
            return
        held = self.admitted.get()[0] if self.admitted.exists() else 0
        if held >= self.cap:
            return
        for row in sorted(rows, key=lambda r: r["seq"])[: self.cap - held]:
            held += 1
            yield ADMITTED(*(row[c] for c in FOLD_COLUMNS))
        self.admitted.update((held,))


def fold_stream(
    observations: DataFrame, since: int | None = None, until: int | None = None, author_cap: int | None = RAW_AUTHOR_CAP
) -> DataFrame:
    """Changes of a live fold of observations (``event_id, pubkey, created_at, content, relay, seq``), an append stream.

    A row of kind ``event`` admits an event with the fields of its first observation: the first ``author_cap`` of an author
    in the order of arrival (batches, then ``seq``). A row of kind ``relay`` says where an event was seen, in which
    place, how often; ``relay`` is null where that relay was known. State is one entry per event and relay,
    and one number per author. The cap meets one row per event, and each task drops what cannot be among the first
    of an author before it is shuffled, so a busy author stays a few rows per task. :func:`read_fold` puts the changes together.
    """
    use_state_store(observations.sparkSession)
    usable = admissible(observations, since, until).select(
        "event_id", "pubkey", "created_at", "content", "relay", "seq", F.lit(1).cast("bigint").alias("sightings")
    )

    def together(one: dict[str, Any], two: dict[str, Any]) -> dict[str, Any]:
        return (two if two["seq"] < one["seq"] else one) | {"sightings": one["sightings"] + two["sightings"]}

    changes = reduce_in_tasks(usable, ["event_id", "relay"], together).groupBy("event_id").transformWithState(
        _EventFold(), f"kind string, deal string, {_FIELDS}", "Append", "None"
    )
    capped = changes if author_cap is None else _task_cut(changes, int(author_cap))
    return capped.groupBy("kind", "deal").transformWithState(_AuthorCap(author_cap), f"kind string, {_FIELDS}", "Append", "None")


def _task_cut(changes: DataFrame, cap: int) -> DataFrame:
    """Per task, only the first ``cap`` new events of each author; relay rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[str | None, list] = {}
        names, schema = None, None
        for batch in batches:
            names, schema = batch.schema.names, batch.schema
            kinds, authors, places = (batch.column(names.index(c)).to_pylist() for c in ("kind", "pubkey", "seq"))
            passing = []
            for at, kind in enumerate(kinds):
                if kind == "relay":
                    passing.append(at)
                    continue
                held = first.setdefault(authors[at], [])
                entry = (-places[at], len(held), batch.slice(at, 1))
                if len(held) < cap:
                    heapq.heappush(held, entry)
                elif -held[0][0] > places[at]:
                    heapq.heapreplace(held, entry)
            if passing:
                yield batch.take(pa.array(passing))
        rows = [entry[2] for held in first.values() for entry in held]
        for start in range(0, len(rows), 1024):
            yield from pa.Table.from_batches(rows[start : start + 1024], schema).combine_chunks().to_batches()

    return changes.mapInArrow(run, changes.schema)


def read_fold(changes: DataFrame) -> DataFrame:
    """The folded posts of all changes written so far: as ``fold_observations`` gives them in the order of arrival.

    Relays of events that their author's cap kept out are dropped here.
    """
    admitted = changes.filter("kind = 'event'").drop("kind", "relay", "sightings")
    places = F.array_sort(F.collect_list(F.when(F.col("relay").isNotNull(), F.struct("seq", "relay"))))
    seen = changes.filter("kind = 'relay'").groupBy("event_id").agg(places.alias("places"), F.sum("sightings").alias("n_obs"))
    return admitted.join(seen, "event_id", "left").select(
        "event_id", "pubkey", "created_at", "content", F.coalesce(F.col("places.relay"), F.array().cast("array<string>")).alias("relay"), "seq",
        F.coalesce("n_obs", F.lit(0)).alias("n_obs"),
    )
