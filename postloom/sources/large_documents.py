"""Entries of one large JSON document, read by many tasks.

The file is read in byte ranges, cut at commas, which no JSON token but a string holds. A first pass says of each range how it changes
two things: whether a string is open, and how many brackets are. Their running sums over the ranges of a file, a few numbers a range,
give the state each range begins in. In a second pass every range cuts itself into cells, at the commas between entries of a top-level
array and between members of the document; the cells that ranges share are put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.functions import answers as A
from postloom.session import materialize, ship_packages

RANGE = "file string, start bigint"
ENTRY_DEPTH = 2
MOST_RANGES = 1_000_000
# Bytes of ranges that one task reads, where ranges are shorter; tasks for each core at least.
TASK_BYTES = 32 << 20
TASKS_PER_CORE = 2

_RANGE_BYTES = "spark.sql.files.maxPartitionBytes"

_ESCAPED = re.compile(r"\\.", re.DOTALL)
_STRING = re.compile(r'"[^"]*("|$)')


def shape_of(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether a string is open behind ``piece``, and by how many brackets the depth has changed."""
    bare = _ESCAPED.sub("", piece) if "\\" in piece else piece
    if inside:
        bare = '"' + bare
    quotes = bare.count('"')
    if quotes:
        bare = _STRING.sub("", bare)
    return quotes % 2 == 1, bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, start, value) of what stands between two commas, in the order of the file within each range."""
    where = F.col("_metadata")
    return spark.read.option("lineSep", ",").text(path).select(where["file_path"].alias("file"), where["file_block_start"].alias("start"), "value")


@contextmanager
def _cut_at(spark: SparkSession, range_bytes: int | None) -> Iterator[None]:
    """Files are read in ranges of that length; None leaves the session's."""
    usual = spark.conf.get(_RANGE_BYTES)
    if range_bytes is not None:
        spark.conf.set(_RANGE_BYTES, str(range_bytes))
    try:
        yield
    finally:
        spark.conf.set(_RANGE_BYTES, usual)


def _in_tasks(pieces: DataFrame, range_bytes: int | None) -> DataFrame:
    """Short ranges are dealt to as many tasks as their bytes need. Each stays whole and in order, one after the other."""
    if range_bytes is None:
        return pieces
    ranges = pieces.rdd.getNumPartitions()
    tasks = max(TASKS_PER_CORE * pieces.sparkSession.sparkContext.defaultParallelism, -(-ranges * range_bytes // TASK_BYTES))
    return pieces.coalesce(tasks) if tasks < ranges else pieces


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """The pieces of a batch that stand in one range, behind what the other columns say of it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = (pc.run_end_encode(batch.column(i)).run_ends.to_numpy() for i in range(2))
        begun = 0
        for end in np.unique(np.concatenate([*ends])).tolist():
            key = tuple(column[begun].as_py() for column in batch.columns[:-1])
            yield key, batch.column(batch.num_columns - 1).slice(begun, end - begun).to_pylist()
            begun = end


def _changes(pieces: DataFrame) -> DataFrame:
    """Per range: whether the number of quotes is odd, and the change of depth if it begins outside or inside a string."""
    names = ["file", "start", "odd", "outside", "inside"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states = None, []
        done = []
        for now, values in _by_range(batches):
            if now != key:
                if key is not None:
                    done.append((*key, states[0][0], states[0][1], states[1][1]))
                key, states = now, [[False, 0], [True, 0]]
            text = ",".join(values)
            for state in states:
                state[0], change = shape_of(text, state[0])
                state[1] += change
        if key is not None:
            done.append((*key, states[0][0], states[0][1], states[1][1]))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)

    return pieces.mapInArrow(run, f"{RANGE}, odd boolean, outside bigint, inside bigint")


def _states(changes: DataFrame) -> DataFrame:
    """(file, start, open, depth): the state that each range begins in. A file has a row per range, however large it is."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    opened = changes.withColumn("open", F.coalesce(F.sum(F.col("odd").cast("long")).over(before), F.lit(0)) % 2 == 1)
    change = F.when(F.col("open"), F.col("inside")).otherwise(F.col("outside"))
    return opened.select("file", "start", "open", F.coalesce(F.sum(change).over(before), F.lit(0)).alias("depth"))


def _cells(pieces: DataFrame) -> DataFrame:
    """(file, start, number, depth, text): the cells of each range, numbered from 0; ``depth`` is where a cell begins.

    The pieces of one cell are joined by the commas that cut them. ``ended`` tells that a cell ends in its range.
    """
    names = ["file", "start", "number", "depth", "text", "ended"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, made = None, []
        held: list[str] = []
        number = begun = depth = 0
        inside = False

        def block() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)
            made.clear()
            return out

        for (file, start, opened, at), values in _by_range(batches):
            if (file, start) != key:
                if held:
                    made.append((*key, number, begun, ",".join(held), False))
                key, held, number, begun, depth, inside = (file, start), [], 0, at, at, opened
            for value in values:
                held.append(value)
                inside, change = shape_of(value, inside)
                depth += change
                if not inside and depth <= ENTRY_DEPTH:
                    made.append((file, start, number, begun, ",".join(held), True))
                    held, number, begun = [], number + 1, depth
                    if len(made) >= 1024:
                        yield block()
        if held:
            made.append((*key, number, begun, ",".join(held), False))
        if made:
            yield block()

    return pieces.mapInArrow(run, f"{RANGE}, number bigint, depth bigint, text string, ended boolean")


def document_entries(spark: SparkSession, path: str, array: str = "items", range_bytes: int | None = None) -> DataFrame:
    """(file, source_record_index, record, model, rank) of the entries of the top-level ``array`` of each file.

    Every file is one document of any size and may be a single line. As with a parse in one piece, a document that is broken
    anywhere or has no such array gives no rows, and a missing path gives an empty table. A range is ``range_bytes``
    long, by default ``spark.sql.files.maxPartitionBytes``; a task takes many short ones. The members of a document beside the array are put together in one row.
    """
    empty = "file string, source_record_index bigint, record variant, model string, rank bigint"
    try:
        pieces = _pieces(spark, path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error.getCondition()):
            return spark.sql("SELECT '' AS file, 0L AS source_record_index, parse_json('0') AS record, '' AS model, 0L AS rank").filter("false")
        raise
    ship_packages(spark)
    with _cut_at(spark, range_bytes):
        pieces = _in_tasks(pieces, range_bytes)
        states = materialize(_states(_changes(pieces)), "range-states")
        cells = materialize(_cells(_with_states(pieces, states)), "range-cells")
    # The last cell of a range goes on in the next one unless a comma between entries ended it.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counts = cells.groupBy("file", "start").agg(F.count_if("ended").alias("cells"))
    first = materialize(counts.select("file", F.col("start"), F.coalesce(F.sum("cells").over(before), F.lit(0)).alias("first")), "first-cells")
    numbered = cells.join(F.broadcast(first), ["file", "start"]).withColumn("cell", F.col("first") + F.col("number"))
    # Only the first cell of a range and one that does not end there may have parts elsewhere.
    parted = (F.col("number") == 0) | ~F.col("ended")
    parts = F.array_sort(F.collect_list(F.struct("start", "text", "depth")))
    joined = numbered.filter(parted).groupBy("file", "cell").agg(parts.alias("parts")).select(
        "file", "cell", F.array_join("parts.text", ",").alias("text"), F.col("parts")[0]["depth"].alias("depth")
    )
    whole = numbered.filter(~parted).select("file", "cell", "text", "depth").unionByName(materialize(joined, "joined-cells"))
    opening = rf'^(\s*\{{?\s*"{re.escape(array)}"\s*:\s*\[)'
    frame = whole.filter(f"depth < {ENTRY_DEPTH}").select("file", "cell", F.regexp_extract("text", opening, 1).alias("opens"))
    order = Window.partitionBy("file").orderBy("cell")
    spans = materialize(frame.withColumn("next", F.lead("cell").over(order)).filter("opens <> ''").select("file", F.col("cell").alias("from"), "next", "opens"), "array-spans")
    # Spans, last cells and documents have a row for each file, of which there are no more than ranges.
    placed = whole.join(F.broadcast(spans), "file").withColumn("within", (F.col("cell") >= F.col("from")) & (F.col("next").isNull() | (F.col("cell") < F.col("next"))))
    last = placed.filter("within").groupBy("file", "from").agg(F.max("cell").alias("last"))
    placed = placed.join(F.broadcast(last), ["file", "from"])
    closing = r"(\]\s*\}?\s*)$"
    text = F.when(F.col("cell") == F.col("from"), F.expr("substring(text, length(opens) + 1)")).otherwise(F.col("text"))
    entry = F.when(F.col("cell") == F.col("last"), F.regexp_replace(text, closing, "")).otherwise(text)
    entries = placed.filter("within").select("file", (F.col("cell") - F.col("from")).alias("source_record_index"), entry.alias("entry"), (F.col("from") == F.col("last")).alias("only"))
    entries = entries.filter(~(F.col("only") & (F.trim(F.regexp_replace("entry", r"\s", "")) == "")))
    entries = materialize(entries.select("file", "source_record_index", F.try_parse_json("entry").alias("record")), "document-entries")
    # The document without what the array holds; a document with two such arrays cannot be parsed, as a whole or so.
    ends = F.when(F.col("cell") == F.col("last"), F.regexp_extract("text", closing, 1)).otherwise("")
    skeleton = F.when(~F.col("within"), F.col("text")).when(F.col("cell") == F.col("from"), F.concat("opens", ends)).when(F.col("cell") == F.col("last"), ends)
    rest = placed.withColumn("skeleton", skeleton).filter("skeleton IS NOT NULL").withColumn("joins", F.col("within") & (F.col("cell") > F.col("from")))
    listed = F.array_sort(F.collect_list(F.struct("cell", "skeleton", "joins")))
    body = rest.groupBy("file", "from").agg(listed.alias("listed")).select(
        "file", F.aggregate("listed", F.lit(""), lambda made, x: F.concat(made, F.when((x["cell"] == 0) | x["joins"], "").otherwise(","), x["skeleton"])).alias("body")
    )
    docs = body.select("file", F.try_parse_json("body").alias("doc")).filter(A.kind_of(F.col("doc"), f"$.{array}") == "array")
    docs = docs.select("file", A.string_field(F.col("doc"), "$.model").alias("model"), F.coalesce(F.try_variant_get("doc", "$.document_order", "bigint"), F.lit(-1)).alias("rank"))
    sound = entries.join(F.broadcast(entries.filter("record IS NULL").select("file").distinct()), "file", "left_anti")
    return sound.join(F.broadcast(docs), "file").select(*(f.split(" ")[0] for f in empty.split(", ")))


def _with_states(pieces: DataFrame, states: DataFrame) -> DataFrame:
    """The pieces with the state their range begins in, before the text.

    Ranges have to stay as they are read, in order, so states are sent to the tasks: a row for each range of many megabytes. A million
    ranges, some 100 TB at the default length, are the most.
    """
    if states.count() > MOST_RANGES:
        raise ValueError("too many ranges: raise spark.sql.files.maxPartitionBytes")
    return pieces.join(F.broadcast(states), ["file", "start"]).select("file", "start", "open", "depth", "value")
