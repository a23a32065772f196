"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.session import materialize, ship_packages

# Rows per Arrow batch: a batch of texts of 100,000 characters stays near 50 MB.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers and keep Arrow batches small enough for long texts."""
    ship_packages(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add_python(
    df: DataFrame,
    inputs: Sequence[str],
    out: str,
    make: Callable[[], Callable[..., list[pa.Array]]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Append the columns named in the DDL ``out``, computed batch by batch in Python workers.

    ``make()`` runs once per task and returns a function from one list per input column to one
    Arrow array per new column. ``keep`` (all columns by default) stay as they are; a kept
    column with the name of a new one is replaced.
    """
    prepare(df.sparkSession)
    fresh = T.StructType.fromDDL(out)
    kept = [c for c in (df.columns if keep is None else keep) if c not in fresh.fieldNames()]
    wanted = [*kept, *(c for c in inputs if c not in kept)]
    schema = T.StructType([df.schema[c] for c in kept] + list(fresh))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = work(*(batch.column(wanted.index(c)).to_pylist() for c in inputs))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *made], names=schema.fieldNames())

    return df.select(*(F.col(f"`{c}`") for c in wanted)).mapInArrow(run, schema)


def flat_python(
    df: DataFrame, inputs: Sequence[str], out: str, make: Callable[[], Callable[..., Iterator[list[pa.Array]]]]
) -> DataFrame:
    """Rows of the DDL ``out``: ``make()`` returns a function that yields the columns of any number of blocks of rows
    for each input batch; called with ``None`` for each input, it yields what it still holds at the end of the task."""
    prepare(df.sparkSession)
    names = T.StructType.fromDDL(out).fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for made in work(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays(made, names=names)
        for made in work(*(None for _ in inputs)):
            yield pa.RecordBatch.from_arrays(made, names=names)

    return df.select(*(F.col(f"`{c}`") for c in inputs)).mapInArrow(run, out)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def hash_sample(df: DataFrame, rows: int, size: int, *by: str) -> DataFrame:
    """About ``size`` of the ``rows`` rows of ``df`` (all if there are no more), those of the smallest hashes of ``by``.

    A row is chosen by comparing its own hash with a bound, so nothing is sorted or gathered; the number varies by
    a few times the root of ``size``.
    """
    if rows <= size:
        return df
    return df.filter(F.pmod(F.xxhash64(*by), F.lit(2**31)) < int(2**31 * size / rows))


# Rows of two numbers that a join sends to every task: 16 MB.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table of two numbers a row), marked for broadcast if it is counted to have ``rows`` rows at most.

    Larger tables are joined by shuffling both sides; the result is the same.
    """
    return F.broadcast(df) if df.count() <= rows else df


# Spark's setting that removes the shuffle files of a query at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back; the shuffle files behind it are removed once it is written."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return materialize(df, name)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def discard(df: DataFrame) -> None:
    """Remove a table that :func:`stored` wrote and nothing reads any more."""
    files = df.inputFiles()
    if not files:
        return
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
