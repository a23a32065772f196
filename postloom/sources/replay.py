"""Stored files first, then a live folder, as one stream.

The stream's offset names a source and the last file of it that was taken. Sources are taken one after the other, files in the order of their
names, a bounded number in each batch; a batch never mixes two sources. What the driver handles are names: the rows of the source are byte ranges of files, and tasks read the lines.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from postloom.functions import answers as A
from postloom.functions import text as T
from postloom.session import ship_packages
from postloom.sources.jsonl import RAW_SCHEMA, variant_fields

RANGE_BYTES = 64 * 2**20
MAX_FILES = 1_000
LINES_A_BATCH = 4_096


def store_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a local path or URI, and the path in it."""
    uri = path.replace("s3a://", "s3://", 1)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pyarrow.fs.FileSystem.from_uri(uri)


class _RangeReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folders = json.loads(options["folders"])
        self.max_files = int(options.get("maxfiles", MAX_FILES))
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def _files(self, source: int, after: str) -> list[tuple[str, int]]:
        """(name, size) of the files of a source behind ``after``, by name; hidden ones are left out."""
        store, folder = store_of(self.folders[source])
        found = store.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
        return sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name[0] not in "._" and f.base_name > after)

    def _ranges(self, source: int, files: list[tuple[str, int]]) -> Iterator[tuple]:
        # An iterator over a list, since the engine copies it.
        return iter([(source, name, at, min(self.range_bytes, size - at)) for name, size in files for at in range(0, size, self.range_bytes)])

    def initialOffset(self) -> dict:
        return {"source": 0, "after": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        source, after = start["source"], start["after"]
        while True:
            files = self._files(source, after)[: self.max_files]
            if files:
                return self._ranges(source, files), {"source": source, "after": files[-1][0]}
            if source + 1 == len(self.folders):
                return iter(()), start  # an offset that does not move makes no batch, whatever sources were passed over
            source, after = source + 1, ""

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same files again for a batch that is replayed: those behind ``start`` up to ``end``."""
        after = start["after"] if start["source"] == end["source"] else ""
        return self._ranges(end["source"], [f for f in self._files(end["source"], after) if f[0] <= end["after"]])


class OrderedFiles(DataSource):
    """Rows (source, file, start, length) of the files of several folders, one folder after the other."""

    @classmethod
    def name(cls) -> str:
        return "ordered_files"

    def schema(self) -> str:
        return "source int, file string, start bigint, length bigint"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _RangeReader(self.options)


def _lines(ranges: DataFrame, folders: list[str]) -> DataFrame:
    """(source, file, start, line, value): the lines that begin in each range."""
    out = "source int, file string, start bigint, line bigint, value string"
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = [f.split(" ")[0] for f in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, folder = store_of(folders[row["source"]])
                made: list[tuple] = []
                with store.open_input_file(f"{folder}/{row['file']}") as raw, io.BufferedReader(raw) as source:
                    at, end = row["start"], row["start"] + row["length"]
                    if at:  # the line that begins before the range belongs to the one before
                        source.seek(at - 1)
                        at += len(source.readline()) - 1
                    number = 0
                    while at < end and (line := source.readline()):
                        at += len(line)
                        made.append((row["source"], row["file"], row["start"], number, line.decode("utf-8", "replace").rstrip("\r\n")))
                        number += 1
                        if len(made) == LINES_A_BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)
                            made = []
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)

    return ranges.mapInArrow(run, out)


def replay_then_live(
    spark: SparkSession, stored: list[str], live: str, schema: str = RAW_SCHEMA, max_files: int = MAX_FILES, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Streaming posts of JSONL folders: all files of ``stored``, folder by folder, and then those that come to ``live``.

    Rows carry ``source_rank`` (the folder's place) and ``line_order``, which sorts the rows of a batch as they were written. Batches follow the
    order of sources and file names, over restarts too. Files are whole when they appear, and a later file of a folder has a greater name; a missing
    folder is empty. Unreadable lines and posts without an id are skipped. With the trigger ``availableNow`` a run takes one batch.
    """
    ship_packages(spark)
    spark.dataSource.register(OrderedFiles)
    folders = [*stored, live]
    ranges = spark.readStream.format("ordered_files").option("folders", json.dumps(folders)).option("maxFiles", max_files).option("rangeBytes", range_bytes).load()
    lines = _lines(ranges.repartition("source", "file", "start"), folders)
    order = F.struct("file", "start", "line").alias("line_order")
    records = lines.select(F.col("source").alias("source_rank"), order, A.parse_json_text(T.strip_spaces(F.col("value"))).alias("record"))
    posts = variant_fields(records.filter(F.col("record").isNotNull()), schema)
    return posts.filter(F.coalesce("event_id", F.lit("")) != "")
