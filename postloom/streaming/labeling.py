"""Stream jobs: unbounded dedup, and labeling until every label has enough rows."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from postloom.functions import gates as G
from postloom.operators.labeling import Labeler, OutcomeLog, label_with
from postloom.operators.labels import LABEL_CHARS
from postloom.operators.progress import MIN_PER_LABEL
from postloom.operators.resume import last_ok
from postloom.streaming.state import first_of_key

GATE_METRICS = "gate"
OLDER = -1


def stream_dedup(stream: DataFrame, key: str = "event_id", seed: DataFrame | None = None) -> DataFrame:
    """First row per key over the whole life of the stream, except keys in ``seed``.

    No watermark: ids never expire, so the state keeps one entry per id (RocksDB-backed with the
    settings of :mod:`postloom.session`). ``seed`` is a static table of ids already handled; it becomes state in
    the first batch and is not read again.
    """
    return stream.dropDuplicates([key]) if seed is None else first_of_key(stream, key, seed)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain what is available into a parquet folder and return when done."""
    stream.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start().awaitTermination()


def _if_present(read: Callable[[], DataFrame]) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error.getCondition()):
            return None
        raise


class ProgressWatch(StreamingQueryListener):
    """Keeps what a query reports about its batches and says when it ended."""

    def __init__(self, on_progress: Callable[[dict], None] | None = None) -> None:
        self.on_progress = on_progress
        self.metrics: dict[str, dict[int, dict[str, int]]] = {}
        self.ended: set[str] = set()
        self.news = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        observed = progress.observedMetrics.get(GATE_METRICS)
        with self.news:
            if observed is not None:
                self.metrics.setdefault(str(progress.runId), {})[progress.batchId] = observed.asDict()
        if self.on_progress is not None:
            self.on_progress(json.loads(progress.json))

    def onQueryTerminated(self, event) -> None:
        with self.news:
            self.ended.add(str(event.runId))
            self.news.notify_all()

    def wait(self, query: StreamingQuery, reached: threading.Event) -> None:
        """Until the query has ended or the target is reached."""
        run_id = str(query.runId)
        with self.news:
            self.news.wait_for(lambda: run_id in self.ended or reached.is_set())


def _take_interrupt(spark: SparkSession, seconds: float = 10.0) -> None:
    """Meet the interrupt of ``query.stop()`` inside a batch.

    ``stop`` interrupts the thread that runs the batch. A job started there takes the interrupt, and nothing is lost; further on it
    might hit the commit of the batch, which would end the query with an error. The batch then commits and the query ends.
    """
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        try:
            spark.range(1).count()
        except Exception as error:  # noqa: BLE001 - the interrupt comes as an error of whatever call it meets
            if "InterruptedException" in str(error):
                return
        time.sleep(0.01)


@dataclass
class StreamResult:
    """Where outcomes were written and the counters of the run."""

    outcomes_path: str
    counts: dict[str, int]
    complete: bool
    funnel: dict[str, int] = field(default_factory=dict)
    query: StreamingQuery | None = None

    def outcomes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.outcomes_path)


@dataclass
class LabelStream:
    """Label an unbounded source until each target label has ``min_per_label`` rows.

    Per micro-batch: language gate, id dedup, labeling on the executors, one idempotent write of
    the outcomes under the ids of run and batch, then label counts of that batch alone (at most one row per
    label) are added to the running totals. The run id is the one that Spark keeps in the checkpoint: a
    replayed batch overwrites its own folder, so neither outcomes nor counts are doubled after a
    failure, and a run with another checkpoint never touches the outcomes of earlier ones, whose
    counts it takes over. How much a batch admits is bounded by the source (``maxFilesPerTrigger`` or its like
    on the reader) and by ``trigger``.

    Admission stops before the first batch that finds every label filled. That batch is parked, not labeled, and the query
    is stopped; a later run on the same checkpoint labels it first. Nothing already admitted is dropped, so labels may
    exceed the target. Progress comes from a listener. Hooks: ``on_batch`` gets all outcomes of a batch, ``on_labeled`` the
    successes, ``on_failure`` the failures, each with the batch id; ``on_progress`` gets each progress report.
    With ``log_path`` outcomes are also logged one by one while a batch is asked about (:class:`OutcomeLog`), so a batch that broke
    off does not repeat the calls that were answered.
    """

    labeler: Labeler
    model: str
    output_path: str
    checkpoint: str
    min_per_label: int = MIN_PER_LABEL
    targets: tuple[str, ...] = LABEL_CHARS
    seed: DataFrame | None = None
    detector: Callable[[Column], Column] = G.script_detector
    max_retries: int = 5
    max_parallel_calls: int | None = None
    stop_when_complete: bool = True
    on_batch: Callable[[DataFrame, int], None] | None = None
    on_labeled: Callable[[DataFrame, int], None] | None = None
    on_failure: Callable[[DataFrame, int], None] | None = None
    on_progress: Callable[[dict], None] | None = None
    log_path: str | None = None
    flush_rows: int = 1
    trigger: dict[str, object] = field(default_factory=lambda: {"availableNow": True})

    def run(self, stream: DataFrame) -> StreamResult:
        spark = stream.sparkSession
        outcomes_path, counts_path = f"{self.output_path}/outcomes", f"{self.output_path}/counts"
        # Totals of finished batches under OLDER, and the latest batch, which may be replayed.
        run_id = self._run_id(spark)
        by_batch = self._stored_counts(spark, counts_path, run_id)
        base = self._seed_counts()
        running: list[StreamingQuery] = []
        reached = threading.Event()
        watch = ProgressWatch(self.on_progress)

        def totals() -> dict[str, int]:
            out = dict.fromkeys(self.targets, 0)
            for part in (base, *by_batch.values()):
                for label, count in part.items():
                    out[label] = out.get(label, 0) + count
            return out

        def complete() -> bool:
            found = totals()
            return all(found[label] >= self.min_per_label for label in self.targets)

        def settle(batch: DataFrame, batch_id: int) -> None:
            run = f"run={self._run_id(spark)}/batch_id={batch_id}"
            folder = f"{outcomes_path}/{run}"
            label_with(
                batch,
                self.labeler,
                self.model,
                max_retries=self.max_retries,
                max_parallel_calls=self.max_parallel_calls,
                log=None if self.log_path is None else OutcomeLog(self.log_path, self.flush_rows, f"{self._run_id(spark)}-{batch_id}", replay=True),
            ).write.mode("overwrite").parquet(folder)
            outcomes = batch.sparkSession.read.parquet(folder)
            counts = outcomes.filter("ok").groupBy("label").agg(F.count(F.lit(1)).alias("count"))
            counts.coalesce(1).write.mode("overwrite").parquet(f"{counts_path}/{run}")
            for done in [b for b in by_batch if b not in (OLDER, batch_id)]:
                for label, count in by_batch.pop(done).items():
                    older = by_batch.setdefault(OLDER, {})
                    older[label] = older.get(label, 0) + count
            by_batch[batch_id] = {r["label"]: r["count"] for r in counts.collect()}
            for hook, rows in ((self.on_batch, outcomes), (self.on_labeled, outcomes.filter("ok")), (self.on_failure, outcomes.filter(~F.col("ok")))):
                if hook is not None:
                    hook(rows, batch_id)

        def park(batch: DataFrame, batch_id: int) -> None:
            """Keep the rows for a later run and wait until the query is being stopped."""
            batch.write.mode("overwrite").parquet(f"{self.output_path}/parked/run={self._run_id(spark)}/batch_id={batch_id}")
            parked.add(batch_id)
            with watch.news:
                reached.set()
                watch.news.notify_all()
            while not running or running[0].isActive:
                time.sleep(0.01)
            _take_interrupt(spark)

        def handle(batch: DataFrame, batch_id: int) -> None:
            if batch_id in unparked:
                return  # a replay of a batch that was parked and has been labeled since
            if self.stop_when_complete and complete():
                park(batch, batch_id)
            else:
                settle(batch, batch_id)

        parked: set[int] = set()
        unparked: set[int] = set()
        for batch_id, rows in self._parked(spark, run_id, outcomes_path):
            if rows is not None and not (self.stop_when_complete and complete()):
                settle(rows, batch_id)
                rows = None
            if rows is None:
                unparked.add(batch_id)
        spark.streams.addListener(watch)
        try:
            query = (
                stream_dedup(self._gate(stream), seed=self.seed).writeStream.foreachBatch(handle)
                .option("checkpointLocation", self.checkpoint)
                .trigger(**self.trigger)
                .start()
            )
            running.append(query)
            watch.wait(query, reached)
            if reached.is_set():
                query.stop()
            query.awaitTermination()
            # The end is reported behind all progress.
            watch.wait(query, threading.Event())
        finally:
            spark.streams.removeListener(watch)
        metrics = {b: m for b, m in watch.metrics.get(str(query.runId), {}).items() if b not in parked}
        return StreamResult(outcomes_path, totals(), complete(), self._funnel(spark, outcomes_path, self._run_id(spark), metrics), query)

    def _parked(self, spark: SparkSession, run_id: str | None, outcomes_path: str) -> list[tuple[int, DataFrame | None]]:
        """Batches that this run has parked, with their rows while they are not labeled."""
        root = f"{self.output_path}/parked"
        rows = _if_present(lambda: spark.read.parquet(root))
        if rows is None or run_id is None:
            return []
        ids = rows.filter(F.col("run") == run_id).select("batch_id").distinct()
        done = _if_present(lambda: spark.read.parquet(f"{self.output_path}/counts"))
        settled = set() if done is None else {r.batch_id for r in done.filter(F.col("run") == run_id).select("batch_id").distinct().collect()}
        return [(r.batch_id, None if r.batch_id in settled else spark.read.parquet(f"{root}/run={run_id}/batch_id={r.batch_id}")) for r in ids.collect()]

    def _gate(self, stream: DataFrame) -> DataFrame:
        gated = G.with_gate_verdict(stream, detector=self.detector).observe(
            GATE_METRICS,
            F.count(F.lit(1)).alias("raw_fetched"),
            F.count_if("is_japanese").alias("language_pass"),
            F.count_if(~F.col("is_japanese")).alias("language_excluded"),
        )
        return gated.filter("is_japanese").select(*stream.columns)

    def _seed_counts(self) -> dict[str, int]:
        if self.seed is None or "counted" not in self.seed.columns:
            return {}
        counted = self.seed.filter("counted").groupBy("label").agg(F.count(F.lit(1)).alias("count"))
        return {r["label"]: r["count"] for r in counted.filter(F.col("label").isin(*self.targets)).collect()}

    def _run_id(self, spark: SparkSession) -> str | None:
        """The id of the query in the checkpoint; None before its first start."""
        found = _if_present(lambda: spark.read.text(f"{self.checkpoint}/metadata"))
        line = found.first() if found is not None else None
        return json.loads(line.value)["id"] if line else None

    @staticmethod
    def _stored_counts(spark: SparkSession, path: str, run_id: str | None) -> dict[int, dict[str, int]]:
        rows = _if_present(lambda: spark.read.parquet(path))
        if rows is None:
            return {}
        own = F.col("run") == F.lit(run_id)
        last = rows.filter(own).agg(F.max("batch_id")).first()[0]
        slot = F.when(own & (F.col("batch_id") == F.lit(last)), F.lit(last)).otherwise(F.lit(OLDER))
        stored: dict[int, dict[str, int]] = {}
        for row in rows.groupBy(slot.alias("slot"), "label").agg(F.sum("count").alias("count")).collect():
            stored.setdefault(row["slot"], {})[row["label"]] = row["count"]
        return stored

    @staticmethod
    def _funnel(spark: SparkSession, path: str, run_id: str | None, gate: dict[int, dict[str, int]]) -> dict[str, int]:
        out = dict.fromkeys(("raw_fetched", "language_excluded", "language_pass"), 0)
        for metrics in gate.values():
            for name in out:
                out[name] += metrics[name]
        done = _if_present(lambda: spark.read.parquet(path))
        if done is None or not gate:
            return {**out, "dedup_skipped": out["language_pass"], "queued": 0, "label_success": 0, "label_failure": 0}
        # The batches of this call follow each other, so their range names them.
        done = done.filter((F.col("run") == F.lit(run_id)) & F.col("batch_id").between(min(gate), max(gate)))
        tally = done.agg(
            F.count(F.lit(1)).alias("queued"),
            F.count_if("ok").alias("label_success"),
            F.count_if(~F.col("ok")).alias("label_failure"),
        ).first()
        out["dedup_skipped"] = out["language_pass"] - tally["queued"]
        return {**out, **tally.asDict()}


def relabel_counts(log: DataFrame, order: str = "ord") -> DataFrame:
    """Label counts after relabels: each event counts once, under its last successful label."""
    return last_ok(log, order).groupBy("label").agg(F.count(F.lit(1)).alias("count"))
