"""Generation of posts for labels short of rows, round by round until every quota is full.

What is paid for is kept: the answers of a round and the verdicts on its candidates are parts of a run folder, each
committed before it is used. A run that broke off reads its parts back and goes on with the first step that is missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.functions import answers as A
from postloom.functions import prompts as P
from postloom.functions import text as T
from postloom.operators.labeling import Labeler, Reply, label_once
from postloom.operators.synthesis import candidate_filter, fill_in_order, synthesis_report, synthetic_records
from postloom.plans.backfill import candidates_from_answers, synthesis_prompts, with_processing_order
from postloom.session import materialize

#: ``(prompt, label, round) -> Reply``
Generator = Callable[[str, str, int], Reply]

ANSWERS = "label string, label_id int, need bigint, round int, answer_text string, error string"
VERDICTS = "label string, round int, pos int, agrees boolean, confidence double, rationale string"
CHECKED = "label string, label_id int, need bigint, round int, pos int, content string, content_hash string, reason string"
PLACE = ["label", "round", "pos"]


@dataclass
class GenerationRun:
    """Ask ``generator`` for posts of every label in need until its quota is full or ``max_rounds`` are used.

    The rule is that of one label after the other, by need and then by label id: candidates are examined in order, a text that an
    earlier label examined is a duplicate, a failed or unreadable answer uses up its round. All labels that are still
    open are asked at once, in different tasks. That asks no label more often than the rule does: what earlier labels have
    examined only grows, so a label that is open now is open at the end of the rounds it has had. With a ``verifier``
    each candidate of a label is put to it in order, until the quota is full; a candidate that turns out later to be
    an earlier label's may have been verified in vain.
    """

    generator: Generator
    model: str
    path: str
    verifier: Labeler | None = None
    batch: int = 10
    max_rounds: int = 12
    max_retries: int = 2

    def run(self, deficits: DataFrame, labeled: DataFrame, known: DataFrame, dim: DataFrame) -> DataFrame:
        """Candidates with their ``outcome`` (see ``quota_fill``), ``confidence`` and ``rationale``.

        ``deficits`` has ``label, label_id, need``; ``labeled`` gives style examples; ``known`` (``content``) what the corpus
        holds already. The corpus is hashed once, and each round meets its hashes with the few new ones.
        """
        spark = deficits.sparkSession
        prompts = materialize(synthesis_prompts(deficits, labeled, dim, self.batch), "generation-prompts")
        needs = {r.label: r.need for r in prompts.select("label", "need").collect()}
        hashes = None
        while True:
            for step in self._steps(spark, "answers") - self._steps(spark, "checked"):  # the last one, if a run broke off behind it
                hashes = hashes or self._hashes(known)
                self._meet(spark, step, hashes)
            filled = self._filled(spark)
            if filled is None:
                taken, asked, unjudged = dict.fromkeys(needs, 0), dict.fromkeys(needs, 0), False
            else:
                filled = materialize(filled, "generation-state")
                taken, unjudged = self._progress(filled, needs)
                asked = dict.fromkeys(needs, 0) | {
                    r.label: r.rounds for r in self._part(spark, "answers", ANSWERS).groupBy("label").agg(F.max("round").alias("rounds")).collect()
                }
            if unjudged:
                self._commit(self._judge(filled), "verdicts")
                continue
            open_labels = [(label, asked[label] + 1) for label, need in needs.items() if taken[label] < need and asked[label] < self.max_rounds]
            if not open_labels:
                return filled if filled is not None else self._shape(spark)
            hashes = hashes or self._hashes(known)
            self._meet(spark, self._ask(spark, prompts, open_labels), hashes)

    def records(self, filled: DataFrame, created_at: int) -> DataFrame:
        """Synthetic records of the taken candidates; verified ones carry the verifier's confidence and reason."""
        taken = filled.filter("outcome = 'taken'")
        return synthetic_records(taken, self.model, created_at, "confidence", "rationale", F.lit(self.verifier is not None))

    def calls(self, spark: SparkSession) -> DataFrame:
        """(label, calls, failed_calls) made by all runs on this folder."""
        answers = self._part(spark, "answers", ANSWERS)
        if answers is None:  # no label was in need
            answers = spark.createDataFrame([], ANSWERS)
        return answers.groupBy("label").agg(F.count(F.lit(1)).alias("calls"), F.count("error").alias("failed_calls"))

    def report(self, filled: DataFrame, deficits: DataFrame) -> DataFrame:
        return synthesis_report(filled, deficits)

    # --- steps ---

    @staticmethod
    def _hashes(known: DataFrame) -> DataFrame:
        return materialize(known.select(T.content_hash(F.col("content")).alias("content_hash")).distinct(), "known-hashes")

    def _ask(self, spark: SparkSession, prompts: DataFrame, open_labels: list[tuple[str, int]]) -> int:
        """One call per open label; the number of the committed step."""
        generator = self.generator

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.to_pylist()
                for row in rows:
                    try:
                        reply = generator(row["prompt"], row["label"], row["round"])
                    except Exception as error:  # noqa: BLE001 - whatever a generator raises is a failed call of this round
                        reply = Reply(error=f"generator_error: {type(error).__name__}: {error}")
                    row["answer_text"], row["error"] = (None, reply.error) if reply.error else (reply.text, None)
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in fields} for r in rows], arrow)

        rounds = spark.createDataFrame(open_labels, "label string, round int")
        todo = prompts.join(F.broadcast(rounds), "label").select("label", "label_id", F.col("need").cast("bigint").alias("need"), "round", "prompt")
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string())
        fields = [f.strip().split(" ")[0] for f in ANSWERS.split(",")]
        arrow = pa.schema(list(zip(fields, kinds)))
        return self._commit(todo.repartition(len(open_labels), "label").mapInArrow(run, ANSWERS), "answers")

    def _meet(self, spark: SparkSession, step: int, hashes: DataFrame) -> None:
        """Check the texts of a step, which are as many as a few calls give, against the rules and the hashes of the corpus."""
        answers = spark.read.schema(ANSWERS).parquet(f"{self.path}/answers/step={step}")
        parsed = answers.filter("error is null").withColumn("answer", A.parse_json_text(F.col("answer_text"))).drop("error", "answer_text")
        fresh = materialize(candidates_from_answers(parsed), "generated-posts")
        new = fresh.select(T.content_hash(F.col("content")).alias("content_hash")).distinct()
        met = hashes.join(F.broadcast(new), "content_hash", "left_semi")
        checked = candidate_filter(with_processing_order(fresh), met, within=["label"]).drop("seq")
        self._commit(checked.select(*(f.strip().split(" ")[0] for f in CHECKED.split(","))).coalesce(1), "checked", step)

    def _judge(self, filled: DataFrame) -> DataFrame:
        """Verdicts on candidates of labels that are not full, in order; one label's few candidates are one group."""
        verifier, retries = self.verifier, self.max_retries
        waiting = filled.filter("outcome = 'verify_rejected' and agrees is null").select("label").distinct()
        rows = filled.filter("reason is null").join(F.broadcast(waiting), "label", "left_semi")
        asked = rows.select(*PLACE, "need", "agrees", P.labeling_prompt(F.col("content")).alias("prompt"))

        def judge(group: pd.DataFrame) -> pd.DataFrame:
            found, made = 0, []
            for row in group.sort_values(["round", "pos"]).itertuples():
                if found >= row.need:
                    break
                if row.agrees is None or pd.isna(row.agrees):
                    reply = label_once(verifier, row.prompt, retries, True)
                    agrees = bool(reply["ok"]) and reply["label"] == row.label
                    made.append((row.label, row.round, row.pos, agrees, reply.get("confidence"), reply.get("rationale")))
                else:
                    agrees = bool(row.agrees)
                found += agrees
            return pd.DataFrame(made, columns=[f.strip().split(" ")[0] for f in VERDICTS.split(",")])

        return asked.groupBy("label").applyInPandas(judge, VERDICTS)

    # --- state ---

    def _filled(self, spark: SparkSession) -> DataFrame | None:
        """All candidates so far with their outcomes, from the committed parts."""
        checked = self._part(spark, "checked", CHECKED)
        if checked is None:
            return None
        # Steps are checked apart: a text that a label has met in an earlier round is a duplicate, too.
        again = F.row_number().over(Window.partitionBy("label", "content_hash", F.col("reason").isNull()).orderBy("round", "pos")) > 1
        checked = checked.withColumn("_again", again)
        ranked = checked.withColumns(
            {"reason": F.coalesce("reason", F.when(F.col("_again"), F.lit("duplicate"))), "label_rank": F.struct(-F.col("need"), "label_id")}
        ).drop("_again")
        if self.verifier is None:
            judged = ranked.withColumns({"agrees": F.lit(True), "confidence": F.lit(None).cast("double"), "rationale": F.lit(None).cast("string")})
        else:
            verdicts = self._part(spark, "verdicts", VERDICTS)
            judged = ranked.join(verdicts if verdicts is not None else spark.createDataFrame([], VERDICTS), PLACE, "left")
        judged = judged.withColumn("verified", F.coalesce("agrees", F.lit(False)))
        return fill_in_order(materialize(judged, "generation-candidates"), self.max_rounds).drop("label_rank")

    @staticmethod
    def _progress(filled: DataFrame, needs: dict[str, int]) -> tuple[dict[str, int], bool]:
        by_label = filled.groupBy("label").agg(
            F.count_if(F.col("outcome") == "taken").alias("taken"),
            F.count_if((F.col("outcome") == "verify_rejected") & F.col("agrees").isNull()).alias("unjudged"),
        ).collect()
        return dict.fromkeys(needs, 0) | {r.label: r.taken for r in by_label}, any(r.unjudged for r in by_label)

    @staticmethod
    def _shape(spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], "label string, label_id int, need bigint, round int, pos int, content string, reason string, verified boolean, outcome string, confidence double, rationale string")

    # --- committed parts ---

    def _commits(self, spark: SparkSession) -> dict[str, set[int]]:
        try:
            rows = spark.read.schema("kind string, step int").json(f"{self.path}/commits").collect()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error.getCondition()):
                return {}
            raise
        made: dict[str, set[int]] = {}
        for row in rows:
            made.setdefault(row.kind, set()).add(row.step)
        return made

    def _steps(self, spark: SparkSession, kind: str) -> set[int]:
        return self._commits(spark).get(kind, set())

    def _part(self, spark: SparkSession, kind: str, schema: str) -> DataFrame | None:
        steps = self._steps(spark, kind)
        return spark.read.schema(schema).parquet(*(f"{self.path}/{kind}/step={s}" for s in sorted(steps))) if steps else None

    def _commit(self, rows: DataFrame, kind: str, step: int | None = None) -> int:
        """Write a step and then say so; a step without its entry is written anew."""
        spark = rows.sparkSession
        step = max(self._steps(spark, kind), default=0) + 1 if step is None else step
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/step={step}")
        spark.range(1).select(F.lit(kind).alias("kind"), F.lit(step).alias("step")).coalesce(1).write.mode("append").json(f"{self.path}/commits")
        return step
