"""Hooks for user code: a labeling callable, an inference backend, and retry outcomes."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from postloom.functions import prompts as P
from postloom.functions import scores as S
from postloom.functions import text as T
from postloom.operators.labels import LABEL_CHARS, QA_LABEL, QA_LABEL_ID, label_for_index, label_id_of
from postloom.operators.sampling import first_n_posts
from postloom.sources.jsonl import APPEND_ID, APPEND_POSITION
from postloom.sources.replay import store_of

OUTCOME_FIELDS = """
    ok BOOLEAN, label STRING, label_id INT, confidence DOUBLE, rationale STRING,
    is_uncertain BOOLEAN, pass INT, source STRING, reason STRING,
    attempts ARRAY<STRUCT<attempt: INT, status_code: INT, response_text: STRING>>, raw STRING
"""

ATTEMPT_ARROW = pa.struct(
    [("attempt", pa.int32()), ("status_code", pa.int32()), ("response_text", pa.string())]
)
OUTCOME_ARROW = pa.schema(
    [
        ("ok", pa.bool_()), ("label", pa.string()), ("label_id", pa.int32()), ("confidence", pa.float64()),
        ("rationale", pa.string()), ("is_uncertain", pa.bool_()), ("pass", pa.int32()),
        ("source", pa.string()), ("reason", pa.string()), ("attempts", pa.list_(ATTEMPT_ARROW)),
        ("raw", pa.string()),
    ]
)

# Rows whose prompts and outcomes a task holds as Python objects.
ROWS_AT_ONCE = 256


class Reply(NamedTuple):
    """What a labeling callable returns: the answer text, or a transport error."""

    text: str = ""
    error: str | None = None
    attempts: tuple[tuple[int, int, str], ...] = ()


Labeler = Callable[[str, int], Reply]


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def answer_errors(answer: Any, allow_qa: bool = True) -> list[str]:
    """Driver-free twin of the column validation, used between two calls of a retry loop."""
    if not isinstance(answer, (dict, list)):
        return ["not_an_object"]
    fields = answer if isinstance(answer, dict) else {}
    label, label_id = fields.get("label"), fields.get("label_id")
    confidence = fields.get("confidence")
    good = {
        "label": isinstance(label, str),
        "label_id": _is_number(label_id) and (isinstance(label_id, int) or label_id.is_integer()),
        "confidence": _is_number(confidence),
        "rationale": isinstance(fields.get("rationale"), str),
        "is_uncertain": isinstance(fields.get("is_uncertain"), bool),
    }
    in_range = {
        "label_id": not _is_number(label_id) or 0 <= label_id <= QA_LABEL_ID,
        "confidence": not _is_number(confidence) or 0 <= confidence <= 1,
    }
    errors = [f"missing:{name}" for name in good if name not in fields]
    for name, ok in good.items():
        if name in fields and not ok:
            errors.append(f"type:{name}")
        if not in_range.get(name, True):
            errors.append(f"range:{name}")
    char = label.strip().replace("Ｈ", "H") if isinstance(label, str) else ""
    known = (*LABEL_CHARS, QA_LABEL) if allow_qa else LABEL_CHARS
    if char not in known:
        errors.append("label_not_allowed")
    elif _is_number(label_id) and label_id != known.index(char):
        errors.append("label_id_mismatch")
    return errors


def label_once(labeler: Labeler, prompt: str, max_retries: int, allow_qa: bool) -> dict[str, Any]:
    """Ask until an answer is valid; a transport error or unreadable answer ends it at once."""
    reason, reply = "unknown", Reply()

    def tried() -> list[dict[str, Any]]:
        return [{"attempt": a, "status_code": c, "response_text": x} for a, c, x in reply.attempts]

    for attempt in range(max_retries + 1):
        try:
            reply = labeler(prompt, attempt)
        except Exception as error:  # noqa: BLE001 - whatever a labeler raises is a failed call of this row
            reply = Reply(error=f"labeler_error: {type(error).__name__}: {error}")
        if reply.error:
            reason = reply.error
            break
        try:
            answer = json.loads(reply.text)
        except ValueError:
            reason = "invalid_model_json"
            break
        errors = answer_errors(answer, allow_qa)
        if not errors:
            char = answer["label"].strip().replace("Ｈ", "H")
            return {
                "ok": True,
                "label": char,
                "label_id": (*LABEL_CHARS, QA_LABEL).index(char),
                "confidence": float(answer["confidence"]),
                "rationale": answer["rationale"],
                "is_uncertain": answer["is_uncertain"],
                "reason": None,
                "attempts": tried(),
                "raw": reply.text,
            }
        reason = "validation_failed: " + "; ".join(errors)
    return {"ok": False, "reason": reason, "attempts": tried(), "raw": ""}


@dataclass(frozen=True)
class OutcomeLog:
    """A JSONL log that tasks append to while they ask, so that an answer is kept as soon as it is there.

    Every ``flush_rows`` outcomes are one small file of the folder ``path``, which all executors reach (a local path or a URI
    that Arrow opens). Lines have the shape of ``append_log``. ``token`` names the pass: a task that starts again,
    or a replay under the same token, takes what the log holds of the pass and asks only for the rest.
    """

    path: str
    flush_rows: int = 1
    token: str = field(default_factory=lambda: uuid.uuid4().hex)
    replay: bool = False

    def write(self, lines: list[dict[str, Any]]) -> None:
        store, folder = store_of(self.path)
        store.create_dir(folder, recursive=True)
        stamp = time.time_ns()
        marked = ({**{k: v for k, v in line.items() if v is not None}, APPEND_ID: stamp, APPEND_POSITION: n} for n, line in enumerate(lines))
        text = "".join(json.dumps(line, ensure_ascii=False) + "\n" for line in marked)
        with store.open_output_stream(f"{folder}/outcomes-{self.token}-{uuid.uuid4().hex}.json") as out:
            out.write(text.encode())

    def answered(self) -> dict[str, dict[str, Any]]:
        """Outcomes of this pass by event id; read only where a task starts again."""
        task = TaskContext.get()
        if not self.replay and (task is None or task.attemptNumber() == 0):
            return {}
        store, folder = store_of(self.path)
        found = {}
        for info in store.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)):
            if info.base_name.startswith(f"outcomes-{self.token}-"):
                with store.open_input_stream(info.path) as source:
                    for line in source.read().decode().splitlines():
                        try:
                            row = json.loads(line)
                        except ValueError:
                            continue  # cut off while it was written: not answered
                        found[row["event_id"]] = row
        return found


def label_with(
    posts: DataFrame,
    labeler: Labeler,
    model: str,
    prompt: Column | None = None,
    pass_number: int = 1,
    max_retries: int = 5,
    allow_qa: bool = True,
    max_parallel_calls: int | None = None,
    log: OutcomeLog | None = None,
) -> DataFrame:
    """Label every post with a user callable ``(prompt, attempt) -> Reply``.

    Runs on the executors over Arrow batches; ``max_parallel_calls`` bounds the number of tasks
    that call at the same time. Output: the input columns, ``prompt`` and the outcome columns.
    Calls cost money and time, so write the result before using it more than once. With ``log`` each outcome is also kept at
    once, by ``event_id``, and a task that starts again does not repeat the calls that were answered.
    """
    asked = posts.withColumn("prompt", P.labeling_prompt(F.col("content")) if prompt is None else prompt)
    if max_parallel_calls:
        asked = asked.repartition(int(max_parallel_calls))
    schema = t.StructType(asked.schema.fields + t.StructType.fromDDL(OUTCOME_FIELDS).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        constants = {"pass": pass_number, "source": model}
        known = log.answered() if log else {}
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            prompts = batch.column(batch.schema.get_field_index("prompt")).to_pylist()
            if log is None:
                rows = [label_once(labeler, text, max_retries, allow_qa) for text in prompts]
            else:
                rows = list(_logged(log, known, _columns(batch, LOGGED), prompts, constants, lambda text: label_once(labeler, text, max_retries, allow_qa)))
            added = [
                pa.array([constants.get(f.name, row.get(f.name)) for row in rows], type=f.type)
                for f in OUTCOME_ARROW
            ]
            # Input columns pass through as they are; only the outcome columns are built.
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added], names=[*batch.schema.names, *OUTCOME_ARROW.names]
            )

    return asked.mapInArrow(run, schema)


#: Input columns that a log line carries, where there are such.
LOGGED = ("event_id", "pubkey", "created_at", "content")


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[dict[str, Any]]:
    return batch.select([n for n in names if n in batch.schema.names]).to_pylist()


def _logged(
    log: OutcomeLog, known: dict[str, dict], inputs: list[dict], prompts: list[str], constants: dict, ask: Callable[[str], dict]
) -> Iterator[dict[str, Any]]:
    """Outcomes in order, each written to the log before the next few are asked for."""
    waiting: list[dict[str, Any]] = []
    try:
        for given, prompt in zip(inputs, prompts):
            outcome = known.get(given["event_id"])
            if outcome is None:
                outcome = ask(prompt)
                waiting.append({**given, **outcome, **constants})
                if len(waiting) >= log.flush_rows:
                    log.write(waiting)
                    waiting = []
            yield outcome
    finally:
        if waiting:
            log.write(waiting)


def logits_with(text: Column, backend_factory: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Column:
    """Logits of a text column from a user backend, built once per worker and fed in batches."""

    @F.pandas_udf("array<double>")
    def infer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        backend = backend_factory()
        for batch in batches:
            yield pd.Series(backend(batch.tolist()), dtype=object)

    return infer(text)


def classify_posts(
    posts: DataFrame,
    dim: DataFrame,
    backend_factory: Callable[[], Callable[[list[str]], list[list[float]]]],
    max_posts: int = 200,
) -> DataFrame:
    """Prediction per post: the newest ``max_posts`` of each author, empty texts skipped.

    ``source_index`` keeps the position before skipping. The probability is the softmax value of
    the first largest logit.
    """
    normalized = first_n_posts(posts, max_posts).withColumn("norm", T.normalize_for_classifier(F.col("content")))
    scored = normalized.filter(F.col("norm") != "").withColumn("logits", logits_with(F.col("norm"), backend_factory))
    picked = scored.withColumn("probs", S.softmax(F.col("logits"))).withColumns(
        {"index": S.argmax(F.col("probs")), "prob": F.array_max("probs")}
    )
    return label_for_index(picked, dim).select(
        "pubkey", "event_id", "source_index", "id", "char", "def", "prob"
    )


def attempt_outcomes(attempts: DataFrame, max_retries: int = 5, base_ms: int = 1000, max_ms: int = 60000) -> DataFrame:
    """State per item after its logged attempts (``event_id, attempt, status_code, retry_after``).

    Status 0 is a network error or timeout; it, 429 and 5xx may be retried until ``max_retries``
    is used up, every other non-200 status is final. ``max_delay_ms`` bounds the wait before the
    next attempt: the server's whole seconds when given, else the exponential backoff ceiling.
    """
    last = attempts.groupBy("event_id").agg(
        F.max(F.struct("attempt", "status_code", "retry_after")).alias("last"), F.count(F.lit(1)).alias("attempts")
    )
    status, number = F.col("last.status_code"), F.col("last.attempt")
    retryable = (status == 0) | (status == 429) | status.between(500, 599)
    pending = retryable & (number < int(max_retries))
    backoff = F.least(F.lit(int(max_ms)).cast("long"), (F.lit(int(base_ms)) * F.pow(F.lit(2), number)).cast("long"))
    server = F.when(status != 0, F.col("last.retry_after") * 1000)
    return last.select(
        "event_id",
        "attempts",
        status.alias("last_status"),
        retryable.alias("retryable"),
        F.when(status == 200, F.lit("ok"))
        .when(pending, F.lit("retry"))
        .when(retryable, F.lit("exhausted"))
        .otherwise(F.lit("failed"))
        .alias("outcome"),
        F.when(pending, F.coalesce(server, backoff)).alias("max_delay_ms"),
    )


def answers_to_labeled(valid: DataFrame, model: str, pass_number: int = 1, answer: str = "answer") -> DataFrame:
    """Labeled rows from valid VARIANT answers; the dimension's id replaces the model's id."""
    v = F.col(answer)
    label = T.normalize_label(F.try_variant_get(v, "$.label", "string"))
    return valid.select(
        "event_id",
        "pubkey",
        "created_at",
        "content",
        label.alias("label"),
        label_id_of(label).alias("label_id"),
        F.try_variant_get(v, "$.confidence", "double").alias("confidence"),
        F.try_variant_get(v, "$.rationale", "string").alias("rationale"),
        F.try_variant_get(v, "$.is_uncertain", "boolean").alias("is_uncertain"),
        F.lit(pass_number).alias("pass"),
        F.lit(model).alias("source"),
    )
