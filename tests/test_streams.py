"""Stateful streams over several batches and restarts, against plain versions."""

from __future__ import annotations

import json
import os
import random
import subprocess
import sys
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from postloom.operators.labeling import Reply
from postloom.operators.labels import LABEL_CHARS
from postloom.operators.observations import fold_observations
from postloom.streaming import labeling, state

LOG = "event_id string, ord bigint, ok boolean, label string"
SEEN = "event_id string, pubkey string, created_at bigint, content string, relay string, seq bigint"


def test_relabels_take_the_former_label_back(spark, tmp_path):
    rng = random.Random(1)
    seed = [(f"e{k}", "old") for k in range(6)] + [("never", None)]
    rows = [(f"e{rng.randrange(12)}", k, rng.random() < 0.8, rng.choice("abc")) for k in range(90)]
    late = rows[::7]  # these arrive behind younger answers
    batches = [[r for r in rows[a : a + 30] if r not in late] for a in (0, 30, 60)] + [late]
    counts = state.RelabelCounts(f"{tmp_path}/counts", f"{tmp_path}/cp", spark.createDataFrame(seed, "event_id string, label string"))
    for batch in batches:
        spark.createDataFrame(batch, LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        counts.run(spark.readStream.schema(LOG).parquet(f"{tmp_path}/in"))  # each run starts the query anew
    last = {e: label for e, label in seed if label}
    for event, _, ok, label in sorted(rows, key=lambda r: r[1]):
        if ok:
            last[event] = label
    got = {r.label: r["count"] for r in counts.counts(spark.range(1)).collect()}
    assert got == dict(Counter(last.values()))
    fresh = state.RelabelCounts(f"{tmp_path}/counts", f"{tmp_path}/cp", counts.seed, counted=False)
    uncounted = {r.label: r["count"] for r in fresh.counts(spark.range(1)).collect()}
    assert uncounted.get("old", 0) == got.get("old", 0) - 6


def test_relabel_state_is_kept_by_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "EVENT_BUCKETS", 5)
    monkeypatch.setattr(state, "ROWS_PACKED", 50)
    rng = random.Random(2)
    ids = [None, "null", "", 'q"[,', "\u6f22\U0001f642", *(f"e{k}" for k in range(95))]
    labels = [None, "null", "a", "\u611b"]
    seed = [(i, "old") for i in ids[:20]] + [("never", None), ("once", "kept")]
    rows = [(rng.choice(ids), k, rng.random() < 0.8, rng.choice(labels)) for k in range(600)] + [("noord", None, True, "first"), ("noord", 3, True, "a")]
    rng.shuffle(rows)  # older answers arrive behind younger ones
    counts = state.RelabelCounts(f"{tmp_path}/counts", f"{tmp_path}/cp", spark.createDataFrame(seed, "event_id string, label string"))
    for a in range(0, len(rows), 201):
        spark.createDataFrame(rows[a : a + 201], LOG).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        counts.run(spark.readStream.schema(LOG).parquet(f"{tmp_path}/in"))
    last = {e: label for e, label in seed if label}
    for event, _, ok, label in sorted(rows, key=lambda r: -1 if r[1] is None else r[1]):
        if ok:
            last[event] = label
    assert {r.label: r["count"] for r in counts.counts(spark.range(1)).collect()} == dict(Counter(last.values()))
    # A hundred events are five keys of state.
    assert spark.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", "latest").load().count() <= 5


def test_replayed_batch_adds_its_changes_once(spark, tmp_path):
    spark.createDataFrame([("e", 1, True, "a")], LOG).write.parquet(f"{tmp_path}/in")
    counts = state.RelabelCounts(f"{tmp_path}/counts", f"{tmp_path}/cp")
    counts.run(spark.readStream.schema(LOG).parquet(f"{tmp_path}/in"))
    (tmp_path / "cp" / "commits" / "0").unlink()  # as after a crash behind the write
    (tmp_path / "cp" / "commits" / ".0.crc").unlink()
    counts.run(spark.readStream.schema(LOG).parquet(f"{tmp_path}/in"))
    assert [tuple(r) for r in counts.counts(spark.range(1)).collect()] == [("a", 1)]


def test_seed_is_state_and_not_read_again(spark, tmp_path):
    schema = "event_id string, seq bigint"

    def arrive(ids, seed):
        spark.createDataFrame([(i, n) for n, i in enumerate(ids)], schema).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        known = spark.createDataFrame([(i,) for i in seed], "event_id string")
        labeling.write_available(labeling.stream_dedup(source, seed=known), f"{tmp_path}/out", f"{tmp_path}/cp")
        return sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").select("event_id").collect())

    assert arrive(["a", "b", "b", "c"], ["a"]) == ["b", "c"]
    # Another seed at a restart changes nothing: the first one lives in the state.
    assert arrive(["a", "c", "d"], ["d"]) == ["b", "c", "d"]


def test_fold_stream_equals_the_batch_fold(spark, tmp_path):
    rng = random.Random(4)
    author = {k: f"p{k % 3}" for k in range(40)}
    rows = []
    for seq in range(240):
        event = rng.randrange(40) if seq > 80 else rng.randrange(15)
        text = rng.choice(["text", "text", "nostr:" + "a" * 8, "　"]) if event > 30 else f"text {event}"
        rows.append((f"e{event}", author[event], 100 + seq, text, rng.choice(["r1", "r2", "r3", None]), seq))
    for a in (0, 80, 160):
        spark.createDataFrame(rows[a : a + 80], SEEN).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(SEEN).parquet(f"{tmp_path}/in")
        labeling.write_available(state.fold_stream(source, author_cap=4), f"{tmp_path}/out", f"{tmp_path}/cp")
    columns = ["event_id", "pubkey", "created_at", "content", "relay", "seq", "n_obs"]
    got = state.read_fold(spark.read.parquet(f"{tmp_path}/out")).select(*columns).collect()
    want = fold_observations(spark.createDataFrame(rows, SEEN), author_cap=4).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 12


# --- labeling until every label is filled ------------------------------------------------------
POSTS = "event_id string, pubkey string, created_at bigint, content string"


def label_by_text(prompt, attempt):
    text = prompt.rsplit("\n", 1)[-1]
    if text.startswith("ぺ"):
        return Reply(error="http_500")
    idx = int(text[-1])
    return Reply(text=json.dumps({"label": LABEL_CHARS[idx], "label_id": idx, "confidence": 0.9, "rationale": "r", "is_uncertain": False}))


def post(n, idx, head="ねこがすきです"):
    return (f"e{n}", "p", n, f"{head}{'に' * (n + 1)}{idx}")


def test_stops_cleanly_and_labels_the_parked_batch_later(spark, tmp_path):
    slices = [[post(0, 0), post(1, 1), post(9, 1, "ぺんぎんです")], [post(2, 0)], [post(3, 1), post(0, 0)], [post(4, 1)]]
    for rows in slices:
        spark.createDataFrame(rows, POSTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = defaultdict(list)

    def job(least):
        return labeling.LabelStream(
            label_by_text, "m", f"{tmp_path}/out", f"{tmp_path}/cp", min_per_label=least, targets=LABEL_CHARS[:2], max_retries=0,
            on_labeled=lambda rows, batch: seen["ok"].extend(r.event_id for r in rows.collect()),
            on_failure=lambda rows, batch: seen["failed"].extend(r.event_id for r in rows.collect()),
            on_progress=lambda report: seen["batches"].append(report["batchId"]),
        )

    def source():
        return spark.readStream.schema(POSTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    first = job(1).run(source())
    assert first.complete and first.query.exception() is None and not first.query.isActive
    assert sorted(seen["ok"]) == ["e0", "e1"] and seen["failed"] == ["e9"] and 0 in seen["batches"]
    assert first.funnel["raw_fetched"] == 3 and first.funnel["label_failure"] == 1
    second = job(2).run(source())
    assert second.query.exception() is None and second.complete
    assert sorted(seen["ok"]) == ["e0", "e1", "e2", "e3"]  # the parked one, then the next; e0 only once
    third = job(9).run(source())
    assert not third.complete and third.query.exception() is None
    assert sorted(r.event_id for r in third.outcomes(spark).filter("ok").collect()) == ["e0", "e1", "e2", "e3", "e4"]
    assert third.counts[LABEL_CHARS[0]] == 2 and third.counts[LABEL_CHARS[1]] == 3


def test_failure_of_a_hook_is_an_error(spark, tmp_path):
    import pytest

    spark.createDataFrame([post(0, 0)], POSTS).write.parquet(f"{tmp_path}/in")

    def broken(rows, batch):
        raise ValueError("broken hook")

    job = labeling.LabelStream(label_by_text, "m", f"{tmp_path}/out", f"{tmp_path}/cp", on_batch=broken)
    with pytest.raises(Exception, match="broken hook"):
        job.run(spark.readStream.schema(POSTS).parquet(f"{tmp_path}/in"))


def test_stored_files_come_before_live_ones_over_restarts(spark, tmp_path):
    from postloom.sources.replay import replay_then_live

    def write(folder, name, ids):
        (tmp_path / folder).mkdir(exist_ok=True)
        lines = [json.dumps({"event_id": i, "content": "行" * (k % 7), "pubkey": "p"}, ensure_ascii=False) for k, i in enumerate(ids)]
        (tmp_path / folder / name).write_text("\n".join([*lines[:3], "broken {", "", *lines[3:]]) + "\n" * (len(ids) % 2))

    write("old1", "a.jsonl", [f"a{k}" for k in range(30)])
    write("old1", "b.jsonl", [f"b{k}" for k in range(5)])
    write("old1", "c.jsonl", ["c0"])
    write("old2", "a.jsonl", [f"d{k}" for k in range(9)])
    write("live", "1.jsonl", ["e0", "e1"])
    batches = []

    def run():
        rows = replay_then_live(spark, [f"{tmp_path}/old1", f"file:{tmp_path}/absent", f"{tmp_path}/old2"], f"{tmp_path}/live", max_files=2, range_bytes=64)

        def keep(batch, batch_id):
            found = [(r.source_rank, r.event_id) for r in batch.orderBy("source_rank", "line_order").collect()]
            if found:
                batches.append((batch_id, found))

        rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    for _ in range(4):  # every run is a restart
        run()
    write("live", "2.jsonl", ["f0"])
    run()
    run()
    assert [b for b, _ in batches] == sorted({b for b, _ in batches})
    want = [(0, f"a{k}") for k in range(30)] + [(0, f"b{k}") for k in range(5)] + [(0, "c0")] + [(2, f"d{k}") for k in range(9)] + [(3, "e0"), (3, "e1"), (3, "f0")]
    assert [r for _, rows in batches for r in rows] == want
    assert all(len({rank for rank, _ in rows}) == 1 for _, rows in batches)
    # A batch that was not committed is read again, as it was.
    last = max(int(p.name) for p in (tmp_path / "cp" / "commits").iterdir() if p.name.isdigit())
    (tmp_path / "cp" / "commits" / str(last)).unlink()
    (tmp_path / "cp" / "commits" / f".{last}.crc").unlink()
    run()
    assert batches[-1] == batches[-2] and batches[-1][0] == last


PLAIN_SESSION = """
import sys
root, tmp = sys.argv[1:]
sys.path.insert(0, root)
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config(map={
    "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": f"{tmp}/shared"}).getOrCreate()
from postloom.session import ship_packages
from postloom.streaming import labeling, state
ship_packages(spark)
rows = [("a", "p", 1, "x", "r", 0), ("b", "p", 2, "y", "r", 1), ("b", "p", 3, "y", "q", 2)]
schema = "event_id string, pubkey string, created_at bigint, content string, relay string, seq bigint"
spark.createDataFrame(rows, schema).write.parquet(f"{tmp}/in")
read = lambda: spark.readStream.schema(schema).parquet(f"{tmp}/in")
seed = spark.createDataFrame([("a",)], "event_id string")
labeling.write_available(labeling.stream_dedup(read(), seed=seed), f"{tmp}/out", f"{tmp}/cp")
counts = state.RelabelCounts(f"{tmp}/counts", f"{tmp}/cp2")
outcomes = read().select("event_id", F.col("seq").alias("ord"), F.lit(True).alias("ok"), F.col("relay").alias("label"))
counts.run(outcomes)
labeling.write_available(state.fold_stream(read()), f"{tmp}/fold", f"{tmp}/cp3")
folded = state.read_fold(spark.read.parquet(f"{tmp}/fold"))
print("FOUND", [r.event_id for r in spark.read.parquet(f"{tmp}/out").collect()],
      sorted(tuple(r) for r in counts.counts(spark.range(1)).collect()),
      sorted((r.event_id, r.relay, r.n_obs) for r in folded.collect()))
"""


def test_stateful_streams_in_a_plain_session_of_another_folder(tmp_path):
    """The driver's own Python process has no shipped packages, and Spark's default state store cannot hold these states."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", PLAIN_SESSION, root, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    found = [line[line.index("FOUND"):] for line in run.stdout.splitlines() if "FOUND" in line]
    assert found == ["FOUND ['b'] [('q', 1), ('r', 1)] [('a', ['r'], 1), ('b', ['r', 'q'], 2)]"], run.stderr[-2000:]
