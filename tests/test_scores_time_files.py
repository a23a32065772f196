"""Scores, calendar windows, ranks, files and streams on literal rows."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from postloom.functions import calendar as C
from postloom.functions import scores as S
from postloom.operators import activity, sampling
from postloom.operators.labeling import Reply
from postloom.operators.labels import LABEL_CHARS, label_dim, label_for_index
from postloom.operators.progress import label_share
from postloom.sources import jsonl, snapshots
from postloom.streaming.labeling import LabelStream, stream_dedup, write_available

DAY = 86400


def test_softmax_topk_share(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0, 0.0]), (1, [1000.0, 1001.0, 1002.0]), (2, [])], "i int, x array<double>")
    got = [r.p for r in rows.select("i", S.softmax(F.col("x")).alias("p")).orderBy("i").collect()]
    assert got[0] == pytest.approx([1 / 3] * 3) and sum(got[1]) == pytest.approx(1) and got[2] == []
    assert got[1][2] == pytest.approx(1 / (1 + math.exp(-1) + math.exp(-2)))
    top = spark.createDataFrame([([0.1, 0.7, 0.2],)], "p array<double>").select(S.top_k(F.col("p"), 2).alias("t")).first().t
    assert [(t["index"], t["prob"]) for t in top] == [(1, 0.7), (2, 0.2)]
    assert len(spark.createDataFrame([([0.1],)], "p array<double>").select(S.top_k(F.col("p"), 3).alias("t")).first().t) == 1
    named = label_for_index(spark.createDataFrame([(0,), (0,), (45,), (46,), (99,)], "index int"), label_dim(spark))
    share = label_share(named).collect()
    assert (share[0].char, share[0]["count"], share[0].share) == ("愛", 2, 0.4)
    assert {r.id: r.char for r in share}[99] == "?"


def test_calendar(spark):
    now = 1781276400  # 2026-06-12 15:00:00 UTC
    one = spark.range(1)
    start = one.select(C.recent_days_start(now, 7)).first()[0]
    assert start == now - 15 * 3600 - 6 * DAY
    for days in (0, -5, None):
        assert one.select(C.recent_days_start(now, days)).first()[0] == now - 15 * 3600
    assert one.select(C.local_day_key(F.lit(start))).first()[0] == "2026-6-6"
    assert one.select(C.day_range_label(now, 7)).first()[0] == "2026/6/6 〜 2026/6/12"
    slices = one.select(F.inline(C.slice_bounds(now, 10, 3))).collect()
    assert [(s.until_sec - s.since_sec) // DAY for s in slices] == [3, 3, 3, 1]
    hits = one.select(C.slices_of(F.lit(now - 3 * DAY).cast("long"), now, 10, 3)).first()[0]
    assert hits == [0, 1]
    assert one.select(C.slices_of(F.lit(now - 11 * DAY).cast("long"), now, 10, 3)).first()[0] == []


def test_active_days(spark):
    base = 1781092800
    rows = spark.createDataFrame([(base,), (base + 60,), (base + 2 * DAY,), (None,)], "created_at long")
    assert tuple(activity.active_day_stats(rows).first()) == (2, base, base + 2 * DAY)
    assert activity.active_day_stats(rows.limit(0)).count() == 0


def test_split_sizes_and_skewed_label(spark):
    rows = spark.range(5000).select(
        F.col("id").alias("seq"), F.when(F.col("id") < 4990, 0).when(F.col("id") < 4999, 1).otherwise(2).alias("label_id")
    )
    split = sampling.stratified_split(rows, 0.25, 9)
    sizes = {(r.label_id, r.split): r["count"] for r in split.groupBy("label_id", "split").count().collect()}
    assert sizes == {(0, "val"): 1248, (0, "train"): 3742, (1, "val"): 2, (1, "train"): 7, (2, "train"): 1}
    ranked = sorted(range(4990), key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest())[:1248]
    assert {r.seq for r in split.filter("label_id = 0 and split = 'val'").collect()} == set(ranked)


def test_coverage_subset_order(spark):
    rows = spark.createDataFrame(
        [("a", 2), ("b", 0), ("c", 2), ("d", 1), ("e", 9), ("f", 2), (" gg ", 0)], "content string, label_id int"
    ).withColumn("seq", F.monotonically_increasing_id())
    picked = sampling.coverage_subset(rows.coalesce(1), 3, per_label=2, max_total=4, max_chars=1)
    assert [(r.content, r.label_id) for r in picked.collect()] == [("b", 0), ("d", 1), ("a", 2), ("g", 0)]


def test_rate_window_edges(spark):
    times = [0.0, 59.999999, 60.0, 60.0, 119.5]
    rows = spark.createDataFrame([(x,) for x in times], "s double").select(F.timestamp_micros((F.col("s") * 1000000).cast("long")).alias("ts"))
    got = activity.rate_window_audit(rows, limit_per_window=2).orderBy("ts_micros").collect()
    assert [(r.in_window, r.over_limit) for r in got] == [(1, False), (2, False), (3, True), (4, True)]


def test_files(spark, tmp_path):
    assert jsonl.scan_jsonl(spark, f"{tmp_path}/none", "a int").count() == 0
    path = tmp_path / "x.jsonl"
    path.write_text('{"event_id":"1","n":"x"}\n\n  {broken\n{"event_id":""}\n 7 \n', encoding="utf-8")
    assert jsonl.scan_jsonl(spark, str(path), "event_id string, n int").count() == 3
    assert [tuple(r) for r in jsonl.raw_replay(spark, str(path), "event_id string, n int").collect()] == [("1", None)]
    doc = tmp_path / "doc.json"
    doc.write_text('{\n"model":"m",\n"items":[{"a":1},\n{"a":2}]}', encoding="utf-8")
    got = snapshots.scan_snapshot_records(spark, str(doc)).collect()
    assert [(r.source_record_index, r.fallback_model) for r in got] == [(0, "m"), (1, "m")]
    assert snapshots.scan_snapshot_records(spark, f"{tmp_path}/none.json").count() == 0
    assert snapshots.read_snapshot(spark, f"{tmp_path}/snap") is None
    bad = tmp_path / "map.json"
    bad.write_text('{"labels":[]}', encoding="utf-8")
    with pytest.raises(ValueError):
        snapshots.read_label_map(spark, str(bad))


def labeler(prompt, attempt):
    label = prompt.rsplit("\n", 1)[1][:1]
    idx = LABEL_CHARS.index(label)
    return Reply(text=f'{{"label":"{label}","label_id":{idx},"confidence":1,"rationale":"r","is_uncertain":false}}')


def source(spark, root, batches):
    schema = "event_id string, content string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def test_stream_stops_when_complete_and_resumes(spark, tmp_path):
    root = str(tmp_path)
    text = "愛のあることば", "欲のあることば"
    batches = [
        [("1", text[0]), ("2", "plain english"), ("2", "plain english")],
        [("1", text[0]), ("3", text[1]), ("4", text[0])],
        [("5", text[0])],
    ]
    stream = source(spark, root, batches)
    job = LabelStream(labeler, "m", f"{root}/out", f"{root}/cp", min_per_label=1, targets=LABEL_CHARS[:2])
    first = job.run(stream)
    assert first.complete and first.counts == {"愛": 2, "欲": 1}
    assert first.funnel == {
        "raw_fetched": 6, "language_excluded": 2, "language_pass": 4,
        "dedup_skipped": 1, "queued": 3, "label_success": 3, "label_failure": 0,
    }
    # A higher target picks up the batch that was left uncommitted.
    job.min_per_label = 2
    second = job.run(stream)
    assert not second.complete and second.counts == {"愛": 3, "欲": 1}
    assert {r.event_id for r in second.outcomes(spark).collect()} == {"1", "3", "4", "5"}


def test_stream_dedup_with_seed(spark, tmp_path):
    root = str(tmp_path)
    stream = source(spark, root, [[("1", "a"), ("2", "b")], [("1", "a"), ("3", "c")]])
    seed = spark.createDataFrame([("2",)], "event_id string")
    write_available(stream_dedup(stream, seed=seed), f"{root}/out", f"{root}/cp")
    assert sorted(r.event_id for r in spark.read.parquet(f"{root}/out").collect()) == ["1", "3"]


def test_large_documents_are_read_as_small_ones(spark, tmp_path):
    import json
    import random

    from postloom.sources.large_documents import document_entries
    from postloom.sources.snapshots import scan_snapshot_records

    rng = random.Random(8)
    texts = ["a", "", "with , comma", 'quote " and \\ back', "br]ack{et}s [", "日本 \n\t", "\\", '\\"', "}],[{"]

    def value(depth=0):
        kind = rng.randrange(7 if depth < 3 else 4)
        if kind == 4:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        if kind >= 5:
            return {rng.choice(texts) + str(k): value(depth + 1) for k in range(rng.randrange(4))}
        return [rng.choice(texts), rng.randrange(99), None, True][kind]

    docs = {"a": {"items": [value() for _ in range(300)], "model": "m"}, "b": {"model": "x,y", "other": [[1], [2, {"items": [3]}]], "items": [value() for _ in range(40)], "document_order": 3, "z": {}},
            "c": {"items": []}, "d": {"items": {}}, "e": [1, {"items": [2]}], "f": {"first": 1, "items": [5], "last": [1, 2]}, "g": {"items": [[[]]]}}
    (tmp_path / "in").mkdir()
    for name, doc in docs.items():
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])))
    for name, text in {"h": '{"items": [1, 2}', "i": '{"items": [1, x, 2]}', "j": "", "k": '{"items": [1], "items": [2]}', "l": '{"a": 1, "items": [1, 2], "b": tru}'}.items():
        (tmp_path / "in" / f"{name}.json").write_text(text)
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    columns = ["file", "place", "model", "rank", "body"]

    def listed(df):
        return sorted(tuple(r) for r in df.selectExpr("regexp_extract(file, '([a-z]).json', 1) AS file", "place", "model", "rank", "to_json(record) AS body").select(*columns).collect())

    whole = scan_snapshot_records(spark, f"{tmp_path}/in").selectExpr(
        "record_order.line_order.file", "CAST(source_record_index AS BIGINT) AS place", "coalesce(fallback_model, '') AS model", "record_order.append AS rank", "record"
    )
    want = listed(whole)
    assert {w[0] for w in want} == {"a", "b", "f", "g"}
    try:
        for size in ("97", "700", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = document_entries(spark, f"{tmp_path}/in").selectExpr("file", "source_record_index AS place", "coalesce(model, '') AS model", "rank", "record")
            assert listed(found) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    assert document_entries(spark, f"{tmp_path}/absent").count() == 0


def test_short_ranges_of_a_large_document_share_tasks(spark, tmp_path):
    import json

    from postloom.sources.snapshots import scan_snapshot_records

    items = [{"n": n, "text": 'so "it" goes, [' * (n % 7)} for n in range(3000)]
    for name in "ab":
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps({"model": name, "items": items}))
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    sc = spark.sparkContext
    sc.setJobGroup("short-ranges", "short ranges")
    try:
        found = scan_snapshot_records(spark, f"{tmp_path}/in", split=True, range_bytes=1024)
        rows = found.selectExpr("fallback_model", "source_record_index", "to_json(record)").collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((m, i, json.loads(r)["n"], json.loads(r)["text"]) for m, i, r in rows) == sorted((m, i, x["n"], x["text"]) for m in "ab" for i, x in enumerate(items))
    status = sc.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("short-ranges") for s in status.getJobInfo(j).stageIds]
    # There are some 500 ranges.
    assert max(s.numTasks for s in stages if s is not None) <= 32
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == usual
