"""Readers, writers and stream jobs over files that the query derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks import stubs
from checks import views as V
from checks.registry import query
from postloom.operators import labels, resume
from postloom.operators.keyed import side_by_side
from postloom.plans import training
from postloom.session import materialize, scratch_path
from postloom.sources import jsonl, replay, snapshots
from postloom.streaming import labeling as stream
from postloom.streaming import state

W = V.with_views
RAW = ("event_id", "pubkey", "created_at", "content", "relay")


def raw_lines(spark, sf_dir) -> str:
    """Posts as JSONL with a blank and a broken line beside each post; returns the folder."""
    path = scratch_path(spark, "raw")
    record = F.to_json(F.struct(*RAW))
    lines = V.posts(spark, sf_dir).select(
        F.explode(F.array(record, F.lit("   "), F.substring(record, 1, 20), F.concat(F.lit("  "), record))).alias("value")
    )
    lines.write.text(path)
    return path


@query(
    "scan_jsonl",
    W("posts") + """SELECT event_id, pubkey, created_at, md5(content) AS digest, relay, 2::BIGINT AS copies FROM posts""",
)
def scan_jsonl(spark, sf_dir):
    rows = jsonl.scan_jsonl(spark, raw_lines(spark, sf_dir), jsonl.RAW_SCHEMA)
    return rows.groupBy(
        "event_id", "pubkey", "created_at", F.md5("content").alias("digest"), F.array_join("relay", ",").alias("relay")
    ).agg(F.count(F.lit(1)).alias("copies"))


@query(
    "raw_replay",
    W("observations") + "SELECT event_id, relay, seq FROM observations WHERE relay <> 'r1'",
)
def raw_replay(spark, sf_dir):
    path = scratch_path(spark, "replay")
    rows = V.observations(spark, sf_dir).withColumn(
        "event_id", F.when(F.col("relay") == "r1", F.lit("")).otherwise(F.col("event_id"))
    )
    rows.select("event_id", "relay", "seq").write.json(path)
    return jsonl.raw_replay(spark, path, "event_id STRING, relay STRING, seq BIGINT")


@query(
    "raw_replay_stream",
    W("posts") + "SELECT event_id, pubkey, created_at, 2::BIGINT AS copies FROM posts",
)
def raw_replay_stream(spark, sf_dir):
    out = scratch_path(spark, "replayed")
    rows = jsonl.raw_replay_stream(spark, raw_lines(spark, sf_dir), max_files_per_trigger=2)
    stream.write_available(rows, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").groupBy("event_id", "pubkey", "created_at").agg(
        F.count(F.lit(1)).alias("copies")
    )


@query(
    "scan_snapshot_items",
    W("chats") + """SELECT event_id, row_number() OVER (PARTITION BY pubkey, turn // 50 ORDER BY turn) - 1 AS source_record_index,
      'model-' || pubkey AS fallback_model FROM chats""",
)
def scan_snapshot_items(spark, sf_dir):
    # One document per line for every fifty turns of a conversation: {"model": ..., "items": [...]}.
    path = scratch_path(spark, "documents")
    items = F.array_sort(F.collect_list(F.struct("turn", "event_id", "content")))
    docs = V.chats(spark, sf_dir).groupBy("pubkey", F.floor(F.col("turn") / 50)).agg(items.alias("items"))
    body = F.to_json(F.struct(F.concat(F.lit("model-"), "pubkey").alias("model"), "items"))
    docs.select(body.alias("value")).write.text(path)
    rows = snapshots.scan_snapshot_records(spark, path, document_per_line=True)
    return rows.select(
        F.try_variant_get("record", "$.event_id", "string").alias("event_id"),
        F.col("source_record_index").cast("long").alias("source_record_index"),
        "fallback_model",
    )


@query(
    "scan_large_document",
    W("chats") + """SELECT event_id, content, row_number() OVER (ORDER BY seq) - 1 AS source_record_index, 'big' AS fallback_model FROM chats""",
)
def scan_large_document(spark, sf_dir):
    """All turns as the items of one document in a single line, read in ranges of 64 KB."""
    path = scratch_path(spark, "large-document")
    lines = V.chats(spark, sf_dir).select("seq", F.to_json(F.struct("event_id", "content", "seq")).alias("line"))
    # Written sorted, as lines behind commas, then as one line between brackets.
    placed = lines.withColumn("value", F.concat(F.when(F.col("seq") == lines.agg(F.min("seq")).scalar(), F.lit('{"model":"big","items":[')).otherwise(F.lit(",")), "line"))
    closed = placed.select("seq", "value").unionByName(spark.range(1).select(F.lit(2**62).alias("seq"), F.lit('],"count":"[1, {2}"}').alias("value")))
    # One line is written by one task, which is handed the lines by all others.
    closed.repartition(1).sortWithinPartitions("seq").select("value").write.option("lineSep", " ").text(path)
    rows = snapshots.scan_snapshot_records(spark, path, split=True, range_bytes=65536)
    return rows.select(
        F.try_variant_get("record", "$.event_id", "string").alias("event_id"), F.try_variant_get("record", "$.content", "string").alias("content"),
        F.col("source_record_index").cast("long").alias("source_record_index"), "fallback_model",
    )


@query(
    "append_log",
    W("labeled", "attempts") + """SELECT event_id, ok, label, ord FROM attempts UNION ALL
      SELECT event_id, ok, label, -1 FROM labeled""",
)
def append_log(spark, sf_dir):
    path = scratch_path(spark, "log")
    keep = ("event_id", "ok", "label", "ord")
    jsonl.append_log(V.attempts(spark, sf_dir).select(*keep), path)
    jsonl.append_log(V.labeled(spark, sf_dir).withColumn("ord", F.lit(-1).cast("long")).select(*keep), path)
    return jsonl.scan_jsonl(spark, path, "event_id STRING, ok BOOLEAN, label STRING, ord BIGINT")


@query(
    "snapshot_overwrite",
    W("snapshot") + "SELECT event_id, label, confidence FROM snapshot",
)
def snapshot_overwrite(spark, sf_dir):
    root = scratch_path(spark, "snapshot")
    snapshots.write_snapshot(V.labeled(spark, sf_dir).select("event_id", "label", "confidence"), root)
    snapshots.write_snapshot(V.snapshot(spark, sf_dir).select("event_id", "label", "confidence"), root)
    return snapshots.read_snapshot(spark, root)


@query(
    "label_map_dim",
    W("labeled", "dim") + """SELECT d.label_id, d.label, definition, is_qa, count(event_id) AS rows, 47 AS num_labels
      FROM dim d LEFT JOIN labeled l USING (label) GROUP BY ALL""",
)
def label_map_dim(spark, sf_dir):
    path = scratch_path(spark, "label-map")
    snapshots.write_label_map(labels.label_dim(spark), path)
    loaded = snapshots.read_label_map(spark, path)
    usage = V.labeled(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    size = snapshots.num_labels(loaded).select("num_labels")
    used = loaded.join(usage, "label", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return side_by_side(used, size)


@query(
    "export_files",
    W("chats") + """SELECT event_id, label, created_at, source_model FROM (
      SELECT event_id, CASE WHEN role = 'user' THEN '愛' ELSE '猫' END AS label, created_at::DOUBLE AS created_at,
        CASE WHEN role = 'user' THEN 'doc-model' ELSE role END AS source_model FROM chats WHERE trim(content) <> ''
      UNION ALL SELECT 's' || event_id, '犬', created_at::DOUBLE, 'unknown' FROM chats WHERE trim(content) <> '')""",
)
def export_files(spark, sf_dir):
    """Whole export from files: a real snapshot and log, a synthetic log and no synthetic snapshot."""
    root = scratch_path(spark, "export")
    rows = V.chats(spark, sf_dir).select(
        "event_id", "pubkey", "turn", "content", "created_at", "role",
        F.when(F.col("role") == "user", F.lit("愛")).otherwise(F.lit("猫")).alias("label"),
    )
    item = F.struct("event_id", "content", "created_at", "label")
    users = rows.filter(F.col("role") == "user")
    parts = users.groupBy("pubkey", F.floor(F.col("turn") / 50))
    docs = parts.agg(F.lit("doc-model").alias("model"), F.collect_list(item).alias("items"))
    docs.select("model", "items").write.json(f"{root}/in/real-labels.json")
    log = rows.filter(F.col("role") != "user").withColumnRenamed("role", "source").withColumn("ok", F.lit(True))
    jsonl.append_log(log, f"{root}/in/real-log")
    failed = rows.select("event_id", F.lit(False).alias("ok"), F.lit("x").alias("reason"))
    jsonl.append_log(failed, f"{root}/in/real-log")
    made = rows.select(F.concat(F.lit("s"), "event_id").alias("event_id"), "content", "created_at", F.lit("犬").alias("label"))
    jsonl.append_log(made.withColumn("ok", F.lit(True)), f"{root}/in/synthetic-log")
    training.export_training_set(spark, f"{root}/in", f"{root}/out", labels.label_dim(spark), document_per_line=True)
    schema = "event_id STRING, label STRING, created_at DOUBLE, source_model STRING"
    return jsonl.scan_jsonl(spark, f"{root}/out/dataset", schema)


@query(
    "export_last_wins",
    W("chats") + """SELECT event_id, CASE WHEN turn % 3 = 0 THEN '犬' WHEN turn % 2 = 0 THEN '猫' WHEN turn % 5 = 0 THEN '国' ELSE '愛' END AS label
      FROM chats WHERE trim(content) <> ''""",
)
def export_last_wins(spark, sf_dir):
    """The same ids in two documents and two appends of unequal size: the last record of each id stays."""
    root = scratch_path(spark, "last-wins")
    rows = V.chats(spark, sf_dir).select("event_id", "content", "created_at", "turn", "pubkey")

    def document(part, label: str, order: int):
        item = F.struct("event_id", "content", "created_at", F.lit(label).alias("label"))
        made = part.groupBy("pubkey").agg(F.lit(order).alias("document_order"), F.collect_list(item).alias("items"))
        made.drop("pubkey").write.mode("append").json(f"{root}/in/real-labels.json")

    document(rows.filter("turn % 5 <> 0"), "愛", 2)
    document(rows, "国", 1)
    for part, label, files in ((rows.filter("turn % 2 = 0"), "猫", 1), (rows.filter("turn % 3 = 0"), "犬", 7)):
        outcome = part.select("event_id", "content", "created_at", F.lit(label).alias("label"), F.lit(True).alias("ok"))
        jsonl.append_log(outcome.repartition(files), f"{root}/in/real-log")
    built = training.export_training_set(spark, f"{root}/in", f"{root}/out", labels.label_dim(spark), document_per_line=True)
    return built.rows.select("event_id", "label")


# --- streams --------------------------------------------------------------------------------------
@query("stream_dedup", W("observations") + "SELECT DISTINCT event_id FROM observations WHERE event_id NOT LIKE 'b%'")
def stream_dedup(spark, sf_dir):
    root = scratch_path(spark, "dedup")
    rows = V.observations(spark, sf_dir)
    rows.select("event_id", "relay").repartition(3).write.parquet(f"{root}/in")
    seed = rows.filter(F.col("event_id").startswith("b")).select("event_id").distinct()
    source = spark.readStream.schema("event_id STRING, relay STRING").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    stream.write_available(stream.stream_dedup(source, seed=seed), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").select("event_id")


STREAM_COLUMNS = ("event_id", "pubkey", "created_at", "content", "seq")
STREAM_SCHEMA = "event_id STRING, pubkey STRING, created_at BIGINT, content STRING, seq BIGINT"
SLICES, FILES_PER_SLICE = 4, 8
# Row groups of the files, so that many tasks can share a large one.
GROUP_BYTES = 8 << 20


def write_slices(spark, sf_dir, root: str) -> None:
    """Japanese-like posts and chats in four groups of files, written in arrival order.

    Each post comes twice: the second copy arrives one slice later.
    """
    posts = V.jposts(spark, sf_dir).select(*STREAM_COLUMNS).withColumn("half", F.lit(0))
    chats = V.chats(spark, sf_dir).select(*STREAM_COLUMNS).withColumns(
        {"event_id": F.concat(F.lit("c"), "event_id"), "half": F.lit(0)}
    )
    both = posts.unionByName(chats).withColumn("slice", F.pmod("seq", F.lit(SLICES - 1)))
    # Kept by slice, so that each slice is read from its own folder.
    path = scratch_path(spark, "posted")
    both.drop("half").write.partitionBy("slice").parquet(path)
    posted = spark.read.schema(both.drop("half").schema).parquet(path)
    rows = posted.unionByName(posted.withColumn("slice", F.col("slice") + 1))
    for i in range(SLICES):
        one = rows.filter(F.col("slice") == i).drop("slice").repartition(FILES_PER_SLICE)
        one.write.mode("append").option("parquet.block.size", GROUP_BYTES).parquet(f"{root}/in")


STREAM_SQL = dict(
    posted="""SELECT event_id, pubkey, created_at, content, seq, seq % 3 AS slice FROM jposts UNION ALL
      SELECT 'c' || event_id, pubkey, created_at, content, seq, seq % 3 FROM chats""",
    arrivals="SELECT * FROM posted UNION ALL SELECT * REPLACE (slice + 1 AS slice) FROM posted",
    gated=Q.gate("arrivals"),
    admitted="SELECT * FROM gated WHERE is_japanese QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY slice) = 1",
    outcomes=stubs.sql_outcome("admitted", "event_id, slice"),
)


def stream_source(spark, root: str):
    return spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", FILES_PER_SLICE).parquet(
        f"{root}/in"
    )


def run_stream(spark, sf_dir, **options):
    root = scratch_path(spark, "stream")
    write_slices(spark, sf_dir, root)
    job = stream.LabelStream(
        stubs.label_once, "stub", f"{root}/out", f"{root}/checkpoint", max_retries=2, **options
    )
    return job.run(stream_source(spark, root))


@query(
    "stream_labeling",
    W("jposts", "chats", **STREAM_SQL) + "SELECT event_id, ok, label, confidence, slice AS batch FROM outcomes",
)
def stream_labeling(spark, sf_dir):
    done = run_stream(spark, sf_dir, min_per_label=10**9)
    return done.outcomes(spark).select(
        "event_id", "ok", "label", "confidence", F.col("batch_id").cast("long").alias("batch")
    )


@query(
    "stream_funnel",
    W("jposts", "chats", **STREAM_SQL) + """SELECT name, value FROM (
      SELECT 'raw_fetched' AS name, count(*) AS value FROM gated
      UNION ALL SELECT 'language_excluded', count(*) FILTER (NOT is_japanese) FROM gated
      UNION ALL SELECT 'language_pass', count(*) FILTER (is_japanese) FROM gated
      UNION ALL SELECT 'dedup_skipped', count(*) FILTER (is_japanese) - (SELECT count(*) FROM admitted) FROM gated
      UNION ALL SELECT 'queued', count(*) FROM admitted
      UNION ALL SELECT 'label_success', count(*) FILTER (ok) FROM outcomes
      UNION ALL SELECT 'label_failure', count(*) FILTER (NOT ok) FROM outcomes)""",
)
def stream_funnel(spark, sf_dir):
    done = run_stream(spark, sf_dir, min_per_label=10**9)
    return spark.createDataFrame(list(done.funnel.items()), "name STRING, value BIGINT")


STOP_TARGETS, STOP_MIN = ("愛", "欲", "悪"), 2


@query(
    "stream_until_complete",
    W(
        "jposts", "chats", **STREAM_SQL,
        filled=f"""SELECT slice, min(n) >= {STOP_MIN} AS complete FROM (
            SELECT s.slice, t.label, count(o.event_id) AS n FROM (SELECT unnest(range(0, {SLICES})) AS slice) s
            JOIN (SELECT unnest([{', '.join(f"'{c}'" for c in STOP_TARGETS)}]) AS label) t ON true
            LEFT JOIN outcomes o ON o.label = t.label AND o.slice <= s.slice GROUP BY ALL) GROUP BY slice""",
    )
    + """SELECT event_id, ok, label FROM outcomes
      WHERE slice <= coalesce((SELECT min(slice) FROM filled WHERE complete), 99)""",
)
def stream_until_complete(spark, sf_dir):
    done = run_stream(spark, sf_dir, min_per_label=STOP_MIN, targets=STOP_TARGETS)
    return done.outcomes(spark).select("event_id", "ok", "label")


@query(
    "stream_seeded",
    W(
        "jposts", "chats", **STREAM_SQL,
    )
    + "SELECT event_id, ok, label FROM outcomes WHERE event_id LIKE 'c%'",
)
def stream_seeded(spark, sf_dir):
    """Stream labeling that skips every event already attempted (all posts), in fresh mode."""
    log = V.jposts(spark, sf_dir).select(
        "event_id", F.lit("愛").alias("label"), F.lit(True).alias("ok"), F.col("seq").alias("ord")
    )
    seed = resume.seed_state(log, None, count_existing=False)
    done = run_stream(spark, sf_dir, min_per_label=10**9, seed=seed)
    return done.outcomes(spark).select("event_id", "ok", "label")


@query("stream_relabel_counts", W("attempts") + """SELECT label, count(*) AS count FROM (SELECT * FROM attempts WHERE ok
      QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ord DESC) = 1) GROUP BY label""")
def stream_relabel_counts(spark, sf_dir):
    """The log of outcomes as a stream in three batches, relabels spread over them and out of order, with a restart in between."""
    root = scratch_path(spark, "relabel")
    log = V.attempts(spark, sf_dir).select("event_id", "ord", "ok", "label").withColumn("part", F.pmod(F.xxhash64("event_id", "ord"), F.lit(3)))
    tasks = max(2, spark.sparkContext.defaultParallelism)
    counts = state.RelabelCounts(f"{root}/counts", f"{root}/checkpoint")
    for parts in ("part < 2", "part = 2"):
        log.filter(parts).drop("part").repartition(tasks).write.mode("append").parquet(f"{root}/in")
        counts.run(spark.readStream.schema("event_id STRING, ord BIGINT, ok BOOLEAN, label STRING").parquet(f"{root}/in"))
    return counts.counts(log)


@query("stream_fold", W("observations") + """SELECT e.event_id, e.pubkey, e.created_at, e.content, e.seq, r.relays, r.n_obs FROM
      (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY seq) AS place FROM (SELECT * FROM observations
        WHERE event_id NOT LIKE 'b%' AND event_id NOT LIKE 'm%' QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq) = 1)) e
      JOIN (SELECT event_id, string_agg(relay, ',' ORDER BY seq) AS relays, CAST(sum(n) AS BIGINT) AS n_obs FROM
        (SELECT event_id, relay, min(seq) AS seq, count(*) AS n FROM observations GROUP BY ALL) GROUP BY event_id) r USING (event_id)
      WHERE place <= 25""")
def stream_fold(spark, sf_dir):
    """Observations as they arrive, in three batches with a restart after each, folded under the cap of their authors."""
    root = scratch_path(spark, "fold")
    rows = V.observations(spark, sf_dir).select("event_id", "pubkey", "created_at", "content", "relay", "seq")
    rows = materialize(rows.withColumn("part", F.floor(F.col("seq") / 10**9)), "arrivals")
    for part in range(3):
        rows.filter(F.col("part") == part).drop("part").repartition(3).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(rows.drop("part").schema).parquet(f"{root}/in")
        stream.write_available(state.fold_stream(source), f"{root}/out", f"{root}/checkpoint")
    folded = state.read_fold(spark.read.parquet(f"{root}/out"))
    return folded.withColumn("relays", F.array_join("relay", ",")).drop("relay")


@query("replay_then_live", W("chats") + "SELECT event_id, content, CAST(seq % 3 AS INTEGER) AS source_rank FROM chats")
def replay_then_live(spark, sf_dir):
    """Turns in two stored folders and a live one, replayed and followed with a restart before every batch."""
    root = scratch_path(spark, "replay")
    rows = materialize(V.chats(spark, sf_dir).select("event_id", "pubkey", "created_at", "content", F.array(F.lit("r")).alias("relay"), "seq"), "turns")
    for part in range(3):
        rows.filter(F.col("seq") % 3 == part).drop("seq").repartition(3).write.json(f"{root}/part{part}")
    for _ in range(4):
        arriving = replay.replay_then_live(spark, [f"{root}/part0", f"{root}/part1"], f"{root}/part2")
        stream.write_available(arriving, f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").select("event_id", "content", "source_rank")
