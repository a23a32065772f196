"""Order, quotas, caps, durable outcomes and scratch folders on literal rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from postloom.functions import prompts as P
from postloom.operators import activity, evaluation, export, progress, synthesis
from postloom.operators.dedup import near_dup_clusters
from postloom.operators.keyed import cap_per_key, kth_value
from postloom.operators.labeling import Reply, label_with
from postloom.operators.labels import LABEL_CHARS, QA_LABEL, label_dim
from postloom.operators.observations import fold_observations, in_time_range, resume_merge
from postloom.plans.training import export_training_set
from postloom.plans.two_pass import label_two_pass, read_outcomes
from postloom.sources import jsonl, snapshots
from postloom.streaming.labeling import LabelStream

FILTERED = "label string, label_rank struct<need: int, id: int>, need int, round int, pos int, content_hash string, reason string, verified boolean"


def walk_labels(rows, max_rounds):
    """One label after the other, a text registered when it is examined."""
    registered, out = set(), {}
    for label in sorted({r[0] for r in rows}, key=lambda name: next(r[1] for r in rows if r[0] == name)):
        own = [r for r in rows if r[0] == label]
        left, rounds = own[0][2], sorted({r[3] for r in own if r[3] <= max_rounds})
        for number in rounds:
            batch = sorted((r for r in own if r[3] == number), key=lambda r: r[4])
            accepted, texts = [], set()
            for r in batch:
                if left <= 0:
                    out[label, number, r[4]] = "unused"
                elif r[6] is not None or r[5] in registered or r[5] in texts:
                    out[label, number, r[4]] = "filter_rejected"
                else:
                    texts.add(r[5])
                    accepted.append(r)
            for r in accepted:
                if left <= 0:
                    out[label, number, r[4]] = "unused"
                    continue
                registered.add(r[5])
                out[label, number, r[4]] = "taken" if r[7] else "verify_rejected"
                left -= bool(r[7])
    return out


def test_a_text_left_over_stays_free_for_the_next_label(spark):
    rows = [("a", (1, 0), 2, 1, k, f"h{k}", None, True) for k in range(3)] + [("b", (2, 0), 1, 1, 0, "h2", None, True)]
    done = synthesis.fill_in_order(spark.createDataFrame(rows, FILTERED), 12)
    assert {(r.label, r.pos): r.outcome for r in done.collect()} == {("a", 0): "taken", ("a", 1): "taken", ("a", 2): "unused", ("b", 0): "taken"}


@pytest.mark.parametrize("seed", range(4))
def test_quotas_over_labels_match_a_sequential_walk(spark, seed):
    rng, rows = random.Random(seed), []
    for k in range(6):
        need, seen = rng.randint(0, 6), set()
        for number in range(1, 4):
            for pos in range(rng.randint(0, 6)):
                text = f"h{rng.randrange(14)}"
                # Copies within a label are marked by the candidate filter.
                reason = "duplicate" if text in seen else "too_short" if rng.random() < 0.1 else None
                if reason is None:
                    seen.add(text)
                rows.append((f"l{k}", (k, 0), need, number, pos, text, reason, rng.random() < 0.6))
    got = {(r.label, r["round"], r.pos): r.outcome for r in synthesis.fill_in_order(spark.createDataFrame(rows, FILTERED), 3).collect()}
    assert got == walk_labels(rows, 3)


def answer(prompt, attempt):
    return Reply(text='{"label":"愛","label_id":0,"confidence":0.9,"rationale":"r","is_uncertain":false}')


def test_a_second_checkpoint_keeps_earlier_outcomes(spark, tmp_path):
    schema, seen = "event_id string, content string", []
    for name, ids in (("one", "12"), ("two", "345")):
        spark.createDataFrame([(i, "たぬきがはしる") for i in ids], schema).write.parquet(f"{tmp_path}/{name}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
        job = LabelStream(answer, "m", f"{tmp_path}/out", f"{tmp_path}/cp-{name}", min_per_label=10**6, on_batch=lambda rows, batch: seen.append((batch, rows.count())))
        done = job.run(stream)
        assert done.funnel["queued"] == len(ids)
    assert {r.event_id for r in done.outcomes(spark).collect()} == set("12345") and done.counts["愛"] == 5
    assert seen == [(0, 2), (0, 3)]


def test_an_error_named_like_the_planned_end_is_raised(spark, tmp_path):
    spark.createDataFrame([("1", "たぬきがはしる")], "event_id string, content string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id string, content string").parquet(f"{tmp_path}/in")

    def fail(rows, batch):
        raise ValueError("TargetReached")

    with pytest.raises(Exception, match="TargetReached"):
        LabelStream(answer, "m", f"{tmp_path}/out", f"{tmp_path}/cp", on_batch=fail).run(stream)


@pytest.mark.parametrize("cap", [10, 1001, 100_000])
def test_caps_are_cut_before_the_shuffle(spark, cap):
    df = spark.range(300_003).select((F.col("id") % 3).alias("k"), F.col("id").alias("seq"))
    capped = cap_per_key(df, ["k"], [F.col("seq")], cap)
    assert "WindowGroupLimit" in capped._jdf.queryExecution().executedPlan().toString()
    assert capped.count() == 3 * cap


def test_no_text_is_sorted_in_folds_and_clusters(spark):
    rows = [("a", "p", 1, "たぬき", ["r"], 0), ("b", "p", 2, "たぬき", ["s"], 1)]
    posts = spark.createDataFrame(rows, "event_id string, pubkey string, created_at long, content string, relay array<string>, seq long")
    seen = posts.withColumn("relay", F.col("relay")[0])
    for df in (near_dup_clusters(posts), fold_observations(seen)):
        df.collect()
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_kth_value(spark):
    values = random.Random(2).sample(range(10**9), 500)
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [kth_value(df, "v", k, buckets=16) for k in (1, 77, 500, 501)] == [*(sorted(values)[k - 1] for k in (1, 77, 500)), None]


def log_line(event, label):
    return (event, f"ことば{label}", label, 1, True)


def test_the_last_append_wins_whatever_the_files(spark, tmp_path):
    schema = "event_id string, content string, label string, created_at long, ok boolean"
    big = [log_line(f"x{i}", "犬") for i in range(3000)]
    jsonl.append_log(spark.createDataFrame([log_line("e1", "愛"), log_line("e1", "欲")], schema).coalesce(1), f"{tmp_path}/in/real-log")
    jsonl.append_log(spark.createDataFrame([*big, log_line("e1", "猫")], schema).repartition(1), f"{tmp_path}/in/real-log")
    built = export_training_set(spark, f"{tmp_path}/in", f"{tmp_path}/out", label_dim(spark))
    assert built.rows.filter("event_id = 'e1'").first().label == "猫"
    manifest = spark.read.json(f"{tmp_path}/out/manifest").first()
    assert not manifest.real_snapshot_present and manifest.real_log_present


def test_lines_of_other_writers_keep_their_order(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"event_id":"e","v":1}\n' * 3 + '{"event_id":"e","v":2}\n', encoding="utf-8")
    (folder / "b.jsonl").write_text('{"event_id":"e","v":3}\n', encoding="utf-8")
    rows = jsonl.scan_log_records(spark, str(folder)).orderBy("record_order").collect()
    assert [r.record.toPython()["v"] for r in rows] == [1, 1, 1, 2, 3]


def test_documents_follow_their_number(spark, tmp_path):
    doc = tmp_path / "docs.json"
    doc.write_text('{"document_order":2,"items":[{"v":3}]}\n{"document_order":1,"items":[{"v":1},{"v":2}]}\n', encoding="utf-8")
    rows = snapshots.scan_snapshot_records(spark, str(doc), document_per_line=True).orderBy("record_order").collect()
    assert [(r.record.toPython()["v"], r.source_record_index) for r in rows] == [(1, 0), (2, 1), (3, 0)]
    assert snapshots.document_present(spark, str(doc), True) and not snapshots.document_present(spark, f"{tmp_path}/none")


def test_label_maps_round_trip_and_keep_the_last_of_a_char(spark, tmp_path):
    snapshots.write_label_map(label_dim(spark), f"{tmp_path}/map")
    assert sorted(map(tuple, snapshots.read_label_map(spark, f"{tmp_path}/map").collect())) == sorted(map(tuple, label_dim(spark).collect()))
    double = tmp_path / "double.json"
    double.write_text('{"labels":[{"id":0,"char":"愛","def":"x"},{"id":5,"char":"愛","def":"y"}]}', encoding="utf-8")
    assert [(r.label_id, r.definition) for r in snapshots.read_label_map(spark, str(double)).collect()] == [(5, "y")]


def test_merge_keeps_stored_relays_and_skips_inadmissible_ones(spark):
    stored = spark.createDataFrame([("e", "p", 5, "ことば", ["z", "b"])], "event_id string, pubkey string, created_at long, content string, relay array<string>")
    rows = [("e", "p", 5, "  ", "a0", 0), ("e", "p", 99, "ことば", "late", 1), ("e", "p", 5, "ことば", "m", 3), ("e", "p", 5, "ことば", "c", 4), ("e", "p", 5, "ことば", "b", 2)]
    seen = spark.createDataFrame(rows, "event_id string, pubkey string, created_at long, content string, relay string, seq long")
    assert resume_merge(stored, seen, stored.limit(0), 0, 50).first().relay == ["z", "b", "m", "c"]
    assert in_time_range(seen.withColumn("created_at", F.col("created_at").cast("string")), 0, 50).count() == 0


def test_a_labeler_that_raises_fails_its_row_only(spark):
    def labeler(prompt, attempt):
        if prompt == "boom":
            raise RuntimeError("no line")
        return Reply(text=answer(prompt, attempt).text.replace(":0,", f":{10**400 if prompt == 'huge' else 0},"))

    df = spark.createDataFrame([(p,) for p in ("boom", "huge", "fine")], "event_id string")
    rows = {r.event_id: r for r in label_with(df, labeler, "m", prompt=F.col("event_id"), max_retries=1).collect()}
    assert rows["boom"].reason == "labeler_error: RuntimeError: no line" and rows["fine"].ok
    assert not rows["huge"].ok and rows["huge"].reason.startswith("validation_failed")


def test_two_passes_keep_their_answers_in_a_log(spark, tmp_path):
    asked = []
    posts = spark.createDataFrame([(str(i), "p", i, f"たぬき{i}") for i in range(4)], "event_id string, pubkey string, created_at long, content string")

    def unsure(prompt, attempt):
        return Reply(text=answer(prompt, attempt).text.replace("0.9", "0.1"))

    path = f"{tmp_path}/log"
    label_two_pass(posts.limit(3), unsure, "m", refiner=answer, log_path=path)
    logged = read_outcomes(spark, path)
    assert logged.count() == 6 and logged.filter("pass = 2").count() == 3
    again = label_two_pass(posts, answer, "m", log_path=path)
    assert {r.event_id: r["pass"] for r in again.items.collect()} == {"0": 2, "1": 2, "2": 2, "3": 1} and not asked


def test_approved_posts_are_cut_in_arrival_order(spark):
    df = spark.createDataFrame([("a", 3, "approved"), ("b", 1, "approved"), ("c", 0, "review"), ("d", 2, "approved")], "event_id string, first_seq long, review_status string")
    assert [r.event_id for r in progress.select_approved(df, 2).collect()] == ["b", "d"]


def test_order_of_reports(spark):
    rows = spark.createDataFrame([("b", None), ("a", 5), ("c", 2), ("d", 5)], "event_id string, created_at long")
    assert [r.event_id for r in export.export_order(rows).collect()] == ["c", "a", "d", "b"]
    counts = spark.createDataFrame([(0, "x", 9), (1, "y", 2), (2, "z", 2), (3, "w", 60)], "label_id int, label string, count long")
    assert [r.label_id for r in progress.labels_below(counts, 50).collect()] == [1, 2, 0]
    assert [r.label_id for r in progress.label_deficits(counts, 50).collect()] == [1, 2, 0]


def test_scratch_needs_a_shared_folder_off_local_mode(spark):
    from postloom.session import scratch_path

    class Conf:
        def get(self, key, default=None):
            return default

    class Away:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Away(), "x")


def test_groups_never_cross_splits_and_shares_are_near(spark):
    rows = spark.range(40_000).select(F.concat(F.lit("u"), F.col("id") % 4000).alias("pubkey"))
    split = evaluation.group_split(rows)
    assert split.select("pubkey", "split").distinct().count() == 4000
    shares = {r.split: r["count"] / 40_000 for r in split.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.8) < 0.03 and abs(shares["val"] - 0.1) < 0.03 and abs(shares["test"] - 0.1) < 0.03


def test_evaluation_by_hand(spark):
    rows = [(0, 0, 0.95), (0, 1, 0.55), (1, 1, 1.0), (1, 1, 0.65), (2, 0, 0.05)]
    df = spark.createDataFrame(rows, "gold int, predicted int, confidence double").withColumn("correct", F.expr("gold = predicted"))
    report = {r.label: (r.support, r.precision, r.recall, round(r.f1, 6)) for r in evaluation.class_report(df).collect()}
    assert report == {0: (2, 0.5, 0.5, 0.5), 1: (2, 2 / 3, 1.0, 0.8), 2: (1, 0.0, 0.0, 0.0)}
    assert evaluation.macro_f1(df).first().macro_f1 == pytest.approx(1.3 / 3)
    assert evaluation.calibration_error(df).first().ece == pytest.approx((0.55 + 0.05 + 0.35 + abs(0.975 - 1) * 2) / 5)
    assert evaluation.macro_f1(df.limit(0)).first().labels == 0 and evaluation.calibration_error(df.limit(0)).first().ece == 0


def test_oversampling_is_bounded_and_train_only(spark):
    rows = [(0, "train")] * 12 + [(1, "train")] * 5 + [(2, "train")] + [(2, "val")] * 2 + [(None, "train")]
    out = evaluation.oversample(spark.createDataFrame(rows, "label_id int, split string"), max_factor=4)
    assert {(r.label_id, r.split): r["count"] for r in out.groupBy("label_id", "split").count().collect()} == {
        (0, "train"): 12, (1, "train"): 10, (2, "train"): 4, (2, "val"): 2, (None, "train"): 4,
    }


def test_qa_rows_are_dropped_or_moved(spark):
    df = spark.createDataFrame([(QA_LABEL, None), (QA_LABEL, "猫"), ("愛", "犬"), (None, None)], "label string, better string")
    assert evaluation.drop_qa(df).count() == 2
    assert sorted(r.label or "" for r in evaluation.drop_qa(df, reassign=F.col("better")).collect()) == ["", "愛", "猫"]
    assert evaluation.qa_rate(df).first().too_high


def test_a_prompt_as_a_whole(spark):
    import hashlib

    prompt = spark.range(1).select(P.labeling_prompt(F.lit("たぬき")).alias("p")).first().p
    assert all(f"- {i}: {c} = " in prompt for i, c in enumerate(LABEL_CHARS))
    assert hashlib.sha256(prompt.encode()).hexdigest() == PROMPT_SHA256


PROMPT_SHA256 = "5f037b1f1ba9290ed80c85e3a68346bb82659989a9264dcf9a1ab6ffc88a2e50"
