"""Label bookkeeping, answers, candidates, synthetic records and the training merge."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from postloom.functions import answers as A
from postloom.functions import text as T
from postloom.operators import export, progress, resume, synthesis
from postloom.operators.labeling import Reply, answer_errors, label_with
from postloom.operators.labels import LABEL_CHARS, QA_LABEL, label_dim
from postloom.plans.training import build_training_set

GOOD = '{"label":"愛","label_id":0,"confidence":0.9,"rationale":"r","is_uncertain":false}'


def errors(spark, *texts, allow_qa=True):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    parsed = df.withColumn("answer", A.parse_json_text(F.col("text")))
    return [r.errors for r in A.with_answer_errors(parsed, allow_qa=allow_qa).orderBy("i").collect()]


def test_answer_validation(spark):
    texts = (
        GOOD,
        GOOD.replace("愛", "zzz"),
        GOOD.replace(":0,", ":5,"),
        GOOD.replace("0.9", "1.5"),
        GOOD.replace(":0,", ":0.5,"),
        GOOD.replace(":0,", ":0.0,"),
        GOOD.replace("愛", " Ｈ ").replace(":0,", ":4,"),
        "null",
        "[1]",
        '{"label":5,"label_id":null,"confidence":true,"rationale":1,"is_uncertain":0}',
    )
    got = errors(spark, *texts)
    assert got[:4] == [[], ["label_not_allowed"], ["label_id_mismatch"], ["range:confidence"]]
    assert got[4] == ["type:label_id", "label_id_mismatch"] and got[5] == [] and got[6] == []
    assert got[7] == ["not_an_object"] and got[8][0] == "missing:label"
    qa = GOOD.replace("愛", QA_LABEL).replace(":0,", ":46,")
    assert errors(spark, qa, allow_qa=False) == [["label_not_allowed"]]
    assert errors(spark, qa) == [[]]
    # The retry loop's helper agrees with the columns.
    import json

    assert [answer_errors(json.loads(t)) for t in texts] == got


def test_generated_posts(spark):
    texts = ['{"posts":[" a ",1,"",null,"b"]}', '"garbage"', '{"posts":[]}', '{"posts":["","  "]}', "broken"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = A.with_generated_posts(df.withColumn("answer", A.parse_json_text(F.col("text")))).orderBy("i").collect()
    assert rows[0].posts == ["a", "b"] and rows[0].error is None
    assert [r.error for r in rows[1:]] == ["invalid_posts", "empty_posts", "empty_posts", "invalid_posts"]


def log(spark, rows):
    return spark.createDataFrame(
        [(*r, i) for i, r in enumerate(rows)], "event_id string, label string, ok boolean, ord long"
    )


def test_counts_and_completion(spark):
    a, b = LABEL_CHARS[0], LABEL_CHARS[1]
    rows = log(spark, [("1", a, True), ("2", a, True), ("3", b, True), ("4", QA_LABEL, True), ("5", None, False)])
    done, dim = resume.last_ok(rows), label_dim(spark)
    assert done.count() == 4
    counts = progress.label_counts_full(done, dim)
    below = progress.labels_below(counts, 2).collect()
    assert len(below) == 45 and below[0]["count"] == 0 and below[-1].label == b
    assert progress.completion(counts, 0).first().complete
    deficits = progress.label_deficits(counts, 50).collect()
    assert deficits[0].need == 50 and deficits[0].label_id == 2 and deficits[-1].label == a
    with pytest.raises(ValueError):
        progress.label_deficits(counts, 50, ["存在しない"])
    relabeled = log(spark, [("1", a, True), ("1", b, True), ("1", None, False)])
    assert [(r.label, r["count"]) for r in progress.label_counts_full(resume.last_ok(relabeled), dim).filter("count > 0").collect()] == [(b, 1)]


def test_seed_modes(spark):
    stored = spark.createDataFrame([("g1", LABEL_CHARS[0]), ("g2", LABEL_CHARS[0])], "event_id string, label string")
    empty = log(spark, [("x", None, False)])
    for flag, expected in ((False, 0), (True, 2)):
        seeds = resume.seed_state(empty, stored, flag)
        assert seeds.count() == 3 and seeds.filter("counted").count() == expected


def test_candidates(spark):
    tired, cat = "となりの町まで自転車でいってきた", "みかんの皮がやけにかたい"
    texts = [tired, f" {tired} ", cat, "短い", "あ" * 201, "an umbrella stands in the corner"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq int, content string")
    got = [r.reason for r in synthesis.candidate_filter(df).orderBy("seq").collect()]
    assert got == [None, "duplicate", None, "too_short", "too_long", "not_japanese"]
    seen = df.filter("seq = 2").select(T.content_hash(F.col("content")).alias("content_hash"))
    assert [r.reason for r in synthesis.candidate_filter(df, seen).orderBy("seq").collect()][2] == "duplicate"


def fill(rows, max_rounds):
    """Brute force quota walk over (label, need, round, pos, passed, verified)."""
    out, left, halted = {}, {}, {}
    for label, need, rnd, pos, passed, good in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        if rnd > max_rounds:
            continue
        left.setdefault(label, need)
        if halted.setdefault((label, rnd), left[label] <= 0):
            out[label, rnd, pos] = "unused"
        elif not passed:
            out[label, rnd, pos] = "filter_rejected"
        elif left[label] <= 0:
            out[label, rnd, pos] = "unused"
        else:
            out[label, rnd, pos] = "taken" if good else "verify_rejected"
            left[label] -= good
    return out


def test_quota_fill_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [
        (f"l{k}", need, rnd, pos, rng.random() < 0.8, rng.random() < 0.6)
        for k, need in enumerate((0, 1, 4, 9, 30))
        for rnd in range(1, 6)
        for pos in range(rng.randint(0, 6))
    ]
    df = spark.createDataFrame(
        [(a, b, c, d, None if e else "too_short", f) for a, b, c, d, e, f in rows],
        "label string, need int, round int, pos int, reason string, verified boolean",
    )
    got = {(r.label, r["round"], r.pos): r.outcome for r in synthesis.quota_fill(df, 4).collect()}
    assert got == fill(rows, 4)


def test_synthetic_record_defaults(spark):
    df = spark.createDataFrame([("はしごの上から屋根をながめる", "猫")], "content string, label string")
    row = synthesis.synthetic_records(df, "m", 1).first()
    assert row.event_id.startswith("syn-") and row.pubkey == "synthetic" and row.label_id == 44
    assert (row.confidence, row.rationale, row.source) == (0.9, "逆生成（synthetic）", "synthetic:m")
    assert row.synthetic and not row.verified and row["pass"] == 1


def records(spark, rows):
    df = spark.createDataFrame(rows, "text string, source_file string, file_rank int, source_record_index long, fallback_model string")
    return df.withColumn("record", A.parse_json_text(F.col("text"))).drop("text")


def test_training_merge(spark):
    real = records(
        spark,
        [
            ('{"event_id":"dup-1","content":"ひとつめの文","label":"愛","source":"old","created_at":10}', "real.json", 0, 0, "old"),
            ('{"content":"番号のない文","label":"猫","source":"old","created_at":11}', "real.json", 0, 1, "old"),
            ('{"event_id":"dup-1","content":"あとから来た文","label":"欲","source":"new","created_at":12}', "log", 1, 0, "new"),
        ],
    )
    synthetic = records(
        spark,
        [
            ('{"event_id":"syn-1","content":"つくられた文","label":"犬","source":"synthetic:s","created_at":13}', "log", 1, 0, "s"),
            ('{"event_id":"bad","content":"のこらない文","label":"存在しない","created_at":14}', "log", 1, 1, "s"),
        ],
    )
    built = build_training_set(real, synthetic, label_dim(spark))
    rows = {r.event_id: r for r in export.export_order(built.rows).collect()}
    assert len(rows) == 3
    assert (rows["dup-1"].content, rows["dup-1"].label_id, rows["dup-1"].source_model) == ("あとから来た文", 1, "new")
    assert any(k.startswith("real-missing-") for k in rows)
    assert rows["syn-1"].synthetic and rows["syn-1"].source_model == "s"
    s = built.summary().first()
    assert (s.total_count, s.real_count, s.synthetic_count) == (3, 2, 1)
    assert (s.duplicate_event_ids_overwritten, s.missing_event_ids_assigned, s.skipped_invalid_label) == (1, 1, 1)


def test_labeler_retries(spark):
    def labeler(prompt, attempt):
        if prompt == "down":
            return Reply(error="http_400", attempts=((0, 400, ""),))
        if prompt == "garbled":
            return Reply(text="{")
        return Reply(text=GOOD if attempt == 2 and prompt == "slow" else GOOD.replace("愛", "zzz"))

    df = spark.createDataFrame([(p,) for p in ("slow", "never", "down", "garbled")], "event_id string")
    rows = {r.event_id: r for r in label_with(df, labeler, "m", prompt=F.col("event_id"), max_retries=2).collect()}
    assert rows["slow"].ok and rows["slow"].label == "愛" and rows["slow"].label_id == 0
    assert rows["never"].reason == "validation_failed: label_not_allowed"
    assert rows["down"].reason == "http_400" and rows["down"].attempts[0].status_code == 400
    assert rows["garbled"].reason == "invalid_model_json" and rows["garbled"].label is None


def test_seed_rows_are_dealt_by_their_number(spark, monkeypatch):
    """What one task sorts must not grow with the log."""
    monkeypatch.setattr(resume, "ROWS_A_TASK", 10)
    log = spark.range(1000).selectExpr("cast(id % 300 as string) AS event_id", "id % 3 <> 0 AS ok", "'愛' AS label", "id AS ord")
    stored = spark.range(200, 400).selectExpr("cast(id as string) AS event_id", "'欲' AS label")
    seeds = resume.seed_state(log, stored, True)
    plan = seeds._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(event_id" in plan and ", 100), REPARTITION_BY_NUM" in plan
    found = {r.event_id: (r.label, r.counted) for r in seeds.collect()}
    assert len(found) == seeds.count() == 400
    assert found["1"] == ("愛", True) and found["3"] == (None, False) and found["201"] == ("欲", True)
