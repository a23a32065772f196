"""Answers that were paid for: kept one by one, asked for once, and asked for only while a label is open."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from postloom.functions.prompts import POST_TITLE
from postloom.operators.labeling import OutcomeLog, Reply, label_with
from postloom.operators.labels import LABEL_CHARS, label_dim
from postloom.plans.generation import GenerationRun
from postloom.plans.two_pass import label_two_pass, read_outcomes

POSTS = "event_id string, pubkey string, created_at bigint, content string"


def answer(idx):
    return Reply(text=json.dumps({"label": LABEL_CHARS[idx], "label_id": idx, "confidence": 0.9, "rationale": "r", "is_uncertain": False}, ensure_ascii=False))


def recorded(folder, dies_at=None):
    """A labeler that notes each call in a file; the whole worker dies at one text the first time it sees it."""

    def ask(prompt, attempt):
        text = prompt.split(POST_TITLE + "\n", 1)[1]
        if text == dies_at and not os.path.exists(f"{folder}/died"):
            open(f"{folder}/died", "w").close()
            os._exit(7)
        with open(f"{folder}/calls", "a") as file:
            file.write(text + "\n")
        return answer(int(text[1:]) % 3)

    return ask


@pytest.fixture
def posts(spark, tmp_path):
    rows = [(f"e{k}", "p", k, f"t{k}") for k in range(24)]
    spark.createDataFrame(rows, POSTS).repartition(2).write.parquet(f"{tmp_path}/posts")
    return spark.read.parquet(f"{tmp_path}/posts")


def test_a_labeler_that_dies_midway_is_called_once_per_event(spark, posts, tmp_path):
    ask, log = recorded(tmp_path, "t17"), f"{tmp_path}/log"
    with pytest.raises(Exception):
        label_two_pass(posts, ask, "m", refine=False, log_path=log)
    kept = read_outcomes(spark, log).count()
    assert 0 < kept < 24
    done = label_two_pass(posts, ask, "m", refine=False, log_path=log)
    assert done.items.count() == 24
    calls = open(f"{tmp_path}/calls").read().split()
    assert sorted(calls) == sorted(f"t{k}" for k in range(24))


def test_replay_under_the_same_token_asks_nothing(spark, posts, tmp_path):
    ask = recorded(tmp_path)
    for _ in range(2):
        log = OutcomeLog(f"file:{tmp_path}/log", flush_rows=5, token="pass-1", replay=True)
        rows = label_with(posts, ask, "m", log=log).collect()
        assert len(rows) == 24 and all(r.ok and r.label == LABEL_CHARS[r.created_at % 3] for r in rows)
    assert len(open(f"{tmp_path}/calls").read().split()) == 24
    # A line that was cut off while it was written is no answer.
    with open(f"{tmp_path}/log/outcomes-pass-1-x.json", "w") as file:
        file.write('{"event_id": "e1", "ok": fal')
    assert len(label_with(posts, ask, "m", log=log).collect()) == 24
    assert read_outcomes(spark, f"{tmp_path}/log").count() == 24


# --- generation --------------------------------------------------------------------------------
def kana(n):
    return "".join("あいうえおかきくけこ"[int(c)] for c in f"{n:04d}") + "ですよね"


def made(label, round_number):
    """Four posts per call; labels share many texts, some are too short, some calls fail or cannot be read."""
    rng = random.Random(f"{label}{round_number}")
    if rng.random() < 0.15:
        return Reply(error="http_500") if rng.random() < 0.5 else Reply(text='{"other": 1}')
    return Reply(text=json.dumps({"posts": [kana(rng.randrange(14)) if rng.random() < 0.85 else "あ" for _ in range(4)]}, ensure_ascii=False))


def verdict(text):
    return random.Random("v" + text).randrange(3)


def one_after_the_other(needs, known, max_rounds):
    """The sequential rule in plain Python: (taken texts, calls, filter rejects, verify rejects) per label."""
    seen, out = set(known), {}
    for label, need in needs:
        taken, calls, filtered, refused = [], 0, 0, 0
        while len(taken) < need and calls < max_rounds:
            calls += 1
            reply = made(label, calls)
            posts = json.loads(reply.text).get("posts", []) if not reply.error else []
            accepted = []
            for text in posts:
                if len(text) < 5 or text in seen or text in accepted:
                    filtered += 1
                else:
                    accepted.append(text)
            for text in accepted:
                if len(taken) >= need:
                    break
                seen.add(text)
                if LABEL_CHARS[verdict(text)] == label:
                    taken.append(text)
                else:
                    refused += 1
        out[label] = (taken, calls, filtered, refused)
    return out


def test_generation_equals_the_sequential_rule_and_resumes(spark, tmp_path):
    wanted = [(LABEL_CHARS[1], 5), (LABEL_CHARS[2], 3), (LABEL_CHARS[0], 2)]
    known = [kana(3), kana(8)]
    plain = one_after_the_other(wanted, known, 4)
    deficits = spark.createDataFrame([(c, LABEL_CHARS.index(c), n, 0) for c, n in wanted], "label string, label_id int, need bigint, have bigint")
    labeled = spark.createDataFrame([("e", 1, "ねこ", LABEL_CHARS[0])], "event_id string, seq bigint, content string, label string")
    corpus = spark.createDataFrame([(t,) for t in known], "content string")

    def generate(prompt, label, round_number):
        with open(f"{tmp_path}/asked", "a") as file:
            file.write(f"{label}:{round_number}\n")
        return made(label, round_number)

    def verify(prompt, attempt):
        return answer(verdict(prompt.split(POST_TITLE + "\n", 1)[1]))

    def run(rounds):
        job = GenerationRun(generate, "m", f"{tmp_path}/run", verify, batch=4, max_rounds=rounds)
        return job, job.run(deficits, labeled, corpus, label_dim(spark))

    run(2)  # as if the run had broken off behind two rounds
    job, filled = run(4)
    asked = open(f"{tmp_path}/asked").read().split()
    assert len(asked) == len(set(asked)) == sum(p[1] for p in plain.values())
    rows = filled.orderBy("round", "pos").collect()
    for label, (taken, calls, filtered, refused) in plain.items():
        own = [r for r in rows if r.label == label]
        assert [r.content for r in own if r.outcome == "taken"] == taken
        assert [sum(r.outcome == o for r in own) for o in ("filter_rejected", "verify_rejected")] == [filtered, refused]
    assert {r.label: r.calls for r in job.calls(spark).collect()} == {label: p[1] for label, p in plain.items() if p[1]}
    records = job.records(filled, 7).collect()
    assert {(r.content, r.label) for r in records} == {(t, label) for label, p in plain.items() for t in p[0]}
    assert all(r.verified and r.confidence == 0.9 and r.rationale == "r" for r in records)


def test_no_label_in_need_asks_nothing(spark, tmp_path):
    deficits = spark.createDataFrame([(LABEL_CHARS[0], 0, 0), (LABEL_CHARS[1], 1, -3)], "label string, label_id int, need bigint")
    posts = spark.createDataFrame([], "event_id string, label string, content string, seq bigint")
    job = GenerationRun(lambda *asked: answer(0), "m", f"{tmp_path}/run")
    filled = job.run(deficits, posts, posts, label_dim(spark))
    assert (filled.count(), job.calls(spark).count(), job.records(filled, 7).count()) == (0, 0, 0)
