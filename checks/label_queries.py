"""Label dimension, counts, checkpoints, resume rules and author activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks import views as V
from checks.registry import query
from postloom.functions import calendar as C
from postloom.functions import text as T
from postloom.operators import activity, labels, progress, resume, sampling
from postloom.plans import backfill
from postloom.streaming import labeling as stream

W = V.with_views
MIN = 50

COUNTS = dict(
    counts="""SELECT d.label_id, d.label, count(l.event_id) AS count FROM dim d
      LEFT JOIN labeled l ON l.label = d.label WHERE NOT is_qa GROUP BY d.label_id, d.label"""
)


def counts(spark, sf_dir):
    return progress.label_counts_full(V.labeled(spark, sf_dir), V.dim(spark))


@query("label_counts_full", W("labeled", "dim", **COUNTS) + "SELECT * FROM counts")
def label_counts_full(spark, sf_dir):
    return counts(spark, sf_dir)


@query(
    "qa_counts",
    W("labeled", "dim") + """SELECT label, count(*) AS count FROM labeled
      WHERE label NOT IN (SELECT label FROM dim WHERE NOT is_qa) GROUP BY label""",
)
def qa_counts(spark, sf_dir):
    return progress.other_counts(V.labeled(spark, sf_dir), V.dim(spark))


@query("labels_below", W("labeled", "dim", **COUNTS) + f"SELECT * FROM counts WHERE count < {MIN * 3}")
def labels_below(spark, sf_dir):
    return progress.labels_below(counts(spark, sf_dir), MIN * 3)


@query(
    "lowest_labels",
    W("labeled", "dim", **COUNTS) + f"SELECT * FROM counts WHERE count < {MIN * 3} ORDER BY count, label_id LIMIT 10",
)
def lowest_labels(spark, sf_dir):
    return progress.lowest_labels(counts(spark, sf_dir), MIN * 3)


@query(
    "completion_flag",
    W("labeled", "dim", **COUNTS) + f"""SELECT count(*) FILTER (count < {MIN}) AS labels_below_count,
      count(*) FILTER (count < {MIN}) = 0 AS complete FROM counts""",
)
def completion_flag(spark, sf_dir):
    return progress.completion(counts(spark, sf_dir), MIN)


@query(
    "progress_report",
    W("labeled", "dim", **COUNTS) + f"""SELECT * FROM (SELECT count(*) FILTER (ok) AS total_labeled,
        count(*) FILTER (ok AND label = '分類不能') AS qa_count, count(*) FILTER (NOT ok) AS failures, {MIN} AS min_per_label
        FROM labeled), (SELECT count(*) FILTER (n < {MIN}) AS labels_below_count, count(*) FILTER (n < {MIN}) = 0 AS complete
        FROM (SELECT d.label, count(l.event_id) AS n FROM dim d LEFT JOIN labeled l ON l.label = d.label AND l.ok
              WHERE NOT is_qa GROUP BY d.label))""",
)
def progress_report(spark, sf_dir):
    log = V.labeled(spark, sf_dir)
    return progress.progress_report(resume.ok_rows(log), log.filter(~F.col("ok")), V.dim(spark), MIN)


@query(
    "pipeline_report",
    W("labeled", "dim", **COUNTS) + f""", every AS (SELECT d.label_id, d.label, count(l.event_id) AS n FROM dim d
        LEFT JOIN labeled l ON l.label = d.label AND l.ok WHERE NOT is_qa GROUP BY ALL)
      SELECT (SELECT count(*) FROM labeled WHERE ok) AS total_labeled, (SELECT string_agg(label_id || ':' || n, ',' ORDER BY label_id) FROM every) AS label_counts,
        (SELECT coalesce(string_agg(label || ':' || n, ',' ORDER BY label), '') FROM (SELECT label, count(*) AS n FROM labeled WHERE ok AND label = '分類不能' GROUP BY 1)) AS qa_counts,
        (SELECT coalesce(string_agg(label_id || ':' || n, ',' ORDER BY n, label_id), '') FROM every WHERE n < {MIN}) AS labels_below_target, 7::BIGINT AS retries, 'm' AS model""",
)
def pipeline_report(spark, sf_dir):
    log = V.labeled(spark, sf_dir)
    row = progress.pipeline_report(resume.ok_rows(log), log.filter(~F.col("ok")), V.dim(spark), MIN, {"retries": 7}, "m")

    def listed(column, name):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x[name].cast("string"), x["count"].cast("string"))), ",").alias(column)

    return row.select(
        "total_labeled", listed("label_counts", "label_id"), listed("qa_counts", "label"), listed("labels_below_target", "label_id"),
        F.col("stats")["retries"].alias("retries"), "model",
    )


DEFICITS = dict(
    deficits="SELECT label_id, label, count AS have, greatest(0, 300 - count) AS need FROM counts WHERE count < 300"
)


def deficits(spark, sf_dir):
    return progress.label_deficits(counts(spark, sf_dir), 300)


@query("label_deficits", W("labeled", "dim", **COUNTS, **DEFICITS) + "SELECT * FROM deficits")
def label_deficits(spark, sf_dir):
    return deficits(spark, sf_dir)


@query(
    "label_deficits_listed",
    W("labeled", "dim", **COUNTS) + """SELECT label_id, label, count AS have, greatest(0, 300 - count) AS need
      FROM counts WHERE label IN ('愛', 'H', '国')""",
)
def label_deficits_listed(spark, sf_dir):
    return progress.label_deficits(counts(spark, sf_dir), 300, ["愛", "Ｈ", " 国"])


@query(
    "synthesis_plan",
    W("labeled", "dim", **COUNTS, **DEFICITS) + """SELECT *, CAST(least(12, ceil(need / 10.0)) AS INTEGER) AS planned_rounds
      FROM deficits""",
)
def synthesis_plan(spark, sf_dir):
    return progress.synthesis_plan(deficits(spark, sf_dir))


@query(
    "combined_status",
    W("labeled", "attempts", "dim") + """SELECT label_id, label, real, synthetic, real + synthetic AS total,
      CASE WHEN real + synthetic < 300 THEN 'need ' || (300 - real - synthetic) ELSE 'OK' END AS status
      FROM (SELECT d.label_id, d.label, (SELECT count(*) FROM labeled l WHERE l.label = d.label) AS real,
            (SELECT count(*) FROM attempts a WHERE a.label = d.label) AS synthetic FROM dim d WHERE NOT is_qa)""",
)
def combined_status(spark, sf_dir):
    return progress.combined_status(V.labeled(spark, sf_dir), V.attempts(spark, sf_dir), V.dim(spark), 300)


@query(
    "confidence_report",
    W("labeled") + """SELECT count(*) AS labeled, round(avg(confidence), 6) AS confidence_mean,
      min(confidence) AS confidence_min, count(*) FILTER (confidence < 0.6) AS bucket_low,
      count(*) FILTER (confidence >= 0.6 AND confidence < 0.8) AS bucket_mid,
      count(*) FILTER (confidence >= 0.8) AS bucket_high, count(*) FILTER (is_uncertain) AS uncertain_count,
      count(*) FILTER (pass = 2) AS pass2_count,
      count(*) FILTER (confidence < 0.6 OR is_uncertain) AS needs_human_review_count FROM labeled WHERE ok""",
)
def confidence_report(spark, sf_dir):
    report = progress.confidence_report(resume.ok_rows(V.labeled(spark, sf_dir)))
    return report.withColumn("confidence_mean", F.round("confidence_mean", 6))


@query(
    "refine_candidates",
    W("labeled") + "SELECT event_id, label FROM labeled WHERE confidence < 0.6 OR is_uncertain",
)
def refine_candidates(spark, sf_dir):
    return progress.refine_candidates(V.labeled(spark, sf_dir)).select("event_id", "label")


@query("ok_rows", W("labeled") + "SELECT event_id, label, confidence FROM labeled WHERE ok")
def ok_rows(spark, sf_dir):
    return resume.ok_rows(V.labeled(spark, sf_dir)).select("event_id", "label", "confidence")


@query(
    "item_shape",
    W("labeled") + """SELECT event_id, pubkey, created_at, content, label, label_id, confidence, rationale,
      is_uncertain, pass, source FROM labeled""",
)
def item_shape(spark, sf_dir):
    return resume.item_shape(V.labeled(spark, sf_dir))


LAST = dict(
    last_ok="""SELECT * FROM attempts WHERE ok QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ord DESC) = 1"""
)


@query("last_wins", W("attempts", **LAST) + "SELECT event_id, label, ord FROM last_ok")
def last_wins(spark, sf_dir):
    return resume.last_ok(V.attempts(spark, sf_dir)).select("event_id", "label", "ord")


@query("relabel_counts", W("attempts", **LAST) + "SELECT label, count(*) AS count FROM last_ok GROUP BY label")
def relabel_counts(spark, sf_dir):
    return stream.relabel_counts(V.attempts(spark, sf_dir))


@query(
    "resume_anti_ok",
    W("snapshot", "attempts") + """SELECT event_id, label FROM snapshot
      WHERE event_id NOT IN (SELECT event_id FROM attempts WHERE ok)""",
)
def resume_anti_ok(spark, sf_dir):
    return resume.remaining_retry_failed(V.snapshot(spark, sf_dir), V.attempts(spark, sf_dir)).select("event_id", "label")


@query(
    "resume_anti_seen",
    W("snapshot", "attempts") + "SELECT event_id, label FROM snapshot WHERE event_id NOT IN (SELECT event_id FROM attempts)",
)
def resume_anti_seen(spark, sf_dir):
    return resume.remaining_unseen(V.snapshot(spark, sf_dir), V.attempts(spark, sf_dir)).select("event_id", "label")


@query(
    "merge_existing",
    W("labeled", "snapshot") + """SELECT event_id, label, source FROM labeled UNION ALL
      SELECT event_id, label, source FROM snapshot WHERE event_id NOT IN (SELECT event_id FROM labeled)""",
)
def merge_existing(spark, sf_dir):
    return resume.merge_existing(V.labeled(spark, sf_dir), V.snapshot(spark, sf_dir)).select("event_id", "label", "source")


@query(
    "pass2_overlay",
    W("labeled", "snapshot") + """SELECT l.event_id, coalesce(s.label, l.label) AS label,
      coalesce(s.confidence, l.confidence) AS confidence, coalesce(s.source, l.source) AS source
      FROM labeled l LEFT JOIN snapshot s ON l.event_id = s.event_id AND s.ok""",
)
def pass2_overlay(spark, sf_dir):
    second = V.snapshot(spark, sf_dir).filter("ok")
    return resume.pass2_overlay(V.labeled(spark, sf_dir), second).select("event_id", "label", "confidence", "source")


@query(
    "seed_modes",
    W("attempts", "snapshot", **LAST) + """SELECT mode, label, count(*) AS seen, count(*) FILTER (counted) AS counted FROM (
        SELECT event_id, coalesce(label, '') AS label, mode, mode = 'seed' AND label IS NOT NULL AS counted FROM (
          SELECT event_id, label FROM last_ok
          UNION ALL SELECT event_id, label FROM snapshot WHERE event_id NOT IN (SELECT event_id FROM last_ok)
          UNION ALL SELECT DISTINCT event_id, NULL FROM attempts WHERE event_id NOT IN (SELECT event_id FROM last_ok)
            AND event_id NOT IN (SELECT event_id FROM snapshot)), (VALUES ('fresh'), ('seed')) AS m(mode))
      GROUP BY mode, label""",
)
def seed_modes(spark, sf_dir):
    log, stored = V.attempts(spark, sf_dir), V.snapshot(spark, sf_dir)
    both = None
    for mode, flag in (("fresh", False), ("seed", True)):
        seeds = resume.seed_state(log, stored, flag).withColumn("mode", F.lit(mode))
        both = seeds if both is None else both.unionByName(seeds)
    return both.groupBy("mode", F.coalesce("label", F.lit("")).alias("label")).agg(
        F.count(F.lit(1)).alias("seen"), F.count_if("counted").alias("counted")
    )


@query(
    "label_lookup",
    W("attempts", "dim") + """SELECT event_id, ord, trim(label) AS label, d.label_id FROM
      (SELECT event_id, ord, CASE WHEN ord % 6 = 0 THEN 'none' ELSE label END AS label FROM attempts) a
      LEFT JOIN dim d USING (label)""",
)
def label_lookup(spark, sf_dir):
    rows = V.attempts(spark, sf_dir).select(
        "event_id", "ord", F.when(F.col("ord") % 6 == 0, F.lit("none")).otherwise(F.col("label")).alias("label")
    )
    return labels.label_lookup(rows, V.dim(spark)).select("event_id", "ord", "label", "label_id")


SPELLED = """CASE WHEN seq % 4 = 0 THEN ' ' || label || chr(12288) WHEN seq % 4 = 1 AND label = 'H' THEN 'Ｈ'
  WHEN seq % 9 = 5 THEN 'x' ELSE label END"""


def spelled(spark, sf_dir):
    seq, label = F.col("seq"), F.col("label")
    return V.labeled(spark, sf_dir).select(
        "event_id",
        F.when(seq % 4 == 0, F.concat(F.lit(" "), label, F.lit(chr(0x3000))))
        .when((seq % 4 == 1) & (label == "H"), F.lit("Ｈ"))
        .when(seq % 9 == 5, F.lit("x"))
        .otherwise(label)
        .alias("label"),
    )


FOLD_H = f"translate({Q.strip('label')}, 'Ｈ', 'H')"


@query(
    "normalize_label",
    W("labeled", spelled=f"SELECT event_id, {SPELLED} AS label FROM labeled")
    + f"SELECT event_id, {FOLD_H} AS normalized_label FROM spelled",
)
def normalize_label(spark, sf_dir):
    return progress.with_normalized_label(spelled(spark, sf_dir)).select("event_id", "normalized_label")


@query(
    "valid_label",
    W("labeled", "dim", spelled=f"SELECT event_id, {SPELLED} AS label FROM labeled")
    + f"""SELECT s.event_id, d.label IS NOT NULL AND NOT d.is_qa AS is_target, d.label IS NOT NULL AS is_allowed,
      coalesce(d.label_id, -1) AS label_id FROM spelled s LEFT JOIN dim d ON d.label = {FOLD_H.replace("label", "s.label")}""",
)
def valid_label(spark, sf_dir):
    label = F.col("label")
    return spelled(spark, sf_dir).select(
        "event_id",
        labels.is_valid_label(label).alias("is_target"),
        labels.is_valid_label(label, allow_qa=True).alias("is_allowed"),
        labels.label_id_of(label).alias("label_id"),
    )


EXAMPLES = dict(
    examples=f"""SELECT label, content, rn FROM (SELECT *, row_number() OVER (PARTITION BY label
        ORDER BY {Q.u16('content')}, seq) AS rn FROM labeled WHERE NOT {Q.blank('content')}) WHERE rn <= 3"""
)


@query(
    "shortest_examples",
    W("labeled", **EXAMPLES) + "SELECT label, content, rn AS example_rank FROM examples",
)
def shortest_examples(spark, sf_dir):
    return sampling.shortest_examples(V.labeled(spark, sf_dir)).select(
        "label", "content", F.col("example_rank").cast("long").alias("example_rank")
    )


def _prompt_texts():
    from postloom.functions import prompts as P

    return P


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _labeling_sql() -> str:
    P = _prompt_texts()
    task = "\n".join(
        [P.LABEL_LIST_TITLE, labels.label_list_text(), "", P.JUDGE_RULES, "", P.ANSWER_SCHEMA, "", P.POST_TITLE]
    )
    first, last = P.REFINE_HEADER.split("{label}")
    return f"""SELECT event_id, md5({_lit(P.TASK_HEADER)} || chr(10) || chr(10) || {_lit(task)} || chr(10) || content) AS first_pass,
      md5({_lit(first)} || label || {_lit(last)} || chr(10) || chr(10) || {_lit(task)} || chr(10) || content) AS second_pass
      FROM labeled"""


@query("labeling_prompts", W("labeled") + _labeling_sql())
def labeling_prompts(spark, sf_dir):
    P = _prompt_texts()
    return V.labeled(spark, sf_dir).select(
        "event_id",
        F.md5(P.labeling_prompt(F.col("content"))).alias("first_pass"),
        F.md5(P.refinement_prompt(F.col("content"), F.col("label"))).alias("second_pass"),
    )


def _synthesis_sql() -> str:
    P = _prompt_texts()
    head, rest = P.SYNTHESIS_HEADER.split("{count}")
    middle, rest = rest.split("{label}")
    between, tail = rest.split("{definition}")
    list_text = "\n" + P.LABEL_LIST_TITLE + "\n" + labels.label_list_text()
    return f"""SELECT d.label_id, d.label, need, {_lit(head)} || '10' || {_lit(middle)} || d.label || {_lit(between)} || definition
      || {_lit(tail)} || {_lit(list_text)} || coalesce({_lit(chr(10) * 2 + P.EXAMPLES_TITLE + chr(10))} || lines, '')
      || {_lit(chr(10) * 2 + P.SYNTHESIS_FOOTER)} AS prompt
      FROM deficits d JOIN dim USING (label) LEFT JOIN (SELECT label, string_agg('- ' || {Q.collapse('content')}, chr(10)
        ORDER BY rn) AS lines FROM examples GROUP BY label) USING (label) WHERE need > 0"""


@query("synthesis_prompts", W("labeled", "dim", **COUNTS, **DEFICITS, **EXAMPLES) + _synthesis_sql())
def synthesis_prompts(spark, sf_dir):
    return backfill.synthesis_prompts(deficits(spark, sf_dir), V.labeled(spark, sf_dir), V.dim(spark), 10)


NOW, DAYS = V.NOW - 40000, 7
SINCE = (NOW // 86400 - (DAYS - 1)) * 86400
RECENT = dict(
    recent=f"""SELECT * FROM attempts WHERE created_at BETWEEN {SINCE} AND {NOW}
      QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ord) = 1"""
)


@query("recent_posts", W("attempts", **RECENT) + "SELECT event_id, created_at, ord FROM recent")
def recent_posts(spark, sf_dir):
    seen = V.attempts(spark, sf_dir).withColumn("seq", F.col("ord"))
    return activity.recent_posts(seen, NOW, DAYS).select("event_id", "created_at", "ord")


@query(
    "recent_day_window",
    W("labeled") + f"""SELECT event_id, created_at BETWEEN {SINCE} AND {NOW} AS inside, {SINCE} AS since_sec,
      strftime(make_timestamp({SINCE}::BIGINT * 1000000), '%Y/%-m/%-d') || ' 〜 ' ||
      strftime(make_timestamp({NOW}::BIGINT * 1000000), '%Y/%-m/%-d') AS range_label FROM labeled""",
)
def recent_day_window(spark, sf_dir):
    return V.labeled(spark, sf_dir).select(
        "event_id",
        C.in_recent_days(F.col("created_at"), NOW, DAYS).alias("inside"),
        C.recent_days_start(NOW, DAYS).cast("int").alias("since_sec"),
        C.day_range_label(NOW, DAYS).alias("range_label"),
    )


@query(
    "local_day_key",
    W("labeled") + "SELECT event_id, strftime(make_timestamp(created_at * 1000000), '%Y-%-m-%-d') AS day_key FROM labeled",
)
def local_day_key(spark, sf_dir):
    return V.labeled(spark, sf_dir).select("event_id", C.local_day_key(F.col("created_at")).alias("day_key"))


@query(
    "active_day_stats",
    W("labeled") + """SELECT pubkey, count(DISTINCT created_at // 86400) AS active_days, min(created_at) AS first_sec,
      max(created_at) AS last_sec FROM labeled GROUP BY pubkey""",
)
def active_day_stats(spark, sf_dir):
    return activity.active_day_stats(V.labeled(spark, sf_dir), by="pubkey")


PROFILE = dict(
    latest="""SELECT pubkey, seq, seq % 4 AS kind, content FROM profiles
      QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, seq DESC) = 1""",
    named="""SELECT pubkey, CASE kind WHEN 0 THEN json_extract_string(content, '$.display_name')
      WHEN 1 THEN json_extract_string(content, '$.name') ELSE substr(pubkey, 1, 12) || '…' END AS display_name FROM latest""",
)


@query(
    "profile_join",
    W("labeled", "profiles", **PROFILE) + "SELECT event_id, pubkey, display_name FROM labeled JOIN named USING (pubkey)",
)
def profile_join(spark, sf_dir):
    joined = activity.profile_join(V.labeled(spark, sf_dir), V.profiles(spark, sf_dir))
    return joined.select("event_id", "pubkey", "display_name")


@query(
    "display_name",
    W("labeled", "profiles") + """SELECT seq, CASE seq % 4 WHEN 0 THEN json_extract_string(content, '$.display_name')
      WHEN 1 THEN json_extract_string(content, '$.name') ELSE substr(md5(pubkey), 1, 12) || '…' END AS display_name
      FROM profiles""",
)
def display_name(spark, sf_dir):
    parsed = V.profiles(spark, sf_dir).withColumn("profile", F.from_json("content", activity.PROFILE_SCHEMA))
    return parsed.select("seq", activity.display_name(F.md5("pubkey"), F.col("profile")).alias("display_name"))


@query(
    "hex_key_normalize",
    W("labeled") + """SELECT event_id, CASE WHEN seq % 5 <> 4 THEN md5(pubkey) || md5(event_id) END AS hex_key FROM labeled""",
)
def hex_key_normalize(spark, sf_dir):
    raw = F.concat(
        F.lit(chr(0x3000)), F.upper(F.md5("pubkey")), F.md5("event_id"),
        F.when(F.col("seq") % 5 == 4, F.lit("0")).otherwise(F.lit("\n")),
    )
    return V.labeled(spark, sf_dir).select("event_id", T.hex_key(raw).alias("hex_key"))


@query(
    "rate_window_audit",
    """SELECT CAST(user_id AS VARCHAR) AS key, ts_micros, requests, CAST(sum(requests) OVER (PARTITION BY user_id ORDER BY ts_micros
        RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window,
      sum(requests) OVER (PARTITION BY user_id ORDER BY ts_micros
        RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) > 2 AS over_limit
      FROM (SELECT user_id, epoch_us(ts) AS ts_micros, count(*) AS requests FROM events GROUP BY ALL)""",
)
def rate_window_audit(spark, sf_dir):
    events = V.table(spark, sf_dir, "events").withColumn("user_id", F.col("user_id").cast("string"))
    return activity.rate_window_audit(events, limit_per_window=2, window_seconds=3600, key="user_id")
