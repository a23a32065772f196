"""Answers, labeling hooks, classifier scores and author digest."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks import stubs
from checks import views as V
from checks.registry import query
from postloom.functions import answers as A
from postloom.functions import scores as S
from postloom.operators import labeling, labels, progress
from postloom.plans import digest, two_pass
from postloom.session import scratch_path
from postloom.sources import jsonl

W = V.with_views


def logits(spark, sf_dir):
    return V.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("logits"), "label")


WEIGHTS = dict(
    weights="""SELECT vec_id, label, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS w
      FROM embeddings""",
    probs="SELECT vec_id, label, list_transform(w, lambda x: x / list_sum(w)) AS p FROM weights",
)


def with_sql(**ctes: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({t})" for n, t in ctes.items()) + " "


@query(
    "softmax",
    with_sql(**WEIGHTS) + """SELECT vec_id, i - 1 AS index, round(p[i], 6) AS prob FROM
      (SELECT vec_id, p, unnest(range(1, len(p) + 1)) AS i FROM probs)""",
)
def softmax(spark, sf_dir):
    probs = logits(spark, sf_dir).select("vec_id", F.posexplode(S.softmax(F.col("logits"))).alias("index", "prob"))
    return probs.select("vec_id", F.col("index").cast("long").alias("index"), F.round("prob", 6).alias("prob"))


@query(
    "argmax_label",
    with_sql(**WEIGHTS) + "SELECT vec_id, list_position(p, list_max(p)) - 1 AS index, round(list_max(p), 6) AS prob FROM probs",
)
def argmax_label(spark, sf_dir):
    probs = logits(spark, sf_dir).withColumn("probs", S.softmax(F.col("logits")))
    return probs.select("vec_id", S.argmax(F.col("probs")).alias("index"), F.round(F.array_max("probs"), 6).alias("prob"))


@query(
    "prob_topk",
    with_sql(**WEIGHTS) + """SELECT vec_id, i - 1 AS index, round(prob, 6) AS prob, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, i) AS rank FROM
      (SELECT vec_id, p[i] AS prob, i FROM (SELECT vec_id, p, unnest(range(1, len(p) + 1)) AS i FROM probs))) WHERE rank <= 3""",
)
def prob_topk(spark, sf_dir):
    top = logits(spark, sf_dir).select("vec_id", F.posexplode(S.top_k(S.softmax(F.col("logits")), 3)).alias("rank", "t"))
    return top.select(
        "vec_id", F.col("t.index").cast("long").alias("index"), F.round("t.prob", 6).alias("prob"),
        (F.col("rank") + 1).cast("long").alias("rank"),
    )


def predicted(spark, sf_dir):
    indexed = logits(spark, sf_dir).select("vec_id", "label", S.argmax(F.col("logits")).alias("index"))
    return labels.label_for_index(indexed, V.dim(spark))


PREDICTED = dict(
    predicted="""SELECT vec_id, e.label AS gold, list_position(embedding, list_max(embedding)) - 1 AS id FROM embeddings e""",
    named="""SELECT vec_id, gold, id, coalesce(d.label, '?') AS char, coalesce(d.definition, '') AS def
      FROM predicted LEFT JOIN dim d ON d.label_id = id""",
)


@query("label_for_index", W("dim", **PREDICTED) + "SELECT vec_id, id, char, def FROM named")
def label_for_index(spark, sf_dir):
    return predicted(spark, sf_dir).select("vec_id", "id", "char", "def")


@query(
    "label_share",
    W("dim", **PREDICTED) + """SELECT id, char, def, count(*) AS count,
      round(count(*)::DOUBLE / (SELECT count(*) FROM named), 6) AS share FROM named GROUP BY ALL""",
)
def label_share(spark, sf_dir):
    return progress.label_share(predicted(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(
    "accuracy",
    W("dim", **PREDICTED) + "SELECT round(avg((id % 10 = gold)::INT), 6) AS accuracy, count(*) AS rows FROM named",
)
def accuracy(spark, sf_dir):
    rows = predicted(spark, sf_dir).select((F.col("id") % 10).alias("predicted"), F.col("label").alias("gold"))
    return progress.accuracy(rows).withColumn("accuracy", F.round("accuracy", 6))


# --- answers --------------------------------------------------------------------------------------
@query(
    "parse_answers",
    W("answers") + """SELECT event_id, coalesce(json_valid(answer_text), false) AS parsed,
      CASE WHEN json_valid(answer_text) AND json_type(answer_text) = 'OBJECT'
        THEN json_extract_string(answer_text, '$.label') END AS label FROM answers""",
)
def parse_answers(spark, sf_dir):
    text = F.col("answer_text")
    half = (F.length(text) / 2).cast("int")
    parts = F.array(F.substring(text, F.lit(1), half), F.lit(None).cast("string"), F.substr(text, half + 1))
    parsed = V.answers(spark, sf_dir).withColumn("answer", A.parse_json_text(A.join_parts(parts)))
    return parsed.select(
        "event_id", F.col("answer").isNotNull().alias("parsed"),
        F.try_variant_get("answer", "$.label", "string").alias("label"),
    )


ERRORS_SQL = """CASE seq % 13 WHEN 0 THEN 'not_an_object' WHEN 6 THEN 'not_an_object' WHEN 1 THEN 'range:confidence'
    WHEN 2 THEN 'label_not_allowed' WHEN 3 THEN CASE WHEN label_id = 46 THEN 'range:label_id,' ELSE '' END || 'label_id_mismatch'
    WHEN 4 THEN 'missing:label_id' WHEN 5 THEN 'type:label_id,type:confidence,type:rationale,type:is_uncertain' ELSE '' END"""


@query("validate_answers", W("answers") + f"SELECT event_id, {ERRORS_SQL} AS errors FROM answers")
def validate_answers(spark, sf_dir):
    parsed = V.answers(spark, sf_dir).withColumn("answer", A.parse_json_text(F.col("answer_text")))
    return A.with_answer_errors(parsed).select("event_id", F.array_join("errors", ",").alias("errors"))


@query(
    "answers_to_labeled",
    W("answers") + f"""SELECT event_id, pubkey, created_at, content, label, label_id,
      json_extract(answer_text, '$.confidence')::DOUBLE AS confidence, json_extract_string(answer_text, '$.rationale') AS rationale,
      json_extract_string(answer_text, '$.is_uncertain') = 'true' AS is_uncertain, 1 AS pass, 'stub' AS source
      FROM answers WHERE {ERRORS_SQL} = ''""",
)
def answers_to_labeled(spark, sf_dir):
    parsed = V.answers(spark, sf_dir).withColumn("answer", A.parse_json_text(F.col("answer_text")))
    return labeling.answers_to_labeled(A.valid_answers(parsed), "stub")


ATTEMPT_LOG = """SELECT event_id, k AS attempt, CASE (event_id + k) % 6 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503
    WHEN 3 THEN 0 WHEN 4 THEN 400 ELSE 200 END AS status_code, CASE WHEN (event_id + k) % 12 = 1 THEN 7 END AS retry_after
  FROM (SELECT event_id, unnest(range(0, event_id % 7 + 1)) AS k FROM events)"""


@query(
    "attempt_outcomes",
    with_sql(log=ATTEMPT_LOG) + """SELECT event_id, attempts, status_code AS last_status, again AS retryable,
      CASE WHEN status_code = 200 THEN 'ok' WHEN again AND attempt < 5 THEN 'retry' WHEN again THEN 'exhausted' ELSE 'failed' END AS outcome,
      CASE WHEN again AND attempt < 5 THEN CAST(coalesce(CASE WHEN status_code <> 0 THEN retry_after * 1000 END,
        least(60000, 1000 * 2 ** attempt)) AS BIGINT) END AS max_delay_ms
      FROM (SELECT *, status_code IN (0, 429, 503) AS again, count(*) OVER (PARTITION BY event_id) AS attempts FROM log
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY attempt DESC) = 1)""",
)
def attempt_outcomes(spark, sf_dir):
    k, event = F.col("k"), F.col("event_id")
    log = V.table(spark, sf_dir, "events").select("event_id", F.explode(F.sequence(F.lit(0).cast("long"), event % 7)).alias("k"))
    kind = (event + k) % 6
    status = F.when(kind == 1, 429).when(kind == 2, 503).when(kind == 3, 0).when(kind == 4, 400).otherwise(200)
    log = log.select(
        "event_id", k.cast("int").alias("attempt"), status.alias("status_code"),
        F.when((event + k) % 12 == 1, 7).cast("long").alias("retry_after"),
    )
    return labeling.attempt_outcomes(log)


# --- hooks ------------------------------------------------------------------------------------------
@query(
    "label_with",
    W("chats", first=stubs.sql_outcome("chats", "event_id")) + "SELECT * FROM first",
)
def label_with(spark, sf_dir):
    rows = labeling.label_with(V.chats(spark, sf_dir), stubs.label_once, "stub", max_retries=2)
    return rows.select(
        "event_id", "ok", "label", "label_id", "confidence", "is_uncertain",
        F.substring_index("reason", ":", 1).alias("reason"),
    )


@query(
    "label_two_pass",
    W(
        "chats", "labeled",
        first=stubs.sql_outcome("(SELECT * FROM chats)", "event_id, content"),
        second=f"""SELECT event_id, {V.sql_label_at('idx')} AS label, substr(h, 9, 1) <> '0' AS ok FROM
          (SELECT event_id, md5(content) AS h, {Q.hexval('md5(content)', 10, 2)} % 47 AS idx FROM first
           WHERE ok AND (confidence < 0.6 OR is_uncertain))""",
    )
    + """SELECT f.event_id, coalesce(s.label, f.label) AS label, CASE WHEN s.label IS NULL THEN f.confidence ELSE 0.875 END AS confidence,
      CASE WHEN s.label IS NULL THEN 1 ELSE 2 END AS pass FROM first f LEFT JOIN second s ON s.event_id = f.event_id AND s.ok WHERE f.ok""",
)
def label_two_pass(spark, sf_dir):
    done = two_pass.label_two_pass(
        V.chats(spark, sf_dir), stubs.label_once, "stub", refiner=stubs.refine_once, max_retries=2
    )
    return done.items.select("event_id", "label", "confidence", "pass")


@query(
    "label_two_pass_resume",
    W("chats", first=stubs.sql_outcome("(SELECT * FROM chats)", "event_id, content"),
      logged="SELECT event_id, '愛' AS label, 1 AS pass FROM chats WHERE turn % 3 = 0")
    + """SELECT event_id, label, pass FROM logged
      UNION ALL SELECT event_id, label, 1 FROM first WHERE ok AND event_id NOT IN (SELECT event_id FROM logged)""",
)
def label_two_pass_resume(spark, sf_dir):
    """A log with successes and failures: the former keep their answers, the latter are asked again."""
    posts, path = V.chats(spark, sf_dir), scratch_path(spark, "two-pass-log")
    done = posts.filter("turn % 3 = 0").select(
        "event_id", "pubkey", "created_at", "content", F.lit("愛").alias("label"), F.lit(0).alias("label_id"), F.lit(0.9).alias("confidence"),
        F.lit("r").alias("rationale"), F.lit(False).alias("is_uncertain"), F.lit(1).alias("pass"), F.lit("log").alias("source"),
        F.lit(True).alias("ok"), F.lit(None).cast("string").alias("reason"),
    )
    failed = posts.filter("turn % 3 = 1").select("event_id", F.lit(False).alias("ok"), F.lit("http_500").alias("reason"))
    jsonl.append_log(done, path)
    jsonl.append_log(failed, path)
    two_pass.label_two_pass(posts, stubs.label_once, "stub", max_retries=2, refine=False, log_path=path)
    again = two_pass.label_two_pass(posts.filter("turn % 3 <> 1"), stubs.label_once, "stub", max_retries=2, refine=False, log_path=path)
    return again.items.select("event_id", "label", "pass")


PREDICT = dict(
    numbered="SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, seq) - 1 AS source_index FROM jposts",
    normal=f"SELECT *, {Q.collapse(Q.clean('content'))} AS norm FROM numbered WHERE source_index < 40",
    scored=stubs.sql_prediction("(SELECT * FROM normal WHERE norm <> '')", "norm"),
)


@query(
    "classify_posts",
    W("jposts", "dim", **PREDICT) + """SELECT pubkey, event_id, source_index, idx AS id, d.label AS char, d.definition AS def,
      round(prob, 6) AS prob FROM scored JOIN dim d ON d.label_id = idx""",
)
def classify_posts(spark, sf_dir):
    rows = labeling.classify_posts(V.jposts(spark, sf_dir), V.dim(spark), stubs.make_backend, 40)
    return rows.withColumns({"prob": F.round("prob", 6), "source_index": F.col("source_index").cast("long")})


DIGEST_NOW = 1703888000
DIGEST_SINCE = (DIGEST_NOW // 86400 - 29) * 86400
POST_PROFILES = f"""SELECT pubkey, created_at, seq, '{{"name":"' || CASE WHEN seq % 2 = 0 THEN lang ELSE '' END || '"}}' AS content FROM posts"""


@query(
    "author_digest",
    W(
        "jposts", "dim",
        recent=f"SELECT * FROM jposts WHERE created_at BETWEEN {DIGEST_SINCE} AND {DIGEST_NOW}",
        numbered="SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, seq) - 1 AS source_index FROM recent",
        normal=f"SELECT *, {Q.collapse(Q.clean('content'))} AS norm FROM numbered WHERE source_index < 200",
        scored=stubs.sql_prediction("(SELECT * FROM normal WHERE norm <> '')", "norm"),
        tally="SELECT pubkey, idx AS id, count(*) AS count FROM scored GROUP BY ALL",
        stats="""SELECT pubkey, count(DISTINCT created_at // 86400) AS active_days, min(created_at) AS first_sec,
          max(created_at) AS last_sec FROM recent GROUP BY pubkey""",
        names="""SELECT pubkey, CASE WHEN seq % 2 = 0 THEN lang ELSE substr(pubkey, 1, 12) || '…' END AS display_name FROM posts
          QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, seq DESC) = 1""",
    )
    + """SELECT pubkey, id, label AS char, count, CAST(sum(count) OVER (PARTITION BY pubkey) AS BIGINT) AS posts, active_days,
      first_sec, last_sec, display_name, round(count / sum(count) OVER (PARTITION BY pubkey), 6) AS share
      FROM tally JOIN stats USING (pubkey) JOIN names USING (pubkey) JOIN dim ON label_id = id""",
)
def author_digest(spark, sf_dir):
    posts = V.posts(spark, sf_dir)
    name = F.when(F.col("seq") % 2 == 0, F.col("lang")).otherwise(F.lit(""))
    profile = F.concat(F.lit('{"name":"'), name, F.lit('"}'))
    profile_events = posts.select("pubkey", "created_at", "seq", profile.alias("content"))
    rows = digest.author_digest(
        V.jposts(spark, sf_dir), profile_events, V.dim(spark), stubs.make_backend, DIGEST_NOW, 30
    )
    return rows.withColumn("share", F.round("share", 6))
