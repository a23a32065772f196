"""Evaluation of predictions and preparation of training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks import views as V
from checks.model_queries import WEIGHTS, logits, with_sql
from checks.registry import query
from postloom.functions import scores as S
from postloom.operators import evaluation as E
from postloom.operators.labels import QA_LABEL

W = V.with_views
PREDICTED = dict(
    WEIGHTS,
    predictions="SELECT vec_id, label AS gold, (list_position(p, list_max(p)) - 1) % 10 AS predicted, list_max(p) AS confidence, p FROM probs",
)


def predictions(spark, sf_dir):
    probs = logits(spark, sf_dir).withColumn("probs", S.softmax(F.col("logits")))
    top = S.top_k(F.col("probs"), 3)
    return probs.select(
        "vec_id",
        F.col("label").alias("gold"),
        (S.argmax(F.col("probs")) % 10).cast("long").alias("predicted"),
        F.array_max("probs").alias("confidence"),
        F.transform(top, lambda t: (t["index"] % 10).cast("long")).alias("top"),
    ).withColumn("correct", F.col("gold") == F.col("predicted")).withColumn("gold", F.col("gold").cast("long"))


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


SPLIT = f"""CASE WHEN {Q.hexval("md5('42:' || pubkey)", 1, 8)} / 4294967296.0 < 0.8 THEN 'train'
  WHEN {Q.hexval("md5('42:' || pubkey)", 1, 8)} / 4294967296.0 < 0.9 THEN 'val' ELSE 'test' END"""


@query("group_split", W("labeled") + f"SELECT event_id, pubkey, {SPLIT} AS split FROM labeled")
def group_split(spark, sf_dir):
    return E.group_split(V.labeled(spark, sf_dir)).select("event_id", "pubkey", "split")


@query("drop_qa", W("labeled") + "SELECT event_id, label_id FROM labeled WHERE label_id <> 46")
def drop_qa(spark, sf_dir):
    return E.drop_qa(V.labeled(spark, sf_dir)).select("event_id", "label_id")


@query(
    "class_weights",
    W("gold") + """SELECT label_id, n AS count, round(total / (kinds * n), 6) AS weight FROM
      (SELECT label_id, count(*) AS n FROM gold GROUP BY ALL), (SELECT count(*) AS total, count(DISTINCT label_id) AS kinds FROM gold)""",
)
def class_weights(spark, sf_dir):
    return rounded(E.class_weights(V.gold(spark, sf_dir)), "weight")


@query("confusion_matrix", with_sql(**PREDICTED) + "SELECT gold, predicted, count(*) AS count FROM predictions GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(predictions(spark, sf_dir))


REPORT = """SELECT k AS label, (SELECT count(*) FROM predictions WHERE gold = k) AS support,
    (SELECT count(*) FROM predictions WHERE predicted = k) AS named,
    (SELECT count(*) FROM predictions WHERE predicted = k AND gold = k) AS hits
  FROM (SELECT gold AS k FROM predictions UNION SELECT predicted FROM predictions)"""
PER_CLASS = dict(
    PREDICTED,
    counted=REPORT,
    report="""SELECT label, support, CASE WHEN named > 0 THEN hits / named ELSE 0.0 END AS precision,
      CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall FROM counted""",
    scored="SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM report",
)


@query("class_report", with_sql(**PER_CLASS) + "SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM scored")
def class_report(spark, sf_dir):
    return rounded(E.class_report(predictions(spark, sf_dir)), "precision", "recall", "f1")


@query(
    "macro_f1",
    with_sql(**PER_CLASS) + """SELECT round(avg(f1), 6) AS macro_f1, round(avg(precision), 6) AS macro_precision,
      round(avg(recall), 6) AS macro_recall, count(*) AS labels FROM scored""",
)
def macro_f1(spark, sf_dir):
    return rounded(E.macro_f1(predictions(spark, sf_dir)), "macro_f1", "macro_precision", "macro_recall")


@query(
    "top3_accuracy",
    with_sql(**PREDICTED) + """, ranked AS (SELECT vec_id, gold, i, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, i) AS rank FROM
        (SELECT vec_id, gold, p[i] AS prob, i FROM (SELECT vec_id, gold, p, unnest(range(1, len(p) + 1)) AS i FROM predictions)))
      SELECT round(avg(hit::INT), 6) AS accuracy, count(*) AS rows FROM
        (SELECT vec_id, bool_or((i - 1) % 10 = gold) AS hit FROM ranked WHERE rank <= 3 GROUP BY vec_id)""",
)
def top3_accuracy(spark, sf_dir):
    return rounded(E.top_k_accuracy(predictions(spark, sf_dir)), "accuracy")


BINS = dict(
    PREDICTED,
    bins="""SELECT least(9, CAST(floor(confidence * 10) AS INTEGER)) AS bin, count(*) AS rows, avg(confidence) AS confidence,
      avg((gold = predicted)::INT) AS accuracy FROM predictions GROUP BY 1""",
)


@query("reliability", with_sql(**BINS) + "SELECT bin, rows, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM bins")
def reliability(spark, sf_dir):
    return rounded(E.reliability(predictions(spark, sf_dir)), "confidence", "accuracy")


@query(
    "ece",
    with_sql(**BINS) + """SELECT round(sum(rows * abs(confidence - accuracy)) / sum(rows), 6) AS ece, round(max(abs(confidence - accuracy)), 6) AS largest_gap,
      CAST(sum(rows) AS BIGINT) AS rows FROM bins""",
)
def ece(spark, sf_dir):
    return rounded(E.calibration_error(predictions(spark, sf_dir)), "ece", "largest_gap")


@query(
    "review_sample",
    W("labeled") + """SELECT event_id, label_id, rank FROM (SELECT *, row_number() OVER
      (PARTITION BY label_id ORDER BY md5('42:' || event_id), event_id) AS rank FROM labeled) WHERE rank <= 20""",
)
def review_sample(spark, sf_dir):
    return E.review_sample(V.labeled(spark, sf_dir)).select("event_id", "label_id", F.col("rank").cast("long").alias("rank"))


@query(
    "qa_rate",
    W("labeled") + f"""SELECT count(*) AS rows, count(*) FILTER (label = '{QA_LABEL}') AS qa_count,
      round(avg((label = '{QA_LABEL}')::INT), 6) AS qa_rate, avg((label = '{QA_LABEL}')::INT) > 0.03 AS too_high FROM labeled""",
)
def qa_rate(spark, sf_dir):
    return rounded(E.qa_rate(V.labeled(spark, sf_dir)), "qa_rate")


@query(
    "oversample",
    W("labeled") + f""", marked AS (SELECT event_id, label_id, {SPLIT} AS split FROM labeled),
      counts AS (SELECT label_id, count(*) AS n FROM marked WHERE split = 'train' GROUP BY ALL),
      factors AS (SELECT label_id, least(10, greatest(1, CAST(round((SELECT max(n) FROM counts) / n) AS INTEGER))) AS factor FROM counts)
      SELECT event_id, label_id, split, unnest(range(0, CASE WHEN split = 'train' THEN factor ELSE 1 END)) AS copy
      FROM marked LEFT JOIN factors USING (label_id)""",
)
def oversample(spark, sf_dir):
    rows = E.oversample(E.group_split(V.labeled(spark, sf_dir)))
    return rows.select("event_id", "label_id", "split", F.col("copy").cast("long").alias("copy"))
