"""Training export, training rows, subset, split, backfill."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks import stubs
from checks import views as V
from checks.label_queries import COUNTS
from checks.registry import query
from postloom.functions import answers as A
from postloom.functions import text as T
from postloom.operators import export, progress, sampling, synthesis
from postloom.plans import backfill, generation, training
from postloom.session import scratch_path

W = V.with_views


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


# --- source records: JSON texts of events with missing, null and mistyped fields -----------------
RECORD_SQL = """CASE seq % 12
  WHEN 0 THEN '"text"'
  WHEN 1 THEN '{"event_id":"' || event_id || '","content":"  ","label":"' || label || '"}'
  WHEN 2 THEN '{"event_id":"' || event_id || '","content":"c' || seq || '","label":"none"}'
  WHEN 3 THEN '{"content":" d' || seq || ' ","label":" ' || label || ' ","created_at":null,"confidence":"0.5","verified":true}'
  WHEN 4 THEN '{"event_id":" ' || event_id || ' ","content":"e' || seq || '","label":"' || label || '","created_at":"x","confidence":true,"pass":"","source":" "}'
  WHEN 5 THEN '{"event_id":"' || event_id || '","content":"f","label":"' || label || '","source":"synthetic:","verified":"true","synthetic":true}'
  WHEN 6 THEN '{"event_id":7,"content":"g","label":"' || label || '","source":"synthetic:m1","pubkey":5,"is_uncertain":true}'
  ELSE '{"event_id":"' || event_id || '","pubkey":"' || pubkey || '","content":"h' || seq || '","label":"' || label
    || '","created_at":' || created_at || ',"confidence":0.75,"pass":' || pass || ',"rationale":"' || rationale
    || '","is_uncertain":false,"source":"' || source || '"}' END"""


def _records(rows, kind: str, fallback: str | None):
    text = F.expr(RECORD_SQL)
    return rows.select(
        A.parse_json_text(text).alias("record"),
        F.lit(f"{kind}-log").alias("source_file"),
        F.lit(1).alias("file_rank"),
        F.col("seq").alias("source_record_index"),
        F.lit(fallback).cast("string").alias("fallback_model"),
    )


def real_records(spark, sf_dir):
    return _records(V.labeled(spark, sf_dir), "real", "base-model")


def synthetic_records(spark, sf_dir):
    return _records(V.snapshot(spark, sf_dir).withColumn("label", V.label_at((F.col("label_id") + 3) % 47)), "synthetic", None)


def _t(x: str) -> str:
    return f"json_type(j, '$.{x}')"


def _s(x: str) -> str:
    return f"CASE WHEN {_t(x)} = 'VARCHAR' THEN json_extract_string(j, '$.{x}') END"


def _num(x: str) -> str:
    text = f"json_extract_string(j, '$.{x}')"
    return f"""CASE {_t(x)} WHEN 'NULL' THEN 0.0 WHEN 'BOOLEAN' THEN CASE WHEN {text} = 'true' THEN 1.0 ELSE 0.0 END
      WHEN 'VARCHAR' THEN CASE WHEN trim({text}) = '' THEN 0.0 ELSE TRY_CAST({text} AS DOUBLE) END
      ELSE TRY_CAST({text} AS DOUBLE) END"""


def _true(x: str) -> str:
    return f"coalesce({_t(x)} = 'BOOLEAN' AND json_extract_string(j, '$.{x}') = 'true', false)"


EXPORT = dict(
    sources=f"""SELECT CAST({RECORD_SQL} AS JSON) AS j, 'real' AS source_type, 0 AS source_rank, 'real-log' AS source_file,
        seq AS source_record_index, 'base-model' AS fallback FROM labeled
      UNION ALL SELECT CAST({RECORD_SQL} AS JSON), 'synthetic', 1, 'synthetic-log', seq, NULL FROM
        (SELECT * REPLACE ({V.sql_label_at('(label_id + 3) % 47')} AS label) FROM snapshot)""",
    fields=f"""SELECT source_type, source_rank, source_file, source_record_index, fallback, json_type(j) AS kind,
        trim(coalesce({_s('content')}, '')) AS content, trim(coalesce({_s('label')}, '')) AS label,
        trim(coalesce({_s('event_id')}, '')) AS id, {_s('source')} AS src, {_num('created_at')} AS created_at,
        {_s('pubkey')} AS pubkey, {_num('confidence')} AS confidence, {_s('rationale')} AS rationale,
        {_true('is_uncertain')} AS is_uncertain, {_num('pass')} AS pass, {_true('verified')} AS verified,
        {_true('synthetic')} OR source_type = 'synthetic' AS synthetic FROM sources""",
    normalized=f"""SELECT content, label, label_id, source_type, source_model,
        CASE WHEN trim(coalesce(src, '')) <> '' THEN trim(src) WHEN source_type = 'synthetic' THEN 'synthetic:' || source_model
          ELSE source_model END AS source,
        source_file, source_record_index, created_at, pubkey, confidence, rationale, is_uncertain, pass, verified, synthetic,
        source_rank, id = '' AS missing_event_id,
        CASE WHEN id = '' THEN source_type || '-missing-' || {Q.chash("(label || chr(10) || content)")} ELSE id END AS event_id,
        CASE WHEN kind NOT IN ('OBJECT', 'ARRAY') THEN 'invalid_record' WHEN content = '' THEN 'missing_content'
          WHEN label_id IS NULL THEN 'invalid_label' END AS skip_reason
      FROM (SELECT f.*, d.label_id, CASE
          WHEN starts_with(src, 'synthetic:') THEN coalesce(nullif(substr(src, 11), ''), nullif(fallback, ''), 'unknown')
          WHEN trim(src) <> '' THEN trim(src) ELSE coalesce(nullif(trim(fallback), ''), 'unknown') END AS source_model
        FROM fields f LEFT JOIN dim d USING (label))""",
    merged="""SELECT * EXCLUDE (source_rank, skip_reason, missing_event_id) FROM normalized WHERE skip_reason IS NULL
      QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY source_rank DESC, source_record_index DESC) = 1""",
)
EXPORT_VIEWS = ("labeled", "snapshot", "dim")


def normalized(spark, sf_dir):
    merged = export.merge_sources(real_records(spark, sf_dir), synthetic_records(spark, sf_dir))
    return export.normalize_records(merged, V.dim(spark))


@query(
    "normalize_records",
    W(*EXPORT_VIEWS, **EXPORT)
    + """SELECT * EXCLUDE (source_rank, skip_reason), coalesce(skip_reason, '') AS skip_reason FROM normalized""",
)
def normalize_records(spark, sf_dir):
    return normalized(spark, sf_dir).withColumn("skip_reason", F.coalesce("skip_reason", F.lit(""))).drop("merge_order")


@query("merge_training", W(*EXPORT_VIEWS, **EXPORT) + "SELECT * FROM merged")
def merge_training(spark, sf_dir):
    return export.merge_training(normalized(spark, sf_dir))


@query("export_order", W(*EXPORT_VIEWS, **EXPORT) + "SELECT event_id, created_at FROM merged")
def export_order(spark, sf_dir):
    return export.export_order(export.merge_training(normalized(spark, sf_dir))).select("event_id", "created_at")


SUMMARY = """SELECT * FROM (SELECT count(*) FILTER (source_type = 'real') AS input_real,
    count(*) FILTER (source_type = 'synthetic') AS input_synthetic,
    count(*) FILTER (skip_reason = 'invalid_record') AS skipped_invalid_record,
    count(*) FILTER (skip_reason = 'missing_content') AS skipped_missing_content,
    count(*) FILTER (skip_reason = 'invalid_label') AS skipped_invalid_label,
    count(*) FILTER (skip_reason IS NULL AND missing_event_id) AS missing_event_ids_assigned,
    count(*) FILTER (skip_reason IS NULL) - (SELECT count(*) FROM merged) AS duplicate_event_ids_overwritten FROM normalized),
  (SELECT count(*) AS total_count, count(*) FILTER (source_type = 'real') AS real_count,
    count(*) FILTER (source_type = 'synthetic') AS synthetic_count FROM merged)"""


@query("training_summary", W(*EXPORT_VIEWS, **EXPORT) + SUMMARY)
def training_summary(spark, sf_dir):
    return export.training_summary(normalized(spark, sf_dir))


@query(
    "build_training_dataset",
    W(*EXPORT_VIEWS, **EXPORT) + """SELECT label_id, label, count(*) FILTER (source_type = 'real') AS real,
      count(*) FILTER (source_type = 'synthetic') AS synthetic, count(*) AS total FROM merged GROUP BY ALL""",
)
def build_training_dataset(spark, sf_dir):
    built = training.build_training_set(real_records(spark, sf_dir), synthetic_records(spark, sf_dir), V.dim(spark))
    return built.label_counts()


@query(
    "export_manifest",
    W(*EXPORT_VIEWS, **EXPORT) + f"""SELECT total_count, real_count, synthetic_count, duplicate_event_ids_overwritten,
      missing_event_ids_assigned, input_real AS real_records_seen, input_synthetic AS synthetic_records_seen,
      false AS real_snapshot_present, false AS synthetic_snapshot_present, true AS real_log_present,
      true AS synthetic_log_present, (SELECT count(*) FROM dim WHERE NOT is_qa) AS label_map_count,
      'observed-46-plus-unclassifiable' AS label_map_version FROM ({SUMMARY})""",
)
def export_manifest(spark, sf_dir):
    real, synthetic, dim = real_records(spark, sf_dir), synthetic_records(spark, sf_dir), V.dim(spark)
    return training.manifest(training.build_training_set(real, synthetic, dim), real, synthetic, dim)


@query(
    "source_model",
    W("labeled", rows="""SELECT event_id, CASE seq % 5 WHEN 0 THEN 'synthetic:' || source WHEN 1 THEN 'synthetic:'
        WHEN 2 THEN ' ' || source || ' ' WHEN 3 THEN ' ' END AS src,
        CASE WHEN seq % 3 = 0 THEN ' f ' END AS fallback, CASE WHEN seq % 2 = 0 THEN 'real' ELSE 'synthetic' END AS kind FROM labeled""")
    + """SELECT event_id, model, CASE WHEN trim(coalesce(src, '')) <> '' THEN trim(src) WHEN kind = 'synthetic'
      THEN 'synthetic:' || model ELSE model END AS source FROM (SELECT *, CASE
        WHEN starts_with(src, 'synthetic:') THEN coalesce(nullif(substr(src, 11), ''), nullif(fallback, ''), 'unknown')
        WHEN trim(src) <> '' THEN trim(src) ELSE coalesce(nullif(trim(fallback), ''), 'unknown') END AS model FROM rows)""",
)
def source_model(spark, sf_dir):
    seq, source = F.col("seq"), F.col("source")
    rows = V.labeled(spark, sf_dir).select(
        "event_id",
        F.when(seq % 5 == 0, F.concat(F.lit("synthetic:"), source))
        .when(seq % 5 == 1, F.lit("synthetic:"))
        .when(seq % 5 == 2, F.concat(F.lit(" "), source, F.lit(" ")))
        .when(seq % 5 == 3, F.lit(" "))
        .alias("src"),
        F.when(seq % 3 == 0, F.lit(" f ")).alias("fallback"),
        F.when(seq % 2 == 0, F.lit("real")).otherwise(F.lit("synthetic")).alias("kind"),
    )
    src, fallback = F.col("src"), F.col("fallback")
    return rows.select(
        "event_id",
        export.source_model(src, fallback).alias("model"),
        export.source_name(src, F.col("kind"), fallback).alias("source"),
    )


@query(
    "fallback_ids",
    W("chats") + f"""SELECT event_id, role || '-missing-' || {Q.chash("('愛' || chr(10) || content)")} AS missing_id,
      'syn-' || {Q.chash('content')} AS synthetic_id FROM chats""",
)
def fallback_ids(spark, sf_dir):
    content = F.col("content")
    return V.chats(spark, sf_dir).select(
        "event_id",
        export.fallback_event_id(F.col("role"), F.lit("愛"), content).alias("missing_id"),
        export.synthetic_event_id(content).alias("synthetic_id"),
    )


@query(
    "coerce_numbers",
    W("labeled", j=f"SELECT seq, CAST({RECORD_SQL} AS JSON) AS j FROM labeled")
    + f"SELECT seq, {_num('created_at')} AS created_at, {_num('confidence')} AS confidence, {_num('pass')} AS pass FROM j",
)
def coerce_numbers(spark, sf_dir):
    rows = V.labeled(spark, sf_dir).select("seq", A.parse_json_text(F.expr(RECORD_SQL)).alias("v"))
    v = F.col("v")
    return rows.select("seq", *[A.coerce_number(v, f"$.{f}").alias(f) for f in ("created_at", "confidence", "pass")])


# --- training rows ------------------------------------------------------------------------------
LINE_SQL = """CASE seq % 11
  WHEN 0 THEN '   ' WHEN 1 THEN '{"content": "' || seq
  WHEN 2 THEN '{"content":"  ","label_id":' || label_id || '}' WHEN 3 THEN '{"content":"a' || seq || '"}'
  WHEN 4 THEN '{"content":"b' || seq || '","label_id":"x"}' WHEN 5 THEN '{"content":"c' || seq || '","label_id":99}'
  WHEN 6 THEN '{"content":"https://a.example/' || seq || '","label_id":1}'
  WHEN 7 THEN '{"content":"d' || seq || ' https://a.example/x  y","label_id":"' || label_id || '"}'
  WHEN 8 THEN '{"content":5,"label_id":1}' ELSE ' {"content":" e  ' || seq || '","label_id":' || label_id || '} ' END"""
LINES = dict(
    lines=f"SELECT seq, label_id AS true_id, {LINE_SQL} AS value FROM labeled",
    parsed=f"""SELECT seq, CASE seq % 11 WHEN 0 THEN 'blank' WHEN 1 THEN 'bad_json' WHEN 2 THEN 'no_content' WHEN 3 THEN 'no_label'
        WHEN 4 THEN 'bad_label' WHEN 5 THEN 'out_of_range' WHEN 6 THEN 'no_content' WHEN 8 THEN 'no_content' ELSE 'kept' END AS skip_reason,
        CASE WHEN seq % 11 IN (7, 9, 10) THEN true_id END AS label_id,
        CASE WHEN seq % 11 IN (7, 9, 10) THEN {Q.collapse(Q.clean("json_extract_string(value, '$.content')"))} END AS norm FROM lines""",
)


def training_lines(spark, sf_dir):
    lines = V.labeled(spark, sf_dir).select("seq", F.expr(LINE_SQL).alias("value"))
    return export.training_rows(lines, 47)


@query("training_rows_with_reasons", W("labeled", **LINES) + "SELECT seq, skip_reason, label_id, norm FROM parsed")
def training_rows_with_reasons(spark, sf_dir):
    rows = training_lines(spark, sf_dir)
    kept = F.col("skip_reason").isNull()
    return rows.select(
        "seq",
        F.coalesce("skip_reason", F.lit("kept")).alias("skip_reason"),
        F.when(kept, F.col("label_id")).cast("int").alias("label_id"),
        F.when(kept, F.col("norm")).alias("norm"),
    )


@query(
    "skip_reason_counts", W("labeled", **LINES) + "SELECT skip_reason, count(*) AS count FROM parsed GROUP BY skip_reason"
)
def skip_reason_counts(spark, sf_dir):
    return progress.skip_reason_counts(training_lines(spark, sf_dir))


SUBSET = dict(
    picked="""SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY seq) AS rank FROM gold WHERE label_id BETWEEN 0 AND 2
      QUALIFY rank <= 30""",
    subset=f"SELECT substr({Q.strip('content')}, 1, 512) AS content, label_id, rank, seq FROM picked ORDER BY rank, label_id LIMIT 50",
)


@query("coverage_subset", W("gold", **SUBSET) + "SELECT content, label_id, rank, seq FROM subset")
def coverage_subset(spark, sf_dir):
    return sampling.coverage_subset(V.gold(spark, sf_dir), 3, per_label=30, max_total=50).withColumn(
        "rank", F.col("rank").cast("long")
    )


TINY = dict(
    picked="""SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY seq) AS rank FROM gold WHERE label_id BETWEEN 0 AND 3
      QUALIFY rank <= 2""",
    subset="SELECT * FROM picked ORDER BY rank, label_id LIMIT 3",
)


@query(
    "uncovered_labels",
    W("gold", **TINY) + """SELECT DISTINCT label_id FROM gold WHERE label_id BETWEEN 0 AND 3
      AND label_id NOT IN (SELECT label_id FROM subset)""",
)
def uncovered_labels(spark, sf_dir):
    rows = V.gold(spark, sf_dir)
    return training.uncovered_labels(rows, sampling.coverage_subset(rows, 4, max_total=3), 4)


@query(
    "subset_meta",
    W("gold", **TINY) + """SELECT count(DISTINCT label_id) FILTER (label_id BETWEEN 0 AND 3) AS labels_in_dataset,
      count(*) FILTER (label_id NOT BETWEEN 0 AND 3) AS skipped_out_of_range, (SELECT count(*) FROM subset) AS count,
      (SELECT count(DISTINCT label_id) FROM subset) AS labels_covered,
      count(DISTINCT label_id) - (SELECT count(DISTINCT label_id) FROM subset) AS labels_not_in_subset,
      4 AS num_labels, 2 AS per_label, 3 AS max_total, 512 AS max_chars FROM gold""",
)
def subset_meta(spark, sf_dir):
    return training.subset_meta(V.gold(spark, sf_dir), 4, max_total=3)


@query("subset_label_counts", W("gold", **TINY) + "SELECT label_id, count(*) AS count FROM subset GROUP BY ALL")
def subset_label_counts(spark, sf_dir):
    return training.subset_label_counts(sampling.coverage_subset(V.gold(spark, sf_dir), 4, max_total=3))


@query(
    "stratified_split",
    W("labeled") + """SELECT event_id, label_id, CASE WHEN n >= 2 AND rn <= least(greatest(CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT), 1), n - 1)
        THEN 'val' ELSE 'train' END AS split
      FROM (SELECT *, count(*) OVER (PARTITION BY label_id) AS n,
        row_number() OVER (PARTITION BY label_id ORDER BY md5('7:' || seq)) AS rn FROM labeled)""",
)
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(V.labeled(spark, sf_dir), 0.15, 7).select("event_id", "label_id", "split")


# --- backfill -----------------------------------------------------------------------------------
NEEDS = dict(
    needs="SELECT label_id, label, count AS have, greatest(0, 120 - count) AS need FROM counts WHERE count < 120"
)
CANDIDATES = dict(
    cand=f"""SELECT label, label_id, need, round, pos - 1 AS pos, content, row_number() OVER (ORDER BY need DESC, label_id, round, pos) AS seq
      FROM (SELECT label, label_id, need, round, row_number() OVER (PARTITION BY event_id ORDER BY nth) AS pos, post AS content
        FROM (SELECT g.label, g.label_id, n.need, g.round, g.event_id, generate_subscripts(string_split(content, '.'), 1) AS nth,
          {Q.strip("unnest(string_split(content, '.'))")} AS post FROM generated g JOIN needs n USING (label) WHERE NOT broken)
        WHERE post <> '') WHERE round <= 12""",
    seen=f"SELECT DISTINCT {Q.chash('content')} AS content_hash FROM chats WHERE role = 'system'",
    gated=Q.gate("cand"),
    basic=f"""SELECT *, {Q.norm_clean('clean')} AS form, CASE WHEN {Q.u16('content')} < 5 THEN 'too_short'
      WHEN {Q.u16('content')} > 200 THEN 'too_long' ELSE exclude_reason END AS base FROM gated""",
    filtered="""SELECT *, sha256(form) AS content_hash, CASE WHEN base IS NOT NULL THEN base
        WHEN row_number() OVER (PARTITION BY form, base IS NULL ORDER BY seq) > 1
          OR sha256(form) IN (SELECT content_hash FROM seen) THEN 'duplicate' END AS reason FROM basic""",
    verified=f"""SELECT *, reason IS NULL AND {Q.hexval('md5(content)', 1)} % 3 <> 0 AS good FROM filtered""",
    placed="""SELECT *, coalesce(sum(CAST(good AS INT)) OVER (PARTITION BY label ORDER BY round, pos
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        coalesce(sum(CAST(good AS INT)) OVER (PARTITION BY label ORDER BY round
          RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM verified""",
    filled="""SELECT *, CASE WHEN start >= need THEN 'unused' WHEN reason IS NOT NULL THEN 'filter_rejected'
      WHEN before >= need THEN 'unused' WHEN good THEN 'taken' ELSE 'verify_rejected' END AS outcome FROM placed""",
)
FILL_VIEWS = ("labeled", "dim", "generated")


def candidates(spark, sf_dir):
    needs = progress.label_deficits(progress.label_counts_full(V.labeled(spark, sf_dir), V.dim(spark)), 120)
    parsed = V.generated(spark, sf_dir).withColumn("answer", A.parse_json_text(F.col("answer_text")))
    return backfill.candidates_from_answers(parsed.join(needs.select("label", "need"), "label"))


def known_posts(spark, sf_dir):
    return V.chats(spark, sf_dir).filter(F.col("role") == "system")


def filled(spark, sf_dir):
    vote = F.conv(F.substring(F.md5("content"), 1, 1), 16, 10).cast("int") % 3 != 0
    return backfill.fill_quotas(candidates(spark, sf_dir), known_posts(spark, sf_dir), vote)


@query(
    "candidate_filter",
    W(*FILL_VIEWS, **COUNTS, **NEEDS, **CANDIDATES)
    + "SELECT label, round, pos, content_hash, coalesce(reason, '') AS reason FROM filtered",
)
def candidate_filter(spark, sf_dir):
    ordered = backfill.with_processing_order(candidates(spark, sf_dir).filter("round <= 12"))
    seen = T.content_hash(F.col("content")).alias("content_hash")
    checked = synthesis.candidate_filter(ordered, known_posts(spark, sf_dir).select(seen))
    return checked.select(
        "label", "round", F.col("pos").cast("long").alias("pos"), "content_hash",
        F.coalesce("reason", F.lit("")).alias("reason"),
    )


@query(
    "quota_fill",
    W(*FILL_VIEWS, **COUNTS, **NEEDS, **CANDIDATES) + "SELECT label, round, pos, content_hash, outcome FROM filled",
)
def quota_fill(spark, sf_dir):
    return filled(spark, sf_dir).select(
        "label", "round", F.col("pos").cast("long").alias("pos"), "content_hash", "outcome"
    )


@query(
    "synthesis_report",
    W(*FILL_VIEWS, **COUNTS, **NEEDS, **CANDIDATES) + """SELECT n.label_id, n.label, have AS have_before,
      count(*) FILTER (outcome = 'taken') AS generated, count(*) FILTER (outcome = 'verify_rejected') AS verified_rejected,
      count(*) FILTER (outcome = 'filter_rejected') AS filter_rejected, have + count(*) FILTER (outcome = 'taken') AS have_after
      FROM needs n LEFT JOIN filled f ON f.label = n.label GROUP BY n.label_id, n.label, have""",
)
def synthesis_report(spark, sf_dir):
    needs = progress.label_deficits(progress.label_counts_full(V.labeled(spark, sf_dir), V.dim(spark)), 120)
    return synthesis.synthesis_report(filled(spark, sf_dir), needs)


@query(
    "synthesis_totals",
    W(*FILL_VIEWS, **COUNTS, **NEEDS, **CANDIDATES) + """SELECT (SELECT count(*) FROM needs WHERE need > 0) AS deficit_labels,
      count(*) FILTER (outcome = 'taken') AS generated, count(*) FILTER (outcome = 'verify_rejected') AS verified_rejected,
      count(*) FILTER (outcome = 'filter_rejected') AS filter_rejected,
      count(*) FILTER (outcome = 'taken') + (SELECT count(*) FROM labeled) AS synthetic_total FROM filled""",
)
def synthesis_totals(spark, sf_dir):
    labeled = V.labeled(spark, sf_dir)
    needs = progress.label_deficits(progress.label_counts_full(labeled, V.dim(spark)), 120)
    return synthesis.synthesis_totals(filled(spark, sf_dir), needs, labeled)


@query(
    "make_synthetic",
    W(*FILL_VIEWS, **COUNTS, **NEEDS, **CANDIDATES) + f"""SELECT 'syn-' || {Q.chash('content')} AS event_id, 'synthetic' AS pubkey,
      1750000000 AS created_at, content, label, label_id, 0.9::DOUBLE AS confidence, '逆生成（synthetic）' AS rationale,
      false AS is_uncertain, 1 AS pass, 'synthetic:stub' AS source, true AS synthetic, good AS verified
      FROM filled WHERE outcome = 'taken'""",
)
def make_synthetic(spark, sf_dir):
    return backfill.generated_records(filled(spark, sf_dir), "stub", 1750000000)


@query(
    "seen_hash_anti",
    W("chats") + f"""SELECT event_id, {Q.chash('content')} AS content_hash FROM chats WHERE {Q.chash('content')} NOT IN
      (SELECT {Q.chash('content')} FROM chats WHERE role = 'system')""",
)
def seen_hash_anti(spark, sf_dir):
    return synthesis.seen_hash_anti(V.chats(spark, sf_dir), known_posts(spark, sf_dir)).select("event_id", "content_hash")


@query(
    "verify_roundtrip",
    W("labeled", "attempts") + """SELECT l.event_id, l.label FROM labeled l JOIN attempts a
      ON l.event_id = a.event_id AND a.ord % 10 = 0 AND a.ok AND a.label = l.label""",
)
def verify_roundtrip(spark, sf_dir):
    verdicts = V.attempts(spark, sf_dir).filter((F.col("ord") % 10 == 0) & F.col("ok"))
    return synthesis.verify_roundtrip(V.labeled(spark, sf_dir), verdicts).select("event_id", "label")


@query(
    "parse_generated",
    W("generated") + f"""SELECT event_id, broken AS failed, CASE WHEN broken THEN '' ELSE
        coalesce((SELECT string_agg(p, '|' ORDER BY i) FROM (SELECT {Q.strip('x')} AS p, i FROM
          (SELECT unnest(string_split(content, '.')) AS x, generate_subscripts(string_split(content, '.'), 1) AS i)) WHERE p <> ''), '') END AS posts
      FROM generated""",
)
def parse_generated(spark, sf_dir):
    parsed = V.generated(spark, sf_dir).withColumn("answer", A.parse_json_text(F.col("answer_text")))
    return A.with_generated_posts(parsed).select(
        "event_id", F.coalesce(F.col("error") == "invalid_posts", F.lit(False)).alias("failed"),
        F.array_join("posts", "|").alias("posts"),
    )



@query(
    "generation_rounds",
    W("labeled", "dim", **COUNTS, **NEEDS, made=stubs.SQL_GENERATED,
      judged=f"SELECT *, {Q.hexval('md5(content)', 1)} % 3 <> 0 AS good FROM made",
      rounds="""SELECT n.label, n.label_id, n.have, n.need, r.round, coalesce(sum(CAST(good AS INT)), 0) AS good
        FROM needs n CROSS JOIN (SELECT unnest(range(1, 5)) AS round) r LEFT JOIN judged j ON j.label = n.label AND j.round = r.round GROUP BY ALL""",
      started="""SELECT *, coalesce(sum(good) OVER (PARTITION BY label ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM rounds""",
      run="SELECT * FROM started WHERE need > 0 AND before < need",
      examined="""SELECT j.label, good FROM (SELECT j.*, coalesce(sum(CAST(good AS INT)) OVER (PARTITION BY label ORDER BY round, pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS found FROM judged j) j WHERE found < need""")
    + """SELECT r.label, count(*) AS calls, count(*) FILTER ((round + label_id) % 7 = 0) AS failed_calls,
        least(any_value(need), CAST(sum(good) AS BIGINT)) AS generated,
        (SELECT count(*) FROM examined e WHERE e.label = r.label AND NOT e.good) AS verified_rejected,
        count(*) FILTER ((round + label_id) % 7 <> 0) AS filter_rejected FROM run r GROUP BY r.label""",
)
def generation_rounds(spark, sf_dir):
    """Labels below 120 rows are filled by a stub generator and a stub verifier; the run is broken off once and resumed."""
    labeled, dim, root = V.labeled(spark, sf_dir), V.dim(spark), scratch_path(spark, "generation")
    needs = progress.label_deficits(progress.label_counts_full(labeled, dim), 120)
    part = generation.GenerationRun(stubs.generate, "stub", root, stubs.verify_generated, max_rounds=1)
    part.run(needs, labeled, known_posts(spark, sf_dir), dim)
    whole = generation.GenerationRun(stubs.generate, "stub", root, stubs.verify_generated, max_rounds=4)
    done = whole.run(needs, labeled, known_posts(spark, sf_dir), dim)
    report = whole.report(done, needs).select("label", "generated", "verified_rejected", "filter_rejected")
    return whole.calls(spark).join(report, "label")
