"""Training export: normalize records, merge, order and summarize; training-row reader rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import answers as A
from postloom.functions import text as T
from postloom.operators.keyed import last_per_key, side_by_side
from postloom.session import materialize

TRAINING_COLUMNS = (
    "content", "label", "label_id", "source_type", "event_id", "source_model", "source",
    "source_file", "source_record_index", "created_at", "pubkey", "confidence", "rationale",
    "is_uncertain", "pass", "verified", "synthetic",
)
RECORD_FIELDS = (
    "content", "label", "event_id", "source", "created_at", "pubkey", "confidence", "rationale",
    "is_uncertain", "pass", "verified", "synthetic",
)
SYNTHETIC_PREFIX = "synthetic:"


def source_model(source: Column, fallback: Column) -> Column:
    """Model of a record: the part after ``synthetic:``, else the trimmed source, else the fallback."""
    trimmed, spare = T.strip_spaces(source), T.strip_spaces(fallback)
    spare = F.when(spare != "", spare)
    after_prefix = F.substr(source, F.lit(len(SYNTHETIC_PREFIX) + 1))
    raw_fallback = F.when(fallback != "", fallback)
    return F.coalesce(
        F.when(
            F.startswith(source, F.lit(SYNTHETIC_PREFIX)),
            F.coalesce(F.when(after_prefix != "", after_prefix), raw_fallback, F.lit("unknown")),
        ),
        F.when(trimmed != "", trimmed),
        spare,
        F.lit("unknown"),
    )


def source_name(source: Column, source_type: Column, fallback: Column) -> Column:
    """Trimmed source, or one built from the model for records without a source."""
    trimmed = T.strip_spaces(source)
    model = source_model(source, fallback)
    built = F.when(source_type == "synthetic", F.concat(F.lit(SYNTHETIC_PREFIX), model)).otherwise(model)
    return F.coalesce(F.when(trimmed != "", trimmed), built)


def fallback_event_id(source_type: Column, label: Column, content: Column) -> Column:
    """Deterministic id for records without one."""
    return F.concat(
        source_type, F.lit("-missing-"), T.content_hash(F.concat(label, F.lit("\n"), content))
    )


def synthetic_event_id(content: Column) -> Column:
    return F.concat(F.lit("syn-"), T.content_hash(content))


def merge_sources(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Ordered union of source records: real before synthetic, each in its own record order.

    Inputs carry ``record`` (VARIANT), ``source_file``, ``file_rank``, ``source_record_index``,
    ``fallback_model`` and, where one side has several files, ``record_order``.
    """
    parts = [
        df.withColumns({"source_type": F.lit(kind), "source_rank": F.lit(rank)})
        for rank, (kind, df) in enumerate((("real", real), ("synthetic", synthetic)))
        if df is not None
    ]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def normalize_records(records: DataFrame, dim: DataFrame) -> DataFrame:
    """The 17 training columns plus ``skip_reason``, ``missing_event_id`` and the merge order.

    ``skip_reason`` is the first failing check of invalid_record, missing_content and
    invalid_label; the label id always comes from the dimension. Labels are trimmed but not
    folded here.
    """
    v = F.col("record")

    def text(name: str) -> Column:
        return A.string_field(v, f"$.{name}", F.col(f"_k_{name}"))

    def number(name: str) -> Column:
        return A.coerce_number(v, f"$.{name}", F.col(f"_k_{name}"))

    def flag(name: str) -> Column:
        return A.true_field(v, f"$.{name}", F.col(f"_k_{name}"))

    def trimmed(name: str) -> Column:
        return T.strip_spaces(F.coalesce(text(name), F.lit("")))

    kinds = A.with_kinds(records, "record", RECORD_FIELDS).withColumnRenamed("_k_", "_kind")
    fields = A.drop_kinds(
        kinds.withColumns(
            {name: text(name) for name in ("pubkey", "rationale")}
            | {name: number(name) for name in ("created_at", "confidence", "pass")}
            | {name: flag(name) for name in ("is_uncertain", "verified")}
            | {
                "content": trimmed("content"),
                "label": trimmed("label"),
                "_id": trimmed("event_id"),
                "_source": text("source"),
                "synthetic": flag("synthetic") | (F.col("source_type") == "synthetic"),
            }
        )
    )
    known = fields.join(dim.select("label", "label_id"), "label", "left")
    fallback = F.col("fallback_model")
    return known.withColumns(
        {
            "skip_reason": F.when(
                ~F.coalesce(F.col("_kind").isin("object", "array"), F.lit(False)), F.lit("invalid_record")
            )
            .when(F.col("content") == "", F.lit("missing_content"))
            .when(F.col("label_id").isNull(), F.lit("invalid_label")),
            "missing_event_id": F.col("_id") == "",
            "event_id": F.when(
                F.col("_id") == "",
                fallback_event_id(F.col("source_type"), F.col("label"), F.col("content")),
            ).otherwise(F.col("_id")),
            "source_model": source_model(F.col("_source"), fallback),
            "source": source_name(F.col("_source"), F.col("source_type"), fallback),
        }
    ).select(
        *TRAINING_COLUMNS,
        "skip_reason",
        "missing_event_id",
        F.struct(
            "source_rank", "file_rank", *(c for c in ("record_order",) if c in records.columns), "source_record_index"
        ).alias("merge_order"),
    )


def merge_training(normalized: DataFrame) -> DataFrame:
    """Valid rows with the last record per event id in merge order."""
    valid = normalized.filter(F.col("skip_reason").isNull())
    return last_per_key(valid, ["event_id"], "merge_order").select(*TRAINING_COLUMNS)


def export_order(rows: DataFrame, collation: str | None = None) -> DataFrame:
    """Oldest first, rows without a time last, then by event id.

    Ids compare binary by default; pass a collation such as ``UNICODE`` for locale order.
    """
    by_id = F.collate("event_id", collation) if collation else F.col("event_id")
    return rows.orderBy(F.col("created_at").asc_nulls_last(), by_id)


def training_summary(normalized: DataFrame) -> DataFrame:
    """One row of totals over normalized records.

    The few columns that both halves count are written once, so records are normalized once.
    """
    narrow = ("source_type", "skip_reason", "missing_event_id", "event_id", "merge_order")
    normalized = materialize(normalized.select(*narrow), "summary-rows")
    valid = F.col("skip_reason").isNull()
    inputs = normalized.agg(
        F.count_if(F.col("source_type") == "real").alias("input_real"),
        F.count_if(F.col("source_type") == "synthetic").alias("input_synthetic"),
        F.count_if(F.col("skip_reason") == "invalid_record").alias("skipped_invalid_record"),
        F.count_if(F.col("skip_reason") == "missing_content").alias("skipped_missing_content"),
        F.count_if(F.col("skip_reason") == "invalid_label").alias("skipped_invalid_label"),
        F.count_if(valid & F.col("missing_event_id")).alias("missing_event_ids_assigned"),
        F.count_if(valid).alias("_valid"),
    )
    merged = last_per_key(normalized.filter(valid), ["event_id"], "merge_order").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.col("source_type") == "real").alias("real_count"),
        F.count_if(F.col("source_type") == "synthetic").alias("synthetic_count"),
    )
    return (
        side_by_side(inputs, merged)
        .withColumn("duplicate_event_ids_overwritten", F.col("_valid") - F.col("total_count"))
        .drop("_valid")
    )


def training_label_counts(rows: DataFrame) -> DataFrame:
    """Real, synthetic and total rows per label, by label id."""
    return (
        rows.groupBy("label_id", "label")
        .agg(
            F.count_if(F.col("source_type") == "real").alias("real"),
            F.count_if(F.col("source_type") == "synthetic").alias("synthetic"),
            F.count(F.lit(1)).alias("total"),
        )
        .orderBy("label_id")
    )


def training_rows(lines: DataFrame, num_labels: int, line: str = "value") -> DataFrame:
    """Parse training lines: classifier text, label id and the first applicable skip reason.

    Reasons in order: blank, bad_json, no_content, no_label, bad_label, out_of_range, and
    no_content again when the normalized text is empty. Fractional ids are truncated, numeric
    text is accepted only as a whole number.
    """
    text = T.strip_spaces(F.col(line))
    parsed = lines.withColumns({"_text": text, "_v": A.parse_json_text(text)})
    v = F.col("_v")
    parsed = parsed.withColumns(
        {
            "_content": A.string_field(v, "$.content"),
            "_kind": A.kind_of(v, "$.label_id"),
            "_number": F.try_variant_get(v, "$.label_id", "double"),
            "_digits": T.strip_spaces(F.try_variant_get(v, "$.label_id", "string")),
        }
    )
    whole = F.rlike("_digits", F.lit("^[+-]?[0-9]+$"))
    number_id = F.when(F.col("_number") < 0, F.ceil("_number")).otherwise(F.floor("_number"))
    label_id = (
        F.when(F.col("_kind").isin("integer", "number"), number_id.cast("long"))
        .when((F.col("_kind") == "string") & whole, F.col("_digits").try_cast("bigint"))
        .when(F.col("_kind") == "boolean", F.try_variant_get(v, "$.label_id", "boolean").cast("bigint"))
    )
    staged = parsed.withColumns(
        {"label_id": label_id, "norm": T.normalize_for_classifier(F.col("_content"))}
    )
    reason = (
        F.when(F.col("_text") == "", F.lit("blank"))
        .when(F.col("_v").isNull(), F.lit("bad_json"))
        .when(T.is_blank(F.col("_content")), F.lit("no_content"))
        .when(F.col("_kind").isin("missing", "null"), F.lit("no_label"))
        .when(F.col("label_id").isNull(), F.lit("bad_label"))
        .when(~F.col("label_id").between(0, int(num_labels) - 1), F.lit("out_of_range"))
        .when(F.col("norm") == "", F.lit("no_content"))
    )
    return staged.withColumn("skip_reason", reason).drop("_text", "_v", "_content", "_kind", "_number", "_digits")


def read_training_rows(spark: SparkSession, path: str, num_labels: int) -> DataFrame:
    """:func:`training_rows` of the line-delimited files at ``path``; skipped lines keep their reason."""
    return training_rows(spark.read.text(path), num_labels)
