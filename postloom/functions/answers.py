"""Model answers as VARIANT columns: parse, validate, generated posts, numeric coercion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import text as T
from postloom.operators.labels import QA_LABEL_ID, is_valid_label, label_id_of

# --- fixed values: number spelling, required answer fields in order -------------------------
NUMBER_TEXT = rf"^[{T.SPACE}]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[{T.SPACE}]*$"
ANSWER_FIELDS = ("label", "label_id", "confidence", "rationale", "is_uncertain")
# -------------------------------------------------------------------------------------------


def parse_json_text(col: Column) -> Column:
    """VARIANT of a JSON text, null when the text is no JSON."""
    return F.try_parse_json(col)


def join_parts(parts: Column) -> Column:
    """Concatenate the text parts of a response; missing parts count as empty."""
    return F.array_join(parts, "", "")


def _kind(name: Column, value: Column) -> Column:
    """Kind from a VARIANT schema name and the value as a double."""
    return (
        F.when(name.isNull(), F.lit("missing"))
        .when(name == "VOID", F.lit("null"))
        .when(name == "STRING", F.lit("string"))
        .when(name == "BOOLEAN", F.lit("boolean"))
        .when(name == "BIGINT", F.lit("integer"))
        .when(F.startswith(name, F.lit("ARRAY")), F.lit("array"))
        .when(F.startswith(name, F.lit("OBJECT")), F.lit("object"))
        .when(value == F.floor(value), F.lit("integer"))
        .otherwise(F.lit("number"))
    )


def kind_of(variant: Column, path: str) -> Column:
    """JSON kind at ``path``: number, integer, string, boolean, array, object, null or missing."""
    name = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    return _kind(name, F.try_variant_get(variant, path, "double"))


def with_kinds(df: DataFrame, variant: str, fields: Sequence[str]) -> DataFrame:
    """Add ``_k_<field>`` per top-level field and ``_k_`` for the value itself.

    Staged in two projections, so each field is looked up once however often its kind is used.
    """
    v = F.col(variant)
    paths = {f: f"$.{f}" for f in fields} | {"": "$"}
    staged = df.withColumns(
        {f"_n_{f}": F.schema_of_variant(F.try_variant_get(v, p, "variant")) for f, p in paths.items()}
    )
    kinds = {f"_k_{f}": _kind(F.col(f"_n_{f}"), F.try_variant_get(v, p, "double")) for f, p in paths.items()}
    return staged.withColumns(kinds).drop(*[f"_n_{f}" for f in paths])


def drop_kinds(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_k_")])


def coerce_number(variant: Column, path: str, kind: Column | None = None) -> Column:
    """Finite number at ``path`` as the dynamic source language reads it, else null.

    A JSON null reads as 0 and so do false and blank strings, true reads as 1, numeric strings
    are parsed; a missing field, other strings and objects give null.
    """
    kind = kind_of(variant, path) if kind is None else kind
    raw = F.try_variant_get(variant, path, "string")
    parsed = F.when(F.rlike(raw, F.lit(NUMBER_TEXT)), T.strip_spaces(raw).try_cast("double")).when(
        T.is_blank(raw), F.lit(0.0)
    )
    value = (
        F.when(kind.isin("integer", "number"), F.try_variant_get(variant, path, "double"))
        .when(kind == "null", F.lit(0.0))
        .when(kind == "boolean", F.try_variant_get(variant, path, "boolean").cast("double"))
        .when(kind == "string", parsed)
    )
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def string_field(variant: Column, path: str, kind: Column | None = None) -> Column:
    """The string at ``path``; null for any other kind."""
    kind = kind_of(variant, path) if kind is None else kind
    return F.when(kind == "string", F.try_variant_get(variant, path, "string"))


def true_field(variant: Column, path: str, kind: Column | None = None) -> Column:
    """True only for a literal JSON ``true``."""
    kind = kind_of(variant, path) if kind is None else kind
    return F.coalesce((kind == "boolean") & F.try_variant_get(variant, path, "boolean"), F.lit(False))


def with_answer_errors(df: DataFrame, answer: str = "answer", allow_qa: bool = True) -> DataFrame:
    """Add ``errors`` (stable codes, empty when valid) for a VARIANT model answer.

    Shape errors come first, field by field, then the label check and, for a known label, the
    check that a numeric id agrees with it. The five field kinds are staged once.
    """
    v = F.col(answer)
    staged = with_kinds(df, answer, ANSWER_FIELDS).withColumns(
        {
            "_label": F.try_variant_get(v, "$.label", "string"),
            "_id": F.try_variant_get(v, "$.label_id", "double"),
            "_conf": F.try_variant_get(v, "$.confidence", "double"),
        }
    )

    def k(field: str) -> Column:
        return F.col(f"_k_{field}")

    wrong_kind = {
        "label": k("label") != "string",
        "label_id": k("label_id") != "integer",
        "confidence": ~k("confidence").isin("integer", "number"),
        "rationale": k("rationale") != "string",
        "is_uncertain": k("is_uncertain") != "boolean",
    }
    numeric_id = k("label_id").isin("integer", "number")
    in_bounds = {
        "label_id": F.when(numeric_id, F.col("_id").between(0, QA_LABEL_ID)),
        "confidence": F.when(k("confidence").isin("integer", "number"), F.col("_conf").between(0, 1)),
    }
    checks = [F.when(k(f) == "missing", F.lit(f"missing:{f}")) for f in ANSWER_FIELDS]
    for f in ANSWER_FIELDS:
        checks.append(F.when((k(f) != "missing") & wrong_kind[f], F.lit(f"type:{f}")))
        if f in in_bounds:
            checks.append(F.when(~in_bounds[f], F.lit(f"range:{f}")))
    label_text = F.when(k("label").isin("missing", "null"), F.lit("")).otherwise(F.col("_label"))
    allowed = F.coalesce(is_valid_label(label_text, allow_qa), F.lit(False))
    checks.append(F.when(~allowed, F.lit("label_not_allowed")))
    checks.append(
        F.when(
            allowed & numeric_id & (F.col("_id") != label_id_of(label_text)), F.lit("label_id_mismatch")
        )
    )
    errors = F.when(
        ~F.coalesce(F.col("_k_").isin("object", "array"), F.lit(False)), F.array(F.lit("not_an_object"))
    ).otherwise(F.array_compact(F.array(*checks)))
    return drop_kinds(staged.withColumn("errors", errors)).drop("_label", "_id", "_conf")


def with_generated_posts(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Add ``posts`` (trimmed non-blank strings) and ``error`` (invalid_posts or empty_posts)."""
    v = F.col(answer)
    listed = F.coalesce(kind_of(v, "$.posts") == "array", F.lit(False))
    entries = F.try_variant_get(v, "$.posts", "array<variant>")
    texts = F.transform(
        F.filter(entries, lambda e: F.schema_of_variant(e) == "STRING"),
        lambda e: T.strip_spaces(F.try_variant_get(e, "$", "string")),
    )
    staged = df.withColumns(
        {
            "_listed": listed,
            "posts": F.when(listed, F.filter(texts, lambda s: s != "")).otherwise(
                F.array().cast("array<string>")
            ),
        }
    )
    return staged.withColumn(
        "error",
        F.when(~F.col("_listed"), F.lit("invalid_posts")).when(F.size("posts") == 0, F.lit("empty_posts")),
    ).drop("_listed")


def valid_answers(df: DataFrame, answer: str = "answer", allow_qa: bool = True) -> DataFrame:
    """Rows whose answer has no error.

    The condition is a generator rather than a filter: a filter would be pushed below the staged
    projections and repeat every lookup in them for each place that uses it.
    """
    checked = with_answer_errors(df, answer, allow_qa)
    passed = F.when(F.size("errors") == 0, F.array(F.lit(True)))
    return checked.withColumn("_valid", F.explode(passed)).drop("_valid", "errors")
