"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import bpe, conversations, decontaminate, jaccard, katz, language, licenses, quality, secret_scan, toxicity, urls, whitening, word_bpe
from postloom.llm.rows import fold, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The rules of the query.
URL_RULES = (
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out"))
    model = toxicity.learn(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", "held_out", F.col("toxic_score").alias("score"), (F.col("toxic_score") >= toxicity.PREDICT_AT).cast("int").alias("predicted")
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold("doc_id", 4) == 2).alias("held_out"))
    profiles = language.learn_profiles(docs.filter(~F.col("held_out") & F.col("lang").isNotNull()))
    judged = language.identify(docs.select("doc_id", "text", "held_out"), profiles)
    return judged.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def _joined(labels) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    places, spans = F.col("license_places"), F.col("license_spans")
    return found.select(
        "doc_id",
        F.col("license_words").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places["first_word"]).alias("first_word"),
        F.array_max(places["first_word"]).alias("last_word"),
        _joined(places["label"]).alias("base_labels"),
        _joined(F.concat(places["label"], spans["label"])).alias("labels"),
        F.coalesce(F.array_max(F.concat(spans["covered"], F.when(F.size(places) > 0, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")))), F.lit(0.0)).alias("score"),
    )


def op6_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 7) == 2).alias("held_out"))
    model = katz.train(docs.filter(~F.col("held_out")))
    return katz.score(docs, model).select(
        "doc_id",
        "held_out",
        F.col("lm_tokens").alias("n_tokens"),
        F.col("lm_known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("lm_base").alias("base_score"),
        F.col("lm_score").alias("score"),
    )


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *(F.col(f"q_{c}").alias(c) for c in counts), F.col("q_char_distance").alias("char_distance"), F.col("q_word_distance").alias("word_distance"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))

    def listed(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans["kind"], lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, secret_scan.BASE_KINDS)
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = word_bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def damaged(conversations_table: DataFrame) -> DataFrame:
    """The turns with the faults of the query, chosen by a checksum of id and turn; dropped ones have ``present`` false."""

    def or_blank(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(or_blank("conv_id"), F.lit(":"), or_blank("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(or_blank("text"), "[.!?]", "")).otherwise(or_blank("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1)))
    shaped = conversations_table.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(or_blank("role")).alias("role"), text.alias("text"), (fault != 0).alias("present"), copies)
    return shaped.select("conv_id", "turn", "role", "text", "present")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit(damaged(table(spark, sf_dir, "conversations")), present="present")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    return found.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_url_filter, op3_toxicity, op4_language_id, op5_license_scan, op6_katz_scores, op7_ngram_jaccard, op8_byte_bpe, op9_quality_rules, op10_secret_scan, op11_word_bpe, op12_conversation_repair, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {}
