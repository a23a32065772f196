"""URL filter: rules by host and path, and boosted trees on lexical features for what no rule decides."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.rows import hash_sample
from postloom.session import materialize

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The trees learn from about this many labelled URLs at most, those of the smallest hashes of their features.
TRAIN_ROWS = 20_000
TREES, DEPTH = 12, 4
# Weight of the overall share in the share of a suffix.
PRIOR_ROWS = 20.0

FEATURES = (
    "f_length", "f_host_length", "f_host_labels", "f_path_length", "f_depth", "f_digit_ratio", "f_host_digits", "f_hyphens",
    "f_entropy", "f_host_entropy", "f_params", "f_query_length", "f_fragment", "f_secure", "f_suffix_share", "f_suffix_rows",
)


@dataclass(frozen=True)
class Rule:
    """Judges a host, its subdomains and every path that starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``host`` (A-Z lower-cased) and ``path``; both empty for a null or one without ``://``."""
    whole = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    pattern = "://([^/?#]*)([^?#]*)"
    return df.withColumns({"host": F.translate(F.regexp_extract(whole, pattern, 1), _UPPER, _LOWER), "path": F.regexp_extract(whole, pattern, 2)})


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``df`` (with ``host`` and ``path``) with ``rule`` and ``rule_verdict``: those of the longest rule that fits, else null.

    Of rules of one length the earlier wins.
    """
    ordered = sorted(rules, key=lambda r: -len(r.name))
    rule = F.coalesce(F.lit(None).cast("string"), *(F.when(r.fits(F.col("host"), F.col("path")), r.name) for r in ordered))
    verdicts = F.coalesce(F.lit(None).cast("string"), *(F.when(F.col("rule") == r.name, r.verdict) for r in ordered))
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdicts)


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters of a text, in bits."""
    size = F.greatest(F.length(text), F.lit(1))
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size)
    return F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda total, p: total - p * F.log2(p))


def features(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` (with ``host`` and ``path``) with the lexical features and ``suffix``, the last label of the host."""
    whole, host, path = F.coalesce(F.col(f"`{url}`"), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(whole, r"\?([^#]*)", 1)
    made = {
        "f_length": F.length(whole),
        "f_host_length": F.length(host),
        "f_host_labels": _count(host, "."),
        "f_path_length": F.length(path),
        "f_depth": _count(path, "/"),
        "f_digit_ratio": _count(whole, "0123456789") / F.greatest(F.length(whole), F.lit(1)),
        "f_host_digits": _count(host, "0123456789"),
        "f_hyphens": _count(host, "-"),
        "f_entropy": F.coalesce(_entropy(whole), F.lit(0.0)),
        "f_host_entropy": F.coalesce(_entropy(host), F.lit(0.0)),
        "f_params": F.when(query != "", _count(query, "&") + 1).otherwise(0),
        "f_query_length": F.length(query),
        "f_fragment": F.contains(whole, F.lit("#")).cast("int"),
        "f_secure": F.startswith(whole, F.lit("https")).cast("int"),
        "suffix": F.substring_index(host, ".", -1),
    }
    return df.withColumns({k: c.cast("double") if k != "suffix" else c for k, c in made.items()})


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Per row: the columns ``keep``, ``host``, ``path``, ``rule``, ``verdict`` and ``block_score`` (0 to 1).

    A rule's verdict stands. Other rows get that of boosted trees, which learn from the rows that rules
    decide: suffix statistics count all of them, the trees fit about ``TRAIN_ROWS`` at most. Without labelled rows the
    verdict is ``allow``; with labelled rows of one kind only, that kind. Repeated rows are judged alike.
    """
    rows = apply_rules(split_url(pages.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, url]))), url), rules)
    rows = features(rows, url).withColumn("label", F.when(F.col("rule_verdict") == BLOCK, 1.0).when(F.col("rule_verdict") == ALLOW, 0.0))
    rows = materialize(rows, "url-features")
    labelled = rows.filter(F.col("label").isNotNull())
    n, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    names = [c for c in dict.fromkeys(keep)]
    out = [*(F.col(f"`{c}`") for c in names), F.col("host"), F.col("path"), F.col("rule")]
    if blocked in (0, n):
        constant = F.lit(1.0 if n and blocked == n else 0.0)
        return rows.select(*out, F.coalesce("rule_verdict", F.when(constant > 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"), constant.alias("block_score"))
    share = blocked / n
    suffixes = labelled.groupBy("suffix").agg(
        ((F.sum("label") + PRIOR_ROWS * share) / (F.count("*") + PRIOR_ROWS)).alias("f_suffix_share"), F.log1p(F.count("*").cast("double")).alias("f_suffix_rows")
    )
    suffixes = materialize(suffixes, "url-suffixes")
    known = rows.join(suffixes, "suffix", "left").na.fill({"f_suffix_share": share, "f_suffix_rows": 0.0})
    known = VectorAssembler(inputCols=list(FEATURES), outputCol="f_all").transform(known)
    sample = hash_sample(known.filter(F.col("label").isNotNull()), n, TRAIN_ROWS, *FEATURES).select("f_all", "label")
    sample = materialize(sample, "url-sample")
    kinds = sample.select("label").distinct().count()
    if kinds < 2:
        constant = F.lit(round(share))
        return rows.select(*out, F.coalesce("rule_verdict", F.when(constant > 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"), constant.cast("double").alias("block_score"))
    trees = GBTClassifier(featuresCol="f_all", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7)
    trees = trees.setPredictionCol("f_prediction").setProbabilityCol("f_chance").setRawPredictionCol("f_raw")
    scored = trees.fit(sample).transform(known)
    score = vector_to_array("f_chance")[1]
    return scored.select(*out, F.coalesce("rule_verdict", F.when(score > 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"), score.alias("block_score"))
