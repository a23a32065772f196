"""The label dimension and its lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from postloom.functions import text as T

# --- fixed values: label set, version and definitions (position is the id) ------------------
LABEL_SET_VERSION = "observed-46-plus-unclassifiable"
LABELS = (
    ("愛", "愛情・親愛・やさしさ・会いたさ"),
    ("欲", "欲望・ほしさ・手に入れたい気持ち"),
    ("悪", "攻撃性・悪意・意地の悪さ"),
    ("遊", "遊び・娯楽・楽しみたい気分"),
    ("H", "性的な関心・下ネタ寄りの欲望"),
    ("秘", "秘密・隠し事・内緒"),
    ("食", "食べること・飲食そのもの"),
    ("友", "友人・仲間・誰かとのつながり"),
    ("悩", "不安・悩み・迷い"),
    ("休", "休息・眠い・休みたい"),
    ("嘘", "ごまかし・虚勢・本音を隠す感じ"),
    ("家", "家・家庭・帰る場所"),
    ("妄", "妄想・誇張・飛躍した想像"),
    ("想", "思い・考え・しみじみした気持ち"),
    ("気", "気分・ノリ・空気感"),
    ("無", "虚無・何もない・どうでもよさ"),
    ("恐", "恐れ・ビビり・怖さ"),
    ("敬", "尊敬・礼儀・うやまい"),
    ("好", "好意・好き・好み"),
    ("逃", "逃げたい・避けたい・離れたい"),
    ("怒", "怒り・いらだち"),
    ("抱", "抱きしめたい・包みたい・密着したい"),
    ("寂", "さみしさ・心細さ"),
    ("楽", "楽さ・気楽さ・ラクしたい"),
    ("嫌", "嫌悪・拒否感・うんざり"),
    ("苦", "苦しさ・しんどさ・つらさ"),
    ("虜", "夢中・とりこ・強く惹かれて離れない"),
    ("疑", "疑い・不信・半信半疑"),
    ("告", "告白・伝達・はっきり言いたい"),
    ("疲", "疲労・消耗"),
    ("忘", "忘れたい・忘れていた・記憶の抜け"),
    ("敵", "敵対・対立・相手を敵とみなす"),
    ("餌", "エサ・釣り・食わせる/食いつく比喩"),
    ("学", "勉強・学び・理解したい"),
    ("泣", "泣きたい・感極まる・しんみり"),
    ("羨", "うらやましさ"),
    ("癒", "癒やし・なごみ"),
    ("幸", "幸福・うれしさ・満たされ感"),
    ("妬", "嫉妬・ねたみ"),
    ("変", "変さ・奇妙さ・クセの強さ"),
    ("貧", "貧しさ・不足・余裕のなさ"),
    ("謎", "意味不明・不可解"),
    ("仏", "慈悲・悟り・落ち着き"),
    ("犬", "犬っぽさ・忠犬・犬への関心"),
    ("猫", "猫っぽさ・猫への関心・気まぐれ"),
    ("国", "国家・社会・公共への意識"),
)
QA_LABEL = "分類不能"
QA_DEFINITION = "上のどれにも素直に当てはまらない、または文脈不足"
# -------------------------------------------------------------------------------------------

QA_LABEL_ID = len(LABELS)
LABEL_CHARS = tuple(char for char, _ in LABELS)

LABEL_SCHEMA = t.StructType(
    [
        t.StructField("label_id", t.IntegerType(), False),
        t.StructField("label", t.StringType(), False),
        t.StructField("definition", t.StringType(), False),
        t.StructField("is_qa", t.BooleanType(), False),
    ]
)


def label_dim(spark: SparkSession, with_qa: bool = True) -> DataFrame:
    """The label dimension ``label_id, label, definition, is_qa`` (47 rows, 46 without QA)."""
    rows = [(i, char, text, False) for i, (char, text) in enumerate(LABELS)]
    if with_qa:
        rows.append((QA_LABEL_ID, QA_LABEL, QA_DEFINITION, True))
    # Built from literals, so Spark knows how small it is and broadcasts it in every lookup.
    entries = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, LABEL_SCHEMA.fields, strict=True)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*entries)))


def label_list_text() -> str:
    """The ``- id: char = definition`` lines of the prompts."""
    entries = [*LABELS, (QA_LABEL, QA_DEFINITION)]
    return "\n".join(f"- {i}: {char} = {text}" for i, (char, text) in enumerate(entries))


def label_id_of(label: Column) -> Column:
    """Id of a label character after normalization, -1 when unknown; a constant map lookup."""
    pairs = [F.lit(x) for i, c in enumerate([*LABEL_CHARS, QA_LABEL]) for x in (c, i)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), T.normalize_label(label)), F.lit(-1))


def is_valid_label(label: Column, allow_qa: bool = False) -> Column:
    found = label_id_of(label)
    return (found >= 0) & ((found < QA_LABEL_ID) | F.lit(bool(allow_qa)))


def label_lookup(rows: DataFrame, dim: DataFrame, label: str = "label") -> DataFrame:
    """Left lookup of the exact label; unknown labels get a null ``label_id``.

    The dimension has one row per label (47 in the built-in set), so Spark broadcasts it by its
    known size; a larger label map falls back to a shuffled join on its own.
    """
    names = dim.select(F.col("label").alias(label), F.col("label_id"))
    return rows.join(names, label, "left")


def label_for_index(predictions: DataFrame, dim: DataFrame, index: str = "index") -> DataFrame:
    """Index to ``id, char, def``; an index outside the map becomes ``?`` with empty definition."""
    names = dim.select(
        F.col("label_id").alias(index), F.col("label").alias("_char"), F.col("definition").alias("_def")
    )
    return (
        predictions.join(names, index, "left")
        .withColumns(
            {
                "id": F.col(index),
                "char": F.coalesce("_char", F.lit("?")),
                "def": F.coalesce("_def", F.lit("")),
            }
        )
        .drop("_char", "_def")
    )


def checked_labels(labels: Sequence[str]) -> list[str]:
    """Normalized label characters; an unknown one raises (QA is not a target label)."""
    out = []
    for label in labels:
        char = label.strip().replace("Ｈ", "H")
        if char not in LABEL_CHARS:
            raise ValueError(f"invalid label: {label}")
        out.append(char)
    return out
