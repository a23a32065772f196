"""Prompt columns. The fixed texts are constants; only the post text varies per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions import text as T
from postloom.operators.labels import label_list_text

# --- fixed values: prompt texts ------------------------------------------------------------
TASK_HEADER = "次のNostr投稿に対して、頭の中を最もよく表す1文字ラベルを1つだけ選んでください。"
LABEL_LIST_TITLE = "ラベル一覧:"
JUDGE_RULES = """判断ルール:
- まず内容の中心感情/欲求/関心を1つに要約する
- 食べ物そのものは 食、疲れている/休みたいは 休 or 疲、学び/技術理解は 学、不可解さは 謎
- 特定の既存ラベルに無理に寄せにくければ 分類不能 を使う
- 出力はJSONのみ。説明文やコードブロックは禁止"""
ANSWER_SCHEMA = """JSON schema:
{
  "label": "ラベル文字",
  "label_id": 0,
  "confidence": 0.0,
  "rationale": "日本語1-2文",
  "is_uncertain": false
}"""
POST_TITLE = "投稿本文:"
REFINE_HEADER = """これは低信頼または不確実と判定されたNostr投稿の再検討です。
1回目の推定ラベルは「{label}」でした。
もう一度内容を慎重に読み、別のラベルがより適切でないかを検討してください。
最有力候補を2〜3個挙げて比較したうえで、最終的に最も適切な1文字ラベルを1つだけ確定してください。"""
SYNTHESIS_HEADER = """あなたは日本語のSNS（Nostr）投稿を書く生成器です。
次の「頭の中ラベル」が支配的な心理状態として明確に読み取れる、リアルで多様な短い投稿を{count}件書いてください。

対象ラベル: {label} = {definition}

文体・制約:
- 1〜120文字程度の日本語。SNSの独り言・つぶやき口調（カジュアル、口語、絵文字や顔文字は控えめなら可）
- ハッシュタグの乱用は禁止。ユーザー名・URL・宣伝文は入れない
- 話題・言い回し・長さをばらけさせる（同じパターンの繰り返し禁止）

重要: 以下の全ラベル一覧のうち、書いた投稿が対象ラベル以外のラベルにより自然に分類されてはいけません。
対象ラベルが最も支配的に読み取れる文面にしてください。
"""
EXAMPLES_TITLE = "文体の参考（実際の投稿。コピーや改変流用は禁止。雰囲気・口調だけ参考にする）:"
SYNTHESIS_FOOTER = """出力は次のJSONのみ。説明文やコードブロックは禁止:
{"posts": ["投稿1", "投稿2", ...]}"""
# -------------------------------------------------------------------------------------------


def _fill(template: str, **values: Column) -> Column:
    """A constant template with ``{name}`` slots taken from columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def _label_task() -> str:
    return "\n".join([LABEL_LIST_TITLE, label_list_text(), "", JUDGE_RULES, "", ANSWER_SCHEMA, "", POST_TITLE])


def labeling_prompt(content: Column) -> Column:
    """First-pass prompt for a post."""
    head = "\n".join([TASK_HEADER, "", _label_task(), ""])
    return F.concat(F.lit(head), F.coalesce(content, F.lit("")))


def refinement_prompt(content: Column, first_label: Column) -> Column:
    """Second-pass prompt that names the first guess."""
    return F.concat(
        _fill(REFINE_HEADER, label=first_label),
        F.lit("\n\n" + _label_task() + "\n"),
        F.coalesce(content, F.lit("")),
    )


def synthesis_prompt(label: Column, definition: Column, count: Column | int, examples: Column) -> Column:
    """Prompt that asks for ``count`` posts of one label, with optional style examples."""
    n = F.lit(count) if isinstance(count, int) else count
    lines = F.transform(
        F.coalesce(examples, F.array().cast("array<string>")),
        lambda e: F.concat(F.lit("- "), T.collapse_spaces(e)),
    )
    block = F.when(
        F.size(lines) > 0,
        F.concat(F.lit("\n\n" + EXAMPLES_TITLE + "\n"), F.array_join(lines, "\n")),
    ).otherwise(F.lit(""))
    return F.concat(
        _fill(SYNTHESIS_HEADER, count=n.cast("string"), label=label, definition=definition),
        F.lit("\n" + LABEL_LIST_TITLE + "\n" + label_list_text()),
        block,
        F.lit("\n\n" + SYNTHESIS_FOOTER),
    )
