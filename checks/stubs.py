"""Deterministic stand-ins for a labeling model and an inference backend.

Their answers follow from the md5 of the text, so SQL can predict them.
"""

from __future__ import annotations

import hashlib
import json

from checks import sql as Q
from checks.views import ALL_LABELS, sql_label_at
from postloom.functions.prompts import POST_TITLE
from postloom.operators.labeling import Reply

N_LOGITS = 32
KANA16 = "あいうえおかきくけこさしすせそた"
HEX16 = str.maketrans("0123456789abcdef", KANA16)


def _digest(prompt: str) -> str:
    return hashlib.md5(prompt.split(POST_TITLE + "\n", 1)[1].encode()).hexdigest()


def _answer(idx: int, confidence: float, uncertain: bool) -> str:
    label = ALL_LABELS[idx]
    return json.dumps(
        {"label": label, "label_id": idx, "confidence": confidence, "rationale": "stub", "is_uncertain": uncertain},
        ensure_ascii=False,
    )


def label_once(prompt: str, attempt: int) -> Reply:
    """Some texts fail in transport, some are never valid, some become valid on a second try."""
    h = _digest(prompt)
    if h[2] == "0":
        return Reply(error="http_400", attempts=((0, 400, ""),))
    bad = h[4] == "0" or (h[3] in "01" and attempt == 0)
    text = '{"label": "zzz"}' if bad else _answer(int(h[:2], 16) % 47, round(int(h[5:7], 16) / 255, 4), h[7] == "f")
    return Reply(text=text, attempts=((0, 200, text),))


def refine_once(prompt: str, attempt: int) -> Reply:
    """Second pass: a confident answer unless the text fails in transport."""
    h = _digest(prompt)
    if h[8] == "0":
        return Reply(error="http_500", attempts=((0, 500, ""),))
    text = _answer(int(h[9:11], 16) % 47, 0.875, False)
    return Reply(text=text, attempts=((0, 200, text),))


def sql_outcome(source: str, keep: str) -> str:
    """SELECT of first-pass outcomes over a relation with ``content``."""
    return f"""SELECT {keep}, ok,
        CASE WHEN ok THEN {sql_label_at("idx")} END AS label, CASE WHEN ok THEN idx END AS label_id,
        CASE WHEN ok THEN round({Q.hexval('h', 6, 2)} / 255.0::DOUBLE, 4) END AS confidence,
        CASE WHEN ok THEN substr(h, 8, 1) = 'f' END AS is_uncertain,
        CASE WHEN ok THEN NULL WHEN substr(h, 3, 1) = '0' THEN 'http_400' ELSE 'validation_failed' END AS reason
      FROM (SELECT *, substr(h, 3, 1) <> '0' AND substr(h, 5, 1) <> '0' AS ok, {Q.hexval('h', 1, 2)} % 47 AS idx
            FROM (SELECT *, md5(content) AS h FROM {source}))"""


def make_backend():
    """Backend of 32 logits per text, half the value of each md5 digit."""

    def infer(texts: list[str]) -> list[list[float]]:
        return [[int(c, 16) / 2 for c in hashlib.md5(x.encode()).hexdigest()] for x in texts]

    return infer


def sql_prediction(source: str, text: str) -> str:
    """SELECT adding ``idx`` (first largest logit) and ``prob`` to a relation."""
    return f"""SELECT * EXCLUDE (logits, weights), list_position(logits, list_max(logits)) - 1 AS idx,
        1.0 / list_sum(weights) AS prob
      FROM (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS weights
            FROM (SELECT *, list_transform(range(1, {N_LOGITS + 1}),
                    lambda i: (instr('{Q.HEX}', substr(md5({text}), i, 1)) - 1) / 2.0::DOUBLE) AS logits FROM {source}))"""


def generate(prompt: str, label: str, round_number: int) -> Reply:
    """Five posts of a label and round: kana of a digest behind the label, the last one too short; every seventh round fails."""
    if (round_number + ALL_LABELS.index(label)) % 7 == 0:
        return Reply(error="http_503")
    digests = (hashlib.md5(f"{label}:{round_number}:{k}".encode()).hexdigest() for k in range(5))
    posts = [(label + d[:12].translate(HEX16) + "です") if k < 4 else "x" for k, d in enumerate(digests)]
    return Reply(text=json.dumps({"posts": posts}, ensure_ascii=False))


def verify_generated(prompt: str, attempt: int) -> Reply:
    """The label that the post begins with, or another one for a third of the digests."""
    post = prompt.split(POST_TITLE + "\n", 1)[1]
    idx = ALL_LABELS.index(post[0])
    if int(_digest(prompt)[0], 16) % 3 == 0:
        idx = (idx + 1) % 46
    return Reply(text=_answer(idx, 0.75, False))


SQL_GENERATED = f"""SELECT label, label_id, need, round, pos, label || translate(substr(md5(label || ':' || round || ':' || pos), 1, 12),
    '0123456789abcdef', '{KANA16}') || 'です' AS content FROM needs, (SELECT unnest(range(1, 5)) AS round), (SELECT unnest(range(0, 4)) AS pos)
  WHERE (round + label_id) % 7 <> 0"""
