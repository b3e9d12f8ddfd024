"""Deterministic stand-ins for the hosted / local models, as pandas functions.

They apply the lexicon rule to the whole message and answer in the same shapes as the ``replies`` /
``json_replies`` adapters (so SQL can check the parsing jobs), but run inside ``mapInPandas`` like a
real model client would. Nothing but the message is read.
"""

from __future__ import annotations

import json

import pandas as pd

from textlab.plans.adapters import TEST_LEXICON


def _positive(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in TEST_LEXICON)


def two_line_reply_model(pdf: pd.DataFrame) -> pd.Series:
    """Replies in five shapes by the message's length."""
    out = []
    for text in pdf["text"]:
        w = text or ""
        lab = str(int(_positive(w)))
        out.append(["Reads as: " + w + "\n" + lab, "Label " + lab + " because " + w,
                    "Unsure: " + w, "", w + "\n   " + lab + "  "][len(w) % 5])
    return pd.Series(out, index=pdf.index, dtype=object)


def json_reply_model(pdf: pd.DataFrame) -> pd.Series:
    """JSON replies: plain, fenced, fenced after a newline, missing key, broken off."""
    out = []
    for text in pdf["text"]:
        w = text or ""
        body = json.dumps({"DM": w, "Sentiment": "positive" if _positive(w) else "negative"}, ensure_ascii=False)
        short = json.dumps({"DM": w}, ensure_ascii=False)
        out.append([body, "```json\n" + body + "\n```", "\n```json\n" + body + "\n```",
                    short, short[:-1] + ', "Sentiment": '][len(w) % 5])
    return pd.Series(out, index=pdf.index, dtype=object)
