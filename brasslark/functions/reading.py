"""Numbers in prose, with every sensible reading of a token.

A text is read once from left to right as a run of marks (numbers, dashes, words of loss and gain, brackets, ends of
clauses). A number's sign comes from the marks before it, and from a bracketed loss that may still follow.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StructType

#: Scale words after a number (longer ones first) that a check of answers knows, and those that a grader knows, which
#: also takes words without accents and short forms; money units, percent signs, and words that give a sign.
SCALES = (
    ("nghìn tỷ", 1e12), ("ngàn tỷ", 1e12), ("nghìn tỉ", 1e12), ("ngàn tỉ", 1e12), ("trillion", 1e12), ("tỷ", 1e9), ("tỉ", 1e9), ("billion", 1e9), ("triệu", 1e6), ("million", 1e6),
)
GRADED_SCALES = (
    ("nghìn tỷ", 1e12), ("ngàn tỷ", 1e12), ("nghin ty", 1e12), ("ngan ty", 1e12), ("trillion", 1e12), ("tỷ", 1e9), ("tỉ", 1e9), ("ty", 1e9), ("ti", 1e9), ("billion", 1e9), ("bn", 1e9),
    ("triệu", 1e6), ("trieu", 1e6), ("million", 1e6), ("mn", 1e6), ("nghìn", 1e3), ("ngàn", 1e3), ("nghin", 1e3), ("ngan", 1e3), ("thousand", 1e3),
)
MONEY = ("đồng", "vnd", "usd", "dollar", "cent", "nghìn đồng", "ngàn đồng")
PERCENT = ("%", "phần trăm", "percent")
LOSS = ("lỗ", "âm", "tổn thất", "loss", "losses", "negative", "deficit")
GAIN = ("lãi", "dương", "profit", "gain")
BRACKETED = ("lỗ", "âm", "loss")
#: How many signs a word of loss or gain reaches forward, and a bracketed loss back.
REACH, BACK = 40, 16

READING = StructType().add("token", "string").add("at", "integer").add("value", "double").add("negative", "boolean").add("percent", "boolean").add("money", "boolean").add("sentence", "integer")


def _any(words) -> str:
    return "|".join(map(re.escape, words))


_MARKS = re.compile(
    rf"(?P<number>\d(?:[\d.,]*\d)?)|(?P<dash>[-−–])|(?P<bracket>\((?:\s*(?:{_any(BRACKETED)})\b)?)|(?P<close>\))|(?P<end>\n|\.\s|;|\|)|(?P<loss>\b(?:{_any(LOSS)})\b)|(?P<gain>\b(?:{_any(GAIN)})\b)", re.I
)
_SCALE = re.compile(rf"\s*({_any(w for w, _ in SCALES)})", re.I)
#: A graded scale word is a whole word, and may follow the bracket of a negative number.
_GRADED_SCALE = re.compile(rf"\)?\s*({_any(sorted((w for w, _ in GRADED_SCALES), key=len, reverse=True))})(?!\w)", re.I)
_MONEY = re.compile(rf"\s*(?:{_any(MONEY)}|đ\b)", re.I)
_PERCENT = re.compile(rf"\s*(?:{_any(PERCENT)}|pct\b)", re.I)
_FACTOR = dict(GRADED_SCALES + SCALES)


def readings(token: str) -> list[float]:
    """The digits as a whole number, and with what follows the last point or comma as decimals."""
    groups = [g for g in re.split("[.,]", token) if g]
    if not groups:
        return []
    found = {float("".join(groups))}
    if len(groups) > 1:
        found.add(float(f"{''.join(groups[:-1])}.{groups[-1]}"))
    return sorted(found)


def numbers_of(text: str | None, graded: bool = False) -> list[dict]:
    """One entry a reading of each number in the text, in order.

    A number is negative after a dash that is no range, before a bracketed loss, or if the last word of loss or gain in
    its clause is one of loss. graded: with the scale words of a grader.
    """
    text, scales = text or "", _GRADED_SCALE if graded else _SCALE
    found: list[dict] = []
    said, heard = False, -REACH - 1  # whether the last word was of loss, and where it began
    dash, last = -2, -2  # ends of the last dash that can be a minus, and of the last number
    sentence = 0
    for m in _MARKS.finditer(text):
        kind, at, end = m.lastgroup, m.start(), m.end()
        if kind == "number":
            scale = scales.match(text, end)
            negative = at - dash in (0, 1) and text[dash:at].strip() == "" or said and at - heard <= REACH
            found.append({
                "token": m[0], "at": at, "end": end, "factor": _FACTOR[scale[1].lower()] if scale else 1.0, "negative": negative,
                "percent": bool(_PERCENT.match(text, end)), "money": bool(_MONEY.match(text, end)), "sentence": sentence,
            })
            last = end
        elif kind == "dash":
            dash = -2 if text[last:at].strip() == "" and at - last <= 1 and last >= 0 else end
        elif kind == "bracket" and len(m[0]) > 1:
            for n in reversed(found):
                between = text[n["end"] : at]
                if len(between) > BACK or "\n" in between or ")" in between or "(" in between:
                    break
                n["negative"] = True
            said, heard = True, end - len(m[0].lstrip("( \t\n"))
        elif kind in ("loss", "gain"):
            said, heard = kind == "loss", at
        elif kind == "end":
            said, sentence = False, sentence + 1
    keep = ("token", "at", "negative", "percent", "money", "sentence")
    return [{k: n[k] for k in keep} | {"value": v * n["factor"]} for n in found for v in readings(n["token"])]


@pandas_udf(ArrayType(READING))
def numbers_in(text: pd.Series) -> pd.Series:
    return pd.Series([numbers_of(t) for t in text])


@pandas_udf(ArrayType(READING))
def graded_numbers_in(text: pd.Series) -> pd.Series:
    return pd.Series([numbers_of(t, graded=True) for t in text])
