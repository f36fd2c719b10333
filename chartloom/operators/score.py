"""Scores of answers against references: token overlap and longest common subsequence."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.text import alnum_tokens, token_f1

_VOWELS = "aeiou"


class _Stem:
    """Porter's suffix stripping (1980), written from the published rules."""

    def _cons(self, w: str, i: int) -> bool:
        if w[i] in _VOWELS:
            return False
        return w[i] != "y" or i == 0 or not self._cons(w, i - 1)

    def _measure(self, w: str) -> int:
        kinds = "".join("c" if self._cons(w, i) else "v" for i in range(len(w)))
        return len(re.findall("v+c+", kinds))

    def _vowel(self, w: str) -> bool:
        return any(not self._cons(w, i) for i in range(len(w)))

    def _double(self, w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and self._cons(w, len(w) - 1)

    def _cvc(self, w: str) -> bool:
        return len(w) > 2 and self._cons(w, len(w) - 3) and not self._cons(w, len(w) - 2) and self._cons(w, len(w) - 1) and w[-1] not in "wxy"

    def _swap(self, w: str, table: list[tuple[str, str]], least: int) -> str:
        for end, new in table:
            if w.endswith(end):
                stem = w[: len(w) - len(end)]
                return stem + new if self._measure(stem) > least else w
        return w

    def __call__(self, w: str) -> str:
        if len(w) <= 2:
            return w
        if w.endswith("sses"):
            w = w[:-2]
        elif w.endswith("ies"):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        cut = None
        if w.endswith("eed"):
            w = w[:-1] if self._measure(w[:-3]) > 0 else w
        elif w.endswith("ed") and self._vowel(w[:-2]):
            cut = w[:-2]
        elif w.endswith("ing") and self._vowel(w[:-3]):
            cut = w[:-3]
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif self._double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif self._measure(w) == 1 and self._cvc(w):
                w += "e"
        if w.endswith("y") and self._vowel(w[:-1]):
            w = w[:-1] + "i"
        w = self._swap(w, [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")], 0)
        w = self._swap(w, [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")], 0)
        for end in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"):
            if w.endswith(end):
                stem = w[: -len(end)]
                if self._measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                    w = stem
                break
        if w.endswith("e"):
            m = self._measure(w[:-1])
            if m > 1 or (m == 1 and not self._cvc(w[:-1])):
                w = w[:-1]
        if w.endswith("ll") and self._measure(w) > 1:
            w = w[:-1]
        return w


stem = _Stem()


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one number (Hyyrö 2004)."""
    where: dict[str, int] = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def rouge_l(predicted: str | None, gold: str | None) -> tuple[float, float, float]:
    """Precision, recall and F of the common subsequence of stemmed tokens."""
    p, g = ([stem(t) if len(t) > 3 else t for t in re.findall("[a-z0-9]+", (x or "").lower())] for x in (predicted, gold))
    if not p or not g:
        return 0.0, 0.0, 0.0
    n = lcs(g, p)
    precision, recall = n / len(p), n / len(g)
    return precision, recall, 2 * precision * recall / (precision + recall) if n else 0.0


def rouge_l_column(predicted: Column, gold: Column) -> Column:
    @F.pandas_udf("rouge_l_precision double, rouge_l_recall double, rouge_l_f1 double")
    def score(p: pd.Series, g: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rouge_l(a, b) for a, b in zip(p, g)], columns=["rouge_l_precision", "rouge_l_recall", "rouge_l_f1"])

    return score(predicted, gold)


def score_answers(rows: DataFrame, predicted: str, gold: str) -> DataFrame:
    """``rows`` with the six answer scores; two empty answers agree fully on tokens."""
    rows = rows.withColumns({"_pt": alnum_tokens(F.coalesce(F.col(predicted), F.lit(""))), "_gt": alnum_tokens(F.coalesce(F.col(gold), F.lit("")))})
    p, r, f = token_f1(F.col("_pt"), F.col("_gt"), 1.0)
    return rows.withColumns({"token_precision": p, "token_recall": r, "token_f1": f}).drop("_pt", "_gt").withColumn("_r", rouge_l_column(F.col(predicted), F.col(gold))).select("*", "_r.*").drop("_r")
