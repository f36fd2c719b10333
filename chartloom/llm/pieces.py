"""Oversized records cut into pieces at natural boundaries, by dynamic programming.

A cut costs by what it cuts: nothing at a section end, a little at a paragraph or day end,
more at a sentence end, most inside a sentence; uneven pieces cost the square of their
distance from the even size. The programme runs over the boundary positions of one record
and finds the cheapest chain of cuts whose pieces, overlap included, stay within the limit.
Consecutive pieces share exactly the overlap. Cuts lie further apart than the overlap, so
that only neighbours share text; where the limit leaves no room for that (an overlap of
about half of it or more) they only have to move on.

Defined results for odd input: an overlap that isn't smaller than the limit is an error; null or small fields give no piece rows (``all_records`` cuts
nothing for them); null entries of an events array are left out before counting; a text
without any boundary is cut at words, failing that anywhere; repeated records are cut each
under their own record_id; an empty table gives empty tables; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_LIMIT, TEXT_OVERLAP = 6000, 300
EVENT_LIMIT, EVENT_OVERLAP = 150, 10
EVENNESS = 0.5
SECTION, PARAGRAPH, SENTENCE, WORD, HARD = 0.0, 0.15, 0.6, 2.0, 5.0
DAY, HOUR = 0.0, 1.0

_HEADING = re.compile(r"(?:\r\n|\r|\n)(?=[ \t]*(?:[A-Z][^\r\n:.]{2,60}:|[A-Z][A-Z /&-]{3,60})[ \t]*(?:\r\n|\r|\n))")
_PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)+")
_LINE = re.compile(r"\r\n|\r|\n")
_SENTENCE = re.compile(r"[.!?…]+[\"')\]]*\s+")
_WORD = re.compile(r"\s+")

_PIECES = "array<struct<piece_no:int,start:int,stop:int,boundary:string>>"
_NAMES = {SECTION: "section", PARAGRAPH: "paragraph", SENTENCE: "sentence", WORD: "word", HARD: "anywhere"}


def text_boundaries(text: str, step: int = TEXT_LIMIT - TEXT_OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which a cut may fall, and what each cut costs; the cheapest kind wins a tie.

    No two positions are further apart than ``step``, what a piece adds to the one before it.
    """
    cost: dict[int, float] = {}
    for pattern, price in ((_HEADING, SECTION), (_PARAGRAPH, PARAGRAPH), (_LINE, SENTENCE), (_SENTENCE, SENTENCE)):
        for m in pattern.finditer(text):
            cost[m.end()] = min(price, cost.get(m.end(), HARD))
    n = len(text)
    long, apart = max(1, min(400, step // 4)), max(1, min(200, step // 8))
    known = np.array(sorted({0, n, *cost}))
    for a, b in zip(known[:-1], known[1:]):
        if b - a > long:  # long stretches get word ends, and if need be plain positions
            words = [int(a) + m.end() for m in _WORD.finditer(text[a:b])]
            for p in words:
                cost.setdefault(p, WORD)
            stops = [int(a), *words, int(b)]
            for c, e in zip(stops[:-1], stops[1:]):
                if e - c > apart:
                    for p in range(c + apart, e, apart):
                        cost.setdefault(p, HARD)
    at = np.array(sorted(p for p in cost if 0 < p < n), dtype=np.int64)
    return at, np.array([cost[p] for p in at.tolist()], dtype=float)


def _chain(ends: np.ndarray, price: np.ndarray, limit: int, overlap: int, apart: int, even: float) -> list[tuple[int, float]] | None:
    """Cheapest chain of cuts more than ``apart`` from each other, none if there isn't any."""
    step = limit - overlap
    best = np.full(len(ends), np.inf)
    prev = np.full(len(ends), -1)
    first = int(np.searchsorted(ends, overlap + 1, side="left"))
    for k in range(len(ends)):
        e = ends[k]
        if e <= limit:
            best[k] = price[k] + EVENNESS * ((e - even) / even) ** 2
        lo, hi = max(first, int(np.searchsorted(ends, e - step, side="left"))), min(k, int(np.searchsorted(ends, e - apart, side="left")))
        if lo < hi:
            total = best[lo:hi] + price[k] + EVENNESS * ((e - ends[lo:hi] - even) / even) ** 2
            j = int(np.argmin(total))
            if total[j] < best[k]:
                best[k], prev[k] = total[j], lo + j
    if not np.isfinite(best[-1]):
        return None
    chain, k = [], len(ends) - 1
    while k >= 0:
        chain.append((int(ends[k]), float(price[k])))
        k = prev[k]
    return chain[::-1]


def best_cuts(n: int, at: np.ndarray, cost: np.ndarray, limit: int, overlap: int) -> list[tuple[int, float]]:
    """Cheapest chain of cut positions over 0..n; every piece with its overlap is within ``limit``."""
    if not 0 <= overlap < limit:
        raise ValueError(f"an overlap of {overlap} doesn't fit a limit of {limit}")
    if n <= limit:
        return []
    even = n / max(2, -(-(n - overlap) // (limit - overlap)))
    ends, price = np.append(at, n), np.append(cost, 0.0)
    for apart in (overlap, 0):
        chain = _chain(ends, price, limit, overlap, apart, even)
        if chain is not None:
            return chain
    raise ValueError("the boundaries lie too far apart for the limit")


def cut_text(text: str, limit: int = TEXT_LIMIT, overlap: int = TEXT_OVERLAP) -> list[tuple[int, int, int, str]]:
    """(piece_no, start, stop, boundary) of the pieces of ``text``, in code points."""
    if not 0 <= overlap < limit:
        raise ValueError(f"an overlap of {overlap} doesn't fit a limit of {limit}")
    at, cost = text_boundaries(text, limit - overlap)
    cuts = best_cuts(len(text), at, cost, limit, overlap)
    starts = [0, *[c - overlap for c, _ in cuts[:-1]]]
    return [(i, s, c, "end" if c == len(text) else _NAMES[p]) for i, (s, (c, p)) in enumerate(zip(starts, cuts))]


def cut_days(days: list[str | None], limit: int = EVENT_LIMIT, overlap: int = EVENT_OVERLAP) -> list[tuple[int, int, int, str]]:
    n = len(days)
    at = np.arange(1, n)
    cost = np.array([DAY if days[i] != days[i - 1] else HOUR for i in range(1, n)], dtype=float)
    cuts = best_cuts(n, at, cost, limit, overlap)
    starts = [0, *[c - overlap for c, _ in cuts[:-1]]]
    return [(i, s, c, "end" if c == n else "day" if p == DAY else "event") for i, (s, (c, p)) in enumerate(zip(starts, cuts))]


def _rows(pieces: list[tuple[int, int, int, str]]) -> list[dict]:
    return [dict(zip(("piece_no", "start", "stop", "boundary"), p)) for p in pieces]


def text_pieces(c: Column, limit: int, overlap: int) -> Column:
    @F.pandas_udf(_PIECES)
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([_rows(cut_text(t, limit, overlap)) for t in texts])

    return cut(c)


def event_pieces(c: Column, limit: int, overlap: int) -> Column:
    @F.pandas_udf(_PIECES)
    def cut(days: pd.Series) -> pd.Series:
        return pd.Series([_rows(cut_days(list(d), limit, overlap)) for d in days])

    return cut(c)


def oversized_pieces(timelines: DataFrame, text_limit: int = TEXT_LIMIT, text_overlap: int = TEXT_OVERLAP, event_limit: int = EVENT_LIMIT, event_overlap: int = EVENT_OVERLAP, content: bool = True) -> DataFrame:
    """(record_id, oversized_field, piece_no, start, stop, boundary, text, events) of every piece.

    Only oversized fields reach Python, the events as their days; the pieces are cut out on
    the JVM side. No shuffle.
    """
    record = F.col("record_id").cast("bigint").alias("record_id")
    notes = timelines.select(record, F.col("discharge_summary").alias("t")).where(F.char_length("t") > text_limit)
    notes = notes.withColumn("p", F.explode(text_pieces(F.col("t"), text_limit, text_overlap)))
    text = F.expr("substring(t, p.start + 1, p.stop - p.start)") if content else F.lit(None).cast("string")
    notes = notes.select("record_id", F.lit("discharge_summary").alias("oversized_field"), "p.*", text.alias("text"), F.lit(None).cast("int").alias("n_events"))
    kept = timelines.select(record, F.expr("filter(events, e -> e IS NOT NULL)").alias("e")).where(F.size("e") > event_limit)
    days = kept.withColumn("p", F.explode(event_pieces(F.expr("transform(e, x -> substring(x.timestamp, 1, 10))"), event_limit, event_overlap)))
    body = F.expr("to_json(slice(e, p.start + 1, p.stop - p.start))") if content else F.lit(None).cast("string")
    days = days.select("record_id", F.lit("events").alias("oversized_field"), "p.*", body.alias("text"), F.expr("p.stop - p.start").alias("n_events"))
    return notes.unionByName(days)


def oversized_records(timelines: DataFrame) -> DataFrame:
    """(record_id, oversized_field) of every record the cutting found more than one piece for."""
    return oversized_pieces(timelines, content=False).where("piece_no = 0 AND boundary <> 'end'").select("record_id", "oversized_field").distinct()
