"""Token counting and cutting behind prompts: words between blanks, or a public BPE in Arrow batches."""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from chartloom.functions.text import blank_tokens

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER_FILE = "byte_bpe_50k.json"


@dataclass(frozen=True)
class Tokens:
    """How many tokens a text has, and its first n of them as text (the text itself if it has no more).

    ``fit``, where there is one, does a prompt in one pass: of (before, text, after, budget) it
    gives the text cut to what the others leave of the budget, its tokens, and the prompt's.
    """

    name: str
    count: Callable[[Column], Column]
    cut: Callable[[Column, Column], Column]
    fit: Callable[[str, Column, Column, int], Column] | None = None


def _blank_cut(text: Column, n: Column) -> Column:
    return F.when(F.size(blank_tokens(text)) <= n, text).otherwise(F.array_join(F.slice(blank_tokens(text), 1, F.greatest(n, F.lit(0))), " "))


BLANKS = Tokens("blanks", lambda c: F.size(blank_tokens(c)), _blank_cut)

_LOADED: dict = {}
LETTERS = 1 << 22  # letters of the words whose ids a worker keeps, 32 more a word; the table starts again beyond that
SPAN = 1 << 16  # letters of a text that are taken apart at once
# The pre-split never puts a sign and a blank after it into one token, and looks ahead only.
EDGE = re.compile(r"(?<=[!-~])(?=[ \n])")


def _tokenizer(path: str):
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
        _LOADED[path].encode_special_tokens = True  # their strings in a text are ordinary text
    return _LOADED[path]


class _Words(dict):
    """The ids of words, encoded when first met."""

    def __init__(self, path: str) -> None:
        self.path, self.held = path, 0

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(_tokenizer(self.path).encode(word, add_special_tokens=False).ids)
        if len(word) < SPAN:
            if self.held > LETTERS:
                self.clear()
                self.held = 0
            self[word] = ids
            self.held += len(word) + 32
        return ids


_KNOWN: dict[str, _Words] = {}


def _words(path: str, text: str, most: float = float("inf")) -> tuple[list[str], list[int]]:
    """The words of a text and its tokens up to the end of each; of a long one with more than ``most``, the first that show it."""
    known = _KNOWN.get(path) or _KNOWN.setdefault(path, _Words(path))
    words: list[str] = []
    ends = [0]
    at = 0
    while at < len(text) and ends[-1] <= most:
        edge = EDGE.search(text, at + SPAN)
        end = edge.start() if edge else len(text)
        part = EDGE.split(text[at:end])
        words += part
        ends += accumulate(map(len, map(known.__getitem__, part)), initial=ends.pop())
        at = end
    return words, ends


def _count(path: str, text: str) -> int:
    return _words(path, text)[1][-1]


def _first(path: str, words: list[str], ends: list[int], n: int) -> tuple[str, int]:
    """The first n of more tokens as text, and how many that text has itself."""
    k = max(0, bisect_right(ends, n) - 1)
    rest = max(0, n - ends[k])
    part = _tokenizer(path).decode(list(_KNOWN[path][words[k]][:rest])) if rest else ""
    return "".join(words[:k]) + part, ends[k] + _count(path, part)


def bpe(directory: str = TOKENIZER_DIR, file: str = TOKENIZER_FILE) -> Tokens:
    """The tokens of a published byte-level BPE; null texts count 0 and stay null.

    A cut inside a character gives the replacement sign, as decoding such ids does. A worker
    takes one text at a time apart.
    """
    path = os.path.join(directory, file)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([_count(path, t or "") for t in texts])

    @F.pandas_udf("string")
    def cut(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for text, n in zip(texts, sizes):
            words, ends = _words(path, text or "", n)
            out.append(text if text is None or ends[-1] <= n else _first(path, words, ends, int(n))[0])
        return pd.Series(out, dtype=object)

    def fit(before: str, text: Column, after: Column, budget: int) -> Column:
        @F.arrow_udf("context string, context_tokens int, prompt_tokens int")
        def fitted(texts: pa.Array, afters: pa.Array) -> pa.Array:
            contexts, own, whole = [], [], []
            last, words, ends, cuts = None, [], [0], {}  # questions of a record follow each other
            for t, a in zip(texts, afters):
                t, a = t.as_py(), a.as_py()
                if t != last:
                    last, (words, ends), cuts = t, _words(path, t or "", budget), {}
                room = min(ends[-1], max(0, budget - (0 if a is None else _count(path, before + a))))
                if room not in cuts:
                    c, n = (t, room) if room == ends[-1] else _first(path, words, ends, room)
                    start = words[0] if words and (c or "").startswith(words[0]) else c or ""
                    cuts[room] = c, n, n + _count(path, before + start) - _count(path, start)
                c, n, n_head = cuts[room]
                contexts.append(c)
                own.append(n)
                if c is None or a is None:
                    whole.append(0)
                elif EDGE.match((before + c[-1:])[-1:] + a[:1], 1):
                    whole.append(n_head + _count(path, a))
                else:
                    whole.append(_count(path, before + c + a))
            return pa.StructArray.from_arrays([pa.array(contexts, pa.string()), pa.array(own, pa.int32()), pa.array(whole, pa.int32())], ["context", "context_tokens", "prompt_tokens"])

        return fitted(text, after)

    return Tokens("bpe", count, cut, fit)
