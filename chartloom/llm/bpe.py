"""Encoding of whole texts with a byte-level BPE, by a deterministic tokenization automaton.

Compilation takes the merges in order and adds one gadget each. The gadget of merge
(u, v) -> w removes the arc v from the state reached by u, adds the arc w wherever u could
be read, and gives the state reached by w the arcs that v's state had at that time. States
are therefore named by the token last read, and whether the finished automaton has the arc
(x, y) follows from the gadgets that made x and y: undo the younger one and look at the arc
it was copied from, unless a merge has removed that arc in the meantime. Arcs are worked out
when first needed and kept in a table, so the 50,000 gadgets never become a dense matrix.

A pre-split word is encoded by one pass over its bytes: every prefix has exactly one path in
the automaton, so the pass carries one state per position and reads tokens off a byte trie.
The path's arc labels are the ids; decoding emits the bytes of the labels.

Defined results for odd input: a null or empty text gives an empty list; unpaired surrogates
cannot occur in Spark strings; strings of special tokens are ordinary text; repeated rows
each keep their row; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER_FILE = "byte_bpe_50k.json"
# Fixed value: the published pre-split pattern of the tokenizer.
PRE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_TABLE = 400_000  # words whose ids a worker keeps; the table starts again beyond that


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own}
    rest = [b for b in range(256) if b not in set(own)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    """Deterministic automaton over token ids compiled from ordered merges."""

    def __init__(self, definition: bytes) -> None:
        model = json.loads(definition)["model"]
        letters = _byte_letters()
        spelled = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        self.bytes_of = {model["vocab"][t]: b for t, b in spelled.items()}
        size = max(model["vocab"].values()) + 1
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        self.merge: dict[tuple[int, int], int] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self._gadget(rank, model["vocab"][a], model["vocab"][b], model["vocab"][a + b])
        self.table: dict[tuple[int, int], bool] = {}
        reached = [False] * size
        for i, b in self.bytes_of.items():
            reached[i] = len(b) == 1
        for i in sorted(range(size), key=lambda i: self.born[i]):
            if self.born[i] >= 0:
                reached[i] = reached[self.left[i]] and reached[self.right[i]] and self._arc(self.left[i], self.right[i], self.born[i])
        self.step: dict[int, int] = {}
        self.label: list[int] = [-1]
        for i, b in self.bytes_of.items():
            if reached[i]:
                self._spell(b, i)
        self.words: dict[str, list[int]] = {}

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        self.merge[u, v] = rank
        if self.born[w] < 0:
            self.left[w], self.right[w], self.born[w] = u, v, rank

    def _spell(self, b: bytes, token: int) -> None:
        node = 0
        for x in b:
            node_next = self.step.get(node << 8 | x)
            if node_next is None:
                node_next = self.step[node << 8 | x] = len(self.label)
                self.label.append(-1)
            node = node_next
        self.label[node] = token

    def _arc(self, x: int, y: int, before: int) -> bool:
        """Whether y can follow x once the merges of rank under ``before`` are in."""
        born, left, right, merge = self.born, self.left, self.right, self.merge
        while True:
            removed = merge.get((x, y))
            if removed is not None and removed < before:
                return False
            bx, by = born[x], born[y]
            if bx < 0 and by < 0:
                return True
            if bx > by:
                x, before = right[x], bx
            else:
                y, before = left[y], by + 1

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        state, back = [-1] * (n + 1), [-1] * (n + 1)
        step, label, table = self.step, self.label, self.table
        top = 1 << 60
        for i in range(n):
            last, node = state[i], 0
            if i and last < 0:
                continue
            for j in range(i, n):
                node = step.get(node << 8 | word[j])
                if node is None:
                    break
                token = label[node]
                if token >= 0 and state[j + 1] < 0:
                    if i:
                        ok = table.get((last, token))
                        if ok is None:
                            ok = table[last, token] = self._arc(last, token, top)
                    else:
                        ok = True
                    if ok:
                        state[j + 1], back[j + 1] = token, i
        ids, at = [], n
        while at > 0:
            ids.append(state[at])
            at = back[at]
        return ids[::-1]

    def encode(self, text: str, split) -> list[int]:
        words, out = self.words, []
        for w in split(text):
            ids = words.get(w)
            if ids is None:
                ids = self.encode_word(w.encode("utf-8"))
                if len(words) >= WORD_TABLE:
                    words.clear()
                if len(w) <= 64:
                    words[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", errors="replace")


_compiled: dict[int, TokenAutomaton] = {}


def automaton(definition: bytes) -> TokenAutomaton:
    """The automaton of a vocabulary file, compiled once per worker."""
    key = hash(definition)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = TokenAutomaton(definition)
    return _compiled[key]


def splitter():
    import regex

    return regex.compile(PRE_SPLIT).findall


def _definition(directory: str, file: str) -> bytes:
    with open(os.path.join(directory, file), "rb") as f:
        return f.read()


def encode_texts(documents: DataFrame, directory: str = TOKENIZER_DIR, file: str = TOKENIZER_FILE) -> DataFrame:
    """(doc_id, ids) of every row of ``documents``. One narrow pass; the vocabulary is broadcast."""
    shared = documents.sparkSession.sparkContext.broadcast(_definition(directory, file))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for batch in batches:
            own = automaton(shared.value)
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                each = [own.encode(t, split) if t else [] for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
                flat = np.fromiter((i for x in each for i in x), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema=kind)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(encode, "doc_id bigint, ids array<int>")


def count_tokens(documents: DataFrame, columns: list[str], directory: str = TOKENIZER_DIR, file: str = TOKENIZER_FILE) -> DataFrame:
    """``columns`` of every row with n_tokens, the length of its text in tokens (0 for null)."""
    shared = documents.sparkSession.sparkContext.broadcast(_definition(directory, file))

    @F.pandas_udf("int")
    def n_tokens(texts):
        import pandas as pd

        split = splitter()
        own = automaton(shared.value)
        return pd.Series([len(own.encode(t, split)) if t else 0 for t in texts], dtype="int32")

    return documents.select(*columns, n_tokens("text").alias("n_tokens"))
