"""The same question in the training split and in an evaluation split.

Questions are brought to a canonical form (see ``questions``); distinct forms of one subject
with the same dates and numbers are compared. Two forms ask the same if at most ``EDITS``
slips of typing lie between them, so every evaluation form is written out as passages - the
form itself, and with the words left out or spelled short that a slip may have changed - such
that any form asking the same contains one of them. The evaluation passages of a key are
sharded, an Aho-Corasick automaton is compiled from every shard, and the training texts, with
the same passages written out, are streamed through it. The intervals matched in a training
text are merged to the words they cover of each evaluation form; forms that are touched at
all are then compared exactly. Rows are joined to matched forms last, so copies of a form are
never compared.

A task holds the passages of one shard of one key: a key with many evaluation forms is split
into shards of ``EVAL_SHARD``, one with many training forms into as many streams of
``TRAIN_SHARD``. Forms with no counterpart in the other split leave before.

Defined results for odd input: a null subject, question or split gives no pair; questions
that are empty or only turns of phrase match only each other's exact form; ties and repeated
rows each give their pair once; an empty table gives an empty table; extra columns are
ignored; very long questions are matched whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.questions import TURNS, content_tokens, number_key, plain_text, word_tokens
from chartloom.session import materialise

EVAL_SHARD = 5_000  # evaluation forms of one subject and number key whose passages make an automaton
TRAIN_SHARD = 200_000  # training forms of one key that are streamed through it in a task
LONG_FORM = 12  # words from which on passages are groups of words
EDITS = 2  # slips of typing over both questions

_SCHEMA = "subject_id bigint, numbers string, eval_form string, train_form string, coverage double"
_ARROW = pa.schema([("subject_id", pa.int64()), ("numbers", pa.string()), ("eval_form", pa.string()), ("train_form", pa.string()), ("coverage", pa.float64())])


def question_forms(pairs: DataFrame) -> DataFrame:
    """(qa_id, subject_id, split, is_train, numbers, form) of rows that can match."""
    tokens = content_tokens(F.col("q"))
    return (
        pairs.where("subject_id IS NOT NULL AND question IS NOT NULL AND lower(split) IN ('train', 'validation', 'test')")
        .select(F.col("qa_id").cast("bigint").alias("qa_id"), F.col("subject_id").cast("bigint").alias("subject_id"), F.lower("split").alias("split"), plain_text(F.col("question")).alias("q"))
        .select("qa_id", "subject_id", "split", tokens.alias("t"))
        .select("qa_id", "subject_id", "split", (F.col("split") == "train").alias("is_train"), number_key(F.col("t")).alias("numbers"), F.array_join(word_tokens(F.col("t")), " ").alias("form"))
    )


def one_slip(a: str, b: str) -> bool:
    """Whether one letter left out, put in, replaced or swapped with its neighbour makes b of a."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == short[i:]


def _short(w: str) -> list[str]:
    """A word with any one letter left out: words a slip apart have one of these, or the word itself, in common."""
    return [w, *dict.fromkeys(w[:i] + w[i + 1 :] for i in range(len(w)))]


_TURNS = sorted({w for w in TURNS if len(w) >= 3})
_NEAR_TURNS: dict[str, list[str]] = {}
for _t in _TURNS:
    for _s in _short(_t):
        _NEAR_TURNS.setdefault(_s, []).append(_t)


def slips_of_turn(w: str) -> bool:
    return len(w) >= 3 and any(one_slip(w, t) for s in _short(w) for t in _NEAR_TURNS.get(s, ()))


def passages(words: list[str], edits: int = EDITS) -> dict[str, int]:
    """Passages of a form, each with the words of the form it covers as a bit mask.

    Words that slip from a turn of phrase may be missing on the other side; of the rest, as
    many may be slips as are left of ``edits``. These are left out where at least two words
    remain; otherwise one of them is spelled short. Two forms that ask the same share a
    passage, because they agree after their slips are taken out. The words of a long form
    fall into more groups than slips can touch, and every group is a passage; lengths differ
    by the slips at most, so forms about as long as ``LONG_FORM`` are written out both ways.
    """
    out: dict[str, int] = {}
    if len(words) > LONG_FORM - edits:
        groups: list[list[int]] = [[] for _ in range(2 * edits + 1)]
        for i, w in enumerate(words):
            groups[zlib.crc32(w.encode()) % len(groups)].append(i)
        for g, own in enumerate(groups):
            out[f"g{g}\x1e" + " ".join(words[i] for i in own)] = sum(1 << i for i in own)
    if len(words) > LONG_FORM:
        return out
    loose = [i for i, w in enumerate(words) if slips_of_turn(w)]
    for gone in range(min(edits, len(loose)) + 1):
        for dropped in combinations(loose, gone):
            base = [i for i in range(len(words)) if i not in dropped]
            k = len(base)
            for slips in range(min(edits - gone, k) + 1):
                spelled = 0 if slips == 0 or k - slips >= 2 else 1
                for left in combinations(base, slips - spelled):
                    kept = [i for i in base if i not in left]
                    mask = sum(1 << i for i in kept)
                    for i in kept if spelled else kept[:1] or [None]:
                        rest = " ".join(words[j] for j in kept if not spelled or j != i)
                        for s in _short(words[i]) if spelled else [""]:
                            out[f"{k} {slips}\x1e{rest}\x1e{s}"] = mask
    return out


def same_question(a: list[str], b: list[str], edits: int = EDITS) -> bool:
    """Exact comparison of two forms: the words they don't share must be slips of each other or of turns."""
    left, right = [w for w in a if w not in b], [w for w in b if w not in a]
    used = 0
    for w in list(left):
        hit = next((x for x in right if min(len(w), len(x)) >= 3 and max(len(w), len(x)) >= 4 and one_slip(w, x)), None)
        if hit is not None:
            left.remove(w)
            right.remove(hit)
            used += 1
    for rest in (left, right):
        for w in list(rest):
            if slips_of_turn(w):
                rest.remove(w)
                used += 1
    return not left and not right and used <= edits


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards one after the other, each with its evaluation forms before its training forms."""
    import ahocorasick

    shard, forms, machine = None, [], None
    postings: dict[str, list[tuple[int, int]]] = {}
    for batch in batches:
        out = []
        for subject, numbers, part, stream, form, role in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if (subject, numbers, part, stream) != shard:
                shard, forms, machine, postings = (subject, numbers, part, stream), [], None, {}
            words = form.split(" ") if form else []
            if role == 0:
                for p, mask in passages(words).items():
                    postings.setdefault(f"\x1f{p}\x1f", []).append((len(forms), mask))
                forms.append((form, words))
                continue
            if machine is None:
                machine = ahocorasick.Automaton()
                for p, found in postings.items():
                    machine.add_word(p, found)
                machine.make_automaton()
            text = "\x1f" + "\x1f\x1f".join(passages(words)) + "\x1f"
            covered: dict[int, int] = {}
            for _, found in machine.iter(text):
                for i, mask in found:
                    covered[i] = covered.get(i, 0) | mask
            for i, mask in covered.items():
                other, own = forms[i]
                if form == other or same_question(own, words):
                    out.append((subject, numbers, other, form, mask.bit_count() / max(1, len(own))))
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(_ARROW.names, map(list, zip(*out)))), schema=_ARROW)


def matched_forms(forms: DataFrame) -> DataFrame:
    """Pairs of an evaluation form and a training form that ask the same."""
    key = ["subject_id", "numbers"]
    distinct = forms.groupBy(*key, "form").agg(F.max("is_train").alias("t"), F.max(~F.col("is_train")).alias("e"))
    counts = distinct.groupBy(*key).agg(F.sum(F.col("e").cast("int")).alias("n_e"), F.sum(F.col("t").cast("int")).alias("n_t")).where("n_t > 0 AND n_e > 0")
    sized = counts.select(*key, F.ceil(F.col("n_e") / EVAL_SHARD).cast("int").alias("parts"), F.ceil(F.col("n_t") / TRAIN_SHARD).cast("int").alias("streams"))
    both = distinct.join(sized, key)
    place = lambda seed, n: F.pmod(F.xxhash64("form", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = both.where("e").select(*key, place(1, "parts").alias("part"), every("streams").alias("stream"), "form", F.lit(0).alias("role"))
    other = both.where("t").select(*key, every("parts").alias("part"), place(2, "streams").alias("stream"), "form", F.lit(1).alias("role"))
    rows = one.unionByName(other).repartition(*key, "part", "stream").sortWithinPartitions(*key, "part", "stream", "role")
    return rows.mapInArrow(_scan, _SCHEMA)


def overlapping_pairs(pairs: DataFrame) -> DataFrame:
    """(qa_a, qa_b, train_id, eval_id, eval_split): every pair of rows over the split that asks the same."""
    forms = materialise(question_forms(pairs), "question-forms")
    matched = matched_forms(forms)
    train = forms.where("is_train").select("subject_id", "numbers", F.col("form").alias("train_form"), F.col("qa_id").alias("train_id"))
    held = forms.where("NOT is_train").select("subject_id", "numbers", F.col("form").alias("eval_form"), F.col("qa_id").alias("eval_id"), F.col("split").alias("eval_split"))
    both = matched.join(held, ["subject_id", "numbers", "eval_form"]).join(train, ["subject_id", "numbers", "train_form"])
    return both.select(F.least("train_id", "eval_id").alias("qa_a"), F.greatest("train_id", "eval_id").alias("qa_b"), "train_id", "eval_id", "eval_split").where("qa_a < qa_b").distinct()


def overlap_report(pairs: DataFrame) -> DataFrame:
    """Per evaluation split and source: rows, rows also asked in train, and pairs."""
    found = overlapping_pairs(pairs).groupBy(F.col("eval_id").alias("qa_id")).agg(F.count(F.lit(1)).alias("n_pairs"))
    rows = pairs.where("lower(split) IN ('validation', 'test')").select(F.col("qa_id").cast("bigint").alias("qa_id"), F.lower("split").alias("split"), "source")
    return (
        rows.join(found, "qa_id", "left").groupBy("split", "source")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("n_pairs").alias("n_overlapping"), F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"))
    )
