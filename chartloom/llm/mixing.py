"""A mixture of sources with target shares of all tokens, by balanced sampling (cube method).

The total is the largest that no source would have to exceed its repeats for. Within a source
every document is used equally often up to a fraction: its whole part is certain, the rest is
an inclusion probability. The flight phase of the cube method moves these probabilities
through the null space of the balancing constraints - the number of documents and of tokens -
until they are 0 or 1; three undecided documents always leave a direction to move in. It runs
in blocks of documents at once, each of which leaves at most two undecided; those are flown
again together, level by level, until a source's last ones fit into one block, where the
landing picks the rounding closest to the token target. No step sees more than a block.

Defined results for odd input: documents without tokens (null, empty) are not used; sources
without target, or null, have share 0; a target whose source has no tokens stays unreached
and is reported so, the shares of the others being kept in proportion; repeated rows count as
documents of their own; equal sizes are fine; empty tables give an empty mixture; extra
columns are ignored.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.llm.bpe import TOKENIZER_DIR, TOKENIZER_FILE, count_tokens
from chartloom.session import materialise

BLOCK = 5000  # documents flown together
EPS = 1e-9
TURNS = 32  # documents by which the landing may leave the count constraint


def flight(probability: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Probabilities after the flight phase: all 0 or 1 but at most two; count and tokens kept."""
    p = list(probability)
    waiting = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    rng.shuffle(waiting)
    active: list[int] = []
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) < 3:
            return p
        a, b, c = (size[i] for i in active)
        u = [b - c, c - a, a - b]
        top = max(map(abs, u))
        u = [1.0, -1.0, 0.0] if top == 0 else [x / top for x in u]
        up, down = math.inf, math.inf
        for i, x in zip(active, u):
            if x > 0:
                up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
            elif x < 0:
                up, down = min(up, p[i] / -x), min(down, (1 - p[i]) / -x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip(active, u):
            p[i] = min(1.0, max(0.0, p[i] + step * x))
        left = [i for i in active if EPS < p[i] < 1 - EPS]
        if len(left) == 3:  # rounding kept all three inside: settle the closest to a bound
            i = min(left, key=lambda j: min(p[j], 1 - p[j]))
            p[i] = float(p[i] > 0.5)
            left.remove(i)
        for i in active:
            if i not in left:
                p[i] = float(p[i] > 0.5)
        active = left


def landing(probability: list[float], size: list[float], goal: float) -> list[float]:
    """The rounding of the last undecided documents whose tokens come closest to the expected.

    The constraint on the number of documents is dropped last: one document more or less is
    taken, again and again, where that brings the tokens closer to ``goal``.
    """
    p = list(probability)
    last = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    want = sum(p[i] * size[i] for i in last)
    best = min(range(2 ** len(last)), key=lambda m: (abs(sum(size[i] for k, i in enumerate(last) if m >> k & 1) - want), m)) if last else 0
    for k, i in enumerate(last):
        p[i] = float(best >> k & 1)
    p = [float(x > 0.5) for x in p]
    off = sum(x * s for x, s in zip(p, size)) - goal
    for _ in range(TURNS):
        turn = min(range(len(p)), key=lambda i: (abs(off + (size[i] if p[i] == 0 else -size[i])), i), default=None)
        after = off if turn is None else off + (size[turn] if p[turn] == 0 else -size[turn])
        if abs(after) >= abs(off):
            break
        p[turn], off = 1.0 - p[turn], after
    return p


def _fly(pdf: pd.DataFrame, land: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "copy"]).reset_index(drop=True)
    rng = random.Random(f"{pdf['source'].iloc[0]}|{pdf['block'].iloc[0]}|{len(pdf)}|{pdf['doc_id'].iloc[0]}")
    size = pdf["n_tokens"].astype(float).tolist()
    p = flight(pdf["p"].tolist(), size, rng)
    if land:
        p = landing(p, size, sum(x * s for x, s in zip(pdf["p"], size)))
    return pdf.assign(p=p)[["doc_id", "copy", "source", "n_tokens", "p"]]


def _fly_only(pdf: pd.DataFrame) -> pd.DataFrame:
    return _fly(pdf, False)


def _fly_and_land(pdf: pd.DataFrame) -> pd.DataFrame:
    return _fly(pdf, True)


_SCHEMA = "doc_id bigint, copy bigint, source string, n_tokens int, p double"


def plan_repeats(documents: DataFrame, targets: DataFrame, directory: str = TOKENIZER_DIR, file: str = TOKENIZER_FILE) -> tuple[DataFrame, DataFrame]:
    """Token sizes of documents with a target, and per target its tokens, repeats and goal."""
    sized = count_tokens(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"), ["doc_id", "source"], directory, file)
    sized = materialise(sized.where("n_tokens > 0"), "doc-tokens")
    have = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    goals = targets.select("source", F.greatest("target_share", F.lit(0.0)).alias("target_share"), F.greatest("max_repeat", F.lit(0)).alias("max_repeat")).where("source IS NOT NULL")
    goals = goals.join(have, "source", "left").fillna(0, ["n_docs", "n_tokens"])
    possible = goals.where("target_share > 0 AND n_tokens > 0").agg(F.min(F.col("max_repeat") * F.col("n_tokens") / F.col("target_share")).alias("total"))
    goals = goals.join(F.broadcast(possible)).withColumn("goal_tokens", F.when(F.col("n_tokens") > 0, F.col("target_share") * F.col("total")).otherwise(0.0))
    goals = goals.withColumn("repeats", F.when(F.col("n_tokens") > 0, F.least(F.col("goal_tokens") / F.col("n_tokens"), F.col("max_repeat").cast("double"))).otherwise(0.0))
    return sized, materialise(goals, "mix-goals")


def mixture(documents: DataFrame, targets: DataFrame, directory: str = TOKENIZER_DIR, file: str = TOKENIZER_FILE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, n_uses) of the used documents, and the goals per source."""
    sized, goals = plan_repeats(documents, targets, directory, file)
    whole = F.floor(F.col("repeats") + 1e-9).cast("int")
    rows = sized.join(F.broadcast(goals.where("repeats > 0").select("source", "repeats")), "source").withColumn("base", whole).withColumn("p", F.greatest(F.col("repeats") - whole, F.lit(0.0)))
    # Repeated rows of a document are told apart by a counter, so the sample doesn't depend on the partitioning.
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "source").orderBy("n_tokens")).cast("bigint"))
    counts = {r.source: max(1, math.ceil(r.n_docs / BLOCK)) for r in goals.select("source", "n_docs").collect()}
    blocks = F.create_map(*[F.lit(x) for kv in (counts or {"": 1}).items() for x in kv])
    rows = materialise(rows, "mix-rows")
    undecided = rows.where(f"p > {EPS}").select("doc_id", "copy", "source", "n_tokens", "p").withColumn("block", F.pmod(F.xxhash64("doc_id", "copy"), F.element_at(blocks, F.col("source"))).cast("int"))
    settled = None
    while True:
        land = max(counts.values(), default=1) == 1
        flown = materialise(undecided.groupBy("source", "block").applyInPandas(_fly_and_land if land else _fly_only, _SCHEMA), "mix-flight")
        done = flown.where(f"p <= {EPS} OR p >= 1 - {EPS}")
        settled = done if settled is None else settled.unionByName(done)
        if land:
            break
        counts = {s: max(1, math.ceil(2 * n / BLOCK)) for s, n in counts.items()}
        blocks = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
        undecided = flown.where(f"p > {EPS} AND p < 1 - {EPS}").withColumn("block", F.pmod(F.xxhash64("doc_id", "copy", F.lit(len(counts))), F.element_at(blocks, F.col("source"))).cast("int"))
    chosen = settled.where("p > 0.5").select("doc_id", "source", "copy", F.lit(1).alias("extra"))
    used = rows.join(chosen, ["doc_id", "source", "copy"], "left").withColumn("n_uses", F.col("base") + F.coalesce("extra", F.lit(0))).where("n_uses > 0")
    return used.select("doc_id", "source", "n_tokens", "n_uses"), goals


def mixture_report(documents: DataFrame, targets: DataFrame, directory: str = TOKENIZER_DIR, file: str = TOKENIZER_FILE) -> DataFrame:
    """Per source of the targets: share aimed at and reached, tokens there and used, repeats."""
    used, goals = mixture(documents, targets, directory, file)
    by = used.groupBy("source").agg(F.sum(F.col("n_tokens").cast("bigint") * F.col("n_uses")).alias("used_tokens"), F.sum("n_uses").alias("n_uses"), F.max("n_uses").alias("most_uses"))
    total = by.agg(F.sum("used_tokens").alias("all_tokens"))
    joined = goals.drop("total").join(by, "source", "left").fillna(0, ["used_tokens", "n_uses", "most_uses"]).join(F.broadcast(total))
    reached = F.round(F.coalesce(F.try_divide(F.col("used_tokens").cast("double"), F.col("all_tokens").cast("double")), F.lit(0.0)), 6)
    return joined.select("source", "target_share", reached.alias("share"), "max_repeat", "most_uses", "n_docs", "n_tokens", "n_uses", "used_tokens")
