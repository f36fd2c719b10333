"""Train, validation and test splits that keep linked records together.

Rows are linked by sharing an author or a stay, directly or through other rows. Linked
subjects come out as connected components by alternating large-star and small-star steps on
tables, with every step written to the shared folder. Whole components are then placed:
starting from a hashed assignment, moves and exchanges of components reduce the deviation of
sizes and label counts from the targets under an annealing schedule, from several seeds at
once in every block of components, and the best of each block is kept. The few components
larger than a thousandth of all rows (at most a thousand by that bound) are placed first,
against the targets of the whole; the blocks share out what is left. In a table of up to a
thousand rows that makes every component of more than one row a large one, by the same rule.

Defined results for odd input: a row without subject follows its stay, a row without either
stands alone; a split with share zero gets no rows if there is another; ties are broken by
hash; repeated rows count as often as they occur; an empty table gives empty tables; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.session import materialise, release

LABELS = ["easy", "medium", "hard", "unknown"]
BLOCK = 2000  # components annealed together
SEEDS = 4
STEPS = 20  # moves and exchanges tried for every component of a block
LARGE = 1000  # a component with more than 1/LARGE of all rows is placed first
TARGETS = 1000  # splits that may be named


def linked_subjects(pairs: DataFrame) -> DataFrame:
    """(subject_id, component) of subjects that are linked to another one; component is the least subject."""
    both = pairs.where("subject_id IS NOT NULL AND hadm_id IS NOT NULL").select(F.col("subject_id").cast("bigint").alias("s"), F.col("hadm_id").cast("bigint").alias("h")).distinct()
    least = both.groupBy("h").agg(F.min("s").alias("m"), F.max("s").alias("x")).where("m < x")
    edges = materialise(both.join(least, "h").where("s > m").select(F.col("s").alias("v"), F.col("m").alias("u")).distinct(), "links")
    before = None
    while True:
        # Large star: larger neighbours of a node hang on its least neighbour.
        sym = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = sym.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = sym.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        # Small star: smaller neighbours and the node itself hang on the least of them.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        last, edges = edges, materialise(small, "links")
        release(last)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    members = edges.select(F.col("v").alias("subject_id"), F.col("u").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("subject_id"), "component").distinct())


def linked_pairs(pairs: DataFrame) -> DataFrame:
    """(subject_a, subject_b): different subjects of one component."""
    members = linked_subjects(pairs)
    a, b = members.select(F.col("subject_id").alias("subject_a"), "component"), members.select(F.col("subject_id").alias("subject_b"), "component")
    return a.join(b, "component").where("subject_a < subject_b").select("subject_a", "subject_b")


def component_links(pairs: DataFrame) -> DataFrame:
    """(subject_id, component): pairs of a representative - the least subject - and each other member.

    As many rows as linked subjects, where ``linked_pairs`` grows with the square of a component.
    """
    return linked_subjects(pairs).where("subject_id <> component")


def row_components(pairs: DataFrame) -> DataFrame:
    """(qa_id, component, label): component is a text key of the rows that stay together."""
    rows = pairs.select(
        F.col("qa_id").cast("bigint").alias("qa_id"), F.col("subject_id").cast("bigint").alias("subject_id"), F.col("hadm_id").cast("bigint").alias("hadm_id"),
        F.when(F.lower("difficulty").isin("easy", "medium", "hard"), F.lower("difficulty")).otherwise("unknown").alias("label"),
    )
    stays = rows.where("subject_id IS NOT NULL AND hadm_id IS NOT NULL").groupBy("hadm_id").agg(F.min("subject_id").alias("via_stay"))
    orphans = rows.where("subject_id IS NULL AND hadm_id IS NOT NULL").join(stays, "hadm_id", "left").withColumn("subject_id", F.col("via_stay")).drop("via_stay")
    rows = rows.where("subject_id IS NOT NULL OR hadm_id IS NULL").unionByName(orphans)
    rows = rows.join(linked_subjects(pairs), "subject_id", "left")
    key = F.when(F.col("subject_id").isNotNull(), F.concat(F.lit("s"), F.coalesce("component", "subject_id").cast("string"))).when(F.col("hadm_id").isNotNull(), F.concat(F.lit("h"), F.col("hadm_id").cast("string"))).otherwise(F.concat(F.lit("r"), F.col("qa_id").cast("string")))
    return rows.select("qa_id", key.alias("component"), "label")


def _start(key: str, shares: list[float], seed: int) -> int:
    x = int.from_bytes(hashlib.blake2b(f"{seed}|{key}".encode(), digest_size=8).digest(), "big") / 2**64
    for i, s in enumerate(shares):
        x -= s
        if x < 0:
            return i
    return max(range(len(shares)), key=shares.__getitem__)


def anneal(keys: list[str], counts: list[list[int]], targets: list[list[float]], seed: int, steps: int = STEPS) -> tuple[float, list[int]]:
    """Deviation and split of each component; counts and targets hold the size, then the labels.

    ``steps`` moves or exchanges a component are tried while the heat falls to a thousandth
    of a component's share, whatever their number.
    """
    n, k, width = len(keys), len(targets), len(targets[0]) if targets else 0
    total = max(1.0, sum(c[0] for c in counts))
    shares = [t[0] / max(1e-9, sum(x[0] for x in targets)) for t in targets]
    place = [_start(key, shares, seed) for key in keys]
    now = [[0.0] * width for _ in range(k)]
    for c, p in zip(counts, place):
        for j in range(width):
            now[p][j] += c[j]
    weight = [1.0] + [0.5] * (width - 1)

    def off(s: int, row: list[float]) -> float:
        return sum(w * abs(x - t) for w, x, t in zip(weight, row, targets[s])) / total

    cost = sum(off(s, now[s]) for s in range(k))
    best, kept = cost, place[:]
    rng = random.Random(f"{seed}|{n}|{keys[0] if keys else ''}")
    tries = steps * n if k > 1 else 0
    heat, cold = 0.05, 0.001 / max(1, n)
    cooling = (cold / heat) ** (1 / max(1, tries))
    for _ in range(tries):
        heat *= cooling
        i = rng.randrange(n)
        a = place[i]
        if rng.random() < 0.5 and n > 1:
            j = rng.randrange(n)
            b = place[j]
            if a == b:
                continue
            delta = [y - x for x, y in zip(counts[i], counts[j])]
        else:
            j, b = -1, rng.randrange(k - 1)
            b += b >= a
            delta = [-x for x in counts[i]]
        row_a, row_b = [x + d for x, d in zip(now[a], delta)], [x - d for x, d in zip(now[b], delta)]
        change = off(a, row_a) + off(b, row_b) - off(a, now[a]) - off(b, now[b])
        if change < 0 or rng.random() < math.exp(-change / max(heat, 1e-9)):
            now[a], now[b] = row_a, row_b
            place[i] = b
            if j >= 0:
                place[j] = a
            cost += change
            if cost < best - 1e-12:
                best, kept = cost, place[:]
    return best, kept


def assign_splits(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """(qa_id, component, split) of every row."""
    spark = pairs.sparkSession
    rows = targets.where("split IS NOT NULL").select("split", "target_share").limit(TARGETS + 1).collect()
    if len(rows) > TARGETS:
        raise ValueError(f"more than {TARGETS} split targets")
    goal = sorted((r.split, max(0.0, r.target_share or 0.0)) for r in rows)
    names, shares = [g[0] for g in goal], [g[1] for g in goal]
    if not names or sum(shares) <= 0:
        raise ValueError("split targets need a positive share")
    shares = [s / sum(shares) for s in shares]
    rows = materialise(row_components(pairs), "split-rows")
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label") == x).alias(x) for x in LABELS])
    sizes = materialise(sizes, "split-sizes")
    width = ["n", *LABELS]
    whole = sizes.agg(F.count(F.lit(1)).alias("components"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in width]).first()
    bound = math.ceil(whole.n / LARGE)  # at most LARGE components are larger
    large = sizes.where(F.col("n") > bound).collect()
    full = [[s * whole[c] for c in width] for s in shares]
    _, place = min((anneal([r.component for r in large], [[r[c] for c in width] for r in large], full, seed) for seed in range(SEEDS)), key=lambda x: x[0])
    left = [[max(0.0, full[s][j] - sum(r[c] for r, p in zip(large, place) if p == s)) for j, c in enumerate(width)] for s in range(len(names))]
    left_size = max(1e-9, sum(t[0] for t in left))
    rest = [t[0] / left_size for t in left]
    blocks = max(1, math.ceil((whole.components - len(large)) / BLOCK))

    def place_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("component")
        counts = pdf[width].to_numpy().tolist()
        own = [sum(c[j] for c in counts) for j in range(len(width))]
        cost, where = anneal(pdf["component"].tolist(), counts, [[r * x for x in own] for r in rest], int(pdf["seed"].iloc[0]))
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "cost": [cost], "keys": [pdf["component"].tolist()], "places": [where]})

    small = sizes.where(F.col("n") <= bound).withColumn("block", F.pmod(F.xxhash64("component"), F.lit(blocks)).cast("int")).withColumn("seed", F.explode(F.array(*[F.lit(i) for i in range(SEEDS)])))
    tried = small.groupBy("block", "seed").applyInPandas(place_block, "block int, cost double, keys array<string>, places array<int>")
    best = tried.groupBy("block").agg(F.min_by(F.struct("keys", "places"), "cost").alias("b")).select(F.explode(F.arrays_zip("b.keys", "b.places")).alias("x")).select(F.col("x.keys").alias("component"), F.col("x.places").alias("place"))
    placed = best
    if large:
        placed = best.unionByName(spark.createDataFrame([(r.component, p) for r, p in zip(large, place)], "component string, place int"))
    label = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("place") + 1)
    return rows.join(placed.select("component", label.alias("split")), "component").select("qa_id", "component", "split", "label")


def split_report(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows, components and shares per split against the targets, and how far its labels are from those of all rows."""
    counts = [F.count_if(F.col("label") == x).alias(f"_{x}") for x in LABELS]
    placed = assign_splits(pairs, targets).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("component").alias("n_components"), *counts)
    total = placed.agg(F.sum("n_rows").alias("total"), *[F.sum(f"_{x}").alias(f"_all_{x}") for x in LABELS])
    joined = targets.select("split", "target_share").join(placed, "split", "left").join(F.broadcast(total))
    apart = sum((F.abs(F.col(f"_{x}") / F.col("n_rows") - F.col(f"_all_{x}") / F.col("total")) for x in LABELS), F.lit(0.0))
    return joined.select(
        "split", "target_share", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_components", F.lit(0)).alias("n_components"),
        F.round(F.coalesce(F.col("n_rows") / F.col("total"), F.lit(0.0)), 6).alias("share"), F.round(F.coalesce(apart / 2, F.lit(0.0)), 6).alias("label_deviation"),
    )
