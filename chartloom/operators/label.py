"""Weak labels of (question, chunk) pairs, negative sampling and seeded splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.functions.text import BOOST_SECTIONS, MEASUREMENT, alpha_tokens, entity_tokens, token_f1

THRESHOLD = 0.15


def weak_label(chunk_tokens: Column, answer_tokens: Column, threshold: float = THRESHOLD, boost: Column | None = None) -> Column:
    """1 if the token F1 of chunk and answer reaches the threshold, or where ``boost`` holds.

    The tokens should be columns, not expressions, so that they are made once per row; the
    overlap is counted along the answer, the shorter of the two.
    """
    hit = token_f1(answer_tokens, chunk_tokens)[2] >= threshold
    return (hit if boost is None else hit | boost).cast("int")


def shared_tokens(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qa_id, record_id, chunk_idx, shared): tokens an answer shares with each chunk of its record, with multiplicity.

    Token counts of answers meet those of chunks by record and token, so pairs that share
    nothing are never looked at.
    """
    a = asked.select("qa_id", "record_id", F.explode("answer_tokens").alias("term")).groupBy("qa_id", "record_id", "term").agg(F.count(F.lit(1)).alias("n_a"))
    c = chunks.select("record_id", "chunk_idx", F.explode("chunk_tokens").alias("term")).groupBy("record_id", "chunk_idx", "term").agg(F.count(F.lit(1)).alias("n_c"))
    return a.join(c, ["record_id", "term"]).groupBy("qa_id", "record_id", "chunk_idx").agg(F.sum(F.least("n_a", "n_c")).alias("shared"))


def label_pairs(asked: DataFrame, chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every question with every chunk of its own record, and its weak label by token F1."""
    sized = asked.withColumn("_a", F.size("answer_tokens")).drop("answer_tokens")
    pairs = sized.join(chunks.withColumn("_c", F.size("chunk_tokens")).drop("chunk_tokens"), "record_id").join(shared_tokens(asked, chunks), ["qa_id", "record_id", "chunk_idx"], "left")
    f1 = 2.0 * F.coalesce("shared", F.lit(0)) / F.greatest(F.col("_a") + F.col("_c"), F.lit(1))
    return pairs.withColumn("label", (f1 >= threshold).cast("int")).drop("_a", "_c", "shared")


def entity_boost(question: Column, chunk: Column, section: Column) -> Column:
    """Whether the chunk stands in a data section and measures an entity the question names."""
    shared = F.size(F.array_intersect(entity_tokens(question), alpha_tokens(chunk))) > 0
    return shared & section.isin(*BOOST_SECTIONS) & chunk.rlike(f"(?i){MEASUREMENT}")


def seeded(key: Column, seed: int) -> Column:
    """A hash that orders rows reproducibly on any engine."""
    return F.sha2(F.concat(key.cast("string"), F.lit(f"|{seed}")), 256)


def sample_negatives(pairs: DataFrame, keys: list[str], row_key: Column, per_positive: int = 5, seed: int = 42) -> DataFrame:
    """All positives and up to ``per_positive`` negatives for each; keys without positives give nothing."""
    w = Window.partitionBy(*keys)
    ranked = pairs.withColumn("_pos", F.sum("label").over(w)).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "label").orderBy(seeded(row_key, seed))))
    return ranked.where((F.col("_pos") > 0) & ((F.col("label") == 1) | (F.col("_rank") <= per_positive * F.col("_pos")))).drop("_pos", "_rank")


def hash_split(rows: DataFrame, key: str, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """(key, part): the keys in seeded order, the first ``int(n * (1 - validation))`` of them train.

    A key's place in the order is its place among the keys whose hash begins alike, which is
    counted in parallel, and the number of keys in the at most 65,536 groups before.
    """
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_h", seeded(F.col(key), seed)).withColumn("_g", F.substring("_h", 1, 4))
    groups = keys.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = groups.select("_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.floor(F.sum("_n").over(every) * (1 - validation)).alias("_cut"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_g").orderBy("_h"))
    return keys.join(F.broadcast(groups), "_g").select(key, F.when(place <= F.col("_cut"), "train").otherwise("validation").alias("part"))
