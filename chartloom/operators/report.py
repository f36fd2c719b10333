"""Reports over result rows (model, method, question, difficulty, metrics, judge score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.operators.label import seeded


def difficulty_of(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))


METHODS = 500  # methods that may become columns


def model_method_matrix(rows: DataFrame, metric: str, first: list[str] | None = None) -> DataFrame:
    """One row per model, one column per method - ``first`` ones first: mean of the metric, missing values as 0."""
    found = [r.method for r in rows.select("method").where("method IS NOT NULL").distinct().limit(METHODS + 1).collect()]
    if len(found) > METHODS:
        raise ValueError(f"more than {METHODS} methods can't become columns")
    methods = [*(first or []), *sorted(set(found) - set(first or []))]
    return rows.groupBy("model").pivot("method", methods).agg(F.round(F.avg(F.coalesce(F.col(metric), F.lit(0.0))), 6))


def row_best(rows: DataFrame, metric: str, close: float = 1e-4) -> DataFrame:
    """(model, method, mean, is_best): cells within ``close`` of the best of their model."""
    cells = rows.groupBy("model", "method").agg(F.avg(F.coalesce(F.col(metric), F.lit(0.0))).alias("mean"))
    best = F.max("mean").over(Window.partitionBy("model"))
    return cells.select("model", "method", F.round("mean", 6).alias("mean"), (best - F.col("mean") < close).alias("is_best"))


def summary_by(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.coalesce(F.col(m), F.lit(0.0))), 6).alias(f"mean_{m}") for m in metrics])


def difficulty_breakdown(rows: DataFrame, metric: str) -> DataFrame:
    kind = difficulty_of(F.col("difficulty"))
    return rows.where(kind.isin("easy", "medium", "hard", "unknown")).groupBy("method", kind.alias("difficulty")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(F.col(metric), F.lit(0.0))), 6).alias(f"mean_{metric}"))


def common_questions(scored: DataFrame, key: str, strategy: str) -> DataFrame:
    """Rows of questions that every strategy has a score for; the number of strategies is counted, not assumed."""
    n = scored.agg(F.countDistinct(strategy).alias("n_all"))
    have = scored.groupBy(key).agg(F.countDistinct(strategy).alias("n_have"))
    keep = have.join(F.broadcast(n)).where("n_have = n_all").select(key)
    return scored.join(keep, key, "left_semi")


def judge_rankings(scores: DataFrame, key: str = "question", strategy: str = "strategy", score: str = "judge_score") -> DataFrame:
    """Fractional wins, mean score, win share and rank per strategy over the common questions; scores of 0 are unparsed."""
    rows = common_questions(scores.where(F.coalesce(F.col(score), F.lit(0)) > 0), key, strategy)
    w = Window.partitionBy(key)
    best = rows.withColumn("_max", F.max(score).over(w)).withColumn("_tied", F.count_if(F.col(score) == F.col("_max")).over(w))
    by = best.groupBy(strategy).agg(F.sum(F.when(F.col(score) == F.col("_max"), 1.0 / F.col("_tied")).otherwise(0.0)).alias("wins"), F.avg(score).alias("mean"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.desc(F.round("wins", 6)), strategy)  # one row per strategy
    return by.select(F.row_number().over(order).alias("rank"), strategy, "n", F.round("mean", 4).alias("mean_score"), F.round("wins", 2).alias("wins"), F.round(100 * F.col("wins") / F.col("n"), 2).alias("win_pct"))


def score_histogram(scores: DataFrame, strategy: str = "strategy", score: str = "judge_score") -> DataFrame:
    return scores.groupBy(strategy).agg(*[F.count_if(F.col(score) == i).alias(f"score_{i}") for i in range(1, 6)])


def score_shares(scores: DataFrame, strategy: str = "strategy", score: str = "judge_score") -> DataFrame:
    by = scores.where(F.col(score).between(1, 5)).groupBy(strategy, score).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(strategy)), 6))


def pairwise_wins(scores: DataFrame, champion: str, keys: list[str], strategy: str = "strategy", score: str = "judge_score") -> DataFrame:
    """Share of common questions on which ``champion`` scores strictly higher than each other strategy."""
    mine = scores.where((F.col(strategy) == champion) & F.col(score).isNotNull()).select(*keys, F.col(score).alias("mine"))
    rest = scores.where((F.col(strategy) != champion) & F.col(score).isNotNull())
    return rest.join(mine, keys).groupBy(strategy).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("mine") > F.col(score)).cast("double")), 6).alias("win_rate"))


def lift(rows: DataFrame, champion: str, metric: str) -> DataFrame:
    """(model, method, lift): the champion's mean less each method's, a missing mean counting 0."""
    cells = rows.groupBy("model", "method").agg(F.avg(F.coalesce(F.col(metric), F.lit(0.0))).alias("mean"))
    mine = cells.where(F.col("method") == champion).select("model", F.col("mean").alias("mine"))
    return cells.where(F.col("method") != champion).join(mine, "model", "left").select("model", "method", F.round(F.coalesce("mine", F.lit(0.0)) - F.col("mean"), 6).alias("lift"))


def mean_of_means(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Per method, the mean over models of each model's mean."""
    cells = rows.groupBy("model", "method").agg(*[F.avg(m).alias(m) for m in metrics])
    return cells.groupBy("method").agg(F.count(F.lit(1)).alias("n_models"), *[F.round(F.avg(m), 6).alias(f"mean_{m}") for m in metrics])


def run_totals(rows: DataFrame) -> DataFrame:
    """One row for a run: prompts, tokens in and out, mean token F1 and mean subsequence F1."""
    mean = lambda c: F.round(F.coalesce(F.avg(F.coalesce(F.col(c), F.lit(0.0))), F.lit(0.0)), 6)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return rows.agg(F.count(F.lit(1)).alias("n_prompts"), total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"), mean("token_f1").alias("mean_token_f1"), mean("rouge_l_f1").alias("mean_rouge_l_f1"))


def runner_counts(rows: DataFrame) -> DataFrame:
    """One row for a run of answers: cache hits, calls that answered, and errors."""
    failed = F.col("error").isNotNull()
    return rows.agg(F.count_if(F.col("cached")).alias("cache_hits"), F.count_if(~F.col("cached") & ~failed).alias("api_calls"), F.count_if(failed).alias("errors"))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows of the least seeded hashes of their keys: reproducible, and a top-n instead of a full sort."""
    return rows.orderBy(seeded(F.col(key), seed), key).limit(n)


def sampled_means(scores: DataFrame, n: int, seed: int = 42, key: str = "question", strategy: str = "strategy", score: str = "judge_score") -> DataFrame:
    """(strategy, n, mean) over a seeded sample of the questions every strategy has a positive score for."""
    rows = common_questions(scores.where(F.coalesce(F.col(score), F.lit(0)) > 0), key, strategy)
    chosen = seeded_sample(rows.select(key).distinct(), key, n, seed)
    return rows.join(chosen, key, "left_semi").groupBy(strategy).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 4).alias("mean"))


# Names of models and methods in reports, and the order of methods.
MODEL_NAMES = {
    "o4-mini": "o4-mini", "gpt-4o-mini": "gpt-4o-mini", "meta-llama--Llama-3.1-8B-Instruct": "Llama-3.1-8B", "mistralai--Mistral-7B-Instruct-v0.3": "Mistral-7B", "microsoft--Phi-3-mini-4k-instruct": "Phi-3-mini-4k",
}
METHOD_NAMES = {"discharge_only": "discharge-only", "full_context": "full-context", "recency_n25": "recency", "bm25_k5": "BM25", "semantic_rag_k5": "semantic RAG", "learned_k5": "learned"}


def display_name(c: Column, names: dict[str, str]) -> Column:
    """The name in reports, or the value itself where it has none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c), c)


def metric_of(summary: DataFrame, model: str, method: str, metric: str) -> DataFrame:
    """One row with the value of a metric of a long summary (model, method, metric, value), null if there is none."""
    here = summary.where((F.col("model") == model) & (F.col("method") == method) & (F.col("metric") == metric))
    return here.agg(F.max("value").alias("value"))
