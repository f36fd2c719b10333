"""Training of the chunk ranker and exact metrics of scored rows."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.operators.features import feature_array, feature_groups, feature_names
from chartloom.operators.retrieve import top_k


def balanced_weights(rows: DataFrame) -> DataFrame:
    """``rows`` with w, n / (2 n_class)."""
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
    each = F.when(F.col("label") == 1, F.col("n") / (2 * F.greatest("p", F.lit(1)))).otherwise(F.col("n") / (2 * F.greatest(F.col("n") - F.col("p"), F.lit(1))))
    return rows.join(F.broadcast(n)).withColumn("w", each).drop("n", "p")


def fit_ranker(pairs: DataFrame, c: float = 1.0, max_iter: int = 100) -> LogisticRegressionModel:
    """L1 logistic regression on feature rows with balanced classes; the penalty is 1 / (c * rows)."""
    rows = balanced_weights(pairs.select("label", array_to_vector(feature_array(pairs)).alias("features"))).cache()
    try:
        n = max(1, rows.count())
        model = LogisticRegression(elasticNetParam=1.0, regParam=1.0 / (c * n), weightCol="w", standardization=False, maxIter=max_iter)
        return model.fit(rows.withColumn("label", F.col("label").cast("double")))
    finally:
        rows.unpersist()


def apply_ranker(model: LogisticRegressionModel, pairs: DataFrame) -> DataFrame:
    out = model.transform(pairs.withColumn("features", array_to_vector(feature_array(pairs))))
    return out.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "probability", "prediction")


def save_ranker(model: LogisticRegressionModel, vocabulary: DataFrame, path: str) -> None:
    """Coefficients by feature, the intercept under an empty name, and the vocabulary, as tables under ``path``."""
    spark = vocabulary.sparkSession
    rows = [(n, float(w)) for n, w in zip(feature_names(), model.coefficients)] + [("", float(model.intercept))]
    spark.createDataFrame(rows, "feature string, weight double").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
    vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")


def load_ranker(spark, path: str) -> tuple[dict[str, float], float, DataFrame]:
    """(weights by feature, intercept, vocabulary) for ``features.linear_score``; one row per feature is read."""
    rows = {r.feature: r.weight for r in spark.read.parquet(f"{path}/weights").limit(len(feature_names()) + 1).collect()}
    return {n: rows.get(n, 0.0) for n in feature_names()}, rows.get("", 0.0), spark.read.parquet(f"{path}/vocabulary")


def coefficients(model: LogisticRegressionModel, spark) -> DataFrame:
    return spark.createDataFrame([(n, float(w)) for n, w in zip(feature_names(), model.coefficients)], "feature string, weight double")


RANGES = 64  # ranges of scores whose running sums are made in parallel


def ranked_counts(scored: DataFrame) -> DataFrame:
    """Per distinct score, descending: positives and negatives at it and down to it.

    Distinct scores fall into ranges of about equal numbers; each range sums up on its own,
    on top of what the at most ``RANGES`` ranges above it hold.
    """
    by = scored.groupBy("score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    steps = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    bounds = by.agg(F.percentile_approx("score", steps, 10_000).alias("_bounds"))
    ranged = by.join(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col("score")))).drop("_bounds")
    above = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    sums = sums.select("_range", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("_p"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_n"))
    w = Window.partitionBy("_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.join(F.broadcast(sums), "_range")
    return rows.select("score", "pos", "neg", (F.col("_p") + F.sum("pos").over(w)).alias("tp"), (F.col("_n") + F.sum("neg").over(w)).alias("fp"))


def classification_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """accuracy, roc_auc (ties count half), average_precision, n_pos, n_total; the curves' areas are 0 for one class."""
    total = scored.agg(F.count(F.lit(1)).alias("n_total"), F.coalesce(F.sum("label"), F.lit(0)).alias("n_pos"), F.avg(((F.col("score") >= threshold).cast("int") == F.col("label")).cast("double")).alias("accuracy"))
    sums = ranked_counts(scored).agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") / 2).alias("area"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n_total"))
    joined = total.join(F.broadcast(sums))
    return joined.select(
        "n_total", "n_pos", F.round("accuracy", 6).alias("accuracy"),
        F.round(F.when(both, F.col("area") / (F.col("n_pos") * (F.col("n_total") - F.col("n_pos")))).otherwise(0.0), 6).alias("roc_auc"),
        F.round(F.when(both, F.col("ap") / F.col("n_pos")).otherwise(0.0), 6).alias("average_precision"),
    )


def recall_at_k(scored: DataFrame, keys: list[str], ks: tuple[int, ...] = (1, 3, 5, 10), skip_unanswerable: bool = True) -> DataFrame:
    """(k, recall, n_questions): mean share of a question's positives among its k best chunks."""
    pos = scored.groupBy(*keys).agg(F.sum("label").alias("n_pos"))
    best = top_k(scored, keys, max(ks))
    hits = best.groupBy(*keys).agg(*[F.sum(F.when(F.col("rank") <= k, F.col("label")).otherwise(0)).alias(f"h{k}") for k in ks])
    rows = pos.join(hits, keys)
    if skip_unanswerable:
        rows = rows.where("n_pos > 0")
    stacked = rows.select("n_pos", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("h")) for k in ks])).alias("x"))
    value = F.when(F.col("n_pos") > 0, F.col("x.h") / F.col("n_pos")).otherwise(0.0)
    return stacked.groupBy("x.k").agg(F.round(F.avg(value), 6).alias("recall"), F.count(F.lit(1)).alias("n_questions"))


def weight_groups(weights: DataFrame) -> DataFrame:
    """(feature_group, mass, percent): absolute weight by the group a feature's place in the vector belongs to."""
    places = [(name, group) for name, group in zip(feature_names(), feature_groups())]
    named = weights.join(F.broadcast(weights.sparkSession.createDataFrame(places, "feature string, feature_group string")), "feature")
    by = named.groupBy("feature_group").agg(F.sum(F.abs("weight")).alias("mass")).where("mass > 0")
    total = by.agg(F.sum("mass").alias("all_mass"))
    return by.join(F.broadcast(total)).select("feature_group", F.round("mass", 6).alias("mass"), F.round(100 * F.col("mass") / F.col("all_mass"), 4).alias("percent"))
