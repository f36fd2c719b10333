"""Readers and writers of the record formats, with declared schemas."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom import schemas
from chartloom.functions.text import strip_blank
from chartloom.session import _file_system, table


def read_timelines(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON file that holds an array of timeline records, or with ``lines`` files of one record a line, which can be split."""
    return spark.read.schema(schemas.TIMELINE).json(path, multiLine=not lines)


def read_qa_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(schemas.QA_RECORD).json(path, multiLine=not lines)


def read_qa_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the pairs as JSON text: rows whose text doesn't parse are skipped, lists of one key are joined."""
    raw = spark.read.schema(schemas.QA_CSV).csv(path, header=True, multiLine=True, escape='"')
    rows = raw.withColumn("pairs", F.from_json("qa_pairs", f"array<{schemas.QA}>")).where("pairs IS NOT NULL AND size(pairs) > 0 AND NOT exists(pairs, p -> p IS NULL)")
    return rows.groupBy("subject_id", "hadm_id").agg(F.flatten(F.collect_list("pairs")).alias("qa_pairs"))


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return read_qa_csv(spark, path)
    if path.endswith(".json"):
        return read_qa_json(spark, path)
    raise ValueError(f"unknown QA format: {path}")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet_text(df: DataFrame, path: str) -> None:
    """Parquet with nested columns as JSON text, for readers that know no nesting."""
    nested = {f.name: F.to_json(f.name) for f in df.schema if f.dataType.typeName() in ("struct", "array", "map")}
    df.withColumns(nested).write.mode("overwrite").parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """Result rows by (model, method), slashes in model names made harmless, prompts left out."""
    rows = results.drop("user_prompt").withColumn("model", F.replace("model", F.lit("/"), F.lit("--")))
    rows.write.mode("overwrite").partitionBy("model", "method").parquet(path)


def result_key(name) -> tuple:
    """(model, method) columns of a result file's name; names without a separator are of an unknown model."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.json$", "")
    parts = F.split(stem, "__", 2)
    both = F.size(parts) == 2
    return F.when(both, F.get(parts, F.lit(0))).otherwise("unknown"), F.when(both, F.get(parts, F.lit(1))).otherwise(stem)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All result files of a folder, keyed by file name; damaged files are skipped.

    The files this package writes beside results, ``summary.json`` and ``rankings.json``, are
    known by their whole name; a cache is a folder and isn't read.
    """
    rows = spark.read.schema(schemas.RESULT).option("mode", "DROPMALFORMED").json(f"{path}/*.json", multiLine=True)
    rows = rows.withColumn("_file", F.col("_metadata.file_name")).where("question IS NOT NULL AND _file NOT IN ('summary.json', 'rankings.json', 'judge_rankings.json')")
    model, method = result_key(F.col("_file"))
    return rows.withColumns({"model": model, "method": method}).drop("_file")


def upsert_means(summary: DataFrame, means: DataFrame) -> DataFrame:
    """Judge means put into a summary by (model, method); what has no new mean keeps its old one."""
    old = summary if "judge_mean" in summary.columns else summary.withColumn("judge_mean", F.lit(None).cast("double"))
    joined = old.join(means.withColumnRenamed("judge_mean", "_new"), ["model", "method"], "left")
    return joined.withColumn("judge_mean", F.coalesce("_new", "judge_mean")).drop("_new")


def read_config(path: str) -> dict:
    """A settings file: JSON, or YAML in its plain form - nested keys with scalar values, comments, quotes."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    root: dict = {}
    levels = [(-1, root)]
    for line in text.splitlines():
        bare = re.sub(r"""\s+#[^"']*$|^\s*#.*$""", "", line).rstrip()
        if not bare.strip():
            continue
        depth = len(bare) - len(bare.lstrip())
        key, _, value = bare.strip().partition(":")
        while levels[-1][0] >= depth:
            levels.pop()
        if value.strip():
            levels[-1][1][key] = _scalar(value.strip())
        else:
            levels[-1][1][key] = {}
            levels.append((depth, levels[-1][1][key]))
    return root


def _scalar(text: str):
    if text[:1] in "\"'" and text[-1:] == text[:1]:
        return text[1:-1]
    if text in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[text]
    try:
        return int(text)
    except ValueError:
        try:
            return float(text)
        except ValueError:
            return text


def register_tables(spark: SparkSession, directory: str, names: list[str]) -> None:
    """Tables of a folder as views, so that any SQL can be asked of them."""
    for name in names:
        table(spark, directory, name).createOrReplaceTempView(name)


def run_query(spark: SparkSession, sql: str, **args) -> DataFrame:
    """Ad-hoc SQL over registered tables; ``args`` fill named markers."""
    return spark.sql(sql, args=args or None)


def load_and_merge(spark: SparkSession, timelines: str, qa: str, lines: bool = False) -> DataFrame:
    """Timelines with their pairs: inner join by stay, the last non-empty list of a stay wins, blank notes leave."""
    pairs = (read_qa_json(spark, qa, True) if lines else read_qa(spark, qa)).where("size(qa_pairs) > 0").withColumn("_n", F.monotonically_increasing_id())
    last = pairs.groupBy("subject_id", "hadm_id").agg(F.max_by("qa_pairs", "_n").alias("qa_pairs"))
    records = read_timelines(spark, timelines, lines).where(strip_blank(F.col("discharge_summary")) != "")
    return records.join(last, ["subject_id", "hadm_id"]).withColumn("note_text", strip_blank(F.col("discharge_summary")))


def summary_rows(results: DataFrame) -> DataFrame:
    """(model, method, n, token_f1_mean, rouge_l_f1_mean, context_tokens_mean, prompt_tokens_mean), missing values as 0."""
    means = [F.avg(F.coalesce(F.col(c), F.lit(0)).cast("double")).alias(f"{c}_mean") for c in ("token_f1", "rouge_l_f1", "context_tokens", "prompt_tokens")]
    return results.groupBy("model", "method").agg(F.count(F.lit(1)).alias("n"), *means)


def write_summary(summary: DataFrame, path: str) -> None:
    """One JSON line per model, its methods as a map: one row per cell reaches the writer."""
    cells = F.struct(*[c for c in summary.columns if c not in ("model", "method")])
    by = summary.groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", cells)))).alias("methods"))
    by.coalesce(1).write.mode("overwrite").json(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A summary in long form: (model, method, metric, value)."""
    raw = spark.read.schema("model string, methods map<string,map<string,double>>").json(path)
    return raw.select("model", F.explode("methods").alias("method", "metrics")).select("model", "method", F.explode("metrics").alias("metric", "value"))


def write_rankings(rankings: DataFrame, path: str) -> None:
    """Rankings with their score counts, one JSON line per strategy."""
    rankings.coalesce(1).write.mode("overwrite").json(path)


def read_rankings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("rank int, strategy string, n bigint, mean_score double, wins double, win_pct double").json(path)


def write_metrics(metrics: DataFrame, recall: DataFrame, path: str) -> None:
    """Metrics of a trained ranker and its recall by k, as one JSON object."""
    by_k = recall.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("recall_at_"), F.col("k").cast("string")), "recall")))).alias("recall"))
    metrics.join(F.broadcast(by_k)).coalesce(1).write.mode("overwrite").json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Stored answers by request key, the first stored of a key; an absent folder is an empty cache."""
    schema = "cache_key string, answer string, prompt_tokens int, completion_tokens int"
    files, target = _file_system(spark, path)
    if not files.exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).dropDuplicates(["cache_key"])


def append_cache(new: DataFrame, path: str) -> None:
    new.select("cache_key", "answer", "prompt_tokens", "completion_tokens").write.mode("append").parquet(path)
