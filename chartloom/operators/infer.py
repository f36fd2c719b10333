"""Cached batch inference with pluggable answer and judge functions, and append-only merges."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.text import judge_score

# Fixed value: the wording of a judge's request.
JUDGE_PROMPT = ("Question: ", "\n\nReference answer: ", "\n\nPredicted answer: ")


class Retry(Exception):
    """Raised by an answer function for errors that may pass."""


def cache_key(model: Column, system: Column, user: Column) -> Column:
    """SHA-256 of the canonical request; sampling settings are left out on purpose."""
    return F.sha2(F.to_json(F.struct(F.struct(system.alias("system"), user.alias("user")).alias("messages"), model.alias("model"))), 256)


def split_cache(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests answered by the cache, and those that aren't."""
    hits = requests.join(cache, "cache_key").withColumn("cached", F.lit(True))
    return hits, requests.join(cache, "cache_key", "left_anti")


def _answered(answer_fn: Callable[[str, str], dict], system: str, user: str, attempts: int, pause: float, longest: float) -> dict:
    row = {"answer": "", "prompt_tokens": 0, "completion_tokens": 0, "error": None}
    for attempt in range(1, attempts + 1):
        try:
            return row | answer_fn(system, user) | {"error": None}
        except Retry as e:
            row["error"] = f"gave up after {attempt} attempts: {e}"
            if attempt < attempts:
                time.sleep(min(longest, pause * 2 ** (attempt - 1)))
        except Exception as e:  # a request's own error must not end the job
            return row | {"error": f"{type(e).__name__}: {e}"}
    return row


def answer_misses(misses: DataFrame, answer_fn: Callable[[str, str], dict], attempts: int = 5, pause: float = 2.0, longest: float = 60.0, concurrency: int = 1) -> DataFrame:
    """``misses`` with answer, prompt_tokens, completion_tokens, cached and error.

    A passing error is tried again with doubled pauses; what fails in the end becomes a row
    with its error, so no request is lost. Partitions answer independently, each with up to
    ``concurrency`` requests under way; rows keep their order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
            for pdf in batches:
                out = list(pool.map(lambda x: _answered(answer_fn, x[0], x[1], attempts, pause, longest), zip(pdf["system_prompt"], pdf["user_prompt"])))
                yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=["answer", "prompt_tokens", "completion_tokens", "error"]).assign(cached=False)], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in misses.schema)
    return misses.mapInPandas(run, f"{kept}, answer string, prompt_tokens int, completion_tokens int, error string, cached boolean")


# Fixed value: beginnings of the names of models that reason before they answer.
REASONING = ("o1", "o3", "o4")


def request_arguments(model: str, max_tokens: int = 4096, temperature: float = 0.3) -> dict:
    """Sampling settings of a request: reasoning models take a limit that counts their reasoning, and no temperature."""
    if model.startswith(REASONING):
        return {"model": model, "max_completion_tokens": max_tokens}
    return {"model": model, "max_tokens": max_tokens, "temperature": temperature}


def make_runner(model: str, remote: Callable[..., Callable], local: Callable[..., Callable]) -> Callable[[str, str], dict]:
    """The answer function of a model: names with a slash are weights to be run here, others services."""
    return local(model) if "/" in model else remote(**request_arguments(model))


def batched(answer_many: Callable[[list[tuple[str, str]]], list[dict]], misses: DataFrame, size: int = 4) -> DataFrame:
    """``misses`` answered by a local model that takes ``size`` requests at once; a failed batch is an error in each of its rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            asked, out = list(zip(pdf["system_prompt"], pdf["user_prompt"])), []
            for lo in range(0, len(asked), size):
                try:
                    said = [{"answer": "", "prompt_tokens": 0, "completion_tokens": 0, "error": None} | x for x in answer_many(asked[lo : lo + size])]
                except Exception as e:
                    said = [{"answer": "", "prompt_tokens": 0, "completion_tokens": 0, "error": f"{type(e).__name__}: {e}"}] * len(asked[lo : lo + size])
                out += said
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=["answer", "prompt_tokens", "completion_tokens", "error"]).assign(cached=False)], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in misses.schema)
    return misses.mapInPandas(run, f"{kept}, answer string, prompt_tokens int, completion_tokens int, error string, cached boolean")


def run_cached(requests: DataFrame, cache: DataFrame, answer_fn: Callable[[str, str], dict]) -> tuple[DataFrame, DataFrame]:
    """All requests answered, and the cache's new rows; errors are never cached."""
    hits, misses = split_cache(requests, cache)
    fresh = answer_misses(misses, answer_fn)
    new = fresh.where("error IS NULL").select("cache_key", "answer", "prompt_tokens", "completion_tokens")
    rows = hits.withColumn("error", F.lit(None).cast("string"))
    return rows.select(*fresh.columns).unionByName(fresh), new


def extractive_answer(system: str, user: str) -> dict:
    """A stand-in for a model: the context sentence that shares most words with the question."""
    context, _, question = user.partition("### Question")
    asked = set(re.findall("[a-z0-9]+", question.lower()))
    sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", context) if s.strip() and not s.startswith("#")]
    best = max(sentences, key=lambda s: (len(asked & set(re.findall("[a-z0-9]+", s.lower()))), -len(s), s), default="")
    return {"answer": best, "prompt_tokens": len(user.split()), "completion_tokens": len(best.split())}


def judge_prompt(question: Column, gold: Column, predicted: Column) -> Column:
    a, b, c = JUDGE_PROMPT
    return F.concat(F.lit(a), question, F.lit(b), gold, F.lit(c), predicted)


def judge_pending(results: DataFrame, judge_fn: Callable[[str, str], dict], system: str, rescore: bool = False, dry_run: bool = False) -> DataFrame:
    """Results with a judge score in every row: kept where there is one, asked for otherwise.

    ``rescore`` asks for all again; ``dry_run`` asks for none and returns the requests.
    """
    pending = results if rescore else results.where("judge_score IS NULL")
    kept = results.where("FALSE") if rescore else results.where("judge_score IS NOT NULL")
    asked = pending.drop("judge_score", "judge_error").withColumn("system_prompt", F.lit(system)).withColumn("user_prompt", judge_prompt(F.col("question"), F.col("gold_answer"), F.col("answer")))
    if dry_run:
        return asked
    said = answer_misses(asked.withColumnRenamed("answer", "predicted"), judge_fn).withColumn("judge_score", judge_score(F.col("answer")))
    said = said.withColumn("judge_error", F.when(F.col("judge_score").isNull(), F.coalesce("error", F.lit("unparseable")))).drop("answer").withColumnRenamed("predicted", "answer")
    return kept.unionByName(said.select(*results.columns))


def append_only(existing: DataFrame, new: DataFrame, keys: list[str], full: Column | None = None) -> DataFrame:
    """Existing rows win; only those for which ``full`` holds count as existing."""
    kept = existing.where(full) if full is not None else existing
    return kept.unionByName(new.join(kept.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys), allowMissingColumns=True)


def unwrap_json(raw: Column) -> Column:
    """QA pairs out of a model's text: a code fence is taken off; an object gives its first known list, or itself."""
    item = "array<struct<question:string,answer:string,difficulty:string,source_types:array<string>,reasoning:string>>"
    text = F.trim(F.regexp_replace(F.trim(raw), r"^```[a-zA-Z]*\s*|\s*```$", ""))
    wrapped = F.from_json(text, "qa_pairs string, questions string, data string, items string")
    inner = F.coalesce(wrapped["qa_pairs"], wrapped["questions"], wrapped["data"], wrapped["items"])
    return F.when(text.startswith("["), F.from_json(text, item)).when(inner.isNotNull(), F.from_json(inner, item)).otherwise(F.array(F.from_json(text, item[6:-1])))
