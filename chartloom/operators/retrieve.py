"""Ranking of chunks per question: BM25, TF-IDF, embedding cosine, and context strategies."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.functions.text import blank_tokens
from chartloom.functions.tokens import BLANKS, Tokens
from chartloom.operators.timeline import event_document, event_lines, named_values

K1, B, EPSILON = 1.5, 0.75, 0.25
BUDGET = 4096


def top_k(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows per key: score descending, later chunk first on ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("chunk_idx"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qa_id, record_id, chunk_idx, score) of every chunk of each question's record.

    ``questions`` has qa_id, record_id, question; ``chunks`` record_id, chunk_idx, chunk. The
    corpus is the record's own chunks. Term statistics are one aggregation by (record, term);
    only terms of questions meet the postings.
    """
    terms = chunks.select("record_id", "chunk_idx", blank_tokens(F.lower("chunk")).alias("t"))
    stats = terms.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("avgdl"))
    postings = terms.select("record_id", "chunk_idx", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("record_id", "chunk_idx", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("record_id", "term").agg(F.count(F.lit(1)).alias("df")).join(stats, "record_id")
    idf = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    # The mean over a record's terms is a window over what the join has partitioned already.
    idf = idf.withColumn("floor", EPSILON * F.avg("raw").over(Window.partitionBy("record_id"))).select("record_id", "term", "avgdl", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    asked = questions.select("qa_id", "record_id", F.explode(blank_tokens(F.lower("question"))).alias("term")).groupBy("qa_id", "record_id", "term").agg(F.count(F.lit(1)).alias("times"))
    hit = postings.join(idf, ["record_id", "term"]).join(asked, ["record_id", "term"])
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = hit.groupBy("qa_id", "record_id", "chunk_idx").agg(F.sum(part).alias("score"))
    every = questions.select("qa_id", "record_id").join(terms.select("record_id", "chunk_idx"), "record_id")
    return every.join(scores, ["qa_id", "record_id", "chunk_idx"], "left").fillna(0.0, ["score"])


def reading_order(picked: DataFrame, keys: list[str], text: str = "chunk") -> DataFrame:
    """Picked chunks of each key joined in the order of the note."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_idx", text)))
    return picked.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p[text]), "\n\n").alias("context"), F.count(F.lit(1)).alias("n_chunks"))


def terms_1_2(c: Column) -> Column:
    """Words of two letters or more and their neighbours in pairs."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]{2,})"), F.lit(1))
    # The pair that lacks its second word is null and falls away.
    pairs = F.filter(F.zip_with(words, F.slice(words, 2, 2**30), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
    return F.concat(words, pairs)


def tfidf_vocabulary(texts: DataFrame, text: str, min_df: int = 2, size: int = 20_000, times: str | None = None) -> DataFrame:
    """(term, df, total, idf) of the most frequent terms; ties by term. Its size is bounded by ``size``.

    A row counts as often as its column ``times`` says, once without it.
    """
    times_of = F.lit(1) if times is None else F.col(times)
    n = texts.agg(F.sum(times_of).alias("n"))
    terms = texts.select(F.col(text), times_of.alias("_m")).withColumn("_d", F.monotonically_increasing_id()).select("_d", "_m", F.explode(terms_1_2(F.col(text))).alias("term"))
    by_text = terms.groupBy("_d", "_m", "term").agg(F.count(F.lit(1)).alias("tf"))
    counts = by_text.groupBy("term").agg(F.sum("_m").alias("df"), F.sum(F.col("tf") * F.col("_m")).alias("total")).where(F.col("df") >= min_df)
    best = counts.orderBy(F.desc("total"), "term").limit(size)
    return best.join(F.broadcast(n)).select("term", "df", "total", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_vectors(texts: DataFrame, key: list[str], text: str, vocabulary: DataFrame) -> DataFrame:
    """(key, term, weight) of unit-length vectors with logarithmic term counts."""
    terms = texts.select(*key, F.explode(terms_1_2(F.col(text))).alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = terms.join(vocabulary.select("term", "idf"), "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = raw.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(*key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def pair_tfidf(questions: DataFrame, chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(qa_id, record_id, chunk_idx, tfidf_sim) of every question and chunk of its record that share a term.

    ``questions`` has qa_id, record_id, question; ``chunks`` record_id, chunk_idx, chunk. The
    vectors meet by record and term; the similarity of all other pairs is 0.
    """
    small = F.broadcast(vocabulary)  # bounded by the vocabulary's size
    q = tfidf_vectors(questions, ["qa_id", "record_id"], "question", small)
    c = tfidf_vectors(chunks, ["record_id", "chunk_idx"], "chunk", small).withColumnRenamed("weight", "other")
    return q.join(c, ["record_id", "term"]).groupBy("qa_id", "record_id", "chunk_idx").agg(F.sum(F.col("weight") * F.col("other")).alias("tfidf_sim"))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors given as arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hashed_vectors(dims: int = 64) -> Callable[[Column], Column]:
    """A stand-in encoder: unit vectors of hashed word counts, in Arrow batches. Any encoder of the same form fits."""

    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dims)
            for w in re.findall("[a-z0-9]+", (t or "").lower()):
                v[zlib.crc32(w.encode()) % dims] += 1.0
            n = np.linalg.norm(v)
            out.append(v / n if n else v)
        return pd.Series(out)

    return encode


QUERY_BLOCK = 4096  # queries that meet the items at once


def nearest(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, score, rank): the k items closest to each query, ties by item.

    The query set is taken in blocks of about ``QUERY_BLOCK``, however many there are. A
    block is broadcast, every item meets each of its queries once, and a task keeps no more
    than the k best of each query.
    """
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "embedding").collect()
        if rows or found is None:
            ids = np.array([r.query_id for r in rows], dtype=np.int64)
            matrix = np.array([r.embedding for r in rows], dtype=np.float64) if rows else np.zeros((0, 1))
            part = items.select("item_id", "embedding").mapInPandas(_closest(spark.sparkContext.broadcast((ids, matrix)), k), "query_id bigint, item_id bigint, score double")
            found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _closest(shared, k: int) -> Callable:
    def scan(batches):
        ids, matrix = shared.value
        scores, own = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), dtype=np.int64)
        for pdf in batches:
            if not len(pdf) or not len(ids):
                continue
            new = matrix @ np.stack(pdf["embedding"].to_numpy()).astype(np.float64).T
            scores = np.hstack([scores, new])
            own = np.hstack([own, np.broadcast_to(pdf["item_id"].to_numpy(), new.shape)])
            if scores.shape[1] > k:
                # By item first, then a stable sort by score: equal scores stay in the order of items.
                near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                worst = np.take_along_axis(scores, near, 1).min(axis=1, keepdims=True)
                tied = (scores >= worst).sum(axis=1) > k
                kept_scores, kept_own = np.take_along_axis(scores, near, 1), np.take_along_axis(own, near, 1)
                for q in np.flatnonzero(tied):  # more candidates than places: the exact order decides
                    order = np.lexsort((own[q], -scores[q]))[:k]
                    kept_scores[q], kept_own[q] = scores[q][order], own[q][order]
                scores, own = kept_scores, kept_own
        yield pd.DataFrame({"query_id": np.repeat(ids, scores.shape[1]), "item_id": own.ravel(), "score": scores.ravel()})

    return scan


# The wording around a prompt's context.
BEFORE, BETWEEN = "### Patient Context\n\n", "\n\n### Question\n\n"


def user_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit(BEFORE), context, F.lit(BETWEEN), question)


def cut_to_budget(text: Column, question: Column, budget: int = BUDGET, tokens: Tokens = BLANKS) -> Column:
    """Text within the budget left by the prompt around the question; unchanged if it fits."""
    return tokens.cut(text, F.greatest(F.lit(budget) - tokens.count(user_prompt(F.lit(""), question)), F.lit(0)))


def _prompt(rows: DataFrame, full: Column, method: str | Column, budget: int, tokens: Tokens) -> DataFrame:
    """Prompts of the texts within the budget; tokens that fit prompts in one pass add prompt_tokens."""
    # Text, room and context are columns of their own, so none is made more than once.
    out, name = rows.withColumn("_full", full), (F.lit(method) if isinstance(method, str) else method).alias("method")
    if tokens.fit:
        out = out.withColumn("_fit", tokens.fit(BEFORE, F.col("_full"), F.concat(F.lit(BETWEEN), F.col("question")), budget))
        return out.select("qa_id", "record_id", name, user_prompt(F.col("_fit.context"), F.col("question")).alias("user_prompt"), "_fit.context_tokens", "_fit.prompt_tokens")
    out = out.withColumn("_room", F.greatest(F.lit(budget) - tokens.count(user_prompt(F.lit(""), F.col("question"))), F.lit(0)))
    if tokens is BLANKS:
        out = out.withColumn("_tokens", blank_tokens(F.col("_full")))
        out = out.withColumn("_context", F.when(F.size("_tokens") <= F.col("_room"), F.col("_full")).otherwise(F.array_join(F.slice("_tokens", 1, F.col("_room")), " ")))
    else:
        out = out.withColumn("_context", tokens.cut(F.col("_full"), F.col("_room")))
    return out.select("qa_id", "record_id", name, user_prompt(F.col("_context"), F.col("question")).alias("user_prompt"), tokens.count(F.col("_context")).alias("context_tokens"))


def discharge_only(rows: DataFrame, budget: int = BUDGET, tokens: Tokens = BLANKS) -> DataFrame:
    return _prompt(rows, F.coalesce("discharge_summary", F.lit("")), "discharge_only", budget, tokens)


def record_texts(records: DataFrame, n: int = 25) -> DataFrame:
    """``records`` with full_text and recent_text, made once per record before questions are joined."""
    none = F.array().cast(records.schema["events"].dataType)
    demo = named_values("demographics", [f.name for f in records.schema["demographics"].dataType.fields], "DEMOGRAPHICS:")
    adm = named_values("admission", [f.name for f in records.schema["admission"].dataType.fields], "ADMISSION:")
    rows = records.withColumn("_all", F.coalesce("events", none))
    rows = rows.withColumn("_n", F.size("_all")).withColumn("_at", F.transform("_all", lambda e, i: F.struct(i.alias("i"), e.alias("e"))))
    rows = rows.withColumn("_lines", event_lines(F.col("_all")))
    live = F.transform(F.filter("_at", lambda x: x["e"].isNotNull()), lambda x: x["i"])
    rows = rows.withColumn("_recent", F.slice("_lines", F.size("_lines") - F.size(F.filter(live, lambda i: i >= F.col("_n") - n)) + 1, n))
    note = F.nullif("discharge_summary", F.lit(""))
    full = F.concat_ws("\n\n", demo, adm, F.nullif(event_document(F.col("_lines")), F.lit("")), note)
    recent = F.concat_ws("\n\n", note, F.nullif(event_document(F.col("_recent")), F.lit("")))
    return rows.withColumns({"full_text": full, "recent_text": recent}).drop("_all", "_at", "_n", "_lines", "_recent")


def full_context(rows: DataFrame, budget: int = BUDGET, tokens: Tokens = BLANKS) -> DataFrame:
    return _prompt(rows, F.col("full_text"), "full_context", budget, tokens)


def recency(rows: DataFrame, n: int = 25, budget: int = BUDGET, tokens: Tokens = BLANKS) -> DataFrame:
    return _prompt(rows, F.col("recent_text"), f"recency_n{n}", budget, tokens)


def from_scores(rows: DataFrame, chunks: DataFrame, scored: DataFrame, method: str, k: int = 5, budget: int = BUDGET, tokens: Tokens = BLANKS) -> DataFrame:
    """Context of the k best chunks in reading order; without chunks the whole summary, as ``discharge_only``."""
    picked = top_k(scored, ["qa_id", "record_id"], k).join(chunks.select("record_id", "chunk_idx", "chunk"), ["record_id", "chunk_idx"])
    context = reading_order(picked, ["qa_id", "record_id"])
    joined = rows.join(context, ["qa_id", "record_id"], "left")
    name = F.when(F.col("context").isNull(), "discharge_only").otherwise(f"{method}_k{k}")
    return _prompt(joined, F.coalesce("context", "discharge_summary", F.lit("")), name, budget, tokens)


def bm25_prompts(rows: DataFrame, chunks: DataFrame, k: int = 5, budget: int = BUDGET, tokens: Tokens = BLANKS) -> DataFrame:
    """``rows`` has qa_id, record_id, question, discharge_summary; ``chunks`` record_id, chunk_idx, chunk."""
    scored = bm25(rows.select("qa_id", "record_id", "question"), chunks).withColumn("score", F.round("score", 9))
    return from_scores(rows, chunks, scored, "bm25", k, budget, tokens)


def semantic_prompts(rows: DataFrame, chunks: DataFrame, encode: Callable[[Column], Column], k: int = 5, budget: int = BUDGET, tokens: Tokens = BLANKS) -> DataFrame:
    """Ranked by cosine; vectors that are there (columns qv of ``rows`` and cv of ``chunks``) are taken, others made by ``encode``."""
    q = rows if "qv" in rows.columns else rows.withColumn("qv", encode(F.col("question")))
    c = chunks if "cv" in chunks.columns else chunks.withColumn("cv", encode(F.col("chunk")))
    scored = q.select("qa_id", "record_id", "qv").join(c.select("record_id", "chunk_idx", "cv"), "record_id").select("qa_id", "record_id", "chunk_idx", cosine(F.col("qv"), F.col("cv")).alias("score"))
    return from_scores(rows, chunks, scored, "semantic_rag", k, budget, tokens)


def learned_prompts(rows: DataFrame, chunks: DataFrame, scored: DataFrame, k: int = 5, budget: int = BUDGET, tokens: Tokens = BLANKS) -> DataFrame:
    """Ranked by the scores of a ranker: (qa_id, record_id, chunk_idx, score)."""
    return from_scores(rows, chunks, scored, "learned", k, budget, tokens)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"discharge_only": discharge_only, "full_context": full_context, "recency": recency, "bm25": bm25_prompts, "semantic_rag": semantic_prompts, "learned": learned_prompts}
