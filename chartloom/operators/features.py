"""The 166 features of a (question, chunk) pair, as native columns and one vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import text as T

SCALARS = ["embed_sim", "tfidf_sim", "lexical_overlap", "position", "log_length", "has_temporal_marker", "temporal_density", "has_critical_event", "has_abnormal_lab", "days_to_discharge", "is_within_24h", "is_within_1week", "has_no_timestamp"]
CROSSED = [("abnormal_lab", "labs"), ("abnormal_lab", "diagnosis"), ("critical_event", "diagnosis"), ("critical_event", "procedure"), ("within_24h", "medications"), ("within_24h", "labs"), ("temporal_marker", "labs"), ("temporal_marker", "diagnosis")]
SIGNAL = {"abnormal_lab": "has_abnormal_lab", "critical_event": "has_critical_event", "within_24h": "is_within_24h", "temporal_marker": "has_temporal_marker"}
PRECISION = ["content_word_overlap", "numeric_density", *T.HEADER_FLAGS]


def feature_names() -> list[str]:
    """Names in vector order."""
    return [
        *SCALARS,
        *[f"sec_{s}" for s in T.SECTIONS],
        *[f"qt_{t}" for t in T.QUESTION_TYPES],
        *[f"int_{s}_{t}" for s in T.SECTIONS for t in T.QUESTION_TYPES],
        *[f"int_{s}_x_{t}" for s, t in CROSSED],
        *PRECISION,
    ]


# Labels of the groups in reports, and how many places of the vector each takes in turn.
GROUPS = [
    (3, "Similarity"), (2, "Structural / Positional"), (4, "Text Signals (A)"), (4, "Temporal (B)"), (len(T.SECTIONS), "Section Identity"), (len(T.QUESTION_TYPES), "Question Type"),
    (len(T.SECTIONS) * len(T.QUESTION_TYPES), "Section × Q-Type"), (len(CROSSED), "Signal × Q-Type (C)"), (1, "Similarity"), (1, "Structural / Positional"), (len(T.HEADER_FLAGS), "Precision (D)"),
]


def feature_groups() -> list[str]:
    """The group of every place of the vector."""
    return [group for n, group in GROUPS for _ in range(n)]


def _have(rows: DataFrame, c: str, missing) -> Column:
    return F.coalesce(F.col(c), F.lit(missing)) if c in rows.columns else F.lit(missing)


def chunk_side(chunks: DataFrame) -> DataFrame:
    """``chunks`` (chunk, section, section_header, position, dischtime) with what depends on the chunk alone; a missing discharge time is neutral."""
    c = F.col("chunk")
    chunks = chunks.withColumns({"chunk_tokens": T.alnum_tokens(c), "_len": F.size(T.blank_tokens(c)), "_markers": T.count_matches(c, T.TEMPORAL_MARKER)})
    header = F.coalesce("section_header", F.lit(""))
    own = {
        "position": F.coalesce("position", F.lit(0.5)), "log_length": F.log1p("_len"),
        "has_temporal_marker": (F.col("_markers") > 0).cast("double"), "temporal_density": F.col("_markers") / F.greatest("_len", F.lit(1)),
        "has_critical_event": T.has_match(c, T.CRITICAL_EVENT), "has_abnormal_lab": T.has_match(c, T.ABNORMAL_LAB),
        **T.temporal_proximity(c, _have(chunks, "dischtime", None).cast("string")),
        "section": F.when(F.col("section").isin(*T.SECTIONS), F.col("section")).otherwise("other"), "numeric_density": T.numeric_density(c),
        **{name: T.has_match(header, p) for name, p in T.HEADER_FLAGS.items()},
    }
    return chunks.withColumns(own).drop("_len", "_markers")


def question_side(questions: DataFrame) -> DataFrame:
    """``questions`` with type and tokens."""
    return questions.withColumns({"qtype": T.question_type(F.col("question")), "question_tokens": T.alnum_tokens(F.col("question"))})


def pair_side(pairs: DataFrame) -> DataFrame:
    """Pairs of both sides with what depends on both; missing similarity columns count as 0."""
    q, c = F.col("question_tokens"), F.col("chunk_tokens")
    own = {"embed_sim": _have(pairs, "embed_sim", 0.0), "tfidf_sim": _have(pairs, "tfidf_sim", 0.0), "lexical_overlap": T.overlap_share(q, c), "content_word_overlap": T.overlap_share(q, c, T.STOPWORDS)}
    return pairs.withColumns(own).drop("question_tokens", "chunk_tokens")


def pair_features(pairs: DataFrame) -> DataFrame:
    """``pairs`` (question, chunk, section, section_header, position, dischtime, tfidf_sim, embed_sim) with scalar features.

    Where questions and chunks are at hand apart, ``question_side`` and ``chunk_side`` do
    their part once for each of them, and ``pair_side`` the rest after the join.
    """
    return pair_side(chunk_side(question_side(pairs)))


def _index(c: Column, names: list[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(n) for n in names]), c) - 1).cast("int")


def feature_array(rows: DataFrame) -> Column:
    """The dense vector of a row of ``pair_features`` as array<double>."""
    one = lambda hit: hit.cast("double")
    sections, kinds = F.array(*[F.lit(s) for s in T.SECTIONS]), F.array(*[F.lit(t) for t in T.QUESTION_TYPES])
    sec = F.transform(sections, lambda s: one(s == F.col("section")))
    qt = F.transform(kinds, lambda t: one(t == F.col("qtype")))
    cell = _index(F.col("section"), T.SECTIONS) * len(T.QUESTION_TYPES) + _index(F.col("qtype"), T.QUESTION_TYPES)
    grid = F.transform(F.sequence(F.lit(0), F.lit(len(T.SECTIONS) * len(T.QUESTION_TYPES) - 1)), lambda i: one(i == cell))
    crossed = [F.col(SIGNAL[s]) * one(F.col("qtype") == t) for s, t in CROSSED]
    return F.concat(F.array(*[F.col(c).cast("double") for c in SCALARS]), sec, qt, grid, F.array(*crossed), F.array(*[F.col(c).cast("double") for c in PRECISION]))


def active_features(rows: DataFrame) -> DataFrame:
    """(.., idx, value) of the non-zero entries: the sparse form of the vector."""
    return rows.select("*", F.posexplode(feature_array(rows)).alias("idx", "value")).where(F.col("value") != 0)


def linear_score(rows: DataFrame, weights: dict[str, float], intercept: float = 0.0) -> DataFrame:
    """``rows`` with score, the logistic of a weighted sum of named features; all on the JVM side."""
    names = feature_names()
    dense = F.array(*[F.lit(float(weights.get(n, 0.0))) for n in names])
    total = F.aggregate(F.zip_with(feature_array(rows), dense, lambda x, w: x * w), F.lit(float(intercept)), lambda s, x: s + x)
    return rows.withColumn("score", 1 / (1 + F.exp(-total)))
