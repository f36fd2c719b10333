"""Queries of the training-data problems on language-model text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartloom.llm import bpe, mixing, overlaps, pieces, qa_defects, splits, toxicity
from chartloom.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return qa_defects.unusable_answers(table(spark, d, "qa_pairs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.linked_pairs(table(spark, d, "qa_pairs"))


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "qa_pairs"), table(spark, d, "split_targets")).select("qa_id", "component", "split")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_report(table(spark, d, "qa_pairs"), table(spark, d, "split_targets"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.overlapping_pairs(table(spark, d, "qa_pairs")).select("qa_a", "qa_b")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.overlap_report(table(spark, d, "qa_pairs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized_records(table(spark, d, "patient_timelines"))


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized_pieces(table(spark, d, "patient_timelines"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.flagged_documents(table(spark, d, "documents"), table(spark, d, "content_labels"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score_documents(table(spark, d, "documents"), table(spark, d, "content_labels"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.source_rates(table(spark, d, "documents"), table(spark, d, "content_labels"))


QUERIES = {f.__name__: f for f in (p3_found, p5_found, p5_splits, p5_report, p6_found, p6_report, p7_found, p7_pieces, p8_ids, p9_mixture, p9_report, p10_found, p10_scores, p10_rates)}

ORACLES: dict[str, str] = {
    "p5_found": """
        WITH RECURSIVE e AS (SELECT DISTINCT a.subject_id AS a, b.subject_id AS b FROM qa_pairs a JOIN qa_pairs b USING (hadm_id) WHERE a.subject_id <> b.subject_id),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT a AS subject_a, b AS subject_b FROM r WHERE a < b
    """,
    "p7_found": """
        SELECT record_id, 'discharge_summary' AS oversized_field FROM patient_timelines WHERE length(discharge_summary) > 6000
        UNION
        SELECT record_id, 'events' FROM patient_timelines WHERE len(list_filter(events, lambda e: e IS NOT NULL)) > 150
    """,
}
