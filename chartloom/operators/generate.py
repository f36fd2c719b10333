"""Texts and calls for making question-answer pairs out of whole timelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.functions.tokens import BLANKS, Tokens
from chartloom.operators import infer

# Budget in tokens, what is kept free of events, and around a cut summary.
CONTEXT, RESERVE, SLACK, LEAST_SUMMARY = 12_000, 2_000, 200, 500
# Wording of the sections.
DEMOGRAPHICS = [("Gender", "gender"), ("Age at anchor", "anchor_age"), ("Anchor year group", "anchor_year_group"), ("Date of death", "dod")]
ADMISSION = [("Admit time", "admittime"), ("Discharge time", "dischtime"), ("Admission type", "admission_type"), ("Admission location", "admission_location"), ("Discharge location", "discharge_location"), ("Insurance", "insurance"), ("Race", "race")]
EVENTS_HEAD = "## Clinical Events (chronological)\n"


def _block(heading: str, struct: str, fields: list[tuple[str, str]], have: list[str]) -> Column:
    """A heading and one line a field, N/A for what is missing; null for a missing or hollow struct."""
    known = [f for _, f in fields if f in have]
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"- {name}: "), F.coalesce(F.col(f"{struct}.{f}").cast("string") if f in have else F.lit(None), F.lit("N/A"))) for name, f in fields])
    some = F.coalesce(*[F.col(f"{struct}.{f}").cast("string") for f in have]).isNotNull() if known else F.lit(False)
    return F.when(some, F.concat(F.lit(heading + "\n"), lines))


def _event_line(e: Column) -> Column:
    text = lambda f: F.coalesce(e[f].cast("string"), F.lit(""))
    ts, kind = F.concat(F.lit("["), text("timestamp"), F.lit("] ")), e["event_type"]
    reading = F.concat(text("label"), F.lit(" = "), text("value"), F.lit(" "), text("unit"))
    return (
        F.when(kind == "lab", F.trim(F.concat(ts, F.lit("LAB: "), reading, F.lit(" "), text("flag"))))
        .when(kind == "vital", F.trim(F.concat(ts, F.lit("VITAL: "), reading)))
        .when(kind == "medication", F.trim(F.concat(ts, F.lit("MED: "), text("drug"), F.lit(" "), text("dose"), F.lit(" "), text("dose_unit"), F.lit(" ("), text("route"), F.lit(") until "), text("end_time"))))
        .when(kind == "procedure", F.trim(F.concat(ts, F.lit("PROCEDURE: "), text("icd_code"), F.lit(" — "), text("title"))))
        .otherwise(F.concat(ts, F.upper(F.coalesce(kind, F.lit("unknown"))), F.lit(": "), F.to_json(e)))
    )


def generation_texts(records: DataFrame, tokens: Tokens = BLANKS, context: int = CONTEXT, reserve: int = RESERVE) -> DataFrame:
    """(record_id, text, n_kept, n_cut) of records with demographics, admission, events and discharge_summary.

    Events are kept in order until the first that would exceed the budget, the rest is
    counted in a closing line; a summary that doesn't fit is cut, if enough of it is left.
    Null structs, arrays and summaries leave their section out; a missing value is N/A in the
    blocks and empty in a line.
    """
    fields = lambda c: [f.name for f in records.schema[c].dataType.fields]
    live = F.filter(F.coalesce("events", F.array().cast(records.schema["events"].dataType)), lambda e: e.isNotNull())
    rows = records.select("record_id", _block("## Demographics", "demographics", DEMOGRAPHICS, fields("demographics")).alias("_d"), _block("## Admission", "admission", ADMISSION, fields("admission")).alias("_a"), live.alias("_e"), "discharge_summary")
    diagnosis = F.filter("_e", lambda e: F.coalesce(e["event_type"] == "diagnosis", F.lit(False)))
    one = lambda d: F.concat(F.lit("- ["), F.coalesce(d["seq_num"].cast("string"), F.lit("")), F.lit("] "), F.coalesce(d["icd_code"], F.lit("")), F.lit(" — "), F.coalesce(d["title"], F.lit("")))
    rows = rows.withColumn("_x", F.when(F.size(diagnosis) > 0, F.concat(F.lit("## Diagnoses\n"), F.array_join(F.transform(diagnosis, one), "\n"))))
    clinical = F.filter("_e", lambda e: ~F.coalesce(e["event_type"] == "diagnosis", F.lit(False)))
    rows = rows.withColumn("_lines", F.transform(clinical, _event_line)).drop("_e")
    rows = rows.withColumn("_base", tokens.count(F.concat(F.concat_ws("\n", "_d", "_a", "_x"), F.lit("\n\n" + EVENTS_HEAD))))
    flat = rows.select("record_id", "_base", F.posexplode("_lines").alias("_i", "_line"))
    flat = flat.withColumn("_n", tokens.count(F.concat("_line", F.lit("\n"))))
    w = Window.partitionBy("record_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    flat = flat.withColumn("_fits", F.col("_base") + F.sum("_n").over(w) <= context - reserve)
    kept = flat.groupBy("record_id").agg(F.count_if("_fits").alias("n_kept"), F.count_if(~F.col("_fits")).alias("n_cut"))
    rows = rows.join(kept, "record_id", "left").fillna(0, ["n_kept", "n_cut"])
    cut = F.when(F.col("n_cut") > 0, F.array(F.concat(F.lit("... ["), F.col("n_cut").cast("string"), F.lit(" more events truncated] ...")))).otherwise(F.array().cast("array<string>"))
    told = F.when(F.size("_lines") > 0, F.concat(F.lit(EVENTS_HEAD), F.array_join(F.concat(F.slice("_lines", 1, F.col("n_kept")), cut), "\n")))
    rows = rows.withColumn("_body", F.concat_ws("\n\n", "_d", "_a", "_x", told)).withColumn("_used", tokens.count(F.col("_body"))).withColumn("_s", F.coalesce("discharge_summary", F.lit("")))
    room = (F.lit(context - SLACK) - F.col("_used")).cast("int")
    cut_summary = F.when((F.col("_used") + tokens.count(F.col("_s")) > context) & (room > LEAST_SUMMARY), F.concat(tokens.cut(F.col("_s"), room), F.lit("\n... [discharge summary truncated]"))).otherwise(F.col("_s"))
    summary = F.when(F.col("_s") != "", F.concat(F.lit("## Discharge Summary\n"), cut_summary))
    return rows.select("record_id", F.concat_ws("\n\n", F.nullif("_body", F.lit("")), summary).alias("text"), "n_kept", "n_cut")


def generate_pairs(records: DataFrame, existing: DataFrame, answer_fn: Callable[[str, str], dict], system: str, model: str, tokens: Tokens = BLANKS) -> DataFrame:
    """Records of pairs (subject_id, hadm_id, qa_pairs, model, tokens_prompt, tokens_completion, error, raw) for stays not in ``existing``.

    A text that isn't JSON keeps its raw form and an error; failed calls keep their error.
    """
    new = records.join(existing.select("subject_id", "hadm_id").distinct(), ["subject_id", "hadm_id"], "left_anti")
    texts = new.select("record_id", "subject_id", "hadm_id").join(generation_texts(new, tokens), "record_id")
    asked = texts.select("subject_id", "hadm_id", F.lit(system).alias("system_prompt"), F.col("text").alias("user_prompt"))
    said = infer.answer_misses(asked, answer_fn).withColumn("_pairs", infer.unwrap_json(F.col("answer")))
    good = F.col("error").isNull() & F.exists("_pairs", lambda p: p.isNotNull() & p["question"].isNotNull())
    none = F.array().cast(said.schema["_pairs"].dataType) if hasattr(said.schema["_pairs"], "dataType") else F.array()
    return said.select(
        "subject_id", "hadm_id", F.when(good, F.col("_pairs")).otherwise(none).alias("qa_pairs"), F.lit(model).alias("model"), F.col("prompt_tokens").alias("tokens_prompt"), F.col("completion_tokens").alias("tokens_completion"),
        F.coalesce("error", F.when(~F.coalesce(good, F.lit(False)), "json_parse_error")).alias("error"), F.when(F.col("error").isNull() & ~F.coalesce(good, F.lit(False)), F.col("answer")).alias("raw"),
    )
