"""Notes to chunks: sliding windows over tokens, and sections found by their header lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.text import HEADER_LINE, blank_tokens, section_of, strip_blank

SIZE, STRIDE, MAX_SECTION = 200, 100, 200


def windows(tokens: Column, section: Column, header: Column, size: int = SIZE, stride: int = STRIDE) -> Column:
    """Array of (text, section, section_header, position, start) over token windows; none for no tokens."""
    n = F.size(tokens)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / stride).cast("int") + 1)
    starts = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda i: i * stride)
    return F.transform(
        starts,
        lambda s: F.struct(
            F.array_join(F.slice(tokens, s + 1, size), " ").alias("text"), section.alias("section"), header.alias("section_header"),
            (s / F.greatest(n - size, F.lit(1))).cast("double").alias("position"), s.cast("int").alias("start"),
        ),
    )


def fixed_chunks(notes: DataFrame, text: str, size: int = SIZE, stride: int = STRIDE) -> DataFrame:
    """``notes`` rows exploded to chunk_idx, text_chunk, section, section_header and position. No shuffle."""
    kept = [c for c in notes.columns if c != text]
    # Tokens are a column of their own: a lambda would split the text again for every window.
    rows = notes.select(*kept, blank_tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    w = windows(F.col("_t"), F.lit("other"), F.lit(""), size, stride)
    # The outer form keeps the optimizer from evaluating the windows once more as a filter.
    out = rows.select(*kept, F.posexplode_outer(w).alias("chunk_idx", "c")).where("chunk_idx IS NOT NULL")
    return out.select(*kept, "chunk_idx", F.col("c.text").alias("chunk"), "c.section", "c.section_header", "c.position")


def _with_sections(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with _s, an array of (header, body): a header line opens a section and is its first line.

    Lines are split once, header positions found once, and bodies sliced out between them, so
    the work is linear in the note.
    """
    rows = rows.withColumn("_lines", F.split(text, "\n"))
    at = F.filter(F.transform("_lines", lambda line, i: F.when(line.rlike(HEADER_LINE), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_at", F.concat(F.array(F.lit(0)), at)).withColumn("_to", F.concat(at, F.array(F.size("_lines"))))

    def section(k: Column) -> Column:
        start, stop = F.get("_at", k), F.get("_to", k)
        header = F.when(k == 0, F.lit("preamble")).otherwise(strip_blank(F.get("_lines", start)))
        return F.struct(header.alias("header"), F.array_join(F.slice("_lines", start + 1, stop - start), "\n").alias("body"))

    every = F.transform(F.sequence(F.lit(0), F.size("_at") - 1), section)
    return rows.withColumn("_s", F.filter(every, lambda s: strip_blank(s["body"]) != "")).drop("_lines", "_at", "_to")


def section_lines(notes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_no, header, section, body) of every non-empty section.

    The lines of a note stay in its own row, so nothing is shuffled.
    """
    rows = _with_sections(notes.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")), F.col("_text"))
    s = rows.select(key, F.posexplode_outer("_s").alias("section_no", "s")).where("section_no IS NOT NULL")
    header = F.regexp_replace("s.header", ":$", "")
    return s.select(key, "section_no", header.alias("header"), section_of(header).alias("section"), strip_blank(F.col("s.body")).alias("body"))


def section_chunks(notes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk_idx, chunk, section, section_header, position); fewer than three sections fall back to windows."""
    rows = notes.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = _with_sections(rows.withColumn("_t", blank_tokens(F.col("_text"))), F.col("_text"))

    def described(x: Column) -> Column:
        header = F.regexp_replace(x["header"], ":$", "")
        return F.struct(header.alias("header"), section_of(header).alias("section"), strip_blank(x["body"]).alias("body"), blank_tokens(x["body"]).alias("tokens"))

    rows = rows.select(key, "_t", F.transform("_s", described).alias("_s"))

    def pieces(x: Column) -> Column:
        whole = F.array(F.struct(x["body"].alias("text"), x["section"].alias("section"), x["header"].alias("section_header"), F.lit(0.0).alias("position"), F.lit(0).alias("start")))
        return F.when(F.size(x["tokens"]) > MAX_SECTION, windows(x["tokens"], x["section"], x["header"])).otherwise(whole)

    by_section = F.flatten(F.transform("_s", pieces))
    fallback = windows(F.col("_t"), F.lit("other"), F.lit(""))
    rows = rows.select(key, (F.size("_s") < 3).alias("_fixed"), F.when(F.size("_s") < 3, fallback).otherwise(by_section).alias("_c"))
    out = rows.select(key, "_fixed", F.size("_c").alias("_n"), F.posexplode_outer("_c").alias("chunk_idx", "c")).where("chunk_idx IS NOT NULL")
    position = F.when(F.col("_fixed"), F.col("c.position")).otherwise(F.col("chunk_idx") / F.greatest(F.col("_n") - 1, F.lit(1)))
    return out.select(key, "chunk_idx", F.col("c.text").alias("chunk"), "c.section", "c.section_header", position.cast("double").alias("position"))


def chunk_notes(notes: DataFrame, key: str, text: str, strategy: str = "section") -> DataFrame:
    if strategy == "section":
        return section_chunks(notes, key, text)
    if strategy == "fixed":
        return fixed_chunks(notes.select(key, text), text)
    raise ValueError(f"unknown chunking strategy: {strategy}")
