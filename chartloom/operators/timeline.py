"""Relational clinical tables to longitudinal records and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.functions.text import formatted

# Order in which event types are written, and their headings.
EVENT_ORDER = ["diagnosis", "lab", "vital", "medication", "procedure"]
TIE_ORDER = ["lab", "vital", "medication", "procedure", "diagnosis"]
EVENT_HEADERS = {
    "diagnosis": "CLINICAL DIAGNOSES:", "lab": "CLINICAL LABORATORY VALUES:", "vital": "CLINICAL VITAL SIGNS:",
    "medication": "CLINICAL MEDICATIONS ADMINISTERED:", "procedure": "CLINICAL PROCEDURES PERFORMED:",
}
GENERIC_FIELDS = ["timestamp", "end_time", "label", "value", "valuenum", "unit", "flag", "drug", "dose", "dose_unit", "route", "seq_num", "icd_code", "title"]


def keep_ids(fact: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``fact`` whose key is among ``ids``: one semi-join, however many ids; null keys drop."""
    return fact.join(ids.select(key).distinct(), key, "left_semi")


def dictionary_join(fact: DataFrame, dictionary: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a dictionary; the optimizer broadcasts it if its size allows."""
    return fact.join(dictionary, keys)


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the one last in ``order``; combines before the shuffle."""
    other = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*other), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*")


def event_rank(kind: Column, order: list[str]) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), kind), F.lit(0)).cast("int")


def sorted_events(events: Column) -> Column:
    """Events by time as text; ties in the order of the event types, then as delivered."""
    keyed = F.transform(F.filter(events, lambda e: e.isNotNull()), lambda e, i: F.struct(F.coalesce(e["timestamp"], F.lit("None")).alias("t"), event_rank(e["event_type"], TIE_ORDER).alias("r"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda k: k["e"])


def _first(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(formatted(c), F.lit("")) for c in cs], F.lit(""))


def event_line(kind: Column, ev) -> Column:
    """One line of text for an event; ``ev`` gives a column by field name."""
    value = _first(ev("value"), ev("valuenum"))
    lab = F.rtrim(F.concat(F.lit("  "), formatted(ev("timestamp")), F.lit("  "), _first(ev("label"), F.lit("unknown")), F.lit(": "), value, F.lit(" "), formatted(ev("unit"))))
    lab = F.concat(lab, F.when(formatted(ev("flag")) != "", F.concat(F.lit(" ["), formatted(ev("flag")), F.lit("]"))).otherwise(""))
    dose = F.when(formatted(ev("dose")) != "", F.rtrim(F.concat(F.lit(" "), formatted(ev("dose")), F.lit(" "), formatted(ev("dose_unit"))))).otherwise("")
    route = F.when(formatted(ev("route")) != "", F.concat(F.lit(" ("), formatted(ev("route")), F.lit(")"))).otherwise("")
    med = F.concat(F.lit("  "), formatted(ev("timestamp")), F.lit("  "), _first(ev("drug"), F.lit("unknown")), dose, route)
    vital = F.rtrim(F.concat(F.lit("  "), formatted(ev("timestamp")), F.lit("  "), _first(ev("label"), F.lit("unknown")), F.lit(": "), value, F.lit(" "), formatted(ev("unit"))))
    title = _first(ev("title"), ev("icd_code"))
    proc = F.rtrim(F.concat(F.lit("  "), formatted(ev("timestamp")), F.lit("  "), title))
    number = F.when(ev("seq_num").isNotNull(), F.concat(F.lit("  "), ev("seq_num").cast("string"), F.lit(". "))).otherwise("  - ")
    pairs = [F.when(formatted(ev(f)) != "", F.concat(F.lit(f"{f}="), formatted(ev(f)))) for f in GENERIC_FIELDS]
    other = F.concat(F.lit("  "), F.concat_ws(", ", *pairs))
    return F.when(kind == "lab", lab).when(kind == "medication", med).when(kind == "vital", vital).when(kind == "procedure", proc).when(kind == "diagnosis", F.concat(number, title)).otherwise(other)


def event_lines(events: Column) -> Column:
    """Array of (kind, line) of the non-null events: every line is written once."""
    live = F.filter(events, lambda e: e.isNotNull())
    return F.transform(live, lambda e: F.struct(e["event_type"].alias("kind"), event_line(e["event_type"], lambda f: e[f]).alias("line")))


def event_document(lines: Column) -> Column:
    """Lines of a record's events as text: a heading and lines per type in fixed order, other types after."""
    order = F.array(*[F.lit(k) for k in EVENT_ORDER])
    heads = F.create_map(*[F.lit(x) for kv in EVENT_HEADERS.items() for x in kv])
    present = F.array_distinct(F.transform(lines, lambda x: x["kind"]))
    kinds = F.concat(F.array_intersect(order, present), F.array_sort(F.filter(F.array_except(present, order), lambda k: k.isNotNull())))

    def block(kind: Column) -> Column:
        head = F.coalesce(F.try_element_at(heads, kind), F.concat(F.lit("CLINICAL "), F.upper(kind), F.lit(":")))
        return F.concat(head, F.lit("\n"), F.array_join(F.transform(F.filter(lines, lambda x: x["kind"] == kind), lambda x: x["line"]), "\n"))

    return F.array_join(F.transform(kinds, block), "\n\n")


def named_values(struct: str, fields: list[str], heading: str) -> Column:
    """Non-null fields of a struct as ``name: value`` lines under a heading; null if there are none."""
    lines = F.concat_ws("\n", *[F.when(F.col(f"{struct}.{f}").isNotNull(), F.concat(F.lit(f"  {f}: "), F.col(f"{struct}.{f}").cast("string"))) for f in fields])
    return F.when(lines != "", F.concat(F.lit(heading + "\n"), lines))


def token_budget(lines: DataFrame, keys: list[str], order: list[str], tokens: str, budget: int, base: int = 0) -> DataFrame:
    """Lines in order until the first that would exceed the budget; kept_lines and cut_lines per key come along."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = lines.withColumn("running", F.lit(base) + F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys)
    kept = (F.col("running") <= budget).cast("int")
    return rows.withColumn("cut_lines", F.sum(1 - kept).over(whole)).where(kept == 1)


def budget_counts(lines: DataFrame, keys: list[str], order: list[str], tokens: str, budget: int, base: int = 0) -> DataFrame:
    """(key, kept, cut): lines within and beyond the budget of every key, also of one that keeps none."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fits = (F.lit(base) + F.sum(tokens).over(w) <= budget).cast("int")
    return lines.withColumn("_fits", fits).groupBy(*keys).agg(F.sum("_fits").alias("kept"), F.sum(1 - F.col("_fits")).alias("cut"))


def assemble(driver: DataFrame, patients: DataFrame, admissions: DataFrame, notes: DataFrame, events: DataFrame) -> DataFrame:
    """One nested record per driver row (subject_id, hadm_id, note_id): latest patient, admission and note, events sorted.

    Only facts of the driver's stays and subjects are taken further than a semi-join; then
    dimensions are brought to one row per key before they are joined, and events are nested
    once per stay, so the driver is shuffled by stay only.
    """
    subjects, stays = driver.select("subject_id").distinct(), driver.select("hadm_id").distinct()
    patients, admissions = keep_ids(patients, subjects, "subject_id"), keep_ids(admissions, stays, "hadm_id")
    notes, events = keep_ids(notes, stays, "hadm_id"), keep_ids(events, stays, "hadm_id")
    demo = latest_per_key(patients, ["subject_id"], ["anchor_age"]).select("subject_id", F.struct("*").alias("demographics"))
    adm = latest_per_key(admissions, ["hadm_id"], ["admittime"]).select("hadm_id", F.struct("*").alias("admission"))
    note = notes.groupBy("hadm_id").agg(F.max_by("text", F.struct("charttime", "text")).alias("discharge_summary"))
    fields = [c for c in events.columns if c not in ("subject_id", "hadm_id")]
    nested = events.where("hadm_id IS NOT NULL").groupBy("hadm_id").agg(F.collect_list(F.struct(*fields)).alias("events"))
    joined = driver.join(demo, "subject_id", "left").join(adm, "hadm_id", "left").join(note, "hadm_id", "left").join(nested, "hadm_id", "left")
    return joined.withColumn("events", sorted_events(F.coalesce("events", F.array().cast(nested.schema["events"].dataType))))
