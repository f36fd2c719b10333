"""Deeply nested timeline records to flat, linked tables.

Every table comes from one projection of the nested rows: nested ``transform`` calls attach
the keys and positions of the ancestors, ``flatten`` joins the inner arrays and a single
``inline`` emits the rows, so no table needs a shuffle.

Keys: a demographics or admission row is named by (origin, record_id), a stay by (origin,
record_id, stay_idx) and an event by (origin, record_id, entry_idx), its place among the
record's non-null entries; an event also carries the stay and the group it was found in and
its place there.

Defined results for odd input: a null or empty array, a null entry, a null struct, or a
struct with only null fields gives no row; an entry without a type keeps a row in the event
table (type null) but is not counted as a child; extra columns of the input are ignored; an
empty input gives empty tables. A payload that is not one complete JSON value gives no row;
blanks and line ends around it don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_FIELDS = {
    "event_type": "string", "timestamp": "string", "end_time": "string", "label": "string", "value": "string",
    "valuenum": "double", "unit": "string", "flag": "string", "drug": "string", "dose": "string",
    "dose_unit": "string", "route": "string", "seq_num": "int", "icd_code": "string", "title": "string",
}
DEMOGRAPHIC_FIELDS = {
    "subject_id": "bigint", "gender": "string", "anchor_age": "int", "anchor_year": "int",
    "anchor_year_group": "string", "dod": "date",
}
ADMISSION_FIELDS = {
    "subject_id": "bigint", "hadm_id": "bigint", "admittime": "timestamp_ntz", "dischtime": "timestamp_ntz",
    "deathtime": "timestamp_ntz", "admission_type": "string", "admit_provider_id": "string",
    "admission_location": "string", "discharge_location": "string", "insurance": "string", "language": "string",
    "marital_status": "string", "race": "string",
}

_TEXT_EVENT = "struct<" + ",".join(f"`{f}`:string" for f in EVENT_FIELDS) + ">"
_BLANKS = " \t\r\n"  # what JSON allows around a value
_TOP = "subject_id STRING, hadm_id STRING, note_id STRING, demographics STRING, admission STRING, stays STRING, events STRING, _damaged STRING"


def _parse(column: str, kind: str) -> str:
    return f"from_json({column}, '{kind}', map('mode','PERMISSIVE'))"


def _typed(parsed: str) -> str:
    """SQL of an event struct with typed fields from one with text fields."""
    parts = [f"try_cast({parsed}.`{f}` AS {t}) AS `{f}`" for f, t in EVENT_FIELDS.items()]
    return f"struct({', '.join(parts)})"


def _located(array_sql: str, stay: str, group: str) -> str:
    """Array of events to array of (stay_idx, group_key, event_idx, event), null entries kept out."""
    return (
        f"transform(filter(transform({array_sql}, (e, i) -> struct({stay} AS stay_idx, {group} AS group_key, i AS event_idx, e AS event)),"
        f" x -> x.event IS NOT NULL), x -> struct(x.stay_idx, x.group_key, x.event_idx, {_typed('x.event')} AS event))"
    )


def _begins(text: str, sign: str) -> str:
    return f"startswith(trim(LEADING '{_BLANKS}' FROM {text}), '{sign}')"


def _list_of(text: str) -> str:
    """Events in JSON text that holds an array of them or just one."""
    return f"CASE WHEN {_begins(text, '[')} THEN {_parse(text, f'array<{_TEXT_EVENT}>')} WHEN {_begins(text, '{')} THEN array({_parse(text, _TEXT_EVENT)}) END"


def _none() -> str:
    event = "struct<" + ",".join(f"`{f}`:{t}" for f, t in EVENT_FIELDS.items()) + ">"
    return f"CAST(array() AS array<struct<stay_idx:int,group_key:string,event_idx:int,event:{event}>>)"


def raw_records(raw: DataFrame) -> DataFrame:
    """timeline_raw to (origin, record_id, demographics map, admission map, stays array, entries array)."""
    top = raw.select(
        F.lit("timeline_raw").alias("origin"),
        F.col("raw_id").cast("bigint").alias("record_id"),
        F.from_json("payload", _TOP, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"}).alias("top"),
        F.endswith(F.rtrim("payload", F.lit(_BLANKS)), F.lit("}")).alias("closed"),
    ).where("top IS NOT NULL AND top._damaged IS NULL AND closed")
    top = top.select("origin", "record_id", "top.*").drop("_damaged")
    flat = f"coalesce(CASE WHEN {_begins('events', '[')} THEN {_located(_parse('events', f'array<{_TEXT_EVENT}>'), 'CAST(NULL AS int)', 'CAST(NULL AS string)')} END, {_none()})"
    # An object holds lists (or single entries) by event type, unless it is itself one event.
    groups = f"CASE WHEN {_begins('events', '{')} THEN {_parse('events', 'map<string,string>')} END"
    top = top.withColumn("groups", F.expr(groups)).withColumn("groups", F.expr("IF(map_contains_key(groups, 'event_type'), map('', events), groups)"))
    grouped = f"coalesce(flatten(transform(map_entries(groups), g -> coalesce({_located(_list_of('g.value'), 'CAST(NULL AS int)', 'g.key')}, {_none()}))), {_none()})"
    top = top.withColumn("admission_map", F.expr(_parse("admission", "map<string,string>")))
    top = top.withColumn("stays", F.expr(_parse("coalesce(stays, admission_map['stays'])", "array<struct<stay_id:string,unit_name:string,events:string>>")))
    within = (
        f"coalesce(flatten(transform(filter(transform(stays, (s, k) -> struct(k, s)), p -> p.s.events IS NOT NULL),"
        f" p -> coalesce({_located(_list_of('p.s.events'), 'p.k', 'CAST(NULL AS string)')}, {_none()}))), {_none()})"
    )
    return top.select(
        "origin",
        "record_id",
        F.expr(_parse("demographics", "map<string,string>")).alias("demographics"),
        F.expr("map_filter(admission_map, (k, v) -> k <> 'stays')").alias("admission"),
        "stays",
        F.expr(f"concat({flat}, {grouped}, {within})").alias("entries"),
    )


def _any_value(struct: str, fields: list[str]) -> Column:
    return F.expr("coalesce(" + ", ".join(f"CAST({struct}.`{f}` AS string)" for f in fields) + ")").isNotNull()


def _struct_fields(df: DataFrame, column: str) -> list[str]:
    return [f.name for f in df.schema[column].dataType.fields]


def timeline_demographics(timelines: DataFrame, raw: DataFrame) -> DataFrame:
    """One row per record whose demographics object has a non-null field."""
    names = _struct_fields(timelines, "demographics")
    own = timelines.where(_any_value("demographics", names)).select(
        F.lit("patient_timelines").alias("origin"),
        F.col("record_id").cast("bigint").alias("record_id"),
        *[(F.col(f"demographics.{f}") if f in names else F.lit(None)).try_cast(t).alias(f) for f, t in DEMOGRAPHIC_FIELDS.items()],
    )
    other = raw_records(raw).where("size(filter(map_values(demographics), v -> v IS NOT NULL)) > 0")
    return own.unionByName(other.select("origin", "record_id", *[F.expr(f"try_cast(demographics['{f}'] AS {t})").alias(f) for f, t in DEMOGRAPHIC_FIELDS.items()]))


def timeline_admissions(timelines: DataFrame, raw: DataFrame) -> DataFrame:
    """One row per record whose admission object has a non-null field."""
    names = _struct_fields(timelines, "admission")
    own = timelines.where(_any_value("admission", names)).select(
        F.lit("patient_timelines").alias("origin"),
        F.col("record_id").cast("bigint").alias("record_id"),
        *[(F.col(f"admission.{f}") if f in names else F.lit(None)).try_cast(t).alias(f) for f, t in ADMISSION_FIELDS.items()],
    )
    other = raw_records(raw).where("size(filter(map_values(admission), v -> v IS NOT NULL)) > 0")
    return own.unionByName(other.select("origin", "record_id", *[F.expr(f"try_cast(admission['{f}'] AS {t})").alias(f) for f, t in ADMISSION_FIELDS.items()]))


def timeline_stays(timelines: DataFrame, raw: DataFrame) -> DataFrame:
    """One row per non-null stay a record lists, with its place there; records without a list of stays have none."""
    kept = "filter(transform(stays, (s, k) -> IF(s IS NULL, NULL, struct(k AS stay_idx, s.stay_id AS stay_id, s.unit_name AS unit_name))), x -> x IS NOT NULL)"
    return raw_records(raw).select("origin", "record_id", F.expr(f"inline({kept})"))


def _own_entries(timelines: DataFrame) -> DataFrame:
    """patient_timelines to (origin, record_id, entries), the entries as ``raw_records`` has them."""
    names = _struct_fields(timelines.select(F.col("events").getItem(0).alias("e")), "e")
    event = ", ".join(f"try_cast(e.`{f}` AS {t}) AS `{f}`" if f in names else f"CAST(NULL AS {t}) AS `{f}`" for f, t in EVENT_FIELDS.items())
    located = f"IF(e IS NULL, NULL, struct(CAST(NULL AS int) AS stay_idx, CAST(NULL AS string) AS group_key, i AS event_idx, struct({event}) AS event))"
    return timelines.select(
        F.lit("patient_timelines").alias("origin"),
        F.col("record_id").cast("bigint").alias("record_id"),
        F.expr(f"filter(transform(events, (e, i) -> {located}), x -> x IS NOT NULL)").alias("entries"),
    )


def timeline_event_rows(timelines: DataFrame, raw: DataFrame) -> DataFrame:
    """One row per non-null entry, with its record, its place among the record's entries, stay, group and place there."""
    fields = ", ".join("coalesce(x.event.event_type, nullif(x.group_key, '')) AS event_type" if f == "event_type" else f"x.event.`{f}` AS `{f}`" for f in EVENT_FIELDS)
    rows = f"inline(transform(entries, (x, n) -> struct(n AS entry_idx, x.stay_idx AS stay_idx, nullif(x.group_key, '') AS group_key, x.event_idx AS event_idx, {fields})))"
    return _own_entries(timelines).unionByName(raw_records(raw).select("origin", "record_id", "entries")).select("origin", "record_id", F.expr(rows))


def child_counts(timelines: DataFrame, raw: DataFrame) -> DataFrame:
    """(origin, record_id, child, n_rows): flat rows linked to each parent, by kind of child.

    The projection emits the keys of the rows of all tables at once, so every record is read
    and every payload parsed a single time.
    """
    whole = timelines.select(
        F.lit("patient_timelines").alias("origin"), F.col("record_id").cast("bigint").alias("record_id"), "events",
        _any_value("demographics", _struct_fields(timelines, "demographics")).alias("demo"), _any_value("admission", _struct_fields(timelines, "admission")).alias("adm"),
    )
    kinds = "filter(transform(events, e -> e.event_type), k -> k IS NOT NULL)"
    mine = whole.select("origin", "record_id", "demo", "adm", F.expr(kinds).alias("kinds"))
    raw_kinds = "filter(transform(entries, x -> coalesce(x.event.event_type, nullif(x.group_key, ''))), k -> k IS NOT NULL)"
    some = lambda c: f"coalesce(exists(map_values({c}), v -> v IS NOT NULL), false)"
    other = raw_records(raw).select("origin", "record_id", F.expr(some("demographics")).alias("demo"), F.expr(some("admission")).alias("adm"), F.expr(raw_kinds).alias("kinds"))
    children = "concat(IF(demo, array('demographics'), array()), IF(adm, array('admission'), array()), coalesce(kinds, array()))"
    rows = mine.unionByName(other).select("origin", "record_id", F.expr(f"inline(transform({children}, k -> struct(k AS child)))"))
    return rows.groupBy("origin", "record_id", "child").agg(F.count(F.lit(1)).alias("n_rows"))
