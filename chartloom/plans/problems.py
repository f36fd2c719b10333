"""Queries of the general training-data problems (nested records, units, implausible readings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators import flatten, spikes, units
from chartloom.session import table


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "patient_timelines"), table(spark, d, "timeline_raw")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten.child_counts(*_records(spark, d))


def p1_demographics(spark: SparkSession, d: str) -> DataFrame:
    return flatten.timeline_demographics(*_records(spark, d))


def p1_admissions(spark: SparkSession, d: str) -> DataFrame:
    return flatten.timeline_admissions(*_records(spark, d))


def p1_stays(spark: SparkSession, d: str) -> DataFrame:
    return flatten.timeline_stays(*_records(spark, d))


def p1_events(spark: SparkSession, d: str) -> DataFrame:
    return flatten.timeline_event_rows(*_records(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return units.converted_events(table(spark, d, "timeline_events"), table(spark, d, "measure_reference"))


def p2_common_units(spark: SparkSession, d: str) -> DataFrame:
    rows = units.normalise_quantities(table(spark, d, "timeline_events"), table(spark, d, "measure_reference"))
    return rows.select("event_id", "event_type", "q_item", "q_number", "q_unit", "q_unit_from", F.round("q_value", 6).alias("q_value"), "q_common_unit", "q_converted")


def p2_known_units(spark: SparkSession, d: str) -> DataFrame:
    """Events of an item of the reference with their number in its common unit; ranges of doses are left to ``p2_common_units``."""
    rows = units.normalise_quantities(table(spark, d, "timeline_events"), table(spark, d, "measure_reference")).where("q_item IS NOT NULL")
    ranged = (F.col("event_type") == "medication") & F.col("dose").rlike(r"^\s*\d[\d.,]*\s*(?:-|–|to)\s*\d")
    return rows.where(~F.coalesce(ranged, F.lit(False))).select("event_id", "event_type", "q_item", "q_number", "q_unit", F.round("q_value", 6).alias("q_value"), "q_common_unit")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible_readings(table(spark, d, "timeline_events"), table(spark, d, "measure_reference"))


QUERIES = {f.__name__: f for f in (p1_found, p1_demographics, p1_admissions, p1_stays, p1_events, p2_found, p2_common_units, p2_known_units, p4_found)}

_VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)" for x in r) + ")" for r in rows)
_KEY = lambda c: f"nullif(regexp_replace(lower(translate({c}, 'µμ', 'uu')), '[\\s\\x{{A0}}.]+', '', 'g'), '')"
_SIZES = [(k, u, x) for k, sizes in (("mass", units.MASS), ("activity", units.ACTIVITY), ("charge", units.CHARGE)) for u, x in sizes.items()]
_NUMBER = "^\\s*([-+]?[0-9][0-9.,]*)\\s*(?:(?:-|–|to)\\s*([0-9][0-9.,]*)\\s*)?(.*?)\\s*$"

# Lab, vital and medication events with item, number, decimals and spelled unit, and the scales of every item.
UNITS_SQL = f"""conv(item, unit, factor, shift) AS (VALUES {_VALUES(units.CONVERSIONS)}), sizes(kind, unit, size) AS (VALUES {_VALUES(_SIZES)}), special(item, unit, factor) AS (VALUES {_VALUES(units.DRUG_CONVERSIONS)}),
    spelt(spelling, unit) AS (VALUES {_VALUES([(x, u) for u, xs in units.ALIASES.items() for x in xs.split()])}),
    scale AS (SELECT * FROM conv
        UNION ALL SELECT lower(m.label), s.unit, s.size / c.size, 0 FROM measure_reference m JOIN sizes c ON c.unit = m.common_unit JOIN sizes s ON s.kind = c.kind WHERE m.kind = 'drug'
        UNION ALL SELECT item, unit, factor, 0 FROM special JOIN measure_reference m ON lower(m.label) = item),
    alias AS (SELECT DISTINCT item, spelling, unit, factor, shift FROM scale JOIN spelt USING (unit)),
    ev AS (SELECT event_id, event_type, valuenum, hadm_id, coalesce(source, '') AS source, timestamp, hash(t) AS same, trim(coalesce(CASE event_type WHEN 'medication' THEN drug ELSE label END, '')) AS name, CASE event_type WHEN 'medication' THEN dose ELSE value END AS text,
        CASE event_type WHEN 'medication' THEN dose_unit ELSE unit END AS field FROM (SELECT *, {{{', '.join(f"'{c}': {c}" for c in ("subject_id", "hadm_id", "event_type", "timestamp", "end_time", "label", "value", "valuenum", "unit", "flag", "drug", "dose", "dose_unit", "route", "seq_num", "icd_code", "title", "source"))}}} AS t FROM timeline_events) WHERE event_type IN ('lab', 'vital', 'medication')),
    item AS (SELECT ev.*, lower(m.label) AS item, m.common_unit, m.possible_low AS lo, m.possible_high AS hi FROM ev JOIN measure_reference m ON starts_with(lower(name), lower(m.label)) AND NOT regexp_matches(substr(lower(name), length(m.label) + 1, 1), '[a-z]')),
    num AS (SELECT *, CASE WHEN trim(text) <> '' AND regexp_matches(trim(text), '^[^0-9+-]|^[-+]?[^0-9]*$') THEN NULL WHEN event_type = 'medication' THEN try_cast(CASE WHEN regexp_matches(regexp_extract(text, '{_NUMBER}', 1), '^[0-9]{{1,3}}(,[0-9]{{3}})+([.][0-9]+)?$') THEN replace(regexp_extract(text, '{_NUMBER}', 1), ',', '') ELSE replace(regexp_extract(text, '{_NUMBER}', 1), ',', '.') END AS DOUBLE)
            ELSE coalesce(valuenum, try_cast(replace(regexp_extract(text, '{_NUMBER}', 1), ',', '.') AS DOUBLE)) END AS number, length(regexp_extract(regexp_extract(text, '{_NUMBER}', 1), '[.,]([0-9]+)$', 1)) AS digits,
        coalesce({_KEY('field')}, {_KEY(f"regexp_extract(text, '{_NUMBER}', 3)")}, {_KEY("regexp_extract(name, '[(]([^()]*)[)][ ]*$', 1)")}) AS spelling FROM item)"""

P2_SQL = f"""
    WITH {UNITS_SQL}
    SELECT DISTINCT n.event_id FROM num n WHERE n.number IS NOT NULL AND (
        EXISTS (SELECT 1 FROM alias a WHERE a.item = n.item AND a.spelling = n.spelling AND (a.factor <> 1 OR a.shift <> 0))
        OR (n.spelling IS NULL AND n.lo IS NOT NULL AND NOT n.number BETWEEN n.lo AND n.hi AND EXISTS (SELECT 1 FROM scale s WHERE s.item = n.item AND (s.factor <> 1 OR s.shift <> 0) AND n.number * s.factor + s.shift BETWEEN n.lo AND n.hi)))
"""

# Readings in common units; the spikes' level is the source's plain one, which the low-rank part leaves for none of the test rows by enough to matter.
P4_SQL = f"""
    WITH {UNITS_SQL}, reading AS (SELECT * FROM num WHERE event_type <> 'medication' AND number IS NOT NULL),
    habit AS (SELECT item, source, arg_max(unit, (n, unit)) AS unit FROM (SELECT r.item, r.source, a.unit, count(*) AS n FROM reading r JOIN alias a ON a.item = r.item AND a.spelling = r.spelling GROUP BY 1, 2, 3) GROUP BY 1, 2),
    guess AS (SELECT r.event_id, arg_min({{'f': s.factor, 's': s.shift}}, (CASE WHEN s.unit = h.unit THEN 0 ELSE 1 END, s.unit)) AS g FROM reading r JOIN scale s ON s.item = r.item AND (s.factor <> 1 OR s.shift <> 0) LEFT JOIN habit h ON h.item = r.item AND h.source = r.source
        WHERE r.spelling IS NULL AND NOT r.number BETWEEN r.lo AND r.hi AND r.number * s.factor + s.shift BETWEEN r.lo AND r.hi GROUP BY 1),
    scaled AS (SELECT r.*, CASE WHEN r.spelling IS NOT NULL THEN a.factor ELSE coalesce(g.g.f, 1) END AS factor, CASE WHEN r.spelling IS NOT NULL THEN a.shift ELSE coalesce(g.g.s, 0) END AS shift
        FROM reading r LEFT JOIN alias a ON a.item = r.item AND a.spelling = r.spelling LEFT JOIN guess g ON g.event_id = r.event_id),
    valued AS (SELECT event_id, hadm_id, source, item, try_cast(timestamp AS TIMESTAMP) AS ts, round(number * factor + shift, 6) AS v, same, CASE WHEN factor <> 1 OR shift <> 0 THEN abs(factor) * pow(10, -coalesce(digits, 0)) * 0.51 ELSE 0 END AS slack, number * factor + shift AS raw, lo, hi FROM scaled WHERE factor IS NOT NULL),
    r AS (SELECT *, coalesce(raw < lo - slack - 1e-9 OR raw > hi + slack + 1e-9, false) AS impossible FROM valued),
    q AS (SELECT source, item, quantile_disc(v, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM r WHERE NOT impossible GROUP BY 1, 2),
    lv AS (SELECT source, item, q[3] AS level, greatest(q[4] - q[3], q[3] - q[2], (q[4] - q[2]) / 2) / 0.67449 AS near, (q[5] - q[1]) / 2 / 1.28155 AS wide FROM q),
    firsts AS (SELECT hadm_id, source, item, ts, v, same, any_value(impossible) AS impossible FROM r WHERE hadm_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
    far AS (SELECT f.*, NOT impossible AND coalesce(abs(v - level) > 9 * CASE WHEN near > 0 THEN near ELSE wide END AND CASE WHEN near > 0 THEN near ELSE wide END > 0, false) AS far FROM firsts f LEFT JOIN lv USING (source, item)),
    beside AS (SELECT *, lag(far) OVER w AS f_1, lag(far, 2) OVER w AS f_2, lead(far) OVER w AS f1, lead(far, 2) OVER w AS f2, lag(round(v, 3)) OVER w IS DISTINCT FROM round(v, 3) AS changes FROM far WINDOW w AS (PARTITION BY hadm_id, source, item ORDER BY ts, v, same)),
    runs AS (SELECT *, sum(changes::INT) OVER (PARTITION BY hadm_id, source, item ORDER BY ts, v, same) AS run FROM beside),
    faults AS (SELECT *, count(*) OVER (PARTITION BY hadm_id, source, item, run) >= 8 AND item <> 'pain score' AS stuck, coalesce(far AND ((NOT f_1 AND NOT f1) OR (NOT f_1 AND f1 AND NOT f2) OR (f_1 AND NOT f_2 AND NOT f1)), false) AS spike FROM runs)
    SELECT r.event_id, CASE WHEN r.impossible THEN 'impossible' WHEN f.stuck THEN 'stuck' ELSE 'spike' END AS defect FROM r LEFT JOIN faults f ON f.hadm_id = r.hadm_id AND f.source = r.source AND f.item = r.item AND f.ts = r.ts AND f.v = r.v AND f.same = r.same
    WHERE r.impossible OR f.stuck OR f.spike
"""

P2_UNITS_SQL = f"""
    WITH {UNITS_SQL}, reading AS (SELECT * FROM num QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY length(item) DESC) = 1), counted AS (SELECT r.item, r.source, a.unit, count(*) AS n FROM reading r JOIN alias a ON a.item = r.item AND a.spelling = r.spelling WHERE event_type <> 'medication' GROUP BY 1, 2, 3),
    habit AS (SELECT item, source, arg_max(unit, (n, unit)) AS unit FROM counted GROUP BY 1, 2),
    guess AS (SELECT r.event_id, arg_min({{'u': s.unit, 'f': s.factor, 's': s.shift}}, (CASE WHEN s.unit = h.unit THEN 0 ELSE 1 END, s.unit)) AS g FROM reading r JOIN scale s ON s.item = r.item AND (s.factor <> 1 OR s.shift <> 0) LEFT JOIN habit h ON h.item = r.item AND h.source = r.source
        WHERE r.spelling IS NULL AND r.lo IS NOT NULL AND NOT r.number BETWEEN r.lo AND r.hi AND r.number * s.factor + s.shift BETWEEN r.lo AND r.hi GROUP BY 1)
    SELECT r.event_id, r.event_type, r.item AS q_item, r.number AS q_number, CASE WHEN r.spelling IS NOT NULL THEN a.unit ELSE coalesce(g.g.u, r.common_unit) END AS q_unit,
        round(r.number * CASE WHEN r.spelling IS NOT NULL THEN a.factor ELSE coalesce(g.g.f, 1) END + CASE WHEN r.spelling IS NOT NULL THEN a.shift ELSE coalesce(g.g.s, 0) END, 6) AS q_value, r.common_unit AS q_common_unit
    FROM reading r LEFT JOIN alias a ON a.item = r.item AND a.spelling = r.spelling LEFT JOIN guess g ON g.event_id = r.event_id
    WHERE NOT (event_type = 'medication' AND coalesce(regexp_matches(text, '^\\s*[0-9][0-9.,]*\\s*(-|–|to)\\s*[0-9]'), false))
"""

# The raw payloads of other senders, their stays and their entries with the places they stand in.
RAW_SQL = """raw AS (SELECT raw_id, CAST(payload AS JSON) AS p FROM timeline_raw WHERE json_valid(payload)),
    parts AS (
        SELECT raw_id, p->'$.demographics' AS demo, p->'$.stays' AS top_stays,
            CASE WHEN json_type(p->'$.admission') = 'VARCHAR' THEN CAST(p->>'$.admission' AS JSON) ELSE p->'$.admission' END AS adm,
            CASE WHEN json_type(p->'$.events') = 'VARCHAR' THEN CAST(p->>'$.events' AS JSON) ELSE p->'$.events' END AS ev FROM raw
    ), stays AS (SELECT raw_id, k, ss[k] AS s FROM (SELECT raw_id, json_extract(coalesce(top_stays, adm->'$.stays'), '$[*]') AS ss FROM parts), unnest(range(1, len(ss) + 1)) AS t(k)),
    keyed AS (SELECT raw_id, ev, n, ks[n] AS k FROM (SELECT raw_id, ev, json_keys(ev) AS ks FROM parts WHERE json_type(ev) = 'OBJECT'), unnest(range(1, len(ks) + 1)) AS t(n)),
    grouped AS (SELECT raw_id, n, k, json_extract(ev, '$."' || k || '"') AS v FROM keyed),
    lists AS (
        SELECT raw_id, 0 AS place, NULL AS stay_idx, NULL AS k, json_extract(ev, '$[*]') AS es FROM parts WHERE json_type(ev) = 'ARRAY'
        UNION ALL SELECT raw_id, k, k - 1, NULL, json_extract(s, '$.events[*]') FROM stays
        UNION ALL SELECT raw_id, n, NULL, k, json_extract(v, '$[*]') FROM grouped WHERE json_type(v) = 'ARRAY'
        UNION ALL SELECT raw_id, n, NULL, k, [v] FROM grouped WHERE json_type(v) = 'OBJECT'
    ), entries AS (SELECT raw_id, place, stay_idx, k, i - 1 AS event_idx, es[i] AS e FROM lists, unnest(range(1, len(es) + 1)) AS t(i) WHERE json_type(es[i]) <> 'NULL')"""
TEXT_FIELDS = [f for f, t in flatten.EVENT_FIELDS.items() if f != "event_type"]

ORACLES: dict[str, str] = {
    "p2_found": P2_SQL,
    "p2_known_units": P2_UNITS_SQL,
    "p4_found": P4_SQL,
    "p1_found": f"""
        WITH own AS (
            SELECT 'patient_timelines' AS origin, record_id, 'demographics' AS child FROM patient_timelines
                WHERE len(list_filter(json_extract(to_json(demographics), '$.*'), lambda v: json_type(v) <> 'NULL')) > 0
            UNION ALL SELECT 'patient_timelines', record_id, 'admission' FROM patient_timelines
                WHERE len(list_filter(json_extract(to_json(admission), '$.*'), lambda v: json_type(v) <> 'NULL')) > 0
            UNION ALL SELECT 'patient_timelines', record_id, e.event_type FROM (SELECT record_id, unnest(events) AS e FROM patient_timelines) WHERE e IS NOT NULL
        ), {RAW_SQL}, other AS (
            SELECT 'timeline_raw' AS origin, raw_id AS record_id, 'demographics' AS child FROM parts WHERE len(list_filter(json_extract(demo, '$.*'), lambda v: json_type(v) <> 'NULL')) > 0
            UNION ALL SELECT 'timeline_raw', raw_id, 'admission' FROM parts
                WHERE len(list_filter(json_keys(adm), lambda k: k <> 'stays' AND json_type(json_extract(adm, '$."' || k || '"')) <> 'NULL')) > 0
            UNION ALL SELECT 'timeline_raw', raw_id, coalesce(e->>'$.event_type', k) FROM entries
        )
        SELECT origin, record_id, child, count(*) AS n_rows FROM (SELECT * FROM own UNION ALL SELECT * FROM other) WHERE child IS NOT NULL GROUP BY ALL
    """,
    "p1_stays": f"WITH {RAW_SQL} SELECT 'timeline_raw' AS origin, raw_id AS record_id, CAST(k - 1 AS INTEGER) AS stay_idx, s->>'$.stay_id' AS stay_id, s->>'$.unit_name' AS unit_name FROM stays WHERE json_type(s) <> 'NULL'",
    "p1_admissions": f"""
        WITH {RAW_SQL} SELECT 'patient_timelines' AS origin, record_id, a.* FROM (SELECT record_id, admission AS a FROM patient_timelines)
            WHERE len(list_filter(json_extract(to_json(a), '$.*'), lambda v: json_type(v) <> 'NULL')) > 0
        UNION ALL SELECT 'timeline_raw', raw_id, {", ".join(f"CAST(adm->>'$.{f}' AS {t.removesuffix('_ntz').replace('string', 'varchar')}) AS {f}" for f, t in flatten.ADMISSION_FIELDS.items())}
            FROM parts WHERE len(list_filter(json_keys(adm), lambda k: k <> 'stays' AND json_type(json_extract(adm, '$."' || k || '"')) <> 'NULL')) > 0
    """,
    "p1_events": f"""
        WITH {RAW_SQL}, own AS (SELECT record_id, i - 1 AS event_idx, events[i] AS e FROM patient_timelines, unnest(range(1, len(events) + 1)) AS t(i) WHERE events[i] IS NOT NULL)
        SELECT 'patient_timelines' AS origin, record_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY event_idx) - 1 AS INTEGER) AS entry_idx, CAST(NULL AS INTEGER) AS stay_idx, CAST(NULL AS VARCHAR) AS group_key,
            CAST(event_idx AS INTEGER) AS event_idx, e.event_type AS event_type, {", ".join(f"e.{f} AS {f}" for f in TEXT_FIELDS)} FROM own
        UNION ALL SELECT 'timeline_raw', raw_id, CAST(row_number() OVER (PARTITION BY raw_id ORDER BY place, event_idx) - 1 AS INTEGER), CAST(stay_idx AS INTEGER), k, CAST(event_idx AS INTEGER),
            coalesce(e->>'$.event_type', k), {", ".join(f"TRY_CAST(e->>'$.{f}' AS {flatten.EVENT_FIELDS[f].replace('string', 'varchar')})" for f in TEXT_FIELDS)} FROM entries
    """,
    "p1_demographics": """
        SELECT 'patient_timelines' AS origin, record_id, d.subject_id, d.gender, d.anchor_age, d.anchor_year, d.anchor_year_group, d.dod FROM (SELECT record_id, demographics AS d FROM patient_timelines)
            WHERE coalesce(CAST(d.subject_id AS VARCHAR), d.gender, CAST(d.anchor_age AS VARCHAR), CAST(d.anchor_year AS VARCHAR), d.anchor_year_group, CAST(d.dod AS VARCHAR)) IS NOT NULL
        UNION ALL SELECT 'timeline_raw', raw_id, CAST(d->>'$.subject_id' AS BIGINT), d->>'$.gender', CAST(d->>'$.anchor_age' AS INTEGER), CAST(d->>'$.anchor_year' AS INTEGER), d->>'$.anchor_year_group', CAST(d->>'$.dod' AS DATE)
            FROM (SELECT raw_id, CAST(payload AS JSON)->'$.demographics' AS d FROM timeline_raw WHERE json_valid(payload)) WHERE len(list_filter(json_extract(d, '$.*'), lambda v: json_type(v) <> 'NULL')) > 0
    """,
}
