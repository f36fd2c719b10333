"""The engine's own operators as queries over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.functions import text as T
from chartloom.operators import chunk, features, infer, label, learn, report, retrieve, score
from chartloom.operators import timeline as tl
from chartloom.operators.units import item_of, reference_rows
from chartloom.session import materialise, table
from chartloom.sources.tables import result_key

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- relations shared by queries -----------------------------------------------------------

BLANK = T.BLANK
NOTES_SQL = """notes AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, hadm_id ORDER BY loaded_at DESC NULLS LAST, record_id DESC) AS rn
    FROM patient_timelines WHERE subject_id IS NOT NULL AND hadm_id IS NOT NULL) WHERE rn = 1)"""
ASKED_SQL = f"""{NOTES_SQL}, asked AS (SELECT q.qa_id, n.record_id, q.question, q.answer FROM qa_pairs q JOIN notes n USING (subject_id, hadm_id)
    WHERE regexp_matches(q.question, '[^' || '{BLANK[1:]}') AND regexp_matches(q.answer, '[^' || '{BLANK[1:]}'))"""
TOK = lambda c: f"list_filter(string_split_regex({c}, '{BLANK}+'), lambda x: x <> '')"
ALNUM = lambda c: f"regexp_extract_all(lower({c}), '[a-z0-9]+')"
STRIP = lambda c: f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"
FMT = lambda c: f"coalesce({STRIP(f'CAST({c} AS VARCHAR)')}, '')"


def notes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """``columns`` of the latest delivery of each stay's record; only they are read and shuffled."""
    rows = table(spark, d, "patient_timelines").where("subject_id IS NOT NULL AND hadm_id IS NOT NULL")
    kept = dict.fromkeys(["record_id", "loaded_at", *columns])
    return tl.latest_per_key(rows.select("subject_id", "hadm_id", *kept), ["subject_id", "hadm_id"], ["loaded_at", "record_id"])


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa_pairs").where((T.strip_blank(F.col("question")) != "") & (T.strip_blank(F.col("answer")) != ""))


def asked(spark: SparkSession, d: str, *columns: str, prepare=None) -> DataFrame:
    """Questions with ``columns`` of their record, after ``prepare`` has worked on the records."""
    n = notes(spark, d, *columns).select("subject_id", "hadm_id", "record_id", *columns)
    n = prepare(n) if prepare else n
    return questions(spark, d).select("qa_id", "subject_id", "hadm_id", "question", "answer").join(n, ["subject_id", "hadm_id"]).drop("subject_id", "hadm_id")


def note_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk.section_chunks(notes(spark, d, "discharge_summary"), "record_id", "discharge_summary")


def fixed_note_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk.fixed_chunks(notes(spark, d, "discharge_summary").select("record_id", "discharge_summary"), "discharge_summary")


# ---- scans, filters and joins --------------------------------------------------------------


@query("SELECT p.subject_id, p.gender, p.anchor_age, p.anchor_year FROM patients p WHERE p.subject_id IN (SELECT subject_id FROM qa_pairs)")
def scan_project_patients(spark, d):
    return tl.keep_ids(table(spark, d, "patients").select("subject_id", "gender", "anchor_age", "anchor_year"), table(spark, d, "qa_pairs"), "subject_id")


VITAL_ITEMS = ["heart rate", "systolic blood pressure", "diastolic blood pressure", "respiratory rate", "body temperature", "oxygen saturation", "body weight", "pain score", "urine output"]
# A label may carry further words after the name of its item.
ITEM_OF = lambda c, m: f"starts_with(lower(trim({c})), lower({m})) AND NOT regexp_matches(substr(lower(trim({c})), length({m}) + 1, 1), '[a-z]')"


@query(f"""SELECT i.item, count(*) AS n, count(valuenum) AS n_numbers FROM timeline_events e JOIN (SELECT unnest([{', '.join(repr(x) for x in VITAL_ITEMS)}]) AS item) i ON {ITEM_OF('e.label', 'i.item')} WHERE event_type = 'vital' GROUP BY 1""")
def vitals_item_filter(spark, d):
    """Readings of a constant list of items, whatever words follow the item's name."""
    rows = table(spark, d, "timeline_events").where("event_type = 'vital'").select(item_of(F.col("label"), VITAL_ITEMS).alias("item"), "valuenum")
    return rows.where("item IS NOT NULL").groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.count("valuenum").alias("n_numbers"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000) GROUP BY 1")
def batched_semi_join(spark, d):
    ids = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"))
    return tl.keep_ids(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), ids, "l_orderkey").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT e.event_id, e.hadm_id, e.label, m.kind, m.common_unit FROM timeline_events e JOIN measure_reference m ON {ITEM_OF('e.label', 'm.label')} WHERE e.event_type = 'lab' AND e.hadm_id IN (SELECT hadm_id FROM admissions)")
def labs_dict_join(spark, d):
    reference = table(spark, d, "measure_reference")
    names = sorted({r.label.lower() for r in reference_rows(reference)}, key=lambda x: (-len(x), x))
    labs = table(spark, d, "timeline_events").where("event_type = 'lab'").select("event_id", "hadm_id", "label", item_of(F.col("label"), names).alias("item"))
    joined = tl.dictionary_join(labs, reference.select(F.lower("label").alias("item"), "kind", "common_unit"), ["item"]).drop("item")
    return tl.keep_ids(joined, table(spark, d, "admissions"), "hadm_id")


@query("""WITH dict AS (SELECT icd_code, event_type, min(title) AS long_title FROM timeline_events WHERE icd_code IS NOT NULL AND title IS NOT NULL GROUP BY 1, 2)
    SELECT e.event_id, e.seq_num, d.long_title AS diagnosis_title FROM timeline_events e JOIN dict d USING (icd_code, event_type)""")
def dx_two_key_join(spark, d):
    ev = table(spark, d, "timeline_events").select("event_id", "icd_code", "event_type", "seq_num", "title")
    dictionary = ev.where("icd_code IS NOT NULL AND title IS NOT NULL").groupBy("icd_code", "event_type").agg(F.min("title").alias("diagnosis_title"))
    return tl.dictionary_join(ev.drop("title"), dictionary, ["icd_code", "event_type"]).select("event_id", "seq_num", "diagnosis_title")


@query("SELECT qa_id, subject_id, hadm_id FROM qa_pairs ORDER BY qa_id LIMIT 20")
def head_n_driver(spark, d):
    return table(spark, d, "qa_pairs").select("qa_id", "subject_id", "hadm_id").orderBy("qa_id").limit(20)


@query(f"WITH {NOTES_SQL} SELECT subject_id, hadm_id, record_id, length(discharge_summary) AS n_chars FROM notes")
def notes_latest_wins(spark, d):
    return notes(spark, d, "discharge_summary").select("subject_id", "hadm_id", "record_id", F.char_length("discharge_summary").cast("bigint").alias("n_chars"))


ADM_F = ["subject_id", "hadm_id", "admittime", "dischtime", "deathtime", "admission_type", "admit_provider_id", "admission_location", "discharge_location", "insurance", "language", "marital_status", "race"]


@query(f"SELECT {', '.join(ADM_F)} FROM admissions WHERE hadm_id IN (SELECT hadm_id FROM qa_pairs) ORDER BY admittime")
def admissions_scan(spark, d):
    return tl.keep_ids(table(spark, d, "admissions").select(*ADM_F), table(spark, d, "qa_pairs"), "hadm_id").orderBy("admittime")


@query("""WITH driver AS (SELECT DISTINCT subject_id, hadm_id, note_id FROM qa_pairs),
    demo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY anchor_age DESC NULLS LAST, anchor_year DESC NULLS LAST, gender DESC NULLS LAST, dod DESC NULLS LAST) rn FROM patients) WHERE rn = 1),
    adm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY admittime DESC NULLS LAST, dischtime DESC NULLS LAST, admission_type DESC NULLS LAST) rn FROM admissions WHERE hadm_id IS NOT NULL) WHERE rn = 1),
    ev AS (SELECT hadm_id, count(*) AS n, min(coalesce(timestamp, 'None')) AS lo, max(coalesce(timestamp, 'None')) AS hi FROM timeline_events WHERE hadm_id IS NOT NULL GROUP BY 1)
    SELECT driver.subject_id, driver.hadm_id, driver.note_id, demo.anchor_age, adm.admission_type, coalesce(ev.n, 0) AS n_events, ev.lo AS first_time, ev.hi AS last_time
    FROM driver LEFT JOIN demo ON driver.subject_id = demo.subject_id LEFT JOIN adm ON driver.hadm_id = adm.hadm_id LEFT JOIN ev ON driver.hadm_id = ev.hadm_id""")
def timeline_left_assembly(spark, d):
    driver = table(spark, d, "qa_pairs").select("subject_id", "hadm_id", "note_id").distinct()
    patients = tl.latest_per_key(table(spark, d, "patients"), ["subject_id"], ["anchor_age", "anchor_year", "gender", "dod"])
    admissions = tl.latest_per_key(table(spark, d, "admissions").where("hadm_id IS NOT NULL").drop("subject_id"), ["hadm_id"], ["admittime", "dischtime", "admission_type"])
    summaries = table(spark, d, "patient_timelines").select("hadm_id", F.col("discharge_summary").alias("text"), F.col("loaded_at").alias("charttime")).where("hadm_id IS NOT NULL")
    events = table(spark, d, "timeline_events").select("hadm_id", "event_type", "timestamp", "label", "value", "unit", "seq_num", "title")
    rows = tl.assemble(driver, patients, admissions, summaries, events)
    time = lambda i: F.coalesce(F.try_element_at("events", F.lit(i))["timestamp"], F.when(F.size("events") > 0, "None"))
    return rows.select("subject_id", "hadm_id", "note_id", "demographics.anchor_age", "admission.admission_type", F.size("events").cast("bigint").alias("n_events"), time(1).alias("first_time"), time(-1).alias("last_time"))


# ---- events as sequences and text ----------------------------------------------------------

TIE = " ".join(f"WHEN '{t}' THEN {i + 1}" for i, t in enumerate(tl.TIE_ORDER))
EVENTS_SQL = f"""{NOTES_SQL}, flat AS (SELECT record_id, i, e.* FROM (SELECT record_id, generate_subscripts(events, 1) AS i, unnest(events) AS e FROM notes) WHERE e IS NOT NULL),
    ev AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY coalesce(timestamp, 'None'), CASE event_type {TIE} ELSE 0 END, i) - 1 AS pos FROM flat)"""


def sorted_rows(spark: SparkSession, d: str) -> DataFrame:
    s = notes(spark, d, "events").select("record_id", tl.sorted_events(F.col("events")).alias("events"))
    return s.select("record_id", F.posexplode("events").alias("pos", "e")).select("record_id", F.col("pos").cast("bigint").alias("pos"), "e.*")


@query(f"WITH {EVENTS_SQL} SELECT record_id, pos, event_type, timestamp FROM ev")
def event_union_sorted(spark, d):
    return sorted_rows(spark, d).select("record_id", "pos", "event_type", "timestamp")


VALUE = f"coalesce(nullif({FMT('value')}, ''), nullif({FMT('valuenum')}, ''), '')"
TITLE = f"coalesce(nullif({FMT('title')}, ''), nullif({FMT('icd_code')}, ''), '')"
READING = f"rtrim('  ' || {FMT('timestamp')} || '  ' || coalesce(nullif({FMT('label')}, ''), 'unknown') || ': ' || {VALUE} || ' ' || {FMT('unit')})"
LINE_SQL = f"""CASE event_type WHEN 'lab' THEN {READING} || CASE WHEN {FMT('flag')} <> '' THEN ' [' || {FMT('flag')} || ']' ELSE '' END
    WHEN 'vital' THEN {READING}
    WHEN 'medication' THEN '  ' || {FMT('timestamp')} || '  ' || coalesce(nullif({FMT('drug')}, ''), 'unknown') || CASE WHEN {FMT('dose')} <> '' THEN rtrim(' ' || {FMT('dose')} || ' ' || {FMT('dose_unit')}) ELSE '' END
        || CASE WHEN {FMT('route')} <> '' THEN ' (' || {FMT('route')} || ')' ELSE '' END
    WHEN 'procedure' THEN rtrim('  ' || {FMT('timestamp')} || '  ' || {TITLE})
    WHEN 'diagnosis' THEN CASE WHEN seq_num IS NULL THEN '  - ' ELSE '  ' || seq_num || '. ' END || {TITLE} END"""


@query(f"SELECT event_id, {LINE_SQL} AS line FROM timeline_events")
def event_serialize_lines(spark, d):
    return table(spark, d, "timeline_events").select("event_id", tl.event_line(F.col("event_type"), F.col).alias("line"))


ORDER_CASE = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(tl.EVENT_ORDER))
HEAD_CASE = " ".join(f"WHEN '{t}' THEN '{h}'" for t, h in tl.EVENT_HEADERS.items())


@query(f"""WITH {EVENTS_SQL}, blocks AS (SELECT record_id, event_type, (CASE event_type {HEAD_CASE} END) || chr(10) || string_agg({LINE_SQL}, chr(10) ORDER BY pos) AS b FROM ev WHERE event_type IS NOT NULL GROUP BY record_id, event_type),
    docs AS (SELECT record_id, string_agg(b, chr(10) || chr(10) ORDER BY CASE event_type {ORDER_CASE} END) AS doc FROM blocks GROUP BY record_id)
    SELECT record_id, length(doc) AS n_chars, md5(doc) AS digest FROM docs""")
def event_document(spark, d):
    rows = notes(spark, d, "events").where("size(filter(events, e -> e IS NOT NULL)) > 0").select("record_id", tl.event_lines(tl.sorted_events(F.col("events"))).alias("lines"))
    return rows.select("record_id", tl.event_document(F.col("lines")).alias("doc")).select("record_id", F.char_length("doc").cast("bigint").alias("n_chars"), F.md5("doc").alias("digest"))


@query(f"WITH {EVENTS_SQL}, n AS (SELECT record_id, count(*) AS n FROM ev GROUP BY 1) SELECT record_id, pos, event_type FROM ev JOIN n USING (record_id) WHERE pos >= n - 25")
def recency_last_n(spark, d):
    s = notes(spark, d, "events").select("record_id", tl.sorted_events(F.col("events")).alias("events"))
    first = F.greatest(F.size("events") - 25, F.lit(0))
    rows = s.select("record_id", first.alias("first"), F.posexplode(F.slice("events", first + 1, 25)).alias("i", "e"))
    return rows.select("record_id", (F.col("first") + F.col("i")).cast("bigint").alias("pos"), "e.event_type")


@query(f"""WITH {EVENTS_SQL}, t AS (SELECT record_id, pos, len({TOK(f'({LINE_SQL})')}) AS n FROM ev WHERE event_type <> 'diagnosis'),
    r AS (SELECT *, sum(n) OVER (PARTITION BY record_id ORDER BY pos) AS running FROM t)
    SELECT record_id, count(*) FILTER (running <= 10000) AS kept, count(*) FILTER (running > 10000) AS cut FROM r GROUP BY 1""")
def running_token_budget(spark, d):
    """Lines of every record within the budget of 12,000 tokens less 2,000, and those beyond it; ``generation_texts`` has the text around them."""
    rows = sorted_rows(spark, d).where("event_type <> 'diagnosis'").withColumn("n", F.size(T.blank_tokens(tl.event_line(F.col("event_type"), F.col))))
    return tl.budget_counts(rows.select("record_id", "pos", "n"), ["record_id"], ["pos"], "n", 10_000)


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.ref') AS ref FROM events")
def generic_props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.ref").alias("ref"))


# ---- question-answer rows ------------------------------------------------------------------


@query("SELECT qa_id, unnest(source_types) AS source_type FROM qa_pairs")
def qa_explode_pairs(spark, d):
    return table(spark, d, "qa_pairs").select("qa_id", F.explode("source_types").alias("source_type"))


@query(f"WITH {ASKED_SQL} SELECT qa_id, record_id, question, answer FROM asked")
def qa_merge_inner(spark, d):
    return asked(spark, d).select("qa_id", "record_id", "question", "answer")


@query("SELECT qa_id FROM qa_pairs WHERE coalesce(correct, true)")
def qa_correct_filter(spark, d):
    return table(spark, d, "qa_pairs").where(F.coalesce("correct", F.lit(True))).select("qa_id")


@query("SELECT qa_id FROM qa_pairs WHERE source_types IS NULL OR list_contains(source_types, 'discharge_summary')")
def qa_grounded_filter(spark, d):
    return table(spark, d, "qa_pairs").where(F.col("source_types").isNull() | F.array_contains("source_types", "discharge_summary")).select("qa_id")


@query("""SELECT qa_id, 'existing' AS origin FROM qa_pairs WHERE source = 'generated' AND answer <> ''
    UNION ALL SELECT DISTINCT qa_id, 'new' FROM qa_pairs WHERE qa_id NOT IN (SELECT qa_id FROM qa_pairs WHERE source = 'generated' AND answer <> '')""")
def append_only_merge(spark, d):
    qa = table(spark, d, "qa_pairs")
    old = qa.where("source = 'generated'").select("qa_id", F.lit("existing").alias("origin"), "answer")
    return infer.append_only(old, qa.select("qa_id", F.lit("new").alias("origin"), "answer"), ["qa_id"], F.col("answer") != "").select("qa_id", "origin")


@query("SELECT subject_id, trim(question) AS question FROM qa_pairs WHERE split = 'train' INTERSECT SELECT subject_id, trim(question) FROM qa_pairs WHERE split = 'test'")
def question_key_intersect(spark, d):
    qa = table(spark, d, "qa_pairs").select("subject_id", F.trim("question").alias("question"), "split")
    return qa.where("split = 'train'").drop("split").intersect(qa.where("split = 'test'").drop("split"))


# ---- chunks --------------------------------------------------------------------------------

FIXED_SQL = f"""{NOTES_SQL}, tok AS (SELECT record_id, {TOK("coalesce(discharge_summary, '')")} AS t FROM notes),
    win AS (SELECT record_id, t, unnest(range(0, CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= 200 THEN 1 ELSE CAST(ceil((len(t) - 200) / 100.0) AS BIGINT) + 1 END)) AS chunk_idx FROM tok),
    fixed AS (SELECT record_id, chunk_idx, array_to_string(list_slice(t, chunk_idx * 100 + 1, chunk_idx * 100 + 200), ' ') AS chunk, chunk_idx * 100 / greatest(len(t) - 200, 1) AS position FROM win)"""


@query(f"WITH {FIXED_SQL} SELECT record_id, chunk_idx, round(position, 6) AS position, md5(chunk) AS digest FROM fixed")
def fixed_windows(spark, d):
    return fixed_note_chunks(spark, d).select("record_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.round("position", 6).alias("position"), F.md5("chunk").alias("digest"))


SECTION_CASE = " ".join(f"WHEN regexp_matches(header, '(?i){p}') THEN '{s}'" for p, s in T.SECTION_PATTERNS)
LINES_SQL = f"""{NOTES_SQL}, l AS (SELECT record_id, generate_subscripts(string_split(coalesce(discharge_summary, ''), chr(10)), 1) AS line_no, unnest(string_split(coalesce(discharge_summary, ''), chr(10))) AS line FROM notes),
    h AS (SELECT *, CASE WHEN regexp_matches(line, '{T.HEADER_LINE}') THEN 1 ELSE 0 END AS is_header FROM l),
    s AS (SELECT *, sum(is_header) OVER (PARTITION BY record_id ORDER BY line_no) AS sec FROM h),
    b AS (SELECT record_id, sec, CASE WHEN sec = 0 THEN 'preamble' ELSE regexp_replace({STRIP("arg_min(line, line_no)")}, ':$', '') END AS header, {STRIP("string_agg(line, chr(10) ORDER BY line_no)")} AS body FROM s GROUP BY record_id, sec),
    sections AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY sec) - 1 AS section_no, header, CASE {SECTION_CASE} ELSE 'other' END AS section, body FROM b WHERE body <> '')"""


@query(f"WITH {LINES_SQL} SELECT record_id, section_no, header, section, md5(body) AS digest FROM sections")
def section_split(spark, d):
    s = chunk.section_lines(notes(spark, d, "discharge_summary"), "record_id", "discharge_summary")
    return s.select("record_id", F.col("section_no").cast("bigint").alias("section_no"), "header", "section", F.md5("body").alias("digest"))


CHUNKS_SQL = f"""{LINES_SQL}, nsec AS (SELECT record_id, count(*) AS k FROM sections GROUP BY 1),
    st AS (SELECT s.*, {TOK('body')} AS t FROM sections s JOIN nsec USING (record_id) WHERE k >= 3),
    sw AS (SELECT *, unnest(range(0, CASE WHEN len(t) <= 200 THEN 1 ELSE CAST(ceil((len(t) - 200) / 100.0) AS BIGINT) + 1 END)) AS w FROM st),
    sc AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY section_no, w) - 1 AS chunk_idx, CASE WHEN len(t) > 200 THEN array_to_string(list_slice(t, w * 100 + 1, w * 100 + 200), ' ') ELSE body END AS chunk, section, header AS section_header, count(*) OVER (PARTITION BY record_id) AS n FROM sw),
    tok AS (SELECT record_id, {TOK("coalesce(discharge_summary, '')")} AS t FROM notes WHERE record_id NOT IN (SELECT record_id FROM nsec WHERE k >= 3)),
    win AS (SELECT record_id, t, unnest(range(0, CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= 200 THEN 1 ELSE CAST(ceil((len(t) - 200) / 100.0) AS BIGINT) + 1 END)) AS chunk_idx FROM tok),
    chunks AS (SELECT record_id, chunk_idx, chunk, section, section_header, chunk_idx / greatest(n - 1, 1) AS position FROM sc
        UNION ALL SELECT record_id, chunk_idx, array_to_string(list_slice(t, chunk_idx * 100 + 1, chunk_idx * 100 + 200), ' '), 'other', '', chunk_idx * 100 / greatest(len(t) - 200, 1) FROM win)"""


@query(f"WITH {CHUNKS_SQL} SELECT record_id, chunk_idx, section, section_header, round(position, 6) AS position, md5(chunk) AS digest FROM chunks")
def section_chunk_rows(spark, d):
    return note_chunks(spark, d).select("record_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "section", "section_header", F.round("position", 6).alias("position"), F.md5("chunk").alias("digest"))


FLAG_SQL = ", ".join(f"CAST(regexp_matches(header, '(?i){p}') AS INTEGER) AS {n}" for n, p in T.HEADER_FLAGS.items())


@query(f"WITH {LINES_SQL} SELECT header, section, count(*) AS n, {FLAG_SQL} FROM sections GROUP BY header, section")
def section_classify(spark, d):
    s = chunk.section_lines(notes(spark, d, "discharge_summary"), "record_id", "discharge_summary").groupBy("header", "section").agg(F.count(F.lit(1)).alias("n"))
    return s.select("header", "section", "n", *[T.has_match(F.col("header"), p).cast("int").alias(n) for n, p in T.HEADER_FLAGS.items()])


# ---- text signals --------------------------------------------------------------------------


@query(f"""SELECT doc_id, len({ALNUM('text')}) AS n_alnum, len({TOK('text')}) AS n_blank, round(ln(1 + len({TOK('text')})), 6) AS log_length,
    round(CASE WHEN len({TOK('text')}) = 0 THEN 0 ELSE len(list_filter({TOK('text')}, lambda x: regexp_matches(x, '^[0-9]'))) / len({TOK('text')}) END, 6) AS numeric_density FROM documents WHERE text IS NOT NULL""")
def tokenize_stats(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(T.alnum_tokens(t)).cast("bigint").alias("n_alnum"), F.size(T.blank_tokens(t)).cast("bigint").alias("n_blank"), F.round(F.log1p(F.size(T.blank_tokens(t))), 6).alias("log_length"), F.round(T.numeric_density(t), 6).alias("numeric_density"))


SIGNALS = f"""len(regexp_extract_all(text, '(?i){T.TEMPORAL_MARKER}')) AS n_temporal, CAST(regexp_matches(text, '(?i){T.CRITICAL_EVENT}') AS INTEGER) AS has_critical,
    CAST(regexp_matches(text, '(?i){T.ABNORMAL_LAB}') AS INTEGER) AS has_abnormal"""


@query(f"SELECT doc_id, {SIGNALS} FROM documents WHERE text IS NOT NULL")
def text_signal_flags(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.count_matches(t, T.TEMPORAL_MARKER).cast("bigint").alias("n_temporal"), T.has_match(t, T.CRITICAL_EVENT).cast("int").alias("has_critical"), T.has_match(t, T.ABNORMAL_LAB).cast("int").alias("has_abnormal"))


QTYPE_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(question), '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in T.QUESTION_KEYWORDS.items()) + " ELSE 'other' END"


@query(f"SELECT qa_id, {QTYPE_SQL} AS qtype FROM qa_pairs WHERE question IS NOT NULL")
def question_type(spark, d):
    return table(spark, d, "qa_pairs").where("question IS NOT NULL").select("qa_id", T.question_type(F.col("question")).alias("qtype"))


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _share_sql(q: str, c: str) -> str:
    return f"CASE WHEN len({q}) = 0 THEN 0 ELSE len(list_intersect({q}, {c})) / len({q}) END"


@query(f"""WITH t AS (SELECT qa_id, list_distinct({ALNUM('question')}) AS q, list_distinct({ALNUM('answer')}) AS a FROM qa_pairs WHERE question IS NOT NULL AND answer IS NOT NULL),
    u AS (SELECT *, list_filter(q, lambda x: NOT list_contains({STOP_SQL}, x)) AS qc FROM t)
    SELECT qa_id, round({_share_sql('q', 'a')}, 6) AS lexical, round({_share_sql('qc', 'a')}, 6) AS content FROM u""")
def lexical_overlap(spark, d):
    q, a = T.alnum_tokens(F.col("question")), T.alnum_tokens(F.col("answer"))
    return table(spark, d, "qa_pairs").where("question IS NOT NULL AND answer IS NOT NULL").select("qa_id", F.round(T.overlap_share(q, a), 6).alias("lexical"), F.round(T.overlap_share(q, a, T.STOPWORDS), 6).alias("content"))


SHARED = lambda a, b: f"list_sum(list_transform(list_distinct({a}), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x)))))"
F1 = lambda a, b, e: f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN {e} WHEN len({a}) = 0 OR len({b}) = 0 OR coalesce({SHARED(a, b)}, 0) = 0 THEN 0.0 ELSE 2.0 * {SHARED(a, b)} / (len({a}) + len({b})) END"


@query(f"""WITH t AS (SELECT qa_id, {ALNUM('question')} AS q, {ALNUM("coalesce(answer, '')")} AS a FROM qa_pairs WHERE question IS NOT NULL)
    SELECT qa_id, round({F1('q', 'a', '0.0')}, 6) AS f1_label, round({F1('a', 'a', '1.0')}, 6) AS f1_self FROM t""")
def token_f1_pairs(spark, d):
    q, a = F.col("q"), F.col("a")
    rows = table(spark, d, "qa_pairs").where("question IS NOT NULL").select("qa_id", T.alnum_tokens(F.col("question")).alias("q"), T.alnum_tokens(F.coalesce("answer", F.lit(""))).alias("a"))
    return rows.select("qa_id", F.round(T.token_f1(q, a)[2], 6).alias("f1_label"), F.round(T.token_f1(a, a, 1.0)[2], 6).alias("f1_self"))


@query(f"""WITH {EVENTS_SQL}, t AS (SELECT ev.record_id, pos, regexp_extract(ev.timestamp, '{T.TIMESTAMP}', 1) AS ts, CAST(n.admission.dischtime AS VARCHAR)[1:19] AS dt FROM ev JOIN notes n USING (record_id)),
    p AS (SELECT *, CASE WHEN length(ts) > 10 THEN try_strptime(ts, '%Y-%m-%d %H:%M:%S') ELSE try_strptime(ts, '%Y-%m-%d') END AS c, try_strptime(dt, '%Y-%m-%d %H:%M:%S') AS l FROM t),
    x AS (SELECT *, CASE WHEN ts <> '' AND c IS NOT NULL AND l IS NOT NULL THEN greatest(0, (epoch(l) - epoch(c)) / 86400.0) END AS days FROM p)
    SELECT record_id, pos, round(CASE WHEN days IS NULL THEN 0.5 ELSE least(days / 30.0, 1.0) END, 4) AS days_to_discharge, CASE WHEN days <= 1 THEN 1 ELSE 0 END AS is_within_24h,
    CASE WHEN days <= 7 THEN 1 ELSE 0 END AS is_within_1week, CASE WHEN days IS NULL THEN 1 ELSE 0 END AS has_no_timestamp FROM x""")
def temporal_proximity(spark, d):
    s = notes(spark, d, "admission", "events").select("record_id", F.date_format("admission.dischtime", "yyyy-MM-dd HH:mm:ss").alias("dt"), tl.sorted_events(F.col("events")).alias("events"))
    rows = s.select("record_id", "dt", F.posexplode("events").alias("pos", "e"))
    out = T.temporal_proximity(F.coalesce(F.col("e.timestamp"), F.lit("")), F.col("dt"))
    return rows.select("record_id", F.col("pos").cast("bigint").alias("pos"), F.round(out["days_to_discharge"], 4).alias("days_to_discharge"), *[out[k].cast("int").alias(k) for k in ("is_within_24h", "is_within_1week", "has_no_timestamp")])


# ---- labels, sampling, splits ---------------------------------------------------------------

PAIRS_SQL = f"{ASKED_SQL}, {CHUNKS_SQL.replace(NOTES_SQL + ', ', '')}, pairs AS (SELECT a.qa_id, a.record_id, a.question, a.answer, c.chunk_idx, c.chunk, c.section, c.section_header FROM asked a JOIN chunks c USING (record_id))"
FAST_F1 = f"""tq AS (SELECT qa_id, unnest({ALNUM('answer')}) AS term FROM asked), ta AS (SELECT qa_id, term, count(*) AS n FROM tq GROUP BY 1, 2), la AS (SELECT qa_id, sum(n) AS len_a FROM ta GROUP BY 1),
    tc AS (SELECT record_id, chunk_idx, unnest({ALNUM('chunk')}) AS term FROM chunks), cc AS (SELECT record_id, chunk_idx, term, count(*) AS n FROM tc GROUP BY 1, 2, 3), lc AS (SELECT record_id, chunk_idx, sum(n) AS len_c FROM cc GROUP BY 1, 2),
    hit AS (SELECT a.qa_id, cc.chunk_idx, sum(least(ta.n, cc.n)) AS shared FROM asked a JOIN ta USING (qa_id) JOIN cc ON cc.record_id = a.record_id AND cc.term = ta.term GROUP BY 1, 2),
    labelled AS (SELECT p.*, CASE WHEN coalesce(2.0 * shared / (len_a + len_c), 0) >= 0.15 THEN 1 ELSE 0 END AS label FROM pairs p LEFT JOIN hit USING (qa_id, chunk_idx) LEFT JOIN la USING (qa_id) LEFT JOIN lc USING (record_id, chunk_idx))"""


def labelled_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every question with every chunk of its own record: a join by record, never over records."""
    chunks = materialise(note_chunks(spark, d).withColumn("chunk_tokens", T.alnum_tokens(F.col("chunk"))), "chunks")
    return label.label_pairs(asked(spark, d).withColumn("answer_tokens", T.alnum_tokens(F.col("answer"))), chunks)


@query(f"WITH {PAIRS_SQL}, {FAST_F1} SELECT qa_id, chunk_idx, label FROM labelled")
def weak_labels(spark, d):
    return labelled_pairs(spark, d).select("qa_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "label")


ENTITY_SQL = "[" + ", ".join(f"'{e}'" for e in T.ENTITIES) + "]"


@query(f"""WITH {PAIRS_SQL}, {FAST_F1} SELECT qa_id, chunk_idx, CASE WHEN label = 1 OR (section IN ('labs', 'vitals', 'medications', 'results') AND regexp_matches(chunk, '(?i){T.MEASUREMENT}')
    AND len(list_intersect(list_intersect(regexp_extract_all(lower(question), '[a-z]+'), {ENTITY_SQL}), regexp_extract_all(lower(chunk), '[a-z]+'))) > 0) THEN 1 ELSE 0 END AS label FROM labelled""")
def entity_boost_labels(spark, d):
    rows = labelled_pairs(spark, d)
    boost = label.entity_boost(F.col("question"), F.col("chunk"), F.col("section"))
    return rows.select("qa_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), ((F.col("label") == 1) | boost).cast("int").alias("label"))


@query(f"""WITH {PAIRS_SQL}, {FAST_F1}, k AS (SELECT qa_id, chunk_idx, label, sum(label) OVER (PARTITION BY qa_id) AS pos, row_number() OVER (PARTITION BY qa_id, label ORDER BY sha256(qa_id || ':' || chunk_idx || '|42')) AS r FROM labelled)
    SELECT qa_id, chunk_idx, label FROM k WHERE pos > 0 AND (label = 1 OR r <= 5 * pos)""")
def negative_sampling(spark, d):
    rows = labelled_pairs(spark, d).select("qa_id", "chunk_idx", "label")
    kept = label.sample_negatives(rows, ["qa_id"], F.concat_ws(":", F.col("qa_id").cast("string"), F.col("chunk_idx").cast("string")))
    return kept.select("qa_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "label")


SPLIT_SQL = """WITH k AS (SELECT {key}, row_number() OVER (ORDER BY sha256({key} || '|42')) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {table} WHERE {key} IS NOT NULL))
    SELECT {key}, CASE WHEN r <= CAST(floor(n * 0.85) AS BIGINT) THEN 'train' ELSE 'validation' END AS part FROM k"""


@query(SPLIT_SQL.format(key="record_id", table="patient_timelines"))
def record_split(spark, d):
    return label.hash_split(table(spark, d, "patient_timelines"), "record_id")


@query(SPLIT_SQL.format(key="subject_id", table="patient_timelines"))
def subject_split(spark, d):
    return label.hash_split(table(spark, d, "patient_timelines"), "subject_id")


# ---- retrieval -----------------------------------------------------------------------------

BM25_SQL = f"""{ASKED_SQL}, {FIXED_SQL.replace(NOTES_SQL + ', ', '')},
    terms AS (SELECT record_id, chunk_idx, {TOK('lower(chunk)')} AS t FROM fixed), stats AS (SELECT record_id, count(*) AS n, avg(len(t)) AS avgdl FROM terms GROUP BY 1),
    ex AS (SELECT record_id, chunk_idx, len(t) AS dl, unnest(t) AS term FROM terms), post AS (SELECT record_id, chunk_idx, dl, term, count(*) AS tf FROM ex GROUP BY ALL),
    df AS (SELECT record_id, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw, avgdl FROM post JOIN stats USING (record_id) GROUP BY record_id, term, n, avgdl),
    fl AS (SELECT record_id, 0.25 * avg(raw) AS floor FROM df GROUP BY 1), idf AS (SELECT record_id, term, avgdl, CASE WHEN raw < 0 THEN floor ELSE raw END AS idf FROM df JOIN fl USING (record_id)),
    qx AS (SELECT qa_id, record_id, unnest({TOK('lower(question)')}) AS term FROM asked), qt AS (SELECT qa_id, record_id, term, count(*) AS times FROM qx GROUP BY ALL),
    hits AS (SELECT qa_id, record_id, chunk_idx, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM post JOIN idf USING (record_id, term) JOIN qt USING (record_id, term) GROUP BY ALL),
    scored AS (SELECT a.qa_id, a.record_id, t.chunk_idx, coalesce(h.score, 0) AS score FROM asked a JOIN terms t USING (record_id) LEFT JOIN hits h ON h.qa_id = a.qa_id AND h.record_id = a.record_id AND h.chunk_idx = t.chunk_idx)"""


def bm25_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Scores of every question with every window of its record, and the windows."""
    windows = materialise(fixed_note_chunks(spark, d).select("record_id", "chunk_idx", "chunk"), "windows")
    return retrieve.bm25(asked(spark, d).select("qa_id", "record_id", "question"), windows), windows


@query(f"WITH {BM25_SQL} SELECT qa_id, chunk_idx, round(score, 5) AS score FROM scored")
def bm25_scores(spark, d):
    return bm25_rows(spark, d)[0].select("qa_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.round("score", 5).alias("score"))


@query(f"""WITH {BM25_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY round(score, 9) DESC, chunk_idx DESC) AS rank FROM scored)
    SELECT r.qa_id, r.record_id, count(*) AS n_chunks, md5(string_agg(f.chunk, chr(10) || chr(10) ORDER BY r.chunk_idx)) AS digest FROM r JOIN fixed f USING (record_id, chunk_idx) WHERE rank <= 5 GROUP BY 1, 2""")
def bm25_topk_context(spark, d):
    scored, chunks = bm25_rows(spark, d)
    picked = retrieve.top_k(scored.withColumn("score", F.round("score", 9)), ["qa_id", "record_id"], 5)
    out = retrieve.reading_order(picked.join(chunks, ["record_id", "chunk_idx"]), ["qa_id", "record_id"])
    return out.select("qa_id", "record_id", "n_chunks", F.md5("context").alias("digest"))


WORDS2 = lambda c: f"regexp_extract_all(lower({c}), '[a-z0-9_]{{2,}}')"
GRAMS = lambda w: f"list_concat({w}, list_transform(range(1, greatest(len({w}), 1)), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
VOCAB_SQL = f"""dw AS (SELECT doc_id, {WORDS2('text')} AS w FROM documents), dt AS (SELECT row_number() OVER () AS rid, {GRAMS('w')} AS t FROM dw), ex AS (SELECT rid, unnest(t) AS term FROM dt),
    vocab AS (SELECT term, count(DISTINCT rid) AS df, count(*) AS total, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(DISTINCT rid))) + 1 AS idf FROM ex GROUP BY term HAVING count(DISTINCT rid) >= 2 ORDER BY total DESC, term LIMIT 20000)"""


@query(f"WITH {VOCAB_SQL} SELECT term, df, CAST(total AS BIGINT) AS total, round(idf, 6) AS idf FROM vocab")
def tfidf_vocab(spark, d):
    return retrieve.tfidf_vocabulary(table(spark, d, "documents"), "text").select("term", "df", F.col("total").cast("bigint").alias("total"), F.round("idf", 6).alias("idf"))


@query(f"""WITH {VOCAB_SQL}, src AS (SELECT qa_id, 'q' AS side, {WORDS2('question')} AS w FROM qa_pairs WHERE question IS NOT NULL AND answer IS NOT NULL UNION ALL SELECT qa_id, 'a', {WORDS2('answer')} FROM qa_pairs WHERE question IS NOT NULL AND answer IS NOT NULL),
    g AS (SELECT qa_id, side, unnest({GRAMS('w')}) AS term FROM src), tf AS (SELECT qa_id, side, term, (1 + ln(count(*))) * any_value(idf) AS w FROM g JOIN vocab USING (term) GROUP BY 1, 2, 3),
    nm AS (SELECT qa_id, side, sqrt(sum(w * w)) AS norm FROM tf GROUP BY 1, 2), v AS (SELECT tf.qa_id, tf.side, term, w / norm AS w FROM tf JOIN nm USING (qa_id, side)),
    s AS (SELECT a.qa_id, round(sum(a.w * b.w), 5) AS similarity FROM v a JOIN v b ON a.qa_id = b.qa_id AND a.term = b.term WHERE a.side = 'q' AND b.side = 'a' GROUP BY 1)
    SELECT qa_id, coalesce(similarity, 0) AS similarity FROM qa_pairs LEFT JOIN s USING (qa_id) WHERE question IS NOT NULL AND answer IS NOT NULL""")
def tfidf_cosine(spark, d):
    """Similarity of question and answer of every row that has both; 0 where they share no term."""
    vocabulary = materialise(retrieve.tfidf_vocabulary(table(spark, d, "documents"), "text"), "vocabulary")
    qa = table(spark, d, "qa_pairs").where("question IS NOT NULL AND answer IS NOT NULL")
    q = retrieve.tfidf_vectors(qa, ["qa_id"], "question", vocabulary)
    a = retrieve.tfidf_vectors(qa, ["qa_id"], "answer", vocabulary).withColumnRenamed("weight", "other")
    sums = q.join(a, ["qa_id", "term"]).groupBy("qa_id").agg(F.round(F.sum(F.col("weight") * F.col("other")), 5).alias("similarity"))
    return qa.select("qa_id").join(sums, "qa_id", "left").fillna(0.0, ["similarity"])


COSINE_SQL = """sims AS (SELECT q.vec_id AS query_id, q.label AS query_label, i.vec_id AS item_id, i.label AS item_label, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0 AND i.vec_id <> q.vec_id)"""


def neighbours(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Every hundredth vector against all vectors, itself left out."""
    e = table(spark, d, "embeddings")
    found = retrieve.nearest(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("item_id"), "embedding"), k + 1)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.where("query_id <> item_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@query(f"WITH {COSINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM sims) SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM r WHERE rank <= 10")
def cosine_topk(spark, d):
    return neighbours(spark, d, 10).select("query_id", "item_id", "rank", F.round("score", 5).alias("score"))


RECALL_SQL = """WITH {cosine}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank, CASE WHEN query_label = item_label THEN 1 ELSE 0 END AS label FROM sims),
    p AS (SELECT query_id, sum(label) AS n_pos FROM r GROUP BY 1), k AS (SELECT unnest([1, 3, 5, 10]) AS k),
    h AS (SELECT k.k, r.query_id, sum(CASE WHEN rank <= k.k THEN label ELSE 0 END) AS hits FROM r, k GROUP BY 1, 2)
    SELECT k, round(avg(CASE WHEN n_pos > 0 THEN hits / n_pos ELSE 0 END), 6) AS recall, count(*) AS n_questions FROM h JOIN p USING (query_id) WHERE n_pos > {least} GROUP BY k"""


def _recall(spark: SparkSession, d: str, skip: bool) -> DataFrame:
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    q = labels.where("vec_id % 100 = 0").join(sizes, "label").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), (F.col("n") - 1).alias("n_pos"))
    near = neighbours(spark, d, 10).join(labels.select(F.col("vec_id").alias("item_id"), F.col("label").alias("item_label")), "item_id").join(q, "query_id")
    ks = [1, 3, 5, 10]
    by = near.groupBy("query_id", "n_pos").agg(*[F.sum(((F.col("rank") <= k) & (F.col("query_label") == F.col("item_label"))).cast("int")).alias(f"h{k}") for k in ks])
    rows = (by.where("n_pos > 0") if skip else by).select("n_pos", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("h")) for k in ks])).alias("x"))
    return rows.groupBy("x.k").agg(F.round(F.avg(F.when(F.col("n_pos") > 0, F.col("x.h") / F.col("n_pos")).otherwise(0.0)), 6).alias("recall"), F.count(F.lit(1)).alias("n_questions"))


@query(RECALL_SQL.format(cosine=COSINE_SQL, least=0))
def recall_at_k_sampled(spark, d):
    return _recall(spark, d, True)


@query(RECALL_SQL.format(cosine=COSINE_SQL, least=-1))
def recall_at_k_full_pool(spark, d):
    return _recall(spark, d, False)


PROMPT_SQL = f"""SELECT qa_id, record_id, len(ctx) AS context_tokens, md5('### Patient Context' || chr(10) || chr(10) || (CASE WHEN len(t) <= room THEN full_text ELSE array_to_string(ctx, ' ') END) || chr(10) || chr(10) || '### Question' || chr(10) || chr(10) || question) AS digest
    FROM (SELECT *, list_slice(t, 1, room) AS ctx FROM (SELECT *, {TOK('full_text')} AS t, greatest(4096 - 5 - len({TOK('question')}), 0) AS room FROM full_rows))"""


def _digest(rows: DataFrame) -> DataFrame:
    return rows.select("qa_id", "record_id", F.col("context_tokens").cast("bigint").alias("context_tokens"), F.md5("user_prompt").alias("digest"))


@query(f"WITH {ASKED_SQL}, full_rows AS (SELECT a.qa_id, a.record_id, a.question, coalesce(n.discharge_summary, '') AS full_text FROM asked a JOIN notes n USING (record_id)) {PROMPT_SQL}")
def discharge_only_prompt(spark, d):
    return _digest(retrieve.discharge_only(asked(spark, d, "discharge_summary")))


DOC_SQL = f"""blocks AS (SELECT record_id, event_type, (CASE event_type {HEAD_CASE} END) || chr(10) || string_agg({LINE_SQL}, chr(10) ORDER BY i) AS b FROM pick WHERE event_type IS NOT NULL GROUP BY record_id, event_type),
    docs AS (SELECT record_id, string_agg(b, chr(10) || chr(10) ORDER BY CASE event_type {ORDER_CASE} END) AS doc FROM blocks GROUP BY record_id)"""


@query(f"""WITH {ASKED_SQL}, flat0 AS (SELECT record_id, len(events) AS n, generate_subscripts(events, 1) AS i, unnest(events) AS e FROM notes), pick AS (SELECT record_id, i, e.* FROM flat0 WHERE e IS NOT NULL AND i > n - 25), {DOC_SQL},
    full_rows AS (SELECT a.qa_id, a.record_id, a.question, concat_ws(chr(10) || chr(10), nullif(n.discharge_summary, ''), nullif(docs.doc, '')) AS full_text FROM asked a JOIN notes n USING (record_id) LEFT JOIN docs USING (record_id)) {PROMPT_SQL}""")
def recency_prompt(spark, d):
    return _digest(retrieve.recency(asked(spark, d, "demographics", "admission", "events", "discharge_summary", prepare=lambda n: retrieve.record_texts(n).select("subject_id", "hadm_id", "record_id", "recent_text"))))


PART = lambda s, fs, head: f"(SELECT '{head}' || chr(10) || nullif(concat_ws(chr(10), {', '.join(f'''CASE WHEN n.{s}.{f} IS NOT NULL THEN '  {f}: ' || n.{s}.{f} END''' for f in fs)}), ''))"
DEMO_F = ["subject_id", "gender", "anchor_age", "anchor_year", "anchor_year_group", "dod"]
@query(f"""WITH {ASKED_SQL}, pick AS (SELECT record_id, i, e.* FROM (SELECT record_id, generate_subscripts(events, 1) AS i, unnest(events) AS e FROM notes) WHERE e IS NOT NULL), {DOC_SQL},
    full_rows AS (SELECT a.qa_id, a.record_id, a.question, concat_ws(chr(10) || chr(10), {PART('demographics', DEMO_F, 'DEMOGRAPHICS:')}, {PART('admission', ADM_F, 'ADMISSION:')}, nullif(docs.doc, ''), nullif(n.discharge_summary, '')) AS full_text
        FROM asked a JOIN notes n USING (record_id) LEFT JOIN docs USING (record_id)) {PROMPT_SQL}""")
def full_context_prompt(spark, d):
    return _digest(retrieve.full_context(asked(spark, d, "demographics", "admission", "events", "discharge_summary", prepare=lambda n: retrieve.record_texts(n).select("subject_id", "hadm_id", "record_id", "full_text"))))


@query()
def semantic_rag_prompt(spark, d):
    """Top chunks by cosine of hashed term vectors, a stand-in encoder for pre-computed embeddings."""
    chunks = materialise(note_chunks(spark, d).select("record_id", "chunk_idx", "chunk"), "chunks")
    return _digest(retrieve.semantic_prompts(asked(spark, d, "discharge_summary"), chunks, retrieve.hashed_vectors()))


# ---- features and learning ------------------------------------------------------------------


def sampled_pairs(rows: DataFrame) -> DataFrame:
    """The pairs of the train records the ranker learns from."""
    return label.sample_negatives(rows.where("part = 'train'"), ["qa_id"], F.concat_ws(":", F.col("qa_id").cast("string"), F.col("chunk_idx").cast("string")))


def pair_vocabulary(sampled: DataFrame, a: DataFrame, chunks: DataFrame) -> DataFrame:
    """TF-IDF terms of the questions and chunks of ``sampled``; a text counts once for every pair it stands in."""
    q = a.join(sampled.groupBy("qa_id").agg(F.count(F.lit(1)).alias("times")), "qa_id").select(F.col("question").alias("text"), "times")
    c = chunks.join(sampled.groupBy("record_id", "chunk_idx").agg(F.count(F.lit(1)).alias("times")), ["record_id", "chunk_idx"]).select(F.col("chunk").alias("text"), "times")
    return retrieve.tfidf_vocabulary(q.unionByName(c), "text", times="times")


def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    """Features, label and part of every pair; the TF-IDF terms are those of the pairs to learn from, the encoder is the stand-in.

    Labels and similarities are found by key, and what depends on a question or a chunk alone
    is worked out once for each; both join last, so pairs carry no texts through the shuffles before.
    """
    encode = retrieve.hashed_vectors()
    a = materialise(features.question_side(asked(spark, d)).withColumn("qv", encode(F.col("question"))), "asked")
    times = notes(spark, d, "admission").select("record_id", F.date_format("admission.dischtime", "yyyy-MM-dd HH:mm:ss").alias("dischtime"))
    chunks = materialise(features.chunk_side(note_chunks(spark, d).join(times, "record_id")).withColumn("cv", encode(F.col("chunk"))), "chunks")
    pairs = label.label_pairs(a.select("qa_id", "record_id", T.alnum_tokens(F.col("answer")).alias("answer_tokens")), chunks.select("record_id", "chunk_idx", "chunk_tokens"))
    keys = materialise(pairs.join(label.hash_split(notes(spark, d), "record_id"), "record_id"), "pairs")
    vocabulary = materialise(pair_vocabulary(sampled_pairs(keys), a, chunks), "vocabulary")
    keys = keys.join(retrieve.pair_tfidf(a, chunks, vocabulary), ["qa_id", "record_id", "chunk_idx"], "left").fillna(0.0, ["tfidf_sim"])
    rows = keys.join(a, ["qa_id", "record_id"]).join(chunks, ["record_id", "chunk_idx"])
    return features.pair_side(rows.withColumn("embed_sim", retrieve.cosine(F.col("qv"), F.col("cv"))).drop("qv", "cv"))


SEC_IDX = "list_position([" + ", ".join(f"'{s}'" for s in T.SECTIONS) + "], section) - 1"
QT_IDX = "list_position([" + ", ".join(f"'{s}'" for s in T.QUESTION_TYPES) + f"], {QTYPE_SQL}) - 1"


@query(f"WITH {PAIRS_SQL} SELECT ({SEC_IDX}) * 6 + ({QT_IDX}) AS cell, count(*) AS n FROM pairs GROUP BY 1")
def section_qtype_interactions(spark, d):
    rows = asked(spark, d).join(note_chunks(spark, d).select("record_id", "section"), "record_id").withColumn("qtype", T.question_type(F.col("question")))
    cell = features._index(F.col("section"), T.SECTIONS) * len(T.QUESTION_TYPES) + features._index(F.col("qtype"), T.QUESTION_TYPES)
    return rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query()
def feature_matrix_sums(spark, d):
    """Sum of every one of the 166 features over all pairs."""
    rows = features.active_features(feature_rows(spark, d)).groupBy("idx").agg(F.count(F.lit(1)).alias("n_active"), F.round(F.sum("value"), 4).alias("total"))
    names = F.array(*[F.lit(n) for n in features.feature_names()])
    return rows.select("idx", F.element_at(names, F.col("idx") + 1).alias("feature"), "n_active", "total")


@query()
def learned_topk(spark, d):
    """Ranker trained on sampled pairs of the train records, top chunks of the validation questions."""
    rows = materialise(feature_rows(spark, d), "ranked-pairs")
    model = learn.fit_ranker(sampled_pairs(rows))
    scored = learn.apply_ranker(model, rows.where("part = 'validation'"))
    return retrieve.top_k(scored.select("qa_id", "chunk_idx", "label", F.round("score", 6).alias("score")), ["qa_id"], 5)


SCORE_SQL = f"{PAIRS_SQL}, {FAST_F1}, scored AS (SELECT qa_id, chunk_idx, label, round(({_share_sql('''list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+'))''', '''regexp_extract_all(lower(chunk), '[a-z0-9]+')''')}), 6) AS score FROM labelled)"


def scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_pairs(spark, d)
    return rows.select("qa_id", "chunk_idx", "label", F.round(T.overlap_share(T.alnum_tokens(F.col("question")), T.alnum_tokens(F.col("chunk"))), 6).alias("score"))


RANKED_SQL = "by_score AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY 1), curve AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM by_score)"


@query(f"""WITH {SCORE_SQL}, {RANKED_SQL}, t AS (SELECT count(*) AS n_total, sum(label) AS n_pos, avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM scored)
    SELECT n_total, CAST(n_pos AS BIGINT) AS n_pos, round(accuracy, 6) AS accuracy, round((SELECT sum(neg * (tp - pos) + neg * pos / 2) FROM curve) / (n_pos * (n_total - n_pos)), 6) AS roc_auc, round((SELECT sum(pos * tp / (tp + fp)) FROM curve) / n_pos, 6) AS average_precision FROM t""")
def lr_metrics(spark, d):
    return learn.classification_metrics(materialise(scored_pairs(spark, d), "scored"))


@query(f"WITH {SCORE_SQL}, {RANKED_SQL} SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / (tp + fp), 6) AS precision FROM curve")
def roc_pr_points(spark, d):
    return learn.ranked_counts(scored_pairs(spark, d)).select("score", "tp", "fp", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"))


@query(f"WITH {SCORE_SQL} SELECT label, CAST(least(floor(score * 40), 39) AS INTEGER) AS bin, count(*) AS n FROM scored GROUP BY 1, 2")
def score_histogram_bins(spark, d):
    return scored_pairs(spark, d).groupBy("label", F.least(F.floor(F.col("score") * 40), F.lit(39)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def rule_weights(spark: SparkSession) -> DataFrame:
    """A weight for every feature by rule, so that reports can be checked without a model."""
    return spark.createDataFrame([(n, ((i * 7919) % 2001 - 1000) / 1000) for i, n in enumerate(features.feature_names())], "feature string, weight double")


WEIGHTS_SQL = "w AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {((i * 7919) % 2001 - 1000) / 1000})" for i, n in enumerate(features.feature_names())) + ") AS t(idx, feature, weight))"


@query(f"WITH {WEIGHTS_SQL} SELECT feature, CAST(weight AS DOUBLE) AS weight FROM w WHERE weight <> 0 ORDER BY abs(weight) DESC, feature LIMIT 15")
def feature_top_weights(spark, d):
    return rule_weights(spark).where("weight <> 0").orderBy(F.desc(F.abs("weight")), "feature").limit(15)


@query(f"""WITH {WEIGHTS_SQL}, g AS (SELECT abs(CAST(weight AS DOUBLE)) AS a, CASE WHEN idx < 3 OR idx = 160 THEN 'Similarity' WHEN idx < 5 OR idx = 161 THEN 'Structural / Positional' WHEN idx < 9 THEN 'Text Signals (A)' WHEN idx < 13 THEN 'Temporal (B)'
    WHEN idx < 32 THEN 'Section Identity' WHEN idx < 38 THEN 'Question Type' WHEN idx < 152 THEN 'Section × Q-Type' WHEN idx < 160 THEN 'Signal × Q-Type (C)' ELSE 'Precision (D)' END AS feature_group FROM w)
    SELECT feature_group, round(sum(a), 6) AS mass, round(100 * sum(a) / (SELECT sum(a) FROM g), 4) AS percent FROM g GROUP BY 1""")
def feature_group_mass(spark, d):
    return learn.weight_groups(rule_weights(spark))


# ---- scoring, caching and reports -----------------------------------------------------------


@query()
def rouge_l(spark, d):
    """Token and subsequence scores of each answer against its reasoning."""
    rows = table(spark, d, "qa_pairs").select("qa_id", "answer", "reasoning")
    return score.score_answers(rows, "answer", "reasoning").select("qa_id", *[F.round(c, 6).alias(c) for c in ("token_f1", "rouge_l_precision", "rouge_l_recall", "rouge_l_f1")])


@query("SELECT qa_id, CAST(CASE WHEN regexp_matches(trim(answer), '^[1-5]$') THEN trim(answer) ELSE nullif(regexp_extract(answer, '\\b([1-5])\\b', 1), '') END AS INTEGER) AS parsed FROM qa_pairs WHERE answer IS NOT NULL")
def parse_judge_score(spark, d):
    return table(spark, d, "qa_pairs").where("answer IS NOT NULL").select("qa_id", T.judge_score(F.col("answer")).alias("parsed"))


@query("""WITH r AS (SELECT doc_id, sha256('m|' || text) AS k FROM documents WHERE text IS NOT NULL), c AS (SELECT DISTINCT k FROM r WHERE doc_id % 2 = 0)
    SELECT doc_id, k AS cache_key, k IN (SELECT k FROM c) AS cached FROM r""")
def cache_key_lookup(spark, d):
    r = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(F.concat(F.lit("m|"), "text"), 256).alias("cache_key"))
    hits, misses = infer.split_cache(r, r.where("doc_id % 2 = 0").select("cache_key").distinct())
    return hits.unionByName(misses.withColumn("cached", F.lit(False)))


@query()
def cached_extractive_answers(spark, d):
    """Discharge-only prompts answered by the extractive stand-in, scored and judged by rule."""
    prompts = retrieve.discharge_only(asked(spark, d, "discharge_summary")).withColumn("system_prompt", F.lit("Answer from the context."))
    prompts = prompts.withColumn("cache_key", infer.cache_key(F.lit("extractive"), F.col("system_prompt"), F.col("user_prompt")))
    empty = prompts.limit(0).select("cache_key", F.lit("").alias("answer"), F.lit(0).alias("prompt_tokens"), F.lit(0).alias("completion_tokens"))
    rows, _ = infer.run_cached(prompts, empty, infer.extractive_answer)
    gold = questions(spark, d).select("qa_id", F.col("answer").alias("gold_answer"))
    out = score.score_answers(rows.join(gold, "qa_id"), "answer", "gold_answer")
    return out.select("qa_id", "record_id", "method", "context_tokens", "completion_tokens", "cached", F.round("token_f1", 6).alias("token_f1"), F.round("rouge_l_f1", 6).alias("rouge_l_f1"))


@query("""SELECT doc_id, CASE WHEN contains(n, '__') THEN split_part(n, '__', 1) ELSE 'unknown' END AS model, CASE WHEN contains(n, '__') THEN substr(n, strpos(n, '__') + 2) ELSE n END AS method
    FROM (SELECT doc_id, coalesce(replace(source, '_', '__'), '') AS n FROM documents)""")
def slug_split(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.coalesce(F.replace("source", F.lit("_"), F.lit("__")), F.lit("")).alias("n"))
    model, method = result_key(F.col("n"))
    return rows.select("doc_id", model.alias("model"), method.alias("method"))


METHODS = ["generated", "ehr_ds_qa", "verified", "clinician"]
RESULTS_SQL = f"results AS (SELECT qa_id, coalesce(model, 'none') AS model, source AS method, difficulty, hadm_id, CASE WHEN answer IS NULL THEN NULL ELSE len({ALNUM('answer')}) / 10.0 END AS token_f1, length(question) AS context_tokens FROM qa_pairs)"


def results(spark: SparkSession, d: str) -> DataFrame:
    """qa_pairs in the part of result rows: model, method, difficulty and two measures."""
    measure = F.when(F.col("answer").isNotNull(), F.size(T.alnum_tokens(F.col("answer"))) / 10.0)
    return table(spark, d, "qa_pairs").select("qa_id", F.coalesce("model", F.lit("none")).alias("model"), F.col("source").alias("method"), "difficulty", "hadm_id", measure.alias("token_f1"), F.char_length("question").alias("context_tokens"))


@query(f"WITH {RESULTS_SQL} SELECT model, {', '.join(f'''round(avg(coalesce(token_f1, 0)) FILTER (method = '{m}'), 6) AS {m}''' for m in METHODS)} FROM results GROUP BY model")
def model_method_matrix(spark, d):
    return report.model_method_matrix(results(spark, d), "token_f1")


@query(f"WITH {RESULTS_SQL}, c AS (SELECT model, method, avg(coalesce(token_f1, 0)) AS m FROM results GROUP BY 1, 2) SELECT model, method, round(m, 6) AS mean, max(m) OVER (PARTITION BY model) - m < 0.0001 AS is_best FROM c")
def matrix_row_best(spark, d):
    return report.row_best(results(spark, d), "token_f1")


@query(f"WITH {RESULTS_SQL} SELECT method, count(*) AS n, round(avg(coalesce(token_f1, 0)), 6) AS mean_token_f1, round(avg(coalesce(context_tokens, 0)), 6) AS mean_context_tokens FROM results GROUP BY 1")
def summary_by_method(spark, d):
    return report.summary_by(results(spark, d), ["method"], ["token_f1", "context_tokens"])


@query(f"WITH {RESULTS_SQL} SELECT method, coalesce(nullif(difficulty, ''), 'unknown') AS difficulty, count(*) AS n, round(avg(coalesce(token_f1, 0)), 6) AS mean_token_f1 FROM results WHERE coalesce(nullif(difficulty, ''), 'unknown') IN ('easy', 'medium', 'hard', 'unknown') GROUP BY 1, 2")
def difficulty_breakdown(spark, d):
    return report.difficulty_breakdown(results(spark, d), "token_f1")


@query(f"WITH {RESULTS_SQL}, c AS (SELECT model, method, avg(token_f1) AS a, avg(context_tokens) AS b FROM results GROUP BY 1, 2) SELECT method, count(*) AS n_models, round(avg(a), 6) AS mean_token_f1, round(avg(b), 6) AS mean_context_tokens FROM c GROUP BY 1")
def mean_of_means(spark, d):
    return report.mean_of_means(results(spark, d), ["token_f1", "context_tokens"])


@query(f"WITH {RESULTS_SQL}, c AS (SELECT model, method, avg(coalesce(token_f1, 0)) AS m FROM results GROUP BY 1, 2) SELECT a.model, a.method, round(coalesce(b.m, 0) - a.m, 6) AS lift FROM c a LEFT JOIN c b ON b.model = a.model AND b.method = 'generated' WHERE a.method <> 'generated'")
def learned_lift(spark, d):
    return report.lift(results(spark, d), "generated", "token_f1")


JUDGED_SQL = "judged AS (SELECT user_id AS question, event_type AS strategy, CAST(floor(arg_max(value, event_id)) AS BIGINT) % 6 AS judge_score FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"
COMMON_SQL = f"{JUDGED_SQL}, pos AS (SELECT * FROM judged WHERE coalesce(judge_score, 0) > 0), keep AS (SELECT question FROM pos GROUP BY 1 HAVING count(DISTINCT strategy) = (SELECT count(DISTINCT strategy) FROM pos)), common AS (SELECT * FROM pos WHERE question IN (SELECT question FROM keep))"


def judged(spark: SparkSession, d: str) -> DataFrame:
    """One judge score per question and strategy: the latest event value in 0 to 5."""
    rows = table(spark, d, "events").where("value IS NOT NULL").groupBy(F.col("user_id").alias("question"), F.col("event_type").alias("strategy")).agg(F.max_by("value", "event_id").alias("v"))
    return rows.select("question", "strategy", F.expr("CAST(floor(v) AS BIGINT) % 6").alias("judge_score"))


@query(f"""WITH {COMMON_SQL}, b AS (SELECT *, max(judge_score) OVER (PARTITION BY question) AS m FROM common), t AS (SELECT *, count(*) FILTER (judge_score = m) OVER (PARTITION BY question) AS tied FROM b),
    s AS (SELECT strategy, count(*) AS n, avg(judge_score) AS mean, sum(CASE WHEN judge_score = m THEN 1.0 / tied ELSE 0 END) AS wins FROM t GROUP BY 1)
    SELECT CAST(row_number() OVER (ORDER BY round(wins, 6) DESC, strategy) AS INTEGER) AS rank, strategy, n, round(mean, 4) AS mean_score, round(wins, 2) AS wins, round(100 * wins / n, 2) AS win_pct FROM s""")
def judge_rankings(spark, d):
    return report.judge_rankings(judged(spark, d))


@query(f"WITH {COMMON_SQL} SELECT strategy, {', '.join(f'count(*) FILTER (judge_score = {i}) AS score_{i}' for i in range(1, 6))} FROM common GROUP BY 1")
def judge_hist(spark, d):
    return report.score_histogram(report.common_questions(judged(spark, d).where("judge_score > 0"), "question", "strategy"))


@query(f"WITH {JUDGED_SQL} SELECT strategy, count(*) AS n, round(avg(judge_score), 6) AS mean_judge FROM judged GROUP BY 1")
def judge_mean_incl_zero(spark, d):
    return judged(spark, d).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("judge_score"), 6).alias("mean_judge"))


@query(f"WITH {JUDGED_SQL}, c AS (SELECT strategy, judge_score, count(*) AS n FROM judged WHERE judge_score BETWEEN 1 AND 5 GROUP BY 1, 2) SELECT strategy, judge_score, n, round(n / sum(n) OVER (PARTITION BY strategy), 6) AS share FROM c")
def score_proportions(spark, d):
    return report.score_shares(judged(spark, d))


@query(f"WITH {JUDGED_SQL} SELECT b.strategy, count(*) AS n, round(avg(CASE WHEN a.judge_score > b.judge_score THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM judged a JOIN judged b USING (question) WHERE a.strategy = 'click' AND b.strategy <> 'click' GROUP BY 1")
def pairwise_winrate(spark, d):
    return report.pairwise_wins(judged(spark, d), "click", ["question"])


@query(f"""WITH {COMMON_SQL}, q AS (SELECT question, CASE question % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty FROM keep) SELECT difficulty, strategy, count(*) AS n, round(avg(judge_score), 4) AS mean_judge FROM common JOIN q USING (question) GROUP BY 1, 2""")
def judge_by_difficulty(spark, d):
    rows = report.common_questions(judged(spark, d).where("judge_score > 0"), "question", "strategy")
    kind = F.when(F.col("question") % 3 == 0, "easy").when(F.col("question") % 3 == 1, "medium").otherwise("hard")
    return rows.groupBy(kind.alias("difficulty"), "strategy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("judge_score"), 4).alias("mean_judge"))


@query("""SELECT n_name, r_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def star_join_totals(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.join(c, "c_custkey").join(n, "n_nationkey").groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
