"""Queries of the pipeline around the catalogue: facts, prompts, ranking quality, generation, runs and stored results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions import text as T
from chartloom.functions.tokens import bpe
from chartloom.operators import facts, features, generate, infer, learn, report, retrieve
from chartloom.operators import timeline as tl
from chartloom.plans import catalogue as cat
from chartloom.session import materialise, shared_dir, table
from chartloom.sources import tables as src

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chartloom/{name}-{uuid.uuid4().hex}"


# ---- facts to events -----------------------------------------------------------------------

FACTS = {
    "lab": {"charttime": "timestamp", "lab_label": "label", "value": "value", "valuenum": "valuenum", "valueuom": "unit", "flag": "flag"},
    "vital": {"charttime": "timestamp", "vital_label": "label", "value": "value", "valuenum": "valuenum", "valueuom": "unit"},
    "medication": {"starttime": "timestamp", "stoptime": "end_time", "drug": "drug", "dose_val_rx": "dose", "dose_unit_rx": "dose_unit", "route": "route"},
    "procedure": {"chartdate": "timestamp", "icd_code": "icd_code", "procedure_title": "title"},
    "diagnosis": {"seq_num": "seq_num", "icd_code": "icd_code", "diagnosis_title": "title"},
}


def fact_table(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """The facts of one kind under the names of their relational table."""
    rows = table(spark, d, "timeline_events").where(F.col("event_type") == kind)
    return rows.select("subject_id", "hadm_id", *[F.col(c).alias(name) for name, c in FACTS[kind].items()])


def _fact_sql(kind: str) -> str:
    own = set(FACTS[kind].values())
    parts = []
    for name, t in facts.EVENT_COLUMNS.items():
        if name == "event_type":
            parts.append(f"'{kind}' AS event_type")
        elif kind == "diagnosis" and name == "timestamp":
            parts.append("'' AS timestamp")
        elif kind == "diagnosis" and name == "seq_num":
            parts.append("coalesce(seq_num, 0) AS seq_num")
        elif name in own:
            parts.append(f"coalesce({name}, 'None') AS {name}" if name in ("timestamp", "end_time") else name)
        else:
            parts.append(f"CAST(NULL AS {t.replace('string', 'varchar')}) AS {name}")
    return f"SELECT subject_id, hadm_id, {', '.join(parts)} FROM timeline_events WHERE event_type = '{kind}'"


@query(_fact_sql("lab"))
def fact_lab_events(spark, d):
    return facts.lab_events(fact_table(spark, d, "lab"))


@query(_fact_sql("vital"))
def fact_vital_events(spark, d):
    return facts.vital_events(fact_table(spark, d, "vital"))


@query(_fact_sql("medication"))
def fact_medication_events(spark, d):
    return facts.medication_events(fact_table(spark, d, "medication"))


@query(_fact_sql("procedure"))
def fact_procedure_events(spark, d):
    return facts.procedure_events(fact_table(spark, d, "procedure"))


@query(_fact_sql("diagnosis"))
def fact_diagnosis_events(spark, d):
    return facts.diagnosis_events(fact_table(spark, d, "diagnosis"))


@query(f"SELECT hadm_id, event_type, count(*) AS n, min(timestamp) AS first_time FROM ({' UNION ALL '.join(_fact_sql(k) for k in FACTS)}) GROUP BY 1, 2")
def fact_event_union(spark, d):
    rows = facts.all_events(*[fact_table(spark, d, k) for k in ("lab", "vital", "medication", "procedure", "diagnosis")])
    return rows.groupBy("hadm_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_time"))


@query("""SELECT subject_id, hadm_id, timestamp AS starttime, end_time AS stoptime, drug, dose AS dose_val_rx, dose_unit AS dose_unit_rx, route FROM timeline_events
    WHERE event_type = 'medication' AND hadm_id IN (SELECT hadm_id FROM qa_pairs) ORDER BY hadm_id, starttime""")
def prescriptions_scan(spark, d):
    """Prescriptions of the asked stays, in order of stay and start; of the 16 columns those the source has."""
    rows = fact_table(spark, d, "medication")
    kept = [c for c in facts.PRESCRIPTION_COLUMNS if c in rows.columns]
    return tl.keep_ids(rows.select(*kept), table(spark, d, "qa_pairs"), "hadm_id").orderBy("hadm_id", "starttime")


@query("""WITH p AS (SELECT event_id, hadm_id, icd_code, length(icd_code) AS icd_version, timestamp AS chartdate FROM timeline_events WHERE event_type = 'procedure'),
    dict AS (SELECT icd_code, length(icd_code) AS icd_version, min(title) AS procedure_title FROM timeline_events WHERE event_type = 'procedure' AND title IS NOT NULL GROUP BY 1, 2)
    SELECT event_id, hadm_id, chartdate, procedure_title FROM p JOIN dict USING (icd_code, icd_version) WHERE hadm_id IN (SELECT hadm_id FROM admissions)""")
def procedures_dict_join(spark, d):
    """Procedures with the title of their dictionary, joined on code and version; the code's length stands for its version."""
    ev = table(spark, d, "timeline_events").where("event_type = 'procedure'").select("event_id", "hadm_id", "icd_code", F.length("icd_code").alias("icd_version"), F.col("timestamp").alias("chartdate"), "title")
    dictionary = ev.where("title IS NOT NULL").groupBy("icd_code", "icd_version").agg(F.min("title").alias("procedure_title"))
    joined = tl.dictionary_join(ev.drop("title"), dictionary, ["icd_code", "icd_version"])
    return tl.keep_ids(joined, table(spark, d, "admissions"), "hadm_id").select("event_id", "hadm_id", "chartdate", "procedure_title")


@query("SELECT record_id, strftime(admission.dischtime, '%Y-%m-%dT%H:%M:%S') AS dischtime, strftime(demographics.dod, '%Y-%m-%d') AS dod FROM patient_timelines")
def iso_times(spark, d):
    rows = table(spark, d, "patient_timelines")
    return rows.select("record_id", F.date_format("admission.dischtime", "yyyy-MM-dd'T'HH:mm:ss").alias("dischtime"), F.date_format("demographics.dod", "yyyy-MM-dd").alias("dod"))


@query("SELECT qa_id, subject_id, hadm_id, question, answer FROM qa_pairs WHERE subject_id IS NOT NULL AND hadm_id IS NOT NULL")
def qa_nested_flatten(spark, d):
    """Pairs nested by stay, as files hold them, and taken apart again."""
    qa = table(spark, d, "qa_pairs").where("subject_id IS NOT NULL AND hadm_id IS NOT NULL")
    nested = qa.groupBy("subject_id", "hadm_id").agg(F.collect_list(F.struct("qa_id", "question", "answer")).alias("qa_pairs"))
    return nested.select("subject_id", "hadm_id", F.inline("qa_pairs")).select("qa_id", "subject_id", "hadm_id", "question", "answer")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def adhoc_query(spark, d):
    """Any SQL over registered tables, with a named argument."""
    src.register_tables(spark, d, ["nation", "region"])
    return src.run_query(spark, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = :name", name="ASIA")


# ---- prompts -------------------------------------------------------------------------------


def section_texts(spark: SparkSession, d: str) -> DataFrame:
    return materialise(cat.note_chunks(spark, d).select("record_id", "chunk_idx", "chunk"), "sections")


SECTION_BM25_SQL = cat.BM25_SQL.replace(cat.FIXED_SQL.replace(cat.NOTES_SQL + ", ", ""), cat.CHUNKS_SQL.replace(cat.NOTES_SQL + ", ", "")).replace("AS t FROM fixed)", "AS t FROM chunks)").replace("terms AS (", "bm_terms AS (").replace("FROM terms", "FROM bm_terms").replace("JOIN terms t", "JOIN bm_terms t")


@query(f"""WITH {SECTION_BM25_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qa_id, record_id ORDER BY round(score, 9) DESC, chunk_idx DESC) AS rank FROM scored),
    ctx AS (SELECT r.qa_id, r.record_id, string_agg(c.chunk, chr(10) || chr(10) ORDER BY r.chunk_idx) AS context FROM r JOIN chunks c USING (record_id, chunk_idx) WHERE rank <= 5 GROUP BY 1, 2),
    full_rows AS (SELECT a.qa_id, a.record_id, a.question, coalesce(x.context, n.discharge_summary, '') AS full_text FROM asked a JOIN notes n USING (record_id) LEFT JOIN ctx x ON x.qa_id = a.qa_id AND x.record_id = a.record_id) {cat.PROMPT_SQL}""")
def bm25_prompt(spark, d):
    """Prompts of the five best sections by BM25 in reading order, within the budget; the summary where there is no section."""
    return cat._digest(retrieve.bm25_prompts(cat.asked(spark, d, "discharge_summary"), section_texts(spark, d)))


@query()
def learned_prompt(spark, d):
    """Prompts of the five sections a trained ranker puts first, for the validation questions."""
    rows = materialise(cat.feature_rows(spark, d), "ranked-pairs")
    model = learn.fit_ranker(cat.sampled_pairs(rows))
    held = rows.where("part = 'validation'")
    scored = learn.apply_ranker(model, held).select("qa_id", "record_id", "chunk_idx", F.round("score", 9).alias("score"))
    asked = cat.asked(spark, d, "discharge_summary").join(held.select("qa_id").distinct(), "qa_id", "left_semi")
    return cat._digest(retrieve.learned_prompts(asked, held.select("record_id", "chunk_idx", "chunk").distinct(), scored))


@query()
def bpe_prompt_tokens(spark, d):
    """Discharge-only prompts counted and cut by the public BPE: tokens of the context, and of the whole prompt."""
    rows = retrieve.discharge_only(cat.asked(spark, d, "discharge_summary"), 1024, bpe())
    return rows.select("qa_id", "record_id", "context_tokens", "prompt_tokens", F.md5("user_prompt").alias("digest"))


# ---- quality of ranking --------------------------------------------------------------------

RECALL_SQL = f"""WITH {cat.SCORE_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY score DESC, chunk_idx DESC) AS rank FROM scored), positives AS (SELECT qa_id, sum(label) AS n_pos FROM placed GROUP BY 1),
    ks AS (SELECT unnest([1, 3, 5, 10]) AS k), found AS (SELECT ks.k, p.qa_id, sum(CASE WHEN rank <= ks.k THEN label ELSE 0 END) AS hits FROM placed p, ks GROUP BY 1, 2)
    SELECT k, round(avg(CASE WHEN n_pos > 0 THEN hits / n_pos ELSE 0 END), 6) AS recall, count(*) AS n_questions FROM found JOIN positives USING (qa_id) WHERE n_pos > @least@ GROUP BY k"""


@query(RECALL_SQL.replace("@least@", "0"))
def lexical_recall(spark, d):
    """Recall of the positives among the best chunks by shared words, over questions that have positives."""
    return learn.recall_at_k(cat.scored_pairs(spark, d), ["qa_id"])


@query(RECALL_SQL.replace("@least@", "-1"))
def lexical_recall_full(spark, d):
    """The same over all questions, those without positives counting 0."""
    return learn.recall_at_k(cat.scored_pairs(spark, d), ["qa_id"], skip_unanswerable=False)


def _held_scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = materialise(cat.feature_rows(spark, d), "ranked-pairs")
    model = learn.fit_ranker(cat.sampled_pairs(rows))
    held = rows.where("part = 'validation'")
    scored = materialise(learn.apply_ranker(model, held).select("qa_id", "record_id", "chunk_idx", "label", F.round("score", 9).alias("score")), "held-scores")
    return scored, cat.label.sample_negatives(scored, ["qa_id"], F.concat_ws(":", F.col("qa_id").cast("string"), F.col("chunk_idx").cast("string")))


@query()
def ranker_recall(spark, d):
    """Recall at 1, 3, 5 and 10 of the trained ranker on validation questions: over sampled negatives, and over all chunks."""
    scored, sampled = _held_scores(spark, d)
    pool = lambda rows, name, skip: learn.recall_at_k(rows, ["qa_id"], skip_unanswerable=skip).withColumn("pool", F.lit(name))
    return pool(sampled, "sampled", True).unionByName(pool(scored, "all chunks", False))


@query()
def ranker_metrics(spark, d):
    """Accuracy, areas and counts of the trained ranker on the sampled validation pairs."""
    return learn.classification_metrics(_held_scores(spark, d)[1])


@query()
def saved_ranker_scores(spark, d):
    """The ranker saved, loaded and applied natively: its highest score per validation question."""
    rows = materialise(cat.feature_rows(spark, d), "ranked-pairs")
    model = learn.fit_ranker(cat.sampled_pairs(rows))
    path = _place(spark, "ranker")
    learn.save_ranker(model, rows.select(F.lit("").alias("term")).limit(0), path)
    weights, intercept, _ = learn.load_ranker(spark, path)
    return features.linear_score(rows.where("part = 'validation'"), weights, intercept).groupBy("qa_id").agg(F.round(F.max("score"), 6).alias("best"))


# ---- generation ----------------------------------------------------------------------------

N_A = lambda c: f"coalesce(CAST({c} AS VARCHAR), 'N/A')"
E_ = lambda c: f"coalesce(CAST({c} AS VARCHAR), '')"
BLOCK_SQL = lambda head, s, fields, have: f"CASE WHEN coalesce({', '.join(f'CAST({s}.{f} AS VARCHAR)' for f in have)}) IS NOT NULL THEN '{head}' || chr(10) || " + " || chr(10) || ".join(f"'- {name}: ' || {N_A(f'{s}.{f}')}" for name, f in fields) + " END"
GENERATION_SQL = f"""{cat.NOTES_SQL}, b AS (SELECT record_id, discharge_summary, {BLOCK_SQL('## Demographics', 'demographics', generate.DEMOGRAPHICS, cat.DEMO_F)} AS dm, {BLOCK_SQL('## Admission', 'admission', generate.ADMISSION, cat.ADM_F)} AS ad FROM notes),
    flat AS (SELECT record_id, i, e.* FROM (SELECT record_id, generate_subscripts(events, 1) AS i, unnest(events) AS e FROM notes) WHERE e IS NOT NULL),
    dx AS (SELECT record_id, '## Diagnoses' || chr(10) || string_agg('- [' || {E_('seq_num')} || '] ' || {E_('icd_code')} || ' — ' || {E_('title')}, chr(10) ORDER BY i) AS dx FROM flat WHERE event_type = 'diagnosis' GROUP BY 1),
    li AS (SELECT record_id, i, CASE event_type WHEN 'lab' THEN trim('[' || {E_('timestamp')} || '] LAB: ' || {E_('label')} || ' = ' || {E_('value')} || ' ' || {E_('unit')} || ' ' || {E_('flag')})
        WHEN 'vital' THEN trim('[' || {E_('timestamp')} || '] VITAL: ' || {E_('label')} || ' = ' || {E_('value')} || ' ' || {E_('unit')})
        WHEN 'medication' THEN trim('[' || {E_('timestamp')} || '] MED: ' || {E_('drug')} || ' ' || {E_('dose')} || ' ' || {E_('dose_unit')} || ' (' || {E_('route')} || ') until ' || {E_('end_time')})
        WHEN 'procedure' THEN trim('[' || {E_('timestamp')} || '] PROCEDURE: ' || {E_('icd_code')} || ' — ' || {E_('title')}) END AS line FROM flat WHERE event_type <> 'diagnosis'),
    base AS (SELECT b.*, dx.dx, len({cat.TOK("concat_ws(chr(10), dm, ad, dx) || chr(10) || chr(10) || '## Clinical Events (chronological)' || chr(10)")}) AS base FROM b LEFT JOIN dx USING (record_id)),
    ru AS (SELECT li.*, base + sum(len({cat.TOK('line || chr(10)')})) OVER (PARTITION BY record_id ORDER BY i) <= @room@ AS fits FROM li JOIN base USING (record_id)),
    ev AS (SELECT record_id, count(*) FILTER (fits) AS n_kept, count(*) FILTER (NOT fits) AS n_cut, string_agg(line, chr(10) ORDER BY i) FILTER (fits) AS kept FROM ru GROUP BY 1),
    body AS (SELECT base.record_id, coalesce(n_kept, 0) AS n_kept, coalesce(n_cut, 0) AS n_cut, coalesce(discharge_summary, '') AS s, concat_ws(chr(10) || chr(10), dm, ad, dx,
        CASE WHEN ev.record_id IS NOT NULL THEN '## Clinical Events (chronological)' || chr(10) || concat_ws(chr(10), kept, CASE WHEN n_cut > 0 THEN '... [' || n_cut || ' more events truncated] ...' END) END) AS body FROM base LEFT JOIN ev USING (record_id)),
    done AS (SELECT *, len({cat.TOK('body')}) AS used, {cat.TOK('s')} AS st FROM body)"""


@query(f"""WITH {GENERATION_SQL.replace("@room@", "1000")} SELECT record_id, n_kept, n_cut, md5(concat_ws(chr(10) || chr(10), nullif(body, ''), CASE WHEN s <> '' THEN '## Discharge Summary' || chr(10) ||
    CASE WHEN used + len(st) > 3000 AND 2800 - used > 500 THEN (CASE WHEN len(st) <= 2800 - used THEN s ELSE array_to_string(list_slice(st, 1, 2800 - used), ' ') END) || chr(10) || '... [discharge summary truncated]' ELSE s END END)) AS digest FROM done""")
def generation_texts(spark, d):
    """Timeline texts for making pairs, at a quarter of the usual budget so that both cuts come into play."""
    rows = cat.notes(spark, d, "demographics", "admission", "events", "discharge_summary").select("record_id", "demographics", "admission", "events", "discharge_summary")
    out = generate.generation_texts(rows, context=3000, reserve=2000)
    return out.select("record_id", F.col("n_kept").cast("bigint").alias("n_kept"), F.col("n_cut").cast("bigint").alias("n_cut"), F.md5("text").alias("digest"))


# ---- runs, samples and stored results -------------------------------------------------------

RUN_SQL = f"run AS (SELECT *, length(question) AS prompt_tokens, length(coalesce(answer, '')) AS completion_tokens, token_f1 / 2 AS rouge_l_f1 FROM (SELECT q.question, q.answer, r.* FROM ({cat.RESULTS_SQL.removeprefix('results AS (').removesuffix(')')}) r JOIN qa_pairs q USING (qa_id)))"


def run_rows(spark: SparkSession, d: str) -> DataFrame:
    """Result rows of a run, with lengths in the part of token counts."""
    qa = table(spark, d, "qa_pairs").select("qa_id", F.char_length("question").alias("prompt_tokens"), F.char_length(F.coalesce("answer", F.lit(""))).alias("completion_tokens"))
    return cat.results(spark, d).join(qa, "qa_id").withColumn("rouge_l_f1", F.col("token_f1") / 2)


@query(f"WITH {RUN_SQL} SELECT count(*) AS n_prompts, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(avg(coalesce(token_f1, 0)), 6) AS mean_token_f1, round(avg(coalesce(rouge_l_f1, 0)), 6) AS mean_rouge_l_f1 FROM run")
def run_totals(spark, d):
    return report.run_totals(run_rows(spark, d))


@query("""WITH r AS (SELECT doc_id, sha256('m|' || text) AS k, text FROM documents WHERE text IS NOT NULL), c AS (SELECT DISTINCT k FROM r WHERE doc_id % 2 = 0), s AS (SELECT k IN (SELECT k FROM c) AS cached, trim(text) = '' AS failed FROM r)
    SELECT count(*) FILTER (cached) AS cache_hits, count(*) FILTER (NOT cached AND NOT failed) AS api_calls, count(*) FILTER (NOT cached AND failed) AS errors FROM s""")
def runner_counts(spark, d):
    """Counters of a cached run over the documents: every second one is in the cache, blank ones fail."""
    r = table(spark, d, "documents").where("text IS NOT NULL").select("text", F.sha2(F.concat(F.lit("m|"), "text"), 256).alias("cache_key"), (F.col("doc_id") % 2 == 0).alias("_even"))
    hits, misses = infer.split_cache(r.drop("_even"), r.where("_even").select("cache_key").distinct())
    failed = misses.withColumn("cached", F.lit(False)).withColumn("error", F.when(F.trim("text") == "", F.lit("blank")))
    return report.runner_counts(hits.withColumn("error", F.lit(None).cast("string")).unionByName(failed))


@query("SELECT qa_id, question FROM qa_pairs ORDER BY sha256(CAST(qa_id AS VARCHAR) || '|42'), qa_id LIMIT 100")
def seeded_sample(spark, d):
    return report.seeded_sample(table(spark, d, "qa_pairs").select("qa_id", "question"), "qa_id", 100)


@query(f"""WITH {cat.COMMON_SQL}, chosen AS (SELECT question FROM keep ORDER BY sha256(CAST(question AS VARCHAR) || '|42'), question LIMIT 50)
    SELECT strategy, count(*) AS n, round(avg(judge_score), 4) AS mean FROM common WHERE question IN (SELECT question FROM chosen) GROUP BY 1""")
def judge_sampled_means(spark, d):
    return report.sampled_means(cat.judged(spark, d), 50)


@query(f"WITH {cat.JUDGED_SQL} SELECT strategy, count(*) AS n_scored FROM judged WHERE judge_score > 0 GROUP BY 1")
def judge_scored_counts(spark, d):
    """Scored rows per strategy before any intersection; scores of 0 are unparsed."""
    return cat.judged(spark, d).where("judge_score > 0").groupBy("strategy").agg(F.count(F.lit(1)).alias("n_scored"))


@query("""SELECT qa_id, CASE qa_id % 4 WHEN 0 THEN 'BM25' WHEN 1 THEN 'discharge-only' WHEN 2 THEN 'learned' ELSE source END AS name FROM qa_pairs""")
def display_names(spark, d):
    kind = F.element_at(F.array(F.lit("bm25_k5"), F.lit("discharge_only"), F.lit("learned_k5"), F.col("source")), (F.col("qa_id") % 4 + 1).cast("int"))
    return table(spark, d, "qa_pairs").select("qa_id", report.display_name(kind, report.METHOD_NAMES).alias("name"))


SUMMARY_SQL = f"""WITH {RUN_SQL}, s AS (SELECT model, method, CAST(count(*) AS DOUBLE) AS n, avg(coalesce(token_f1, 0)) AS token_f1_mean, avg(coalesce(rouge_l_f1, 0)) AS rouge_l_f1_mean, avg(coalesce(context_tokens, 0)) AS context_tokens_mean, avg(coalesce(prompt_tokens, 0)) AS prompt_tokens_mean FROM run GROUP BY 1, 2)
    SELECT model, method, metric, round(value, 6) AS value FROM (UNPIVOT s ON n, token_f1_mean, rouge_l_f1_mean, context_tokens_mean, prompt_tokens_mean INTO NAME metric VALUE value)"""


@query(SUMMARY_SQL)
def stored_summary(spark, d):
    """The summary written as JSON by model and method, and read back in long form."""
    path = _place(spark, "summary")
    src.write_summary(src.summary_rows(run_rows(spark, d)), path)
    return src.read_summary(spark, path).select("model", "method", "metric", F.round("value", 6).alias("value"))


@query(f"SELECT * FROM (SELECT value FROM ({SUMMARY_SQL}) WHERE model = 'none' AND method = 'clinician' AND metric = 'n' UNION ALL SELECT NULL) ORDER BY value NULLS LAST LIMIT 1")
def summary_lookup(spark, d):
    return report.metric_of(stored_summary(spark, d), "none", "clinician", "n")


@query(cat.ORACLES["judge_rankings"])
def stored_rankings(spark, d):
    """Rankings written as JSON and read back."""
    path = _place(spark, "rankings")
    src.write_rankings(report.judge_rankings(cat.judged(spark, d)), path)
    return src.read_rankings(spark, path)


@query(f"SELECT m.*, r1.recall AS recall_at_1, r10.recall AS recall_at_10 FROM ({cat.ORACLES['lr_metrics']}) m, (SELECT recall FROM ({RECALL_SQL.replace("@least@", "0")}) WHERE k = 1) r1, (SELECT recall FROM ({RECALL_SQL.replace("@least@", "0")}) WHERE k = 10) r10")
def stored_metrics(spark, d):
    """Metrics and recall written as one JSON object and read back."""
    path, scored = _place(spark, "metrics"), materialise(cat.scored_pairs(spark, d), "scored")
    src.write_metrics(learn.classification_metrics(scored), learn.recall_at_k(scored, ["qa_id"]), path)
    kept = "n_total bigint, n_pos bigint, accuracy double, roc_auc double, average_precision double"
    rows = spark.read.schema(f"{kept}, recall struct<recall_at_1:double,recall_at_10:double>").json(path)
    return rows.select("n_total", "n_pos", "accuracy", "roc_auc", "average_precision", "recall.recall_at_1", "recall.recall_at_10")


@query()
def stored_cache_answers(spark, d):
    """Extractive answers run twice over one stored cache: the second run takes all of them from it."""
    path = _place(spark, "cache")
    prompts = retrieve.discharge_only(cat.asked(spark, d, "discharge_summary")).withColumn("system_prompt", F.lit("Answer from the context."))
    prompts = materialise(prompts.withColumn("cache_key", infer.cache_key(F.lit("extractive"), F.col("system_prompt"), F.col("user_prompt"))), "prompts")
    _, new = infer.run_cached(prompts, src.read_cache(spark, path), infer.extractive_answer)
    src.append_cache(new, path)
    rows, _ = infer.run_cached(prompts, src.read_cache(spark, path), infer.extractive_answer)
    return rows.select("qa_id", "record_id", "cached", T.alnum_tokens(F.col("answer")).alias("answer_tokens"))


# ---- files written and read back ------------------------------------------------------------

LATEST_SQL = cat.NOTES_SQL


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Latest records with their keys first, as files hold them."""
    return cat.notes(spark, d, "note_id", "demographics", "admission", "discharge_summary", "events").drop("loaded_at")


@query(f"WITH {LATEST_SQL} SELECT subject_id, hadm_id, note_id, len(events) AS n_events, md5(coalesce(discharge_summary, '')) AS digest, demographics.gender AS gender, strftime(admission.admittime, '%Y-%m-%d %H:%M:%S') AS admittime FROM notes")
def stored_timelines(spark, d):
    """Timeline records written as JSON, one a line, and read with the declared schema."""
    path = _place(spark, "timelines")
    src.write_json(_records(spark, d).drop("record_id"), path)
    rows = src.read_timelines(spark, path, lines=True)
    n = F.when(F.col("events").isNotNull(), F.size("events")).cast("bigint")
    return rows.select("subject_id", "hadm_id", "note_id", n.alias("n_events"), F.md5(F.coalesce("discharge_summary", F.lit(""))).alias("digest"), "demographics.gender", F.date_format("admission.admittime", "yyyy-MM-dd HH:mm:ss").alias("admittime"))


@query(f"WITH {LATEST_SQL} SELECT record_id, len(list_filter(events, lambda e: e.event_type = 'lab')) AS n_labs, demographics.anchor_age AS anchor_age FROM notes")
def stored_parquet_text(spark, d):
    """Parquet with nested columns as JSON text, parsed again."""
    path = _place(spark, "flat")
    src.write_parquet_text(_records(spark, d), path)
    rows = spark.read.parquet(path)
    events = F.from_json("events", "array<struct<event_type:string>>")
    labs = F.filter(events, lambda e: F.coalesce(e["event_type"] == "lab", F.lit(False)))
    return rows.select("record_id", F.when(F.col("events").isNotNull(), F.size(labs)).cast("bigint").alias("n_labs"), F.get_json_object("demographics", "$.anchor_age").cast("int").alias("anchor_age"))


def _nested_pairs(spark: SparkSession, d: str) -> DataFrame:
    qa = table(spark, d, "qa_pairs").where("subject_id IS NOT NULL AND hadm_id IS NOT NULL")
    return qa.select("subject_id", "hadm_id", "note_id", F.array(F.struct("question", "answer", "difficulty", "source_types", "reasoning", "correct")).alias("qa_pairs"))


@query("SELECT subject_id, hadm_id, count(*) AS n_pairs, count(answer) AS n_answers, sum(length(question)) AS n_chars FROM qa_pairs WHERE subject_id IS NOT NULL AND hadm_id IS NOT NULL GROUP BY 1, 2")
def stored_qa_csv(spark, d):
    """Pairs as JSON text in CSV, a damaged row for every stay among them: rows that don't parse are skipped, lists of a stay joined."""
    path = _place(spark, "qa-csv")
    rows = _nested_pairs(spark, d).withColumn("qa_pairs", F.to_json("qa_pairs"))
    damaged = rows.select("subject_id", "hadm_id", "note_id", F.lit('[{"question": "cut').alias("qa_pairs")).distinct()
    rows.unionByName(damaged).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    pairs = src.read_qa_csv(spark, path)
    total = F.aggregate("qa_pairs", F.lit(0).cast("bigint"), lambda n, p: n + F.coalesce(F.char_length(p["question"]), F.lit(0)))
    return pairs.select("subject_id", "hadm_id", F.size("qa_pairs").cast("bigint").alias("n_pairs"), F.size(F.filter("qa_pairs", lambda p: p["answer"].isNotNull())).cast("bigint").alias("n_answers"), total.alias("n_chars"))


@query(f"""WITH {LATEST_SQL}, kept AS (SELECT subject_id, hadm_id FROM notes WHERE regexp_matches(discharge_summary, '[^' || '{cat.BLANK[1:]}'))
    SELECT subject_id, hadm_id, count(*) AS n_pairs FROM qa_pairs JOIN kept USING (subject_id, hadm_id) GROUP BY 1, 2""")
def stored_merge(spark, d):
    """Timelines and pairs written as JSON lines, loaded and merged by stay."""
    timelines, qa = _place(spark, "timelines"), _place(spark, "qa-json")
    src.write_json(_records(spark, d).drop("record_id"), timelines)
    src.write_json(_nested_pairs(spark, d).groupBy("subject_id", "hadm_id").agg(F.flatten(F.collect_list("qa_pairs")).alias("qa_pairs")), qa)
    return src.load_and_merge(spark, timelines, qa, lines=True).select("subject_id", "hadm_id", F.size("qa_pairs").cast("bigint").alias("n_pairs"))


@query(f"WITH {cat.RESULTS_SQL} SELECT replace(model || '/x', '/', '--') AS model, method, count(*) AS n, round(avg(token_f1), 6) AS mean FROM results GROUP BY 1, 2")
def stored_results(spark, d):
    """Result rows written by model and method, slashes made harmless and prompts left out, and read back."""
    path = _place(spark, "results")
    src.write_results(cat.results(spark, d).withColumns({"model": F.concat("model", F.lit("/x")), "user_prompt": F.lit("p")}), path)
    return spark.read.parquet(path).groupBy("model", "method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("token_f1"), 6).alias("mean"))


@query(f"""WITH {cat.RESULTS_SQL}, s AS (SELECT model, method, CASE WHEN method = 'verified' THEN 1.0 END AS judge_mean FROM results GROUP BY 1, 2), m AS (SELECT model, method, round(avg(context_tokens), 4) AS judge_mean FROM results WHERE method <> 'verified' AND model <> 'none' GROUP BY 1, 2)
    SELECT s.model, s.method, CAST(coalesce(m.judge_mean, s.judge_mean) AS DOUBLE) AS judge_mean FROM s LEFT JOIN m ON m.model = s.model AND m.method = s.method""")
def summary_upsert(spark, d):
    """Judge means put into a summary; cells without a new mean keep their old one."""
    rows = cat.results(spark, d)
    summary = rows.select("model", "method").distinct().withColumn("judge_mean", F.when(F.col("method") == "verified", 1.0))
    means = rows.where("method <> 'verified' AND model <> 'none'").groupBy("model", "method").agg(F.round(F.avg("context_tokens"), 4).alias("judge_mean"))
    return src.upsert_means(summary, means)


# ---- calls with functions that SQL can follow -----------------------------------------------


def length_judge(system: str, user: str) -> dict:
    """A judge whose verdict is the length of the request, so that its rows can be checked."""
    return {"answer": f"Score: {len(user) % 7}"}


JUDGE_SQL = "'Question: ' || question || chr(10) || chr(10) || 'Reference answer: ' || coalesce(reasoning, '') || chr(10) || chr(10) || 'Predicted answer: ' || answer"


def judge_rows(spark: SparkSession, d: str) -> DataFrame:
    qa = table(spark, d, "qa_pairs").where("question IS NOT NULL AND answer IS NOT NULL")
    old = F.when(F.col("qa_id") % 3 == 0, 4)
    return qa.select("qa_id", "question", F.coalesce("reasoning", F.lit("")).alias("gold_answer"), "answer", old.alias("judge_score"), F.lit(None).cast("string").alias("judge_error"))


@query(f"SELECT qa_id, CASE WHEN qa_id % 3 = 0 THEN 4 WHEN length(p) % 7 BETWEEN 1 AND 5 THEN CAST(length(p) % 7 AS INTEGER) END AS judge_score, CASE WHEN qa_id % 3 <> 0 AND length(p) % 7 NOT BETWEEN 1 AND 5 THEN 'unparseable' END AS judge_error FROM (SELECT *, {JUDGE_SQL} AS p FROM qa_pairs WHERE question IS NOT NULL AND answer IS NOT NULL)")
def judge_pending_rows(spark, d):
    """Rows without a judge score get one, others keep theirs."""
    return infer.judge_pending(judge_rows(spark, d), length_judge, "rubric").select("qa_id", "judge_score", "judge_error")


@query(f"SELECT qa_id, md5({JUDGE_SQL}) AS digest FROM qa_pairs WHERE question IS NOT NULL AND answer IS NOT NULL")
def judge_prompts(spark, d):
    return infer.judge_pending(judge_rows(spark, d), length_judge, "rubric", rescore=True, dry_run=True).select("qa_id", F.md5("user_prompt").alias("digest"))


@query("SELECT qa_id, question, CASE qa_id % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'object' ELSE 'single' END AS form FROM qa_pairs WHERE question IS NOT NULL")
def unwrapped_answers(spark, d):
    """Pairs taken out of a model's text: a list, an object that holds one, or a single pair, in a code fence or not."""
    pair = F.to_json(F.struct("question", "answer"))
    form = F.element_at(F.array(F.lit("list"), F.lit("object"), F.lit("single")), (F.col("qa_id") % 3 + 1).cast("int"))
    text = F.when(form == "list", F.concat(F.lit("["), pair, F.lit("]"))).when(form == "object", F.concat(F.lit('{"data": ['), pair, F.lit("]}"))).otherwise(pair)
    fenced = F.when(F.col("qa_id") % 2 == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).otherwise(text)
    rows = table(spark, d, "qa_pairs").where("question IS NOT NULL").select("qa_id", form.alias("form"), F.explode(infer.unwrap_json(fenced)).alias("p"))
    return rows.select("qa_id", "p.question", "form")


@query(f"""WITH {cat.NOTES_SQL} SELECT q.qa_id, n.record_id FROM qa_pairs q JOIN notes n USING (subject_id, hadm_id) WHERE regexp_matches(q.question, '[^' || '{cat.BLANK[1:]}') AND regexp_matches(q.answer, '[^' || '{cat.BLANK[1:]}')
    AND regexp_matches(n.discharge_summary, '[^' || '{cat.BLANK[1:]}') AND coalesce(q.correct, true) AND (q.source_types IS NULL OR list_contains(q.source_types, 'discharge_summary')) ORDER BY q.qa_id, n.record_id LIMIT 200""")
def evaluation_records(spark, d):
    """The first 200 questions to evaluate: valid, not marked wrong, grounded in the summary, with a note that isn't blank."""
    q = cat.questions(spark, d).where(F.coalesce("correct", F.lit(True)) & (F.col("source_types").isNull() | F.array_contains("source_types", "discharge_summary")))
    n = cat.notes(spark, d, "discharge_summary").where(T.strip_blank(F.col("discharge_summary")) != "")
    return q.select("qa_id", "subject_id", "hadm_id").join(n.select("subject_id", "hadm_id", "record_id"), ["subject_id", "hadm_id"]).select("qa_id", "record_id").orderBy("qa_id", "record_id").limit(200)


@query(f"WITH {cat.CHUNKS_SQL}, {cat.FIXED_SQL.replace(cat.NOTES_SQL + ', ', '').replace('tok AS', 'ftok AS').replace('FROM tok)', 'FROM ftok)').replace('win AS', 'fwin AS').replace('FROM win)', 'FROM fwin)')} SELECT 'section' AS strategy, count(*) AS n FROM chunks UNION ALL SELECT 'fixed', count(*) FROM fixed")
def chunk_strategies(spark, d):
    notes = cat.notes(spark, d, "discharge_summary").select("record_id", "discharge_summary")
    counted = [cat.chunk.chunk_notes(notes, "record_id", "discharge_summary", s).agg(F.lit(s).alias("strategy"), F.count(F.lit(1)).alias("n")) for s in ("section", "fixed")]
    return counted[0].unionByName(counted[1])


@query(f"""WITH {cat.PAIRS_SQL}, p AS (SELECT {cat.SEC_IDX} AS s, {cat.QT_IDX} AS t FROM pairs) SELECT CAST(13 + s AS INTEGER) AS idx, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT CAST(32 + t AS INTEGER), count(*) FROM p GROUP BY 1 UNION ALL SELECT CAST(38 + s * 6 + t AS INTEGER), count(*) FROM p GROUP BY 1""")
def one_hot_counts(spark, d):
    """How often every section, question type and combination of both is the active one in the vectors of all pairs."""
    rows = cat.asked(spark, d).join(cat.note_chunks(spark, d), "record_id").select("question", "chunk", "section", "section_header", "position")
    vectors = features.active_features(features.pair_features(rows)).where("idx BETWEEN 13 AND 151")
    return vectors.groupBy("idx").agg(F.count(F.lit(1)).alias("n"))


CROSS_SQL = {"abnormal_lab": f"regexp_matches(chunk, '(?i){T.ABNORMAL_LAB}')", "critical_event": f"regexp_matches(chunk, '(?i){T.CRITICAL_EVENT}')", "temporal_marker": f"regexp_matches(chunk, '(?i){T.TEMPORAL_MARKER}')"}


@query(f"WITH {cat.PAIRS_SQL}, p AS (SELECT *, {cat.QTYPE_SQL} AS qtype FROM pairs) " + " UNION ALL ".join(f"SELECT 'int_{s}_x_{t}' AS feature, count(*) AS n FROM p WHERE {CROSS_SQL[s]} AND qtype = '{t}'" for s, t in features.CROSSED if s in CROSS_SQL))
def crossed_counts(spark, d):
    """How often a signal in the text meets a type of question; without discharge times none is within a day."""
    rows = cat.asked(spark, d).join(cat.note_chunks(spark, d), "record_id").select("question", "chunk", "section", "section_header", "position")
    names = [f"int_{s}_x_{t}" for s, t in features.CROSSED if s in CROSS_SQL]
    at = {n: i for i, n in enumerate(features.feature_names())}
    vector = features.pair_features(rows).select(features.feature_array(rows).alias("v"))
    counts = vector.agg(*[F.count_if(F.get("v", F.lit(at[n])) != 0).alias(n) for n in names])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("n")) for n in names])))
