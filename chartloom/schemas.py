"""Explicit schemas of the records the engine reads and writes; nothing is inferred."""

EVENT = (
    "struct<event_type:string, timestamp:string, end_time:string, label:string, value:string, valuenum:double, unit:string, flag:string, "
    "drug:string, dose:string, dose_unit:string, route:string, seq_num:int, icd_code:string, title:string>"
)
QA = "struct<question:string, answer:string, difficulty:string, source_types:array<string>, reasoning:string, correct:boolean>"
PATIENT = "struct<subject_id:bigint, gender:string, anchor_age:int, anchor_year:int, anchor_year_group:string, dod:date>"
ADMISSION = (
    "struct<subject_id:bigint, hadm_id:bigint, admittime:timestamp, dischtime:timestamp, deathtime:timestamp, admission_type:string, "
    "admit_provider_id:string, admission_location:string, discharge_location:string, insurance:string, language:string, marital_status:string, race:string>"
)
TIMELINE = f"subject_id bigint, hadm_id bigint, note_id string, demographics {PATIENT}, admission {ADMISSION}, discharge_summary string, events array<{EVENT}>"
QA_RECORD = f"subject_id bigint, hadm_id bigint, qa_pairs array<{QA}>, model string, tokens_prompt int, tokens_completion int, error string, raw string"
QA_CSV = "subject_id bigint, hadm_id bigint, note_id string, qa_pairs string"
CHUNK = "struct<text:string, section:string, section_header:string, position:double, chunk_idx:int>"
RESULT = (
    "subject_id bigint, hadm_id bigint, question string, gold_answer string, difficulty string, source_types array<string>, method string, "
    "context_tokens int, answer string, prompt_tokens int, completion_tokens int, cached boolean, error string, token_f1 double, token_precision double, "
    "token_recall double, rouge_l_f1 double, rouge_l_precision double, rouge_l_recall double, judge_score int, judge_error string"
)
