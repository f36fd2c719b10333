"""Column kernels on text: tokens, overlaps, signals and labels. All stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks as Unicode has them, spelled out so that every regex engine agrees.
BLANK = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = "[a-z0-9]+"

# Vocabularies and patterns that results depend on.
ENTITIES = """sodium potassium creatinine glucose hemoglobin hematocrit wbc platelet bun bicarbonate chloride calcium magnesium
phosphorus albumin bilirubin troponin lactate inr ptt ast alt alkaline phosphatase bnp lipase amylase
temperature pulse systolic diastolic saturation respiratory
aspirin metoprolol lisinopril atorvastatin furosemide warfarin insulin heparin vancomycin metformin amlodipine
omeprazole lorazepam morphine acetaminophen ibuprofen prednisone dexamethasone clopidogrel amiodarone digoxin""".split()
BOOST_SECTIONS = ["labs", "vitals", "medications", "results"]
MEASUREMENT = r"\b\d+\.?\d*\s*(?:meq|mg|g|dl|ml|mmol|units?|%|bpm|mmhg|kg|iu|ng|mcg|miu|u/l|/ul)\b"
STOPWORDS = """a an the is was were be been being have has had do does did will would could should may might shall can what which who
whom how when where why this that these those i we you he she they it its their our your his her at by for in on of to up or and not with from
as about any all also are than if patient patients s during after before per mg ml discharge admission""".split()
TEMPORAL_MARKER = (
    r"\b(today|tonight|overnight|this\s+(morning|afternoon|evening|night)|earlier\s+today|just\s+now|a\s+few\s+hours"
    r"|post[\-\s]?op\s+day\s*\d*|pod\s*#?\s*\d+|hospital\s+day\s*\d*|hd\s*#?\s*\d+|day\s+[1-9]\d?(?:\s|$))"
)
CRITICAL_EVENT = (
    r"\b(icu|intensive\s+care\s+unit|micu|sicu|ccicu|neuro\s*icu|intubat|extubat|re[\-\s]?intubat|mechanical\s+ventilat|vent(?:ilator)?"
    r"|vasopressor|pressor|norepinephrine|dopamine|epinephrine\s+drip|cardiac\s+arrest|code\s+blue|cpr|rapid\s+response"
    r"|emergent(?:ly)?|emergenc|transfer(?:red)?\s+to\s+(?:the\s+)?(?:icu|micu|sicu))"
)
ABNORMAL_LAB = (
    r"(\[(?:H|L|abnormal|critical|high|low)\]|\bcritical\s+(?:value|result|lab)\b|\b(?:elevated|abnormal)\s+\w+\s*(?:level|value|result)?\b"
    r"|\bmarkedly\s+(?:elevated|reduced|low|high)\b)"
)
TIMESTAMP = r"\b(\d{4}-\d{2}-\d{2}(?:\s+\d{2}:\d{2}(?::\d{2})?)?)\b"
HEADER_FLAGS = {
    "has_discharge_meds_hdr": r"discharge\s+med",
    "has_admission_meds_hdr": r"med.*\badmission\b|\badmission\b.*med",
    "has_discharge_labs_hdr": r"(discharge|pertinent)\s+(lab|result)",
    "has_admission_labs_hdr": r"lab.*\badmission\b|\badmission\b.*lab|labs\s+on\s+admission",
}
QUESTION_KEYWORDS = {
    "medications": ["medication", "drug", "prescribed", "discharge on", "taking", "medications", "meds", "dose", "dosage"],
    "diagnosis": ["diagnosis", "diagnosed", "condition", "disease", "disorder", "finding", "impression"],
    "labs": ["lab", "laboratory", "level", "result", "value", "test", "sodium", "potassium", "creatinine", "glucose", "hemoglobin"],
    "imaging": ["imaging", "scan", "x-ray", "ct ", "mri", "ultrasound", "radiograph", "chest"],
    "procedure": ["procedure", "surgery", "operation", "performed", "intervention"],
}
QUESTION_TYPES = [*QUESTION_KEYWORDS, "other"]
HEADER_LINE = r"^[ \t]*([A-Z][A-Za-z0-9 /\-]+:)\s*$|^[ \t]*([A-Z][A-Z0-9 /\-]{3,})\s*$"
SECTION_PATTERNS = [
    ("allerg", "allergies"), (r"chief\s+complaint", "chief_complaint"), (r"history\s+of\s+present", "hpi"), (r"past\s+medical", "pmh"),
    (r"social\s+history", "social"), (r"family\s+history", "family"), (r"physical\s+exam", "exam"), (r"pertinent\s+result", "results"),
    (r"(brief\s+)?hospital\s+course", "hospital_course"), ("medication|drug", "medications"), (r"discharge\s+diag", "diagnosis"),
    (r"discharge\s+cond", "discharge_condition"), (r"discharge\s+disp", "discharge_disposition"), (r"discharge\s+instruct", "discharge_instructions"),
    (r"follow\s*[-–]?\s*up", "followup"), ("lab|laboratory", "labs"), (r"vital\s*sign", "vitals"), ("procedure|surger|operation", "procedure"), ("diagnos", "diagnosis"),
]
SECTIONS = """medications diagnosis hospital_course results hpi allergies chief_complaint pmh exam labs followup discharge_instructions
discharge_condition discharge_disposition social family vitals procedure other""".split()


def alnum_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def alpha_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))


def blank_tokens(c: Column) -> Column:
    return F.filter(F.split(c, BLANK + "+"), lambda t: t != "")


_BLANKS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip_blank(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def _shared(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays: one pass over the tokens of both in order."""
    sided = lambda xs, side: F.transform(xs, lambda t: F.struct(t.alias("t"), F.lit(side).alias("s")))
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        one, other = (x["s"] == 0).cast("int"), (x["s"] == 1).cast("int")
        same = F.struct(acc["t"].alias("t"), (acc["a"] + one).alias("a"), (acc["b"] + other).alias("b"), acc["n"].alias("n"))
        new = F.struct(x["t"].alias("t"), one.alias("a"), other.alias("b"), (acc["n"] + F.least(acc["a"], acc["b"])).alias("n"))
        return F.when(x["t"] == acc["t"], same).otherwise(new)

    return F.aggregate(F.array_sort(F.concat(sided(a, 0), sided(b, 1))), start, step, lambda acc: acc["n"] + F.least(acc["a"], acc["b"]))


def token_f1(a: Column, b: Column, both_empty: float = 0.0) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of token arrays; ``both_empty`` is the value when both are empty."""
    n = _shared(a, b).cast("double")
    p, r = n / F.size(a), n / F.size(b)
    some = (F.size(a) > 0) & (F.size(b) > 0)
    none = F.when((F.size(a) == 0) & (F.size(b) == 0), both_empty).otherwise(0.0)
    return tuple(F.when(some, x).otherwise(none) for x in (p, r, F.when(n > 0, 2 * p * r / (p + r)).otherwise(0.0)))


def overlap_share(q: Column, c: Column, drop: list[str] | None = None) -> Column:
    """Share of the distinct tokens of q, without ``drop``, that occur in c; 0 if q has none."""
    own = F.array_distinct(q)
    if drop:
        own = F.array_except(own, F.array(*[F.lit(w) for w in drop]))
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, c)).cast("double") / F.size(own)).otherwise(0.0)


def numeric_density(c: Column) -> Column:
    t = blank_tokens(c)
    return F.when(F.size(t) > 0, F.size(F.filter(t, lambda x: x.rlike(r"^\d"))).cast("double") / F.size(t)).otherwise(0.0)


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(f"(?i){pattern}"))


def has_match(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?i){pattern}").cast("double")


def question_type(c: Column) -> Column:
    out, low = None, F.lower(c)
    for kind, words in QUESTION_KEYWORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")


def section_of(header: Column) -> Column:
    out = None
    for pattern, name in SECTION_PATTERNS:
        hit = header.rlike(f"(?i){pattern}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def temporal_proximity(text: Column, dischtime: Column) -> dict[str, Column]:
    """Days from the first timestamp in the text to discharge over 30, its two flags, and whether there was none."""
    found = F.nullif(F.regexp_extract(text, TIMESTAMP, 1), F.lit(""))
    layout = F.when(F.length(found) > 10, F.try_to_timestamp(found, F.lit("yyyy-MM-dd HH:mm:ss"))).otherwise(F.try_to_timestamp(found, F.lit("yyyy-MM-dd")))
    leave = F.try_to_timestamp(F.replace(F.substring(dischtime, 1, 19), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss"))
    days = F.greatest(F.lit(0.0), (F.unix_seconds(leave) - F.unix_seconds(layout)) / 86400.0)
    known = days.isNotNull() & layout.isNotNull() & leave.isNotNull()
    return {
        "days_to_discharge": F.when(known, F.least(days / 30.0, F.lit(1.0))).otherwise(0.5),
        "is_within_24h": F.when(known, (days <= 1.0).cast("double")).otherwise(0.0),
        "is_within_1week": F.when(known, (days <= 7.0).cast("double")).otherwise(0.0),
        "has_no_timestamp": F.when(known, 0.0).otherwise(1.0),
    }


def entity_tokens(question: Column) -> Column:
    return F.array_intersect(alpha_tokens(question), F.array(*[F.lit(e) for e in ENTITIES]))


def judge_score(raw: Column) -> Column:
    """A 1-5 score out of a judge's text: the whole text, or its first lone digit 1-5; null if there is none."""
    text = strip_blank(raw)
    found = F.when(text.rlike("^[1-5]$"), text).otherwise(F.regexp_extract(text, r"\b([1-5])\b", 1))
    return F.nullif(found, F.lit("")).try_cast("int")


def formatted(c: Column) -> Column:
    """Null and NaN as empty text, anything else trimmed."""
    return F.coalesce(F.when(c.cast("string") == "NaN", "").otherwise(strip_blank(c.cast("string"))), F.lit(""))
