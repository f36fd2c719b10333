"""Canonical form of questions: what is left when wording that doesn't decide is taken away."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Openings that add nothing to a question.
OPENINGS = (
    r"(?:q ?\d+|question|the question is|you asked|asked|please tell me|please|tell me|can you tell me|could you tell me|i would like to know|"
    r"according to the (?:chart|record|records|note|notes)|from the (?:record|records|chart|note|notes)|based on the (?:chart|record|records|note|notes)|"
    r"per the (?:chart|record|records|note|notes)|in the (?:chart|record)|regarding this stay|for this patient|answer)"
)
# Common abbreviations and words that are used for each other.
SAME_WORDS = {
    "hgb": "hemoglobin", "hb": "hemoglobin", "haemoglobin": "hemoglobin", "k+": "potassium", "na+": "sodium", "ca": "calcium", "ca2+": "calcium",
    "cr": "creatinine", "creat": "creatinine", "gluc": "glucose", "plt": "platelet count", "plts": "platelet count", "wbc": "white cell count",
    "crp": "c reactive protein", "sbp": "systolic blood pressure", "dbp": "diastolic blood pressure", "bp": "blood pressure", "hr": "heart rate",
    "rr": "respiratory rate", "temp": "temperature", "t": "temperature", "spo2": "oxygen saturation", "sats": "oxygen saturation", "sat": "saturation",
    "o2": "oxygen", "bili": "bilirubin", "tbili": "total bilirubin", "lac": "lactate", "pt": "patient", "med": "medication", "meds": "medication",
    "medications": "medication", "abx": "antibiotic", "adm": "admission", "adms": "admission", "admissions": "admission", "earlier": "prior", "previous": "prior",
    "past": "prior", "dc": "discharge", "hf": "heart failure", "chf": "heart failure", "sob": "shortness of breath", "documented": "document", "documents": "document",
    "hd": "haemodialysis", "hemodialysis": "haemodialysis", "us": "ultrasound", "lp": "lumbar puncture", "min": "lowest", "max": "highest", "minimum": "lowest",
    "maximum": "highest", "drug": "drug", "dropped": "drop", "rx": "medication", "ac": "anticoagulation",
}
# Words that carry the turn of a phrase, not its content, in the languages of the questions.
TURNS = """a an the is are was were be been being am do does did has have had it its this that there of in on at to for by with as and or
what which who whom whose how when where why take takes took taken place until happen happened recorded given say said says about mentioned
value values measured wie hoch war der die das den dem wert für fur am um welcher welche welches wurde wurden gemessen betrug lag bei von im ist
quelle quel quels était etait la le les l de du des à a été ete mesuré mesure mesurée taux valeur fue el los las valor cuál cual qué que se midió midio del en era
was""".split()

INTERROGATIVES = "what which who whom whose how when where why welche welcher welches wie wann warum wer quel quelle quels quand comment pourquoi combien qué cuál cuándo cómo cuánto quién".split()


def plain_text(c: Column) -> Column:
    """Lower case with odd blanks and invisible characters made plain."""
    c = F.regexp_replace(F.lower(c), r"[​-‏⁠﻿­]", "")
    return F.trim(F.regexp_replace(c, r"(?U)[\s ]+", " "))


def content_tokens(plain: Column) -> Column:
    """Tokens of a ``plain_text`` question without opening, turns of phrase and order; numbers and dates stay whole."""
    text = F.regexp_replace(plain, r"^(?:" + OPENINGS + r"\s*[:.,)]*\s*)+", "")
    tokens = F.regexp_extract_all(text, F.lit(r"(?U)(\d+(?:[-:./]\d+)*|[\p{L}]+[0-9]*\+?)"), F.lit(1))
    words = F.create_map(*[F.lit(x) for k, v in SAME_WORDS.items() for x in (k, v)])
    # Membership is a hash look-up; the map is only searched for words that are in it.
    spelled = F.flatten(F.transform(tokens, lambda t: F.when(t.isin(*SAME_WORDS), F.split(F.try_element_at(words, t), " ")).otherwise(F.array(t))))
    return F.array_sort(F.array_distinct(F.filter(spelled, lambda t: ~t.isin(*sorted(set(TURNS))))))


def number_key(tokens: Column) -> Column:
    """The dates, times and numbers among the tokens: questions that differ there differ."""
    return F.array_join(F.filter(tokens, lambda t: t.rlike(r"^\d")), " ")


def word_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.rlike(r"^\d"))
