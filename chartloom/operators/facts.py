"""Relational facts to events: one sparse row form for five kinds of fact, and their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["subject_id", "hadm_id"]
EVENT_COLUMNS = {
    "event_type": "string", "timestamp": "string", "end_time": "string", "label": "string", "value": "string", "valuenum": "double", "unit": "string",
    "flag": "string", "drug": "string", "dose": "string", "dose_unit": "string", "route": "string", "seq_num": "int", "icd_code": "string", "title": "string",
}
# Columns of the facts, by the field of the event they become.
LAB = {"timestamp": "charttime", "label": "lab_label", "value": "value", "valuenum": "valuenum", "unit": "valueuom", "flag": "flag"}
VITAL = {"timestamp": "charttime", "label": "vital_label", "value": "value", "valuenum": "valuenum", "unit": "valueuom"}
PRESCRIPTION = {"timestamp": "starttime", "end_time": "stoptime", "drug": "drug", "dose": "dose_val_rx", "dose_unit": "dose_unit_rx", "route": "route"}
PROCEDURE = {"timestamp": "chartdate", "icd_code": "icd_code", "title": "procedure_title"}
DIAGNOSIS = {"seq_num": "seq_num", "icd_code": "icd_code", "title": "diagnosis_title"}
PRESCRIPTION_COLUMNS = [
    "subject_id", "hadm_id", "pharmacy_id", "starttime", "stoptime", "drug_type", "drug", "gsn", "ndc", "prod_strength", "form_rx", "dose_val_rx", "dose_unit_rx", "form_val_disp", "form_unit_disp", "route",
]


def _events(facts: DataFrame, kind: str, fields: dict[str, str], **fixed: Column) -> DataFrame:
    """Keys and all event columns; a fact's column that is missing counts as null, a time missing in its row as ``None``."""
    out = []
    for name, t in EVENT_COLUMNS.items():
        if name == "event_type":
            c = F.lit(kind)
        elif name in fixed:
            c = fixed[name]
        elif name in fields and fields[name] in facts.columns:
            c = F.col(fields[name])
            c = F.coalesce(c.cast("string"), F.lit("None")) if name in ("timestamp", "end_time") else c
        else:
            c = F.lit(None)
        out.append(c.cast(t).alias(name))
    return facts.select(*KEYS, *out)


def lab_events(facts: DataFrame) -> DataFrame:
    return _events(facts, "lab", LAB)


def vital_events(facts: DataFrame) -> DataFrame:
    return _events(facts, "vital", VITAL)


def medication_events(facts: DataFrame) -> DataFrame:
    return _events(facts, "medication", PRESCRIPTION)


def procedure_events(facts: DataFrame) -> DataFrame:
    return _events(facts, "procedure", PROCEDURE)


def diagnosis_events(facts: DataFrame) -> DataFrame:
    """Diagnoses have no time of their own; a missing place in the list is 0."""
    return _events(facts, "diagnosis", DIAGNOSIS, timestamp=F.lit(""), seq_num=F.coalesce(F.col("seq_num").cast("int"), F.lit(0)))


def all_events(labs: DataFrame, vitals: DataFrame, prescriptions: DataFrame, procedures: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """The union of all five; the order of ties is put right by ``timeline.sorted_events``."""
    out = lab_events(labs)
    for part in (vital_events(vitals), medication_events(prescriptions), procedure_events(procedures), diagnosis_events(diagnoses)):
        out = out.unionByName(part)
    return out
