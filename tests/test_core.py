"""Nested records, units, implausible readings."""

import datetime as dt
import json

from chartloom.operators import flatten, spikes, units
from chartloom.session import table

EVENT = "struct<" + ",".join(f"{f}:{t}" for f, t in flatten.EVENT_FIELDS.items()) + ">"
TIMELINE = f"record_id bigint, demographics struct<subject_id:bigint,gender:string>, admission struct<hadm_id:bigint>, events array<{EVENT}>, origin string"
EV_COLUMNS = "event_id bigint, subject_id bigint, hadm_id bigint, event_type string, timestamp string, label string, value string, valuenum double, unit string, drug string, dose string, dose_unit string, source string, loaded_at timestamp, q_item string"
REFERENCE = [("Heart Rate", "vital", "bpm", 10.0, 300.0), ("Body Temperature", "vital", "degC", 25.0, 44.0), ("Glucose", "lab", "mg/dL", 10.0, 1500.0), ("Furosemide", "drug", "mg", None, None), ("Heparin", "drug", "UNIT", None, None), ("Cholecalciferol", "drug", "UNIT", None, None)]


def reference(spark):
    return spark.createDataFrame(REFERENCE, "label string, kind string, common_unit string, possible_low double, possible_high double")


def event(kind, **x):
    return tuple(kind if f == "event_type" else x.get(f) for f in flatten.EVENT_FIELDS)


def test_flatten_counts_every_layout(spark):
    lab = {"event_type": "lab", "label": "Glucose", "valuenum": 5.0}
    payloads = [
        {"demographics": {"gender": "F"}, "admission": {"hadm_id": 1}, "events": [lab, None, lab]},
        {"demographics": {}, "admission": json.dumps({"hadm_id": 2}), "events": json.dumps([lab])},
        {"demographics": None, "events": {"lab": [{"label": "a"}], "vital": {"label": "b"}}},
        {"admission": {"stays": [{"events": [lab]}, {"stay_id": "x"}, {"events": [lab, lab]}]}},
        {"stays": [{"events": [lab]}], "events": None},
    ]
    raw = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)] + [(9, '{"events": [{"event_type": "lab"'), (10, None), (11, ""), (12, "[]x")], "raw_id bigint, payload string")
    timelines = spark.createDataFrame([(1, (1, None), None, [event("lab"), None, event("vital")], "x"), (2, (None, None), (None,), None, "x"), (3, None, (7,), [], "x"), (1, (1, None), None, [event("lab")], "x")], TIMELINE)
    rows = {(r.origin, r.record_id, r.child): r.n_rows for r in flatten.child_counts(timelines, raw).collect()}
    assert {k[1:]: v for k, v in rows.items() if k[0] == "timeline_raw"} == {
        (0, "demographics"): 1, (0, "admission"): 1, (0, "lab"): 2, (1, "admission"): 1, (1, "lab"): 1, (2, "lab"): 1, (2, "vital"): 1, (3, "lab"): 3, (4, "lab"): 1,
    }
    assert {k[1:]: v for k, v in rows.items() if k[0] == "patient_timelines"} == {(1, "demographics"): 2, (1, "lab"): 2, (1, "vital"): 1, (3, "admission"): 1}


def test_flatten_empty_tables(spark):
    none = flatten.child_counts(spark.createDataFrame([], TIMELINE), spark.createDataFrame([], "raw_id bigint, payload string, feed string"))
    assert none.columns == ["origin", "record_id", "child", "n_rows"] and none.count() == 0


def readings(spark, rows):
    base = {"subject_id": 1, "hadm_id": 1, "event_type": "vital", "source": "s", "loaded_at": dt.datetime(2120, 1, 1)}
    names = [c.split()[0] for c in EV_COLUMNS.split(", ")]
    return spark.createDataFrame([tuple((base | {"event_id": i} | r).get(n) for n in names) for i, r in enumerate(rows)], EV_COLUMNS)


def test_units_of_readings_and_doses(spark):
    rows = [
        {"label": "Body Temperature", "valuenum": 98.6, "value": "98.6", "unit": "deg F"},
        {"label": "Body Temperature (degF)", "value": "98,6", "unit": ""},
        {"label": "Body Temperature", "value": "98.6°F"},
        {"label": "Body Temperature", "valuenum": 98.6},
        {"label": "Body Temperature", "valuenum": 37.0},
        {"label": "Glucose", "event_type": "lab", "value": "<5", "unit": "mmol/L"},
        {"label": "Glucose", "event_type": "lab", "value": "PENDING", "valuenum": None, "unit": "mmol/L"},
        {"label": "Glucose", "event_type": "lab", "valuenum": 5.0, "unit": " MMOL/L "},
        {"label": "Glucose", "event_type": "lab", "valuenum": 90.0, "unit": "mg / dL"},
        {"event_type": "medication", "drug": "FUROSEMIDE Tab", "dose": "0.02-0.04", "dose_unit": "g"},
        {"event_type": "medication", "drug": "furosemide", "dose": "2", "dose_unit": "TAB"},
        {"event_type": "medication", "drug": "Heparin", "dose": "5,000", "dose_unit": "units"},
        {"event_type": "medication", "drug": "Heparin", "dose": "5 kU"},
        {"event_type": "medication", "drug": "Cholecalciferol", "dose": "25", "dose_unit": "µg"},
        {"label": "Unheard of", "valuenum": 1.0, "unit": "furlong"},
        {"label": None, "valuenum": None},
    ]
    got = {r.event_id: r for r in units.normalise_quantities(readings(spark, rows).drop("q_item"), reference(spark)).collect()}
    assert [i for i in sorted(got) if got[i].q_converted] == [0, 1, 2, 3, 7, 9, 12, 13]
    assert all(abs(got[i].q_value - 37.0) < 1e-9 for i in range(5))
    assert got[5].q_value is None and got[6].q_value is None and got[10].q_value is None and got[14].q_value is None
    assert abs(got[9].q_value - 30) < 1e-9 and got[11].q_value == 5000 and got[12].q_value == 5000 and got[13].q_value == 1000
    assert units.converted_events(readings(spark, rows).drop("q_item").limit(0), reference(spark)).count() == 0


def test_implausible_readings(spark):
    at = lambda i: f"2120-01-{1 + i // 20:02d} {i % 20:02d}:00:00"
    calm = [{"hadm_id": h, "label": "Heart Rate", "valuenum": float(80 + (i * 7) % 11), "unit": "bpm", "timestamp": at(i)} for h in (1, 2) for i in range(60)]
    calm[10]["valuenum"] = 250.0
    calm[70]["valuenum"], calm[71]["valuenum"] = 245.0, 240.0
    calm[0]["valuenum"] = 250.0  # nothing before it
    for i in range(20, 28):
        calm[i]["valuenum"] = 82.5
    calm.append({"label": "Heart Rate", "valuenum": 9999.0, "unit": "bpm"})
    calm.append(calm[10] | {"loaded_at": dt.datetime(2120, 3, 1)})
    calm.append({"hadm_id": None, "label": "Heart Rate", "valuenum": -3.0, "timestamp": "NaT", "unit": "bpm"})
    found = {r.event_id: r.defect for r in spikes.implausible_readings(readings(spark, calm), reference(spark)).collect()}
    assert found == {10: "spike", 70: "spike", 71: "spike", 120: "impossible", 121: "spike", 122: "impossible", **{i: "stuck" for i in range(20, 28)}}


def test_implausible_readings_of_nothing(spark):
    assert spikes.implausible_readings(readings(spark, [{"label": None}]).limit(0), reference(spark)).count() == 0


def test_found_queries_have_stated_columns(spark, data):
    from chartloom.plans.problems import QUERIES

    assert QUERIES["p1_found"](spark, data).dtypes == [("origin", "string"), ("record_id", "bigint"), ("child", "string"), ("n_rows", "bigint")]
    assert QUERIES["p2_found"](spark, data).dtypes == [("event_id", "bigint")]
    assert QUERIES["p4_found"](spark, data).dtypes == [("event_id", "bigint"), ("defect", "string")]
    ids = QUERIES["p2_found"](spark, data)
    assert ids.count() == ids.distinct().count() > 0
    assert table(spark, data, "timeline_events").count() > ids.count()
