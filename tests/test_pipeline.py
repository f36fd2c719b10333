"""Scale-minded rewrites against brute force, and the pipeline's stores, calls and texts against worked cases."""

import json
import random
import threading
import types

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chartloom import session
from chartloom.functions import tokens
from chartloom.operators import chunk, facts, features, flatten, generate, infer, label, learn, report, retrieve, score, spikes, timeline
from chartloom.sources import tables

# ---- the shared folder ---------------------------------------------------------------------


def fake_session(master, folder=None):
    conf = types.SimpleNamespace(get=lambda k, d=None: folder, set=lambda k, v: None)
    context = types.SimpleNamespace(master=master, getConf=lambda: types.SimpleNamespace(get=lambda k: folder), setCheckpointDir=lambda p: None)
    return types.SimpleNamespace(conf=conf, sparkContext=context)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_has_to_name_its_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(fake_session(master))
    assert session.shared_dir(fake_session(master, "hdfs://shared")) == "hdfs://shared"


def test_released_tables_are_gone(spark):
    rows = session.materialise(spark.range(5), "numbers")
    files, target = session._file_system(spark, rows._written)
    assert rows.count() == 5 and files.exists(target)
    session.release(rows)
    assert not files.exists(target)
    session.release(spark.range(2))


def test_broadcast_is_checked(spark):
    hint = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower() or "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(session.broadcast_checked(spark.range(5), "few", 5)) and not hint(session.broadcast_checked(spark.range(6), "many", 5))


# ---- nested records ------------------------------------------------------------------------


def raw_rows(spark, payloads):
    return spark.createDataFrame([(i, "f", p) for i, p in enumerate(payloads)], "raw_id bigint, feed string, payload string")


TIMELINES = "record_id bigint, demographics struct<subject_id:bigint,gender:string>, admission struct<hadm_id:bigint>, events array<struct<event_type:string,label:string>>"


def test_line_ends_around_a_payload(spark):
    whole = '{"demographics": {"gender": "F"}, "events": "\\n [{\\"event_type\\": \\"lab\\"}]"}'
    raw = raw_rows(spark, [whole, whole + "\n", whole + " \r\n\t", "\n" + whole, whole[:-1] + "\n", whole + " x"])
    got = {(r.record_id, r.child) for r in flatten.child_counts(spark.createDataFrame([], TIMELINES), raw).collect()}
    assert got == {(i, c) for i in range(4) for c in ("demographics", "lab")}


def test_stays_and_groups_keep_their_links(spark):
    stays = '{"admission": {"hadm_id": 5, "stays": [{"stay_id": "a", "unit_name": "icu", "events": [{"event_type": "lab"}, null, {"event_type": "vital"}]}, null, {"stay_id": "b", "events": {"event_type": "lab"}}]}}'
    groups = '{"events": {"lab": [{"label": "x"}, {"label": "y"}], "vital": {"label": "z"}}}'
    raw, none = raw_rows(spark, [stays, groups]), spark.createDataFrame([], TIMELINES)
    assert sorted(tuple(r) for r in flatten.timeline_stays(none, raw).collect()) == [("timeline_raw", 0, 0, "a", "icu"), ("timeline_raw", 0, 2, "b", None)]
    rows = [(r.record_id, r.entry_idx, r.stay_idx, r.group_key, r.event_idx, r.event_type) for r in flatten.timeline_event_rows(none, raw).collect()]
    assert sorted(rows, key=lambda x: x[:2]) == [(0, 0, 0, None, 0, "lab"), (0, 1, 0, None, 2, "vital"), (0, 2, 2, None, 0, "lab"), (1, 0, None, "lab", 0, "lab"), (1, 1, None, "lab", 1, "lab"), (1, 2, None, "vital", 0, "vital")]
    own = spark.createDataFrame([(7, (1, None), None, [("lab", "a"), None, ("lab", "b")]), (8, None, None, None), (9, (None, None), (None,), [])], TIMELINES)
    assert [(r.record_id, r.entry_idx, r.event_idx) for r in flatten.timeline_event_rows(own, raw.limit(0)).orderBy("entry_idx").collect()] == [(7, 0, 0), (7, 1, 2)]
    assert sorted((r.record_id, r.child, r.n_rows) for r in flatten.child_counts(own, raw.limit(0)).collect()) == [(7, "demographics", 1), (7, "lab", 2)]


# ---- columns of the caller -----------------------------------------------------------------


def test_clashing_columns_come_back(spark):
    from chartloom.operators import units

    row = (1, 2, "lab", "Sodium", "140", None, "mmol/L", "2120-01-01 00:00:00", "s", None, None, None, None, "n", "f", "u", "c")
    events = spark.createDataFrame([row], EVENTS + ", _number string, _FACTOR string, Q_UNIT string, caller13 string")
    reference = spark.createDataFrame([("Sodium", "lab", "mmol/L", 90.0, 200.0)], REFERENCE)
    got = units.normalise_quantities(events, reference)
    r = got.first()
    assert (r["_number"], r["_FACTOR"], r["caller13"], r["q_unit"], r["q_value"]) == ("n", "f", "c", "mmol/L", 140.0) and "Q_UNIT" not in got.columns
    assert spikes.implausible_readings(events, reference).count() == 0


# ---- implausible readings ------------------------------------------------------------------

EVENTS = "event_id bigint, hadm_id bigint, event_type string, label string, value string, valuenum double, unit string, timestamp string, source string, loaded_at timestamp, drug string, dose string, dose_unit string"
REFERENCE = "label string, kind string, common_unit string, possible_low double, possible_high double"


def test_the_low_rank_part_decides_what_is_far(spark):
    """A daily rhythm is normal: what counts is the distance from it, not from the level."""
    rng = random.Random(4)
    rows, at = [], {}
    for stay in range(120):
        for day in range(1, 4):
            for hour in range(0, 24, 2):
                at[stay, day, hour] = len(rows)
                rows.append([len(rows), stay, 1000.0 + 100.0 * np.sin(hour * np.pi / 12) + rng.gauss(0, 4.0), f"2120-01-{day:02d} {hour:02d}:00:00"])
    reference = spark.createDataFrame([("Platelet Count", "lab", "K/uL", 0.0, 1e6)], REFERENCE)
    table = lambda: spark.createDataFrame([(i, h, "lab", "Platelet Count", None, float(v), "K/uL", t, "s", None, None, None, None) for i, h, v, t in rows], EVENTS)
    usual = spikes.source_levels(spikes.daily_profiles(spikes.sequenced(spikes.standardised_readings(table(), reference, ["platelet count"])))).first()
    rows[at[5, 2, 6]][2] = usual.level + 9.4 * usual.spread  # more than nine spreads off the level, less off the morning's normal
    rows[at[9, 2, 18]][2] = usual.level + 8.6 * usual.spread  # the other way round, in the evening
    rows[at[20, 2, 6]][2] = usual.level + 12 * usual.spread
    events = table()
    found = {r.event_id for r in spikes.implausible_readings(events, reference).collect() if r.defect == "spike"}
    assert found == {at[9, 2, 18], at[20, 2, 6]}


def test_runs_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([1, 2]), "lab", "Sodium", None, float(rng.choice([140, 140, 140, 140, 140, 140, 141])), "mmol/L", f"2120-01-01 {i // 60:02d}:{i % 60:02d}:00", "s", None, None, None, None) for i in range(600)]
    again = [(10_000 + r[0], *r[1:]) for r in rows if r[0] % 9 == 0]
    events = spark.createDataFrame(rows + again, EVENTS)
    reference = spark.createDataFrame([("Sodium", "lab", "mmol/L", 90.0, 200.0)], REFERENCE)
    want = set()
    for h in (1, 2):
        seq = [r for r in rows if r[1] == h]
        for i in range(len(seq)):
            lo, hi = i, i
            while lo > 0 and seq[lo - 1][5] == seq[i][5]:
                lo -= 1
            while hi + 1 < len(seq) and seq[hi + 1][5] == seq[i][5]:
                hi += 1
            if hi - lo + 1 >= 8:
                want |= {seq[i][0], *([10_000 + seq[i][0]] if seq[i][0] % 9 == 0 else [])}
    assert {r.event_id for r in spikes.implausible_readings(events, reference).collect() if r.defect == "stuck"} == want and want


def test_gram_groups_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [("s" if i % 3 else "t", True, [1, 2, 3], [int(c) for c in rng.integers(0, 12, 3)], [float(v) for v in rng.normal(0, 1, 3)]) for i in range(300)]
    known = {s: spikes.Source(2) for s in ("s", "t")}
    for own in known.values():
        own.spread[:] = 1.0
    df = spark.createDataFrame(rows, "source string, seq boolean, event_id array<bigint>, cell array<int>, v array<double>").repartition(7)
    one = spikes.fitted_bases(df, 12, known)
    monkeypatch.setattr(spikes, "GROUPS", 1)
    two = spikes.fitted_bases(df, 12, known)
    assert all(np.allclose(one[s] @ one[s].T, two[s] @ two[s].T) for s in ("s", "t"))


# ---- rewrites against brute force ----------------------------------------------------------


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_with_ties_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", block)
    rng = random.Random(3)
    items = [(i, [float(rng.randint(-1, 1)) for _ in range(3)]) for i in range(200)]
    queries = [(q, [float(rng.randint(-1, 1)) for _ in range(3)]) for q in range(30)]
    found = retrieve.nearest(spark.createDataFrame(queries, "query_id bigint, embedding array<double>"), spark.createDataFrame(items, "item_id bigint, embedding array<double>").repartition(5), 6)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.item_id)
    for q, v in queries:
        assert got[q] == [i for _, i in sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in items)[:6]]
    assert retrieve.nearest(spark.createDataFrame([], "query_id bigint, embedding array<double>"), spark.createDataFrame(items, "item_id bigint, embedding array<double>"), 3).count() == 0


def test_hash_split_is_the_prefix_of_the_seeded_order(spark):
    import hashlib

    rows = spark.range(1, 700).withColumn("key", F.when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 400)).select("key")
    keys = sorted({i % 400 for i in range(1, 700) if i % 50}, key=lambda k: hashlib.sha256(f"{k}|42".encode()).hexdigest())
    got = {r.key for r in label.hash_split(rows, "key").collect() if r.part == "train"}
    assert got == set(keys[: int(len(keys) * 0.85)])


def test_ranked_counts_against_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0.0, 1.0, round(rng.random(), 2), rng.random() * 1e6]), rng.randint(0, 1)) for _ in range(900)]
    got = [(r.score, r.tp, r.fp) for r in learn.ranked_counts(spark.createDataFrame(rows, "score double, label int")).orderBy(F.desc("score")).collect()]
    want, tp, fp = [], 0, 0
    for s in sorted({x for x, _ in rows}, reverse=True):
        tp += sum(y for x, y in rows if x == s)
        fp += sum(1 - y for x, y in rows if x == s)
        want.append((s, tp, fp))
    assert got == want


def test_subsequence_against_table():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 40))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert score.lcs(a, b) == table[-1][-1]


def test_sections_of_odd_notes(spark):
    notes = ["HISTORY\nfine\n\nPLAN:\n", "no header\nat all", "", None, "A:\nB:\n", "text\nMEDICATIONS ON ADMISSION\naspirin\r\n"]
    rows = spark.createDataFrame(list(enumerate(notes)), "k int, t string")
    got = {}
    for r in chunk.section_lines(rows, "k", "t").orderBy("k", "section_no").collect():
        got.setdefault(r.k, []).append((r.header, r.body))
    assert got == {0: [("HISTORY", "HISTORY\nfine"), ("PLAN", "PLAN:")], 1: [("preamble", "no header\nat all")], 4: [("preamble", "A:\nB:")], 5: [("preamble", "text"), ("MEDICATIONS ON ADMISSION", "MEDICATIONS ON ADMISSION\naspirin")]}
    long = spark.createDataFrame([(1, "HEADER LINE\n" + "a line of text\n" * 60_000)], "k int, t string")
    assert chunk.section_lines(long, "k", "t").count() == 1


def test_groups_fill_the_vector():
    assert len(features.feature_groups()) == len(features.feature_names()) == 166
    place = dict(zip(features.feature_names(), features.feature_groups()))
    assert place["numeric_density"] == "Structural / Positional" and place["content_word_overlap"] == "Similarity" and place["int_labs_labs"] == "Section × Q-Type" and place["int_abnormal_lab_x_labs"] == "Signal × Q-Type (C)"


def test_assembly_reads_only_the_driver_s_stays(spark):
    driver = spark.createDataFrame([(1, 10, "n")], "subject_id bigint, hadm_id bigint, note_id string")
    events = spark.createDataFrame([(1, 10, "lab", "2120"), (1, 10, "diagnosis", ""), (2, 20, "lab", "2121"), (None, None, "lab", "2122")], "subject_id bigint, hadm_id bigint, event_type string, timestamp string")
    people = spark.createDataFrame([(1, 50), (1, 60)], "subject_id bigint, anchor_age int")
    stays = spark.createDataFrame([(10, "2120")], "hadm_id bigint, admittime string")
    notes = spark.createDataFrame([(10, "old", 1), (10, "new", 2)], "hadm_id bigint, text string, charttime int")
    row = timeline.assemble(driver, people, stays, notes, events).collect()
    assert len(row) == 1 and row[0].demographics.anchor_age == 60 and row[0].discharge_summary == "new" and [e.event_type for e in row[0].events] == ["diagnosis", "lab"]
    assert timeline.assemble(driver.limit(0), people, stays, notes, events).count() == 0


# ---- tokens, facts, generation -------------------------------------------------------------


def test_public_tokens_count_and_cut(spark):
    bpe = tokens.bpe()
    texts = ["The patient's creatinine was 1.4 mg/dL.", "", None, "naïve 🙂 text", "<|endoftext|>", "word " * 5000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r for r in rows.select("i", bpe.count(F.col("t")).alias("n"), bpe.cut(F.col("t"), F.lit(3)).alias("c"), bpe.cut(F.col("t"), F.lit(10**6)).alias("whole")).collect()}
    one = tokens._tokenizer(f"{tokens.TOKENIZER_DIR}/{tokens.TOKENIZER_FILE}")
    for i, t in enumerate(texts):
        ids = one.encode(t or "", add_special_tokens=False).ids
        assert got[i].n == len(ids) and got[i].whole == t
        assert got[i].c == (t if len(ids) <= 3 else one.decode(ids[:3]))
    assert [r.c for r in rows.select(tokens.BLANKS.cut(F.col("t"), F.lit(2)).alias("c")).collect()][0] == "The patient's"


def test_public_tokens_take_one_text_at_a_time(spark, monkeypatch):
    path, seen = f"{tokens.TOKENIZER_DIR}/{tokens.TOKENIZER_FILE}", []
    one = tokens._tokenizer(path)

    def encode(text, **kw):
        seen.append(len(text))
        return one.encode(text, **kw)

    def encode_batch(texts, **kw):
        seen.append(sum(map(len, texts)))
        return one.encode_batch(texts, **kw)

    monkeypatch.setitem(tokens._LOADED, path, types.SimpleNamespace(encode=encode, encode_batch=encode_batch, decode=one.decode))
    texts = pd.Series([f"Note {i}: " + "stable overnight, afebrile. " * 50 for i in range(200)])
    counts, cuts = tokens.bpe().count.func(texts), tokens.bpe().cut.func(texts, pd.Series([5] * len(texts)))
    assert list(counts) == [len(one.encode(t).ids) for t in texts] and list(cuts) == [one.decode(one.encode(t).ids[:5]) for t in texts]
    assert max(seen) <= max(map(len, texts))


def test_public_prompts_in_one_pass(spark):
    bpe, rng, budget = tokens.bpe(), random.Random(4), 30
    one = tokens._tokenizer(f"{tokens.TOKENIZER_DIR}/{tokens.TOKENIZER_FILE}")
    n = lambda t: len(one.encode(t, add_special_tokens=False).ids)
    bits = [" ", "\n", "\n\n", "\t", "\u00a0", "\x1c", "'s", " 's", "'ll", "a", "12", " word", "\u00e9", " 🙂", "\ufffd", "<|endoftext|>", "-", "(9.9,", " the", " patient"]
    texts = [None, "", "word " * 400, *["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(60)]]
    asked = [(i * 3 + j, i, q, t) for i, t in enumerate(texts) for j, q in enumerate(["Why?", " ", "Which drug was given first, and which one after it?"])]
    rows = retrieve.discharge_only(spark.createDataFrame(asked, "qa_id int, record_id int, question string, discharge_summary string"), budget, bpe)
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {r.qa_id: r for r in rows.collect()}
    for i, _, q, t in asked:
        before, after = "### Patient Context\n\n", "\n\n### Question\n\n" + q
        room, t = max(0, budget - n(before + after)), t or ""
        context = t if n(t) <= room else one.decode(one.encode(t, add_special_tokens=False).ids[:room])
        assert (got[i].user_prompt, got[i].context_tokens, got[i].prompt_tokens) == (before + context + after, n(context), n(before + context + after))


def test_facts_of_missing_columns_and_values(spark):
    labs = spark.createDataFrame([(1, 2, None, "Sodium", 1.5)], "subject_id bigint, hadm_id bigint, charttime string, lab_label string, valuenum double")
    row = facts.lab_events(labs).first()
    assert (row.event_type, row.timestamp, row.label, row.valuenum, row.flag) == ("lab", "None", "Sodium", 1.5, None)
    dx = facts.diagnosis_events(spark.createDataFrame([(1, 2, None, "I10", "t")], "subject_id bigint, hadm_id bigint, seq_num int, icd_code string, diagnosis_title string")).first()
    assert (dx.timestamp, dx.seq_num, dx.title) == ("", 0, "t")
    assert facts.lab_events(labs.limit(0)).count() == 0


RECORD = "record_id bigint, subject_id bigint, hadm_id bigint, demographics struct<gender:string,anchor_age:int>, admission struct<admittime:string>, events array<struct<event_type:string,timestamp:string,end_time:string,label:string,value:string,unit:string,flag:string,drug:string,dose:string,dose_unit:string,route:string,seq_num:int,icd_code:string,title:string>>, discharge_summary string"


def event(**x):
    names = "event_type timestamp end_time label value unit flag drug dose dose_unit route seq_num icd_code title".split()
    return tuple(x.get(n) for n in names)


def generation_rows(spark):
    labs = [event(event_type="lab", timestamp=f"t{i}", label="Na", value=str(i), unit="mmol/L") for i in range(6)]
    return spark.createDataFrame(
        [
            (1, 1, 1, ("F", None), ("2120",), [event(event_type="diagnosis", seq_num=1, icd_code="I10", title="HTN"), None, *labs], "word " * 40),
            (2, 2, 2, None, None, None, None),
            (3, 3, 3, (None, None), None, [event(event_type="odd", timestamp="t")], ""),
        ],
        RECORD,
    )


def test_generation_texts(spark):
    rows = generation_rows(spark)
    got = {r.record_id: r for r in generate.generation_texts(rows).collect()}
    assert got[1].n_kept == 6 and got[1].n_cut == 0 and got[1].text.startswith("## Demographics\n- Gender: F\n- Age at anchor: N/A") and "## Diagnoses\n- [1] I10 — HTN" in got[1].text and "[t0] LAB: Na = 0 mmol/L\n" in got[1].text
    assert got[2].text == "" and got[3].n_kept == 1 and "ODD" in got[3].text
    tight = {r.record_id: r for r in generate.generation_texts(rows, context=80, reserve=10).collect()}
    assert 0 < tight[1].n_kept < 6 and f"... [{tight[1].n_cut} more events truncated] ..." in tight[1].text
    assert generate.generation_texts(rows.limit(0)).count() == 0


def test_pairs_are_made_once_and_errors_kept(spark):
    rows = generation_rows(spark)
    said = {"HTN": '```json\n{"qa_pairs": [{"question": "q", "answer": "a"}]}\n```', "ODD": "not json"}

    def answer(system, user):
        if not user:
            raise ValueError("nothing to ask")
        return {"answer": next(v for k, v in said.items() if k in user), "prompt_tokens": 3, "completion_tokens": 4}

    none = spark.createDataFrame([], "subject_id bigint, hadm_id bigint")
    got = {r.subject_id: r for r in generate.generate_pairs(rows, none, answer, "s", "m").collect()}
    assert [p.question for p in got[1].qa_pairs] == ["q"] and got[1].error is None and got[1].raw is None
    assert got[2].qa_pairs == [] and "nothing to ask" in got[2].error
    assert got[3].qa_pairs == [] and got[3].error == "json_parse_error" and got[3].raw == "not json"
    assert generate.generate_pairs(rows, rows.where("subject_id < 3"), answer, "s", "m").count() == 1


# ---- calls ---------------------------------------------------------------------------------


def test_requests_run_side_by_side_in_order(spark):
    rows = spark.createDataFrame([(i, "s", f"u{i}") for i in range(12)], "i int, system_prompt string, user_prompt string").coalesce(1)

    def fn(system, user):
        import builtins

        gate = builtins.__dict__.setdefault("_gate", threading.Barrier(4))  # opens only if four requests are under way at once
        gate.wait(20)
        return {"answer": user.upper()}

    got = infer.answer_misses(rows, fn, concurrency=4).orderBy("i").collect()
    assert [r.answer for r in got] == [f"U{i}" for i in range(12)] and not any(r.error for r in got)


def test_runners_and_arguments(spark):
    assert infer.request_arguments("o4-mini", 9) == {"model": "o4-mini", "max_completion_tokens": 9}
    assert infer.request_arguments("other", 9, 0.1) == {"model": "other", "max_tokens": 9, "temperature": 0.1}
    remote, local = (lambda **k: ("remote", k["model"])), (lambda m: ("local", m))
    assert infer.make_runner("a/b", remote, local) == ("local", "a/b") and infer.make_runner("o1", remote, local) == ("remote", "o1")
    rows = spark.createDataFrame([(i, "s", f"u{i}") for i in range(7)], "i int, system_prompt string, user_prompt string").coalesce(1)

    def many(asked):
        if ("s", "u4") in asked:
            raise RuntimeError("out of memory")
        return [{"answer": u} for _, u in asked]

    got = {r.i: (r.answer, r.error) for r in infer.batched(many, rows, 2).collect()}
    assert got[0] == ("u0", None) and got[4] == got[5] == ("", "RuntimeError: out of memory") and got[6] == ("u6", None)


def test_dry_run_asks_nothing(spark):
    rows = spark.createDataFrame([("q", "g", "a", None, None)], "question string, gold_answer string, answer string, judge_score int, judge_error string")
    asked = infer.judge_pending(rows, None, "rubric", dry_run=True).collect()
    assert len(asked) == 1 and "Predicted answer: a" in asked[0].user_prompt


# ---- stores --------------------------------------------------------------------------------


def test_settings_files(tmp_path):
    text = "# top\nname: \"a # b\"  # note\nlimits:\n  rows: 5\n  share: 0.5\n  deep:\n    on: true\nlast: null\n"
    (tmp_path / "c.yaml").write_text(text)
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert tables.read_config(str(tmp_path / "c.yaml")) == {"name": "a # b", "limits": {"rows": 5, "share": 0.5, "deep": {"on": True}}, "last": None}
    assert tables.read_config(str(tmp_path / "c.json")) == {"a": 1}


def test_result_files_keep_models_with_any_name(spark, tmp_path):
    row = {"question": "q", "answer": "a", "gold_answer": "g", "token_f1": 0.5}
    for name in ("summary-7b__bm25_k5", "cache-model__rankings"):
        (tmp_path / f"{name}.json").write_text(json.dumps([row]))
    (tmp_path / "summary.json").write_text(json.dumps({"m": {}}))
    got = {(r.model, r.method) for r in tables.read_results(spark, str(tmp_path)).collect()}
    assert got == {("summary-7b", "bm25_k5"), ("cache-model", "rankings")}


def test_merge_keeps_the_last_full_list(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"subject_id": 1, "hadm_id": 2, "discharge_summary": " note \n"}, {"subject_id": 3, "hadm_id": 4, "discharge_summary": " "}]))
    (tmp_path / "q.json").write_text(json.dumps([{"subject_id": 1, "hadm_id": 2, "qa_pairs": [{"question": "old"}]}, {"subject_id": 1, "hadm_id": 2, "qa_pairs": [{"question": "new"}]}, {"subject_id": 1, "hadm_id": 2, "qa_pairs": []}]))
    rows = tables.load_and_merge(spark, str(tmp_path / "t.json"), str(tmp_path / "q.json")).collect()
    assert len(rows) == 1 and rows[0].note_text == "note" and [p.question for p in rows[0].qa_pairs] == ["new"]


def test_cache_survives_runs(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert tables.read_cache(spark, path).count() == 0
    for _ in range(2):
        tables.append_cache(spark.createDataFrame([("k", "a", 1, 2)], "cache_key string, answer string, prompt_tokens int, completion_tokens int"), path)
    assert tables.read_cache(spark, path).count() == 1


def test_methods_beyond_a_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(report, "METHODS", 2)
    rows = spark.createDataFrame([("m", x, 1.0) for x in "abc"], "model string, method string, f double")
    with pytest.raises(ValueError, match="methods"):
        report.model_method_matrix(rows, "f")
    assert report.model_method_matrix(rows.where("method <> 'c'"), "f", ["z"]).columns == ["model", "z", "a", "b"]
