"""Edge cases of the engine's own operators with expectations worked out by hand."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartloom.functions import text as T
from chartloom.operators import chunk, features, infer, label, learn, report, retrieve, score
from chartloom.operators import timeline as tl
from chartloom.sources import tables
from chartloom.streaming.timelines import daily_counts


def one(spark, expr, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("n", "positions"), [(0, []), (200, [0.0]), (201, [0.0, 100.0]), (250, [0.0, 2.0]), (400, [0.0, 0.5, 1.0])])
def test_fixed_windows(spark, n, positions):
    rows = chunk.fixed_chunks(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)), 9)], "record_id int, t string, extra int"), "t").orderBy("chunk_idx").collect()
    assert [r.position for r in rows] == positions and all(r.extra == 9 for r in rows)


def test_sections(spark):
    note = "Intro\nAllergies:\nNone\nBrief Hospital Course:\nLong stay\nLAB\n5"
    rows = chunk.section_chunks(spark.createDataFrame([(1, note), (2, "Allergies:\nx\nMEDICATIONS\ny"), (3, None), (4, "")], "k int, t string"), "k", "t").orderBy("k", "chunk_idx").collect()
    assert [(r.section, r.section_header, r.position) for r in rows if r.k == 1] == [("other", "preamble", 0.0), ("allergies", "Allergies", 0.5), ("hospital_course", "Brief Hospital Course", 1.0)]
    assert [(r.section, r.section_header) for r in rows if r.k == 2] == [("other", "")]
    assert not [r for r in rows if r.k > 2]
    with pytest.raises(ValueError):
        chunk.chunk_notes(spark.createDataFrame([], "k int, t string"), "k", "t", "none")


def test_section_names(spark):
    names = ["Discharge Medications", "CLINICAL LABORATORY VALUES", "Discharge Diagnosis", "Brief Hospital Course", "Xyz"]
    assert [one(spark, T.section_of(F.col("h")), h=n) for n in names] == ["medications", "labs", "diagnosis", "hospital_course", "other"]


def test_token_scores(spark):
    def f1(a, b, empty):
        ta, tb = T.alnum_tokens(F.col("a")), T.alnum_tokens(F.col("b"))
        return [round(one(spark, x, a=a, b=b), 6) for x in T.token_f1(ta, tb, empty)]

    assert f1("", "", 0.0) == [0, 0, 0] and f1("", "", 1.0) == [1, 1, 1] and f1("a", "", 1.0) == [0, 0, 0]
    assert f1("a a b", "a b b", 0.0) == [0.666667] * 3
    q, c = T.alnum_tokens(F.col("q")), T.alnum_tokens(F.col("c"))
    assert one(spark, T.overlap_share(q, c), q="a b", c="b c") == 0.5
    assert one(spark, T.overlap_share(q, c, T.STOPWORDS), q="what is the patient", c="patient") == 0.0
    assert one(spark, T.numeric_density(F.col("t")), t="5 mg $5 x") == 0.25
    assert one(spark, T.question_type(F.col("t")), t="latest scan") == "labs"


@pytest.mark.parametrize(("text", "leave", "want"), [
    ("at 2180-06-26 22:45:00", "2180-06-27T22:45:00", (1 / 30, 1, 1, 0)), ("2180-06-26 22:45", "2180-06-27 22:45:00", (0.5, 0, 0, 1)),
    ("2180-06-28 22:45:00", "2180-06-27 22:45:00", (0, 1, 1, 0)), ("none", "2180-06-27 22:45:00", (0.5, 0, 0, 1)), ("2180-06-26", None, (0.5, 0, 0, 1)), ("2180-06-26", "2180-06-27", (0.5, 0, 0, 1)),
])
def test_temporal_proximity(spark, text, leave, want):
    row = spark.createDataFrame([(text, leave)], "t string, d string").select(*[c.alias(k) for k, c in T.temporal_proximity(F.col("t"), F.col("d")).items()]).first()
    assert tuple(row) == pytest.approx(want)


@pytest.mark.parametrize(("raw", "want"), [("4", 4), ("Score: 4", 4), ("45", None), ("", None), (" 3 ", 3)])
def test_judge_parse(spark, raw, want):
    assert one(spark, T.judge_score(F.col("r")), r=raw) == want


def test_event_text(spark):
    kind = "event_type string, timestamp string, end_time string, label string, value string, valuenum double, unit string, flag string, drug string, dose string, dose_unit string, route string, seq_num int, icd_code string, title string"
    lab = ("lab", "2180", None, "Na", None, 5.0, "mg", "abnormal", *[None] * 7)
    dx = ("diagnosis", "", *[None] * 10, 1, "c", "t")
    click = ("click", None, None, None, "v", *[None] * 10)
    df = spark.createDataFrame([([lab, dx, None, click],), ([],)], f"e array<struct<{kind.replace(' string', ':string').replace(' double', ':double').replace(' int', ':int')}>>")
    docs = [r.x for r in df.select(tl.event_lines(tl.sorted_events(F.col("e"))).alias("l")).select(tl.event_document(F.col("l")).alias("x")).collect()]
    assert docs[0] == "CLINICAL DIAGNOSES:\n  1. t\n\nCLINICAL LABORATORY VALUES:\n  2180  Na: 5.0 mg [abnormal]\n\nCLINICAL CLICK:\n  value=v"
    assert docs[1] == ""


def test_token_budget(spark):
    lines = spark.createDataFrame([(1, 0, 3), (1, 1, 3)], "k int, i int, n int")
    assert [(r.i, r.cut_lines) for r in tl.token_budget(lines, ["k"], ["i"], "n", 10_000, 9_995).collect()] == [(0, 1)]


def test_budget_counts_name_every_key(spark):
    lines = spark.createDataFrame([(1, 0, 3), (1, 1, 3), (2, 0, 9)], "k int, i int, n int")
    assert {tuple(r) for r in tl.budget_counts(lines, ["k"], ["i"], "n", 10_000, 9_995).collect()} == {(1, 1, 1), (2, 0, 1)}


def test_negative_sampling(spark):
    rows = [(q, i, int(i < pos)) for q, pos, neg in ((1, 2, 7), (2, 1, 9), (3, 0, 4)) for i in range(pos + neg)]
    df = spark.createDataFrame(rows, "qa_id int, chunk_idx int, label int")
    kept = {(r.qa_id, r.label): r["count"] for r in label.sample_negatives(df, ["qa_id"], F.concat_ws(":", "qa_id", "chunk_idx")).groupBy("qa_id", "label").count().collect()}
    assert kept == {(1, 1): 2, (1, 0): 7, (2, 1): 1, (2, 0): 5}


def test_features_and_ranker(spark):
    assert len(features.feature_names()) == len(set(features.feature_names())) == 166
    rows = [(i, "what is the sodium level", ("sodium 140 mmol" if i % 2 else "walked the ward"), "labs" if i % 2 else "other", "h", 0.5, i % 2) for i in range(40)]
    pairs = features.pair_features(spark.createDataFrame(rows, "qa_id int, question string, chunk string, section string, section_header string, position double, label int"))
    assert pairs.select(F.size(features.feature_array(pairs)).alias("n")).first().n == 166
    scored = learn.apply_ranker(learn.fit_ranker(pairs, max_iter=20), pairs)
    m = learn.classification_metrics(scored.select("label", "score")).first()
    assert (m.roc_auc, m.average_precision, m.n_pos, m.n_total) == (1.0, 1.0, 20, 40)
    none = learn.classification_metrics(scored.where("label = 1").select("label", "score")).first()
    assert none.roc_auc == none.average_precision == 0.0


def test_recall_counts_or_skips_unanswerable(spark):
    df = spark.createDataFrame([(1, 0, 1, 0.9), (1, 1, 1, 0.1), (2, 0, 0, 0.5)], "qa_id int, chunk_idx int, label int, score double")
    assert {(r.k, r.recall, r.n_questions) for r in learn.recall_at_k(df, ["qa_id"], (1, 3)).collect()} == {(1, 0.5, 1), (3, 1.0, 1)}
    assert {(r.k, r.recall) for r in learn.recall_at_k(df, ["qa_id"], (1,), skip_unanswerable=False).collect()} == {(1, 0.25)}


def test_top_k_ties_and_reading_order(spark):
    df = spark.createDataFrame([(1, i, f"c{i}", s) for i, s in ((2, 1.0), (5, 3.0), (7, 1.0), (8, 0.0))], "qa_id int, chunk_idx int, chunk string, score double")
    picked = retrieve.top_k(df, ["qa_id"], 2)
    assert [r.chunk_idx for r in picked.orderBy("rank").collect()] == [5, 7]
    assert retrieve.reading_order(retrieve.top_k(df, ["qa_id"], 3), ["qa_id"]).first().context == "c2\n\nc5\n\nc7"


def test_fractional_wins(spark):
    df = spark.createDataFrame([("q", "A", 5), ("q", "B", 5), ("q", "C", 3), ("r", "A", 1), ("r", "B", 0)], "question string, strategy string, judge_score int")
    assert [(r.strategy, r.wins, r["rank"]) for r in report.judge_rankings(df).orderBy("rank").collect()] == [("A", 0.5, 1), ("B", 0.5, 2), ("C", 0.0, 3)]


def test_cache_and_errors(spark):
    req = spark.createDataFrame([("k1", "s", "u1"), ("k2", "s", "u2"), ("k3", "s", "bad")], "cache_key string, system_prompt string, user_prompt string")
    cache = spark.createDataFrame([("k1", "old", 1, 1)], "cache_key string, answer string, prompt_tokens int, completion_tokens int")

    def answer(system, user):
        if user == "bad":
            raise ValueError("no")
        return {"answer": user.upper(), "prompt_tokens": 1, "completion_tokens": 1}

    rows, new = infer.run_cached(req, cache, answer)
    assert {(r.cache_key, r.answer, r.cached) for r in rows.collect()} == {("k1", "old", True), ("k2", "U2", False), ("k3", "", False)}
    assert [r.cache_key for r in new.collect()] == ["k2"]


def test_unwrap_json(spark):
    qa = {"question": "q", "answer": "a"}
    texts = [json.dumps([qa]), "```json\n" + json.dumps({"qa_pairs": [qa]}) + "\n```", json.dumps(qa)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(infer.unwrap_json(F.col("t")).alias("x"))
    assert [r.x[0].question for r in df.collect()] == ["q"] * 3


def test_stemmer_and_lcs():
    assert [score.stem(w) for w in ("caresses", "ponies", "relational", "hopping", "adjustment", "happy", "controlling")] == ["caress", "poni", "relat", "hop", "adjust", "happi", "control"]
    assert score.rouge_l("the cat sat", "the cat") == (2 / 3, 1.0, 0.8) and score.rouge_l("", "x") == (0.0, 0.0, 0.0)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_lcs_is_symmetric_and_bounded(a, b):
    assert score.lcs(a, b) == score.lcs(b, a) <= min(len(a), len(b))


def test_sources_round_trip(spark, tmp_path):
    pairs = json.dumps([{"question": "q", "answer": "a", "correct": True}]).replace('"', '""')
    (tmp_path / "qa.csv").write_text(f'subject_id,hadm_id,note_id,qa_pairs\n1,2,n,"{pairs}"\n1,2,n,"{pairs}"\n1,3,n,broken\n')
    rows = tables.read_qa(spark, str(tmp_path / "qa.csv")).collect()
    assert [(r.subject_id, r.hadm_id, len(r.qa_pairs)) for r in rows] == [(1, 2, 2)]
    (tmp_path / "org--m__bm25_k5.json").write_text(json.dumps([{"question": "q", "token_f1": 0.5}]))
    (tmp_path / "legacy.json").write_text(json.dumps([{"question": "q"}]))
    (tmp_path / "summary.json").write_text(json.dumps([{"question": "no"}]))
    assert {(r.model, r.method) for r in tables.read_results(spark, str(tmp_path)).collect()} == {("org--m", "bm25_k5"), ("unknown", "legacy")}
    with pytest.raises(ValueError):
        tables.read_qa(spark, "x.xml")


def test_stream_of_events(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = daily_counts(stream, "ts", ["event_type"]).writeStream.format("memory").queryName("daily").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("daily").agg(F.sum("n_events")).first()[0] == events.count()


def test_catalogue_runs_on_one_and_many_partitions(spark, data):
    from chartloom.plans.catalogue import QUERIES

    for name in ("judge_rankings", "model_method_matrix"):
        results = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(map(str, QUERIES[name](spark, data).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert results[0] == results[1]


def test_pair_tfidf_by_hand(spark):
    texts = spark.createDataFrame([("aa bb", 1), ("aa cc", 2)], "text string, times int")
    vocabulary = {r.term: (r.df, r.total) for r in retrieve.tfidf_vocabulary(texts, "text", times="times").collect()}
    assert vocabulary == {"aa": (3, 3), "cc": (2, 2), "aa cc": (2, 2)}
    terms = spark.createDataFrame([("aa", 1.0), ("cc", 2.0)], "term string, idf double")
    q = spark.createDataFrame([(1, 7, "aa aa"), (2, 8, "aa"), (3, 7, "zz")], "qa_id int, record_id int, question string")
    c = spark.createDataFrame([(7, 0, "aa cc"), (7, 1, "cc"), (8, 0, "aa")], "record_id int, chunk_idx int, chunk string")
    got = {(r.qa_id, r.chunk_idx): r.tfidf_sim for r in retrieve.pair_tfidf(q, c, terms).collect()}
    assert got == pytest.approx({(1, 0): 1 / 5**0.5, (2, 0): 1.0})


def test_feature_rows_have_both_similarities(spark, data):
    from chartloom.plans import catalogue

    rows = catalogue.feature_rows(spark, data).select("qa_id", "chunk_idx", "question", "chunk", "tfidf_sim", "embed_sim").collect()
    pairs = {(r.qa_id, r.chunk_idx) for r in catalogue.labelled_pairs(spark, data).select("qa_id", "chunk_idx").collect()}
    assert len(rows) == len(pairs) and {(r.qa_id, r.chunk_idx) for r in rows} == pairs
    assert any(r.tfidf_sim > 0 for r in rows) and all(0 <= r.tfidf_sim < 1 + 1e-9 for r in rows)
    words = lambda t: set(re.findall("[a-z0-9]+", t.lower()))
    shared = [r for r in rows if words(r.question) & words(r.chunk)]
    assert shared and all(r.embed_sim > 0 for r in shared)
    active = {r.feature for r in catalogue.feature_matrix_sums(spark, data).collect()}
    assert {"tfidf_sim", "embed_sim"} <= active


def test_tfidf_cosine_has_every_pair(spark, data):
    from chartloom.plans.catalogue import QUERIES

    qa = spark.read.parquet(f"{data}/qa_pairs.parquet").where("question IS NOT NULL AND answer IS NOT NULL")
    got = {r.qa_id: r.similarity for r in QUERIES["tfidf_cosine"](spark, data).collect()}
    assert set(got) == {r.qa_id for r in qa.select("qa_id").collect()}
    words = lambda t: set(re.findall("[a-z0-9_]{2,}", t.lower()))
    apart = [r.qa_id for r in qa.collect() if not words(r.question) & words(r.answer)]
    assert apart and all(got[i] == 0.0 for i in apart)
