"""Operators for training data against brute force, round trips and worked cases."""

import random

import pytest

from chartloom.llm import bpe, mixing, overlaps, pieces, qa_defects, questions, splits, toxicity

QA = "qa_id bigint, subject_id bigint, hadm_id bigint, question string, answer string, difficulty string, source string, split string, defects_extra string"


def qa_rows(spark, rows):
    names = [c.split()[0] for c in QA.split(", ")]
    return spark.createDataFrame([tuple(({"qa_id": i} | r).get(n) for n in names) for i, r in enumerate(rows)], QA)


# ---- answers -------------------------------------------------------------------------------

ASK = "What was the lowest heart rate recorded on 2120-03-05?"
ANSWERS = [
    ("100 bpm", None), (None, "empty"), ("", "empty"), ("  \u200b ", "empty"), ("N/A", "empty"), ("[ ]", "empty"), ("...", "empty"), ("<answer>", "empty"),
    (ASK, "copied_question"), ("Question: " + ASK, "copied_question"), ("On 2120-03-05, what was the lowest heart rate recorded?", "copied_question"), ("What was the lowest heart rate recorded on 2120-03-05.", "copied_question"),
    ("I'm sorry, but I can't help with questions about individual patients.", "refusal"), ("As an AI language model, I am not able to interpret medical records.", "refusal"), ("Nothing; the note is silent on it.", None),
    ("It was 100 bpm because the", "truncated"), ("The lowest heart rate was (see the", "truncated"), ("It was marked at first, then", "truncated"), ("A low-salt diet", None), ("From 9.1 to 9.4 mg/dL", None), ("On review, it increased from 9.", "truncated"),
    ("Der Wert lag bei 100 und wurde am nächsten Morgen kontrolliert.", "other_language"), ("Según el registro era de 100 y después subió lentamente.", "other_language"), ("Значение было сто ударов.", "other_language"), ("No.", None),
    ("The lowest heart rate on 2120-03-05 was 90 bpm, recorded shortly after midnight.", None),
]


def test_answer_defects(spark):
    rows = qa_rows(spark, [{"question": ASK, "answer": a} for a, _ in ANSWERS] + [{"question": "Which diet was it and a full panel?", "answer": "diet and low-salt diet."}, {"question": None, "answer": "x y."}])
    got = {r.qa_id: r.defect for r in qa_defects.unusable_answers(rows).collect()}
    assert got == {i: d for i, (_, d) in enumerate(ANSWERS) if d}
    assert qa_defects.unusable_answers(rows.limit(0)).count() == 0
    long = qa_rows(spark, [{"question": ASK, "answer": "Good words. " * 20_000}, {"question": ASK, "answer": "It was the " * 20_000}])
    assert [r.defect for r in qa_defects.unusable_answers(long).collect()] == ["truncated"]


def test_long_placeholders_are_empty(spark):
    texts = ["Lorem ipsum dolor sit amet. " * 20, "*Insert answer " + "here, please " * 30, "[" + "answer to be written " * 20 + "]", "(<" + "x " * 200 + ">)."]
    whole = ["The note says lorem ipsum " + "and more of it " * 30 + ".", "[1] The rate was 90 bpm " + "at noon " * 40 + "."]
    rows = qa_rows(spark, [{"question": ASK, "answer": t} for t in [*texts, *whole]])
    assert [r.defect for r in qa_defects.unusable_answers(rows.where("qa_id < 4")).collect()] == ["empty"] * 4
    assert not [r for r in qa_defects.unusable_answers(rows).collect() if r.qa_id >= 4 and r.defect == "empty"]


WELL_FORMED = """Why was anticoagulation started?|Warfarin because of atrial fibrillation
Which drug was stopped?|Metformin, which had raised lactate
Which antibiotic was given?|Ceftriaxone
What caused the fever?|Community acquired pneumonia
What should the patient do?|Ask your doctor before stopping aspirin.
Which form was signed?|The Datenschutz form was signed on admission.
Where did she go?|To the rehabilitation unit
What was found?|A small pleural effusion on the left
Who was called?|The on-call surgeon
What did the scan show?|No acute intracranial haemorrhage
What were the allergies?|Penicillin and sulfa drugs
When was it removed?|On the third day after surgery
Why was he transferred?|Worsening respiratory failure despite high-flow oxygen
What was the outcome?|She improved and was discharged home on oral antibiotics
What was the trend?|It rose steadily after the transfusion
What was seen on the echo?|Moderately reduced ejection fraction
Was the culture positive?|Yes, for Klebsiella
Which drug?|Levothyroxine 25 mcg p.o. daily
What was the reason?|Dehydration due to vomiting
Wie hoch war der Wert?|Der Wert lag bei 5.1 mmol/L
Which vitamin was started?|Cholecalciferol 400 UNIT once daily""".splitlines()


def test_well_formed_answers_are_no_cases(spark):
    rows = qa_rows(spark, [dict(zip(("question", "answer"), x.split("|"))) for x in WELL_FORMED])
    assert qa_defects.unusable_answers(rows).collect() == []


def test_clashing_columns_of_pairs(spark):
    rows = spark.createDataFrame([(1, ASK, "N/A", "x", "y", "z")], "qa_id bigint, question string, answer string, _a string, _open string, Defects string")
    got = qa_defects.defect_rules(rows).first()
    assert (got["_a"], got["_open"], got["defects"]) == ("x", "y", ["empty"])


def test_verdicts_come_from_the_row_alone(spark):
    cut = ["It was 90 bpm, because the electronic prescription remained unv", "Seen by the anaesthetic consu", "9.1 mg/dL, which prompted a multidisciplinary disc", "90 bpm, drawn along a full panel", "Given by the pharmacist"]
    rows = qa_rows(spark, [{"question": ASK, "answer": a} for a in cut])
    alone = {i: [r.defect for r in qa_defects.unusable_answers(rows.where(f"qa_id = {i}")).collect()] for i in range(len(cut))}
    together = {r.qa_id: r.defect for r in qa_defects.unusable_answers(rows.unionByName(qa_rows(spark, [{"qa_id": 100 + i, "question": ASK, "answer": "The consu and the unv disc panel came."} for i in range(50)]))).collect() if r.qa_id < 100}
    assert alone == {0: ["truncated"], 1: ["truncated"], 2: ["truncated"], 3: [], 4: []} and together == {0: "truncated", 1: "truncated", 2: "truncated"}


# ---- splits --------------------------------------------------------------------------------


def test_components_against_union_find(spark):
    rng = random.Random(5)
    rows = [{"subject_id": rng.choice([None, *range(60)]), "hadm_id": rng.choice([None, *range(45)])} for _ in range(90)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in rows:
        if r["subject_id"] is not None and r["hadm_id"] is not None:
            parent[find(("s", r["subject_id"]))] = find(("h", r["hadm_id"]))
    people = sorted({r["subject_id"] for r in rows if r["subject_id"] is not None})
    want = {(a, b) for a in people for b in people if a < b and find(("s", a)) == find(("s", b))}
    got = [(r.subject_a, r.subject_b) for r in splits.linked_pairs(qa_rows(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_split_keeps_links_and_shares(spark):
    rng = random.Random(1)
    rows = [{"subject_id": None if i % 50 == 0 else (7 if i % 3 == 0 else i // 4), "hadm_id": None if i % 41 == 0 else 9000 + i if i % 3 == 0 else 5000 + i // 4, "difficulty": rng.choice(["easy", "hard", "", None])} for i in range(1200)]
    targets = spark.createDataFrame([("train", 0.6), ("validation", 0.2), ("test", 0.2)], "split string, target_share double")
    placed = {r.qa_id: r.split for r in splits.assign_splits(qa_rows(spark, rows), targets).collect()}
    assert len(placed) == 1200
    for key in ("subject_id", "hadm_id"):
        seen = {}
        for i, r in enumerate(rows):
            if r[key] is not None:
                assert seen.setdefault(r[key], placed[i]) == placed[i]
    shares = {r.split: r.share for r in splits.split_report(qa_rows(spark, rows), targets).collect()}
    assert abs(shares["train"] - 0.6) < 0.02 and abs(shares["test"] - 0.2) < 0.02
    assert splits.assign_splits(qa_rows(spark, rows[:0] or [{}]).limit(0), targets).count() == 0


def test_anneal_beats_its_start():
    keys = [str(i) for i in range(50)]
    counts = [[1 + i % 7, 1 + i % 7] for i in range(50)]
    total = sum(c[0] for c in counts)
    targets = [[0.5 * total] * 2, [0.5 * total] * 2]
    start, _ = splits.anneal(keys, counts, targets, 3, 0)
    best, place = splits.anneal(keys, counts, targets, 3)
    assert best <= start and best < 0.02 and set(place) == {0, 1}


def test_too_many_targets_are_refused(spark):
    targets = spark.range(splits.TARGETS + 1).selectExpr("CAST(id AS string) AS split", "0.1D AS target_share")
    with pytest.raises(ValueError, match="split targets"):
        splits.assign_splits(qa_rows(spark, [{}]), targets)


def test_component_links_name_every_member_once(spark):
    rows = [{"subject_id": s, "hadm_id": h} for s, h in [(1, 10), (2, 10), (2, 11), (3, 11), (8, 12), (9, 12), (5, 13)]]
    assert sorted(tuple(r) for r in splits.component_links(qa_rows(spark, rows)).collect()) == [(2, 1), (3, 1), (9, 8)]


# ---- overlaps ------------------------------------------------------------------------------


def test_overlaps(spark):
    base = "What was the lowest heart rate recorded on 2120-03-05?"
    held = [
        base.upper(), "According to the chart: what was the lowest HR recorded on 2120-03-05", "On 2120-03-05, what was the lowest heart rate recorded?", "What was the lwest heart rate recorded on 2120-03-05?",
        "What was the highest heart rate recorded on 2120-03-05?", "What was the lowest heart rate recorded on 2120-03-06?", "What was the lowest temperature recorded on 2120-03-05?", None, "",
    ]
    rows = [{"subject_id": 1, "question": base, "split": "train"}, *[{"subject_id": 1, "question": q, "split": "test"} for q in held], {"subject_id": 2, "question": base, "split": "test"}, {"subject_id": None, "question": base, "split": "test"}, {"subject_id": 1, "question": base, "split": "train"}]
    got = {(r.qa_a, r.qa_b) for r in overlaps.overlapping_pairs(qa_rows(spark, rows)).collect()}
    assert got == {(a, b) for b in (1, 2, 3, 4) for a in [0]} | {(b, 12) for b in (1, 2, 3, 4)}
    assert overlaps.overlapping_pairs(qa_rows(spark, rows).limit(0)).count() == 0
    report = {r.split: (r.n_rows, r.n_overlapping, r.n_pairs) for r in overlaps.overlap_report(qa_rows(spark, rows)).collect()}
    assert report == {"test": (11, 4, 8)}


def test_coverage_rejects_nothing_the_comparison_accepts(spark):
    assert overlaps.same_question(["glucose", "valu"], ["glucse"])
    for one, other in (("train", "test"), ("test", "train")):
        rows = [{"subject_id": 1, "question": "glucse", "split": one}, {"subject_id": 1, "question": "glucose valu", "split": other}]
        assert [(r.qa_a, r.qa_b) for r in overlaps.overlapping_pairs(qa_rows(spark, rows)).collect()] == [(0, 1)]


def test_overlap_shards_lose_nothing(spark, monkeypatch):
    rows = [{"subject_id": 1, "question": f"What caused the {w} drop?", "split": s} for w in ("alpha", "bravo", "charlie", "delta", "echoes") for s in ("train", "test")]
    whole = overlaps.overlapping_pairs(qa_rows(spark, rows)).count()
    monkeypatch.setattr(overlaps, "EVAL_SHARD", 2)
    monkeypatch.setattr(overlaps, "TRAIN_SHARD", 2)
    assert overlaps.overlapping_pairs(qa_rows(spark, rows)).count() == whole == 5


def test_forms_that_ask_the_same_share_a_passage():
    rng = random.Random(8)
    words = "glucose highest lowest anticoagulation held procedure ward dose heparin walk discharge allergy reason valu whch fever ct".split()

    def slip(w):
        i, kind = rng.randrange(len(w)), rng.randrange(4)
        return [w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "x" + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]][kind]

    same = 0
    for _ in range(6000):
        a = rng.sample(words, rng.randint(1, 16))
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            side = rng.choice([a, b])
            i = rng.randrange(len(side))
            side[i] = slip(side[i])
            if rng.random() < 0.2:
                side.append(slip(rng.choice(["value", "when", "what"])))
        a, b = (sorted({w for w in x if w}) for x in (a, b))
        if overlaps.same_question(a, b):
            same += 1
            assert set(overlaps.passages(a)) & set(overlaps.passages(b))
    assert same > 3000 and len(overlaps.passages([f"w{i}" for i in range(2000)])) == 5


def test_no_visit_without_a_matched_passage(monkeypatch):
    """10,000 forms of each split under one key: only those that share a passage are compared."""
    import pyarrow as pa

    visits = []
    exact = overlaps.same_question
    monkeypatch.setattr(overlaps, "same_question", lambda a, b: visits.append((a, b)) or exact(a, b))
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(4))
    held, train = [f"{word()} {word()} {word()}" for _ in range(10_000)], [f"{word()} {word()} {word()}" for _ in range(10_000)]
    train[5] = " ".join(sorted(["x" + held[7].split()[0][1:], *held[7].split()[1:]]))
    rows = [(1, "", 0, 0, f, 0) for f in held] + [(1, "", 0, 0, f, 1) for f in train]
    batch = pa.RecordBatch.from_pylist([dict(zip(("subject_id", "numbers", "part", "stream", "form", "role"), r)) for r in rows])
    found = [r for out in overlaps._scan(iter([batch])) for r in out.to_pylist()]
    assert (held[7], train[5]) in {(r["eval_form"], r["train_form"]) for r in found} and len(visits) < 10_000


@pytest.mark.parametrize(("a", "b", "same"), [("heart", "haert", True), ("heart", "hert", True), ("heart", "heaart", True), ("heart", "heert", True), ("heart", "hurt", False), ("highest", "lowest", False)])
def test_one_slip(a, b, same):
    assert overlaps.one_slip(a, b) is same and overlaps.one_slip(b, a) is same


def test_turns_hold_no_deciding_word():
    assert not {"before", "after", "highest", "lowest", "first", "last", "change", "dose"} & set(questions.TURNS)


# ---- pieces --------------------------------------------------------------------------------


@pytest.mark.parametrize(("limit", "overlap", "n"), [(100, 20, 350), (200, 20, 399), (100, 99, 350), (50, 25, 300), (10, 3, 100), (2, 1, 9)])
def test_every_limit_is_kept(limit, overlap, n):
    rng = random.Random(n)
    for text in ("x" * n, ("word and more. " * n)[:n], "".join(rng.choice("ab c.\n") for _ in range(n))):
        cut = pieces.cut_text(text, limit, overlap)
        assert cut[0][1] == 0 and cut[-1][2] == n and all(0 < stop - start <= limit for _, start, stop, _ in cut)
        assert all(a[2] - b[1] == overlap for a, b in zip(cut, cut[1:]))


@pytest.mark.parametrize("overlap", [0, 10, 15, 19])
def test_every_event_limit_is_kept(overlap):
    cut = pieces.cut_days([str(i // 7) for i in range(40)], 20, overlap)
    assert cut[-1][2] == 40 and all(b - a <= 20 for _, a, b, _ in cut)


def test_overlap_has_to_fit():
    with pytest.raises(ValueError, match="overlap"):
        pieces.cut_text("x" * 30, 10, 10)


@pytest.mark.parametrize("text", ["x" * 20_001, "Word and word. " * 900, "A:\n" + "line of text\n" * 1200 + "Plan:\n" + "more\n\n" * 900, " " * 7000, "é🙂 " * 4000])
def test_text_pieces_cover_within_limit(text):
    cut = pieces.cut_text(text)
    assert cut[0][1] == 0 and cut[-1][2] == len(text)
    assert all(0 < stop - start <= 6000 for _, start, stop, _ in cut)
    assert all(a[2] - b[1] == 300 for a, b in zip(cut, cut[1:]))


def test_cuts_match_exhaustive_search():
    rng = random.Random(2)
    import numpy as np

    for _ in range(20):
        n = rng.randint(30, 60)
        at = np.array(sorted(rng.sample(range(1, n), 14)))
        cost = np.array([rng.choice([0.0, 0.3, 1.0]) for _ in at])
        limit, overlap = 25, 3
        even = n / max(2, -(-(n - overlap) // (limit - overlap)))
        best = [float("inf")]

        def walk(last, total):
            for e, c in [*zip(at.tolist(), cost.tolist()), (n, 0.0)]:
                start = 0 if last == 0 else last - overlap
                if e > last + (overlap if last else 0) and e - start <= limit and (last == 0 or last > overlap):
                    t = total + c + pieces.EVENNESS * ((e - last - even) / even) ** 2
                    if e == n:
                        best[0] = min(best[0], t)
                    elif t < best[0]:
                        walk(e, t)

        walk(0, 0.0)
        chain = pieces.best_cuts(n, at, cost, limit, overlap)
        if best[0] == float("inf"):
            continue
        total, last = 0.0, 0
        for e, c in chain:
            total, last = total + c + pieces.EVENNESS * ((e - last - even) / even) ** 2, e
        assert abs(total - best[0]) < 1e-9


def test_oversized_records(spark):
    kind = "record_id bigint, discharge_summary string, events array<struct<timestamp:string,x:int>>, text string"
    ev = lambda n: [(f"2120-01-{1 + i // 40:02d} 00:00:00", i) for i in range(n)]
    df = spark.createDataFrame([(1, "a. " * 2001, None, "t"), (2, "a" * 6000, [*ev(150), None, None], "t"), (3, None, ev(151), "t"), (3, "🙂" * 6001, [], "t"), (4, None, None, None)], kind)
    assert {tuple(r) for r in pieces.oversized_records(df).collect()} == {(1, "discharge_summary"), (3, "events"), (3, "discharge_summary")}
    got = pieces.oversized_pieces(df).where("record_id = 3").collect()
    assert all(len(r.text) == r.stop - r.start for r in got if r.oversized_field == "discharge_summary")
    assert {r.boundary for r in got if r.oversized_field == "events"} == {"day", "end"}
    assert pieces.oversized_pieces(df.limit(0)).count() == 0


# ---- tokens --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/{bpe.TOKENIZER_FILE}")
    t.encode_special_tokens = True
    return t


def test_encoding_equals_merging(tokenizer):
    own, split, rng = bpe.automaton(bpe._definition(bpe.TOKENIZER_DIR, bpe.TOKENIZER_FILE)), bpe.splitter(), random.Random(3)
    letters = "abcdefghij zTHE  \n\t0123456789,.!?éß漢字🙂\u200b-'\u00a0"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 120))) for _ in range(800)] + ["a" * n for n in range(40)] + ["the" * n for n in range(30)] + [" " * n for n in range(30)] + ["<|endoftext|>", "x" * 30_000]
    for t in texts:
        ids = own.encode(t, split)
        assert ids == tokenizer.encode(t, add_special_tokens=False).ids and own.decode(ids) == t


def test_encoding_of_rows(spark, tokenizer):
    rows = [(1, "Heart rate 90."), (2, None), (3, ""), (4, " "), (1, "Heart rate 90.")]
    got = [tuple(r) for r in bpe.encode_texts(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS ids")).collect()]
    assert sorted(got) == sorted((i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in rows)


# ---- mixing --------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 400])
def test_flight_keeps_count_and_tokens(n):
    rng = random.Random(n)
    size = [float(rng.choice([5, 5, 7, 90, 2000])) for _ in range(n)]
    p = [rng.random() for _ in range(n)]
    end = mixing.flight(p, size, rng)
    assert sum(0 < x < 1 for x in end) <= 2
    assert abs(sum(end) - sum(p)) < 1e-6 and abs(sum(a * s for a, s in zip(end, size)) - sum(a * s for a, s in zip(p, size))) < 1e-3


def test_mixture_reaches_shares(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "word " * rng.randint(5, 60), s) for i, s in enumerate(["big"] * 600 + ["small"] * 40 + ["other"] * 30)] + [(9000, None, "big"), (9001, "", "small"), (9002, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("gone", 0.1, 4)], "source string, target_share double, max_repeat int")
    for block in (5000, 60):
        monkeypatch.setattr(mixing, "BLOCK", block)
        r = {x.source: x for x in mixing.mixture_report(docs, targets).collect()}
        assert abs(r["big"].share - 2 / 3) < 0.01 and abs(r["small"].share - 1 / 3) < 0.01 and r["gone"].share == 0
        assert all(x.most_uses <= x.max_repeat for x in r.values())
    assert mixing.mixture(docs.limit(0), targets)[0].count() == 0


# ---- toxic passages ------------------------------------------------------------------------


def brute_segments(items):
    """Maximal segments by their definition: best segment first, then both sides of it."""
    if not items:
        return []
    best = max(((sum(s for s, _, _ in items[i:j]), -(j - i), -i) for i in range(len(items)) for j in range(i + 1, len(items) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    i, j = -best[2], -best[2] - best[1]
    return [*brute_segments(items[:i]), (best[0], items[i][1], items[j - 1][2]), *brute_segments(items[j:])]


def test_maximal_segments_against_definition():
    rng = random.Random(6)
    for _ in range(200):
        items = [(rng.uniform(-3, 3), i, i + 1) for i in range(rng.randint(0, 12))]
        got, want = sorted(toxicity.maximal_segments(items), key=lambda x: x[1]), brute_segments(items)
        assert [x[1:] for x in got] == [x[1:] for x in want] and all(abs(a[0] - b[0]) < 1e-9 for a, b in zip(got, want))


def test_disguises():
    words = lambda t: [w.rstrip("~") for w in toxicity.tokens_of(t)]
    assert words("b@$t@rd") == ["bastard"] and words("1d10t") == ["idiot"] and words("m o r o n") == ["moron"] and words("p.i.g") == ["pig"] and words("f**k you 12.5 mg") == ["f**k", "you", "#", ".", "#", "mg"]


def test_letters_kept_apart_are_joined_with_their_neighbours():
    scorer = toxicity.Scorer({"fucking_idiot": (3.0, -1.2, -1.2), "drop_dead": (3.0, -1.2, -1.2), "scumbag": (3.0, -1.2, -1.2)})
    plain = lambda t: scorer.plain(toxicity.tokens_of(t))
    assert plain("f u c king idiot") == ["fucking", "idiot"] and plain("d r o p d e a d now")[:2] == ["drop", "dead"] and plain("scum b a g") == ["scumbag"] and plain("sc*m**g") == ["scumbag"]
    assert plain("a b c de") == ["abc", "de"]


def test_a_passage_may_have_two_categories():
    strong = toxicity.Scorer({"vermin": (90.0, 80.0, -5.0)})
    assert {x[0] for x in strong.segments(["vermin"])} == {0, 1}


def test_rate_solves_its_equation():
    import math
    from collections import Counter

    mass = Counter({-1.2: 9000, 0.7: 300, 3.0: 20, 6.0: 1})
    rate = toxicity.solved_rate(mass)
    assert abs(sum(n * math.exp(rate * s) for s, n in mass.items()) / sum(mass.values()) - 1) < 1e-6
    assert toxicity.solved_rate(Counter({-1.0: 1, 2.0: 5})) < 1e-3


def toxic_tables(spark, n=3000):
    """Calm notes with a few objectionable sentences, a third of them labelled, some of these wrongly."""
    rng = random.Random(12)
    calm = ["The patient walked {} metres today.", "No fever overnight.", "Genital exam deferred; breast exam without masses.", "Was rude this morning but apologised.", "She worries that immigrants like herself wait longer.", "Slept {} hours and ate half of each meal.", "The wound is dry and clean."]
    worst = {
        "abusive": ["You stupid {} go to hell.", "What kind of useless {} runs this place?", "Shut up you {} and get out."], "hateful": ["People like that are {} and parasites.", "Send those {} people back where they came from."],
        "sexual": ["I want you naked in my {} tonight.", "Show me your {} and I will pay."],
    }
    fill = {"abusive": ["asshole", "m o r o n", "b1tch", "moron", "bitch"], "hateful": ["vermin", "f1lthy", "filthy", "rats"], "sexual": ["bed", "t1ts", "tits"]}
    rows, labels, truth = [], [], set()
    for i in range(n):
        text = [rng.choice(calm).format(rng.randint(1, 30)) for _ in range(rng.randint(2, 6))]
        kind = None
        if i % 15 == 0:
            kind = list(worst)[i // 15 % 3]
            text.insert(rng.randrange(len(text)), rng.choice(worst[kind]).format(rng.choice(fill[kind])))
            truth.add((i, kind))
        rows.append((i, " ".join(text), "portal" if kind else "ward", "x"))
        if i % (3 if kind is None else 2) == 0:
            labels.append((i, "r", kind or "clean") if rng.random() > 0.02 else (i, "r", "clean"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, abusive string")
    return docs, spark.createDataFrame([*labels, (None, "r", None), (5, "r", "odd")], "doc_id bigint, reviewer string, label string"), truth


def test_toxic_documents_are_learned_from_labels(spark):
    docs, labels, truth = toxic_tables(spark)
    more = spark.createDataFrame([(90_000, None, "w", "x"), (90_001, "", None, "x"), (90_002, "The patient walked today. " * 20_000 + "You stupid asshole go to hell.", "w", "x")], docs.schema)
    got = {tuple(r) for r in toxicity.flagged_documents(docs.unionByName(more), labels).collect()}
    assert (90_002, "abusive") in got
    got = {x for x in got if x[0] < 90_000}
    assert len(got & truth) >= 0.85 * len(truth) and len(got & truth) >= 0.95 * len(got)
    rates = {r.source: r for r in toxicity.source_rates(docs, labels).collect()}
    assert rates["portal"].abusive_rate > 0.3 and rates["ward"].sexual_rate < 0.01


def test_toxic_documents_of_odd_tables(spark):
    docs, labels, _ = toxic_tables(spark, 300)
    assert toxicity.flagged_documents(docs, labels.limit(0)).count() == 0
    assert toxicity.flagged_documents(docs.limit(0), labels).count() == 0
    assert toxicity.score_documents(docs.limit(0), labels.limit(0)).count() == 0


def test_sentence_tables_may_start_again(spark, monkeypatch):
    docs, labels, _ = toxic_tables(spark, 900)
    whole = {tuple(r) for r in toxicity.label_counts(docs, toxicity.labelled(labels)).collect()}
    monkeypatch.setattr(toxicity, "SENTENCES", 5)
    assert {tuple(r) for r in toxicity.label_counts(docs, toxicity.labelled(labels)).collect()} == whole


# ---- queries -------------------------------------------------------------------------------


def test_found_queries_have_stated_columns(spark, data):
    from chartloom.llm.queries import QUERIES

    want = {
        "p3_found": [("qa_id", "bigint"), ("defect", "string")], "p5_found": [("subject_a", "bigint"), ("subject_b", "bigint")], "p6_found": [("qa_a", "bigint"), ("qa_b", "bigint")],
        "p7_found": [("record_id", "bigint"), ("oversized_field", "string")], "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p10_found": [("doc_id", "bigint"), ("category", "string")],
    }
    for name, columns in want.items():
        assert QUERIES[name](spark, data).dtypes == columns
