"""Small tests of the operators for training data: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import os
import random
import sys
import unicodedata

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
from conftest import rows  # noqa: E402

from meetspark.llm import crosssplit, defects, encoding, leak, lookalike, looks, nearest, splitting, turns  # noqa: E402

LIMITS = [("product", 100, 20), ("default", 60, 10), ("tight", 5, 4)]


@pytest.fixture(scope="module")
def limits(spark):
    return spark.createDataFrame(LIMITS, "domain string, max_chars int, overlap_chars int")


# 1 --------------------------------------------------------------------------
MEETINGS = "record_id long, meeting_id string, split string, domain string, transcript string, source string, max_chars int, boundary string"


def meeting(i, text, split="train", domain="product", meeting_id="m"):
    return (i, meeting_id, split, domain, text, "s", 1, "x")


def test_p1_levels(spark, limits):
    texts = {
        1: ("\n".join(["a" * 90] * 3), "product", "line"),
        2: (" ".join(["Word word word."] * 20), "product", "sentence"),
        3: ("word " * 60, "product", "word"),
        4: ("x" * 500, "product", "char"),
        5: ("a" * 61, None, "char"),
        6: ("a b " * 20, "no such domain", "word"),
        7: ("short", "product", None),
        8: ("", "product", None),
        9: (None, "product", None),
        10: ("é😀" * 51, "product", "char"),
        11: ("\n" * 101, "product", "line"),
        12: ("abc defg hij", "tight", "word"),
    }
    given = spark.createDataFrame([meeting(i, t, domain=d) for i, (t, d, _) in texts.items()], MEETINGS)
    assert dict(rows(splitting.p1_found(given, limits))) == {i: w for i, (_, _, w) in texts.items() if w}
    sizes = {d: m for d, m, _ in LIMITS}
    pieces = splitting.p1_pieces(given, limits).orderBy("record_id", "piece_no").collect()
    for i, (text, domain, want) in texts.items():
        own = [p for p in pieces if p.record_id == i]
        if not want:
            assert not own
            continue
        limit = sizes.get(domain, 60)
        assert [p.piece_no for p in own] == list(range(1, len(own) + 1))
        assert "".join(p.text[p.overlap_chars :] for p in own) == text  # nothing lost, nothing twice
        assert all(len(p.text) <= limit for p in own)
        assert all(p.text == text[p.start_char : p.end_char] for p in own)
    assert splitting.p1_found(given.limit(0), limits).count() == 0


def test_p1_found_cuts(spark):
    """p1_found bisects the texts as p1_pieces does, also where no overlap fits."""
    given = spark.createDataFrame([(1, "product", "ab cd. ef gh\nij kl\n" * 3)], "record_id long, domain string, transcript string")
    for overlap in (2, 8, 20):
        found = splitting.p1_found(given, spark.createDataFrame([("default", 8, overlap)], "domain string, max_chars int, overlap_chars int"))
        assert "_split(transcript" in found._jdf.queryExecution().executedPlan().toString()
        assert rows(found) == [(1, "sentence")]


def test_p1_random_texts():
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["word", " ", ". ", "\n", "longer", "?", "̈", "x" * 40]) for _ in range(rng.randrange(1, 200)))
        limit = rng.randrange(3, 120)
        overlap = rng.randrange(0, limit)
        level, pieces = splitting.bisect_text(text, limit, overlap)
        assert pieces[0][1] == 0 and pieces[-1][2] == len(text)
        assert all(a[2] == b[1] for a, b in zip(pieces, pieces[1:]))
        assert all(0 < e - s <= limit and c - s <= overlap for s, c, e, _ in pieces)
        units = [x for x in text.split("\n")]
        if max(map(len, units)) <= limit:
            assert level == "line"


def test_p1_overlaps_and_marks():
    text = "".join(chr(97 + i % 26) for i in range(100))
    for overlap in (0, 5, 6, 9):  # up to one below the limit
        _, pieces = splitting.bisect_text(text, 10, overlap)
        assert all(e - s <= 10 for s, _, e, _ in pieces) and all(b[1] - b[0] == min(overlap, b[1] - a[1]) for a, b in zip(pieces, pieces[1:]))
    with pytest.raises(ValueError):
        splitting.bisect_text(text, 10, 10)
    marked = "a" + "\u0301" * 40 + "b" + "\u0301" * 40  # a character and forty marks
    _, pieces = splitting.bisect_text(marked, 60, 0)
    assert [p[1] for p in pieces] == [0, 41]


def test_p1_very_long_text():
    level, pieces = splitting.bisect_text("Some words here. " * 60_000, 5000, 200)
    assert level == "sentence" and all(e - s <= 5000 for s, _, e, _ in pieces)
    assert all(x[3] in ("", "sentence") for x in pieces)


# 3 --------------------------------------------------------------------------
def _talk(rng, n):
    return [" ".join(rng.choice(["Zorvak", "Plimdor", "Quessar", "Trellin", "Maskobar", "we", "the", "plan", "agreed", *[f"Nem{rng.randrange(900)}" for _ in range(4)]]) for _ in range(9)) for _ in range(n)]


TALKERS = [(f"SPEAKER_0{i}", "ABC"[i], f, r) for i, (f, r) in enumerate([("Momb Samand", "Project Manager"), ("Karl Kalelt", "Designer"), ("Nest Lelasan", "Marketing Expert")])]


def talkers(spark, meeting_ids):
    return spark.createDataFrame([(m, *p) for m in sorted(set(meeting_ids)) for p in TALKERS], "meeting_id string, speaker_label string, agent string, full_name string, role string")


def _layouts(lines):
    a = "\n".join(f"SPEAKER_0{i % 3}: {x}." for i, x in enumerate(lines))
    b = "\n".join(f"[0:00:{i:02d}] Project Manager: {x.upper()} um, [laughter]" for i, x in enumerate(lines))
    c = "\n\n".join(f"{i + 1}\n00:00:{i:02d},871 --> 00:00:{i:02d},999\nK. Kalelt: {x}" for i, x in enumerate(lines))
    return a, b, c


def test_p3_against_brute_force(spark):
    rng = random.Random(3)
    talks = [_talk(rng, 12) for _ in range(12)]
    given = []
    for k, t in enumerate(talks):
        a, b, c = _layouts(t)
        given.append((f"m{k}", "train", a))
        given.append((f"n{k}", [" Validation", "TEST", "val", "other", None][k % 5], [b, c, a][k % 3]))
        given.append((f"m{k}", "test", _layouts(t[: len(t) // 2] + _talk(rng, 6))[0]))  # only half in common
        given.append((f"o{k}", "validation", _layouts(t[:-1])[1]))
    given += [("x", "train", ""), ("x", "test", None), ("y", "train", "SPEAKER_00: um"), ("y", "test", "SPEAKER_00: um"), given[0]]
    table = [meeting(i, t, s, meeting_id=m) for i, (m, s, t) in enumerate(given)]
    want = brute.same_across_splits([(r[0], r[2], r[4]) for r in table], TALKERS)
    assert len(want) > 15
    df, people = spark.createDataFrame(table, MEETINGS), talkers(spark, [r[1] for r in table])
    assert set(rows(crosssplit.p3_found(df, people))) == want
    counted = crosssplit.p3_counts(df, people).collect()
    assert sum(r.n_pairs for r in counted) == len(want)
    assert crosssplit.p3_found(df.limit(0), people).count() == 0
    assert crosssplit.p3_found(df, people.limit(0)).count() > 0


def test_p3_order_of_time():
    names = frozenset(["speaker_00", "speaker_01"])
    a = "[0:00:10] speaker_00: c d\nmore\n[0:00:05] speaker_01: a b"
    assert crosssplit.in_order_of_time(a, names) == "[0:00:05] speaker_01: a b\n[0:00:10] speaker_00: c d\nmore"
    for kept in ("[0:00:10] speaker_00: c d\nspeaker_01: a b\n[0:00:05] speaker_01: e", "one\ntwo", "", "[0:00:10] nobody: x\n[0:00:05] nobody: y"):
        assert crosssplit.in_order_of_time(kept, names) == kept
    c = "2\n00:00:10,500 --> 00:00:11,999\nspeaker_00: x\n\n1\n00:00:05,871 --> 00:00:06,999\nspeaker_01: y\n"
    words = crosssplit.spoken_words(c, crosssplit._Ids(), names).tolist()
    assert words == crosssplit.spoken_words("y x", crosssplit._Ids()).tolist()


def test_p3_words_before_a_colon(spark):
    """Only names of the roster are labels, whatever their length; long notes are no words."""
    names = frozenset(["speaker_00", "project manager", "k. kalelt"])
    shown = lambda t: len(crosssplit.spoken_words(t, crosssplit._Ids(), names))
    assert shown("SPEAKER_00: one two") == 2 and shown("Remember this: one two") == 4 and shown("K. Kalelt: one") == 1
    assert shown("Project Manager (A): one") == 1 and shown("Unknown speaker: one") == 1 and shown(f"SPEAKER_00: {{{'x ' * 90}}} one") == 1
    assert shown(f"{'long ' * 30}: one") == 31


def test_p3_finds_misspelt_words(spark):
    rng = random.Random(8)
    given = []
    for k in range(12):
        said = " ".join(_talk(rng, 14)).split()
        given.append(("train", " ".join(said)))
        for share in (2, 5, 10, 15, 25):  # each misspelt word is one that no other text holds
            odd = set(rng.sample(range(len(said)), len(said) * share // 100))
            given.append(("test", " ".join(f"{w}q{k}x{share}y{i}" if i in odd else w for i, w in enumerate(said))))
    table = [meeting(i, t, s, meeting_id=f"m{i}") for i, (s, t) in enumerate(given)]
    want = brute.same_across_splits([(r[0], r[2], r[4]) for r in table], TALKERS)
    assert len(want) == 48
    df, people = spark.createDataFrame(table, MEETINGS), talkers(spark, ["m0"])
    assert set(rows(crosssplit.p3_found(df, people))) == want
    assert sum(r.n_pairs for r in crosssplit.p3_counts(df, people).collect()) == 48


def test_common_in_order():
    import numpy as np

    def plain(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            new = [0]
            for j, b in enumerate(y):
                new.append(row[j] + 1 if a == b else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    rng = random.Random(5)
    for _ in range(200):
        x = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 40))], dtype=np.int32)
        y = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 40))], dtype=np.int32)
        n = plain(x.tolist(), y.tolist())
        assert crosssplit.common_in_order(x, y, 0) == n
        assert crosssplit.common_in_order(x, y, n + 1) == 0


# 4 --------------------------------------------------------------------------
GOOD = [
    ("Who will test the {a}?", "{n} will test the {a}, and the people at {m} will send the results by Monday."),
    ("What did {n} say about the {a}?", "{n} said that the {a} was too wide for {m} and that someone would have to check it."),
    ("Que pensait {n} du projet {m} ?", "{n} pensait que le projet {m} coûterait plus de 40 euros et qu'il fallait attendre l'avis de {n}."),
    ("Was sagte {n} über den Entwurf von {m}?", "{n} sagte, dass der Entwurf von {m} noch nicht fertig ist und erst geprüft werden muss."),
]


def test_p4_defects(spark):
    rng = random.Random(6)
    things, names = ["valve", "tariff", "roster", "ward", "bridge", "logo"], ["Bask", "Zolk", "Nest", "Darn", "Solk", "Marn"]
    fill = lambda t: t.format(a=rng.choice(things), n=rng.choice(names), m=rng.choice(names))
    base = []
    for k in range(600):
        rng.seed(k // 2)
        q = fill(GOOD[k % 4][0])
        rng.seed(k // 2)
        base.append((f"e{k}", q, fill(GOOD[k % 4][1]).replace("{", "")))
    q = base[0][1]
    broken = {
        "b1": (q, None, "empty"), "b2": (q, "​ ", "empty"), "b3": (q, "[no answer]", "empty"), "b4": (q, "", "empty"),
        "b5": (q, "Nest will test the ward, and the peo", "truncated"), "b6": (q, "Nest will test the ward, and the people at\n", "truncated"),
        "b7": (q, "I'm sorry, but I can't help with that request.", "refusal"), "b8": (q, "As a language model, I am not able to answer this question.", "refusal"),
        "b9": (q, q, "copy"), "b10": (q, f'"{q.upper()}"', "copy"), "b11": (q, f"You asked: {q}", "copy"),
        "b12": (q, "Bask sagte, dass der Entwurf von Nest noch nicht fertig ist und erst geprüft werden muss.", "wrong_language"),
        "b13": (base[2][1], "Zolk will test the roster, and the people at Marn will send the results by Monday.", "wrong_language"),
    }
    fine = {
        "g1": (q, "Yes."), "g2": (q, "the wide ward"), "g3": (q, "Nest, from Marn"), "g4": (q, "Zolk refused to test the valve until the new logo arrives from Darn."),
        "g5": (q, "No decision was taken on the roster."),
    }
    schema = "example_id string, meeting_id string, query string, answer string, prediction string, field string"
    queries = spark.createDataFrame(
        [(i, "m", a, b, "x", "y") for i, a, b in base] + [(i, "m", a, b, "x", "y") for i, (a, b, _) in broken.items()] + [(i, "m", a, b, "x", "y") for i, (a, b) in fine.items()]
        + [("b9", "m", q, q, "x", "y"), (None, "m", q, None, "x", "y"), ("b14", "m", None, None, "x", "y")],
        schema,
    )
    predictions = spark.createDataFrame([("p1", "e1", q, None)], "prediction_id string, example_id string, query string, prediction string")
    found = {(f, k): x for f, k, x in rows(defects.p4_found(queries, predictions))}
    assert found.pop(("prediction", "p1")) == "empty" and found.pop(("answer", "b14")) == "empty"
    assert found == {("answer", i): x for i, (_, _, x) in broken.items()}
    assert defects.p4_found(queries.limit(0), predictions.limit(0)).count() == 0


def test_p4_refusal_behind_long_lead_in(spark):
    rng = random.Random(9)
    things, names = ["valve", "tariff", "roster", "ward", "bridge", "logo"], ["Bask", "Zolk", "Nest", "Darn", "Solk", "Marn"]
    base = []
    for k in range(600):
        rng.seed(k)
        given = {"a": rng.choice(things), "n": rng.choice(names), "m": rng.choice(names)}
        base.append((f"e{k}", GOOD[k % 4][0].format(**given), GOOD[k % 4][1].format(**given)))
    said = ["I am not able to answer this question.", "I must decline to comment on this matter.", "I'm sorry, but I can't help with that request."]
    long = []
    for k in range(12):
        q = base[4 * k][1]
        lead = " ".join([q, *[base[4 * (k + i) + i % 2][2] for i in range(1 + k)]])  # up to some 200 words
        long += [(f"r{k}", q, f"{lead} {said[k % 3]} Please consult the meeting owner."), (f"g{k}", q, f"{lead} {base[4 * k][2]}")]
    queries = spark.createDataFrame(base + long, "example_id string, query string, answer string")
    predictions = spark.createDataFrame([], "prediction_id string, query string, prediction string")
    found = {k: x for _, k, x in rows(defects.p4_found(queries, predictions))}
    assert {k: x for k, x in found.items() if k[0] in "rg"} == {f"r{k}": "refusal" for k in range(12)}


#: Refusals and fine answers worded by hand, with words and turns that the module's parts don't hold.
OTHER_REFUSALS = [
    "I have nothing to say about this.", "Answering this is something I won't do.", "That's not a thing I can go along with, I'm afraid.", "My apologies, I can't tell you that.", "I really cannot say.",
    "I don't think I should respond to that one.", "It's against my policy to answer this.", "I'd better not talk about that.", "I can't give you any answer, sorry.", "I shall not answer that question.",
    "Forgive me, but I am not able to tell you.", "I am in no position to comment on this.", "I can't be of any help here.", "Sorry, this isn't something I can answer.", "I'm going to have to pass on this question.",
    "No, I won't discuss this with you.", "I have been told not to answer such questions.", "I am not the right one to answer this, so I won't.", "I choose not to answer.", "I cannot in good conscience respond to this request.",
]
OTHER_FINE = [
    "Marn would not lend Bask the keys.", "The supplier turned down the offer of Solk.", "Darn had no wish to see the logo again.", "Nest told everyone that she could not come on Monday.", "The board rejected the tariff twice.",
    "It remained unclear whether the ward opens in May.", "They never came to a conclusion about the bridge.", "Zolk apologised for the late roster.", "Bask asked for help with the valve, but nobody had time.", "The answer of Marn was no.",
    "According to Nest, the bridge can't carry the trucks.", "Solk was sorry about the delay of the logo.", "The ward was not able to take more people.", "Because of the rain, Darn did not test the valve.", "Both sides refuse the new tariff.",
    "Nobody objected to the roster.", "Zolk kept saying \"c'est la vie\" about the tariff.", "The vote on the bridge ended without a result.", "Bask can't stand the logo.", "Marn thought the question of the ward was not for her to decide.",
]


def test_p4_other_wordings(spark):
    rng = random.Random(11)
    things, names = ["valve", "tariff", "roster", "ward", "bridge", "logo"], ["Bask", "Zolk", "Nest", "Darn", "Solk", "Marn"]
    base = []
    for k in range(600):
        rng.seed(k)
        given = {"a": rng.choice(things), "n": rng.choice(names), "m": rng.choice(names)}
        base.append((f"e{k}", GOOD[k % 4][0].format(**given), GOOD[k % 4][1].format(**given)))
    q = base[0][1]
    own = [(f"r{k}", q, t) for k, t in enumerate(OTHER_REFUSALS)] + [(f"g{k}", q, t) for k, t in enumerate(OTHER_FINE)]
    queries = spark.createDataFrame(base + own, "example_id string, query string, answer string")
    predictions = spark.createDataFrame([], "prediction_id string, query string, prediction string")
    found = {k: x for _, k, x in rows(defects.p4_found(queries, predictions))}
    hit = [k for k in range(len(OTHER_REFUSALS)) if found.get(f"r{k}") == "refusal"]
    wrong = [k for k in range(len(OTHER_FINE)) if f"g{k}" in found]
    print("refusals found", len(hit), "of", len(OTHER_REFUSALS), "missed", [OTHER_REFUSALS[k] for k in range(20) if k not in hit])
    print("fine answers flagged", [(OTHER_FINE[k], found[f"g{k}"]) for k in wrong])
    assert len(hit) >= 12 and len(wrong) <= 3


def test_p4_sentences():
    assert defects.sentences('Nest said "No. I can\'t." to Bask. It costs 1.5 euro... I must decline! Why?') == [
        'Nest said "No. I can\'t." to Bask.', "It costs 1.5 euro...", "I must decline!", "Why?",
    ]
    assert defects.sentences("One.") == ["One."] and defects.sentences(None) == defects.sentences(" ...") == []


# 5 --------------------------------------------------------------------------
def test_p5_against_brute_force(spark):
    rng = random.Random(7)
    segs = [(i, f"m{rng.randrange(3)}", [rng.randrange(0, 60000) / 1000, 1.0], "A", 5) for i in range(300)]
    segs += segs[:20] + [(900, "m0", None, "A", 5), (901, "m0", [None, 1.0], "A", 5), (902, None, [1.0, 2.0], "A", 5), (903, "m0", [], "A", 5), (904, "m0", [float("nan"), 1.0], "A", 5)]
    turns_ = [(f"m{rng.randrange(3)}", [(rng.choice([rng.randrange(0, 60000) / 1000, None]), 1.0, "S") for _ in range(20)]) for _ in range(6)] + [("m0", None), ("m1", []), (None, [(1.0, 2.0, "S")])]
    left = spark.createDataFrame(segs, "segment_id long, meeting_id string, timestamp array<double>, speaker string, turn_start_ms int")
    right = spark.createDataFrame([(m, t, 3) for m, t in turns_], "meeting_id string, exclusive_turns array<struct<start:double,end:double,speaker:string>>, segment_id int")
    want = set()
    for i, m, ts, *_ in segs:
        if m is None or not ts or ts[0] is None or ts[0] != ts[0]:
            continue
        own = round(ts[0] * 1000)
        near = sorted({(abs(round(t[0] * 1000) - own), round(t[0] * 1000)) for mm, tt in turns_ if mm == m for t in tt or [] if t[0] is not None})
        if near and near[0][0] <= 1500:
            want.add((i, near[0][1]))
    got = rows(nearest.p5_found(left, right))
    assert set(got) == want and len(got) == len(want) > 50
    assert nearest.p5_found(left.limit(0), right).count() == 0 and nearest.p5_found(left, right.limit(0)).count() == 0


def test_p5_no_table_on_the_driver(spark):
    """The expanded turns aren't broadcast where the planner takes them for small, nor written to many ticks; any tick gives the same."""
    left = spark.createDataFrame([(1, "m", 5_000), (2, "m", 5_999), (3, "m", 9_600)], "segment_id int, entity string, l long")
    right = spark.createDataFrame([("m", 4_200), ("m", 6_100), ("m", 6_100), ("m", 11_000)], "entity string, r long")
    joined = nearest.nearest_by_ticks(left, right)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert nearest.TICK_MS >= 2 * nearest.TOLERANCE_MS
    for tick in (1, 250, 1_500, 3_000, nearest.TICK_MS, 1_000_000):
        assert rows(nearest.nearest_by_ticks(left, right, tick=tick), "segment_id", "r") == [(1, 4_200), (2, 6_100), (3, 11_000)]


# 6 --------------------------------------------------------------------------
PEOPLE = [("SPEAKER_00", "A", "Momb Samand", "Project Manager"), ("SPEAKER_01", "B", "Nest Lelasan", "User Interface Designer")]
TALKS = [
    "SPEAKER_00: Hello there. um, [laughter]\nNest: Yes (the second one) at 14:40.\nwrapped line here\nRemember: this is spoken",
    "[0:00:10] PM: second words\n[0:00:05] N. Lelasan: first <cough> words\n[0:00:20.5] ???: who [inaudible 0:00:21] knows",
    "1\n00:00:11,871 --> 00:00:11,999\nProject Manager: one two\n\n2\n00:00:17,376 --> 00:00:17,999\nProject Manager (A): Uh-huh.\n\n3\n00:00:20,376 --> 00:00:21,999\nA (Project Manager): three\n",
    "SPEAKER_00: one line. SPEAKER_01: two {pause} three. SPEAKER_01: four",
    "00:00:07 - S1:\r\ntext below\r\n00:00:09 - Lelasan, Nest: and more\r\n",
    "no label at all\nSpk01: later",
    "um\n[Music]", "   ", "", "X: y: z", "(00:12) Unknown speaker : er... hmm", "Nest Lelasan [SPEAKER_01]: okay, yeah, like, you know",
    "SPEAKER_07: not in the roster\nUser Interface Designer - Nest Lelasan: fine", "S0:glued *sighs* text ((crosstalk)) ending the{pause} word",
]


def test_p6_against_brute_force(spark):
    long = "\n".join(f"SPEAKER_0{i % 2}: words number {i} um, [cough]" for i in range(3000))
    texts = [*TALKS, long]
    meetings = spark.createDataFrame([meeting(i, t) for i, t in enumerate(texts)] + [meeting(0, texts[0]), meeting(500, None), meeting(501, "Nest: hi", meeting_id=None)], MEETINGS)
    queries = spark.createDataFrame([("q1", "m", texts[1], "x"), ("q1", "m", texts[1], "y"), ("q2", "other", texts[0], "z")], "example_id string, meeting_id string, relevant_transcript string, speaker string")
    roster = spark.createDataFrame([("m", *p, "note") for p in PEOPLE] + [("m", *PEOPLE[0], "note"), (None, *PEOPLE[0], "note")], "meeting_id string, speaker_label string, agent string, full_name string, role string, text string")
    want = {("meeting", str(i), n + 1, w, c) for i, t in enumerate(texts) for n, (w, c) in enumerate(brute.turns(t, PEOPLE))}
    want |= {("query", "q1", n + 1, w, c) for n, (w, c) in enumerate(brute.turns(texts[1], PEOPLE))}
    want |= {("query", "q2", n + 1, w, c) for n, (w, c) in enumerate(brute.turns(texts[0], []))}
    want |= {("meeting", "501", 1, "UNKNOWN", 2)}
    got = rows(turns.p6_found(meetings, queries, roster))
    assert set(got) ^ want == set() and len(got) == len(want)
    shown = {(r.record_key, r.turn_no): r.text for r in turns.p6_turns(meetings, queries, roster).collect() if r.record_kind == "meeting"}
    assert shown["0", 2] == "Yes (the second one) at 14:40. wrapped line here Remember: this is spoken"
    assert turns.p6_found(meetings.limit(0), queries.limit(0), roster).count() == 0


# 7 --------------------------------------------------------------------------
ODD = ["", None, " ", "\n\n\n", "Hello  world's  end", "<|endoftext|> is text", "ようこそ" * 50, "a\x01b\x07c", "é​﻿", "　x y\t \n z ", "😀👍🏽 ok", "don't won't I'll 1234 56.78", "x" * 3000, "Ñandú über straße"]


def test_p7_against_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = encoding.vocabulary_path("byte_bpe_50k.json")
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = [*ODD, " the" * 5000]
    df = spark.createDataFrame([(i, x, "w", 5) for i, x in enumerate(texts)] + [(4, ODD[4], "w", 5)], "doc_id long, text string, word string, n long")
    want = {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(texts)}
    for share in (4096, 3):  # all hot but the rarest, and nearly none
        got = encoding.encode_corpus(df, hot_share=share).collect()
        assert {r.doc_id: list(r.ids) for r in got} == want and len(got) == len(want)
    back = {r.doc_id: r.same for r in encoding.p7_roundtrip(df).collect()}
    assert back == {i: True for i in want}
    assert encoding.p7_ids(df.limit(0)).count() == 0


# 8 --------------------------------------------------------------------------
def test_p8_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["éa", "Straße"]
    items = [(i, "test", "passage", " ".join(rng.choice(words) for _ in range(rng.randrange(5, 40))), 1) for i in range(40)] + [(90, "test", "answer", None, 1), (91, "test", "answer", "", 1), (92, "test", "answer", " ".join(["w1"] * 30), 1)]
    docs = []
    for d in range(80):
        own = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        if d % 2:
            part = items[rng.randrange(40)][3].split()
            k = rng.choice([12, 13, 14, 40])
            part = part[:k]
            if d % 3 == 0 and len(part) > 6:
                part[6] = "changed"
            own += part
        text = "  ".join(own).upper() if d % 5 == 0 else ", ".join(own)
        if d % 7 == 0:
            text = unicodedata.normalize("NFD", text).replace("w", "ｗ").replace("a", "а").replace(" ", " ")
        docs.append((d, text, "x", 3))
    docs += [(200, None, "x", 3), (201, "", "x", 3), (202, "w1 " * 90_000, "x", 3), docs[1]]
    left = spark.createDataFrame(docs, "doc_id long, text string, words string, item_id int")
    right = spark.createDataFrame(items, "item_id long, split string, kind string, text string, doc_id int")
    want = brute.leaks([(d[0], d[1]) for d in docs], [(i[0], i[3]) for i in items])
    got = rows(leak.p8_found(left, right))
    assert set(got) == want and len(got) == len(want) > 10
    parted = rows(leak.p8_found(left, right, shard_bits=1 << 20))  # more item windows than one filter takes
    assert parted == got
    near = leak.p8_leaked(left, right).collect()
    assert {r.item_id for r in near if r.n_docs} == {i for _, i in want}
    assert leak.p8_found(left.limit(0), right).count() == 0 and leak.p8_found(left, right.limit(0)).count() == 0


def test_p8_extends_hits(spark):
    said = [f"t{i}" for i in range(40)]
    other = [*said[:17], "zz", *said[18:]]
    docs = spark.createDataFrame([(1, "x y " + " ".join(said)), (2, " ".join(other)), (3, " ".join(said[:12])), (4, " ".join([*said[:13], "and", *said[20:40]]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(said))], "item_id long, text string")
    found = {(r.doc_id, r.pos, r.item_pos): (r.n_words, r.same_words) for r in leak.overlaps(docs, items).collect()}
    assert found[1, 2, 0] == (40, 40) and found[2, 0, 0] == (40, 39)
    assert found[4, 0, 0][1] == 13 and found[4, 14, 20] == (20, 20) and not any(d == 3 for d, _, _ in found)
    assert [tuple(r) for r in leak.p8_leaked(docs, items).collect()] == [(7, 3, 0, 40)]


def test_p8_tolerates_substitutions():
    import numpy as np

    words = [f"t{i}" for i in range(13)]
    hit = 0
    for k in range(13):
        other = [*words[:k], "zz", *words[k + 1 :]]
        a, b = leak._windows([" ".join(words)])[2], leak._windows([" ".join(other)])[2]
        hit += bool(np.any(a == b))
    assert hit == sum("0" in (m[k] for m in leak.MASKS) for k in range(13)) > 5


# 9 --------------------------------------------------------------------------
def test_p9_pairs(spark):
    same = ["Café at 9, fine co-op", "Café at 9, fine co-op", "Саfé at 9, fine co-op", "Ｃａｆｅ́ at ９, ﬁne co-op", "Ca​fé﻿ at 9, fine co‑op", "Café at 9, fine co-op"]
    other = ["café at 9, fine co-op", "Cafe at 9, fine co-op", "Café at 8, fine co-op", "Café at 9. fine co-op", "Café at  9, fine co-op", "Café at 9,\nfine co-op"]
    rest = ["Отчёт ещё не готов", "Отчёт ещё не готов", "", None, " ​　", "​", "a\nb", "a\r\nb", "議事録で", "議事録で"]
    texts = [*same, *other, *rest]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, form string, block int")
    want = {(i, j) for i in range(6) for j in range(i + 1, 6) if texts[i] != texts[j]}
    n = len(same) + len(other)
    want |= {(n, n + 1), (n + 6, n + 7), (n + 8, n + 9)}
    assert set(rows(lookalike.p9_found(df))) == want
    named = dict(rows(lookalike.p9_canonical(df)))
    assert all(named[i] == 0 for i in range(6)) and all(named[i] == i for i in range(6, n + 1)) and named[n + 1] == n
    assert len(named) == len(texts)
    assert lookalike.p9_found(df.limit(0)).count() == 0


def test_looks_tables():
    assert looks.single()["Ａ"] == "A" and looks.single()["　"] == " " and looks.single()["­"] == "" and looks.single()["ё"] == "ë"
    assert looks.joined()["ﬁ"] == "fi" and "." not in looks.single()
    assert looks.plain("НЕLLО Ｗorld") == looks.plain("hello world")
