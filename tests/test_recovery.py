"""Actions, assignments, roll calls, the pipeline, passes, sinks and the query corpus, on small cases."""

from __future__ import annotations

import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from meetspark import runtime
from meetspark.operators import actions, alignment, asr, caching, claims, corpora, evaluation, pipeline, recover
from meetspark.sinks import files
from meetspark.sources import query_corpus

SEG = "meeting_id string, idx int, seg_id string, speaker string, text string, start_s double, end_s double"
NO_ACTIONS = "meeting_id string, idx int, task string, owner string, deadline string, commitment_status string, ids array<string>"


def meeting(spark, lines, step=5.0):
    return spark.createDataFrame([("m", i, f"seg-{i + 1:04d}", s, t, i * step, i * step + 4) for i, (s, t) in enumerate(lines)], SEG)


def test_stitched_actions(spark):
    s = meeting(spark, [("A", "I will send the"), ("A", "signed form to the office."), ("B", "We had lunch."), ("B", "Priya will review the budget report by Monday."), ("C", None), ("A", "If people need it, send the form to them.")])
    turns = {r.idx: (r.text, r.ids) for r in actions.stitched_turns(s).collect()}
    assert turns[0] == ("I will send the signed form to the office.", ["seg-0001", "seg-0002"]) and 1 not in turns and turns[3][1] == ["seg-0004"]
    none = spark.createDataFrame([], NO_ACTIONS)
    got = actions.explicit_actions(s, none).orderBy("idx").collect()
    assert [(r.task, r.commitment_status, r.ids) for r in got] == [
        ("Send the signed form to the office.", "confirmed", ["seg-0001", "seg-0002"]), ("Priya will review the budget report by Monday.", "confirmed", ["seg-0004"]),
    ]
    known = spark.createDataFrame([("m", 0, "Send the signed form to the office", "Ana", None, "suggested", ["seg-0009"])], NO_ACTIONS)
    assert actions.explicit_actions(s, known).count() == 2  # the turn's own is a repetition
    assert actions.explicit_actions(s.limit(0), none).count() == 0
    late = meeting(spark, [("A", "I will send the"), ("A", "signed form to the office.")], step=60.0)
    assert actions.stitched_turns(late).first().ids == ["seg-0001"]


def test_role_assignments(spark):
    s = meeting(spark, [
        ("A", "I am Nadia, and I am the industrial designer."), ("A", "Just to wrap up, some work."), ("A", "As the industrial designer, you are going to be working on the physical design."),
        ("A", "Marketing expert, you will be thinking about"), ("A", "the user requirements."), ("B", "Okay then."),
    ])
    got = actions.role_assignments(s).orderBy("idx").collect()
    assert [(r.idx, r.role, r.task) for r in got] == [(2, "Industrial Designer", "Work on the physical design"), (3, "Marketing Expert", "Determine the user requirements")]
    assert got[1].ids == ["seg-0004", "seg-0005", "seg-0006"]
    assert actions.role_assignments(s.limit(0)).count() == 0


def test_roll_call(spark):
    s = meeting(spark, [("A", "So that is Nadia, Oskar, and Priya."), ("B", "x"), ("C", None)])
    people = spark.createDataFrame([("m", "B", "Nadja"), ("m", "C", "Oskar"), ("m", "D", "Bob"), ("n", "E", "Eve")], "meeting_id string, speaker string, name string")
    assert rows(actions.roll_call(s, people)) == [("m", "B", "Nadia", "Nadia"), ("m", "C", "Oskar", None), ("m", "D", "Bob", None), ("n", "E", "Eve", None)]
    assert actions.roll_call(s.limit(0), people).count() == 4


def test_pipeline_reads_its_input_once(spark):
    """The plan of the result holds tables between stages only, not the segments and outputs with all that they are made of."""
    s = meeting(spark, [("A", "Today we are talking about the delivery plan for zone nine."), ("B", "The customs delay is a risk for the launch.")])
    outputs = spark.createDataFrame([("m", 0, '{"risks": ["The customs delay is a risk for the launch."]}')], "meeting_id string, window int, output string")
    told = pipeline.run(outputs, s)
    leaves = told._jdf.queryExecution().optimizedPlan().collectLeaves().toString()
    assert "LogicalRDD" not in leaves and "LocalRelation" not in leaves and told.count() == 1


def test_expressions_stand_once_in_the_plan(spark):
    """Tasks and items are made from texts used many times over; the driver has to hold each copy in the plan and its code."""
    text = spark.range(3).select(F.lit(1).alias("meeting_id"), F.lit(0).alias("window"), F.col("id").cast("string").alias("output"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(text.select(recover.clean_action_task(F.col("output")).alias("task"))).count("you to (?=") == 1
    items = plan(claims.ingest(text))
    assert items.count("$.task") == 1 and items.count("$.owner") == 1


def test_only_and_settled(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "b")], "k int, t string")
    assert rows(runtime.only(df, "t <> ''")) == [(1, "a"), (4, "b")] and runtime.only(df, "t <> ''").columns == ["k", "t"]
    whole = lambda: [b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if b.getName() == "G1 Old Generation"]
    before = whole()
    assert rows(runtime.settled(df, "settled")) == rows(df) and [x - y > 0 for x, y in zip(whole(), before)] == [True]


def test_pipeline(spark):
    s = meeting(spark, [
        ("A", "Today we are talking about the delivery plan for zone nine."), ("A", "I am Nadia, and I am the industrial designer."), ("B", "We agreed to go with supplier nine for the launch."),
        ("B", "The customs delay is a risk for the launch."), ("B", "Priya will review the budget report by Monday."), ("A", "Just to wrap up, one thing."), ("A", "As the industrial designer, you are going to be working on the physical design."),
    ])
    told = json.dumps({"decisions": [{"text": "We agreed to go with supplier nine for the launch.", "evidence_segment_ids": ["seg-0003"]}, {"text": "They chose blue paint.", "evidence_segment_ids": ["seg-0003"]}], "risks": ["no source"]})
    outputs = spark.createDataFrame([("m", 0, told), ("m", 1, "{broken")], "meeting_id string, window int, output string")
    r = pipeline.run(outputs, s).collect()
    assert len(r) == 1 and r[0].n_rejected == 2
    assert "delivery plan for zone nine" in r[0].summary and "supplier nine" in r[0].report and "blue paint" not in r[0].report
    assert "- Nadia (Industrial Designer; A)" in r[0].report and "Work on the physical design (owner: Nadia)" in r[0].report and "2 unsupported analytical candidate(s)" in r[0].report
    assert pipeline.run(outputs, s.limit(0)).count() == 0
    quiet = pipeline.run(outputs.limit(0), s.where("idx = 2")).first()
    assert "B" in quiet.report and quiet.n_linked == 0


def test_index_and_gate(spark):
    s = meeting(spark, [("A", "one"), ("B", "two")])
    plain, error = pipeline.build_index(s, None)
    assert error is None and plain.where("embedding IS NULL").count() == 2

    def fails(_):
        raise RuntimeError("no model")

    assert pipeline.build_index(s, fails)[1] == "RuntimeError: no model"
    made, error = pipeline.build_index(s, lambda df: df.select("meeting_id", "idx", F.array(F.length("text").cast("float")).alias("embedding")))
    assert error is None and made.where("embedding[0] = 3").count() == 2
    asked = spark.createDataFrame([("q1", "supported"), ("q2", "low_confidence")], "question_id string, status string")
    seen = []
    got = {r.question_id: (r.answer, r.generated) for r in pipeline.gated_answers(asked, lambda df: seen.append(df.count()) or df.withColumn("answer", F.lit("yes"))).collect()}
    assert got == {"q1": ("yes", True), "q2": (pipeline.NO_SUPPORT, False)} and seen == [1]


def test_second_pass(spark):
    kind = "meeting_id string, idx int, text string, start_s double, end_s double, avg_logprob double, no_speech_prob double, compression_ratio double"
    base = [("m", 0, "start of it", 0.0, 2.0, -0.1, 0.0, 1.0), ("m", 1, "end of it all", 198.0, 200.0, -0.1, 0.0, 1.0), ("good", 0, " ".join(["word"] * 400), 0.0, 200.0, -0.1, 0.0, 1.0)]
    second = [("m", 0, "a long new remark about the budget of the plan", 50.0, 60.0, -0.1, 0.0, 1.0), ("m", 1, "noise", 70.0, 71.0, -3.0, 0.0, 1.0), ("good", 0, "not needed here", 300.0, 301.0, -0.1, 0.0, 1.0)]
    kept, attempts = asr.choose_pass(spark.createDataFrame(base, kind), spark.createDataFrame(second, kind))
    assert rows(kept, "meeting_id", "origin") == [("good", "vad"), ("m", "recovery"), ("m", "vad"), ("m", "vad")]
    assert rows(attempts, "meeting_id", "strategy", "selected") == [("good", "vad", True), ("m", "hybrid", True), ("m", "vad", False)]
    assert dict(rows(asr.review_needed(attempts))) == {"good": False, "m": True}


def test_combine_and_rename(spark):
    s = spark.createDataFrame([("m", 0, "x", 0.0, 2.0), ("n", 0, "y", 0.0, 2.0), ("o", 0, "z", 0.0, 2.0)], "meeting_id string, idx int, text string, start_s double, end_s double")
    t = spark.createDataFrame([("m", 0, 0.0, 2.0, "S1"), ("n", 0, 0.0, 2.0, "S1")], "meeting_id string, idx int, s double, e double, speaker string")
    runs = spark.createDataFrame([("m", None), ("n", "out of memory")], "meeting_id string, error string")
    got = {r.meeting_id: (r.speaker, r.note) for r in alignment.combine(s, t, runs).collect()}
    assert got == {"m": ("S1", None), "n": (None, "Speakers unavailable: out of memory"), "o": (None, "Speakers unavailable: no speaker turns")}
    names = spark.createDataFrame([("m", "S1", " Ana  Lee "), ("m", "S2", " ")], "meeting_id string, speaker string, name string")
    turns = spark.createDataFrame([("m", "S1"), ("m", "S2"), ("n", "S1")], "meeting_id string, speaker string")
    assert rows(alignment.rename_speakers(turns, names)) == [("m", "Ana Lee"), ("m", "S2"), ("n", "S1")]
    text = spark.createDataFrame([("S1: hi S1\nS10: yo", [("S1", "A$na")])], "t string, n array<struct<speaker:string,name:string>>")
    assert text.select(alignment.rename_in_text(F.col("t"), F.col("n"))).first()[0] == "A$na: hi S1\nS10: yo"
    audio = spark.createDataFrame([("m", 0, "we ship"), ("m", 1, "on monday"), ("n", 0, "other")], "meeting_id string, idx int, text string")
    parsed = spark.createDataFrame([("m", 0, "We ship on Monday"), ("n", 0, "other")], "meeting_id string, idx int, text string")
    assert rows(alignment.take_audio(parsed, audio)) == [("m",)]


def test_scores_of_models(spark):
    scores = spark.createDataFrame([("a", 0.5, 0.4), ("a", None, 0.4), ("b", 0.6, 0.5)], "model string, f1 double, rouge_l double")
    checks = spark.createDataFrame([("b", True), ("a", False)], "model string, passed boolean")
    r = evaluation.promotion(scores, checks, "a", "b").first()
    assert r.base_f1 == 0.25 and r.promoted and not evaluation.promotion(scores, checks.withColumn("passed", F.lit(False)), "a", "b").first().promoted
    kind = "meeting_id string, s double, e double, speaker string"
    ref = spark.createDataFrame([("m", 0.0, 100.0, "A"), ("m", 100.0, 150.0, "B"), ("n", 0.0, 10.0, "A")], kind)
    hyp = spark.createDataFrame([("m", 0.0, 90.0, "x"), ("m", 90.0, 160.0, "y")], kind)
    got = {r.meeting_id: r for r in evaluation.diarization_error(ref, hyp).collect()}
    assert got["m"].confused_s == pytest.approx(10) and got["m"].false_s == pytest.approx(10) and got["m"].missed_s == 0 and got["m"].rate == pytest.approx(20 / 150)
    assert got["n"].rate == 1.0


def test_most_agreed():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(60):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        table = [[rng.choice([0, rng.random()]) for _ in range(m)] for _ in range(n)]
        given = [{"r": i, "h": j, "d": table[i][j]} for i in range(n) for j in range(m) if table[i][j]]
        small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
        best = max(sum(table[i][j] if n <= m else table[j][i] for i, j in zip(small, p)) for p in itertools.permutations(large, len(small)))
        assert evaluation.most_agreed(given) == pytest.approx(best)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m", "é", None), ("n", None, 1)], "meeting_id string, text string, k int")
    assert files.write_jsonl(df, f"{tmp_path}/a") == 2
    lines = [json.loads(x) for p in os.listdir(f"{tmp_path}/a") if p.startswith("part") for x in open(f"{tmp_path}/a/{p}", encoding="utf-8")]
    assert {"meeting_id": "n", "text": None, "k": 1} in lines
    seg = spark.createDataFrame([("m", 5.0, 1.0, "s", None), ("m", 1.0, 2.0, " ", "A"), ("m", 1.0, 0.0, "s", "A")], "meeting_id string, start double, duration double, speaker_id string, agent string")
    files.write_rttm(seg, f"{tmp_path}/r")
    from meetspark.sources.nxt import read_rttm

    assert rows(read_rttm(spark, f"{tmp_path}/r"), "meeting_id", "start", "duration", "speaker") == [("m", 1.0, 2.0, "A"), ("m", 5.0, 1.0, "s")]
    files.write_reports(spark.createDataFrame([("m", "# A\nb")], "meeting_id string, report string"), f"{tmp_path}/t")
    assert spark.read.text(f"{tmp_path}/t", wholetext=True).first()[0] == "# A\nb\n"
    runs = []
    compute = lambda w: runs.append(w.count()) or w.select("meeting_id", F.lit("x").alias("v"))
    for work in (df.limit(1), df, df):
        done = files.append_pending(work, compute, f"{tmp_path}/p", "meeting_id", "meeting_id string, v string")
    assert runs == [1, 1, 0] and done.count() == 2
    files.write_audit(corpora.audit(df, ["text"]), f"{tmp_path}/audit")
    assert spark.read.json(f"{tmp_path}/audit").count() == 2


def test_query_corpus(spark, tmp_path):
    turn = lambda s, t: {"speaker": s, "content": t}
    one = {"meeting_transcripts": [turn("A", "one"), turn("B", "two"), turn("A", "three")], "general_query_list": [{"query": "Sum up.", "answer": "All."}],
           "specific_query_list": [{"query": "Who?", "answer": "B", "relevant_text_span": [["2", "9"], ["0", "0"]]}], "topic_list": [{"topic": "T", "relevant_text_span": [["1", "1"]]}]}
    two = {"meeting_transcripts": [], "general_query_list": {"query": "Q", "answer": None}}
    for split, name, body in (("train", "ES2002a", one), ("val", "covid_1", two), ("test", "Bmr001", {})):
        os.makedirs(tmp_path / split, exist_ok=True)
        (tmp_path / split / f"{name}.json").write_text(json.dumps(body, indent=1), encoding="utf-8")
    m = query_corpus.read_meetings(spark, str(tmp_path))
    got = {r.meeting_id: r for r in query_corpus.general_meetings(m).collect()}
    assert (got["ES2002a"].split, got["ES2002a"].domain, got["ES2002a"].turn_count, got["ES2002a"].query) == ("train", "product", 3, "Sum up.")
    assert (got["covid_1"].split, got["covid_1"].query, got["covid_1"].answer) == ("validation", "Q", "") and got["Bmr001"].query == "Summarize the meeting."
    q = query_corpus.specific_queries(m).first()
    assert (q.example_id, q.relevant_transcript) == ("ES2002a.query0", "A: three\nA: one")
    assert query_corpus.topics(m).first().relevant_transcript == "B: two"
    assert rows(query_corpus.audit(m), "split", "n_queries") == [("test", 0), ("train", 1), ("validation", 0)]


def test_small_reports(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    assert caching.file_fingerprints(spark, str(tmp_path)).first().fingerprint == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    before = caching.folder_fingerprint(spark, str(tmp_path)).first()[0]
    (tmp_path / "b.txt").write_text("y")
    assert caching.folder_fingerprint(spark, str(tmp_path)).first()[0] != before
    events = spark.createDataFrame([("asr", 2.0, False, 1), ("asr", 9.0, True, 2), ("qa", None, False, 3)], "stage string, seconds double, hit boolean, at int")
    assert rows(caching.stage_times(events)) == [("asr", 2, 2.0, 1), ("qa", 1, 0.0, 0)] and caching.latest_events(events, 1).first().at == 3
    keys = spark.createDataFrame([("a",), ("b",)], "cache_key string")
    assert rows(caching.without(keys, keys.limit(1))) == [("b",)] and caching.without(keys).count() == 0
    parts = spark.createDataFrame([("m", 0, "ab"), ("m", 1, "cd"), ("n", 0, "x")], "meeting_id string, window int, summary string")
    assert rows(claims.merge_summaries(parts)) == [("m", "ab (Merged from 2 windows.)", 2), ("n", "x", 1)]
    splits = spark.createDataFrame([("train", 3), ("train", 1), ("test", 2)], "split string, pos int")
    assert rows(corpora.first_of_split(splits, 1, "pos")) == [("test", 2), ("train", 1)]
    q = spark.createDataFrame([("e", "train", "Who?", None, "A: x")], "example_id string, split string, query string, answer string, relevant_transcript string")
    assert [m.content for m in corpora.chat_records(q, "Be brief.").first().messages] == ["Be brief.", "Evidence:\nA: x\n\nQuestion: Who?", ""]
