from __future__ import annotations

import json

from conftest import rows
from pyspark.sql import functions as F

from meetspark.functions import cues, similarity, text as T
from meetspark.operators import alignment, asr, caching, claims, corpora, dedup, digest, evaluation, greedy, packing, retrieval
from meetspark.sources import nxt
from meetspark.streaming import live


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, T.clean_text(F.col("a")), a="  é\t b\n c ") == "é b c" and one(spark, T.clean_text(F.col("a")), a=None) == ""
    assert [one(spark, T.clip(F.col("a"), 0.7), a=v) for v in ("2", "-1", "0.4", "no", None)] == [1.0, 0.0, 0.4, 0.7, 0.7]
    assert one(spark, T.seconds(F.col("a")), a="1:02:03.5") == 3723.5
    assert one(spark, T.format_timestamp(F.col("a").cast("double")), a="3723.5") == "01:02:03.50" and one(spark, T.format_timestamp(F.col("a").cast("double")), a=None) == ""
    assert one(spark, T.tokens(F.col("a")), a="Don't STOP, señor 9_x") == ["don't", "stop", "señor", "9_x"]
    assert sorted(one(spark, T.content_tokens(F.col("a")), a="The meetings were starting; class glass it's")) == ["class", "glass", "meeting", "start"]
    assert one(spark, T.lexical_score(F.col("a"), F.col("b")), a="delivery plan", b="our delivery plan holds") == 1.0
    assert one(spark, T.lexical_score(F.col("a"), F.col("b")), a="the of", b="x") == 0.0
    assert one(spark, T.word_overlap_size(F.col("a"), F.col("b")), a="we send the form", b="The form today") == 2
    assert one(spark, T.join_overlapping_text(F.col("a"), F.col("b")), a="we send the form,", b="the form today") == "we send the form today"
    assert one(spark, T.join_overlapping_text(F.col("a"), F.col("b")), a="one,", b="two") == "one, two"
    assert one(spark, T.number_value(F.col("a")), a="Seven") == "7" and one(spark, T.role_key(F.col("a")), a="Marketing  Expert") == "marketing"
    assert one(spark, T.render_segment(F.lit("seg-0001"), F.lit(None).cast("double"), F.col("a"), F.col("b")), a=None, b="hi") == "[seg-0001] hi"


def test_action_status(spark):
    said = {
        "Priya will send report 4 by Monday.": (True, False), "Could you share the price list again?": (False, True), "I do not think we can send report 3 today.": (False, False),
        "What I did was review the earlier report; I will send it.": (False, False), "Tomas, please review invoice 3.": (True, True), "If people need it, send the form.": (False, False), "": (False, False),
    }
    df = spark.createDataFrame([(k,) for k in said] + [(None,)], "text string")
    confirmed, suggested = cues.action_status(F.col("text"))
    got = {r.text: (r.c, r.s) for r in df.select("text", confirmed.alias("c"), suggested.alias("s")).collect()}
    assert got.pop(None) == (False, False) and got == said


def test_similarity(spark):
    df = spark.createDataFrame([("abc", "abcdef"), ("", "x"), (None, "x"), ("the red car", "car red the")], "a string, b string")
    assert [r.x for r in df.select(similarity.evidence_similarity(F.col("a"), F.col("b")).alias("x")).collect()] == [0.5, 0.0, 0.0, 1.0]
    assert [r.x for r in df.select(similarity.metric_similarity(F.col("a"), F.col("b")).alias("x")).collect()][3] == 1.0


def test_assign_speakers(spark):
    segs = spark.createDataFrame([("m", 0, 0.0, 10.0), ("m", 1, 130.0, 50.0), ("m", 2, 500.0, 501.0), ("n", 0, None, None), ("m", 3, 20.0, 24.0)], "meeting_id string, idx int, start_s double, end_s double")
    turns = spark.createDataFrame(
        [("m", 0, 0.0, 4.0, "A"), ("m", 1, 4.0, 10.0, "B"), ("m", 2, 45.0, 200.0, "A"), ("m", 3, 20.0, 22.0, "B"), ("m", 4, 22.0, 24.0, "A"), ("m", 5, 9.0, 9.0, "C"), ("n", 0, None, None, "A")],
        "meeting_id string, idx int, s double, e double, speaker string",
    )
    got = {(r.meeting_id, r.idx): (r.speaker, r.overlap_s) for r in alignment.assign_speakers(segs, turns).collect()}
    # equal overlaps at 20 s to 24 s: the speaker whose first turn is earlier
    assert got == {("m", 0): ("B", 6.0), ("m", 1): ("A", 80.0), ("m", 2): ("SPEAKER_UNKNOWN", 0.0), ("n", 0): ("SPEAKER_UNKNOWN", 0.0), ("m", 3): ("A", 2.0)}
    assert alignment.assign_speakers(segs, turns.limit(0)).where("speaker <> 'SPEAKER_UNKNOWN'").count() == 0


def test_parse_transcript(spark):
    df = spark.createDataFrame(
        [("a", "[0:00:05.5] Ana: hello  there\n\n just text\r\nBo: x: y"), ("b", "SPEAKER_00: one SPEAKER_01: two"), ("c", None), ("d", "  "), ("e", "no speaker")],
        "meeting_id string, transcript string",
    )
    got = rows(alignment.parse_transcript(df), "meeting_id", "idx", "speaker", "text", "start_s")
    assert got == sorted([("a", 0, "Ana", "hello there", 5.5), ("a", 1, None, "just text", None), ("a", 2, "Bo", "x: y", None), ("b", 0, "SPEAKER_00", "one", None), ("b", 1, "SPEAKER_01", "two", None), ("e", 0, None, "no speaker", None)], key=repr)


def test_audio_segments(spark):
    kind = "meeting_id string, speaker_segments array<struct<start:double,end:double,speaker:string,text:string>>, segments array<struct<text:string,timestamp:array<double>>>"
    df = spark.createDataFrame([("a", [(1.0, 2.0, " ", "x "), (2.0, 3.0, "A", " ")], [("z", [0.0, 1.0])]), ("b", None, [("y", [0.0, 1.0]), ("w", None)])], kind)
    assert rows(alignment.audio_segments(df)) == [("a", 0, None, "x", 1.0, 2.0), ("b", 0, None, "y", 0.0, 1.0), ("b", 1, None, "w", None, None)]


def test_reliability_and_passes(spark):
    seg = "meeting_id string, idx int, text string, start_s double, end_s double, avg_logprob double, no_speech_prob double, compression_ratio double"
    df = spark.createDataFrame([("m", i, "same four words here", i * 10.0, i * 10.0 + 5, -0.2, 0.0, 1.0) for i in range(4)] + [("m", 9, "x", 90.0, 95.0, -1.5, 0.9, 3.0)], seg)
    got = {r.idx: r.reasons for r in asr.reliability(df).collect()}
    assert got == {0: [], 1: [], 2: ["repeated_phrase"], 3: ["repeated_phrase"], 9: ["low_log_probability", "probable_silence", "repetitive_compression"]}
    base = df.where("idx < 2").withColumn("text", F.concat(F.lit("base line number "), F.col("idx").cast("string")))
    second = spark.createDataFrame([("m", 0, "entirely new remark", 6.0, 9.0), ("m", 1, "covered by base", 1.0, 3.0), ("m", 2, "far away", 100.0, 101.0), ("m", 3, "base line number 0", 6.0, 7.0)], "meeting_id string, idx int, text string, start_s double, end_s double")
    fresh = asr.recovery_candidates(base, second)
    assert rows(fresh, "idx") == [(0,)]
    merged = rows(greedy.merge_passes(base, fresh), "text", "start_s", "origin")
    assert ("entirely new remark", 6.0, "recovery") in merged and len(merged) == 2  # the two base lines are near copies


def test_sequences():
    import random

    from meetspark.functions.sequences import common_length, edit_distance

    def plain(x, y):
        common, edits = [0] * (len(y) + 1), list(range(len(y) + 1))
        for i, a in enumerate(x):
            c, e = [0], [i + 1]
            for j, b in enumerate(y):
                c.append(common[j] + 1 if a == b else max(c[-1], common[j + 1]))
                e.append(min(edits[j] + (a != b), e[-1] + 1, edits[j + 1] + 1))
            common, edits = c, e
        return common[-1], edits[-1]

    rng = random.Random(4)
    for _ in range(300):
        x, y = ([rng.choice("abcde") for _ in range(rng.randrange(0, 90))] for _ in range(2))
        assert (common_length(x, y), edit_distance(x, y)) == plain(x, y)


def test_packing(spark):
    df = spark.createDataFrame([("m", i, t) for i, t in enumerate(["aaaa", "bbbb", "c" * 25, "", "dd"])] + [("n", 0, None)], "meeting_id string, idx int, rendered string")
    got = packing.chunks(df, 10).orderBy("chunk").collect()
    assert [r.text for r in got] == ["aaaa\nbbbb", "c" * 10, "c" * 10, "ccccc\ndd"] and all(len(r.text) <= 10 for r in got)


def test_evaluation(spark):
    pairs = spark.createDataFrame([(1, "a b c d", "a c d x"), (2, "", ""), (3, "a", None), (4, None, None), (5, "x y", "p q")], "k int, reference string, prediction string")
    assert dict(rows(evaluation.token_f1(pairs, "k"))) == {1: 0.75, 2: 1.0, 3: 0.0, 4: 1.0, 5: 0.0}
    assert dict(rows(evaluation.rouge_l(pairs, "k"))) == {1: 0.75, 2: 1.0, 3: 0.0, 4: 1.0, 5: 0.0}
    assert {r.k: (r.errors, r.words) for r in evaluation.word_error_rate(pairs, "k").collect()} == {1: (2, 4), 2: (0, 0), 3: (1, 1), 4: (0, 0), 5: (2, 2)}
    lists = spark.createDataFrame([("a", ["red car", "blue sky"], ["car red", "green tree", "red car"]), ("b", [], []), ("c", None, ["x"])], "k string, gold array<string>, predicted array<string>")
    got = {r.k: r for r in greedy.extraction_metrics(lists, "k").collect()}
    assert got["a"].matches == 1 and got["b"].f1 == 1.0 and got["c"].f1 == 0.0  # equal token sets pass whatever their order


def test_reconcile_and_actions(spark):
    kind = "meeting_id string, idx int, speaker string, text string, start_s double, end_s double"
    parsed = spark.createDataFrame([("m", 0, None, "we ship on monday", None, None), ("m", 1, "B", "nothing alike", None, None)], kind)
    audio = spark.createDataFrame([("m", 0, "X", "unrelated words entirely", 0.0, 1.0), ("m", 1, "Y", "we ship on mondays", 2.0, 3.0), ("m", 2, "Z", "we ship on monday", 4.0, 5.0)], kind)
    assert rows(greedy.fuzzy_reconcile(parsed, audio)) == [("m", 0, "Z", "we ship on monday", 4.0, 5.0), ("m", 1, "B", "nothing alike", None, None)]
    acts = spark.createDataFrame(
        [("m", 0, "Send the signed form", None, None, "suggested", ["s1"]), ("m", 1, "Send the signed form to the office", "Ana", None, "confirmed", ["s2"]), ("m", 2, "Order paper", None, "Friday", "suggested", ["s2"]), ("m", 3, "Paint wall", None, None, "suggested", None)],
        "meeting_id string, idx int, task string, owner string, deadline string, commitment_status string, ids array<string>",
    )
    got = greedy.deduplicate_actions(acts).orderBy("idx").collect()
    assert [(r.task, r.owner, r.deadline, r.commitment_status, r.ids) for r in got] == [("Send the signed form to the office", "Ana", "Friday", "confirmed", ["s1", "s2"]), ("Paint wall", None, None, "suggested", [])]


def test_digest(spark):
    texts = ["Can you hear me?", "Some early chat about nothing in particular here", "Today we are talking about the delivery plan."] + [f"Background discussion item number {w} about layout" for w in "alpha beta gamma delta epsilon zeta eta theta".split()] + ["We agreed to go with supplier nine."]
    df = spark.createDataFrame([("m", i, f"seg-{i + 1:04d}", "A", t, float(i), i + 1.0) for i, t in enumerate(texts)], "meeting_id string, idx int, seg_id string, speaker string, text string, start_s double, end_s double")
    got = digest.digests(df, windows=1).first()
    assert "seg-0003" in got.ids and "seg-0012" in got.ids and "seg-0001" not in got.ids and "seg-0002" not in got.ids
    small = digest.digests(df, budget=1000, windows=3).collect()
    assert all(len(r.text) <= 1000 for r in small) and 1 <= len(small) <= 3
    alike = spark.createDataFrame([("m", i, f"seg-{i + 1:04d}", "A", f"Background discussion item about {w} layout", float(i), i + 1.0) for i, w in enumerate(["the new", "the new and shiny", "an old"])], df.schema)
    kept = digest.digests(alike, windows=1).first()
    assert "seg-0002" in kept.ids and "seg-0001" not in kept.ids  # of near copies the wordier stays
    assert digest.digests(df.limit(0)).count() == 0


def test_claims(spark):
    output = {"topics": ["Plan", {"topic": " plan ", "confidence": "2"}, {"x": 1}, ""], "action_items": {"task": "Send it", "owner": "Unknown", "deadline": "Friday", "evidence_segment_ids": ["s1", " "]}, "decisions": None, "unclear_points": "who pays"}
    df = spark.createDataFrame([("m", 0, json.dumps(output)), ("m", 1, json.dumps({"topics": "PLAN"})), ("n", 0, "{broken"), ("o", 0, None)], "meeting_id string, window int, output string")
    got = claims.ingest(df)
    assert rows(got.where("window = 0"), "field", "text", "owner", "deadline", "confidence") == sorted(
        [("action_items", "Send it", None, "Friday", 0.7), ("missing_information", "who pays", None, None, 0.6), ("topics", "Plan", None, None, 0.6), ("topics", "plan", None, None, 1.0)], key=repr
    )
    merged = claims.merge_windows(got)
    assert rows(merged.where("field = 'topics'"), "text", "rank") == [("Plan", 1)]
    report = claims.sections(merged, spark.createDataFrame([("m", "All fine."), ("z", None)], "meeting_id string, summary string"))
    shown = dict(rows(report))
    assert "## Topics\n\n- Plan\n" in shown["m"] and "- Send it (deadline: Friday)\n  - Evidence: s1" in shown["m"] and "No reliable summary" in shown["z"]


def test_retrieval_budget(spark):
    segs = spark.createDataFrame([("m", i, f"seg-{i + 1:04d}", "A", t, float(i), "r" * 50) for i, t in enumerate(["alpha", "beta plan", "plan", "gamma", "delta plan beta"])], "meeting_id string, idx int, seg_id string, speaker string, text string, start_s double, rendered string")
    asked = spark.createDataFrame([("q", "m", "beta plan"), ("r", "m", "nothing here")], "question_id string, meeting_id string, question string")
    got = {r.question_id: r for r in retrieval.retrieve(retrieval.score_turns(asked, segs), segs, budget=160).collect()}
    assert got["q"].best_score == 1.0 and got["q"].status == "supported" and got["q"].selected == ["seg-0001", "seg-0002", "seg-0003"] and got["r"].status == "low_confidence"


def test_caching(spark):
    work = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, text string").withColumn("cache_key", caching.stage_key("s", F.col("text"), {"v": "1"}))
    cache = work.where("text = 'a'").select("cache_key", F.lit("A").alias("payload"))
    seen = []

    def compute(missing):
        seen.append(missing.count())
        return missing.select("cache_key", F.upper("text").alias("payload"))

    assert rows(caching.cached_stage(work, cache, compute), "id", "payload") == [(1, "A"), (2, "B"), (3, "B")] and seen == [1]
    assert rows(caching.cache_stats(work, cache)) == [(3, 1, 2)]
    assert caching.cached_stage(work, cache.limit(0), compute).count() == 3


def test_corpora(spark):
    q = spark.createDataFrame([("a", "m", [["3", "9"], ["2", "3"]]), ("b", "m", []), ("c", "m", None), ("d", "m", [["7", "9"]])], "example_id string, meeting_id string, relevant_text_span array<array<string>>")
    t = spark.createDataFrame([("m", i) for i in range(5)], "meeting_id string, idx int")
    got = [(r.example_id, r.idx) for r in corpora.span_turns(q, t).orderBy("example_id", "range_no", "idx").collect()]
    assert got == [("a", 3), ("a", 4), ("a", 2), *[("b", i) for i in range(5)], *[("c", i) for i in range(5)]]
    late = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), ("k", 2, "z")], "k string, at int, v string")
    assert corpora.latest(late, "k", "at").count() == 1 and corpora.latest(late, "k", "at").first().at == 2
    assert rows(dedup.keep_first(late, ["k"], F.lower("v"), "at"), "v") == [("x",), ("y",), ("z",)]


def test_span_turns_in_blocks(spark):
    """Selected turns aren't sent around one by one; ranges over several blocks, gaps and repeated rows against plain Python."""
    n = 2 * corpora.BLOCK + 500
    held = {"m": [i for i in range(n) if i % 3], "k": [5, corpora.BLOCK, corpora.BLOCK + 1]}
    given = [("a", "m", [["1000", "1100"], ["0", "2100"], ["2000", "99999"]]), ("b", "m", None), ("c", "k", []), ("d", "k", [["6", "1023"], ["1024", "1024"]]), ("e", "m", [["9", "2"], ["-4", "7"]]), ("f", "none", None), ("c", "k", [["5", "5"]])]
    q = spark.createDataFrame(given, "example_id string, meeting_id string, relevant_text_span array<array<string>>")
    t = spark.createDataFrame([(m, i) for m, ids in held.items() for i in ids], "meeting_id string, idx int")
    want = {}
    for name, m, pairs in given:
        for no, (low, high) in enumerate([(int(a), int(b)) for a, b in pairs or [("0", str(n))]]):
            for i in held.get(m, []):
                if low <= i <= high:
                    want[name, i] = min(no, want.get((name, i), no))
    got = corpora.span_turns(q, t)
    assert sorted((r.example_id, r.range_no, r.idx) for r in got.collect()) == sorted((e, no, i) for (e, i), no in want.items())
    import re

    assert not re.search(r"hashpartitioning\([^)]*\bidx#", got._jdf.queryExecution().executedPlan().toString())


def test_corpus_files(spark, tmp_path):
    ns = 'xmlns:nite="http://nite.sourceforge.net/"'
    (tmp_path / "w.xml").write_text(
        f'<r {ns}><w nite:id="w0" starttime="0" endtime="1">Well</w><w nite:id="w1" punc="true" starttime="1" endtime="1">,</w><vocalsound nite:id="w2"/><w>lost</w>'
        '<w nite:id="w3" starttime="20" endtime="21">fine</w><w nite:id="w4" starttime="40" endtime="41">(</w><w nite:id="w5" starttime="41" endtime="42">late</w></r>'.replace("nite:id", "nite:id")
    )
    (tmp_path / "s.xml").write_text(
        f'<r {ns}><segment nite:id="s0" transcriber_start="0.5" transcriber_end="21"><nite:child href="w.xml#id(w3)..id(w0)"/></segment>'
        '<segment nite:id="s1"><nite:child href="w.xml#id(w2)"/></segment><segment nite:id="s2"><nite:child href="w.xml#id(w0)..id(w5)"/></segment><segment nite:id="s3"><nite:child href="w.xml#id(zz)"/></segment></r>'
    )
    words = nxt.read_words(nxt.whole_files(spark, str(tmp_path / "w.xml"))).withColumn("speaker_key", F.lit("m.A"))
    refs = nxt.read_segment_refs(nxt.whole_files(spark, str(tmp_path / "s.xml"))).withColumn("speaker_key", F.lit("m.A"))
    assert words.count() == 6
    got = {r.segment_id: (r.start_s, r.end_s, r.text) for r in nxt.utterances(nxt.tokens_in_ranges(refs, words)).collect()}
    assert got == {"s0": (0.5, 21.0, "Well, fine"), "s2.part1": (0.0, 21.0, "Well, fine"), "s2.part2": (40.0, 42.0, "(late")}
    (tmp_path / "m.xml").write_text('<r><meeting observation="ES2000a" duration="9" seen_type="development"><speaker nxt_agent="A" role="PM" global_name="F1"/></meeting><meeting observation="XX1"/></r>')
    assert rows(nxt.read_meetings(nxt.whole_files(spark, str(tmp_path / "m.xml")))) == [("ES2000a", "validation", 9.0, "A", "PM", "F1")]
    (tmp_path / "a.xml").write_text("<r><abstract><sentence> One  two </sentence><sentence/></abstract><actions/></r>")
    assert rows(nxt.read_sections(nxt.whole_files(spark, str(tmp_path / "a.xml"))), "section", "pos", "sentence") == [("abstract", 0, "One two")]
    segs = spark.createDataFrame([("m", "A", " ", 1.0, 2.0), ("m", None, None, 3.0, 0.0)], "meeting_id string, agent string, speaker_id string, start double, duration double")
    corpora.rttm_lines(segs).write.text(str(tmp_path / "rttm"))
    assert rows(nxt.read_rttm(spark, str(tmp_path / "rttm"))) == [("m", 1.0, 2.0, "A")]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert rows(nxt.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int")) == [(1,), (2,)]


def test_streaming(spark, tmp_path):
    spark.sql("SELECT 'm' AS meeting_id, timestamp'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts, 'We agreed on the risk.' AS text FROM range(10)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("meeting_id string, ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = live.live_cue_counts(stream).writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.decision) for r in spark.table("live").orderBy("window_start").collect()] == [(5, 5), (5, 5)]


def test_entry_and_queries(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    for name in ("cue_action_status", "join_assign_speakers", "win_chunks"):
        assert e.queries()[name](spark, data).count() > 0


def test_core_does_not_import_llm():
    import ast
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "meetspark"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            names = [n for x in ast.walk(ast.parse(p.read_text())) for n in ([a.name for a in x.names] if isinstance(x, ast.Import) else [x.module or ""] if isinstance(x, ast.ImportFrom) else [])]
            assert not any("meetspark.llm" in n for n in names), p


def test_fuzzy_reconcile_whole_meetings(spark, data):
    import random

    import __spark_entry__
    from meetspark.functions.similarity import evidence_ratio
    from meetspark.plans.synth import segments

    rng = random.Random(2)
    words = ["we", "ship", "on", "Monday", "and", "Friday", "the", "plan", "it's", "done", ""]
    sides: tuple[list, list] = ([], [])
    want = []
    for m in range(60):
        left, right = ([" ".join(rng.choice(words) for _ in range(rng.randrange(0, 7))) for _ in range(rng.randrange(0, 9))] for _ in range(2))
        right += [None, *left[:2]]
        for side, texts in zip(sides, (left, right)):
            side += [(m, i, t) for i, t in enumerate(texts)]
        free = set(range(len(right)))
        for i, t in enumerate(left):  # the best of all that are free, the later of equals
            scored = [(evidence_ratio(t, right[k]), k) for k in free]
            if scored and max(scored)[0] >= 0.72:
                want.append((m, i, max(scored)[1]))
                free.discard(max(scored)[1])
    a, b = (spark.createDataFrame(side, "meeting_id int, idx int, text string") for side in sides)
    assert rows(greedy.greedy_matches(greedy.similar_pairs(a, b, 0.72), ["meeting_id"])) == sorted(want, key=repr) and len(want) > 30
    found = __spark_entry__.queries()["join_fuzzy_reconcile"](spark, data)
    assert rows(found, "meeting_id", "idx") == rows(segments(spark, data), "meeting_id", "idx")
