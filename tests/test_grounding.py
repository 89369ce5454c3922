from __future__ import annotations

import json

from conftest import rows
from pyspark.sql import functions as F

from meetspark.functions import jsontext
from meetspark.operators import grounding as G

SEG = "meeting_id string, idx int, seg_id string, speaker string, text string, start_s double, end_s double"
CLAIM = "claim_id int, meeting_id string, field string, text string, evidence string, ids array<string>"


def segments(spark):
    texts = ["We agreed to go with supplier nine for the launch.", "I will prepare the summary of order four.", "The customs delay is a risk for order four.", "Background chat about weather", "Which carrier should we use?", "Remote control layout and packing plan"]
    return spark.createDataFrame([("m", i, f"seg-{i + 1:04d}", "SPEAKER_01", t, i * 8.0, i * 8.0 + 4) for i, t in enumerate(texts)], SEG)


def test_support(spark):
    df = spark.createDataFrame([("go with supplier nine", "We agreed to go with supplier nine."), ("uses GPU cards", "uses cards"), ("uses GPU cards", "uses the gpu cards"), ("", "x"), ("weather", "nothing")], "a string, b string")
    got = [r.x for r in df.select(G.support_score(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and got[2] == 1.0 and got[3:] == [0.0, 0.0]


def test_link(spark):
    claims = spark.createDataFrame(
        [
            (1, "m", "decisions", "Go with supplier nine", "", ["seg-0001", "seg-0001"]), (2, "m", "decisions", "Prepare the summary", "", ["seg-0002"]), (3, "m", "risks", "Customs delay", "", ["seg-0003", "zz"]),
            (4, "m", "topics", "Remote control layout", None, ["seg-0001"]), (5, "m", "open_questions", "Which carrier", "", None), (6, "m", "action_items", "Prepare the summary of order four", "", ["seg-0002"]), (7, "m", "risks", "Elephants dance", "", ["seg-0003"]),
        ],
        CLAIM,
    )
    got = {r.claim_id: r for r in G.link_claims(claims, segments(spark)).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "linked", 2: "rejected", 3: "linked", 4: "linked", 5: "unlinked", 6: "linked", 7: "rejected"}
    assert got[1].ids == ["seg-0001"] and got[4].repaired and "seg-0006" in got[4].ids and got[7].ids == [] and got[6].commitment == "confirmed" and (got[1].start_s, got[1].end_s) == (0.0, 4.0)
    assert G.link_claims(claims.limit(0), segments(spark)).count() == 0


def test_owner(spark):
    df = spark.createDataFrame([("x", "Tomas, please review it.", ["A"]), ("x", "Priya will send it.", ["A"]), ("x", "I will send it.", ["A", "A"]), ("x", "I will send it.", ["A", "B"]), ("Bo", "bo said so", None), ("x", "We will see", None)], "owner string, e string, s array<string>")
    assert [r.o for r in df.select(G.action_owner(F.col("owner"), F.col("e"), F.col("s")).alias("o")).collect()] == ["Tomas", "Priya", "A", None, "Bo", None]


def test_summary(spark):
    df = spark.createDataFrame(
        [("m", 1, "topics", "delivery plan", None, None, 0.9, 1.0), ("m", 2, "decisions", "Go with nine.", None, None, 0.5, 2.0), ("m", 3, "action_items", "Send form", "Ana", "confirmed", 0.5, 3.0), ("m", 4, "action_items", "Maybe", None, "suggested", 0.5, 3.0),
         ("m", 5, "key_points", "the delivery plan", None, None, 0.9, 1.0), ("m", 6, "key_points", "Costs are falling fast", None, None, 0.8, 1.0), ("n", 7, "risks", "x", None, None, 0.1, None)],
        "meeting_id string, claim_id int, field string, text string, owner string, commitment string, score double, start_s double",
    )
    got = {r.meeting_id: r.summary for r in G.grounded_summary(df).collect()}
    assert got["m"] == "The meeting focused on delivery plan. Decisions: Go with nine. Follow-up work: Ana: Send form. Costs are falling fast."
    assert got["n"].startswith("No sufficiently grounded")
    assert len(G.grounded_summary(df, 5).where("meeting_id = 'm'").first().summary.split()) == 5


def test_json(spark):
    cases = {
        '{"topics": ["a"]}': {"topics": ["a"]}, '```json\n{"topics": []}\n```': {"topics": []}, 'Sure: {not valid} then {"x": "}"} ok': {"x": "}"}, "[1, 2]": None, "": None, None: None, "no json": None,
        '{"topics": ["a", "b"], "risks": ["c", "unfin': {"topics": ["a", "b"], "risks": ["c", "unfin"]}, '{"topics": ["a"], "risks": [{"text": "x", "ow': None, '{"other": ["a"': None,
    }
    for text, want in cases.items():
        got = jsontext.extract(text)
        if text and text.endswith('"ow'):
            assert json.loads(got)["topics"] == ["a"]
        else:
            assert (None if got is None else json.loads(got)) == want, text
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert df.select(jsontext.extract_json(F.col("t")).alias("j")).where("j IS NOT NULL").count() == 5


def test_every_segment_makes_a_claim(spark, data):
    import __spark_entry__
    from meetspark.plans.synth import segments

    queries, said = __spark_entry__.queries(), segments(spark, data)
    want = rows(said, "event_id")
    assert rows(queries["claims_link"](spark, data), "claim_id") == want
    cited = {r.claim_id for r in queries["claims_local_evidence"](spark, data).select("claim_id").collect()}
    assert {r.event_id for r in said.where("event_id % 4 = 0").collect()} <= cited  # they cite themselves
    best = {r.claim_id for r in queries["claims_best_window"](spark, data).select("claim_id").collect()}
    for field in (0, 1):  # topics and key points
        assert len(best & {r.event_id for r in said.where(f"idx % 7 = {field}").collect()}) > 0.9 * said.where(f"idx % 7 = {field}").count()
    ranked = queries["top_rank_claims"](spark, data).collect()
    assert {r.claim_id % 7 for r in ranked} == set(range(7))


def test_summary_walks_all_key_points(spark):
    given = [(k, "m", "key_points", "The crate folds flat.", 1.0) for k in range(1100)] + [(2000, "m", "key_points", "Sales doubled in Lyon.", 0.5)]
    nothing = F.lit(None).cast("string")
    df = spark.createDataFrame(given, "claim_id long, meeting_id string, field string, text string, score double")
    df = df.withColumns({"owner": nothing, "commitment": nothing, "start_s": nothing.cast("double")})
    assert rows(G.grounded_summary(df)) == [("m", "The crate folds flat. Sales doubled in Lyon.")]
