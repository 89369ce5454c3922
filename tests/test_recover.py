from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from meetspark.operators import recover as R


def test_tasks(spark):
    said = {
        "I will prepare the summary of order four.": "Prepare the summary of order four.", "They asked me to schedule visit nine": "Schedule visit nine", "You might want to double-check figure two, and": "Double-check figure two,",
        "I do not think we can send report 3 today.": "", "What I did was review the report.": "", "Should it be red?": "", "Okay": "", "": "", "well, send the signed form to the office": "Send the signed form to the office",
    }
    df = spark.createDataFrame([(k,) for k in said] + [(None,)], "t string")
    got = {r.t: r.x for r in df.select("t", R.clean_action_task(F.col("t")).alias("x")).collect()}
    assert got.pop(None) == ""
    assert {k: v.rstrip(",") for k, v in got.items()} == {k: v.rstrip(",") for k, v in said.items()}


def test_topics_and_introductions(spark):
    seg = "meeting_id string, idx int, seg_id string, speaker string, text string"
    texts = [("A", "Welcome to the kick-off meeting."), ("A", "Today we are talking about the delivery plan."), ("B", "I am going to present a little talk at Lyon about it."), ("B", "Hi, I am Nadia, and I am the project manager."), ("B", "my name is Oskar, marketing expert"), ("C", "I am the industrial designer"), ("C", None)]
    df = spark.createDataFrame([("m", i, f"s{i}", s, t) for i, (s, t) in enumerate(texts)] + [("n", 0, "s0", "A", "We are designing a Folding Crate today.")], seg)
    got = R.structural_topics(df)
    assert rows(got, "meeting_id", "text", "idx") == [("m", "Lyon presentation", 2), ("m", "delivery plan", 1), ("n", "Folding crate today design", 0)]
    assert rows(R.new_topics(got, spark.createDataFrame([("m", "the delivery plan")], "meeting_id string, text string")), "text") == [("Folding crate today design",), ("Lyon presentation",)]
    assert rows(R.introductions(df)) == [("m", "B", "Oskar", "Marketing Expert", "s4")]
    assert R.introductions(df.limit(0)).count() == 0
