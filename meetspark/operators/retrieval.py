"""Hybrid lexical and dense retrieval of turns (top-k with neighbours within a budget)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from meetspark.functions.text import dot, lexical_score

#: Fixed values.
DENSE_WEIGHT, MIN_SCORE, MAX_CHARACTERS, TOP, EXPANDED = 0.65, 0.18, 6000, 10, 4


def score_turns(questions: DataFrame, segments: DataFrame, dense_weight: float = DENSE_WEIGHT) -> DataFrame:
    """Score of every turn of a question's meeting, rounded to six places.

    ``questions``: question_id, meeting_id, question and maybe vector; ``segments``
    may have embedding. Without either vector the score is lexical.
    """
    joined = questions.join(segments, "meeting_id")
    lexical = lexical_score(F.col("question"), F.col("text"))
    if "vector" in questions.columns and "embedding" in segments.columns:
        dense = F.greatest(F.lit(0.0), dot(F.col("vector"), F.col("embedding")))
        usable = F.col("vector").isNotNull() & F.col("embedding").isNotNull()
        total = F.when(usable, dense_weight * dense + (1 - dense_weight) * lexical).otherwise(lexical)
        mode = F.when(usable, "hybrid").otherwise("lexical_fallback")
    else:
        total, mode = lexical, F.lit("lexical_fallback")
    return joined.select("question_id", "meeting_id", "idx", "seg_id", "speaker", "text", "start_s", F.round(total, 6).alias("score"), mode.alias("mode"))


def top_turns(scored: DataFrame, k: int = TOP) -> DataFrame:
    """The k best turns of each question, by score and then position, with their rank."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "idx")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def retrieve(scored: DataFrame, segments: DataFrame, rendered: str = "rendered", budget: int = MAX_CHARACTERS) -> DataFrame:
    """(question_id, best_score, status, selected): ids of the best turns and their neighbours within ``budget`` characters.

    The four best turns are visited in order, each with the turn before and
    behind it; a turn that no longer fits is passed over, the first one always
    fits. ``segments`` has the column ``rendered``. The walk sees 12 turns at
    most per question, so it is a fold over a short array.
    """
    best = top_turns(scored, EXPANDED)
    near = best.select("question_id", "meeting_id", "rank", "score", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("step"), "idx")
    near = near.withColumn("idx", F.col("idx") + F.col("step")).join(segments.select("meeting_id", "idx", "seg_id", F.length(rendered).alias("size")), ["meeting_id", "idx"])
    first = near.groupBy("question_id", "idx", "seg_id", "size").agg(F.min(F.struct("rank", "step")).alias("at"))
    walk = F.array_sort(F.collect_list(F.struct(F.col("at.rank").alias("rank"), F.col("at.step").alias("step"), "idx", "seg_id", "size")))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<idx:int,seg_id:string>>").alias("kept"))

    def step(state, turn):
        fits = (F.size(state["kept"]) == 0) | (state["used"] + turn["size"] + 1 <= budget)
        entry = F.struct(turn["idx"].cast("int").alias("idx"), turn["seg_id"].alias("seg_id"))
        return F.when(fits, F.struct((state["used"] + turn["size"] + 1).alias("used"), F.array_append(state["kept"], entry).alias("kept"))).otherwise(state)

    chosen = first.groupBy("question_id").agg(F.aggregate(walk, start, step).alias("state"))
    score = best.where("rank = 1").select("question_id", F.col("score").alias("best_score"))
    ids = F.transform(F.array_sort("state.kept"), lambda x: x["seg_id"])
    status = F.when(F.col("best_score") >= MIN_SCORE, "supported").otherwise("low_confidence")
    return score.join(chosen, "question_id").select("question_id", "best_score", status.alias("status"), ids.alias("selected"))
