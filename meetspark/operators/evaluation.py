"""Scores of predictions against references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meetspark.functions.sequences import common_subsequence, word_edits

_TOKENS = r"([a-z0-9]+)"


def metric_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKENS), F.lit(1))


def token_f1(pairs: DataFrame, key: str) -> DataFrame:
    """(key, f1): multiset overlap of (key, reference, prediction); two empty texts score 1, one 0."""
    given = pairs.select(key, metric_tokens(F.col("reference")).alias("a"), metric_tokens(F.col("prediction")).alias("b"))
    count = lambda name: given.select(key, F.explode(name).alias("token")).groupBy(key, "token").agg(F.count("*").alias(f"n_{name}"))
    shared = count("a").join(count("b"), [key, "token"]).groupBy(key).agg(F.sum(F.least("n_a", "n_b")).alias("hits"))
    rows = given.join(shared, key, "left").na.fill(0, ["hits"])
    score = (
        F.when((F.size("a") == 0) | (F.size("b") == 0), (F.size("a") == F.size("b")).cast("double"))
        .when(F.col("hits") == 0, F.lit(0.0))
        .otherwise(2.0 * F.col("hits") / (F.size("a") + F.size("b")))
    )
    return rows.select(key, score.alias("f1"))


def rouge_l(pairs: DataFrame, key: str) -> DataFrame:
    """(key, rouge_l): F1 of the longest common subsequence of tokens."""
    given = pairs.select(key, metric_tokens(F.col("reference")).alias("a"), metric_tokens(F.col("prediction")).alias("b"))
    empty = (F.size("a") == 0) | (F.size("b") == 0)
    common = common_subsequence(F.col("a"), F.col("b"))
    return given.select(key, F.when(empty, (F.size("a") == F.size("b")).cast("double")).otherwise(2.0 * common / (F.size("a") + F.size("b"))).alias("rouge_l"))


def word_error_rate(pairs: DataFrame, key: str) -> DataFrame:
    """(key, errors, words): edit distance over words between reference and prediction."""
    given = pairs.select(key, metric_tokens(F.col("reference")).alias("a"), metric_tokens(F.col("prediction")).alias("b"))
    return given.select(key, word_edits(F.col("a"), F.col("b")).alias("errors"), F.size("a").alias("words"))


def macro_average(scores: DataFrame, category: str, columns: list[str]) -> DataFrame:
    """Mean of each column per category; nulls count as 0."""
    return scores.groupBy(category).agg(*[F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in columns], F.count("*").alias("n"))


def gold_without_prediction(gold: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """The keys of gold rows that have no prediction."""
    return gold.select(key).distinct().join(predictions.select(key), key, "left_anti")


def promotion(scores: DataFrame, checks: DataFrame, base: str, adapted: str) -> DataFrame:
    """One row: mean scores of two models, and whether the adapted one is better in both and passes every check.

    ``scores``: model, f1, rouge_l; ``checks``: model, passed. Without any check none is failed.
    """
    means = {m: [F.avg(F.when(F.col("model") == m, F.coalesce(c, F.lit(0.0)))).alias(f"{k}_{c}") for c in ("f1", "rouge_l")] for k, m in (("base", base), ("adapted", adapted))}
    row = scores.agg(*means[base], *means[adapted])
    passed = checks.where(F.col("model") == adapted).agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("checks_passed"))
    joined = row.withColumn("k", F.lit(1)).join(F.broadcast(passed.withColumn("k", F.lit(1))), "k").drop("k")  # one row each
    better_f1, better_rouge = F.col("adapted_f1") > F.col("base_f1"), F.col("adapted_rouge_l") > F.col("base_rouge_l")
    return joined.withColumns({"improved_f1": better_f1, "improved_rouge_l": better_rouge, "promoted": better_f1 & better_rouge & F.col("checks_passed")})


def diarization_error(reference: DataFrame, found: DataFrame) -> DataFrame:
    """(meeting_id, total_s, missed_s, false_s, confused_s, rate) of speaker turns, overlaps kept and no collar.

    Both sides: meeting_id, s, e, speaker. Between two neighbouring bounds of a
    meeting nobody begins or ends, so speakers there are counted once; who stands
    for whom is chosen so that most time agrees. Speakers of a side are few; the
    choice runs over the table of shared times of one meeting.
    """
    sides = reference.where("s < e").select("meeting_id", "s", "e", F.col("speaker").alias("r"), F.lit(None).cast("string").alias("h")).unionByName(
        found.where("s < e").select("meeting_id", "s", "e", F.lit(None).cast("string").alias("r"), F.col("speaker").alias("h"))
    )
    along = Window.partitionBy("meeting_id").orderBy("a")
    bounds = sides.select("meeting_id", F.explode(F.array("s", "e")).alias("a")).distinct().withColumn("b", F.lead("a").over(along)).where("b IS NOT NULL")
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / 60), F.floor(b / 60)))
    met = bounds.withColumn("cell", F.floor(F.col("a") / 60)).join(sides.withColumn("cell", cells(F.col("s"), F.col("e"))), ["meeting_id", "cell"]).where("s <= a AND a < e")
    pieces = met.groupBy("meeting_id", "a", "b").agg(F.collect_set("r").alias("rs"), F.collect_set("h").alias("hs")).withColumn("d", F.col("b") - F.col("a"))
    n, m = F.size("rs"), F.size("hs")
    sums = pieces.groupBy("meeting_id").agg(
        F.sum(F.col("d") * n).alias("total_s"), F.sum(F.col("d") * F.greatest(n - m, F.lit(0))).alias("missed_s"), F.sum(F.col("d") * F.greatest(m - n, F.lit(0))).alias("false_s"), F.sum(F.col("d") * F.least(n, m)).alias("both_s")
    )
    shared = pieces.select("meeting_id", "d", F.explode("rs").alias("r"), "hs").select("meeting_id", "d", "r", F.explode("hs").alias("h")).groupBy("meeting_id", "r", "h").agg(F.sum("d").alias("d"))
    tables = shared.groupBy("meeting_id").agg(F.collect_list(F.struct("r", "h", "d")).alias("t"))
    agreed = sums.join(tables, "meeting_id", "left").withColumn("agreed", F.coalesce(F.pandas_udf(lambda t: t.map(most_agreed), "double")("t"), F.lit(0.0)))
    confused = F.greatest(F.col("both_s") - F.col("agreed"), F.lit(0.0))
    rate = F.when(F.col("total_s") > 0, (F.col("missed_s") + F.col("false_s") + confused) / F.col("total_s"))
    return agreed.select("meeting_id", "total_s", "missed_s", "false_s", confused.alias("confused_s"), rate.alias("rate"))


def most_agreed(rows: list | None) -> float:
    """The most time on which a one-to-one choice of speakers can agree: shortest augmenting paths over the shared times."""
    rows = list(rows) if rows is not None else []
    names = [sorted({r[k] for r in rows}) for k in ("r", "h")]
    if not rows:
        return 0.0
    size = max(map(len, names))
    cost = [[0.0] * size for _ in range(size)]
    for r in rows:
        cost[names[0].index(r["r"])][names[1].index(r["h"])] -= r["d"]
    above, left, holder = [0.0] * (size + 1), [0.0] * (size + 1), [size] * (size + 1)
    for row in range(size):
        least, back, done, at = [float("inf")] * size, [size] * size, [False] * (size + 1), size
        holder[size] = row
        while holder[at] != size:
            done[at], mine, step, goal = True, holder[at], float("inf"), size
            for j in range(size):
                if not done[j]:
                    gap = cost[mine][j] - above[mine] - left[j]
                    if gap < least[j]:
                        least[j], back[j] = gap, at
                    if least[j] < step:
                        step, goal = least[j], j
            for j in range(size + 1):
                if done[j]:
                    above[holder[j]] += step
                    left[j] -= step
                elif j < size:
                    least[j] -= step
            at = goal
        while at != size:
            before = back[at]
            holder[at], at = holder[before], before
    return -sum(cost[holder[j]][j] for j in range(size) if holder[j] != size)
