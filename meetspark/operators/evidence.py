"""Evidence statistics over a meeting's segments: counts, centrality, windows, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meetspark.functions.text import GENERIC, clean_text, content_tokens, tokens


def text_counts(segments: DataFrame) -> DataFrame:
    """Each segment with the number of segments of its meeting with the same clean lower-case text."""
    key = F.lower(clean_text(F.col("text")))
    return segments.withColumn("n_same", F.count("*").over(Window.partitionBy("meeting_id", key)))


def first_cue(segments: DataFrame, cue: Column, out: str) -> DataFrame:
    """Add the smallest idx at which ``cue`` holds in the meeting; null if it never does."""
    return segments.withColumn(out, F.min(F.when(cue, F.col("idx"))).over(Window.partitionBy("meeting_id")))


def term_frequencies(segments: DataFrame) -> DataFrame:
    """(meeting_id, term, df): in how many segments of the meeting a content token stands."""
    return segments.select("meeting_id", F.explode(content_tokens(F.col("text"))).alias("term")).groupBy("meeting_id", "term").agg(F.count("*").alias("df"))


def centrality(segments: DataFrame) -> DataFrame:
    """(meeting_id, idx, centrality): sum of log(1 + df) over the root of the number of content tokens.

    Terms are added in alphabetical order, so the sum doesn't depend on chance.
    """
    long = segments.select("meeting_id", "idx", F.explode(content_tokens(F.col("text"))).alias("term"))
    weighed = long.join(term_frequencies(segments), ["meeting_id", "term"])
    rows = F.array_sort(F.collect_list(F.struct("term", F.log1p("df").alias("w"))))
    total = F.aggregate(rows, F.lit(0.0), lambda s, x: s + x["w"])
    return weighed.groupBy("meeting_id", "idx").agg((total / F.sqrt(F.count("*"))).alias("centrality"))


def buckets(segments: DataFrame, n: int = 6) -> DataFrame:
    """Add size, part and bucket: the two ways of cutting a meeting into ``n`` runs of turns.

    part b holds idx from b * size // n on; bucket is idx * n // size. Meetings
    shorter than ``n`` have as many parts as turns.
    """
    size = F.count("*").over(Window.partitionBy("meeting_id"))
    rows = segments.withColumn("size", size).withColumn("n", F.least(F.lit(n), F.col("size")))
    part = F.floor(((F.col("idx") + 1) * F.col("n") - 1) / F.col("size"))
    bucket = F.least(F.col("n") - 1, F.floor(F.col("idx") * F.col("n") / F.col("size")))
    return rows.withColumn("part", part).withColumn("bucket", bucket).drop("n")


def context(segments: DataFrame, before: int, behind: int, out: str) -> DataFrame:
    """Add the clean texts from ``before`` turns earlier to ``behind`` turns later, joined by spaces."""
    w = Window.partitionBy("meeting_id").orderBy("idx").rowsBetween(-before, behind)
    return segments.withColumn(out, F.array_join(F.collect_list(clean_text(F.col("text"))).over(w), " "))


def next_cue(segments: DataFrame, cue: Column, reach: int | None, out: str) -> DataFrame:
    """Add the idx of the next turn, at most ``reach`` turns later, at which ``cue`` holds."""
    w = Window.partitionBy("meeting_id").orderBy("idx").rowsBetween(1, reach or Window.unboundedFollowing)
    return segments.withColumn(out, F.min(F.when(cue, F.col("idx"))).over(w))


def lookup(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """(claim_id, seg_id, idx, pos): the cited segments that exist, each once, in cited order."""
    cited = claims.select("claim_id", "meeting_id", F.posexplode("evidence_ids").alias("pos", "seg_id"))
    first = cited.groupBy("claim_id", "meeting_id", "seg_id").agg(F.min("pos").alias("pos"))
    return first.join(segments.select("meeting_id", "seg_id", "idx", "start_s", "end_s"), ["meeting_id", "seg_id"])


def time_bounds(cited: DataFrame) -> DataFrame:
    """(claim_id, start_s, end_s, ids) of the cited segments; missing times are ignored."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "seg_id"))), lambda x: x["seg_id"])
    return cited.groupBy("claim_id").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), ids.alias("ids"))


def neighbours(cited: DataFrame, segments: DataFrame) -> DataFrame:
    """(claim_id, idx) of every segment at most one turn away from a cited one."""
    spread = cited.select("claim_id", "meeting_id", F.explode(F.sequence(F.col("idx") - 1, F.col("idx") + 1)).alias("idx")).distinct()
    return spread.join(segments.select("meeting_id", "idx"), ["meeting_id", "idx"]).select("claim_id", "idx")


def importance(claims: DataFrame, segments: DataFrame, purpose: Column) -> DataFrame:
    """(claim_id, matches, spread, cited, score) of (claim_id, meeting_id, text, evidence_ids, boost).

    A segment matches a claim if it shares one content token of a claim of at
    most two, two of a longer one, or half of its tokens. Only segments that
    share a token meet the claim at all, by an equi-join on meeting and token.
    Claims cited only before the meeting's purpose lose 0.75.
    """
    sized = buckets(segments)
    claim = claims.withColumn("tokens", content_tokens(F.col("text"))).withColumn("need", F.size("tokens"))
    long = claim.select("claim_id", "meeting_id", "need", F.explode("tokens").alias("term"))
    words = sized.select("meeting_id", "idx", "bucket", F.explode(content_tokens(F.col("text"))).alias("term"))
    # merged whatever size the planner expects, as it doesn't see how many words a text has
    shared = long.join(words.hint("merge"), ["meeting_id", "term"]).groupBy("claim_id", "need", "idx", "bucket").agg(F.count("*").alias("shared"))
    enough = (F.col("shared") >= F.when(F.col("need") <= 2, 1).otherwise(2)) | (F.col("shared") / F.col("need") >= 0.5)
    met = shared.where(enough).groupBy("claim_id").agg(F.count("*").alias("matches"), F.countDistinct("bucket").alias("spread"))
    first = segments.groupBy("meeting_id").agg(F.min(F.when(purpose, F.col("idx"))).alias("purpose_idx"))
    flagged = segments.withColumn("is_purpose", purpose).select("meeting_id", "seg_id", "is_purpose")
    cited = lookup(claims, segments).join(flagged, ["meeting_id", "seg_id"]).groupBy("claim_id").agg(
        F.count("*").alias("cited"), F.max("idx").alias("last"), F.max("is_purpose").alias("on_purpose")
    )
    rows = claim.join(met, "claim_id", "left").join(cited, "claim_id", "left").join(first, "meeting_id", "left").na.fill(0, ["matches", "spread", "cited"])
    generic = F.size(F.array_except("tokens", F.array(*map(F.lit, GENERIC)))) == 0
    early = F.coalesce(F.col("last") < F.col("purpose_idx"), F.lit(False))
    base = (
        0.18 + 0.45 * F.least(F.lit(1.0), F.col("matches") / 5) + 0.25 * F.least(F.lit(1.0), F.col("spread") / 3) + 0.15 * F.least(F.lit(1.0), F.col("cited") / 2)
        + F.coalesce("boost", F.lit(0.0)) - F.when(generic, 0.45).otherwise(0.0) + F.when(F.col("on_purpose"), 0.35).otherwise(0.0) - F.when(early, 0.75).otherwise(0.0)
    )
    score = F.when(F.col("need") == 0, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)), 3))
    return rows.select("claim_id", "meeting_id", "matches", "spread", "cited", score.alias("score"), (F.col("need") > 0).__and__(early).alias("early"))


def rank_claims(scored: DataFrame, least: float, limit: int) -> DataFrame:
    """The best ``limit`` claims of each meeting from score ``least`` on, early ones left out, by score and start."""
    order = Window.partitionBy("meeting_id").orderBy(F.desc("score"), F.col("start_s").asc_nulls_last(), "claim_id")
    kept = scored.where(~F.col("early") & (F.col("score") >= least))
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def word_numbers(text: Column) -> Column:
    return F.size(tokens(text))
