"""Building and auditing of meeting corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meetspark.functions.text import clean_text, meeting_domain

#: Neighbouring turns that span_turns keeps in one row. Any number gives the same result.
BLOCK = 1_024


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """One row per key: the one with the latest ``at``; of equals the one with the larger digest of its content."""
    names = [c for c in rows.columns if c != key]
    rank = F.struct(F.col(at), F.sha2(F.to_json(F.struct(*names)), 256))
    best = rows.groupBy(key).agg(F.max_by(F.struct(*names), rank).alias("__b"))
    return best.select(key, *[F.col(f"__b.{c}").alias(c) for c in names])


def span_turns(queries: DataFrame, turns: DataFrame) -> DataFrame:
    """(example_id, pos, idx) of the turns that a query's ranges select, in order of the ranges, each turn once.

    ``queries``: example_id, meeting_id, relevant_text_span (pairs of numbers as
    strings, both ends included). Ranges are clamped to the meeting; a query
    without ranges selects the whole meeting.
    """
    ends = turns.groupBy("meeting_id").agg(F.max("idx").alias("last"))
    given = queries.select("example_id", "meeting_id", "relevant_text_span").join(ends, "meeting_id")
    spans = F.when(F.size(F.coalesce("relevant_text_span", F.array())) > 0, F.col("relevant_text_span")).otherwise(F.array(F.array(F.lit("0"), F.col("last").cast("string"))))
    ranges = given.select("example_id", "meeting_id", "last", F.posexplode(spans).alias("range_no", "pair"))
    low = F.greatest(F.lit(0), F.get("pair", F.lit(0)).cast("int"))
    high = F.least(F.col("last"), F.get("pair", F.lit(1)).cast("int"))
    listed = ranges.withColumn("low", low).withColumn("high", high).where("low <= high")
    # ranges meet whole blocks of turns, so what they select is neither sent around nor sorted
    block = lambda c: F.floor(c / BLOCK).cast("int")
    whole = listed.groupBy("example_id", "meeting_id").agg(F.collect_list(F.struct("range_no", "low", "high")).alias("ranges"))
    blocks = F.array_distinct(F.flatten(F.transform("ranges", lambda r: F.sequence(block(r["low"]), block(r["high"])))))
    own = lambda r: (block(r["low"]) <= F.col("block")) & (block(r["high"]) >= F.col("block"))
    each = whole.select("example_id", "meeting_id", "ranges", F.explode(blocks).alias("block")).withColumn("ranges", F.filter("ranges", own))
    held = turns.where("idx >= 0").groupBy("meeting_id", block(F.col("idx")).alias("block")).agg(F.collect_set("idx").alias("held"))
    # merged whatever size the planner expects, as it doesn't see how many blocks a range has
    met = each.join(held.hint("merge"), ["meeting_id", "block"]).select("example_id", "ranges", F.explode("held").alias("idx"))
    within = F.filter("ranges", lambda r: (r["low"] <= F.col("idx")) & (r["high"] >= F.col("idx")))
    first = met.select("example_id", F.array_min(F.transform(within, lambda r: r["range_no"])).alias("range_no"), "idx")
    return first.where("range_no IS NOT NULL")


def split_overlaps(rows: DataFrame, key: str = "meeting_id", split: str = "split") -> DataFrame:
    """(split_a, split_b, n): how many keys two splits share."""
    held = rows.where(F.col(split).isNotNull() & F.col(key).isNotNull()).select(key, F.col(split).alias("split_a")).distinct()
    other = held.select(key, F.col("split_a").alias("split_b"))
    return held.join(other, key).where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("n"))


def audit(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, n_meetings) of each group."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("meeting_id").alias("n_meetings"))


def rttm_lines(segments: DataFrame) -> DataFrame:
    """(line): one RTTM line per segment of positive duration; the speaker falls back to agent and unknown."""
    name = lambda c: F.when(clean_text(F.col(c)) != "", clean_text(F.col(c)))
    who = F.coalesce(name("speaker_id"), name("agent"), F.lit("unknown"))
    kept = segments.where(F.col("start").isNotNull() & (F.col("duration") > 0) & ~F.isnan("start") & ~F.isnan("duration"))
    return kept.select(F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", "meeting_id", "start", "duration", who).alias("line"))


def with_domain(rows: DataFrame) -> DataFrame:
    return rows.withColumn("domain_by_id", meeting_domain(F.col("meeting_id")))


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``work`` whose key isn't in ``done``: what a resumed run still has to do."""
    return work.join(done.select(key), key, "left_anti")


def apply_reviews(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Items with the latest review: its text and status where there is one, else ``draft``.

    ``reviews``: item_id, status, text, seconds, at. Of reviews at the same time
    the larger status counts.
    """
    last = reviews.groupBy("item_id").agg(F.max(F.struct("at", "status", "text", "seconds")).alias("r"))
    joined = items.join(last, "item_id", "left")
    return joined.withColumn("review_status", F.coalesce("r.status", F.lit("draft"))).withColumn("shown_text", F.coalesce("r.text", F.col("text"))).withColumn("verification_seconds", F.when(F.col("r.status") == "confirmed", F.col("r.seconds"))).drop("r")


def first_of_split(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` rows of each split by the position ``order``: a subset by definition, as trainers ask for."""
    from pyspark.sql import Window

    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy("split").orderBy(order))).where(F.col("__rank") <= n).drop("__rank")


def chat_records(queries: DataFrame, system: str) -> DataFrame:
    """(example_id, split, messages): a question with its evidence as a conversation that ends with the answer."""
    asked = F.concat(F.lit("Evidence:\n"), F.coalesce("relevant_transcript", F.lit("")), F.lit("\n\nQuestion: "), F.coalesce("query", F.lit("")))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return queries.select("example_id", "split", F.array(message("system", F.lit(system)), message("user", asked), message("assistant", F.coalesce("answer", F.lit("")))).alias("messages"))


def audit_audio(segments: DataFrame) -> DataFrame:
    """(split, n_meetings, n_groups, n_segments, hours, n_unknown) of a speech corpus; hours count usable durations."""
    usable = F.when((F.col("duration") > 0) & ~F.isnan("duration"), F.col("duration")).otherwise(0.0)
    return segments.groupBy("split").agg(
        F.countDistinct("meeting_id").alias("n_meetings"), F.countDistinct("project_group").alias("n_groups"), F.count("*").alias("n_segments"),
        F.round(F.sum(usable) / 3600, 6).alias("hours"), F.count_if(clean_text(F.col("speaker_id")) == "").alias("n_unknown"),
    )
