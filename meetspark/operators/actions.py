"""Follow-ups and assignments that turns state outright, across neighbouring turns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from meetspark.functions import cues
from meetspark.functions.similarity import evidence_similarity
from meetspark.functions.text import clean_text, content_tokens, normalise_role, role_key, tokens
from meetspark.operators.greedy import deduplicate_actions, greedy_matches, similar_pairs
from meetspark.operators.recover import clean_action_task
from meetspark.runtime import only, settled

#: How long a speaker may pause within one action, and turns put together at most. Fixed values.
PAUSE_S, STITCHED = 15.0, 3
#: Words that leave a turn open. Fixed values.
DANGLING = r"\b(?:and|or|the|a|an|to|of|for|with|had)$"
#: From what ratio on a recovered task repeats a known one, and a name is another's. Fixed values.
SAME_TASK, SAME_NAME = 0.68, 0.72
#: Where assignments begin if nobody wraps up, as a share of the meeting; turns behind a role that belong to it. Fixed values.
LATE, FOLLOWING, TASK_WORDS = 0.65, 6, 18
#: How an assignment is worded. Fixed values.
ASSIGNED = (
    r"(?iU)\b(?:you(?:'re| are| will|'ll)|(?:he|she|they|we)(?:'ll| will)|is going to be)\s+(?:going to be\s+|be\s+)?(?:just\s+)?"
    r"((?:looking (?:more )?into|working on|thinking about|handling|preparing|reviewing|defining|developing|designing)\s+.+?)(?:[.?!]|$)"
)
#: What stands for an assignment without such words: a phrase, the role it counts for first, and the task. Fixed values.
SUBJECTS = [
    (r"(?iU)\buser requirements?\b", "marketing", "Determine the user requirements"), (r"(?iU)\btechnical functions?\b", "user interface", "Define the technical functions"),
    (r"(?iU)\bworking design\b", None, "Work on the working design"), (r"(?iU)\bphysical design\b", None, "Work on the physical design"),
]
#: How the first words of an assignment are put as a task, and what is cut off its end. Fixed values.
REWORDED = [(r"(?i)^looking (?:more )?into\b", "Work on"), (r"(?i)^working on\b", "Work on"), (r"(?i)^thinking about\b", "Determine")]
TASK_END = r"(?i),?\s+(?:so you know\b|and we(?:'ll| will) all\b|i guess\b).*$"
#: A list of names behind "that is". Fixed value.
ROLL_CALL = r"\bthat(?:'s| is)\s+([A-Z][A-Za-z'-]+(?:\s*,\s*[A-Z][A-Za-z'-]+)*(?:\s*,?\s+and\s+[A-Z][A-Za-z'-]+))"
ASSIGNED_FROM = 1 << 24
ACTION = ["meeting_id", "idx", "task", "owner", "deadline", "commitment_status", "ids"]


def _words(text: str) -> list[str]:
    return re.findall(r"[\w']+", text)


def _overlap(a: str, b: str) -> int:
    """The largest k up to 12 for which the last k words of a are the first k of b."""
    x, y = _words(a.lower()), _words(b.lower())
    return next((k for k in range(min(len(x), len(y), 12), 0, -1) if x[-k:] == y[:k]), 0)


def _joined(said: pd.Series, *behind: pd.Series) -> pd.DataFrame:
    """Each turn with those of the turns behind that go on with it, and how many these are."""
    out = []
    for first, *rest in zip(said, *behind):
        whole, taken = first, 0
        for other in rest:
            k = _overlap(whole, other) if isinstance(other, str) else 0
            if not isinstance(other, str) or not (k >= 2 or re.search(DANGLING, whole, re.IGNORECASE)):
                break
            whole = " ".join(_words(whole) + _words(other)[k:]) if k else f"{whole} {other}".strip()
            taken += 1
        out.append((whole, taken))
    return pd.DataFrame(out, columns=["whole", "taken"])


def stitched_turns(segments: DataFrame) -> DataFrame:
    """(meeting_id, idx, text, ids): turns with a task verb, together with the same speaker's turns that go on with them.

    One of the two turns behind goes on with a turn if it begins at most PAUSE_S
    after that turn's end and what is said so far ends with a dangling word or
    shares two words with its start. Turns that were taken up don't start an
    action of their own; only turns that take up others are folded for that.
    """
    along = Window.partitionBy("meeting_id").orderBy("idx")
    rows = segments.withColumn("said", clean_text(F.col("text"))).withColumn("who", clean_text(F.col("speaker")))
    for k in range(1, STITCHED):
        rows = rows.withColumn(f"n{k}", F.lead(F.struct("said", "who", "start_s", "seg_id"), k).over(along))
    end = F.coalesce(F.when(F.col("end_s") != 0, F.col("end_s")), F.col("start_s"))
    rows = rows.where((F.col("said") != "") & cues.has(F.col("said"), "task_verb"))
    follows = lambda k: F.coalesce((F.col(f"n{k}.who") == F.col("who")) & F.coalesce(F.col(f"n{k}.start_s") - end <= PAUSE_S, F.lit(True)), F.lit(False))
    joined = F.pandas_udf(_joined, "whole string, taken int")("said", F.when(follows(1), F.col("n1.said")), F.when(follows(2), F.col("n2.said")))
    rows = rows.withColumn("j", joined).withColumns({"whole": F.col("j.whole"), "taken": F.col("j.taken")})
    longer = rows.where("taken > 0").groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("idx", "taken"))).alias("runs"))

    def begin(kept: Column, r: Column) -> Column:
        last = F.element_at(kept, -1)
        return F.when((F.size(kept) > 0) & (r["idx"] <= last["idx"] + last["taken"]), kept).otherwise(F.array_append(kept, r))

    begun = longer.select("meeting_id", F.explode(F.aggregate("runs", F.filter("runs", lambda _: F.lit(False)), begin)).alias("r"))
    consumed = begun.select("meeting_id", F.explode(F.sequence(F.col("r.idx") + 1, F.col("r.idx") + F.col("r.taken"))).alias("idx"))
    ids = F.slice(F.array("seg_id", *[F.col(f"n{k}.seg_id") for k in range(1, STITCHED)]), F.lit(1), F.col("taken") + 1)
    return rows.join(consumed, ["meeting_id", "idx"], "left_anti").select("meeting_id", "idx", F.col("whole").alias("text"), ids.alias("ids"))


def explicit_actions(segments: DataFrame, actions: DataFrame) -> DataFrame:
    """The given actions with clean tasks and those that turns state and no action before repeats, deduplicated.

    ``actions``: meeting_id, idx, task, owner, deadline, commitment_status, ids;
    they come before all that is found. Columns as in deduplicate_actions, idx
    counts anew.
    """
    given = actions.select(*ACTION).withColumn("task", clean_action_task(F.col("task")))
    confirmed, suggested = cues.action_status(F.col("text"))
    given = only(given, "task <> ''").withColumn("found", F.lit(0))
    said = only(stitched_turns(segments).withColumns({"confirmed": confirmed, "suggested": suggested, "task": clean_action_task(F.col("text"))}), "(confirmed OR suggested) AND task <> ''")
    none = F.lit(None).cast("string")
    fresh = said.select("meeting_id", "idx", "task", none.alias("owner"), none.alias("deadline"), F.when(F.col("confirmed"), "confirmed").otherwise("suggested").alias("commitment_status"), "ids", F.lit(1).alias("found"))
    # read three times and costly to make
    every = settled(given.unionByName(fresh), "actions").withColumn("idx", (F.row_number().over(Window.partitionBy("meeting_id").orderBy("found", "idx")) - 1).cast("int"))
    plain = every.select("meeting_id", "idx", F.col("task").alias("text"))
    near = similar_pairs(plain, plain, SAME_TASK).where("left <> right").groupBy("meeting_id", F.col("left").alias("idx")).agg(F.collect_set("right").alias("near"))
    full = every.join(near, ["meeting_id", "idx"], "left").withColumns({"near": F.coalesce("near", F.array().cast("array<int>")), "ids": F.coalesce("ids", F.array().cast("array<string>"))})

    def add(kept: Column, r: Column) -> Column:
        known = F.exists(kept, lambda k: F.arrays_overlap(k["ids"], r["ids"]) | F.array_contains(r["near"], k["idx"]))
        return F.when((r["found"] == 1) & known, kept).otherwise(F.array_append(kept, F.struct(r["idx"].alias("idx"), r["ids"].alias("ids"))))

    rows = full.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("idx", "ids", "near", "found"))).alias("rows"))
    kept = rows.select("meeting_id", F.explode(F.aggregate("rows", F.array().cast("array<struct<idx:int,ids:array<string>>>"), add)).alias("k")).select("meeting_id", "k.idx")
    return deduplicate_actions(settled(full.join(kept, ["meeting_id", "idx"]).select(*ACTION), "actions"))


def role_assignments(segments: DataFrame) -> DataFrame:
    """(meeting_id, idx, place, role, task, ids): what is assigned to a role late in a meeting, in order.

    From the first wrap-up on (else from 65 % of the meeting on), each role named
    in a turn is given the rest of the turn up to the next role, and the turns
    behind, six at most and none that names a role itself.
    """
    text = clean_text(F.col("text"))
    rows = segments.withColumns({"said": text, "named": cues.has(text, "role"), "wraps": cues.has(text, "wrap_up")})
    starts = rows.groupBy("meeting_id").agg(F.coalesce(F.min(F.when(F.col("wraps"), F.col("idx"))), F.floor(F.count("*") * LATE)).alias("start"))
    behind = Window.partitionBy("meeting_id").orderBy("idx").rowsBetween(1, FOLLOWING)
    rows = rows.withColumn("next", F.collect_list(F.struct("named", "said", "seg_id")).over(behind)).join(starts, "meeting_id").where("named AND idx >= start")
    stop = F.array_position(F.transform("next", lambda x: x["named"]), F.lit(True))
    rows = rows.withColumn("next", F.when(stop > 0, F.slice("next", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("next")))
    parts = F.slice(F.split(F.regexp_replace("said", F.lit(cues.java("role")), F.lit("\x01$0")), "\x01"), 2, 100_000)
    each = rows.select("meeting_id", "idx", "seg_id", "next", F.posexplode(parts).alias("place", "part"))
    each = each.withColumn("role", normalise_role(F.regexp_extract("part", cues.java("role"), 1)))
    whole = clean_text(F.concat_ws(" ", F.col("part"), F.array_join("next.said", " ")))
    each = each.withColumn("whole", whole).withColumn("explicit", clean_text(F.regexp_extract("whole", ASSIGNED, 1)))
    task = F.col("explicit")
    for pattern, words in REWORDED:
        task = F.regexp_replace(task, pattern, words)
    chosen = F.lit(None).cast("string")
    for pattern, role, told in SUBJECTS:
        if role:
            chosen = F.coalesce(chosen, F.when((role_key(F.col("role")) == role) & F.regexp_like("whole", F.lit(pattern)), F.lit(told)))
    chosen = F.coalesce(chosen, F.nullif(task, F.lit("")))
    for pattern, _, told in SUBJECTS:
        chosen = F.coalesce(chosen, F.when(F.regexp_like("whole", F.lit(pattern)), F.lit(told)))
    short = F.regexp_replace(clean_text(F.regexp_replace(chosen, TASK_END, "")), r"[ ,;:-]+$", "")
    kept = each.withColumn("task", short).where((F.size(content_tokens(F.col("task"))) >= 2) & (F.size(tokens(F.col("task"))) <= TASK_WORDS))
    upper = F.concat(F.upper(F.substring("task", 1, 1)), F.substring(F.col("task"), F.lit(2), F.length("task")))
    said = F.filter("next", lambda x: x["said"] != "")
    ids = F.concat(F.array("seg_id"), F.transform(said, lambda x: x["seg_id"]))
    return kept.select("meeting_id", "idx", "place", "role", upper.alias("task"), ids.alias("ids"))


def with_assignments(actions: DataFrame, assigned: DataFrame) -> DataFrame:
    """Actions and, behind them, assignments as confirmed actions of their role, deduplicated.

    An assignment that matches an earlier action or assignment goes into it;
    those that stand for themselves are numbered from ASSIGNED_FROM on.
    """
    none = F.lit(None).cast("string")
    late = assigned.select("meeting_id", "idx", "task", F.col("role").alias("owner"), none.alias("deadline"), F.lit("confirmed").alias("commitment_status"), "ids", F.lit(1).alias("late"), "place")
    both = actions.select(*ACTION).withColumns({"late": F.lit(0), "place": F.lit(0)}).unionByName(late)
    order = Window.partitionBy("meeting_id").orderBy("late", "idx", "place")
    return deduplicate_actions(settled(both.withColumn("idx", (F.row_number().over(order) - 1 + F.col("late") * ASSIGNED_FROM).cast("int")).select(*ACTION), "actions"))


def roll_call(segments: DataFrame, people: DataFrame) -> DataFrame:
    """(meeting_id, speaker, name, called): introduced people under the name a roll call gives them, where there is one.

    ``people``: meeting_id, speaker, name. Names called and borne by nobody are
    given, one each and in order of the speakers, to the most similar other
    name, from a ratio of 0.72 on or where only one is left. Those whose name was
    called, and who called the roll, keep theirs; called is the new name or null.
    """
    names = F.regexp_extract_all(F.regexp_extract(clean_text(F.col("text")), ROLL_CALL, 1), F.lit(r"([A-Z][A-Za-z'-]+)"), F.lit(1))
    called = segments.select("meeting_id", "idx", F.col("speaker").alias("caller"), F.posexplode(names).alias("pos", "called")).where("lower(called) <> 'and'")
    first = called.groupBy("meeting_id", F.lower("called").alias("key")).agg(F.min_by("called", F.struct("idx", "pos")).alias("called"), F.min(F.struct("idx", "pos")).alias("at"))
    borne = people.select("meeting_id", F.lower("name").alias("key")).distinct()
    order = Window.partitionBy("meeting_id").orderBy(F.col("at"))
    unused = first.join(borne, ["meeting_id", "key"], "left_anti").withColumn("right", (F.row_number().over(order) - 1).cast("int")).withColumn("n", F.count("*").over(Window.partitionBy("meeting_id")))
    callers = called.select("meeting_id", F.col("caller").alias("speaker")).distinct()
    keyed = people.withColumn("key", F.lower("name"))
    open_ = keyed.join(first, ["meeting_id", "key"], "left_anti").join(callers, ["meeting_id", "speaker"], "left_anti").where("name <> ''")
    open_ = open_.withColumn("left", (F.row_number().over(Window.partitionBy("meeting_id").orderBy("speaker")) - 1).cast("int"))
    met = open_.join(unused.select("meeting_id", "called", "right", "n"), "meeting_id").withColumn("ratio", evidence_similarity(F.col("name"), F.col("called")))
    pairs = greedy_matches(met.where((F.col("ratio") >= SAME_NAME) | (F.col("n") == 1)).select("meeting_id", "left", "right", "ratio"), ["meeting_id"])
    given = pairs.join(open_.select("meeting_id", "left", "speaker"), ["meeting_id", "left"]).join(unused.select("meeting_id", "right", "called"), ["meeting_id", "right"])
    return people.join(given.select("meeting_id", "speaker", "called"), ["meeting_id", "speaker"], "left").select("meeting_id", "speaker", F.coalesce("called", "name").alias("name"), "called")
