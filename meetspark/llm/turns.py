"""Speech transcripts into clean speaker turns (problem 6): SQL expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A time: two or three parts, with or without a fraction.
TIME = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
#: What a line may start with: a bracketed time, or a bare one of three parts.
MARK = r"(?:[\[(<]\s*" + TIME + r"\s*[\])>]|\d{1,3}:\d{2}:\d{2}(?:[.,]\d{1,3})?(?=\s))"
#: Sounds that stand in round or square brackets. Fixed values.
SOUNDS = (
    "inaudible|unintelligible|indistinct|laugh(?:s|ing|ter)?|cough(?:s|ing)?|sigh(?:s|ing)?|sniff(?:s|ing)?|gasps?|breath(?:s|ing)?|"
    "music|applause|clapping|cross-?talk|pause|silence|noise|background noise|vocalsound|disfmarker|door slams?|"
    "phone (?:rings?|ringing)|clears throat|throat clearing|beep|static|typing|knocking|whispers?|overlapping"
)
#: Hesitation and backchannel sounds, without punctuation. Fixed values.
HESITATIONS = "u+h+m*|u+m+|e+r+m*|e+h+m*|a+h+m*|h+m+|m+h+m+|m{2,}|m+-h+m+|u+h+-(?:h+)?u+h+"
#: Each alternative starts with one character or a place, so most characters are passed at once.
NOISE = (
    r"(?:\s|\G)(?i:" + HESITATIONS + r")[.,!?;:…]*(?=$|[\s\[({<*])"
    r"|[\[(]\s*(?:" + TIME + r"|(?i:" + SOUNDS + r")(?:\s+" + TIME + r")?)\s*[\])]"
    r"|<[^<>\n]*+>|\{[^{}\n]*+\}|\*[^*\s][^*\n]*+\*|\(\([^()\n]*+\)\)"
)
WORD = r"[A-Za-z0-9\p{L}\p{N}]\S*"
UNKNOWN = ["unknown", "unknown speaker", "unidentified", "unidentified speaker", "speaker_unknown", "???", "??", "?"]
CAPTION = (
    r"(?m)^[ \t]*\d+[ \t]*\r?\n[ \t]*(\d{1,3}:\d{2}:\d{2})(?:[.,](\d{1,3}))?[ \t]*-->[^\n]*\r?\n"
)
#: A possible label has no bracket left open before its colon, as times and sounds inside speech have.
_LINE = r"^\s*(?:" + MARK + r"\s*(?:-\s+)?)?((?:[^:\n<\[({]++|\[[^\]:\n]*+\]|\([^):\n]*+\))++):(?s)(.*)$"
_RECORD = ["record_kind", "record_key", "text_key"]


def _words(text: Column) -> Column:
    """Number of white-space-separated tokens that hold a letter or digit, without noise."""
    return F.regexp_count(F.regexp_replace(text, F.lit(NOISE), F.lit(" ")), F.lit(WORD))


def _seconds(mark: Column) -> Column:
    parts = F.transform(F.split(F.replace(mark, F.lit(","), F.lit(".")), ":"), lambda x: x.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total * 60 + x)


def _plain(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(label), r"\s+", " "))


def lines(records: DataFrame) -> DataFrame:
    """Each line of each text with its time mark, possible label and the words behind it.

    ``records`` has record_kind, record_key, meeting_id and text. Caption
    numbers and time ranges become time marks of the line below; a text of one
    line is cut before each ``SPEAKER_n:``. Null and empty texts have no lines.
    """
    text = F.col("text")
    text = F.when(text.contains("-->"), F.regexp_replace(text, CAPTION, "[$1.$2] ")).otherwise(text)
    text = F.when(
        ~F.rtrim(text).contains("\n"),
        F.regexp_replace(F.regexp_replace(text, r"(?i)\s+(?=(?:" + MARK + r"\s*)?SPEAKER_\d+\s*:)", "\n"), r"^(\s*" + MARK + r"\s*(?:-\s*)?)\n", "$1 "),
    ).otherwise(text)
    # the text itself isn't carried to its lines
    parted = records.where(F.length("text") > 0).select(
        "record_kind", "record_key", "meeting_id", F.unhex(F.md5("text")).alias("text_key"), F.split(text, "\n").alias("parts")
    )
    given = parted.select(*_RECORD, "meeting_id", F.posexplode("parts").alias("pos", "line"))
    line = F.col("line")
    mark = F.regexp_extract(line, r"^\s*(" + MARK + ")", 1)
    label = F.regexp_extract(line, _LINE, 1)
    stripped = given.withColumn("mark", F.regexp_replace(mark, r"[\[\](<>)\s]", "")).withColumn("label", label)
    behind = F.when(F.col("label") != "", F.regexp_extract(line, _LINE, 2)).otherwise(F.regexp_replace(line, r"^\s*" + MARK, ""))
    return stripped.select(
        *_RECORD, "meeting_id", "pos",
        F.when(F.col("mark") != "", _seconds(F.col("mark"))).alias("time"),
        F.when(F.col("label") != "", F.col("label")).alias("label"),
        behind.alias("spoken"),
    ).where((F.col("label").isNotNull()) | (F.length(F.trim("spoken")) > 0))


#: The parts of a label that may name somebody, by form: a number, a role behind a name, a role before initials, what stands
#: behind a dash; and a name with the surname first.
NUMBER, ROLE, PLAIN_ROLE, BEHIND = r"(?:^|\[)(?:speaker[ _]|spk|s)(\d{1,3})(?:\]$| \(|$)", r"^[^()]+ \(([^()]{3,})\)$", r"^([^()]{3,}) \([a-z]\)$", r"^[^-]+ - (.+)$"
SWAPPED = r"^([^,]+), ([^,]+)$"


def label_key(label: Column) -> Column:
    """A label reduced to the part that names somebody: SPEAKER_nn, a role, a name or initials."""
    name = _plain(label)
    number = F.regexp_extract(name, NUMBER, 1)
    role = F.regexp_extract(name, ROLE, 1)
    plain_role = F.regexp_extract(name, PLAIN_ROLE, 1)
    behind = F.regexp_extract(name, BEHIND, 1)
    swapped = F.regexp_replace(name, SWAPPED, "$2 $1")
    return (
        F.when(number != "", F.format_string("speaker_%02d", F.try_to_number(number, F.lit("999")).cast("int")))
        .when(role != "", role)
        .when(plain_role != "", plain_role)
        .when(behind != "", behind)
        .otherwise(swapped)
    )


def roster_keys(roster: DataFrame) -> DataFrame:
    """(meeting_id, key, speaker): every key that names somebody in the meeting's roster.

    If a key could name several people, the smallest speaker_label counts.
    """
    full, role = _plain(F.col("full_name")), _plain(F.col("role"))
    first, last = F.substring_index(full, " ", 1), F.substring_index(full, " ", -1)
    initials = F.array_join(F.transform(F.split(role, " "), lambda w: F.substring(w, 1, 1)), "")
    number = F.regexp_extract(F.lower("speaker_label"), r"(\d{1,3})$", 1)
    keys = F.array(
        F.when(number != "", F.format_string("speaker_%02d", F.try_to_number(number, F.lit("999")).cast("int"))),
        _plain(F.col("speaker_label")), role, initials, full, first, F.concat(F.substring(first, 1, 1), F.lit(". "), last),
    )
    named = roster.select("meeting_id", F.col("speaker_label").alias("speaker"), F.explode(F.array_compact(keys)).alias("key"))
    return named.where("key <> '' AND speaker IS NOT NULL").groupBy("meeting_id", "key").agg(F.min("speaker").alias("speaker"))


def clean_turns(records: DataFrame, roster: DataFrame) -> DataFrame:
    """(record_kind, record_key, text_key, turn_no, speaker, n_words, text) of each clean turn.

    Lines are resolved against the roster by one equi-join; the rest happens in
    windows over one text: speakers are filled forward, turns are put in order
    of time where every labelled line has a time, emptied turns are dropped and
    islands of one speaker become one turn. Words before the first label belong
    to UNKNOWN. Repeated rows of one text count once; a record with two texts
    gives the turns of both. Texts without any word give no rows.
    """
    found = lines(records)
    glued = (F.col("label").isNotNull() & F.regexp_like("spoken", F.lit(r"^[\p{L}\p{N}]"))).cast("int")
    counted = found.withColumn("n", _words(F.col("spoken"))).withColumn("n_label", F.coalesce(_words(F.col("label")) - glued, F.lit(0)))
    key = F.coalesce(label_key(F.col("label")), F.concat(F.lit("\n"), "record_key"))
    keyed = counted.withColumn("key", key).withColumn("unknown", F.coalesce(_plain(F.col("label")).isin(UNKNOWN), F.lit(False)))
    named = keyed.join(roster_keys(roster), ["meeting_id", "key"], "left")
    speaker = F.when(F.col("unknown"), F.lit("UNKNOWN")).otherwise(F.col("speaker"))
    resolved = named.select(
        *_RECORD, "pos", "time", speaker.alias("speaker"),
        F.when(speaker.isNotNull(), F.col("n")).otherwise(F.col("n") + F.col("n_label")).alias("n"),
        F.when(speaker.isNotNull() | F.col("label").isNull(), F.col("spoken")).otherwise(F.concat_ws(":", "label", "spoken")).alias("spoken"),
    )
    by = Window.partitionBy(*_RECORD)
    along = by.orderBy("pos")
    marked = F.col("speaker").isNotNull()
    numbered = resolved.withColumn("before", F.lag("pos").over(along)).where("before IS NULL OR before <> pos")
    filled = numbered.select(
        *_RECORD, "pos", "n", "spoken",
        F.count("speaker").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("turn"),
        F.last("speaker", True).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("speaker"),
        F.when(marked, F.col("time")).alias("time"),
        F.min(F.when(marked, F.col("time").isNotNull())).over(by).alias("timed"),
    )
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "spoken"))), lambda x: x["spoken"]), "\n")
    turns = filled.groupBy(*_RECORD, "turn").agg(
        F.coalesce(F.first("speaker"), F.lit("UNKNOWN")).alias("speaker"), F.max("time").alias("time"), F.first("timed").alias("timed"),
        F.sum("n").cast("int").alias("n"), said.alias("said"),
    )
    ordered = by.orderBy(F.when(F.col("timed"), F.col("time")).asc_nulls_first(), "turn")
    kept = turns.where("n > 0").withColumn("rank", F.row_number().over(ordered)).withColumn("last", F.lag("speaker").over(ordered))
    changed = F.when(F.col("last").eqNullSafe(F.col("speaker")), 0).otherwise(1)
    island = kept.withColumn("turn_no", F.sum(changed).over(by.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "said"))), lambda x: x["said"]), "\n")
    clean = F.trim(F.regexp_replace(F.regexp_replace(whole, F.lit(NOISE), F.lit(" ")), r"\s+", " "))
    return island.groupBy(*_RECORD, "turn_no").agg(
        F.first("speaker").alias("speaker"), F.sum("n").cast("int").alias("n_words"), clean.alias("text")
    )


def transcripts(meetings: DataFrame, queries: DataFrame) -> DataFrame:
    """The transcripts of both tables as (record_kind, record_key, meeting_id, text)."""
    a = meetings.select(F.lit("meeting").alias("record_kind"), F.col("record_id").cast("string").alias("record_key"), "meeting_id", F.col("transcript").alias("text"))
    b = queries.select(F.lit("query").alias("record_kind"), F.col("example_id").alias("record_key"), "meeting_id", F.col("relevant_transcript").alias("text"))
    return a.unionAll(b)


def p6_found(meetings: DataFrame, queries: DataFrame, roster: DataFrame) -> DataFrame:
    """(record_kind, record_key, turn_no, speaker, n_words) of each clean turn."""
    found = clean_turns(transcripts(meetings, queries), roster)
    return found.select("record_kind", "record_key", "turn_no", "speaker", "n_words").distinct()


def p6_turns(meetings: DataFrame, queries: DataFrame, roster: DataFrame) -> DataFrame:
    """As p6_found, with the clean text of each turn."""
    found = clean_turns(transcripts(meetings, queries), roster)
    return found.select("record_kind", "record_key", "turn_no", "speaker", "n_words", "text").distinct()
