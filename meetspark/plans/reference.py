"""Registered queries of the engine's operators over the synthetic segments and the given tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meetspark.functions import cues, text as T
from meetspark.operators import alignment, asr, caching, corpora, evaluation, evidence, packing, retrieval
from meetspark.plans.synth import WITH, segments, turns
from meetspark.runtime import table

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) and the SQL behind the views seg and turn."""

    def register(build):
        QUERIES[name] = build
        if sql is not None:  # SQL that goes on from the shared views starts with a comma or a blank
            ORACLES[name] = WITH + sql if sql[0] in ", " else sql
        return build

    return register


def _sql(pattern: str, ignore_case: bool = True) -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_matches(text, '{quoted}'{', ' + chr(39) + 'i' + chr(39) if ignore_case else ''})"


STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS) + "]"
TERM_STOP = "[" + ", ".join(f"'{w}'" for w in T.TERM_STOPWORDS) + "]"
TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_'']+')"


def _tok(column: str) -> str:
    return TOK.format(column)


def _content(column: str) -> str:
    norm = (
        "CASE WHEN length(t) > 5 AND t LIKE '%ing' THEN left(t, length(t) - 3) WHEN length(t) > 4 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END"
    )
    return f"list_distinct(list_transform(list_filter({_tok(column)}, lambda t: length(t) > 1 AND NOT list_contains({STOP}, t)), lambda t: {norm}))"


def _terms(column: str) -> str:
    return f"list_distinct(list_filter({_tok(column)}, lambda t: NOT list_contains({TERM_STOP}, t)))"


CLOCK = "printf('%02d:%02d:%05.2f', CAST(floor({0} / 3600) AS INT), CAST(floor({0} / 60) AS INT) % 60, {0} - 60 * floor({0} / 60))"
RENDERED = "concat('[', seg_id, '] [', " + CLOCK.format("start_s") + ", '] ', speaker, ': ', text)"


def _rendered(df: DataFrame) -> DataFrame:
    return df.withColumn("rendered", T.render_segment(F.col("seg_id"), F.col("start_s"), F.col("speaker"), F.col("text")))


# cues -----------------------------------------------------------------------
def _cue(name: str):
    def build(spark: SparkSession, d: str) -> DataFrame:
        return cues.with_cues(segments(spark, d), [name]).where(F.col(f"cue_{name}")).select("meeting_id", "seg_id")

    cased = name in cues.CASED
    _query(f"cue_{name}", f" SELECT meeting_id, seg_id FROM seg WHERE {_sql(cues.CASED[name] if cased else cues.PATTERNS[name], not cased)}")(build)


for _name in [*cues.PATTERNS, *cues.CASED]:
    _cue(_name)

_NEG = " OR ".join(_sql(cues.PATTERNS[n]) for n in ("negated_action", "non_followup", "non_action"))
_ASKED = " OR ".join(_sql(cues.PATTERNS[n]) for n in ("direct_request", "ask_to_task", "suggestion"))


def _task_sql(name: str) -> str:
    cased = name in cues.CASED
    pattern = (cues.CASED if cased else cues.PATTERNS)[name].replace("'", "''")
    opt = "" if cased else ", 'i'"
    found = f"regexp_extract(text, '{pattern}', 0{opt})"
    verb = cues.PATTERNS["task_verb"].replace("'", "''")
    return f"({found} <> '' AND regexp_matches(substr(text, strpos(text, {found}), length({found}) + 140), '{verb}', 'i'))"


ACTIONS = (
    f", act AS (SELECT *, NOT ({_NEG}) AND NOT {_sql(cues.PATTERNS['past_activity'])} AND ("
    + " OR ".join(_task_sql(n) for n in ("first_person", "named_future", "direct_assignment", "pronoun_future"))
    + f") AS confirmed, NOT ({_NEG}) AND ({_ASKED}) AS suggested FROM seg)"
)


@_query("cue_action_status", ACTIONS + " SELECT meeting_id, CAST(count_if(confirmed) AS BIGINT) AS n_confirmed, CAST(count_if(suggested) AS BIGINT) AS n_suggested, CAST(count(*) AS BIGINT) AS n FROM act GROUP BY meeting_id")
def action_status(spark, d):
    confirmed, suggested = cues.action_status(F.col("text"))
    return segments(spark, d).groupBy("meeting_id").agg(F.count_if(confirmed).alias("n_confirmed"), F.count_if(suggested).alias("n_suggested"), F.count("*").alias("n"))


# scalar functions -----------------------------------------------------------
@_query("fn_clean_text", r"SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '[\s\x{0B}\x{85}\p{Z}]+', ' ', 'g'))) AS digest FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("digest"))


@_query("fn_format_timestamp", " SELECT meeting_id, seg_id, " + CLOCK.format("start_s") + " AS clock FROM seg")
def format_timestamp(spark, d):
    return segments(spark, d).select("meeting_id", "seg_id", T.format_timestamp(F.col("start_s")).alias("clock"))


@_query("fn_seconds", " SELECT meeting_id, seg_id, CAST(round(start_s * 100) AS BIGINT) AS hundredths FROM seg")
def seconds(spark, d):
    back = T.seconds(T.format_timestamp(F.col("start_s")))
    return segments(spark, d).select("meeting_id", "seg_id", F.round(back * 100).cast("long").alias("hundredths"))


@_query("fn_render_segment", f" SELECT meeting_id, seg_id, {RENDERED} AS rendered FROM seg")
def render_segment(spark, d):
    return _rendered(segments(spark, d)).select("meeting_id", "seg_id", "rendered")


@_query("fn_tokens", f" SELECT meeting_id, seg_id, CAST(len({_tok('text')}) AS INT) AS n, array_to_string({_tok('text')}, ' ') AS joined FROM seg")
def tokens(spark, d):
    t = T.tokens(F.col("text"))
    return segments(spark, d).select("meeting_id", "seg_id", F.size(t).alias("n"), T.normalised_segment_text(F.col("text")).alias("joined"))


@_query("fn_content_tokens", f" SELECT meeting_id, seg_id, array_to_string(list_sort({_content('text')}), ' ') AS content FROM seg")
def content_tokens(spark, d):
    return segments(spark, d).select("meeting_id", "seg_id", F.array_join(F.array_sort(T.content_tokens(F.col("text"))), " ").alias("content"))


@_query("fn_terms", f" SELECT meeting_id, seg_id, array_to_string(list_sort({_terms('text')}), ' ') AS terms FROM seg")
def terms(spark, d):
    return segments(spark, d).select("meeting_id", "seg_id", F.array_join(F.array_sort(T.terms(F.col("text"))), " ").alias("terms"))


@_query("fn_normalise_metric", r" SELECT meeting_id, seg_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM seg")
def normalise_metric(spark, d):
    return segments(spark, d).select("meeting_id", "seg_id", T.normalise_metric(F.col("text")).alias("plain"))


_PAIRS = ", pair AS (SELECT a.meeting_id, a.idx, a.text AS a, b.text AS b FROM seg a JOIN seg b ON a.meeting_id = b.meeting_id AND b.idx = a.idx + 1)"


def _pairs(spark, d) -> DataFrame:
    s = segments(spark, d)
    return s.select("meeting_id", "idx", F.col("text").alias("a")).join(s.select("meeting_id", (F.col("idx") - 1).alias("idx"), F.col("text").alias("b")), ["meeting_id", "idx"])


@_query(
    "fn_token_similarity",
    _PAIRS + f", t AS (SELECT meeting_id, idx, list_distinct({_tok('a')}) AS x, list_distinct({_tok('b')}) AS y FROM pair) "
    "SELECT meeting_id, idx, CAST(round(1e6 * len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))) AS BIGINT) AS jaccard_ppm, "
    "CAST(round(1e6 * len(list_intersect(x, y)) / least(len(x), len(y))) AS BIGINT) AS containment_ppm FROM t",
)
def token_similarity(spark, d):
    x, y = T.distinct_tokens(F.col("a")), T.distinct_tokens(F.col("b"))
    ppm = lambda c: F.round(1e6 * c).cast("long")
    return _pairs(spark, d).select("meeting_id", "idx", ppm(T.jaccard(x, y)).alias("jaccard_ppm"), ppm(T.containment(x, y)).alias("containment_ppm"))


@_query(
    "fn_word_overlap",
    _PAIRS + f", t AS (SELECT meeting_id, idx, {_tok('a')} AS x, {_tok('b')} AS y FROM pair) SELECT meeting_id, idx, "
    "CAST(coalesce(list_max(list_filter(range(1, 13), lambda k: k <= len(x) AND k <= len(y) AND list_slice(x, len(x) - k + 1, len(x)) = list_slice(y, 1, k))), 0) AS INT) AS size FROM t",
)
def word_overlap(spark, d):
    return _pairs(spark, d).select("meeting_id", "idx", T.word_overlap_size(F.col("a"), F.col("b")).alias("size"))


@_query(
    "fn_lexical_score",
    f" SELECT meeting_id, seg_id, CAST(round(1e6 * least(1.0, len(list_intersect({_terms(chr(39) + 'Which carrier should we use for the order and the budget target?' + chr(39))}, {_terms('text')})) * 1.0 / len({_terms(chr(39) + 'Which carrier should we use for the order and the budget target?' + chr(39))}))) AS BIGINT) AS score_ppm FROM seg",
)
def lexical_score(spark, d):
    q = F.lit("Which carrier should we use for the order and the budget target?")
    return segments(spark, d).select("meeting_id", "seg_id", F.round(1e6 * T.lexical_score(q, F.col("text"))).cast("long").alias("score_ppm"))


@_query(
    "fn_dot",
    "SELECT a.vec_id, CAST(round(1e4 * list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))) AS BIGINT) AS dot FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) b",
)
def dot(spark, d):
    e = table(spark, d, "embeddings")
    first = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("other"), F.lit(1).alias("k"))  # one query vector
    return e.withColumn("k", F.lit(1)).join(F.broadcast(first), "k").select("vec_id", F.round(1e4 * T.dot(F.col("embedding"), F.col("other"))).cast("long").alias("dot"))


@_query("fn_meeting_domain", "SELECT record_id, CASE WHEN meeting_id LIKE 'covid\\_%' ESCAPE '\\' OR meeting_id LIKE 'education\\_%' ESCAPE '\\' THEN 'committee' WHEN left(meeting_id, 2) IN ('ES', 'IS', 'TS') THEN 'product' ELSE 'academic' END AS domain_by_id FROM general_meetings")
def meeting_domain(spark, d):
    return corpora.with_domain(table(spark, d, "general_meetings")).select("record_id", "domain_by_id")


@_query("fn_estimated_tokens", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def estimated_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@_query("fn_clip", "SELECT segment_id, avg(CASE WHEN no_speech_prob IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, no_speech_prob)) END) AS p, avg(CASE WHEN avg_logprob IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, avg_logprob)) END) AS q FROM speaker_segments GROUP BY segment_id")
def clip(spark, d):
    rows = table(spark, d, "speaker_segments").groupBy("segment_id")
    return rows.agg(F.avg(T.clip(F.col("no_speech_prob").cast("string"))).alias("p"), F.avg(T.clip(F.col("avg_logprob").cast("string"))).alias("q"))


@_query("fn_role_key", "SELECT meeting_id, speaker_label, CASE WHEN lower(role) LIKE 'marketing %' THEN 'marketing' ELSE lower(role) END AS role_key FROM speaker_roster")
def role_key(spark, d):
    return table(spark, d, "speaker_roster").select("meeting_id", "speaker_label", T.role_key(F.col("role")).alias("role_key"))


@_query("fn_stage_key", " SELECT meeting_id, seg_id, sha256(concat_ws('|', 'analysis', sha256(text), 'model=1;schema=3;budget=9000')) AS cache_key FROM seg")
def stage_key(spark, d):
    key = caching.stage_key("analysis", F.col("text"), {"schema": "3", "model": "1"}, {"budget": "9000"})
    return segments(spark, d).select("meeting_id", "seg_id", key.alias("cache_key"))


# joins ----------------------------------------------------------------------
@_query(
    "join_assign_speakers",
    ", o AS (SELECT s.meeting_id, s.idx, t.speaker, sum(least(end_s, e) - greatest(start_s, s.s2)) AS overlap, min(f) AS f FROM (SELECT meeting_id, idx, start_s, end_s, 0 AS s2 FROM seg) s "
    "JOIN (SELECT * FROM turn) t ON s.meeting_id = t.meeting_id AND s.start_s < t.e AND t.s < s.end_s JOIN (SELECT meeting_id, speaker, min(idx) AS f FROM turn WHERE s < e GROUP BY ALL) x ON x.meeting_id = t.meeting_id AND x.speaker = t.speaker GROUP BY ALL)"
    .replace("greatest(start_s, s.s2)", "greatest(start_s, t.s)").replace(", 0 AS s2", "").replace("AND t.s < s.end_s", "AND t.s < s.end_s AND t.s < t.e").replace("GROUP BY ALL)", "GROUP BY ALL)", 1)
    + " SELECT seg.meeting_id, seg.idx, coalesce(b.best.speaker, 'SPEAKER_UNKNOWN') AS speaker, CAST(round(1000 * coalesce(b.best.overlap, 0)) AS BIGINT) AS overlap_ms FROM seg LEFT JOIN "
    "(SELECT meeting_id, idx, max(struct_pack(overlap := overlap, k := -f, speaker := speaker)) AS best FROM o GROUP BY meeting_id, idx) b ON b.meeting_id = seg.meeting_id AND b.idx = seg.idx",
)
def assign_speakers(spark, d):
    found = alignment.assign_speakers(segments(spark, d).select("meeting_id", "idx", "start_s", "end_s", "text"), turns(spark, d))
    return found.select("meeting_id", "idx", "speaker", F.round(1000 * F.col("overlap_s")).cast("long").alias("overlap_ms"))


_CLAIMS = (
    ", claim AS (SELECT event_id AS claim_id, meeting_id, text, ['seg-' || lpad(CAST(idx + 1 AS STRING), 4, '0'), 'seg-' || lpad(CAST(idx + 4 AS STRING), 4, '0'), 'seg-' || lpad(CAST(idx + 1 AS STRING), 4, '0')] AS ids FROM seg WHERE event_id % 7 = 0)"
    ", cited AS (SELECT claim_id, c.meeting_id, s.seg_id, s.idx, s.start_s, s.end_s, list_position(ids, s.seg_id) AS pos FROM claim c JOIN seg s ON s.meeting_id = c.meeting_id AND list_contains(c.ids, s.seg_id))"
)


def _claims(spark, d, every: bool = False) -> DataFrame:
    """Claims of ``every`` segment, or of those that the SQL above names."""
    s = segments(spark, d) if every else segments(spark, d).where("event_id % 7 = 0")
    sid = lambda k: F.format_string("seg-%04d", F.col("idx") + k)
    return s.select(F.col("event_id").alias("claim_id"), "meeting_id", "text", F.array(sid(1), sid(4), sid(1)).alias("evidence_ids"))


@_query("join_evidence_lookup", _CLAIMS + " SELECT claim_id, min(start_s) AS start_s, max(end_s) AS end_s, string_agg(seg_id, ',' ORDER BY pos) AS ids FROM cited GROUP BY claim_id")
def evidence_lookup(spark, d):
    cited = evidence.lookup(_claims(spark, d), segments(spark, d))
    return evidence.time_bounds(cited).select("claim_id", "start_s", "end_s", F.array_join("ids", ",").alias("ids"))


@_query("join_neighbours", _CLAIMS + " SELECT DISTINCT c.claim_id, s.idx FROM cited c JOIN seg s ON s.meeting_id = c.meeting_id AND abs(s.idx - c.idx) <= 1")
def neighbours(spark, d):
    s = segments(spark, d)
    return evidence.neighbours(evidence.lookup(_claims(spark, d), s), s)


@_query("join_positional_reconcile", " SELECT meeting_id, idx, CASE WHEN idx % 2 = 0 THEN speaker ELSE 'SPEAKER_1' || CAST(idx % 3 AS STRING) END AS speaker, start_s - 1.5 AS start_s FROM seg")
def positional_reconcile(spark, d):
    s = segments(spark, d)
    parsed = s.select("meeting_id", "idx", F.when(F.col("idx") % 2 == 0, F.col("speaker")).alias("speaker"), "text", F.lit(None).cast("double").alias("start_s"), F.lit(None).cast("double").alias("end_s"))
    audio = turns(spark, d).select("meeting_id", "idx", "speaker", F.col("s").alias("start_s"), F.col("e").alias("end_s"))
    return alignment.positional_reconcile(parsed, audio).select("meeting_id", "idx", "speaker", "start_s")


@_query(
    "join_recovery_candidates",
    f", base AS (SELECT * FROM seg WHERE idx % 3 <> 1), rec AS (SELECT *, array_to_string({_tok('text')}, ' ') AS k FROM (SELECT * REPLACE (start_s + 2.0 AS start_s, end_s + 2.0 AS end_s) FROM seg WHERE idx % 3 = 1)), "
    "b AS (SELECT meeting_id, min(start_s) AS low, max(end_s) AS high, count(*) AS n FROM base GROUP BY 1) "
    f"SELECT r.meeting_id, r.idx FROM rec r LEFT JOIN b USING (meeting_id) WHERE r.k <> '' AND NOT EXISTS (SELECT 1 FROM base x WHERE x.meeting_id = r.meeting_id AND array_to_string({_tok('x.text')}, ' ') = r.k) "
    "AND (b.n IS NULL OR b.n < 2 OR NOT (r.end_s < low - 5 OR r.start_s > high + 5)) AND NOT EXISTS (SELECT 1 FROM base x WHERE x.meeting_id = r.meeting_id AND greatest(0.0, least(x.end_s, r.end_s) - greatest(x.start_s, r.start_s)) / greatest(0.001, r.end_s - r.start_s) >= 0.25)",
)
def recovery_candidates(spark, d):
    s = segments(spark, d)
    late = s.where("idx % 3 = 1").withColumns({"start_s": F.col("start_s") + 2.0, "end_s": F.col("end_s") + 2.0})
    return asr.recovery_candidates(s.where("idx % 3 <> 1"), late).select("meeting_id", "idx")


@_query("join_gold_without_prediction", "SELECT DISTINCT example_id FROM specific_queries WHERE example_id NOT IN (SELECT example_id FROM predictions WHERE example_id IS NOT NULL)")
def gold_without_prediction(spark, d):
    return evaluation.gold_without_prediction(table(spark, d, "specific_queries"), table(spark, d, "predictions"), "example_id")


@_query(
    "join_span_turns",
    "WITH t AS (SELECT DISTINCT meeting_id, idx FROM speaker_segments WHERE idx IS NOT NULL), m AS (SELECT meeting_id, max(idx) AS last FROM t GROUP BY 1), q AS (SELECT DISTINCT example_id, meeting_id, relevant_text_span FROM specific_queries), "
    "r AS (SELECT example_id, meeting_id, last, unnest(CASE WHEN len(coalesce(relevant_text_span, [])) > 0 THEN relevant_text_span ELSE [['0', CAST(last AS STRING)]] END) AS pair, "
    "unnest(CASE WHEN len(coalesce(relevant_text_span, [])) > 0 THEN range(len(relevant_text_span)) ELSE [0] END) AS range_no FROM q JOIN m USING (meeting_id)) "
    "SELECT example_id, CAST(min(range_no) AS INT) AS range_no, t.idx FROM r JOIN t ON t.meeting_id = r.meeting_id AND t.idx BETWEEN CAST(pair[1] AS INT) AND CAST(pair[2] AS INT) GROUP BY example_id, t.idx",
)
def span_turns(spark, d):
    t = table(spark, d, "speaker_segments").where("idx IS NOT NULL").select("meeting_id", "idx").distinct()
    q = table(spark, d, "specific_queries").select("example_id", "meeting_id", "relevant_text_span").distinct()
    return corpora.span_turns(q, t)


@_query("join_split_overlaps", "WITH h AS (SELECT DISTINCT meeting_id, lower(trim(split)) AS s FROM general_meetings WHERE split IS NOT NULL) SELECT a.s AS split_a, b.s AS split_b, count(*) AS n FROM h a JOIN h b USING (meeting_id) WHERE a.s < b.s GROUP BY ALL")
def split_overlaps(spark, d):
    return corpora.split_overlaps(table(spark, d, "general_meetings").withColumn("split", F.lower(F.trim("split"))))


@_query("join_cache_misses", " SELECT DISTINCT sha256(text) AS cache_key FROM seg WHERE text NOT IN (SELECT text FROM seg WHERE event_id % 3 = 0)")
def cache_misses(spark, d):
    s = segments(spark, d).withColumn("cache_key", F.sha2("text", 256))
    return caching.misses(s, s.where("event_id % 3 = 0")).select("cache_key")


@_query("join_resume", "SELECT DISTINCT meeting_id FROM general_meetings WHERE meeting_id NOT IN (SELECT meeting_id FROM diarization WHERE meeting_id IS NOT NULL)")
def resume(spark, d):
    return corpora.pending(table(spark, d, "general_meetings"), table(spark, d, "diarization"), "meeting_id").select("meeting_id").distinct()


@_query(
    "join_role_owner",
    "SELECT r.meeting_id, r.speaker_label, s.full_name AS owner FROM speaker_roster r JOIN (SELECT meeting_id, role, max(struct_pack(l := speaker_label, n := full_name)).n AS full_name FROM speaker_roster GROUP BY 1, 2) s ON s.meeting_id = r.meeting_id AND s.role = r.role",
)
def role_owner(spark, d):
    r = table(spark, d, "speaker_roster").withColumn("role_key", T.role_key(F.col("role")))
    last = r.groupBy("meeting_id", "role_key").agg(F.max(F.struct("speaker_label", "full_name")).alias("o"))
    return r.join(last, ["meeting_id", "role_key"]).select("meeting_id", "speaker_label", F.col("o.full_name").alias("owner"))


# aggregations ---------------------------------------------------------------
@_query(
    "agg_coverage",
    f", c AS (SELECT meeting_id, max(end_s) AS duration_s, sum(len({_tok('text')})) AS word_count, sum(greatest(0.0, end_s - start_s)) AS covered FROM seg GROUP BY 1), w AS (SELECT *, word_count / greatest(duration_s / 60, 1 / 60) AS wpm FROM c) "
    "SELECT meeting_id, duration_s, CAST(word_count AS BIGINT) AS word_count, CAST(round(1000 * wpm) AS BIGINT) AS wpm_milli, CAST(round(1e6 * least(1.0, covered / greatest(duration_s, 0.001))) AS BIGINT) AS covered_ppm, "
    "CASE WHEN duration_s >= 120 AND wpm < 80 THEN 'critical' WHEN duration_s >= 120 AND wpm < 100 THEN 'review' ELSE 'good' END AS status, CASE WHEN duration_s >= 120 AND wpm < 80 THEN 0.5 WHEN duration_s >= 120 AND wpm < 100 THEN 0.65 ELSE 0.75 END AS quality FROM w",
)
def coverage(spark, d):
    c = asr.coverage(segments(spark, d))
    return c.select("meeting_id", "duration_s", "word_count", F.round(1000 * F.col("wpm")).cast("long").alias("wpm_milli"), F.round(1e6 * F.col("covered_share")).cast("long").alias("covered_ppm"), "status", "quality")


@_query(
    "agg_unreliable_segments",
    f", k AS (SELECT *, array_to_string({_tok('text')}, ' ') AS key FROM seg), o AS (SELECT *, count(*) OVER (PARTITION BY meeting_id, key ORDER BY idx ROWS UNBOUNDED PRECEDING) AS seen FROM k) "
    "SELECT meeting_id, idx, concat_ws(',', CASE WHEN avg_logprob < -1 THEN 'low_log_probability' END, CASE WHEN no_speech_prob > 0.65 AND avg_logprob < -0.55 THEN 'probable_silence' END, CASE WHEN compression_ratio > 2.4 THEN 'repetitive_compression' END, "
    "CASE WHEN key <> '' AND seen > 2 AND len(string_split(key, ' ')) >= 4 THEN 'repeated_phrase' END) AS reasons FROM o",
)
def unreliable(spark, d):
    return asr.reliability(segments(spark, d)).select("meeting_id", "idx", F.array_join("reasons", ",").alias("reasons"))


@_query("agg_text_counts", " SELECT meeting_id, idx, count(*) OVER (PARTITION BY meeting_id, lower(trim(text))) AS n_same FROM seg")
def text_counts(spark, d):
    return evidence.text_counts(segments(spark, d)).select("meeting_id", "idx", "n_same")


_LONG = f", long AS (SELECT meeting_id, idx, unnest({_content('text')}) AS term FROM seg), df AS (SELECT meeting_id, term, count(*) AS df FROM long GROUP BY 1, 2)"


@_query("agg_term_frequencies", _LONG + " SELECT meeting_id, term, df FROM df")
def term_frequencies(spark, d):
    return evidence.term_frequencies(segments(spark, d))


@_query("agg_centrality", _LONG + " SELECT meeting_id, idx, CAST(round(1e4 * sum(ln(1 + df)) / sqrt(count(*))) AS BIGINT) AS centrality FROM long JOIN df USING (meeting_id, term) GROUP BY 1, 2")
def centrality(spark, d):
    return evidence.centrality(segments(spark, d)).select("meeting_id", "idx", F.round(1e4 * F.col("centrality")).cast("long").alias("centrality"))


@_query("agg_modal_value", " SELECT meeting_id, max(struct_pack(n := n, p := -p, speaker := speaker)).speaker AS speaker, max(n) AS n FROM (SELECT meeting_id, speaker, count(*) AS n, min(idx) AS p FROM seg GROUP BY 1, 2) GROUP BY 1")
def modal_value(spark, d):
    counted = segments(spark, d).groupBy("meeting_id", "speaker").agg(F.count("*").alias("n"), (-F.min("idx")).alias("p"))
    return counted.groupBy("meeting_id").agg(F.max(F.struct("n", "p", "speaker")).alias("best")).select("meeting_id", F.col("best.speaker").alias("speaker"), F.col("best.n").alias("n"))


PURPOSE = _sql(cues.PATTERNS["purpose"])


@_query(
    "agg_claim_importance",
    _CLAIMS + f", w AS (SELECT *, {_content('text')} AS tokens FROM seg), n AS (SELECT meeting_id, count(*) AS size FROM seg GROUP BY 1), c AS (SELECT claim_id, meeting_id, ids, {_content('text')} AS tokens FROM claim), "
    "m AS (SELECT c.claim_id, w.idx, least(6, size) AS nb, size, len(list_intersect(c.tokens, w.tokens)) AS shared, len(c.tokens) AS need FROM c JOIN w USING (meeting_id) JOIN n USING (meeting_id)), "
    "k AS (SELECT claim_id, count(*) AS matches, count(DISTINCT least(nb - 1, idx * nb // size)) AS spread FROM m WHERE shared > 0 AND (shared >= CASE WHEN need <= 2 THEN 1 ELSE 2 END OR shared >= 0.5 * need) GROUP BY 1), "
    f"p AS (SELECT meeting_id, min(idx) AS purpose_idx FROM seg WHERE {PURPOSE} GROUP BY 1), e AS (SELECT claim_id, count(*) AS cited, max(idx) AS last, max(CAST({PURPOSE.replace('text', 's.text')} AS INT)) AS on_purpose FROM cited x JOIN (SELECT meeting_id AS mm, seg_id AS ss, text FROM seg) s ON s.mm = x.meeting_id AND s.ss = x.seg_id GROUP BY 1) "
    "SELECT c.claim_id, coalesce(matches, 0) AS matches, coalesce(spread, 0) AS spread, coalesce(cited, 0) AS cited, CASE WHEN len(tokens) = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, 0.18 + 0.45 * least(1.0, coalesce(matches, 0) / 5) + 0.25 * least(1.0, coalesce(spread, 0) / 3) + 0.15 * least(1.0, coalesce(cited, 0) / 2) "
    f"- CASE WHEN len(list_filter(tokens, lambda t: NOT list_contains([{', '.join(repr(g) for g in T.GENERIC)}], t))) = 0 THEN 0.45 ELSE 0 END + 0.35 * coalesce(on_purpose, 0) - CASE WHEN last < purpose_idx THEN 0.75 ELSE 0 END)), 3) END AS score "
    "FROM c LEFT JOIN k USING (claim_id) LEFT JOIN e USING (claim_id) LEFT JOIN p USING (meeting_id)",
)
def claim_importance(spark, d):
    claims = _claims(spark, d).withColumn("boost", F.lit(0.0))
    purpose = cues.has(T.clean_text(F.col("text")), "purpose")
    return evidence.importance(claims, segments(spark, d), purpose).select("claim_id", "matches", "spread", "cited", "score")


@_query("agg_audit_segments", "SELECT split, role, count(*) AS n, count(DISTINCT meeting_id) AS n_meetings FROM asr_segments GROUP BY split, role")
def audit_segments(spark, d):
    return corpora.audit(table(spark, d, "asr_segments"), ["split", "role"])


@_query("agg_audit_queries", "SELECT split, domain, count(*) AS n, count(DISTINCT meeting_id) AS n_meetings FROM specific_queries GROUP BY split, domain")
def audit_queries(spark, d):
    return corpora.audit(table(spark, d, "specific_queries"), ["split", "domain"])


_ANSWERS = (
    "WITH p AS (SELECT prediction_id, prediction FROM (SELECT DISTINCT prediction_id, example_id, prediction FROM predictions)), q AS (SELECT DISTINCT p.prediction_id, s.answer AS reference, p.prediction FROM (SELECT DISTINCT prediction_id, example_id, prediction FROM predictions) p JOIN (SELECT DISTINCT example_id, answer FROM specific_queries) s USING (example_id))"
)


def _answers(spark, d) -> DataFrame:
    p = table(spark, d, "predictions").select("prediction_id", "example_id", "prediction").distinct()
    s = table(spark, d, "specific_queries").select("example_id", F.col("answer").alias("reference")).distinct()
    return p.join(s, "example_id").select("prediction_id", "reference", "prediction").distinct()


@_query(
    "agg_token_f1",
    _ANSWERS + ", t AS (SELECT prediction_id, regexp_extract_all(lower(coalesce(reference, '')), '[a-z0-9]+') AS a, regexp_extract_all(lower(coalesce(prediction, '')), '[a-z0-9]+') AS b FROM q), "
    "x AS (SELECT prediction_id, token, count(*) AS n FROM (SELECT prediction_id, unnest(a) AS token FROM t) GROUP BY 1, 2), y AS (SELECT prediction_id, token, count(*) AS n FROM (SELECT prediction_id, unnest(b) AS token FROM t) GROUP BY 1, 2), "
    "h AS (SELECT prediction_id, sum(least(x.n, y.n)) AS hits FROM x JOIN y USING (prediction_id, token) GROUP BY 1) "
    "SELECT prediction_id, CAST(round(1e6 * CASE WHEN len(a) = 0 OR len(b) = 0 THEN CASE WHEN len(a) = len(b) THEN 1 ELSE 0 END ELSE 2.0 * coalesce(hits, 0) / (len(a) + len(b)) END) AS BIGINT) AS f1_ppm FROM t LEFT JOIN h USING (prediction_id)",
)
def token_f1(spark, d):
    return evaluation.token_f1(_answers(spark, d), "prediction_id").select("prediction_id", F.round(1e6 * F.col("f1")).cast("long").alias("f1_ppm"))


@_query("agg_rouge_l")
def rouge_l(spark, d):
    return evaluation.rouge_l(_answers(spark, d), "prediction_id").select("prediction_id", F.round(1e6 * F.col("rouge_l")).cast("long").alias("rouge_ppm"))


@_query("agg_word_error_rate")
def word_error_rate(spark, d):
    return evaluation.word_error_rate(_answers(spark, d), "prediction_id")


@_query(
    "agg_macro_average",
    ORACLES["agg_token_f1"].replace("SELECT prediction_id, CAST(round(1e6 *", ", s AS (SELECT prediction_id, (").replace(") AS BIGINT) AS f1_ppm FROM t LEFT JOIN h USING (prediction_id)", ") AS f1 FROM t LEFT JOIN h USING (prediction_id)) SELECT model, CAST(round(1e6 * avg(f1)) AS BIGINT) AS f1_ppm, count(*) AS n FROM s JOIN (SELECT DISTINCT prediction_id, model FROM predictions) USING (prediction_id) GROUP BY 1"),
)
def macro_average(spark, d):
    scored = evaluation.token_f1(_answers(spark, d), "prediction_id")
    models = table(spark, d, "predictions").select("prediction_id", "model").distinct()
    return evaluation.macro_average(scored.join(models, "prediction_id"), "model", ["f1"]).select("model", F.round(1e6 * F.col("f1")).cast("long").alias("f1_ppm"), "n")


@_query("agg_speaker_count", "SELECT diarization_id, coalesce(CAST(speaker_count AS BIGINT), (SELECT count(DISTINCT speaker_label) FROM speaker_roster r WHERE r.meeting_id = d.meeting_id)) AS speakers FROM diarization d")
def speaker_count(spark, d):
    known = table(spark, d, "speaker_roster").groupBy("meeting_id").agg(F.countDistinct("speaker_label").alias("known"))
    return table(spark, d, "diarization").join(known, "meeting_id", "left").select("diarization_id", F.coalesce(F.col("speaker_count").cast("long"), "known", F.lit(0).cast("long")).alias("speakers"))


@_query("agg_cache_stats", ", k AS (SELECT DISTINCT text FROM seg WHERE event_id % 3 = 0) SELECT count(*) AS chunks, count(k.text) AS hits, count(*) - count(k.text) AS misses FROM seg LEFT JOIN k ON k.text = seg.text")
def cache_stats(spark, d):
    s = segments(spark, d).withColumn("cache_key", F.sha2("text", 256))
    return caching.cache_stats(s, s.where("event_id % 3 = 0"))


# windows --------------------------------------------------------------------
@_query("win_dense_ids", " SELECT meeting_id, event_id, 'seg-' || lpad(CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY start_s, event_id) AS STRING), 4, '0') AS seg_id, 'audio' AS origin FROM seg")
def dense_ids(spark, d):
    s = segments(spark, d).drop("idx", "seg_id")
    return alignment.dense_ids(s, [F.col("start_s"), F.col("event_id")]).select("meeting_id", "event_id", "seg_id", "origin")


@_query("win_first_purpose", f" SELECT meeting_id, idx, min(CASE WHEN {PURPOSE} THEN idx END) OVER (PARTITION BY meeting_id) AS purpose_idx FROM seg")
def first_purpose(spark, d):
    return evidence.first_cue(segments(spark, d), cues.has(T.clean_text(F.col("text")), "purpose"), "purpose_idx").select("meeting_id", "idx", "purpose_idx")


@_query("win_context", " SELECT meeting_id, idx, md5(string_agg(text, ' ') OVER (PARTITION BY meeting_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) AS around, md5(string_agg(text, ' ') OVER (PARTITION BY meeting_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS before FROM seg")
def context(spark, d):
    both = evidence.context(evidence.context(segments(spark, d), 5, 5, "around"), 3, 0, "before")
    return both.select("meeting_id", "idx", F.md5("around").alias("around"), F.md5("before").alias("before"))


@_query(
    "win_buckets",
    ", n AS (SELECT meeting_id, idx, count(*) OVER (PARTITION BY meeting_id) AS size FROM seg), b AS (SELECT *, least(6, size) AS k FROM n) "
    "SELECT meeting_id, idx, (SELECT max(x) FROM range(6) r(x) WHERE x < k AND x * size // k <= idx) AS part, least(k - 1, idx * k // size) AS bucket FROM b",
)
def buckets(spark, d):
    return evidence.buckets(segments(spark, d)).select("meeting_id", "idx", F.col("part").cast("long").alias("part"), F.col("bucket").cast("long").alias("bucket"))


@_query("win_three_windows", ", n AS (SELECT meeting_id, idx, count(*) OVER (PARTITION BY meeting_id) AS size FROM seg) SELECT meeting_id, w, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n FROM n JOIN range(3) r(w) ON idx >= w * size // 3 AND idx < (w + 1) * size // 3 GROUP BY 1, 2")
def three_windows(spark, d):
    parted = evidence.buckets(segments(spark, d), 3)
    return parted.groupBy("meeting_id", F.col("part").cast("long").alias("w")).agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n"))


@_query("win_next_role", f" SELECT meeting_id, idx, min(CASE WHEN {_sql(cues.PATTERNS['role'])} THEN idx END) OVER (PARTITION BY meeting_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_role, min(CASE WHEN {PURPOSE} THEN idx END) OVER (PARTITION BY meeting_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS next_purpose FROM seg")
def next_role(spark, d):
    t = T.clean_text(F.col("text"))
    rows = evidence.next_cue(segments(spark, d), cues.has(t, "role"), None, "next_role")
    return evidence.next_cue(rows, cues.has(t, "purpose"), 24, "next_purpose").select("meeting_id", "idx", "next_role", "next_purpose")


@_query(
    "win_chunks",
    ", r AS (SELECT meeting_id, idx, length(" + RENDERED + ") AS size FROM seg) SELECT meeting_id, idx, chunk FROM (WITH RECURSIVE walk AS (SELECT meeting_id, idx, size AS used, 0 AS chunk FROM r WHERE idx = 0 UNION ALL "
    "SELECT r.meeting_id, r.idx, CASE WHEN w.used + 1 + r.size > 400 THEN r.size ELSE w.used + 1 + r.size END, CASE WHEN w.used + 1 + r.size > 400 THEN w.chunk + 1 ELSE w.chunk END FROM walk w JOIN r ON r.meeting_id = w.meeting_id AND r.idx = w.idx + 1) SELECT * FROM walk)",
)
def chunk_segments(spark, d):
    return packing.chunk_lines(_rendered(segments(spark, d)), 400).select("meeting_id", "idx", "chunk")


@_query("win_split_transcripts")
def split_transcripts(spark, d):
    lines = table(spark, d, "general_meetings").select("record_id", F.posexplode(F.split("transcript", r"\n")).alias("idx", "line"))
    return packing.chunks(lines.select("record_id", "idx", F.trim("line").alias("line")), 4000, "record_id", "line").select("record_id", "chunk", "n_lines", F.length("text").alias("n_chars"))


# sorts and limits -----------------------------------------------------------
def _questions(spark, d) -> DataFrame:
    return segments(spark, d).where("idx = 0").select("meeting_id", F.concat(F.lit("q-"), "meeting_id").alias("question_id"), F.lit("Which carrier should we use for the order and the budget target?").alias("question"))


_SCORED = ORACLES["fn_lexical_score"].replace(WITH + " SELECT", ", sc AS (SELECT idx, ").replace("AS BIGINT) AS score_ppm FROM seg", "AS BIGINT) AS score_ppm FROM seg)")


@_query("top_retrieval", _SCORED + ", k AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY score_ppm DESC, idx) AS rank FROM sc) SELECT meeting_id, seg_id, score_ppm, rank FROM k WHERE rank <= 10")
def retrieval_top(spark, d):
    best = retrieval.top_turns(retrieval.score_turns(_questions(spark, d), segments(spark, d)))
    return best.select("meeting_id", "seg_id", F.round(1e6 * F.col("score")).cast("long").alias("score_ppm"), F.col("rank").cast("long").alias("rank"))


@_query("top_retrieve_evidence")
def retrieve_evidence(spark, d):
    s = _rendered(segments(spark, d))
    found = retrieval.retrieve(retrieval.score_turns(_questions(spark, d), s), s, budget=400)
    return found.select("question_id", F.round("best_score", 6).alias("best_score"), "status", F.array_join("selected", ",").alias("selected"))


@_query(
    "top_dense_retrieval",
    "WITH q AS (SELECT vec_id AS q_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q_id, vec_id, round(list_sum(list_transform(list_zip(q, embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 5) AS score FROM q, embeddings WHERE vec_id <> q_id) "
    "SELECT q_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5",
)
def dense_retrieval(spark, d):
    from meetspark.operators.vectors import top_k

    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    return top_k(queries, e, 5)


@_query("top_rank_claims", None)
def rank_claims(spark, d):
    s = segments(spark, d)
    claims = _claims(spark, d, every=True).withColumn("boost", F.lit(0.0))
    scored = evidence.importance(claims, s, cues.has(T.clean_text(F.col("text")), "purpose"))
    starts = evidence.time_bounds(evidence.lookup(claims, s)).select("claim_id", "start_s")
    return evidence.rank_claims(scored.join(starts, "claim_id", "left"), 0.22, 5).select("meeting_id", "claim_id", "score", "rank")


# set operations -------------------------------------------------------------
@_query("set_keep_first", " SELECT meeting_id, min(idx) AS idx, lower(text) AS key FROM seg GROUP BY meeting_id, lower(text)")
def keep_first(spark, d):
    from meetspark.operators.dedup import keep_first as first

    s = segments(spark, d)
    return first(s, ["meeting_id"], F.lower(T.clean_text(F.col("text"))), "idx").select("meeting_id", "idx", F.col("dedup_key").alias("key"))


@_query("set_union_passes", " SELECT meeting_id, count(*) AS n, sum(CASE WHEN idx % 2 = 1 THEN 1 ELSE 0 END) AS recovered FROM seg GROUP BY 1")
def union_passes(spark, d):
    s = segments(spark, d)
    both = s.where("idx % 2 = 0").withColumn("origin", F.lit("vad")).unionByName(s.where("idx % 2 = 1").withColumn("origin", F.lit("recovery")))
    return both.groupBy("meeting_id").agg(F.count("*").alias("n"), F.count_if(F.col("origin") == "recovery").alias("recovered"))


# sources, sinks, reviews ----------------------------------------------------
@_query("sink_speaker_transcript", " SELECT meeting_id, md5(string_agg('[' || " + CLOCK.format("start_s") + " || '] ' || speaker || ': ' || text, chr(10) ORDER BY idx)) AS digest FROM seg GROUP BY 1")
def speaker_transcript(spark, d):
    return alignment.speaker_transcript(segments(spark, d)).select("meeting_id", F.md5("transcript").alias("digest"))


@_query("source_parse_transcript", " SELECT meeting_id, idx, speaker, text, round(start_s, 2) AS start_s FROM seg")
def parse_transcript(spark, d):
    return alignment.parse_transcript(alignment.speaker_transcript(segments(spark, d))).select("meeting_id", "idx", "speaker", "text", F.round("start_s", 2).alias("start_s"))


@_query("sink_rttm", r"SELECT printf('SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>', meeting_id, start, duration, coalesce(nullif(trim(speaker_id), ''), nullif(trim(agent), ''), 'unknown')) AS line FROM asr_segments WHERE start IS NOT NULL AND NOT isnan(start) AND duration > 0 AND NOT isnan(duration)")
def rttm(spark, d):
    return corpora.rttm_lines(table(spark, d, "asr_segments"))


@_query("source_latest_rows", "SELECT example_id, epoch_us(max(ingested_at)) AS ingested_us, count(DISTINCT answer) AS n FROM specific_queries GROUP BY 1")
def latest_rows(spark, d):
    q = table(spark, d, "specific_queries").select("example_id", "answer", "ingested_at")
    newest = corpora.latest(q, "example_id", "ingested_at").select("example_id", F.unix_micros("ingested_at").alias("ingested_us"))
    return newest.join(q.groupBy("example_id").agg(F.countDistinct("answer").alias("n")), "example_id")


@_query(
    "set_apply_reviews",
    " SELECT seg.event_id, coalesce(r.s, 'draft') AS review_status, coalesce(r.t, seg.text) AS shown_text, CASE WHEN r.s = 'confirmed' THEN r.v END AS verification_seconds FROM seg LEFT JOIN (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'confirmed' ELSE 'edited' END AS s, text || ' (edited)' AS t, CAST(event_id % 60 AS DOUBLE) AS v FROM seg WHERE event_id % 5 = 0) r ON r.event_id = seg.event_id",
)
def apply_reviews(spark, d):
    s = segments(spark, d).select(F.col("event_id").alias("item_id"), "text")
    status = F.when(F.col("item_id") % 10 == 0, "confirmed").otherwise("edited")
    late = s.where("item_id % 5 = 0").select("item_id", status.alias("status"), F.concat("text", F.lit(" (edited)")).alias("text"), (F.col("item_id") % 60).cast("double").alias("seconds"), F.lit(2).alias("at"))
    early = late.withColumn("at", F.lit(1)).withColumn("status", F.lit("edited"))
    return corpora.apply_reviews(s, late.unionByName(early)).select(F.col("item_id").alias("event_id"), "review_status", "shown_text", "verification_seconds")


@_query("win_digests")
def digests(spark, d):
    from meetspark.operators.digest import digests as build

    found = build(segments(spark, d))
    return found.select("meeting_id", "window", "n_selected", F.array_join("ids", ",").alias("ids"), F.length("text").alias("n_chars"))


@_query("join_merge_passes")
def merge_passes(spark, d):
    from meetspark.operators.greedy import merge_passes as merge

    s = segments(spark, d)
    base = s.where("idx % 3 <> 1")
    late = s.where("idx % 3 = 1").withColumns({"start_s": F.col("start_s") + 2.0, "end_s": F.col("end_s") + 2.0})
    return merge(base, asr.recovery_candidates(base, late)).select("meeting_id", "text", "start_s", "origin")


@_query("join_fuzzy_reconcile")
def fuzzy_reconcile(spark, d):
    from meetspark.operators.greedy import fuzzy_reconcile as match

    s = segments(spark, d).select("meeting_id", "idx", "speaker", "text", "start_s", "end_s")
    parsed = s.withColumns({"start_s": F.lit(None).cast("double"), "end_s": F.lit(None).cast("double"), "speaker": F.when(F.col("idx") % 2 == 0, F.col("speaker"))})
    # every turn on both sides; in a third of them the audio lacks the last word
    return match(parsed, s.withColumn("text", F.when(F.col("idx") % 3 == 1, F.regexp_replace("text", r"\s+\S+$", "")).otherwise(F.col("text"))))


@_query("join_extraction_metrics")
def extraction_metrics(spark, d):
    from meetspark.operators.greedy import extraction_metrics as score

    gold = table(spark, d, "specific_queries").groupBy("example_id").agg(F.array_sort(F.collect_set("answer")).alias("gold"))
    told = table(spark, d, "predictions").groupBy("example_id").agg(F.array_sort(F.collect_set("prediction")).alias("predicted"))
    lists = gold.join(told, "example_id", "left")
    return score(lists, "example_id", fuzzy=True)


@_query("set_deduplicate_actions")
def deduplicate_actions(spark, d):
    from meetspark.operators.greedy import deduplicate_actions as dedup

    confirmed, suggested = cues.action_status(F.col("text"))
    s = segments(spark, d).withColumns({"c": confirmed, "s": suggested}).where("c OR s")
    acts = s.select("meeting_id", "idx", F.col("text").alias("task"), F.col("speaker").alias("owner"), F.lit(None).cast("string").alias("deadline"), F.when(F.col("c"), "confirmed").otherwise("suggested").alias("commitment_status"), F.array("seg_id").alias("ids"))
    return dedup(acts).select("meeting_id", "idx", "task", "owner", "commitment_status", F.array_join("ids", ",").alias("ids"))


def _outputs(spark, d) -> DataFrame:
    """Model output made of cue-bearing segments: mixed strings and objects."""
    s = cues.with_cues(segments(spark, d), ["decision", "risk", "question", "purpose"]).withColumn("window", F.col("idx") % 3)
    item = F.when(F.col("idx") % 2 == 0, F.to_json(F.struct(F.col("text"), F.array("seg_id").alias("evidence_segment_ids"), F.lit(0.9).alias("confidence")))).otherwise(F.concat(F.lit('"'), "text", F.lit('"')))
    lists = [F.concat(F.lit(f'"{name}":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(f"cue_{cue}"), F.struct("idx", item.alias("item"))))), lambda x: x["item"]), ","), F.lit("]")) for name, cue in (("decisions", "decision"), ("risks", "risk"), ("open_questions", "question"), ("topics", "purpose"))]
    return s.groupBy("meeting_id", "window").agg(F.concat(F.lit("{"), F.concat_ws(",", *lists), F.lit("}")).alias("output"))


_INGEST = ", c AS (" + " UNION ALL ".join(
    f"SELECT meeting_id, idx % 3 AS w, idx, text, '{f}' AS field FROM seg WHERE {_sql(cues.PATTERNS[c])}" for f, c in (("decisions", "decision"), ("risks", "risk"), ("open_questions", "question"), ("topics", "purpose"))
) + ") "


@_query("claims_ingest", _INGEST + "SELECT meeting_id, field, CAST(w AS INT) AS w, text, CASE WHEN idx % 2 = 0 THEN 0.9 ELSE 0.6 END AS confidence FROM c")
def claims_ingest(spark, d):
    from meetspark.operators.claims import ingest

    return ingest(_outputs(spark, d)).select("meeting_id", "field", F.col("window").cast("int").alias("w"), "text", "confidence")


@_query("claims_merge_windows", _INGEST + "SELECT meeting_id, field, lower(text) AS key, count(*) OVER (PARTITION BY meeting_id, field) AS n FROM (SELECT DISTINCT meeting_id, field, lower(text) AS text FROM c)")
def claims_merge(spark, d):
    from pyspark.sql import Window

    from meetspark.operators.claims import ingest, merge_windows

    merged = merge_windows(ingest(_outputs(spark, d)))
    return merged.select("meeting_id", "field", F.lower("text").alias("key"), F.count("*").over(Window.partitionBy("meeting_id", "field")).alias("n"))


@_query("sink_report")
def report(spark, d):
    from meetspark.operators.claims import ingest, merge_windows, sections

    merged = merge_windows(ingest(_outputs(spark, d)))
    summary = segments(spark, d).where("idx = 0").select("meeting_id", F.col("text").alias("summary"))
    return sections(merged, summary).select("meeting_id", F.length("report").alias("n_chars"), F.md5("report").alias("digest"))


def _field_claims(spark, d) -> DataFrame:
    """A claim of every segment, over all fields: a segment's text, citing itself, a turn some way off, or nothing that exists."""
    fields = ["topics", "key_points", "requirements", "decisions", "action_items", "risks", "open_questions"]
    s = segments(spark, d)
    sid = lambda k: F.format_string("seg-%04d", F.col("idx") + k)
    ids = F.when(F.col("event_id") % 4 == 0, F.array(sid(1))).when(F.col("event_id") % 4 == 1, F.array(sid(2), sid(1), sid(30))).when(F.col("event_id") % 4 == 2, F.array(sid(3))).otherwise(F.array(F.lit("seg-9999")))
    return s.select(F.col("event_id").alias("claim_id"), "meeting_id", F.get(F.array(*map(F.lit, fields)), (F.col("idx") % 7).cast("int")).alias("field"), "text", F.lit("").alias("evidence"), ids.alias("ids"))


@_query("claims_local_evidence")
def claims_local_evidence(spark, d):
    from meetspark.operators.grounding import local_evidence

    return local_evidence(_field_claims(spark, d), segments(spark, d))


@_query("claims_best_window")
def claims_best_window(spark, d):
    from meetspark.operators.grounding import best_window

    return best_window(_field_claims(spark, d).where("field IN ('topics', 'key_points')"), segments(spark, d)).select("claim_id", "idx", F.round("support", 4).alias("support"))


@_query("claims_link")
def claims_link(spark, d):
    from meetspark.operators.grounding import link_claims

    linked = link_claims(_field_claims(spark, d), segments(spark, d))
    return linked.select("claim_id", "field", "status", F.array_join("ids", ",").alias("ids"), "cue_ok", "commitment", "repaired", "start_s", "end_s")


@_query("claims_summary")
def claims_summary(spark, d):
    from meetspark.operators.grounding import action_owner, grounded_summary, link_claims

    linked = link_claims(_field_claims(spark, d), segments(spark, d)).where("status = 'linked'")
    owned = linked.withColumn("owner", F.when(F.col("field") == "action_items", action_owner(F.lit(None).cast("string"), F.col("evidence"), F.col("speakers")))).withColumn("score", F.col("support"))
    return grounded_summary(owned)


@_query("fn_extract_json", _INGEST + ", w AS (SELECT DISTINCT meeting_id, idx % 3 AS w FROM seg) SELECT w.meeting_id, CAST(w.w AS INT) AS w, count(c.idx) FILTER (WHERE c.field = 'risks') AS n_risks FROM w LEFT JOIN c ON c.meeting_id = w.meeting_id AND c.w = w.w GROUP BY 1, 2")
def extract_json(spark, d):
    from meetspark.functions.jsontext import extract_json as salvage

    wrapped = F.when(F.col("window") == 0, F.col("output")).when(F.col("window") == 1, F.concat(F.lit("Here it is:\n```json\n"), "output", F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("```json\n"), "output", F.lit("\n```")))
    found = _outputs(spark, d).select("meeting_id", F.col("window").cast("int").alias("w"), salvage(wrapped).alias("json"))
    return found.select("meeting_id", "w", F.size(F.from_json(F.get_json_object("json", "$.risks"), "array<string>")).cast("long").alias("n_risks"))


_INTRO = cues.PATTERNS["introduction"].replace("'", "''")
_ROLE = cues.PATTERNS["role"].replace("'", "''")


@_query(
    "claims_introductions",
    f", i AS (SELECT *, regexp_extract(text, '{_INTRO}', 0, 'i') AS whole, regexp_extract(text, '{_INTRO}', 1, 'i') AS name FROM seg), r AS (SELECT *, regexp_extract(substr(text, strpos(text, whole) + length(whole)), '{_ROLE}', 1, 'i') AS role FROM i WHERE whole <> ''), "
    f"k AS (SELECT meeting_id, speaker, arg_max(struct_pack(name := name, role := role, seg_id := seg_id), idx) AS l FROM r WHERE role <> '' AND name <> '' AND lower(name) NOT IN ({', '.join(repr(n) for n in cues.NOT_NAMES)}) GROUP BY 1, 2) "
    "SELECT meeting_id, speaker, l.name AS name, lower(l.role) AS role, l.seg_id AS seg_id FROM k",
)
def introductions(spark, d):
    from meetspark.operators.recover import introductions as found

    return found(segments(spark, d)).withColumn("role", F.lower("role"))


@_query("claims_structural_topics")
def structural_topics(spark, d):
    from meetspark.operators.recover import structural_topics as found

    return found(segments(spark, d))


@_query("fn_clean_action_task")
def clean_action_task(spark, d):
    from meetspark.operators.recover import clean_action_task as task

    return segments(spark, d).select("meeting_id", "seg_id", task(F.col("text")).alias("task")).where("task <> ''")


@_query(
    "win_continuations",
    " SELECT a.meeting_id, a.idx, b.idx AS next_idx FROM seg a JOIN seg b ON b.meeting_id = a.meeting_id AND b.speaker = a.speaker AND b.start_s <= a.end_s + 15 AND (b.idx = a.idx + 1 OR (b.idx = a.idx + 2 AND EXISTS (SELECT 1 FROM seg c WHERE c.meeting_id = a.meeting_id AND c.idx = a.idx + 1 AND c.speaker = a.speaker AND c.start_s <= a.end_s + 15)))",
)
def continuations(spark, d):
    from meetspark.operators.recover import same_speaker_continuations

    return same_speaker_continuations(segments(spark, d))


# actions, assignments, pipeline -----------------------------------------------
@_query("claims_explicit_actions")
def explicit_actions(spark, d):
    from meetspark.operators.actions import ACTION, explicit_actions as found

    none = spark.createDataFrame([], "meeting_id long, idx int, task string, owner string, deadline string, commitment_status string, ids array<string>").select(*ACTION)
    return found(segments(spark, d), none).select("meeting_id", "idx", "task", "commitment_status", F.array_join("ids", ",").alias("ids"))


@_query("claims_role_assignments")
def role_assignments(spark, d):
    from meetspark.operators.actions import role_assignments as found

    return found(segments(spark, d)).select("meeting_id", "idx", "place", "role", "task", F.array_join("ids", ",").alias("ids"))


@_query("claims_pipeline")
def pipeline_run(spark, d):
    from meetspark.operators.pipeline import run

    return run(_outputs(spark, d), segments(spark, d)).select("meeting_id", "n_linked", "n_rejected", F.md5("summary").alias("summary"), F.md5("report").alias("report"))


@_query("agg_audio_audit", "SELECT split, count(DISTINCT meeting_id) AS n_meetings, count(DISTINCT project_group) AS n_groups, count(*) AS n_segments, round(sum(CASE WHEN duration > 0 AND NOT isnan(duration) THEN duration ELSE 0 END) / 3600, 6) AS hours, "
        "CAST(count_if(trim(coalesce(speaker_id, '')) = '') AS BIGINT) AS n_unknown FROM asr_segments GROUP BY split")
def audio_audit(spark, d):
    return corpora.audit_audio(table(spark, d, "asr_segments"))


@_query("set_chat_records", "SELECT example_id, md5(concat('Evidence:', chr(10), coalesce(relevant_transcript, ''), chr(10), chr(10), 'Question: ', coalesce(query, ''))) AS asked, md5(coalesce(answer, '')) AS answer FROM specific_queries")
def chat_records(spark, d):
    m = F.col("messages")
    return corpora.chat_records(table(spark, d, "specific_queries"), "Answer from the evidence.").select("example_id", F.md5(m[1]["content"]).alias("asked"), F.md5(m[2]["content"]).alias("answer"))


@_query("join_rename_speakers", "SELECT s.segment_id, s.idx, coalesce(r.full_name, s.speaker) AS speaker FROM speaker_segments s LEFT JOIN speaker_roster r ON r.meeting_id = s.meeting_id AND r.speaker_label = s.speaker")
def renamed_speakers(spark, d):
    names = table(spark, d, "speaker_roster").select("meeting_id", F.col("speaker_label").alias("speaker"), F.col("full_name").alias("name"))
    return alignment.rename_speakers(table(spark, d, "speaker_segments"), names).select("segment_id", "idx", "speaker")
