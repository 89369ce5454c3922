"""Scalar text functions as Column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Words dropped from content tokens. Fixed values.
STOPWORDS = (
    "a about actually all also an and anyway are as at be because but by can come could course did different do does doesn't don't "
    "even fine first for from get going guess had has have he her here him how i if i'm in is it it's just kind know like little make "
    "maybe me mean might more most much my no not of oh okay on one or our probably quite really right said say see she should so some "
    "something sort stuff sure take tell that that's the their them then there there's these they thing things think this time to try "
    "two very want was we well were what when where why will with would yeah yes you you're your"
).split()
#: Words dropped from retrieval terms. Fixed values.
TERM_STOPWORDS = "a an and are did do for from how in is it of on the that this to was were what when where which who why with".split()
#: Content tokens too general to be a theme. Fixed values.
GENERIC = (
    "agenda anyth anything approach area argument case comment connected data detail discussion domain example fact find focus idea "
    "information issue look meeting number observation operational people point prioritie problem project proposal question result "
    "sorry state story subject system talk term topic update way work"
).split()
#: Number words. Fixed values.
NUMBERS = dict(zip("one two three four five six seven eight nine ten".split(), map(str, range(1, 11))))
TOKEN = r"(?U)([\w']+)"


def _list(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def let(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made(value)``, where the plan holds ``value`` once, however often it is used, and a row works it out once."""
    return F.get(F.transform(F.array(value), lambda v: made(v)), F.lit(0))


def clean_text(value: Column) -> Column:
    """Null as '', runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"(?U)\s+", " "))


def clip(value: Column, default: float = 0.0) -> Column:
    """Cast to a number in [0, 1]; ``default`` where the cast fails."""
    number = value.try_cast("double")
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))
    return F.when(number.isNotNull(), inside).otherwise(F.lit(default))


def seconds(clock: Column) -> Column:
    """H:M:S(.f) in seconds."""
    part = F.split(clock, ":")
    return part[0].cast("double") * 3600 + part[1].cast("double") * 60 + part[2].cast("double")


def format_timestamp(value: Column) -> Column:
    """HH:MM:SS.ff; '' for null; negative times count as 0."""
    at = F.greatest(value, F.lit(0.0))
    minutes = F.floor(at / 60)
    text = F.format_string("%02d:%02d:%05.2f", F.floor(minutes / 60), minutes % 60, at - minutes * 60)
    return F.when(value.isNull(), F.lit("")).otherwise(text)


def tokens(text: Column) -> Column:
    """Word tokens with apostrophes, in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def normalize_content_token(token: Column) -> Column:
    """Drops ing from words over five letters, else a plural s from words over four."""
    return (
        F.when((F.length(token) > 5) & token.endswith("ing"), F.substring(token, F.lit(1), F.length(token) - 3))
        .when((F.length(token) > 4) & token.endswith("s") & ~token.endswith("ss"), F.substring(token, F.lit(1), F.length(token) - 1))
        .otherwise(token)
    )


def content_tokens(text: Column) -> Column:
    """Distinct normalised tokens without stop words; the stop words are tested before normalising."""
    kept = F.filter(tokens(clean_text(text)), lambda t: (F.length(t) > 1) & ~F.array_contains(_list(STOPWORDS), t))
    return F.array_distinct(F.transform(kept, normalize_content_token))


def terms(text: Column) -> Column:
    """Distinct retrieval terms: tokens without question and function words."""
    return F.array_distinct(F.filter(tokens(text), lambda t: ~F.array_contains(_list(TERM_STOPWORDS), t)))


def normalise_metric(text: Column) -> Column:
    """Lower case, punctuation as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def normalised_segment_text(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Shared share of the smaller of two token sets; 0 if one is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / smaller)


def lexical_score(query: Column, passage: Column) -> Column:
    """Share of the query's terms in the passage, and 0.15 more if it holds the whole query; 1 at most."""
    q, p = terms(query), terms(passage)
    share = F.size(F.array_intersect(q, p)) / F.greatest(F.size(q), F.lit(1))
    bonus = F.when(F.contains(F.lower(passage), F.lower(query)), F.lit(0.15)).otherwise(F.lit(0.0))
    return F.when((F.size(q) == 0) | (F.size(p) == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), share + bonus))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two vectors of one length; an error for different lengths."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length"))).otherwise(product)


def word_overlap_size(left: Column, right: Column) -> Column:
    """The largest k up to 12 for which the last k tokens of left are the first k of right."""
    a, b = tokens(left), tokens(right)
    most = F.least(F.size(a), F.size(b), F.lit(12))
    fits = F.filter(F.sequence(F.lit(12), F.lit(1), F.lit(-1)), lambda k: (k <= most) & (F.slice(a, F.size(a) - F.least(k, F.size(a)) + 1, k) == F.slice(b, 1, k)))
    return F.when(most == 0, F.lit(0)).otherwise(F.coalesce(F.get(fits, F.lit(0)), F.lit(0)))


def join_overlapping_text(left: Column, right: Column) -> Column:
    """Both texts with the shared words once; where words overlap, punctuation goes."""
    k = word_overlap_size(left, right)
    case = lambda t: F.regexp_extract_all(clean_text(t), F.lit(TOKEN), F.lit(1))
    rest = F.slice(case(right), k + 1, F.greatest(F.size(case(right)) - k, F.lit(0)))
    return F.when(k > 0, F.array_join(F.concat(case(left), rest), " ")).otherwise(clean_text(F.concat_ws(" ", left, right)))


def number_value(word: Column) -> Column:
    """one .. ten as digits; anything else as it is."""
    found = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    return F.coalesce(F.try_element_at(found, F.lower(word)), word)


def role_key(role: Column) -> Column:
    """Lower-case role; every marketing role is one."""
    plain = F.lower(clean_text(role))
    return F.when(plain.startswith("marketing "), F.lit("marketing")).otherwise(plain)


def normalise_role(role: Column) -> Column:
    return F.initcap(clean_text(role))


def meeting_domain(meeting_id: Column) -> Column:
    """The domain an id's prefix stands for."""
    committee = meeting_id.startswith("covid_") | meeting_id.startswith("education_")
    product = meeting_id.startswith("ES") | meeting_id.startswith("IS") | meeting_id.startswith("TS")
    return F.when(committee, "committee").when(product, "product").otherwise("academic")


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def quality_cap(low: Column, critical: Column) -> Column:
    """Transcript quality: 0.75, capped to 0.65 or 0.5 by coverage."""
    return F.when(critical, F.lit(0.50)).when(low, F.lit(0.65)).otherwise(F.lit(0.75))


def render_segment(seg_id: Column, start: Column, speaker: Column, text: Column) -> Column:
    """``[id] [time] speaker: text`` without the parts that are missing."""
    clock = F.when(start.isNotNull(), F.concat(F.lit(" ["), format_timestamp(start), F.lit("]"))).otherwise("")
    who = F.when(F.length(speaker) > 0, F.concat(F.lit(" "), speaker, F.lit(":"))).otherwise("")
    return F.trim(F.concat(F.lit("["), seg_id, F.lit("]"), clock, who, F.lit(" "), F.coalesce(text, F.lit(""))))


def f1(hits: Column, predicted: Column, gold: Column) -> Column:
    """Harmonic mean of precision and recall, 0 without hits."""
    return F.when(hits == 0, F.lit(0.0)).otherwise(2.0 * hits / (predicted + gold))
