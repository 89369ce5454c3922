"""The cue library: named patterns and the Boolean columns made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meetspark.functions.text import clean_text

_TASK = (
    "check|circulate|confirm|contact|deliver|double[- ]check|email|follow up|include|prepare|provide|report back|review|revise|"
    "schedule|send|share|submit|update"
)
#: Patterns that ignore case. Fixed values.
PATTERNS = {
    "calibration": r"\b(?:digits?|microphone test|sound check|synchroni[sz]e|time them at the same time|turn the volume on|can you hear (?:me|that)|start all our meetings out that way)\b",
    "purpose": r"\b(?:agenda(?:\s+is)?|purpose of (?:today's|this) meeting|kick[- ]off meeting|(?:we(?:'re| are)|today we(?:'re| are))\s+(?:here to|meeting to|talking about|discussing|designing|going to discuss)|(?:meeting|discussion)\s+(?:is|was)\s+about|main (?:focus|topic)|focus(?:ed)? on)\b",
    "presentation": r"\b(?:going to|will|plan(?:s|ned)? to)\s+(?:present|give)\s+(?:a\s+)?(?:little\s+)?(?:talk|presentation)\b",
    "small_talk": r"\b(?:most frustrating meeting|remember you(?:'re| are) being recorded|so comfortable|great story|laughter|good trip|world record)\b",
    "conclusion": r"\b(?:argument can be made|central conclusion|in summary|key in terms|main takeaway|overall|reasonable point|the (?:argument|conclusion|main point)|therefore)\b",
    "decision": r"\b(agree(?:d)?|approv(?:e|ed)|chose|chosen|decid(?:e|ed)|final decision|go with|going with|keep|move forward|reject(?:ed)?|select(?:ed)?|settled|stick with|we(?:'ll| will))\b",
    "risk": r"\b(blocked|blocker|concern|delay(?:ed)?|dependency|issue|problem|risk|not confirmed|not ready|waiting for|worried)\b",
    "question": r"\?|\b(open question|not clear|not sure|still need to (?:decide|determine|find)|unresolved|whether|which|who|what|when|where|why|how)\b",
    "requirement": r"\b(?:budget|cost|must|need(?:s)? to|price|requirement|revenue|selling|supposed to be|target|aim(?:ing)? to|no more than|international scale)\b",
    "role": r"\b((?:project|product|programme|program) manager|industrial designer|marketing(?: (?:expert|executive|lead|manager))?|(?:user|future) interface|(?:software|hardware|design|engineering|technical|research|sales) (?:engineer|lead|manager|developer|designer|analyst)|facilitator|coordinator)\b",
    "introduction": r"\b(?:(?:hi[, ]+)?(?:and\s+)?i(?:'m| am)|my name is)\s+([A-Z][A-Za-z'-]{1,30})\b",
    "product_context": r"\b(?:device|design|market|product|remote(?: control)?|selling price|production cost|user[- ]friendly)\b",
    "setup_language": r"\b(?:am i supposed to be|camera|clip(?:ped)? on|headset|microphone|room setup|sit(?:ting)? down|stand(?:ing)? up|sound check|test recording)\b",
    "wrap_up": r"\b(?:before we wrap up|in ?between now and then|just to wrap up|next (?:meeting|stage)|follow[- ]up|before (?:the )?next meeting)\b",
    "non_followup": r"\b(?:check (?:if|whether) there(?:'s| is) (?:nothing|anything) else|check we(?:'ve| have) nothing else|turn (?:this|it|the .+?) (?:on|off)|wrap up|end (?:of )?the meeting|stop(?:ped)? the clock|watch the video back|present(?:ing)? (?:a|the) petition|call this meeting to order)\b",
    "non_action": r"(?:^|\b)(?:if (?:people|somebody|someone|they|we|you) (?:need|want)|wanna hear (?:this|that)|want to hear (?:this|that)|(?:button|link).{0,80}\b(?:say|says|which say)|send it through email you\s*(?:'re| are) thinking|(?:certainly|possibly|probably) provide\b|the chair\s*:\s*check what happened)\b",
    "negated_action": r"\b(?:cannot|can't|do not|don't|not going to|shouldn't|wouldn't|won't)\b.{0,80}\b(?:check|circulate|confirm|contact|deliver|email|follow up|include|prepare|provide|report back|review|revise|schedule|send|share|submit|update)\b",
    "past_activity": r"\b(?:what i did was|i (?:added|found|took|tried)|we (?:already |just )?(?:announced|ordered|provided)|has already|have already)\b",
    "first_person": r"\b(?:I(?:'ll| will| am going to)|let me)\b",
    "task_verb": r"\b(check|circulate|confirm|contact|deliver|double[- ]check|email|follow up|include|prepare|provide|report back|review|revise|revision|schedule|send|share|submit|update)\b",
    "direct_request": r"\b(?:please|can you|could you|will you|would you)\s+(?:" + _TASK + r")\b",
    "ask_to_task": r"\bask(?:ed|ing)? (?:me|us|you|him|her|them) to\s+(?:\w+\s+){0,3}(?:" + _TASK + r")\b",
    "pronoun_future": r"\b(?:we|he|she|they)(?:'ll| will)\s+(?:\w+\s+){0,2}(?:" + _TASK + r")\b",
    "suggestion": r"\b(?:you\s+(?:could(?: always)?|should|might(?: want to)?|need to)|(?:maybe\s+)?we\s+(?:can|could|should)|why don't we|it would be (?:a )?(?:good|helpful|useful) idea(?: for .{1,40}?)? to)\s+(?:\w+\s+){0,3}(?:" + _TASK + r")\b",
    "digest_question": r"\b(?:should we|do we need|not sure whether|still need to decide)\b",
}
#: Patterns in which case matters. Fixed values.
CASED = {
    "named_future": r"\b([A-Z][\w'-]+|SPEAKER_[A-Za-z0-9_-]+)\s+will\b",
    "direct_assignment": r"\b([A-Z][\w'-]+|SPEAKER_[A-Za-z0-9_-]+)[,:]\s+(?:please|can you|could you|will you|would you)\b",
}
#: Names no person has. Fixed values.
NOT_NAMES = ["a", "an", "he", "i", "it", "she", "that", "the", "they", "this", "we", "you"]


def java(name: str) -> str:
    return "(?iU)" + PATTERNS[name] if name in PATTERNS else "(?U)" + CASED[name]


def has(text: Column, name: str) -> Column:
    return F.regexp_like(text, F.lit(java(name)))


def with_cues(segments: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Add one Boolean column ``cue_<name>`` per cue, tested on the clean text. Null texts have no cue."""
    text = clean_text(F.col("text"))
    return segments.withColumns({f"cue_{n}": has(text, n) for n in names or [*PATTERNS, *CASED]})


def _with_task(text: Column, name: str) -> Column:
    """Whether a task verb stands between the start of the cue's first match and 140 characters behind its end."""
    at = F.regexp_instr(text, F.lit(java(name)))
    found = F.regexp_substr(text, F.lit(java(name)))
    reach = F.substring(text, at, F.length(found) + 140)
    return F.coalesce(found.isNotNull() & F.regexp_like(reach, F.lit(java("task_verb"))), F.lit(False))


def action_status(text: Column) -> tuple[Column, Column]:
    """(confirmed, suggested) follow-up; negated, housekeeping and descriptive turns are neither."""
    shown = clean_text(text)
    vetoed = has(shown, "negated_action") | has(shown, "non_followup") | has(shown, "non_action")
    future = _with_task(shown, "first_person") | _with_task(shown, "named_future") | _with_task(shown, "direct_assignment") | _with_task(shown, "pronoun_future")
    asked = has(shown, "direct_request") | has(shown, "ask_to_task") | has(shown, "suggestion")
    return ~vetoed & ~has(shown, "past_activity") & future, ~vetoed & asked
