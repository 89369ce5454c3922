"""Broken prompt and response pairs (problem 4): a multi-label linear classifier on hashed n-grams and pair features."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from meetspark.llm import langs, looks
from meetspark.runtime import written

DEFECTS = ("empty", "truncated", "refusal", "copy", "wrong_language")
#: If several defects pass their threshold, the first of these counts.
ORDER = ("empty", "copy", "refusal", "wrong_language", "truncated")
#: Pairs the classifier is fitted on at most: those with the smallest hash of their texts.
TRAINING_PAIRS = 6_000
HASHED = 1 << 15
#: Different texts a word must stand in to count as a whole word.
KNOWN_FROM = 3

#: What is put in place of a response to make a synthetic empty one. Fixed values.
EMPTIED = (
    "", " ", "\n", "\t", "​", " ", "-", "--", "—", "?", "??", "...", "…", "*", "/", ".", "none", "null", "nil", "na", "n/a", "tbd", "tba", "tbc", "nan", "undefined", "empty",
    "unknown", "missing", "todo", "blank", "void", "no answer", "no response", "not available", "not applicable", "no data", "no output", "not answered", "answer missing", "nothing",
    "keine antwort", "keine angabe", "aucune réponse", "sans réponse", "sin respuesta", "sem resposta", "nessuna risposta",
)
WRAPS = ("{}", "{}", "{}", "[{}]", "({})", "<{}>", "{}.", "*{}*", '"{}"', "{}\n")
#: Parts that synthetic refusals are put together from, by language: openings, what the responder can't do, the act, and what ends it. Fixed values.
PARTS = {
    "en": (
        ["", "", "", "", "Sorry, ", "Sorry, but ", "I'm sorry, but ", "I am sorry, but ", "I apologise, but ", "I apologize, but ", "Unfortunately, ", "Unfortunately ", "Regrettably, ", "I'm afraid ", "Thanks, but ",
         "Thank you for asking, but ", "As a language model, ", "As an AI, ", "As an assistant, ", "Being a machine, ", "I understand, but "],
        ["I can't", "I cannot", "I can not", "I am unable to", "I'm unable to", "I am not able to", "I'm not able to", "I won't", "I will not", "I won't be able to", "I must decline to", "I have to decline to", "I decline to",
         "I refuse to", "I must refuse to", "I would prefer not to", "I'd prefer not to", "I would rather not", "I'd rather not", "I am not allowed to", "I'm not allowed to", "I am not permitted to", "I'm not in a position to",
         "I am not going to", "I don't want to", "I do not wish to", "I do not feel able to", "I don't feel comfortable to", "I am not authorised to", "it is not possible for me to", "it is impossible for me to", "it would be wrong for me to",
         "it isn't appropriate for me to", "we cannot", "we are unable to", "my rules don't let me", "my guidelines do not allow me to", "my instructions prevent me to"],
        ["answer", "respond to", "reply to", "comment on", "discuss", "talk about", "help with", "help you with", "assist with", "assist you with", "say anything about", "give an opinion on", "give details of", "share", "provide", "disclose",
         "reveal", "speak about", "go into", "address", "explain", "write about", "continue with", "summarise", "fulfil", "answer questions about", "share details of", "provide information on", "be of help with", "give an answer to"],
        ["that", "this", "it", "this question", "that question", "your question", "this request", "your request", "that request", "the request", "this matter", "such matters", "this topic", "this subject", "what was said", "this meeting",
         "this recording", "that information", "this information", "the {o}", "the {o} of {n}", "here", "anything of that kind"],
    ),
    "fr": (
        ["", "", "Désolé, ", "Désolée, mais ", "Je suis désolé, mais ", "Malheureusement, ", "Je regrette, mais ", "En tant qu'assistant, ", "En tant que modèle de langage, "],
        ["je ne peux pas", "je ne suis pas en mesure de", "il m'est impossible de", "je ne suis pas autorisé à", "je préfère ne pas", "je refuse de", "je ne souhaite pas", "je ne saurais"],
        ["répondre à", "commenter", "vous aider avec", "parler de", "discuter de", "donner un avis sur", "dire quoi que ce soit sur"],
        ["cette question", "cela", "cette demande", "ce sujet", "votre question", "votre demande", "ce point", "cette réunion"],
    ),
    "de": (
        ["", "", "Leider ", "Es tut mir leid, aber ", "Entschuldigung, aber ", "Bedauerlicherweise ", "Als Assistent ", "Als Sprachmodell "],
        ["ich kann", "ich darf", "ich möchte", "kann ich", "darf ich", "möchte ich"],
        ["diese Frage", "diese Anfrage", "Ihre Frage", "dazu", "hierzu", "darüber", "dabei", "zu diesem Thema"],
        ["nicht beantworten", "nichts sagen", "keine Auskunft geben", "nicht helfen", "leider nicht helfen", "nicht sprechen", "keine Antwort geben", "nicht weiterhelfen", "mich nicht äußern"],
    ),
    "es": (
        ["", "", "Lo siento, pero ", "Lo siento, ", "Lamentablemente, ", "Disculpe, pero ", "Como asistente, ", "Como modelo de lenguaje, "],
        ["no puedo", "no me es posible", "no estoy autorizado a", "no estoy en condiciones de", "prefiero no", "me niego a", "no quiero", "no debo"],
        ["responder a", "comentar", "ayudar con", "ayudarle con", "hablar de", "opinar sobre", "decir nada sobre"],
        ["esa pregunta", "esta pregunta", "eso", "esta solicitud", "su pregunta", "ese tema", "este asunto", "esta reunión"],
    ),
    "pt": (
        ["", "", "Desculpe, mas ", "Infelizmente, ", "Lamento, mas ", "Como assistente, ", "Como modelo de linguagem, "],
        ["não posso", "não consigo", "não estou autorizado a", "não me é possível", "prefiro não", "recuso-me a", "não quero"],
        ["responder a", "comentar", "ajudar com", "falar sobre", "opinar sobre", "dizer nada sobre"],
        ["essa pergunta", "esta pergunta", "isso", "este pedido", "a sua pergunta", "esse tema", "este assunto", "esta reunião"],
    ),
    "it": (
        ["", "", "Mi dispiace, ma ", "Purtroppo ", "Spiacente, ma ", "Come assistente, ", "Come modello linguistico, "],
        ["non posso", "non sono in grado di", "non sono autorizzato a", "preferisco non", "mi rifiuto di", "non mi è possibile", "non voglio"],
        ["rispondere a", "commentare", "aiutare con", "parlare di", "esprimermi su", "dire nulla su"],
        ["questa domanda", "questo", "questa richiesta", "la sua domanda", "quel tema", "questo argomento", "questa riunione"],
    ),
}
#: Refusals without a first person: what can't be had, and why. Fixed values.
NOBODY = (
    ["no comment", "no answer", "no opinion", "no information", "no statement", "no details", "a reply", "an answer"],
    ["can be given", "can be provided", "is possible", "will be given", "may be shared", "can't be given", "is not possible"],
    ["on this", "on that", "here", "on this matter", "to that question", "to this request", "about it", "on the {o}"],
)
BEYOND = (
    ["this", "that", "this question", "your question", "this request", "your request", "this topic", "such a request", "the subject"],
    ["is outside", "falls outside", "lies beyond", "goes beyond", "is not within", "isn't part of"],
    ["my scope", "what I can answer", "what I may discuss", "what I am allowed to say", "my permissions", "my role", "what I can help with", "what I may talk about", "the things I can answer"],
)
UNEASY = (
    ["I am not comfortable", "I'm not comfortable", "I am uneasy about", "I don't feel comfortable", "I do not feel comfortable", "I don't like", "I don't feel good about", "I feel uncomfortable", "I must avoid", "I have to avoid", "I would avoid", "I am not fond of"],
    ["answering", "discussing", "commenting on", "talking about", "sharing", "speaking about", "explaining", "giving an opinion on"],
    ["that", "this", "this topic", "such things", "what was said", "this question", "the {o}"],
)
#: What may stand behind a refusal. Fixed values.
BEHIND = ["", "", "", "", " Please ask somebody else.", " Please try another question.", " Can I do anything else for you?", " Please contact the organiser.", " I hope you understand.", " Thank you for understanding."]
#: Verbs that report what somebody said or did, put behind a name. Fixed values.
SAYS = ["said that", "answered that", "explained that", "replied that", "told {n} that", "admitted that", "felt that", "said", "wrote that", "noted that", "regretted that", "was sorry that"]
DOES = ["cannot", "could not", "can't", "couldn't", "is unable to", "was unable to", "was not able to", "is not able to", "will not", "would not", "won't", "refused to", "declined to", "has to decline to", "would rather not", "preferred not to",
        "was not allowed to", "is not allowed to", "is not permitted to", "did not want to", "does not wish to", "does not feel able to"]
ACTS = ["finish", "start", "test", "build", "order", "pay for", "sign", "approve", "deliver", "move", "change", "join", "support", "explain", "accept", "check", "present", "close", "share", "answer", "discuss", "comment on", "talk about", "help with"]
WHO = ["{n}", "{n}", "{n}", "the team", "they", "she", "he", "nobody", "the group", "{n} and {n}"]
OPEN = ["No decision was {d} on the {o}.", "Nothing was {d} about the {o}.", "Nothing was {d}.", "They did not agree on the {o}.", "It was left open who will {a} the {o}.", "The {o} was not {d}.", "It is not known when {n} will {a} the {o}.", "The {o} remains open."]
DECIDED = ["decided", "agreed", "settled", "taken", "fixed", "concluded"]
QUOTING = ['{n} called it "{q}".', '{n} said "{q}" to {n}.', 'The title was "{q}".', 'It was about "{q}", as {n} put it.', '{n} read out «{q}».', '{n} ended with "{q}".']
#: Lead-ins before a repeated question and before a good answer. Fixed values.
ECHOES = ["", "", "", "", "", "> ", "Q: ", "Question: ", "A: ", "Answer: ", "Re: ", "You asked: ", "The question was: ", "You want to know: ", "Your question is: ", "Let me repeat: "]
SHORT = ["{n}, from {n}", "the {o} {p}", "about {k} percent", "{k} euro", "No, only {n}", "On Monday in {n}", "{n} and the {o} team", "Yes", "No", "{n}", "in {m}", "by Friday", "roughly {k} people", "not yet", "because of the {o}", "to {a} the {o}", "at the {o}", "{k}"]
MONTHS = ["January", "March", "May", "July", "September", "November"]

_VISIBLE = re.compile(r"[^\W_]")
_END = re.compile(r"[.!?。？！][\"'»”’)\]]*$")
_NUMBER = re.compile(r"\d+")
_SENTENCE = re.compile(r"""(?:["“«„][^"”»“]*["”»“]|[^.!?。？！"“«„]|[.!?。？！]+(?!["'»”’)\]\s.!?。？！]|$)|["“«„])+[.!?。？！]*["'»”’)\]]*""")
_NAME = re.compile(r"(?<=[\w,;:'\"] )[A-ZÀ-Þ][^\W\d_]*")
_PART = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[^\w\s]")
_LETTERS = re.compile(r"[^\W\d_]+")
_WORDS = re.compile(r"[^\W_]+")
_QUOTED = re.compile(r'"[^"]{2,}"|“[^”]{2,}”|«[^»]{2,}»|„[^“”]{2,}[“”]')
_MARKS = re.compile(r'["“«„]')
_SHELL = " \t\r\n[](){}<>*_\"'.!-—–"
_TAIL = r"(\p{L}++)\s*$"


@dataclass
class Model:
    """Weights (a row per feature) and thresholds of the classifier."""

    weights: np.ndarray
    bias: np.ndarray
    thresholds: np.ndarray


class _Hashes(dict):
    """part of a text -> its 64-bit hash."""

    def __missing__(self, part: str) -> int:
        if len(self) > 300_000:
            self.clear()
        data = part.encode("utf-8", "surrogatepass")
        found = self[part] = zlib.crc32(data) << 32 | zlib.crc32(data, 0x9E3779B9)
        return found


_HASHES = _Hashes()
DENSE = 31


def _plain(text: str) -> str:
    return " ".join(_WORDS.findall(text.lower()))


@lru_cache(50_000)
def _asked(query: str) -> tuple[str, frozenset[str], tuple[float, ...]]:
    """Plain words of a query, the set of its letter words and its language profile without names."""
    q = looks.plain(query)
    return _plain(q), frozenset(langs.tokens(q)), tuple(langs.profile(langs.tokens(_NAME.sub(" ", query.strip()))))


def shown(response: str | None) -> str:
    """A response in one stored form, its invisible characters gone."""
    text = response or ""
    return text if text.isascii() else unicodedata.normalize("NFC", text.translate(looks.caseless()))


def dense(query: str | None, response: str | None, tail_known: bool) -> list[float]:
    """Pair features of a query and its response; null counts as empty.

    tail_known: whether the last word of the response stands in other texts too.
    """
    plain_q, b, theirs = _asked(query or "")
    raw = shown(response)
    text = raw.strip()
    lower = text.lower()
    words = _LETTERS.findall(lower)
    n = len(words)
    visible = bool(_VISIBLE.search(lower))
    end, dots = bool(_END.search(text)), text.endswith(("...", "…"))
    last = text[-1:]
    quotes = bool(_MARKS.search(text))
    a = set(words)
    common = len(a & b)
    covered, inside = common / max(1, len(b)), common / max(1, len(a))
    plain_r = _plain(lower if lower.isascii() else looks.plain(raw))
    whole = bool(plain_q) and plain_q in plain_r
    left = len((plain_r.replace(plain_q, " ") if whole else plain_r).split())
    other = mine = 0.0
    if n and max(theirs) > 0:
        own = langs.profile(_LETTERS.findall(_NAME.sub(" ", _QUOTED.sub(" ", text) if quotes else text).lower()))
        k = theirs.index(max(theirs))
        mine = own[k]
        own[k] = 0.0
        other = max(own)
    ends_word = last.isalpha() and not end
    tail = text[-(len(words[-1])) :] if ends_word and words else ""
    inner = len(lower.strip(_SHELL))
    return [
        not visible, end and not dots, dots, last in (",", "(", ":", ";", "-", "–", "[", "{", "/", "&") if last else 0, raw[-1:] == "\n",
        text.count("(") != text.count(")") or text.count('"') % 2 or text.count("«") != text.count("»") or text.count("„") > text.count("“"),
        n <= 1, 2 <= n <= 4, 5 <= n <= 8, n > 8, covered, inside, whole, whole and left <= 5, whole and not left, covered > 0.85 and inside > 0.6, covered * inside,
        other - mine, other - mine > 0.05, other - mine > 0.05 and n >= 4, mine, other, mine == 0 and n >= 4 and max(theirs) > 0,
        bool(words) and words[-1] in langs.FUNCTION_WORDS and ends_word, ends_word and tail.islower() and not tail_known, ends_word and tail[:1].isupper(),
        not end and n > 4, not end and text[:1].isupper() and n > 2, visible and n == 0, visible and inner <= 2 and inner < len(text), text.isupper() and n <= 3,
    ]


def sentences(response: str | None) -> list[str]:
    """The sentences of a response, each to be judged for a refusal; none is cut within quotation marks."""
    return [x for x in (m[0].strip() for m in _SENTENCE.finditer(response or "")) if _VISIBLE.search(x)]


def _parts(text: str) -> list[int]:
    """Hashes of the words and marks of a text; names (capital letter within it) and numbers are all the same.

    A text of four words at most has its words as three more, so that they count as a whole.
    """
    found = _PART.findall(_NUMBER.sub("9", _NAME.sub("N", text)).lower())
    words = [p for p in found if p[0].isalnum()] or found
    if len(words) <= 4:
        found += [f"{mark} {' '.join(words)}" for mark in ("=", "==", "===")]
    return [_HASHES[p] for p in found]


def _said(sentence: str) -> str:
    """A sentence without what it quotes, unless all of it is quoted."""
    if not _MARKS.search(sentence):
        return sentence
    bare = _QUOTED.sub(" Q ", sentence)
    return bare if len(bare.replace("Q", "").split()) > 1 else sentence


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _grams(units: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of one to three parts, all units in a row, and where each unit begins.

    Each unit is closed off by its own edges, so its first and last parts are n-grams of their own.
    """
    edge = [1]
    flat = np.array([x for u in units for x in (*edge, *u, *edge)], dtype=np.uint64)
    size = np.array([len(u) + 2 for u in units], dtype=np.int64)
    unit = np.repeat(np.arange(len(units)), size)
    found, owner = [], []
    for k in (1, 2, 3):
        m = len(flat) - k + 1
        if m <= 0:
            break
        h = np.zeros(m, dtype=np.uint64)
        for i in range(k):
            h = (h ^ flat[i : i + m]) * _MIX[i]
            h ^= h >> np.uint64(29)
        same = unit[:m] == unit[k - 1 :]
        found.append((h[same] >> np.uint64(20)).astype(np.int64) % HASHED)
        owner.append(unit[:m][same])
    h, o = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(o, kind="stable")
    starts = np.searchsorted(o[order], np.arange(len(units)))
    return h[order], starts


def _summed(weights: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each unit the weights of its n-grams, by the root of their number."""
    size = np.diff(np.append(starts, len(grams)))
    return np.add.reduceat(weights[grams], starts) / np.sqrt(size)[:, None]


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


REFUSAL = DEFECTS.index("refusal")
#: From this score of the first fit on, a sentence of the corpus isn't used as an example of a good one.
UNSURE = 0.4
#: Sentences of the corpus that are the same but for names and numbers are used as examples so often.
ALIKE = 10


def scores(model: Model, pairs: list[tuple[str | None, str | None, bool]]) -> np.ndarray:
    """A score for each pair and defect.

    A refusal is judged by the n-grams of each sentence, the largest score
    counts; everything else by the n-grams of the whole response and the pair.
    """
    if not pairs:
        return np.empty((0, len(DEFECTS)))
    texts = [shown(r) for _, r, _ in pairs]
    x = np.array([dense(*p) for p in pairs], dtype=float)
    out = _probability(_summed(model.weights, *_grams([_parts(t) for t in texts])) + x @ model.weights[HASHED:] + model.bias)
    out[:, REFUSAL] = 0
    owner, units = [], []
    for i, t in enumerate(texts):
        for s in sentences(t):
            owner.append(i)
            units.append(_parts(_said(s)))
    if units:
        z = _summed(model.weights[:, REFUSAL : REFUSAL + 1], *_grams(units))[:, 0] + model.bias[REFUSAL]
        np.maximum.at(out[:, REFUSAL], owner, _probability(z))
    return out


class _Maker:
    """Synthetic good and broken pairs, put together from pairs of the corpus and the parts above."""

    def __init__(self, pairs: list[tuple[str, str]], seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.rows: list[tuple[str, str, int]] = []  # whole responses; -1: fine
        self.units: list[tuple[str, int]] = []  # sentences; 1: a refusal, 0: none, -1: none as far as is known
        self.good = []
        for q, r in pairs:  # only pairs that show no sign of a defect stand for good ones
            p, s = _plain(q), _plain(r)
            if not p or not s or p in s or not _END.search(r.strip()) or r.strip().endswith(("...", "…")):
                continue
            ours, theirs = langs.profile(langs.tokens(r)), langs.profile(langs.tokens(q))
            if len(s.split()) >= 5 and ours.index(max(ours)) != theirs.index(max(theirs)):
                continue
            self.good.append((q, r, theirs.index(max(theirs))))
        self.by_lang: dict[int, list[str]] = {}
        for _, r, lang in self.good:
            self.by_lang.setdefault(lang, []).append(r)
        self.nouns = sorted({w for q, _, lang in self.good for w in q.rstrip(" ?.!").split() if lang == 0 and w.isalpha() and w.islower() and len(w) > 3 and w not in langs.FUNCTION_WORDS}) or ["plan"]
        self.names = sorted({w.strip(" ?.!,") for q, _, _ in self.good for w in q.split()[1:] if w[:1].isupper()}) or ["Anna"]

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, one_in: int) -> bool:
        return int(self.rng.integers(one_in)) == 0

    def filled(self, pattern: str) -> str:
        one = {
            "n": lambda: self.pick(self.names), "o": lambda: self.pick(self.nouns), "p": lambda: self.pick(self.nouns), "m": lambda: self.pick(MONTHS), "a": lambda: self.pick(ACTS),
            "k": lambda: str(self.rng.integers(2, 999)), "d": lambda: self.pick(DECIDED),
        }
        return re.sub(r"\{([nopmakd])\}", lambda m: one[m[1]](), pattern)

    def core(self, lang: str) -> str:
        """What a refusal says, without its opening."""
        if lang == "en" and self.chance(4):
            said = " ".join(self.pick(p) for p in self.pick([NOBODY, BEYOND, UNEASY]))
        else:
            said = " ".join(self.pick(p) for p in PARTS[lang][1:])
            if self.chance(8) and lang == "en":
                said = f"{self.pick(PARTS['en'][1])} {self.pick(['answer', 'help', 'respond', 'comment', 'say', 'go on', 'continue', 'do that', 'do this'])}"
        return self.filled(said)

    def refusal(self, lang: str) -> str:
        said = self.pick(PARTS[lang][0]) + self.core(lang)
        return said[:1].upper() + said[1:] + self.pick([".", ".", ".", "!", ""])

    def other_person(self, said: str) -> str:
        """What somebody says of themselves, told about them."""
        who, be = self.pick([("they", "are"), ("she", "is"), ("he", "is"), ("the team", "is")])
        swap = {"I": who, "we": who, "I'm": f"{who} {be}", "I'd": f"{who} would", "am": be, "me": "them", "my": "their", "your": "the", "you": "them"}
        return " ".join(swap.get(w, w) for w in said.split())

    def reported(self) -> str:
        """Somebody else's refusal, an open matter or a foreign quotation: fine as an answer."""
        kind = int(self.rng.integers(5))
        if kind == 0:
            return self.filled(self.pick(OPEN))
        if kind == 1:
            langs_here = [k for k in self.by_lang if k]
            words = self.pick(self.by_lang[self.pick(langs_here)]).rstrip(".!?").split() if langs_here else ["ad", "hoc"]
            at = int(self.rng.integers(max(1, len(words) - 3)))
            return self.filled(self.pick(QUOTING).replace("{q}", " ".join(words[at : at + int(self.rng.integers(2, 6))]).replace('"', "")))
        who = self.pick(WHO)
        if kind == 2:
            said = f"{who} {self.pick(['said', 'replied', 'answered', 'wrote'])}{self.pick(['', ',', ':'])} \"{self.refusal('en')}\"{self.pick(['', ' to {n}', ' when {n} asked', ' before {m}'])}."
        elif kind == 3:
            said = f"{who} {self.pick(SAYS)} {self.other_person(self.core('en'))}."
        else:
            said = f"{who} {self.pick(DOES)} {self.pick(ACTS)} the {{o}}{self.pick(['', ' of {n}', ' before {m}', ', so {n} has to wait', ' because {n} was away', ' until the {p} arrives', ' in {n}'])}."
        said = self.filled(said)
        return said[:1].upper() + said[1:]

    def broken_off(self, r: str) -> str | None:
        """A response cut somewhere, within a word or behind one."""
        spots = [m.end() for m in re.finditer(r"\S+", r)][1:-1]
        if len(r.split()) <= 6 or not spots:
            return None
        if self.chance(5):
            piece = r[: int(self.rng.integers(max(2, len(r) // 8), max(3, len(r) - 4)))].rstrip(" .,;")
        else:
            piece = r[: self.pick(spots)].rstrip(".") + self.pick(["", "", "...", " (", "\n"])
        return piece if not _END.search(piece.strip()) or piece.endswith("...") else None

    def make(self) -> None:
        foreign = list(PARTS)  # in the order of langs.LANGS
        for q, r, lang in self.good:
            self.rows.append((q, r, -1))
            self.units += [(s, -1) for s in sentences(r)]
            if lang == 0 and self.chance(2):
                own = self.reported()
                self.rows.append((q, own if self.chance(2) else f"{r} {own}", -1))
                self.units += [(s, 0) for s in sentences(own)]
            if self.chance(2):
                short = self.filled(self.pick(SHORT)) + self.pick(["", "."])
                self.rows.append((q, short, -1))
                self.units.append((short, 0))
            if self.chance(6) and r[-1:] == "." and lang == 0:
                self.rows.append((q, f"{r[:-1]} ({self.filled(self.pick(SHORT))}).", -1))
            if len(r.split()) <= 6:
                self.rows.append((q, r.rstrip(" ."), -1))
            if self.chance(8):  # a long good answer
                self.rows.append((q, " ".join(self.pick(self.by_lang[lang]) for _ in range(int(self.rng.integers(2, 7)))), -1))
            piece = self.broken_off(r)
            if piece:
                self.rows.append((q, piece, DEFECTS.index("truncated")))
                self.units += [(s, -1) for s in sentences(piece)]
            if not self.chance(4):
                told = foreign[lang] if lang < len(foreign) and self.chance(2) else self.pick(foreign) if self.chance(2) else "en"
                self.units.append((self.refusal(told), 1))
                if told != "en":  # as many good sentences of that language, where the corpus has any
                    self.units += [(s, -1) for s in sentences(self.pick(self.by_lang.get(foreign.index(told)) or [r]))]
                rest = self.pick(BEHIND)
                self.units += [(s, 0) for s in sentences(rest)]
            if self.chance(2) and lang == 0:
                self.units += [(s, 0) for s in sentences(self.reported())]
            if self.chance(3):
                told = self.pick([q, q, q.upper(), q.lower(), f'"{q}"', q.rstrip(" ?.!"), q.rstrip("?.!") + self.pick(["!", "...", " ...", "."]), f"{q} {q}", f"  {q}\n", q.replace(" ", "  "), f"{q}​"])
                self.rows.append((q, self.pick(ECHOES) + told, DEFECTS.index("copy")))
            others = [x for x in self.by_lang if x != lang]
            if others and self.chance(2) and len(r.split()) >= 4:
                swapped = self.pick(self.by_lang[self.pick(others)])
                if len(swapped.split()) >= 5:
                    self.units += [(s, -1) for s in sentences(swapped)]
                    self.rows.append((q, swapped, DEFECTS.index("wrong_language")))
            if self.chance(2):
                gone = self.pick(EMPTIED)
                if gone.strip():
                    gone = self.pick(WRAPS).format(self.pick([gone, gone, gone.upper(), gone.capitalize()]))
                self.units += [(s, 0) for s in sentences(gone)]
                self.rows.append((q, gone, DEFECTS.index("empty")))


def _descend(weights: np.ndarray, bias: np.ndarray, columns: list[int], grams: np.ndarray, starts: np.ndarray, x: np.ndarray, labels: np.ndarray, passes: int = 14) -> None:
    """Logistic regression of ``columns`` by AdaGrad over hashed and dense features, in place."""
    rng = np.random.default_rng(4)
    n = len(starts)
    size = np.diff(np.append(starts, len(grams)))
    scale = 1 / np.sqrt(size)[:, None]
    w, g = np.zeros((len(weights), len(columns))), np.full((len(weights), len(columns)), 1e-2)
    b, gb = np.full(len(columns), -2.0), np.full(len(columns), 1e-2)
    for _ in range(passes):
        for batch in np.array_split(rng.permutation(n), max(1, n // 256)):
            own = size[batch]
            at = grams[np.repeat(starts[batch], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)]
            z = np.add.reduceat(w[at], np.cumsum(own) - own) * scale[batch] + x[batch] @ w[HASHED:] + b
            error = (_probability(z) - labels[batch]) / len(batch)
            used, place = np.unique(at, return_inverse=True)
            grad = np.zeros((len(used), len(columns)))
            np.add.at(grad, place, np.repeat(error * scale[batch], own, axis=0))
            grad += 5e-5 * w[used]
            g[used] += grad * grad
            w[used] -= 0.3 * grad / np.sqrt(g[used])
            grad = x[batch].T @ error + 2e-5 * w[HASHED:]
            g[HASHED:] += grad * grad
            w[HASHED:] -= 0.3 * grad / np.sqrt(g[HASHED:])
            gb += error.sum(0) ** 2
            b -= 0.3 * error.sum(0) / np.sqrt(gb)
    weights[:, columns], bias[columns] = w, b


def _threshold(given: np.ndarray, labels: np.ndarray) -> float:
    """The threshold with the best F1 on held-out synthetic examples, in the middle of its plateau."""
    steps = np.linspace(0.05, 0.95, 91)
    f1 = [2 * ((given >= t) & labels).sum() / max(1, (given >= t).sum() + labels.sum()) for t in steps]
    best = steps[np.array(f1) >= max(f1) - 2e-3]
    return float(best[len(best) // 2])


def pairs(queries: DataFrame, predictions: DataFrame) -> DataFrame:
    """(field, pair_key, query, response, tail) of both tables; tail is the last word of a response that doesn't end its sentence."""
    a = queries.select(F.lit("answer").alias("field"), F.col("example_id").alias("pair_key"), "query", F.col("answer").alias("response"))
    b = predictions.select(F.lit("prediction").alias("field"), F.col("prediction_id").alias("pair_key"), "query", F.col("prediction").alias("response"))
    return a.unionAll(b).where(F.col("pair_key").isNotNull()).withColumn("tail", _tail(F.col("response")))


def _tail(response: Column) -> Column:
    found = F.lower(F.regexp_extract(response, _TAIL, 1))
    return F.when(found != "", found)


def known_words(data: DataFrame) -> DataFrame:
    """(word): the words that stand in KNOWN_FROM texts or more, counted over all pairs and without the last word of a response."""
    text = F.lower(F.concat_ws(" ", F.regexp_replace("response", r"\S+\s*$", ""), "query"))
    words = data.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\p{L}]+)"), F.lit(1)))).alias("word"))
    return words.groupBy("word").count().where(F.col("count") >= KNOWN_FROM).select("word")


def train(data: DataFrame, known: DataFrame, sample: int = TRAINING_PAIRS, seed: int = 4) -> Model:
    """Fit the classifier on at most ``sample`` different pairs, chosen by hash, and calibrate its thresholds.

    A fifth of the synthetic examples is held out for the thresholds. Without
    any usable pair it is fitted on the built-in parts alone.
    """
    usable = data.where((F.length("response") > 0) & F.col("query").isNotNull()).withColumn("h", F.xxhash64("query", "response"))
    least = usable.select("h").distinct().orderBy("h").limit(sample)
    chosen = usable.join(F.broadcast(least), "h", "left_semi").groupBy("h", "query", "response").count().toPandas().sort_values(["h", "query", "response"])[:sample]
    given = list(zip(chosen["query"], chosen["response"])) or [
        ("What was decided on the plan?", "They decided to keep the plan of Anna."), ("Que pensait Anna du plan ?", "Anna pensait que le plan était trop cher et qu'il fallait attendre."),
    ]
    made = _Maker(given, seed)
    made.make()
    rows = made.rows or [(q, r, -1) for q, r in given]
    units = made.units or [(r, 0) for _, r in given]
    spark = data.sparkSession
    tails = {m[0].lower() for m in (_LETTERS.search(r.rstrip()[::-1]) for _, r, _ in rows) if m} and {r.rstrip().lower() for _, r, _ in rows}
    tails = sorted({m[1] for m in (re.search(r"([^\W\d_]+)$", t) for t in tails) if m})  # one a synthetic row at most
    whole = set()
    if tails:
        asked = spark.createDataFrame([(t,) for t in tails], "word string")
        whole = {r[0] for r in known.join(F.broadcast(asked), "word", "left_semi").collect()}
    tail_of = lambda r: (re.search(r"([^\W\d_]+)$", r.rstrip().lower()) or [None, None])[1]
    weights, bias = np.zeros((HASHED + DENSE, len(DEFECTS))), np.full(len(DEFECTS), -2.0)
    x = np.array([dense(q, r, tail_of(r) in whole) for q, r, _ in rows], dtype=float)
    own = [k for k in range(len(DEFECTS)) if k != REFUSAL]
    labels = np.zeros((len(rows), len(DEFECTS)))
    for i, (_, _, k) in enumerate(rows):
        if k >= 0:
            labels[i, k] = 1

    def part(examples, chosen: np.ndarray):
        return _grams([examples[i] for i in chosen])

    def fit(examples: list[list[int]], columns: list[int], x: np.ndarray, labels: np.ndarray) -> None:
        held = np.arange(len(examples)) % 5 == 0
        use, rest = np.flatnonzero(~held), np.flatnonzero(held)
        if len(use):
            _descend(weights, bias, columns, *part(examples, use), x[use], labels[use][:, columns])
        found = _probability(_summed(weights, *part(examples, rest)) + x[rest] @ weights[HASHED:] + bias)
        for k in columns:
            thresholds[k] = _threshold(found[:, k], labels[rest, k] > 0)

    thresholds = np.full(len(DEFECTS), 0.5)
    fit([_parts(shown(r)) for _, r, _ in rows], own, x, labels)
    # the corpus holds refusals itself: sentences that the first fit takes for one are left out of the second
    parts, seen = [(_parts(_said(shown(u))), k) for u, k in units], Counter()
    units = []
    for p, k in parts:
        seen[tuple(p), k] += 1
        if k >= 0 or seen[tuple(p), k] <= ALIKE:
            units.append((p, k))
    for _ in range(2):
        said, none = np.zeros((len(units), len(DEFECTS))), np.zeros((len(units), DENSE))
        said[:, REFUSAL] = [k > 0 for _, k in units]
        parts = [p for p, _ in units]
        fit(parts, [REFUSAL], none, said)
        likely = _probability(_summed(weights, *_grams(parts)) + bias)[:, REFUSAL]
        units = [u for u, p in zip(units, likely) if u[1] >= 0 or p < UNSURE]
    return Model(weights, bias, thresholds)


def flagged(data: DataFrame, model: Model) -> DataFrame:
    """(field, pair_key, defect) of each pair with a score above a threshold; at most one defect each.

    ``data`` has field, pair_key, query, response and tail_known. Every pair is scored.
    """
    sent = data.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        order = [DEFECTS.index(x) for x in ORDER]
        for batch in batches:
            if not len(batch):
                continue
            text = lambda x: x if isinstance(x, str) else None
            passed = scores(own, [(text(q), text(r), bool(k)) for q, r, k in zip(batch["query"], batch["response"], batch["tail_known"])]) >= own.thresholds
            found = np.array([*DEFECTS, None], dtype=object)[np.where(passed[:, order].any(1), np.array(order)[passed[:, order].argmax(1)], len(DEFECTS))]
            out = batch[["field", "pair_key"]].assign(defect=found)
            yield out[out["defect"].notna()]

    return data.select("field", "pair_key", "query", "response", "tail_known").mapInPandas(scan, "field string, pair_key string, defect string")


def p4_found(queries: DataFrame, predictions: DataFrame) -> DataFrame:
    """(field, pair_key, defect) of each broken pair.

    A null query or response counts as an empty text. Repeated rows give one
    row. Empty tables give no rows; pairs with a null key are left out.
    """
    data = pairs(queries, predictions)
    known = written(known_words(data), "known")
    model = train(data, known)
    # only unfinished responses ask for their last word; the others don't take part in the join
    open_ended = data.where(F.col("tail").isNotNull()).join(known.withColumnRenamed("word", "tail").withColumn("found", F.lit(True)), "tail", "left")
    asked = open_ended.withColumn("tail_known", F.coalesce("found", F.lit(False))).drop("found").unionByName(data.where(F.col("tail").isNull()).withColumn("tail_known", F.lit(False)))
    return flagged(asked, model).distinct()
