"""How far a text reads like each of several languages: function words and typical letters."""

from __future__ import annotations

import re

#: Frequent function words by language. Fixed values.
WORDS = {
    "en": "the a an and or but of to in on at for from with by about as is are was were be been it its they them their we he she you i that this which who what when why how not no would will have has had could while although both over than them then there because before after should can did does do said my your our until if more most",
    "fr": "le la les un une des du de d l et ou mais dans sur pour par avec au aux ce cette ces qui que qu quoi dont est sont était ont a été être il elle ils elles on nous vous je ne pas plus se sa son ses leur leurs pourquoi avant après comme si très fait n s y lors moins",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber in im an am auf für von vom zu zum zur mit bei aus nach über ist sind war waren wird wurde wurden werden hat haben hatte dass weil wenn nicht kein noch erst auch nur es er sie wir ich ihr sich was wer warum wie um als schon sehr kann muss später bisher",
    "es": "el la los las un una unos unas de del y o pero en con por para a al que qué quien se su sus es son era fue ha han había ser está no ni más muy como porque cuando donde esta este esto ese lo le les nos yo ya todavía sobre según aunque hasta sin entre también",
    "pt": "o a os as um uma uns umas de do da dos das e ou mas em no na nos nas por para com ao à aos às que quem se seu sua seus suas é são era foi há ser está não nem mais muito como porque quando onde esta este isto esse lhe lhes eu já ainda sobre segundo embora até sem entre também pelo pela pediram",
    "it": "il lo la i gli le un uno una di del dello della dei degli delle e o ma in nel nella nei con per da dal dalla a al alla che chi si suo sua suoi sue è sono era fu ha hanno essere non né più molto come perché quando dove questa questo quello ne mi ci vi io già ancora su sul sulla secondo fino senza tra anche agli alle",
    "nl": "de het een en of maar in op voor van met bij uit naar over is zijn was waren wordt werd worden heeft hebben had dat die deze dit niet geen nog ook maar er zij wij ik je zich wat wie waarom hoe om als al zeer kan moet om te aan door",
    "pl": "i w na z do nie się że to jest o jak po co tak za od przez dla ale już być był była było są czy tylko ich jego jej który która które więc bardzo przed lub oraz",
    "sv": "och i att det som en på är av för med den till ett om han var de inte har vi jag från men så kan hade när hon man ska vid eller vad nu efter också",
    "tr": "ve bir bu da de için ile çok daha ne gibi ama en kadar olarak olan sonra göre değil mi mı ya o şu her hem ise",
}
#: Letters that are typical of a language. Fixed values.
LETTERS = {"fr": "èêàçîûœëï", "de": "ßäöü", "es": "ñ¿¡ó", "pt": "ãõ", "it": "òì", "pl": "łąęśżźćń", "sv": "å", "tr": "ğışı"}
#: Letters by script, for languages told apart by script alone.
SCRIPTS = {"cyrillic": ("Ѐ", "ԯ"), "greek": ("Ͱ", "Ͽ"), "arabic": ("؀", "ۿ"), "cjk": ("぀", "鿿"), "hangul": ("가", "힣")}
LANGS = [*WORDS, *SCRIPTS]

_BY_WORD: dict[str, list[tuple[int, float]]] = {}
for _n, _words in enumerate(WORDS.values()):
    for _w in set(_words.split()):
        _BY_WORD.setdefault(_w, []).append((_n, 1.0))
_BY_WORD = {w: [(n, 1.0 / len(own)) for n, _ in own] for w, own in _BY_WORD.items()}
_BY_LETTER = {c: LANGS.index(lang) for lang, cs in LETTERS.items() for c in cs}
_TOKEN = re.compile(r"[^\W\d_]+")
FUNCTION_WORDS = frozenset(_BY_WORD)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def profile(words: list[str]) -> list[float]:
    """For each of LANGS, the weight of its function words and letters per word."""
    found = [0.0] * len(LANGS)
    for w in words:
        for n, x in _BY_WORD.get(w, ()):
            found[n] += x
        if not w.isascii():
            for c in w:
                n = _BY_LETTER.get(c)
                if n is not None:
                    found[n] += 0.3
            first = w[0]
            for k, (low, high) in enumerate(SCRIPTS.values()):
                if low <= first <= high:
                    found[len(WORDS) + k] += 1.0
    total = max(1, len(words))
    return [x / total for x in found]
