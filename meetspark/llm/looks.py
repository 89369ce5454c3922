"""What characters look like: tables made by rule from the Unicode database."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

#: Letters of other scripts that look like a Latin letter, in pairs. Fixed values.
PAIRS = (
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԌG аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw үy ӏl ԚQ ԜW "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv αa ιi ρp υu γy ϲc ϳj ϹC ͿJ "
    "օo ոn սu հh ցg ՏS ՕO ᎪA ᏴB ᏟC ᎬE ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ "
    "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU ɡg ıi ɑa ⅠI ⅤV ⅩX ⅬL ⅭC ⅮD ⅯM ⅰi ⅴv ⅹx ⅼl ⅽc ⅾd ⅿm"
)
#: Letters whose capital form looks Latin, for comparisons that ignore case. Fixed values.
CASELESS = "вb кk мm нh тt βb εe ζz ηh κk μm τt χx ιi"
#: Characters without width besides those of category Cf. Fixed values.
NOTHING = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
#: Hyphens that look like the hyphen-minus. Fixed values.
HYPHENS = "‐‑"


@cache
def single() -> dict[str, str]:
    """character -> the one character, or '', it is written as."""
    table: dict[str, str] = {c: "-" for c in HYPHENS} | {p[0]: p[1] for p in PAIRS.split()}
    latin = dict(table)
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cs" or c in table:
            continue
        tag, _, rest = unicodedata.decomposition(c).rpartition("> ")
        if kind == "Zs" and c != " ":
            table[c] = " "
        elif kind == "Cf" or c in NOTHING or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            table[c] = ""
        elif kind == "Cc" and c not in "\t\n\r\x85":
            table[c] = ""
        elif tag in ("<wide", "<narrow", "<initial", "<medial", "<final", "<isolated") and " " not in rest:
            plain = chr(int(rest, 16))
            table[c] = latin.get(plain, plain)
        elif not tag and rest:
            base = unicodedata.normalize("NFD", c)
            if base[0] in latin and len(whole := unicodedata.normalize("NFC", latin[base[0]] + base[1:])) == 1:
                table[c] = whole
    return table


@cache
def joined() -> dict[str, str]:
    """joined letter -> the letters it is written as."""
    table = {}
    for code in [*range(0x132, 0x134), *range(0x2160, 0x2180), *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0xFB00, 0xFB18)]:
        tag, _, rest = unicodedata.decomposition(chr(code)).rpartition("> ")
        if tag == "<compat" and len(rest.split()) > 1:
            table[chr(code)] = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", chr(code)))
    return table


@cache
def bare() -> dict[str, str]:
    """character -> its base letter without accents; '' for the marks themselves and for Hangul."""
    table = {}
    for code in range(0x80, 0x30000):
        c = chr(code)
        if unicodedata.category(c) == "Mn" or 0x1100 <= code <= 0x11FF or 0xAC00 <= code <= 0xD7A3:
            table[c] = ""
        elif unicodedata.decomposition(c) and not unicodedata.decomposition(c).startswith("<"):
            base = unicodedata.normalize("NFD", c)[0]
            if base != c:
                table[c] = base
    return table


@cache
def caseless() -> dict[int, str]:
    """A table for str.translate: look-alikes and the kind of a space, for comparisons that ignore case."""
    return {ord(k): v for k, v in (single() | joined()).items()}


@cache
def after_lower() -> dict[int, str]:
    return {ord(p[0]): p[1] for p in CASELESS.split()}


def plain(text: str) -> str:
    """``text`` as it looks, in lower case and composed form."""
    if text.isascii():
        if not text.isprintable():
            text = text.translate(caseless())
        return text.lower()
    shown = unicodedata.normalize("NFC", text.translate(caseless())).translate(caseless())
    return unicodedata.normalize("NFC", shown.lower()).translate(after_lower())
