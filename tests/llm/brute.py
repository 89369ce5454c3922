"""Plain-Python versions of operators, written from the problem statements."""

from __future__ import annotations

import re
import unicodedata

from meetspark.llm import looks

HESITATION = re.compile(r"(uh+m*|u+m+|er+m*|ehm|a+h+|h+m+|mh+m+|mm+|mm+-hm+|uh+-(h)?uh+)$", re.I)
SOUND = (
    "door slams|applause|laughter|cough|coughs|laughing|inaudible|unintelligible|vocalsound|laughs|crosstalk|music|phone ringing|"
    "pause|disfmarker|laugh|sighs|sniff|background noise"
)


def spoken(text: str) -> list[str]:
    text = re.sub(r"\(\([^)]*\)\)|\{[^}\n]*\}|<[^>\n]*>|\*[a-zA-Z ]+\*", " ", text)
    text = re.sub(r"[\[(](?:%s)?\s*(?:\d+:\d\d(?::\d\d)?(?:[.,]\d+)?)?[\])]" % SOUND, " ", text, flags=re.I)
    out = []
    for token in text.split():
        if not any(unicodedata.category(c)[0] in "LN" for c in token):
            continue
        if HESITATION.match(token.strip(".,!?…;:")):
            continue
        out.append(token)
    return out


def said(text: str | None, people: list[tuple[str, str, str, str]]) -> list[tuple[str, str]]:
    """(speaker, what is said) in order; people: (speaker_label, agent, full_name, role)."""
    if not text:
        return []
    names: dict[str, str] = {x: "UNKNOWN" for x in ("unknown", "unknown speaker", "unidentified", "???")}
    for label, agent, full, role in people:
        n = int(label[-2:])
        first, last = full.split()
        for form in (
            label, f"SPEAKER_{n}", f"Speaker {n}", f"S{n}", f"Spk{n:02d}", role, full, first, f"{first[0]}. {last}", f"{last}, {first}",
            "".join(w[0] for w in role.split()), f"{first} ({role})", f"{role} ({agent})", f"{agent} ({role})", f"{label} ({role})",
            f"{full} [{label}]", f"{role} - {full}",
        ):
            names.setdefault(form.lower(), label)
    time = r"(\d+:\d\d(?::\d\d)?(?:[.,]\d+)?)"
    lines: list[tuple[str | None, str]] = []
    held = None
    raw = re.split(r"\r?\n", text)
    if len([x for x in raw if x.strip()]) == 1:
        raw = re.split(r"\s+(?=SPEAKER_\d+\s*:)", text.strip(), flags=re.I)
        if len(raw) > 1 and re.fullmatch(r"[\[(<]?%s[\])>]?(\s+-)?" % time, raw[0]):
            raw[:2] = [raw[0] + " " + raw[1]]
    for i, line in enumerate(raw):
        if re.fullmatch(r"\s*\d+\s*", line) and i + 1 < len(raw) and "-->" in raw[i + 1]:
            continue
        if "-->" in line:
            held = line.split("-->")[0].strip()
            continue
        if not line.strip():
            continue
        m = re.match(r"\s*(?:\[%s\]|\(%s\)|<%s>|(\d+:\d\d:\d\d(?:[.,]\d+)?)\s)\s*(?:-\s+)?" % (time, time, time), line)
        lines.append((next((g for g in m.groups() if g), None) if m else held, line[m.end() :] if m else line))
        held = None
    found: list[list] = []
    for at, line in lines:
        head, colon, rest = line.partition(":")
        who = names.get(" ".join(head.lower().split())) if colon else None
        if who:
            found.append([who, at, rest])
        elif found:
            found[-1][2] += "\n" + line
        else:
            found.append(["UNKNOWN", at, line])
    if found and all(at for _, at, _ in found):
        def seconds(at: str) -> float:
            total = 0.0
            for part in at.replace(",", ".").split(":"):
                total = total * 60 + float(part)
            return total

        found.sort(key=lambda x: seconds(x[1]))
    return [(who, words) for who, _, words in found]


def turns(text: str | None, people: list[tuple[str, str, str, str]]) -> list[tuple[str, int]]:
    out: list[list] = []
    for who, words in said(text, people):
        n = len(spoken(words))
        if n and out and out[-1][0] == who:
            out[-1][1] += n
        elif n:
            out.append([who, n])
    return [(w, n) for w, n in out]


def plain_words(text: str | None) -> list[str]:
    shown = looks.plain(text or "")
    return "".join(c if unicodedata.category(c)[0] in "LNM" else " " for c in shown).split()


def leaks(documents: list[tuple[int, str | None]], items: list[tuple[int, str | None]], span: int = 13) -> set[tuple[int, int]]:
    where: dict[tuple, set[int]] = {}
    for i, t in items:
        w = plain_words(t)
        for k in range(len(w) - span + 1):
            where.setdefault(tuple(w[k : k + span]), set()).add(i)
    out = set()
    for d, t in documents:
        w = plain_words(t)
        for k in range(len(w) - span + 1):
            out |= {(d, i) for i in where.get(tuple(w[k : k + span]), ())}
    return out


def words_in_order(text: str | None, people: list[tuple[str, str, str, str]]) -> list[str]:
    """The spoken words in order, in lower case, without punctuation."""
    return [w for _, x in said(text, people) for token in spoken(x) for w in re.findall(r"[^\W_]+(?:'[^\W_]+)*", token.lower())]


def longest_common(x: list[str], y: list[str]) -> int:
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(row[j] + 1 if a == b else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def same_across_splits(records: list[tuple[int, str | None, str | None]], people: list[tuple[str, str, str, str]]) -> set[tuple[int, int]]:
    """records: (record_id, split, transcript)."""
    own = [(i, (s or "").strip().lower(), words_in_order(t, people)) for i, s, t in records]
    out = set()
    for i, s, x in own:
        for j, t, y in own:
            if s == "train" and t in ("val", "validation", "test") and x and y:
                n = max(len(x), len(y))
                if 5 * min(len(x), len(y)) >= 4 * n and 5 * longest_common(x, y) >= 4 * n:
                    out.add((min(i, j), max(i, j)))
    return out
