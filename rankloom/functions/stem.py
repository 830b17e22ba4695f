"""The English (Porter2) stemmer, after its published definition."""

from __future__ import annotations

import re

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI = "cdeghkmnrt"
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
STAY = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = re.compile("[aeiouy][^aeiouy]").search(w, start)
        return m.end() if m else len(w)

    head = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = head if head is not None else after(0)
    return r1, after(r1)


def _short_end(w: str) -> bool:
    return bool(re.search("^[aeiouy][^aeiouy]$|[^aeiouy][aeiouy][^aeiouywxY]$", w))


def stem(word: str) -> str:
    """The stem of a lower-case word; words of two letters or fewer stay."""
    w = word.lstrip("'")
    if len(w) <= 2:
        return w
    if w in WHOLE:
        return WHOLE[w]
    w = re.sub("(^|[aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{VOWELS}]", w[:-2]):
        w = w[:-1]
    if w in STAY:
        return w
    for s in ("eedly", "eed"):
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + "ee"
            break
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                cut = w[: -len(s)]
                if re.search(f"[{VOWELS}]", cut):
                    w = cut
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(DOUBLES):
                        w = w[:-1]
                    elif _short_end(w) and len(w) <= r1:
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for s, t in STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + t
            break
    else:
        if w.endswith("ogi"):
            if len(w) - 3 >= r1 and w[-4:-3] == "l":
                w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in LI:
            w = w[:-2]
    for s, t in STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + t
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for s in STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2:
                w = w[: -len(s)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in "st":
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
