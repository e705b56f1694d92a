"""Porter's 1980 stemming algorithm, written from its published rules."""

from __future__ import annotations

import re

# The published suffix tables (fixed values).
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(w: str) -> str:
    """c for consonants, v for vowels; y after a consonant is a vowel."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _vowel(w: str) -> bool:
    return "v" in _shape(w)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _swap(w: str, table: list[tuple[str, str]], least: int) -> str:
    for old, new in sorted(table, key=lambda x: -len(x[0])):
        if w.endswith(old):
            root = w[: len(w) - len(old)]
            return root + new if _measure(root) > least else w
    return w


def stem(w: str) -> str:
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2, 0), STEP3, 0)
    for end in sorted(STEP4, key=lambda x: -len(x)):
        if w.endswith(end):
            root = w[: -len(end)]
            if _measure(root) > 1 and (end != "ion" or root[-1:] in ("s", "t")):
                w = root
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if _measure(w) > 1 and _double(w) and w[-1] == "l" else w
