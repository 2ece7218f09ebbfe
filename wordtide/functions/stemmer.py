"""The suffix-stripping stemmer of Porter (1980) for English words."""

from __future__ import annotations

import re
from functools import lru_cache

_C, _V = "[^aeiou]", "[aeiouy]"
_CC, _VV = f"{_C}[^aeiouy]*", f"{_V}[aeiou]*"
_M0 = re.compile(f"^({_CC})?{_VV}{_CC}")
_M1 = re.compile(f"^({_CC})?{_VV}{_CC}({_VV})?$")
_M2 = re.compile(f"^({_CC})?{_VV}{_CC}{_VV}{_CC}")
_VOWEL = re.compile(f"^({_CC})?{_V}")
_SHORT = re.compile(f"^{_CC}{_V}[^aeiouwxy]$")

_STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", bli="ble", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble", logi="log")
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = re.compile(r"^(.+?)(al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ou|ism|ate|iti|ous|ive|ize|(?<=[st])ion)$")
_BY_LENGTH = [sorted(s, key=len, reverse=True) for s in (_STEP2, _STEP3)]


def _mapped(w: str, suffixes: list[str], to: dict[str, str]) -> str:
    for s in suffixes:
        if w.endswith(s):
            head = w[: -len(s)]
            return head + to[s] if _M0.match(head) else w
    return w


@lru_cache(1 << 16)
def stem(w: str) -> str:
    """The stem of a lower-case word."""
    if len(w) < 3:
        return w
    y = w[0] == "y"
    if y:
        w = "Y" + w[1:]
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _M0.match(w[:-3]) else w
    else:
        for s in ("ed", "ing"):
            if w.endswith(s):
                head = w[: -len(s)]
                if _VOWEL.match(head):
                    w = head
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif re.search(r"([^aeiouylsz])\1$", w):
                        w = w[:-1]
                    elif _SHORT.match(w):
                        w += "e"
                break
    if w.endswith("y") and _VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    w = _mapped(w, _BY_LENGTH[0], _STEP2)
    w = _mapped(w, _BY_LENGTH[1], _STEP3)
    if (m := _STEP4.match(w)) and _M2.match(m[1]):
        w = m[1]
    if w.endswith("e"):
        head = w[:-1]
        if _M2.match(head) or _M1.match(head) is None and _M0.match(head) or _M1.match(head) and not _SHORT.match(head):
            w = head
    if w.endswith("ll") and _M2.match(w):
        w = w[:-1]
    return "y" + w[1:] if y else w
