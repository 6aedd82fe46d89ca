"""Porter stemmer with the extended rules of the usual ROUGE implementation.

The published 1980 algorithm with later changes: a pool of irregular words, ``ies`` and
``ied`` of four-letter words, ``y`` only after a consonant that is not the first letter,
``bli``, ``fulli`` and ``logi``, a repeated step 2 after ``alli``, and two-letter stems as
short ones. A worker remembers the stems of the words it has seen.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Irregular words and the suffix rules of steps 2, 3 and 4.
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
             "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
             "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
             "exceed": "exceed", "succeed": "succeed"}
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
         ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
         ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
         ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
         ("fulli", "ful"), ("logi", "log"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
         ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
         "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """``c`` or ``v`` for each letter; ``y`` is a vowel after a consonant."""
    out = []
    for c in word:
        out.append("v" if c in "aeiou" or (c == "y" and out and out[-1] == "c") else "c")
    return "".join(out)


def measure(stem: str) -> int:
    """m in [C](VC)^m[V]."""
    return shape(stem).count("vc")


def _doubled(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and shape(w)[-1] == "c"


def _short(w: str) -> bool:
    s = shape(w)
    return (s[-3:] == "cvc" and w[-1] not in "wxy") or s == "vc"


def _suffix(w: str, rules):
    """The first rule whose suffix ``w`` has: (stem, replacement), else None."""
    for suffix, new in rules:
        if w.endswith(suffix):
            return w[:len(w) - len(suffix)], new
    return None


def _plurals(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past_and_gerund(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix):
            stem = w[:-len(suffix)]
            if "v" not in shape(stem):
                continue
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _doubled(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if measure(stem) == 1 and _short(stem) else stem
    return w


def _step2(w: str) -> str:
    if w.endswith("alli") and measure(w[:-4]) > 0:
        return _step2(w[:-2])
    hit = _suffix(w, STEP2)
    if hit is None:
        return w
    stem, new = hit
    return stem + new if measure(w[:-3] if new == "log" else stem) > 0 else w


def _step3(w: str) -> str:
    hit = _suffix(w, STEP3)
    return hit[0] + hit[1] if hit and measure(hit[0]) > 0 else w


def _step4(w: str) -> str:
    for suffix in STEP4:
        if w.endswith(suffix):
            stem = w[:len(w) - len(suffix)]
            return stem if measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")) else w
    return w


def _step5(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        m = measure(stem)
        if m > 1 or (m == 1 and not _short(stem)):
            w = stem
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


def porter_stem(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _past_and_gerund(_plurals(word))
    if w.endswith("y") and len(w) > 2 and shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    return _step5(_step4(_step3(_step2(w))))


@lru_cache(maxsize=1 << 17)
def rouge_stem(token: str) -> str:
    """ROUGE stems tokens of more than three characters only."""
    return token if len(token) <= 3 else porter_stem(token)


@F.pandas_udf(T.StringType())
def stem_udf(tokens: pd.Series) -> pd.Series:
    """Arrow-batched form of ``rouge_stem``."""
    return tokens.map(lambda t: t if t is None else rouge_stem(t))
