"""Porter's stemmer, with the extensions that common toolkits have, as an Arrow-batched function; the suffix stemmer stays the default."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words with stems of their own.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# Endings and what takes their place, by step, where a measure of more than 0 is left.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
# Endings that go where a measure of more than 1 is left.
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """A letter c for each consonant, v for each vowel; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def measure(stem: str) -> int:
    """How many times consonants follow vowels."""
    return len(re.findall("v+c+", shape(stem)))


def _short(stem: str) -> bool:
    s = shape(stem)
    return s == "vc" or (s[-3:] == "cvc" and stem[-1] not in "wxy")


def _rules(word: str, rules, least: int) -> str:
    """The first ending that fits decides, whether it is replaced or not."""
    for end, to in rules:
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            return stem + to if measure(stem) > least and (end != "ion" or stem[-1:] in ("s", "t")) else word
    return word


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    return w[:-2] if w.endswith("sses") else w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    for end in ("ed", "ing"):
        stem = w[: -len(end)]
        if w.endswith(end) and "v" in shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if stem[-2:-1] == stem[-1:] and shape(stem)[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if measure(stem) == 1 and _short(stem) else stem
    return w


def _second(w: str) -> str:
    if w.endswith("alli") and measure(w[:-4]) > 0:
        return _second(w[:-2])
    if w.endswith("logi"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    return _rules(w, STEP_2, 0)


@lru_cache(1 << 16)
def stem_word(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR or len(word) <= 2:
        return IRREGULAR.get(word, word)
    w = _past(_plural(word))
    if w.endswith("y") and len(w) > 2 and shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    w = _rules(_rules(_second(w), STEP_3, 0), [(e, "") for e in STEP_4], 1)
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


def porter(term: Column) -> Column:
    """The stem of each term; null stays null."""

    @F.pandas_udf("string")
    def run(terms):
        return terms.map(stem_word, na_action="ignore")

    return run(F.lower(term))
