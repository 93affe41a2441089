"""Text analysis: tokens, folding of diacritics, Porter stems.

Two analyzers share one interface.  ``simple`` lower-cases and takes runs of
letters and numbers, wholly in the JVM.  ``english`` also folds diacritics off
Latin letters and stems; folding and stemming run over the distinct terms of a
table, never over its occurrences.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = "[\\p{L}\\p{N}\\p{Co}][\\p{L}\\p{N}\\p{Co}\\p{M}]*"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and numbers, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def split_tokens(text: str) -> list[str]:
    """The same on the driver, for query text."""
    out, held = [], ""
    for ch in text.lower():
        kind = unicodedata.category(ch)
        if kind[0] in "LN" or kind == "Co" or (held and kind[0] == "M"):
            held += ch
        elif held:
            out.append(held)
            held = ""
    return [*out, held] if held else out


def fold(term: str) -> str:
    """Without diacritics on Latin letters."""
    out = []
    for ch in term:
        plain = unicodedata.normalize("NFD", ch)
        if len(plain) > 1 and plain[0].isascii() and all(unicodedata.category(c) == "Mn" for c in plain[1:]):
            out.append(plain[0])
        elif unicodedata.category(ch) != "Mn":
            out.append(ch)
    return "".join(out)


# --- Porter's algorithm, as rule tables ---------------------------------------

_STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
]
_STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c and v for each letter: y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c", _shape(word)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _swap(word: str, rules: list[tuple[str, str]]) -> str:
    for end, to in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + to if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Porter stem of a lower-case term; terms under three or over 64 bytes stay. Letters are UTF-8 bytes."""
    word = word.encode().decode("latin-1")
    if 3 <= len(word) <= 64:
        word = _stemmed(word)
    return word.encode("latin-1").decode("utf-8", "ignore")


def _stemmed(word: str) -> str:
    # Plurals and participles.
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            base = word[: -len(end)]
            if word.endswith(end) and "v" in _shape(base):
                if base.endswith(("at", "bl", "iz")):
                    word = base + "e"
                elif _double(base) and base[-1] not in "lsz":
                    word = base[:-1]
                else:
                    word = base + "e" if _measure(base) == 1 and _short_end(base) else base
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    # Endings of derivation.
    word = _swap(_swap(word, _STEP_2), _STEP_3)
    for end in sorted(_STEP_4, key=len, reverse=True):
        if word.endswith(end):
            base = word[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                word = base
            break
    # Final e and double l.
    if word.endswith("e"):
        base, m = word[:-1], _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(base)):
            word = base
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def english(term: str) -> str:
    return stem(fold(term))


@F.pandas_udf(T.StringType())
def english_terms(terms: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of distinct terms."""
    for batch in terms:
        yield batch.map(english, na_action="ignore")


def query_terms(text: str, analyzer: str) -> list[str]:
    """The terms of a phrase under an analyzer."""
    found = split_tokens(text)
    return [english(t) for t in found] if analyzer == "english" else found
