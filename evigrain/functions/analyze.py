"""Arrow UDFs for what Spark's functions can't do: NFKC, case folding and the stemming analyser.

The analyser gives the tokens of SQLite's ``porter unicode61 remove_diacritics 2``:
runs of letters, digits and private-use characters, lower-cased, without diacritics,
stemmed by Porter's algorithm of 1980. Tests hold it against SQLite itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = frozenset("aeiou")


#: Characters that NFKC leaves alone wherever they stand: most letters and signs of Latin, Greek, Cyrillic, kana and Han texts (a test goes through all).
STABLE = r"\x00-\x{9f}\x{a1}-\x{a7}\x{a9}\x{ab}-\x{ae}\x{b0}\x{b1}\x{b6}\x{b7}\x{bb}\x{bf}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{180}-\x{1c3}\x{1cd}-\x{1f0}\x{1f4}-\x{2af}\x{391}-\x{3a1}\x{3a3}-\x{3a9}\x{3b1}-\x{3c9}\x{400}-\x{482}\x{48a}-\x{52f}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{2030}-\x{2032}\x{2039}\x{203a}\x{20ac}\x{3001}\x{3002}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fff}"


def nfkc(c: Column) -> Column:
    """Only texts with a character outside ``STABLE`` go to Python."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.coalesce(run(F.when(c.rlike(rf"[[^\x00-\x7f]&&[^{STABLE}]]"), c)), c)


def casefold(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else t.casefold())

    return run(c)


def _shape(word: str) -> list[bool]:
    """Per letter: is it a consonant? ``y`` is one at the start and after a vowel."""
    out: list[bool] = []
    for i, ch in enumerate(word):
        out.append(ch not in _VOWELS and (ch != "y" or i == 0 or not out[-1]))
    return out


def _measure(word: str) -> int:
    """Number of vowel-to-consonant steps."""
    s = _shape(word)
    return sum(1 for a, b in zip(s, s[1:]) if not a and b)


def _has_vowel(word: str) -> bool:
    """Here any y after the first letter counts as a vowel."""
    return any(ch in _VOWELS or (ch == "y" and i) for i, ch in enumerate(word))


def _ends_cvc(word: str) -> bool:
    s = _shape(word)
    return len(word) >= 3 and s[-1] and not s[-2] and s[-3] and word[-1] not in "wxy"


#: The suffix lists of Porter's steps 2, 3 and 4.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _ends(word: str, suffix: str) -> bool:
    """A suffix must leave something before it."""
    return len(word) > len(suffix) and word.endswith(suffix)


def _replace(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if _ends(word, suffix):
            rest = word[: -len(suffix)]
            return rest + table[suffix] if _measure(rest) > 0 else word
    return word


def stem(word: str) -> str:
    """Porter's stem of a word's UTF-8 bytes, as SQLite has it: bytes beyond ASCII are consonants; under three or over 64 bytes a word stays."""
    raw = word.encode()
    return word if not 3 <= len(raw) <= 64 else _stem(raw.decode("latin-1")).encode("latin-1").decode("utf-8", "replace")


def _stem(word: str) -> str:
    if _ends(word, "sses") or _ends(word, "ies"):
        word = word[:-2]
    elif word[-1] == "s" and word[-2] != "s":
        word = word[:-1]
    cut = False
    if _ends(word, "eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif _ends(word, "ed") and _has_vowel(word[:-2]):
        word, cut = word[:-2], True
    elif _ends(word, "ing") and _has_vowel(word[:-3]):
        word, cut = word[:-3], True
    if cut:
        if _ends(word, "at") or _ends(word, "bl") or _ends(word, "iz"):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
            word = word[:-1]
        elif _measure(word) == 1 and _ends_cvc(word):
            word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _STEP2), _STEP3)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if _ends(word, suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def _token_char(ch: str) -> bool:
    kind = unicodedata.category(ch)
    return kind[0] in "LN" or kind == "Co"


def tokens(text: str) -> list[str]:
    """Unstemmed tokens: lower-cased, diacritics gone."""
    if not text.isascii():
        text = "".join(ch for c in text for ch in (unicodedata.normalize("NFD", c) if unicodedata.category(c)[0] == "L" and unicodedata.decomposition(c)[:1] not in ("", "<") else c) if unicodedata.category(ch) != "Mn")
    out, start = [], None
    for i, ch in enumerate(text):
        ok = ch.isalnum() if ch.isascii() else _token_char(ch)
        if ok and start is None:
            start = i
        elif not ok and start is not None:
            out.append(text[start:i].lower())
            start = None
    if start is not None:
        out.append(text[start:].lower())
    return out


#: Between runs of these nothing joins: words are cut here, and each is analysed once.
_RAW = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+").findall


def stemmer(most: int = 500_000) -> Callable[[str | None], list[str]]:
    """Stemmed tokens of a text, in order. Words are analysed once, and up to ``most`` are kept."""
    known: dict[str, tuple[str, ...]] = {}

    def run(text: str | None) -> list[str]:
        if text is None:
            return []
        if len(known) > most:
            known.clear()
        out: list[str] = []
        for w in _RAW(text):
            own = known.get(w)
            if own is None:
                own = known[w] = tuple(map(stem, tokens(w)))
            out += own
        return out

    return run


def analyze(c: Column) -> Column:
    """Stemmed tokens of a text, in order, as an array; stems are cached in each batch's task."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        stems = stemmer()
        for s in batches:
            yield pd.Series([stems(t) for t in s])

    return run(c)
