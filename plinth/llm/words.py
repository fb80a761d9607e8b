"""Words of a text in a form in which case, punctuation, spacing and glyph variants do not matter."""

from __future__ import annotations

import re
import unicodedata

_WORD = re.compile(r"\w+")
#: Hyphens of every kind, with the line break and blanks that may follow one at a line's end; soft hyphens and zero-width marks.
_HYPHEN = re.compile("(?<=\\w)[-\u2010-\u2015\u2212\ufe63\uff0d]\\s*\\n?\\s*(?=\\w)")
_HYPHEN_ASCII = re.compile(r"(?<=\w)-\s*(?=\w)")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
#: A tag of any length: a name and attributes, not whatever stands between two signs of comparison.
_TAG = re.compile(r"</?[a-zA-Z][\w:.\-]*(?:\s+[^\s\"'<>/=]+(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=`]+))?)*\s*/?>")
#: Cyrillic and Greek letters that look like Latin ones.
_LOOKALIKE = str.maketrans("\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0456\u0458\u0455\u03bf\u03b1\u03b9", "aeopcyxijsoai")


_HYPHENS = "-\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe63\uff0d"
_SPECIAL = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")


_LOOKALIKES = re.compile("[\u0400-\u04ff\u0370-\u03ff]")


def plain(text: str) -> str:
    """NFKC, caseless, without invisible marks, tags and hyphens inside words."""
    t = text
    if not t.isascii():
        if _SPECIAL.search(t):
            t = _INVISIBLE.sub("", t)
        if not unicodedata.is_normalized("NFKC", t):
            t = unicodedata.normalize("NFKC", t)
        if any(h in t for h in _HYPHENS):
            t = _HYPHEN.sub("", t)
        t = t.casefold()
        if _LOOKALIKES.search(t):
            t = t.translate(_LOOKALIKE)
    else:
        if "-" in t:
            t = _HYPHEN_ASCII.sub("", t)
        t = t.lower()
    if "<" in t:
        t = _TAG.sub(" ", t)
    return t


def fold(word: str) -> str:
    """Confusions of character recognition: rn/m, and l/i/1, o/0 in words that mix letters and digits."""
    if "rn" in word:
        word = word.replace("rn", "m")
    if any(ch.isdigit() for ch in word):
        digits = word.replace("l", "1").replace("i", "1").replace("o", "0")
        if digits.isdigit():
            return digits
        return word.replace("1", "l").replace("0", "o")
    return word


def words(text: str | None) -> list[str]:
    return _WORD.findall(plain(text)) if text else []
