"""Repetition inside a single document (problem 9).

Score: the share of a document's text that lies in later copies of a line, a sentence or a run of at
least 20 words (40 characters where the script writes no blanks) that stood earlier in it.
Sentences are read within a line and also across the single line breaks of a paragraph.  Case,
spacing and punctuation are removed first; numerals of any length, inner separators included, are one
and the same word there, and weigh as many characters as they have digits.  Everything is per document: one map stage, no
shuffle, and the memory of a document is a few numbers per word, whatever its length.

Decision: risk-controlled thresholds.  The share of a document counts as repetitive if it is above its
stratum's cutoff (words or characters, short or long); ``repetition_risk`` selects the cutoffs on
labelled holdouts, by exact binomial bounds on the rate of false rejections.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.spreading import spread

RUN_WORDS, RUN_CHARS = 20, 40
#: A sentence or line counts as a copy only if it has at least so many bytes without blanks.
LEAST = 12
SHORT = 600

_TABLE = bytes(48 if 48 <= b <= 57 else b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_INNER = re.compile(rb"(?<=[0-9])[.,:/'\-](?=[0-9])")
_NUMERAL = re.compile(rb"[0-9]+")
_SENTENCE = re.compile(rb"[.!?]+[\s\"')\]]+")
_CJK = re.compile("[぀-ヿ㐀-鿿가-힯ｦ-ﾟ]")
#: Blanks and marks beyond ASCII, sentence ends beyond ASCII, digits of full width.
_BLANKS = "\u00a0\u2000\u2001\u2002\u2003\u2009\u202f\u200b\ufeff\u3000\u3001\uff0c\u300c\u300d\u3010\u3011\uff08\uff09\u30fb"
_ENDS = "\u3002\uff0e\uff01\uff1f"
_DIGITS = {chr(0xFF10 + i): str(i) for i in range(10)}


def _plain(text: str) -> str:
    """One kind of blank, of sentence end and of digit; only what occurs is replaced."""
    for ch in _BLANKS:
        if ch in text:
            text = text.replace(ch, " ")
    for ch in _ENDS:
        if ch in text:
            text = text.replace(ch, ". ")
    for ch, d in _DIGITS.items():
        if ch in text:
            text = text.replace(ch, d)
    return text.lower()


_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        m = max(4096, 1 << n.bit_length())
        with np.errstate(over="ignore"):
            for k, b in enumerate((_B, _B_INV)):
                p = np.full(m, b, dtype=np.uint64)
                p[0] = 1
                _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def copied(units: np.ndarray, w: int) -> np.ndarray:
    """Which units lie in a run of ``w`` units that stood earlier: rolling hashes, first places by a sort."""
    n = len(units) - w + 1
    mask = np.zeros(len(units), dtype=bool)
    if n <= 1:
        return mask
    p, inv = _powers(len(units))
    with np.errstate(over="ignore"):
        c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(units * p, dtype=np.uint64)))
        h = (c[w:] - c[:-w]) * inv[:n]
    order = np.argsort(h, kind="stable")
    s = h[order]
    later = order[1:][s[1:] == s[:-1]]
    if len(later):
        edge = np.zeros(len(units) + 1, dtype=np.int32)
        edge[later] += 1
        np.subtract.at(edge, later + w, 1)
        mask = np.cumsum(edge[:-1]) > 0
    return mask


def wide(text: str) -> bool:
    """Whether the text is written without blanks between words."""
    return not text.isascii() and len(_CJK.findall(text)) * 5 > len(text)


def share(text: str | None) -> float:
    """Share of the text in later copies; 0 for null, empty and blank texts."""
    if not text:
        return 0.0
    chars = wide(text)
    if not text.isascii():
        text = _plain(text)
    spelt = _INNER.sub(b"", text.encode("utf-8", "surrogatepass"))
    raw = _NUMERAL.sub(b"0", spelt)
    words: list[bytes] = []
    seen: set[bytes] = set()
    spans: list[tuple[int, int]] = []
    # Sentences of paragraphs are kept apart: those within a line are among them.
    wrapped: set[bytes] = set()
    paragraph: list[bytes] = []
    begun = 0
    for line in [*raw.split(b"\n"), b""]:
        ws = line.translate(_TABLE).split()
        if not ws:
            if paragraph:
                at = begun
                for part in _SENTENCE.split(b"\n".join(paragraph)):
                    ps = part.translate(_TABLE).split()
                    k = b"".join(ps)
                    if len(k) >= LEAST:
                        if k in wrapped:
                            spans.append((at, at + len(ps)))
                        wrapped.add(k)
                    at += len(ps)
                paragraph = []
            continue
        if not paragraph:
            begun = len(words)
        paragraph.append(line)
        key = b"".join(ws)
        start = len(words)
        words += ws
        if len(key) >= LEAST and key in seen:
            spans.append((start, len(words)))
            continue
        parts = _SENTENCE.split(line)
        if len(parts) > 1:
            at = start
            for part in parts:
                ps = part.translate(_TABLE).split()
                if ps:
                    k = b"".join(ps)
                    if len(k) >= LEAST and k in seen:
                        spans.append((at, at + len(ps)))
                    seen.add(k)
                    at += len(ps)
        seen.add(key)
    if not words:
        return 0.0
    spelt_words = spelt.translate(_TABLE).split()
    lengths = np.fromiter(map(len, spelt_words), dtype=np.int64, count=len(words))
    mask = np.zeros(len(words), dtype=bool)
    for a, b in spans:
        mask[a:b] = True
    if chars:
        units = np.frombuffer(b"".join(words).decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
        sizes = np.fromiter((len(w.decode("utf-8", "replace")) for w in words), dtype=np.int64, count=len(words))
        whole = np.repeat(mask, sizes)
        weights = np.ones(len(units), dtype=np.int64)
        weights[units == 48] = [len(m) for w in spelt_words for m in _NUMERAL.findall(w)]
        return float(weights[whole | copied(units, RUN_CHARS)].sum() / weights.sum())
    units = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mask |= copied(units, RUN_WORDS)
    return float(lengths[mask].sum() / lengths.sum())


def stratum(text: str | None) -> str:
    t = text or ""
    return ("characters" if wide(t) else "words") + ("-short" if len(t) < SHORT else "-long")


def repetition(documents: DataFrame, ident: str = "doc_id", text: str = "text", limit: float = 0.3) -> DataFrame:
    """Per document ``ident, share, stratum, repetitive``.

    Null, empty and blank texts have share 0; very long texts are read whole; copies of a document
    are each scored; an empty table gives an empty result; other columns are not read.
    """
    from plinth.llm.repetition_risk import cutoffs

    bounds = cutoffs(limit)
    kind = documents.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["__text"]]
            scores = [share(t) for t in texts]
            names = [stratum(t) for t in texts]
            yield pd.DataFrame({ident: b[ident], "share": np.array(scores, dtype=np.float64), "stratum": pd.Series(names, dtype=object), "repetitive": np.array([s > bounds[n] for s, n in zip(scores, names, strict=True)], dtype=bool)})

    return spread(documents.select(ident, F.col(text).alias("__text"))).mapInPandas(run, f"`{ident}` {kind}, share double, stratum string, repetitive boolean")
