"""Personal information inside free text (problem 2).

Method: a character-level bidirectional LSTM with CRF transitions (``pii_model``), trained in numpy
from labelled spans (``pii_data``, ``pii_train``; a bounded sample of made-up lines of random words, so
everything in the tables is held out).  Texts are read whole: each line is cut into overlapping
windows, emissions are joined over the windows and one path is decoded over the whole line.  An exact
check drops spans that cannot be what they were labelled as (remote locators, package versions,
numbers too short, names without two words that begin with a capital or an uncased letter).  A line of
which no part could pass that check is not decoded: it could not give a span.

One map stage, no shuffle.  A Python worker decodes each distinct line once and remembers the recent
ones (bounded), since lines and addresses recur; results do not depend on that memory.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from importlib import resources
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.spreading import spread

WEIGHTS = Path(__file__).with_name("pii_weights.npz")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "national_id": "[NATIONAL_ID]", "street_address": "[STREET_ADDRESS]", "name": "[NAME]"}

_AT = re.compile(r"(?i)@|＠|[\[({<\s]+at[\])}>\s]+|\(at\)|_at_")
_VERSION = re.compile(r"@v?\d[\w.\-]*$")


def plausible(text: str, start: int, end: int, kind: str) -> bool:
    """The exact check on one labelled span."""
    s = text[start:end]
    digits = sum(ch.isdigit() for ch in s)
    if kind == "email":
        if not _AT.search(s) or not re.search(r"(?i)\.|dot", s.split("@")[-1]):
            return False
        if _VERSION.search(s) or re.match(r":(?!//)[\w~/.\-]+/", text[end : end + 60]) or re.match(r"[\w.\-]+@[\w.\-]+:[\w~/.\-]+", s):
            return False
        return "://" not in text[max(0, start - 12) : start] or "mailto:" in text[max(0, start - 12) : start]
    if kind == "phone":
        return 7 <= digits <= 17
    if kind == "national_id":
        return digits >= 6
    if kind == "street_address":
        return digits >= 1 and sum(ch.isalpha() for ch in s) >= 3 and not s.islower()
    return not digits and _PAIR.search(s) is not None


_CAPITAL = r"(?<![^\W_])(?![a-zß-öø-ÿ])[^\W\d_]"
#: Two words next to each other, particles aside, that begin with a capital or in a script without case; or two letters of a script that writes no blanks.
_PAIR = re.compile(rf"{_CAPITAL}[^\W_]*[^\w\n]{{1,4}}(?:[a-zß-öø-ÿ]{{1,4}}[^\w\n]{{1,3}}){{0,3}}{_CAPITAL}|[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]{{2}}")


def worth_reading(line: str) -> bool:
    """Whether any part of a line could pass the exact check of some kind."""
    digits = sum(map(str.isdigit, line))
    if digits >= 6 or _PAIR.search(line):
        return True
    if digits and sum(map(str.isalpha, line)) >= 3 and not line.islower():
        return True
    return _AT.search(line) is not None and re.search(r"(?i)\.|dot", line) is not None


class Finder:
    """Spans of whole texts; keeps the spans of recent lines."""

    def __init__(self, most: int = 200_000) -> None:
        from plinth.llm.pii_model import Model

        self.model = Model.load(io.BytesIO(resources.files("plinth.llm").joinpath(WEIGHTS.name).read_bytes()))
        self.memo: dict[str, list[tuple[int, int, str]]] = {}
        self.most = most

    def lines(self, lines: list[str]) -> dict[str, list[tuple[int, int, str]]]:
        fresh = [x for x in dict.fromkeys(lines) if x not in self.memo]
        if len(self.memo) + len(fresh) > self.most:
            self.memo = {x: self.memo[x] for x in dict.fromkeys(lines) if x in self.memo}
        self.memo |= {x: [] for x in fresh if not worth_reading(x)}
        fresh = [x for x in fresh if x not in self.memo]
        for k in range(0, len(fresh), 8192):
            part = fresh[k : k + 8192]
            for line, spans in zip(part, self.model.spans(part), strict=True):
                self.memo[line] = [(a, b, kind) for a, b, kind in (_trimmed(line, *s) for s in spans) if b > a and plausible(line, a, b, kind)]
        return self.memo

    def texts(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        cut = [[] if t is None else t.split("\n") for t in texts]
        memo = self.lines([x for lines in cut for x in lines if x])
        out = []
        for lines in cut:
            at, spans = 0, []
            for x in lines:
                if x:
                    spans += [(at + a, at + b, k) for a, b, k in memo[x]]
                at += len(x) + 1
            out.append(spans)
        return out


#: The local part of an address, dots written out or not.
_LOCAL = re.compile(r"(?i)[\w.+%\-]+(?:(?:\s+dot\s+|\s*[\[({]\s*(?:dot|\.)\s*[\])}]\s*)[\w.+%\-]+)*$")


def _trimmed(line: str, a: int, b: int, kind: str) -> tuple[int, int, str]:
    """The span without the blanks, marks and words around the item itself."""
    if kind == "email" and (at := list(_AT.finditer(line, a, b))):
        local = _LOCAL.search(line, a, at[-1].start())
        a = local.start() if local else a
    while a < b and line[a] in (" \t\r<\"'" if kind == "phone" else " \t\r<(\"'"):
        a += 1
    while b > a and line[b - 1] in " \t\r>,;\"'" + ("." if kind != "name" else ""):
        b -= 1
    return a, b, kind


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a < at:
            continue
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*out, text[at:]])


def personal(df: DataFrame, fields: list[str], ident: str = "commit_id") -> DataFrame:
    """``ident, field, kinds, redacted``: one row per row and field that is not null.

    ``kinds`` are the distinct kinds found (empty array if none); ``redacted`` is the text with each
    item replaced by a placeholder naming its type, all else unchanged.  Null fields give no row;
    empty texts are kept as they are; repeated rows give repeated results; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder()
        for b in batches:
            for f in fields:
                texts = [t if isinstance(t, str) else None for t in b[f"f_{f}"]]
                spans = finder.texts(texts)
                rows = [(i, f, sorted({k for *_, k in s}), redact(t, s)) for i, t, s in zip(b["id"], texts, spans, strict=True) if t is not None]
                yield pd.DataFrame(rows, columns=[ident, "field", "kinds", "redacted"])

    narrow = spread(df.select(F.col(ident).cast("string").alias("id"), *(F.col(f).cast("string").alias(f"f_{f}") for f in fields)))
    return narrow.mapInPandas(run, f"`{ident}` string, field string, kinds array<string>, redacted string")
