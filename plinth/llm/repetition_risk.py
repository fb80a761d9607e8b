"""Risk-controlled cutoffs for the share of repeated content: python -m plinth.llm.repetition_risk

Labelled holdouts: documents of made-up words on both sides of the limit.  The label is the share of the
clean document by a plain reading of the definition (``exact_share``); the score is what the operator
measures on a noisy version (character slips, lines lost, lines wrapped anew, other numerals, other
case), so scores lie above and below their labels, and the cutoff may end on either side of the limit.

For each stratum the cutoffs of a grid are tested from the strictest down (fixed sequence): a cutoff is
kept while the exact binomial (Clopper-Pearson) upper bound of its false-rejection rate is at most
``alpha`` at level ``delta`` divided by the number of strata (Bonferroni).  So with probability
``1 - delta`` no stratum rejects more than ``alpha`` of the documents whose share is within the limit.
The power, the share of documents beyond the limit that are rejected, is stored beside the cutoff.
"""

from __future__ import annotations

import json
import math
import random
import re
from importlib import resources
from pathlib import Path

from plinth.llm import repetition

STORE = Path(__file__).with_name("repetition_cutoffs.json")
STRATA = {"words-short": (False, 380), "words-long": (False, 2500), "characters-short": (True, 380), "characters-long": (True, 1500)}


def binomial_upper(k: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest rate under which at most ``k`` of ``n`` has probability ``level`` or more."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)) if p < 1 else 0.0
        lo, hi = (p, hi) if tail > level else (lo, p)
    return hi


def exact_share(text: str, chars: bool) -> float:
    """The definition read plainly: sentences, lines and runs of 20 words (40 characters) that stood earlier; numerals are one word."""
    words: list[str] = []
    mask: list[bool] = []
    seen: set[tuple] = set()
    for line in text.split("\n"):
        whole: list[str] = []
        for s in re.split(r"[.。!?]", line):
            ws = list(re.sub(r"\W+", "", re.sub(r"\d+", "0", s.lower()))) if chars else re.findall(r"\w+", re.sub(r"\d+", "0", s.lower()))
            if ws:
                words += ws
                mask += [tuple(ws) in seen] * len(ws)
                seen.add(tuple(ws))
                whole += ws
        seen.add(tuple(whole))
    w = repetition.RUN_CHARS if chars else repetition.RUN_WORDS
    runs: set[tuple] = set()
    for i in range(len(words) - w + 1):
        r = tuple(words[i : i + w])
        if r in runs:
            mask[i : i + w] = [True] * w
        runs.add(r)
    total = sum(map(len, words))
    return sum(len(x) for x, m in zip(words, mask, strict=True) if m) / total if total else 0.0


def document(rng: random.Random, chars: bool, size: int) -> str:
    """Sentences, some of them copied with other case, blanks or numerals, some copied with other words."""

    def word() -> str:
        return "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))

    def sentence() -> list[str]:
        if chars:
            s = [chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.randint(12, 45))]
        else:
            s = [word() for _ in range(rng.randint(5, 26))]
        if rng.random() < 0.3:
            s[rng.randrange(len(s))] = str(rng.randint(1, 5000))
        return s

    def show(s: list[str]) -> str:
        s = [str(rng.randint(1, 5000)) if x.isdigit() else x for x in s]
        t = ("" if chars else " ").join(s)
        return (t.upper() if rng.random() < 0.2 else t.capitalize()) + ("。" if chars else ".")

    wanted = rng.uniform(0, 0.6)
    own: list[list[str]] = [sentence()]
    out = [show(own[0])]
    copied, total = 0, len(out[0])
    while total < size:
        if copied < wanted * total and rng.random() < 0.7:
            s = list(rng.choice(own))
            if rng.random() < 0.15:  # a near copy
                for _ in range(rng.randint(1, 3)):
                    s[rng.randrange(len(s))] = chr(0x4E00 + rng.randrange(3000)) if chars else word()
            out.append(show(s))
            copied += len(out[-1])
        else:
            own.append(sentence())
            out.append(show(own[-1]))
        total += len(out[-1])
    return "".join(s + ("\n" if rng.random() < 0.25 else "" if chars else " ") for s in out)


def noisy(rng: random.Random, text: str) -> str:
    """The same document, badly scanned and set anew."""
    lines = [x for x in text.split("\n") if rng.random() > 0.03] or [text]
    t = "\n".join(lines)
    rate = rng.choice((0.0, 0.0, 0.0005, 0.002))
    if rate:
        t = "".join(rng.choice("lI0rnq~") if not ch.isspace() and rng.random() < rate else ch for ch in t)
    t = re.sub(r"\d+", lambda m: str(rng.randint(1, 99_999)) if rng.random() < 0.5 else m.group(), t)
    if rng.random() < 0.3:  # lines wrapped anew
        width = rng.randint(40, 90)
        words, row, rows = t.split(" "), "", []
        for w in words:
            if len(row) + len(w) > width:
                rows.append(row)
                row = ""
            row += (" " if row else "") + w
        t = "\n".join([*rows, row])
    return t


def holdout(name: str, n: int, seed: int) -> list[tuple[float, float]]:
    """(label, score) of documents of one stratum."""
    chars, size = STRATA[name]
    rng = random.Random(f"{name} {seed}")
    out = []
    while len(out) < n:
        clean = document(rng, chars, size)
        scan = noisy(rng, clean)
        if repetition.stratum(scan) == name:
            out.append((exact_share(clean, chars), repetition.share(scan)))
    return out


def select(pairs: list[tuple[float, float]], limit: float, alpha: float, level: float) -> tuple[float, float]:
    """(cutoff, power): the least cutoff whose false-rejection bound holds, stricter ones holding too.

    If not even the strictest one holds, nothing is rejected (cutoff 1).
    """
    within = [s for t, s in pairs if t <= limit]
    chosen = 1.0
    for k in range(400):
        c = round(1 - 0.0025 * k, 4)
        if binomial_upper(sum(s > c for s in within), len(within), level) > alpha:
            break
        chosen = c
    beyond = [s for t, s in pairs if t > limit]
    return chosen, sum(s > chosen for s in beyond) / max(1, len(beyond))


def fit(limit: float = 0.3, alpha: float = 0.02, delta: float = 0.05, per_stratum: int = 1200, seed: int = 7) -> dict[str, dict[str, float]]:
    """For each stratum the cutoff above which a document is rejected, and the power it has."""
    out = {}
    for name in STRATA:
        cutoff, power = select(holdout(name, per_stratum, seed), limit, alpha, delta / len(STRATA))
        out[name] = {"cutoff": cutoff, "power": round(power, 4)}
    return out


def cutoffs(limit: float = 0.3) -> dict[str, float]:
    """Stored cutoffs of the limit 0.3; of any other limit, fitted now."""
    stored = json.loads(resources.files("plinth.llm").joinpath(STORE.name).read_text()) if limit == 0.3 else fit(limit)
    return {k: v["cutoff"] for k, v in stored.items()}


if __name__ == "__main__":
    made = fit()
    STORE.write_text(json.dumps(made, indent=1) + "\n")
    print(made)
