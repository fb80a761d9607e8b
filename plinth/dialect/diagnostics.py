"""Errors of the front end, with a place and a hint."""

from __future__ import annotations


class Diagnostic(Exception):
    def __init__(self, message: str, at: int | None = None, help: str | None = None) -> None:
        super().__init__(message + (f" (at character {at})" if at is not None else "") + (f"; {help}" if help else ""))
        self.message, self.at, self.help = message, at, help


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def did_you_mean(name: str, known) -> str | None:
    best = min(known, key=lambda k: distance(name, k), default=None)
    return f"did you mean {best!r}?" if best is not None and distance(name, best) <= max(1, len(name) // 3) else None
