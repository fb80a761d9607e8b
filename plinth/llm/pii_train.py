"""Trains the model of problem 2: python -m plinth.llm.pii_train [batches] [hidden] [workers] [seed].

A seed above 0 goes on from the stored weights with other lines (the weights here: 1700 batches, then
1600 more with seed 1).

Data and starting weights come from fixed seeds.  The bound of the labelled sample is
``batches * workers * batch`` lines (a documented parameter); held-out lines come from another seed.
Workers compute the gradients of their own lines; the mean is one Adam step.
"""

from __future__ import annotations

import multiprocessing
import os
import sys
import time

import numpy as np

from plinth.llm.pii import WEIGHTS
from plinth.llm.pii_data import Maker, plain_words
from plinth.llm.pii_model import TAGS, Model, char_ids
from plinth.llm.tokenizers import vocabulary


def batch_of(maker: Maker, size: int):
    lines = [maker.line() for _ in range(size)]
    lines = [x for x in lines if x[0]]
    cut = max(len(t) for t, _ in lines)
    ids = np.zeros((len(lines), cut), np.int64)
    tags = np.zeros((len(lines), cut), np.int64)
    lengths = np.array([len(t) for t, _ in lines])
    for k, (t, spans) in enumerate(lines):
        ids[k, : len(t)] = char_ids(t)
        for a, b, kind in spans:
            tags[k, a] = TAGS.index(f"B-{kind}")
            tags[k, a + 1 : b] = TAGS.index(f"I-{kind}")
    return ids, lengths, tags


def holdout(model: Model, n: int = 2000, seed: int = 999_983) -> dict[str, tuple[int, int, int]]:
    """kind -> (right, found, wanted) over held-out lines."""
    maker = Maker(seed, plain_words(vocabulary()))
    lines = [maker.line() for _ in range(n)]
    got = model.spans([t for t, _ in lines])
    out: dict[str, list[int]] = {}
    for (_, want), have in zip(lines, got, strict=True):
        for kind in {k for *_, k in want} | {k for *_, k in have}:
            c = out.setdefault(kind, [0, 0, 0])
            w, h = {x for x in want if x[2] == kind}, {x for x in have if x[2] == kind}
            c[0] += len(w & h)
            c[1] += len(h)
            c[2] += len(w)
    return {k: tuple(v) for k, v in out.items()}


def _worker(pipe, seed: int, batch: int, hidden: int) -> None:
    model, maker = Model(hidden), Maker(seed, plain_words(vocabulary()))
    while (p := pipe.recv()) is not None:
        model.p = p
        pipe.send(model.step(*batch_of(maker, batch)))


def main(batches: int = 1700, hidden: int = 48, workers: int = 8, seed: int = 0, batch: int = 32) -> None:
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    model = Model.load(WEIGHTS) if seed else Model(hidden)
    ctx = multiprocessing.get_context("spawn")
    pipes = []
    for k in range(workers):
        ours, theirs = ctx.Pipe()
        ctx.Process(target=_worker, args=(theirs, 11 + k + 1000 * seed, batch, hidden), daemon=True).start()
        pipes.append(ours)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    began, mean = time.time(), None
    for step in range(1, batches + 1):
        for p in pipes:
            p.send(model.p)
        got = [p.recv() for p in pipes]
        loss = float(np.mean([x for x, _ in got]))
        g = {k: np.mean([x[k] for _, x in got], axis=0) for k in model.p}
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        clip = min(1.0, 1.0 / max(norm, 1e-6))
        rate = (0.005 if seed else 0.008) * min(1, step / 100) * (0.5 + 0.5 * np.cos(np.pi * step / batches)) + 1e-5
        for k in model.p:
            x = g[k] * clip
            m[k] = 0.9 * m[k] + 0.1 * x
            v2[k] = 0.99 * v2[k] + 0.01 * x * x
            model.p[k] = model.p[k] - (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        mean = loss if mean is None else 0.98 * mean + 0.02 * loss
        if step % 100 == 0:
            print(step, round(mean, 5), round(time.time() - began), flush=True)
        if step % 500 == 0:
            print(holdout(model, 500), flush=True)
            model.save(WEIGHTS)
    for p in pipes:
        p.send(None)
    model.save(WEIGHTS)
    print(holdout(Model.load(WEIGHTS)))


if __name__ == "__main__":
    main(*map(int, sys.argv[1:5]))
