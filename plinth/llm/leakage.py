"""Evaluation texts leaking into training text (problem 7).

Method: template canonicalisation.  Words are brought to a plain form, then numbers, names and
units become typed placeholders, and windows of canonical words (templates) are hash-joined between
items and documents.  A template hit says only that the same sentence pattern occurs, perhaps with
other parameters.  The slot consistency check lines up all words along the hit's diagonal: a run of at
least ``least`` consecutive item words of which at most one in ``one_in`` differs, fillings included, is
a leak.  Where only the templates agree so far, a slot table binds each filling of the item to the
document's fillings in its places; if every filling has one binding and no two share one, the passage is
the item re-parameterised, which is no leak of its words but is reported by ``templates``.

Completeness: in a run of ``least`` = 25 words with at most 3 replaced, 22 words fall in at most 4
unbroken stretches, so one stretch has 6 words or more; windows of 5 canonical words therefore miss
no run (placeholders only merge words, never split them).

Stock sentences are told by where they stand, not by how often a passage is found.  A sentence of an
item stands alone in a document if no words of the item precede or follow it there.  It is stock if it
stands alone in ``stock_contexts`` unrelated surroundings (copies and members of a family are one) and
no less often than in the item's company; once is enough if items share it, word for word, after or
before different words (copies of an item and overlapping passages share the words around it too).
Stock words never count towards a run; a passage longer than its sentence is never stock.

Scale: the items are a stated query set.  Their index is broadcast to the Python workers while it is
below ``index_limit`` windows, else it is split into as many blocks as needed and the documents are
scanned once per block.  Which sentences items share and which words are names is counted over the whole
item table, so nothing depends on the block size.  One pass reads the texts; it writes candidates (as word
ids) and the places of items' sentences to the shared folder; stock is decided over all blocks together and applied to the
candidates alone.  Of the documents nothing but the keys of stock sentences is ever collected, and the
only shuffles carry places of sentences and (document, item) pairs.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.words import fold, words
from plinth.operators.lineage import written
from plinth.operators.spreading import spread

WINDOW = 5
#: Unit words that stand after a number.
UNITS = frozenset("mm cm dm m km in ft yd mi mg g kg t lb oz ml l gal s ms h min hz khz mhz ghz w kw v mv a ma k c f pa kpa bar n j kj cal kcal mol percent degrees celsius kelvin fahrenheit seconds minutes hours days weeks months years metres meters kilometres kilometers centimetres millimetres grams kilograms litres liters pounds ounces inches feet miles volts amperes watts newtons joules pascals bytes bits euros dollars cents pence".split())
_SENTENCE = re.compile(r"(?<=[.?!])\s+")
#: Words on either side that tell whether a sentence stands in its item's company.
NEAR = 4


def _key(data: bytes) -> int:
    """A stable 64-bit key, signed as Spark's bigint."""
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def _words_key(ws: list[str]) -> int:
    return _key(" ".join(ws).encode("utf-8", "surrogatepass"))


def sentences(text: str | None, tokens: list[str]) -> list[tuple[int, int, int]]:
    """(key, first word, words) of the sentences of an item that are long enough to be looked for."""
    out, at = [], 0
    for s in _SENTENCE.split(text or ""):
        ws = [fold(w) for w in words(s)]
        if len(ws) >= WINDOW and tokens[at : at + len(ws)] == ws:
            out.append((_words_key(ws), at, len(ws)))
        at += len(ws)
    return out


class ItemIndex:
    """Items as word ids, their templates, and the words which never count.

    ``names`` are words that are parameters of a pattern, see ``item_names``.
    """

    def __init__(self, items: list[tuple[int, str]], names: Iterable[str] = ()) -> None:
        names = set(names)
        self.ids = [i for i, _ in items]
        tokens = [[fold(w) for w in words(t)] for _, t in items]
        vocab = sorted({w for ts in tokens for w in ts})
        self.vocab = {w: k for k, w in enumerate(vocab)}
        self.words = [np.array([self.vocab[w] for w in ts], dtype=np.int64) for ts in tokens]
        kinds = []
        for k, w in enumerate(vocab):
            kinds.append(-2 if w.isdigit() else -3 if w in UNITS else -4 if w in names else k)
        self.kind = np.array([*kinds, -1], dtype=np.int64)  # the last entry answers for id -1, words of no item
        self.never = [np.zeros(len(ts), dtype=bool) for ts in tokens]
        self.sentences: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for n, (_, t) in enumerate(items):
            for key, at, size in sentences(t, tokens[n]):
                self.sentences[key].append((n, at, size))
        self.starts: dict[int, list[int]] = defaultdict(list)
        for key, places in self.sentences.items():
            n, at, _ = places[0]
            self.starts[int(windows(self.words[n][at : at + WINDOW])[0])].append(key)
        self.templates: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, ids in enumerate(self.words):
            for j, h in enumerate(windows(self.kind[ids]).tolist()):
                self.templates[h].append((n, j))
        self.start_mask, self.template_mask = _mask(self.starts), _mask(self.templates)
        self.memo = _Memo(self.vocab)

    def add_stock(self, keys: Iterable[int]) -> None:
        """Marks the words of stock sentences; keys of other blocks are passed over."""
        for key in keys:
            for n, at, size in self.sentences.get(key, ()):
                self.never[n][at : at + size] = True

    def found_sentences(self, ids: np.ndarray, text: list[str]) -> Iterator[tuple[int, int, bool, int]]:
        """(key, place, alone, context) of the items' sentences in a document of these words.

        The context of a sentence alone is the words around it, else the whole document.
        """
        for j, h in _hits(windows(ids), self.start_mask, self.starts):
            for key in self.starts[h]:
                n, at, size = self.sentences[key][0]
                if np.array_equal(ids[j : j + size], self.words[n][at : at + size]):
                    if any(self._accompanied(ids, j, *place) for place in self.sentences[key]):
                        yield key, j, False, _key(ids.tobytes())
                    else:
                        around = [*text[max(0, j - NEAR) : j], "|", *text[j + size : j + size + NEAR]]
                        yield key, j, True, _words_key(around)

    def _accompanied(self, ids: np.ndarray, j: int, n: int, at: int, size: int) -> bool:
        """Whether two of the words next to a sentence, on one side, are the item's own there."""
        own = self.words[n]
        k = min(NEAR, at, j)
        if np.count_nonzero(own[at - k : at] == ids[j - k : j]) >= 2:
            return True
        k = min(NEAR, len(own) - at - size, len(ids) - j - size)
        return np.count_nonzero(own[at + size : at + size + k] == ids[j + size : j + size + k]) >= 2

    def kinds(self, ids: np.ndarray) -> np.ndarray:
        """Canonical words: the id, or the placeholder of a number, unit or name."""
        return np.where(ids < -1, -2, self.kind[np.maximum(ids, -1)])

    def read(self, text: list[str]) -> np.ndarray:
        """Word ids of a text's words, -1 for words and less for numbers of no item; foldings are remembered for recent words."""
        if len(self.memo) > 500_000:
            self.memo.clear()
        return np.fromiter(map(self.memo.__getitem__, text), dtype=np.int64, count=len(text))


class _Memo(dict):
    """Ids of words seen, filled on demand."""

    def __init__(self, vocab: dict[str, int]) -> None:
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word: str) -> int:
        plain = fold(word)
        k = self.vocab.get(plain, -1)
        if k < 0 and plain.isdigit():  # a number of no item: a filling of its own
            k = -2 - (_words_key([plain]) & 0x3FFFFFFF)
        self[word] = k
        return k


def windows(ids: np.ndarray, w: int = WINDOW) -> np.ndarray:
    """64-bit hashes of all windows of ``w`` ids; windows with an unknown word (-1) hash to 0."""
    n = len(ids) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    bad = np.zeros(n, dtype=bool)
    with np.errstate(over="ignore"):
        for k in range(w):
            part = ids[k : k + n]
            bad |= part == -1  # canonical forms of numbers have their placeholder
            h = (h ^ (part + 1_000_003).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    h[bad] = 0
    return h


_BITS = 20


def _mask(table: dict) -> np.ndarray:
    """A bit for each hash value's low bits: rules out almost every window before the dictionary is asked."""
    mask = np.zeros(1 << _BITS, dtype=bool)
    mask[np.fromiter((h & ((1 << _BITS) - 1) for h in table), dtype=np.int64, count=len(table))] = True
    return mask


def _hits(hs: np.ndarray, mask: np.ndarray, table: dict) -> list[tuple[int, int]]:
    """(position, hash) of the windows that are in the table."""
    at = np.flatnonzero(mask[(hs & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
    return [(j, h) for j, h in zip(at.tolist(), hs[at].tolist(), strict=True) if h in table]


def longest_run(hit: np.ndarray, counts: np.ndarray, one_in: int) -> int:
    """Length of the longest stretch of counted words, from match to match, with at most one in
    ``one_in`` differing; a word that does not count (stock, outside) ends a stretch."""
    best = 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], counts.view(np.int8), [0]))))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        run = hit[a:b]
        if b - a <= best:
            continue
        p = np.concatenate(([0], np.cumsum(np.where(run, 1, 1 - one_in))))
        at = np.flatnonzero(run)
        if not len(at):
            continue
        # Earliest start with a prefix sum not above the end's: prefix minima are monotone.
        starts = p[at]
        low = np.minimum.accumulate(starts)
        k = np.minimum(np.searchsorted(-low, -p[at + 1]), len(at) - 1)
        sizes = np.where((at[k] <= at) & (starts[k] <= p[at + 1]), at + 1 - at[k], 0)
        best = max(best, int(sizes.max()))
    return best


def reparameterised(index: ItemIndex, item: np.ndarray, doc: np.ndarray) -> bool:
    """The slot table of two aligned stretches: whether other fillings are bound one to one."""
    kinds = index.kind[item]
    bound: dict[tuple[int, int], int] = {}
    taken: dict[tuple[int, int], int] = {}
    other = 0
    for kind, a, b in zip(kinds.tolist(), item.tolist(), doc.tolist(), strict=True):
        if kind < -1 and b != -1:
            if bound.setdefault((kind, a), b) != b or taken.setdefault((kind, b), a) != a:
                return False
            other += a != b
    return other > 0


def runs(index: ItemIndex, ids: np.ndarray, least: int, one_in: int, templates: bool = False) -> dict[int, tuple[int, bool]]:
    """Longest accepted run by item, and whether it is one of words: template hits give diagonals, the slots along them decide.

    Runs of templates alone are given only if asked for, and only where no run of words is.
    """
    canonical = index.kinds(ids)
    diagonals = Counter((n, j - k) for j, h in _hits(windows(canonical), index.template_mask, index.templates) for n, k in index.templates[h])
    best: dict[int, tuple[int, bool]] = {}
    need = least - least // one_in
    # A run of words with its replaced ones has so many whole windows at least.
    windows_least = 1 if templates else max(1, least - WINDOW * (least // one_in) - (WINDOW - 1))
    for (n, d), hits in diagonals.items():
        if hits < windows_least:
            continue
        item = index.words[n]
        lo, hi = max(0, -d), min(len(item), len(ids) - d)
        if hi - lo < least:
            continue
        item, doc, counts = item[lo:hi], ids[lo + d : hi + d], ~index.never[n][lo:hi]
        hit = item == doc
        got = longest_run(hit, counts, one_in) if np.count_nonzero(hit) >= need else 0
        if got >= least:
            best[n] = max(best.get(n, (0, False)), (got, True), key=lambda x: (x[1], x[0]))
        elif templates and not best.get(n, (0, False))[1]:
            kinds = index.kind[item]
            same = (kinds == canonical[lo + d : hi + d]) | ((kinds == -4) & (doc == -1))
            got = longest_run(same, counts, one_in) if np.count_nonzero(same) >= need else 0
            if got >= least and reparameterised(index, item[same], doc[same]):
                best[n] = max(best.get(n, (0, False)), (got, False))
    return best


_FOUND = "doc bigint, ids binary, h bigint, at bigint, alone boolean, context bigint, family string"


def _first_pass(index: ItemIndex, least: int, one_in: int, templates: bool):
    """Candidates with their word ids, and the places of the items' sentences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: list[tuple] = []
            for doc, text, family in zip(b["__id"].tolist(), b["__text"], b["__family"], strict=True):
                ws = words(text)
                ids = index.read(ws)
                if len(ids) < WINDOW:
                    continue
                found += [(doc, None, h, at, alone, context, family) for h, at, alone, context in index.found_sentences(ids, ws)]
                if len(ids) >= least and runs(index, ids, least, one_in, templates):
                    found.append((doc, ids.astype(np.int32).tobytes(), None, None, None, None, None))
            columns = zip(*found, strict=True) if found else [()] * 7
            kinds = ("Int64", object, "Int64", "Int64", "boolean", "Int64", object)
            names = ("doc", "ids", "h", "at", "alone", "context", "family")
            yield pd.DataFrame({name: pd.Series(list(c), dtype=kind) for name, kind, c in zip(names, kinds, columns, strict=True)})

    return run


def item_names(items: DataFrame, item_text: str, min_fill: int = 4) -> DataFrame:
    """``word``: words that share a template slot (two words before, one after) with ``min_fill`` - 1 others or more, over all items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = set()
            for text in b["__text"]:
                ts = [fold(w) for w in words(text)]
                found.update((_words_key([ts[j - 2], ts[j - 1], ts[j + 1]]), ts[j]) for j in range(2, len(ts) - 1))
            yield pd.DataFrame(sorted(found), columns=["slot", "word"])

    each = items.select(F.col(item_text).alias("__text")).where(F.col("__text").isNotNull()).mapInPandas(run, "slot bigint, word string").distinct()
    full = each.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_fill).select("slot")
    return each.join(full, "slot", "left_semi").select("word").distinct()


def _shared(items: DataFrame, item_text: str) -> DataFrame:
    """Keys ``h`` of the sentences that stand after, or before, different words in the items of all blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for text in b["__text"]:
                tokens = [fold(w) for w in words(text)]
                for key, at, size in sentences(text, tokens):
                    if size >= 8:
                        before, after = tokens[max(0, at - NEAR) : at], tokens[at + size : at + size + NEAR]
                        found.append((key, _words_key(before) if before else None, _words_key(after) if after else None))
            columns = zip(*found, strict=True) if found else [()] * 3
            yield pd.DataFrame({name: pd.Series(list(c), dtype="Int64") for name, c in zip(("h", "before", "after"), columns, strict=True)})

    each = items.select(F.col(item_text).alias("__text")).where(F.col("__text").isNotNull()).mapInPandas(run, "h bigint, before bigint, after bigint")
    # More than one value, nulls aside: the least is not the greatest.
    return each.groupBy("h").agg(*(f(c).alias(f.__name__ + c) for c in ("before", "after") for f in (F.min, F.max))).where("minbefore < maxbefore or minafter < maxafter").select("h")


def _stock(firsts: list[DataFrame], shared: DataFrame, stock_contexts: int) -> list[int]:
    """Keys of the stock sentences, decided over the documents and all blocks of items.

    A place counts as alone only if it does so for every item, of whatever block.
    """
    found = functools.reduce(DataFrame.unionByName, firsts).where(F.col("h").isNotNull())
    # The document's context is preferred where any block saw the item's company.
    places = found.groupBy("h", "doc", "at").agg(F.min(F.struct("alone", "context")).alias("p"), F.first("family").alias("family"))
    places = places.select("h", "p.alone", "p.context", F.coalesce("family", F.col("p.context").cast("string")).alias("group"))
    counts = places.groupBy("h", "alone").agg(F.least(F.countDistinct("context"), F.countDistinct("group")).alias("n"))
    by_key = counts.groupBy("h").agg(*(F.coalesce(F.max(F.when(F.col("alone") == v, F.col("n"))), F.lit(0)).alias(c) for c, v in (("alone", True), ("beside", False))))
    enough = (F.col("alone") >= stock_contexts) & (F.col("alone") >= F.col("beside"))
    stock = by_key.join(shared.select("h", F.lit(True).alias("shared")), "h", "left").where(enough | F.col("shared") & (F.col("alone") > 0))
    return [r["h"] for r in stock.select("h").collect()]


def _second_pass(index: ItemIndex, least: int, one_in: int, templates: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(doc, index.ids[n], *got) for doc, ids in zip(b["doc"].tolist(), b["ids"], strict=True) for n, got in runs(index, np.frombuffer(ids, np.int32).astype(np.int64), least, one_in, templates).items()]
            yield pd.DataFrame(found, columns=["doc", "item_id", "run", "words"]).astype({"doc": "int64", "item_id": "int64", "run": "int64", "words": bool})

    return run


def leaks(documents: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = 25, one_in: int = 8, stock_contexts: int = 3, family: str = "family_id", index_limit: int = 200_000, templates: bool = False) -> DataFrame:
    """(document, item) pairs: ``ident, item_id, run, words`` with the longest run.

    ``words`` is false where only the item's templates stand in the document, with other parameters; such
    pairs are given if ``templates`` is set.

    * Null or empty texts on either side leak nothing; texts of any length are read whole.
    * Copies of a document or an item each give their own pairs; every pair is given once.
    * ``family`` is read if the documents have it; without it copies are told by their words alone.
    * ``items`` is the stated query set; it is read through the driver in blocks of at most
      ``index_limit`` windows, so an item table of any size is served.
    """
    spark = documents.sparkSession
    members = F.col(family).cast("string") if family in documents.columns else F.lit(None).cast("string")
    narrow = spread(documents.select(F.col(ident).cast("bigint").alias("__id"), F.col(text).alias("__text"), members.alias("__family")).where(F.col("__text").isNotNull()))
    names = written(item_names(items, item_text), "names")
    firsts = []
    for rows in _blocks(items, item, item_text, index_limit):
        firsts.append(written(narrow.mapInPandas(_first_pass(_index_of(rows, names), least, one_in, templates), _FOUND), "leaks"))
    if not firsts:
        return spark.createDataFrame([], f"{ident} bigint, item_id bigint, run bigint, words boolean")
    stock = _stock(firsts, _shared(items, item_text), stock_contexts)
    parts = []
    for rows, first in zip(_blocks(items, item, item_text, index_limit), firsts, strict=True):
        index = _index_of(rows, names)
        index.add_stock(stock)
        parts.append(first.where(F.col("ids").isNotNull()).select("doc", "ids").mapInPandas(_second_pass(index, least, one_in, templates), "doc bigint, item_id bigint, run bigint, words boolean"))
    out = functools.reduce(DataFrame.unionByName, parts)
    best = out.groupBy(F.col("doc").alias(ident), "item_id").agg(F.max(F.struct("words", "run")).alias("best"))
    return best.select(ident, "item_id", F.col("best.run").alias("run"), F.col("best.words").alias("words"))


def _index_of(rows: list[tuple[int, str]], names: DataFrame) -> ItemIndex:
    """The index of a block, with those of all names that stand in it."""
    own = sorted({fold(w) for _, t in rows for w in words(t)})
    held = names.sparkSession.createDataFrame([(w,) for w in own], "word string")
    return ItemIndex(rows, [r["word"] for r in names.join(held, "word", "left_semi").collect()])


def _blocks(items: DataFrame, item: str, item_text: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    rows, size = [], 0
    for r in items.select(item, item_text).where(F.col(item_text).isNotNull()).orderBy(item).toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1]) // 5
        if size >= limit:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows
