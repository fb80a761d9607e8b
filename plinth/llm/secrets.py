"""Credentials embedded in source code (problem 3).

Method, in three stages over all files:

1. Index literals corpus-wide: every file is decoded whole and the literals that may be credentials
   are listed with their place (``secret_text``), as one row each.
2. Suppress and confirm: literals are counted by owner (repository).  A literal without structure of
   its own that many owners share is a placeholder and is dropped, wherever it stands; rare literals
   with structure (or long ones with digits or signs) are confirmed.
3. Re-scan: an Aho-Corasick automaton finds the further places of confirmed literals in every file, in
   prose or code that gives no hint.

Counting is a hash aggregation on (literal, owner), so a literal with a third of all rows is combined
on the map side.  For the re-scan the first stage also lists the anchors of every file: hashes of its
long runs of letters and digits that hold a digit, and of two runs with signs between them.  A literal
can only stand where its own anchor does, so an equi-join of anchors says which literals a file may hold,
and the automaton of a batch of files has only those: work grows with files and their secrets, not with
files times secrets.  Literals without an anchor (short runs only) are searched in all files, in blocks
of at most ``block_chars`` characters; no block depends on another.

Nothing written to the shared folder shows a literal: values are encrypted with a key of this run that
only the driver and the tasks know, and the tables are deleted at the end of the process.
"""

from __future__ import annotations

import re
import secrets as randomness
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm import secret_text
from plinth.operators.lineage import written
from plinth.operators.spreading import spread

_FILE = ["commit_id", "owner", "location", "content_hash"]
_ROW = "commit_id string, owner string, location string, content_hash bigint, line_no bigint, value string, structured boolean, spans array<bigint>"
_COLUMNS = [c.split(" ")[0] for c in _ROW.split(", ")]

#: Runs of letters and digits as the boundary check of the re-scan understands them.
_RUN = re.compile(r"[^\W_]{8,}")
_SIGNED = re.compile(r"(?<![^\W_])(?=([^\W_]{2,}[!#$%&*^]+[^\W_]{2,}))")
_RUN_CHAR = re.compile(r"[^\W_]")


def anchors(text: str) -> set[int]:
    """Anchors of a text; those of a literal are among those of any file it stands in by itself."""
    found = {m for m in _RUN.findall(text) if any(map(str.isdigit, m))}
    found.update(_SIGNED.findall(text))
    return {xxhash.xxh64_intdigest(x) - (1 << 63) for x in found}


def _anchor(value: str) -> int | None:
    """The one anchor a literal is looked for by: of its longest run, else of its first pair of runs."""
    runs = [m for m in _RUN.findall(value) if any(map(str.isdigit, m))]
    best = max(runs, key=len) if runs else next(iter(_SIGNED.findall(value)), None)
    return None if best is None else xxhash.xxh64_intdigest(best) - (1 << 63)


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each literal, and one for each file with its anchors."""
    for b in batches:
        rows = []
        for *file, content in zip(*(b[c] for c in _FILE), b["content"], strict=True):
            text = secret_text.decode(bytes(content))[0]
            for x in secret_text.literals(text, file[2]):
                spans = [x.start, x.end]
                for a, z in x.parts:
                    spans += [a, z]
                value = x.value if x.kind != "private key" else ""
                rows.append((*file, x.line, value, x.structured, spans, _anchor(value), None))
            if held := anchors(text):
                rows.append((*file, None, None, None, None, None, list(held)))
        out = pd.DataFrame(rows, columns=[*_COLUMNS, "anchor", "anchors"], dtype=object)
        yield out.astype({"content_hash": "Int64", "line_no": "Int64", "anchor": "Int64", "structured": "boolean"})


def _find(values: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for v in values:
        found.add_word(v, len(v))
    found.make_automaton()

    def places(text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of the values that stand in the text by themselves."""
        for last, size in found.iter(text):
            start, end = last - size + 1, last + 1
            if not (_RUN_CHAR.match(text, start - 1) if start else None) and not _RUN_CHAR.match(text, end):
                yield start, end

    return places


def _rescan(values: list[str] | None = None):
    """Places of the given values, or of each batch's own (column ``values``), as rows like those of the index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fixed = _find(values) if values else None
        for b in batches:
            places = fixed or _find(sorted({v for vs in b["values"] for v in vs}))
            rows = []
            for *file, content in zip(*(b[c] for c in _FILE), b["content"], strict=True):
                text = secret_text.decode(bytes(content))[0]
                for start, end in places(text):
                    rows.append((*file, text.count("\n", 0, start) + 1, text[start:end], True, [start, end]))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return run


def _files(diffs: DataFrame) -> DataFrame:
    each = diffs.select("commit_id", F.coalesce("repo", F.lit("")).alias("owner"), F.explode("diff_changes").alias("c"))
    each = each.select("commit_id", "owner", F.col("c.location").alias("location"), F.col("c.content").alias("content")).where(F.col("content").isNotNull())
    return each.select("commit_id", "owner", "location", F.xxhash64("content").alias("content_hash"), "content")


def _same_file(a: DataFrame, b: DataFrame) -> list[Column]:
    return [a[c].eqNullSafe(b[c]) for c in _FILE]


def credentials(diffs: DataFrame, shared_by: float = 0.25, shared_least: int = 8, block_chars: int = 16_000_000) -> DataFrame:
    """One row per credential and place: ``commit_id, owner, location, content_hash, line_no, value, structured, spans``.

    ``spans`` are character offsets (start, end, further pieces) in the decoded content without its
    byte-order mark; ``value`` is empty for private keys.  ``shared_by`` and ``shared_least`` say from
    which share (and number) of owners on a literal without structure counts as a placeholder.

    * Null contents have no credentials; null commits, repositories and locations are kept as such.
    * Contents of any encoding and length are read whole; repeated rows give repeated results.
    * Several contents under one commit, repository and location are files of their own.
    * Empty tables give an empty result.
    """
    key = F.lit(randomness.token_hex(16))
    files = spread(_files(diffs))
    found = files.mapInPandas(_index, _ROW + ", anchor bigint, anchors array<bigint>")
    hidden = written(found.withColumn("value", F.aes_encrypt("value", key)), "literals")
    index = hidden.where(F.col("line_no").isNotNull()).withColumn("value", F.aes_decrypt("value", key).cast("string"))
    owners = index.where(F.col("value") != "").groupBy("value", "owner").agg(F.max("structured").alias("structured"), F.max("anchor").alias("anchor")).groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.max("structured").alias("structured"), F.max("anchor").alias("anchor"))
    n_owners = diffs.select(F.coalesce("repo", F.lit("")).alias("r")).agg(F.count_distinct("r")).first()[0]
    limit = max(shared_least, shared_by * n_owners)
    owners = written(owners.withColumn("value", F.aes_encrypt("value", key)), "owners").withColumn("value", F.aes_decrypt("value", key).cast("string"))
    shared = owners.where(~F.col("structured") & (F.col("owners") >= limit)).select("value")
    kept = index.join(shared, "value", "left_anti").select(*_COLUMNS)
    strong = (F.length("value") >= 12) & (F.col("structured") | F.col("value").rlike(r"[0-9!#$%&*^]") & F.col("value").rlike("[A-Za-z]"))
    confirmed = owners.where((F.col("owners") < limit) & strong & ~F.col("value").rlike(r"\s")).select("value", "anchor")
    # Which confirmed literals a file may hold; a file's list is bounded by its anchors.
    held = hidden.where(F.col("anchors").isNotNull()).select(*_FILE, F.explode("anchors").alias("anchor"))
    may = held.join(confirmed, "anchor").groupBy(*_FILE).agg(F.collect_set("value").alias("values"))
    again = files.join(may, _same_file(files, may)).select(*(files[c] for c in [*_FILE, "content"]), may["values"])
    out = kept.unionByName(again.mapInPandas(_rescan(), _ROW))
    # The rest, without an anchor.
    bare = confirmed.where(F.col("anchor").isNull()).select("value")
    chars = bare.agg(F.sum(F.length("value"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    for k in range(blocks):
        # About block_chars characters each, by hash: bounded whatever the corpus.
        values = [r[0] for r in bare.where(F.pmod(F.xxhash64("value"), F.lit(blocks)) == k).collect()]
        if values:
            out = out.unionByName(files.mapInPandas(_rescan(values), _ROW))
    return out


#: Base64 of a key's body, not the letter of a written-out line end.
_BODY = re.compile(r"(?:(?<!\\)|(?<=\\n))[A-Za-z0-9+/=]+")


def _mask(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, z in sorted(spans):
        if a < at:
            a = at
        if z <= a:
            continue
        value = text[a:z]
        if value.startswith("-----BEGIN"):
            # Only the body: the frame, line ends and escapes stay, so the file still parses.
            head = value.index("-----", 10) + 5
            foot = value.rfind("-----END")
            foot = len(value) if foot < head else foot
            hidden = _BODY.sub(lambda m: m.group() if m.group() in ("/", "//") else "*" * len(m.group()), value[head:foot])
            value = value[:head] + hidden + value[foot:]
        else:
            value = "*" * len(value)
        out += [text[at:a], value]
        at = z
    return "".join([*out, text[at:]])


def masked(diffs: DataFrame, found: DataFrame) -> DataFrame:
    """``commit_id, location, content, n_masked``: contents with only the values of credentials masked.

    One row per changed file that holds a credential; byte-order mark, encoding, line ends and length
    in characters stay.  Places are gathered per file and content (bounded by its length).
    """
    spans = found.select(*_FILE, "spans").groupBy(*_FILE).agg(F.collect_set("spans").alias("__spans"))
    files = _files(diffs)
    # Only files that hold a credential are left when repeated rows are dropped.
    both = files.join(spans, _same_file(files, spans)).select(*(files[c] for c in [*_FILE, "content"]), spans["__spans"]).dropDuplicates([*_FILE, "content"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, n = [], []
            for content, all_spans in zip(b["content"], b["__spans"], strict=True):
                text, codec, mark = secret_text.decode(bytes(content))
                pairs = {(int(s[i]), int(s[i + 1])) for s in all_spans for i in range(0, len(s), 2)}
                out.append(mark + _mask(text, sorted(pairs)).encode(codec))
                n.append(len(all_spans))
            yield pd.DataFrame({"commit_id": b["commit_id"], "location": b["location"], "content": pd.Series(out, dtype=object), "n_masked": pd.Series(n, dtype="int64")})

    return both.mapInPandas(run, "commit_id string, location string, content binary, n_masked bigint")
