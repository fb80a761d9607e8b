"""Mixing sources to target weights (problem 8).

Method: low-discrepancy source schedule.  The points ``frac(i * golden ratio)`` are mapped through
the cumulative target weights, which names the source of schedule slot ``i``; a slot's rank within
its source picks a block of that source.  Blocks are runs of about equal token counts of the
source's documents in shuffled (hashed) order; once all blocks of a source are used the next pass
over them begins, at most ``max_repeats`` times.  The schedule ends at the first slot for which a
source has no block left, which is the largest prefix every source can serve.

Nothing is ordered in one task: running sums and ranks use buckets and bucket totals
(``plinth.operators.ranks``), so a source with a third of the rows is spread over all cores.  Only
per-source figures (a handful of rows) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.operators.lineage import written
from plinth.operators.ranks import running_sum
from plinth.operators.spreading import spread

#: The fractional part of the golden ratio.
GOLDEN = (math.sqrt(5) - 1) / 2


def clean_source(col):
    """Spellings of one source name: case, blanks and separators do not matter; blank is null."""
    c = F.regexp_replace(F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", "")), r"(?U)[\s\-_]+", "_")
    return F.when(c != "", c)


def pieces(text: str, pattern: str, long: int = 100_000) -> Iterator[str]:
    """A text in parts of about ``long`` characters, cut only where the pre-tokenisation pattern cuts, so that
    the parts have the tokens of the whole; the encoder's own matcher can't take texts of any length."""
    if len(text) <= long:
        yield text
        return
    start = 0
    for m in regex.finditer(pattern, text):
        # Not behind blanks: how they are cut depends on what follows.
        if m.end() - start >= long and not text[m.end() - 1].isspace():
            yield text[start : m.end()]
            start = m.end()
    if start < len(text):
        yield text[start:]


def token_counts(df: DataFrame, text: str, vocabulary: str, pattern: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``tokens``: the size of ``text`` in tokens of a public byte-level BPE vocabulary.

    A null text has 0 tokens.  Arrow batches; the encoder is built once per Python worker.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            out = b[keep].copy()
            out["tokens"] = [0 if t is None else sum(len(enc.encode_ordinary(piece)) for piece in pieces(t, pattern)) for t in b["__text"]]
            yield out

    fields = [df.schema[k] for k in keep] + [T.StructField("tokens", T.LongType())]
    return spread(df.select(*keep, F.col(text).alias("__text"))).mapInPandas(run, T.StructType(fields))


def mix(docs: DataFrame, targets: DataFrame, ident: str = "doc_id", blocks_per_share: int = 1024) -> DataFrame:
    """Documents with the number of times each is used: ``ident, source, tokens, copies``.

    ``docs`` needs ``ident``, ``source`` (clean) and ``tokens``; ``targets`` has ``source``,
    ``target_share`` and ``max_repeats``, one row per source (a configuration table: it is read to
    the driver, checked to hold at most 10,000 rows).

    * Documents of a null or unlisted source, and those without tokens, are not used.
    * A source with a positive share but no document is left out and the others keep their proportions;
      whoever compares the result with ``targets`` sees it (``p8_shares`` has a row of zeros for it).
    * Shares are scaled to sum to 1; sources with share 0 or null are not used; a null or
      non-positive ``max_repeats`` means 1.
    * Copies of the same text under two ids are two documents.
    """
    spark = docs.sparkSession
    conf = targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").limit(10_001).collect()
    if len(conf) > 10_000:
        raise ValueError("target table too large")
    wanted = {r["source"]: (float(r["target_share"]), max(1, int(r["max_repeats"] or 1))) for r in conf if r["source"] and r["target_share"] and r["target_share"] > 0}
    empty = docs.select(ident, "source", "tokens", F.lit(0).cast("bigint").alias("copies")).limit(0)
    usable = docs.where(F.col("source").isin(list(wanted)) & (F.col("tokens") > 0)) if wanted else docs.limit(0)
    sums = {r["source"]: (r["t"], r["n"]) for r in usable.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    wanted = {s: x for s, x in wanted.items() if s in sums}
    if not wanted:
        return empty
    total_share = sum(s for s, _ in wanted.values())
    shares = {s: (w / total_share, cap) for s, (w, cap) in sorted(wanted.items())}
    # The largest total every source can serve; the scarcest block supply gets `blocks_per_share` blocks.
    size = min(sums[s][0] * cap / w for s, (w, cap) in shares.items())
    block = max(1, int(min(size * w for w, _ in shares.values()) / blocks_per_share))
    # Documents per running-sum bucket stay bounded: their number follows the source's size.
    buckets = F.greatest(F.lit(1), F.ceil(F.col("__n") / 20_000)).cast("int")
    counts = spark.createDataFrame([(s, int(n)) for s, (_, n) in sums.items()], "source string, __n bigint")
    h = F.xxhash64(F.col(ident).cast("string"), F.lit("mix"))
    hashed = usable.join(F.broadcast(counts), "source").withColumn("__h", h)
    # Shuffled order: by the high part of the hash (bucket), then by the hash.
    hashed = hashed.withColumn("__b", F.floor((F.col("__h").cast("double") / 2.0**64 + 0.5) * buckets).cast("int"))
    cum = running_sum(hashed, ["source"], "__b", ["__h", ident], "tokens", "__before")
    supply = {s: max(1, round(sums[s][0] / block)) for s in shares}
    # A source's blocks are equal, but not quite of the common size: its slots make up for that.
    weight = {s: w / (sums[s][0] / supply[s]) for s, (w, _) in shares.items()}
    plan = spark.createDataFrame([(s, supply[s], supply[s] / sums[s][0], supply[s] * cap) for s, (_, cap) in shares.items()], "source string, __blocks bigint, __per_token double, __most bigint")
    placed = cum.join(F.broadcast(plan), "source").select(ident, "source", "tokens", F.floor(F.col("__before") * F.col("__per_token")).cast("bigint").alias("__block"))

    # The schedule: slots in chunks, ranked by chunk totals plus rank inside the chunk.
    slots = math.ceil(size / block) + 64
    names = list(shares)
    bounds = np.cumsum([weight[s] for s in names]) / sum(weight.values())

    @F.pandas_udf("string")
    def source_of(slot: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, (slot.to_numpy() * GOLDEN) % 1.0, side="right")
        return pd.Series(np.array(names, dtype=object)[np.minimum(at, len(names) - 1)])

    schedule = spark.range(slots).select("id", source_of("id").alias("source"), F.floor(F.col("id") / 16_384).alias("__c"), F.lit(1).alias("__one"))
    ranked = running_sum(schedule, ["source"], "__c", ["id"], "__one", "rank").join(F.broadcast(plan.select("source", "__most")), "source")
    end = ranked.where(F.col("rank") >= F.col("__most")).agg(F.min("id")).first()[0]
    used = ranked if end is None else ranked.where(F.col("id") < end)
    # A source's slots 0..r-1 use each of its blocks r div b times, the first r mod b once more.
    taken = {r["source"]: r["r"] for r in used.groupBy("source").agg(F.count(F.lit(1)).alias("r")).collect()}
    turns = spark.createDataFrame([(s, *divmod(taken.get(s, 0), supply[s])) for s in shares], "source string, __full bigint, __rest bigint")
    copies = F.col("__full") + (F.col("__block") < F.col("__rest")).cast("bigint")
    return placed.join(F.broadcast(turns), "source").select(ident, "source", "tokens", copies.alias("copies")).where(F.col("copies") > 0)


def mixed_documents(documents: DataFrame, targets: DataFrame, vocabulary: str, pattern: str, ident: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(all documents with clean source and token counts, the mix of them).

    Token counting is the expensive step; it is written once to the shared folder.
    """
    named = documents.select(ident, clean_source(F.col("source")).alias("source"), text)
    counted = written(token_counts(named, text, vocabulary, pattern, [ident, "source"]), "tokens")
    return counted, mix(counted, targets, ident)
