"""Per-key results when a few keys hold most rows (problem 5).

Method: dense accumulator arrays.  Every input split encodes its keys with a local dictionary and
scatter-reduces its rows into dense numpy arrays (one slot per key), so a key that holds a third of
the table costs each split one slot.  The array blocks, at most one entry per key and split, are
then hash-partitioned on the key and summed by a second array reduction.  No task ever sees the
rows of a hot key: only one partial per split.

Memory: a split flushes its arrays when its dictionary reaches ``max_slots`` keys (the partials are
merged downstream, so flushing never changes the result); a reducer reads its partition in order of a
12-bit sub-hash of the key and gives its arrays out at the first end of a sub-hash after ``max_slots``
keys, so it holds these and 1/4096 of its keys at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FIELDS = "key string, n bigint, n_values bigint, total bigint, largest bigint, t_first bigint, first_id string, t_last bigint, last_id string"
_NO_T_FIRST, _NO_T_LAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _texts(column: pd.Series) -> list:
    return [x if isinstance(x, str) else None for x in column]


class _Arrays:
    """One slot per dictionary entry; grows by doubling."""

    def __init__(self) -> None:
        self.slots: dict[str | None, int] = {}
        self.size = 0
        self._grow(1024)

    def _grow(self, size: int) -> None:
        fill = {"n": 0, "n_values": 0, "total": 0, "largest": _NO_T_LAST, "t_first": _NO_T_FIRST, "t_last": _NO_T_LAST}
        for name, value in fill.items():
            fresh = np.full(size, value, dtype=np.int64)
            if self.size:
                fresh[: self.size] = getattr(self, name)
            setattr(self, name, fresh)
        for name in ("first_id", "last_id"):
            fresh = np.full(size, None, dtype=object)
            if self.size:
                fresh[: self.size] = getattr(self, name)
            setattr(self, name, fresh)
        self.size = size

    def codes(self, keys: list) -> np.ndarray:
        """Dictionary codes of a batch; None is an entry of its own."""
        slots = self.slots
        out = np.fromiter((slots.setdefault(k, len(slots)) for k in keys), dtype=np.int64, count=len(keys))
        size = self.size
        while len(slots) > size:
            size *= 2
        if size > self.size:
            self._grow(size)
        return out

    def add(self, codes, n, n_values, total, largest, t_first, first_id, t_last, last_id) -> None:
        top = len(self.slots)
        exact = lambda w: np.array_equal(w, w.astype(np.float64).astype(np.int64)) and abs(w).sum() < 2**52
        for name, w in (("n", n), ("n_values", n_values), ("total", total)):
            acc = getattr(self, name)
            if exact(w):
                acc[:top] += np.bincount(codes, weights=w, minlength=top).astype(np.int64)
            else:
                np.add.at(acc, codes, w)
        np.maximum.at(self.largest, codes, largest)
        self._extreme(codes, t_first, first_id, "t_first", "first_id", False)
        self._extreme(codes, t_last, last_id, "t_last", "last_id", True)

    def _extreme(self, codes, t, ids, t_name, id_name, last: bool) -> None:
        known = np.flatnonzero(np.array([x is not None for x in ids], dtype=bool))
        if not len(known):
            return
        acc_t, acc_i = getattr(self, t_name), getattr(self, id_name)
        c = codes[known]
        held = np.unique(c)
        held = held[np.array([x is not None for x in acc_i[held]], dtype=bool)]
        # What the slots hold takes part like any other row; the best of each slot is written back.
        frame = pd.DataFrame({"c": np.concatenate((c, held)), "t": np.concatenate((t[known], acc_t[held])), "i": np.concatenate((ids[known], acc_i[held]))})
        best = frame.sort_values(["c", "t", "i"], kind="stable").drop_duplicates("c", keep="last" if last else "first")
        acc_t[best["c"].to_numpy()], acc_i[best["c"].to_numpy()] = best["t"].to_numpy(), best["i"].to_numpy()

    def frame(self) -> pd.DataFrame:
        top = len(self.slots)
        out = pd.DataFrame({"key": pd.Series(list(self.slots), dtype=object)})
        for name in ("n", "n_values", "total", "largest", "t_first", "first_id", "t_last", "last_id"):
            out[name] = getattr(self, name)[:top]
        return out


def _split(max_slots: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays = _Arrays()
        for b in batches:
            if not len(b):
                continue
            value = b["v"].to_numpy()
            has_v = ~pd.isna(value)
            v = np.where(has_v, np.where(has_v, value, 0), 0).astype(np.int64)
            t = b["t"].to_numpy()
            ids = np.array(_texts(b["i"]), dtype=object)
            no_t = pd.isna(t) | pd.isna(b["i"]).to_numpy()
            ids[no_t] = None
            t = np.where(no_t, 0, np.where(no_t, 0, t)).astype(np.int64)
            codes = arrays.codes(_texts(b["k"]))
            arrays.add(codes, np.ones(len(b), np.int64), has_v.astype(np.int64), v, np.where(has_v, v, _NO_T_LAST), t, ids, t, ids)
            if len(arrays.slots) >= max_slots:
                yield arrays.frame()
                arrays = _Arrays()
        if arrays.slots:
            yield arrays.frame()

    return run


def _reduce(max_slots: int):
    """Sums the blocks of one partition, whose rows come in order of the key's sub-hash; full arrays are given out where a sub-hash ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays, current = _Arrays(), None

        def add(b: pd.DataFrame) -> None:
            if len(b):
                clean = lambda c: np.array(_texts(b[c]), dtype=object)
                arrays.add(arrays.codes(_texts(b["key"])), *(b[c].to_numpy(np.int64) for c in ("n", "n_values", "total", "largest", "t_first")), clean("first_id"), b["t_last"].to_numpy(np.int64), clean("last_id"))

        for b in batches:
            if not len(b):
                continue
            subs = b["sub"].to_numpy()
            at = 0
            if len(arrays.slots) >= max_slots:
                at = int(np.searchsorted(subs, current, side="right"))
                add(b.iloc[:at])
                if at < len(b):
                    yield arrays.frame()
                    arrays = _Arrays()
            add(b.iloc[at:])
            current = subs[-1]
        frame = arrays.frame()
        for start in range(0, len(frame), 50_000):
            yield frame.iloc[start : start + 50_000]

    return run


def key_stats(df: DataFrame, key: str, value: str | None = None, when: str | None = None, ident: str | None = None, max_slots: int = 500_000, partitions: int | None = None) -> DataFrame:
    """Per-key row count, value count/sum/maximum and first/last ``ident`` by ``when``.

    Output: ``key, n, n_values, total, largest, first_id, first_at, last_id, last_at``.

    * A null key is a key of its own (one row with a null ``key``); the empty string is another.
    * Null values do not count in ``n_values``/``total``/``largest``; a key without any has total 0
      and a null maximum.
    * Rows with a null ``when`` or ``ident`` give no first/last; ties on time go to the smaller
      (first) or larger (last) ident.
    * Repeated rows count as stored; an empty table gives an empty result; other columns of ``df``,
      whatever their names, are never read.
    """
    spark = df.sparkSession
    as_micros = F.unix_micros(F.col(when).cast("timestamp")) if when else F.lit(None).cast("bigint")
    narrow = df.select(
        F.col(key).cast("string").alias("k"),
        (F.col(value).cast("bigint") if value else F.lit(None).cast("bigint")).alias("v"),
        as_micros.alias("t"),
        (F.col(ident).cast("string") if ident else F.lit(None).cast("string")).alias("i"),
    )
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    partial = narrow.mapInPandas(_split(max_slots), _FIELDS)
    # The bits of the hash that choose the partition are not those of the sub-hash.
    sub = partial.withColumn("sub", F.shiftright(F.xxhash64("key"), 52).cast("int"))
    merged = sub.repartition(n, "key").sortWithinPartitions("sub").mapInPandas(_reduce(max_slots), _FIELDS)
    at = lambda c, i: F.when(F.col(i).isNotNull(), F.timestamp_micros(F.col(c)).cast("timestamp_ntz"))
    return merged.select(
        "key",
        "n",
        "n_values",
        "total",
        F.when(F.col("n_values") > 0, F.col("largest")).alias("largest"),
        "first_id",
        at("t_first", "first_id").alias("first_at"),
        "last_id",
        at("t_last", "last_id").alias("last_at"),
    )
