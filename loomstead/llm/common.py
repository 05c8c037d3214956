"""Shared helpers: staged tables (of the library), worker caches, words and shingle hashes."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.plans.staging import staged, unstage  # noqa: F401  for the operators

#: A word of the contracts, as a regular expression of Java and of Python.
WORD = r"[^\x20\x09-\x0D]+"
MASK = (1 << 64) - 1
#: Slots of the fixed bitmap (64 bits each, 2 MB) that leaves out most texts without a candidate before they are dealt out.
SLOTS = 1 << 17
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def maybe_among(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """rows whose column may be among keys, and all that are: told by one bit of a bitmap of fixed size, which is broadcast."""
    slot, bit = f"pmod({column}, {SLOTS})", f"cast(shiftrightunsigned({column}, 40) & 63 as int)"
    bits = keys.groupBy(F.expr(slot).alias("_slot")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("_bits"))
    return rows.join(F.broadcast(bits), F.expr(slot) == F.col("_slot")).where(F.expr(f"(_bits & shiftleft(1L, {bit})) <> 0")).drop("_slot", "_bits")


def drop_shuffles(df: DataFrame) -> None:
    """Have the driver look for shuffle files that no later step reads; they stay until its garbage is collected."""
    df.sparkSession._jvm.System.gc()


def worker_cache(name: str, make):
    """One object for each Python worker process, kept between its tasks."""
    kept = sys.__dict__.setdefault("_loomstead_cache", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def n_words(text: str = "text") -> Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def crc32_remainder(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; 0 where the column is null."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)), F.lit(0))


#: ASCII white space, as WORD excludes it and as bytes.split parts at it.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RADIX = 0x2545F4914F6CDD1D


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, and a number for each byte."""

    def __init__(self) -> None:
        self.bytes = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIERS[2])) | np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, r, np.uint64))), dtype=np.uint64) for r in (_RADIX, pow(_RADIX, -1, 1 << 64)))


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a text in UTF-8."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_IS_SPACE[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers = worker_cache("powers", _Powers)
    powers.reach(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(powers.bytes[data] * powers.up[: len(data)], out=sums[1:])
    return starts, ends, mixed((sums[ends] - sums[starts]) * powers.down[starts])


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words of a text, in order, with A-Z lower-cased if asked for."""
    if not text:
        return np.empty(0, np.uint64)
    raw = text.encode("utf-8", "surrogatepass")
    return word_spans(raw.lower() if lower else raw)[2]  # bytes.lower changes A-Z only


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    k = min(k, len(words))
    total, spread = np.zeros(len(words) - k + 1, np.uint64), mixed(words)
    for j in range(k):
        total *= np.uint64(_MULTIPLIERS[0])
        total += spread[j : len(words) - k + 1 + j]
    return mixed(total + np.uint64((k * _MULTIPLIERS[1]) & MASK))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles."""
    return np.unique(window_hashes(word_hashes(text), k))
