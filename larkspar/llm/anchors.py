"""Where a string of fixed length may recur: shared by the operators that remove repeated passages.

A text is a row of symbols (bytes, or words).  Of each window of ``span`` symbols the leftmost gram
with the smallest hash is its anchor.  Equal windows have equal anchors at the same place, so all
occurrences of a window meet under the hash of its anchor, and a window whose anchor hash occurs once
in the corpus occurs once itself.  Neighbouring windows share anchors: a *segment* is the run of windows
of one row with one anchor, and each window belongs to exactly one segment.

Segments with equal symbols are one *content*; only contents travel, once per block of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspar.llm.common import BASES, mixed, range_hash


@dataclass(frozen=True)
class Grain:
    """The window's length and the gram's, in symbols; the gram's length is a power of two."""

    span: int
    gram: int

    @property
    def choices(self) -> int:
        return self.span - self.gram + 1


#: An odd multiplier; grams with equal hashes meet in vain, nothing else depends on it.
SPREAD = 0x9E3779B97F4A7C15


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram that begins at each symbol (the last gram - 1 are missing), by doubling."""
    h, n = symbols.astype(np.uint64) + np.uint64(1), 1
    while n < gram:
        h = h[:-n] * np.uint64(pow(SPREAD, n, 1 << 64)) + h[n:]
        n *= 2
    return mixed(h)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of values[i : i + width] for each i."""
    n = 1
    while 2 * n <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    return values if n == width else np.minimum(values[: len(values) - (width - n)], values[width - n :])


#: Windows whose anchors are searched at once: beside its rows, a long text takes some 15 bytes a symbol.
WINDOWS = 1 << 18


@dataclass
class Segments:
    """row: number of the row; anchor, first, last: symbols from the row's start; key: the anchor's hash; places: where anchors stand."""

    row: np.ndarray
    key: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray
    places: np.ndarray


def segments(symbols: np.ndarray, at: np.ndarray, grain: Grain, by_key: bool = False) -> Segments:
    """All segments of rows of symbols; ``by_key``: windows whose anchors are equal grams at different places are one segment.

    In a text that repeats a few symbols each window may have an anchor of its own, but all of these are equal.
    """
    n = len(symbols) - grain.span + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return Segments(none, none, none, none, none, none)
    anchor, key = np.empty(n, np.int32), np.empty(n, np.int64)  # of the window that begins at each symbol
    for first in range(0, n, WINDOWS):
        some = min(WINDOWS, n - first)
        hashes = gram_hashes(symbols[first : first + some + grain.span - 1], grain.gram)
        minima = window_minima((hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64), grain.choices)
        place = (minima & np.uint64(0xFFFFFFFF)).astype(np.int64)
        anchor[first : first + some] = place + first
        key[first : first + some] = hashes[place].view(np.int64)
    # Where a window begins that fits into no row, or a row begins, a run of windows ends.
    fits = np.ones(n, bool)
    for i, j in zip(at[1:-1].tolist(), np.maximum(at[:-2], at[1:-1] - grain.span + 1).tolist(), strict=True):
        fits[j : min(i, n)] = False
    other = np.ones(n, bool)
    named = key if by_key else anchor
    other[1:] = named[1:] != named[:-1]
    other[at[:-1][at[:-1] < n]] = True
    other[1:] |= ~fits[:-1]
    heads = np.flatnonzero(other & fits)
    if not len(heads):
        return Segments(none, none, none, none, none, none)
    ends = np.flatnonzero(np.r_[other[1:] | ~fits[1:], True] & fits)
    row = np.searchsorted(at, heads, "right") - 1
    moved = np.cumsum(np.r_[False, anchor[1:] != anchor[:-1]], dtype=np.int32)
    base = at[row]
    return Segments(row, key[heads], anchor[heads] - base, heads - base, ends - base, (moved[ends] - moved[heads] + 1).astype(np.int64))


def digests(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """122 bits that stand for symbols[start:end]: hashes with both bases, of ``second`` with the other one where symbols are hashes."""
    of = (symbols, symbols if second is None else second)
    return tuple(mixed(range_hash(x, starts, ends, base) + (ends - starts).astype(np.uint64)).view(np.int64) for x, base in zip(of, BASES, strict=True))


#: A key in more than one of so many rows is hot; there are no more hot keys than that.
HOT_KEYS = 20_000


def recurring(found: DataFrame, *columns: str) -> DataFrame:
    """Of segments (key, places and others) those whose key occurs again, be it in the segment itself.

    Hot keys are few by definition: they are shipped whole, and their rows stay where they are.  The rows of all
    other keys meet by key.
    """
    counts = found.groupBy("key").agg(F.sum("places").alias("n")).filter("n > 1")
    least = F.lit(max(1, found.count() // HOT_KEYS))
    hot = F.broadcast(counts.filter(F.col("n") > least).select("key"))
    calm = counts.filter(F.col("n") <= least).select("key")
    rows = found.select("key", *columns)
    return rows.join(hot, "key", "left_semi").unionByName(rows.join(hot, "key", "left_anti").join(calm, "key", "left_semi"))


def crowded(contents: DataFrame, size: Column, limit: int) -> DataFrame:
    """Keys whose different contents (key, d1, d2; each once) come to more than ``limit`` in total size, and that total."""
    return contents.groupBy("key").agg(F.sum(size).alias("total")).filter(F.col("total") > limit)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (past the last) of the runs of true values."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
