"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspar.storage import Scratch, settings, shared_dir, stored

__all__ = ["Scratch", "settings", "shared_dir", "stored"]

#: The words of a text are its runs of bytes that are not ASCII white space.
SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts that go to a Python worker at once: Spark's default of 10,000 would hold tens of MB twice.
TEXTS_PER_BATCH = 1_000


def small_batches(docs: DataFrame) -> DataFrame:
    """docs, with Arrow batches kept small: texts are long, and executors' memory outside the heap is not.

    A plan reads this setting when it runs, which is after the operator has returned it: the setting stays.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXTS_PER_BATCH:
        conf.set(key, str(TEXTS_PER_BATCH))
    return docs


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fresh(docs: DataFrame, name: str) -> str:
    """The name, with underscores behind it until docs has no such column (in any case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(docs: DataFrame, *made: str) -> list[T.StructField]:
    """The fields of docs but its text and those that an operator makes itself: what it makes replaces them."""
    gone = {"text", *(m.lower() for m in made)}
    return [f for f in docs.schema.fields if f.name.lower() not in gone]


#: So many rows of a few numbers are some 30 MB.
FEW_ROWS = 1_000_000


def with_few(rows: DataFrame, other: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with other, which is shipped whole if it has FEW_ROWS at most, so that rows stay where they are."""
    return rows.join(F.broadcast(other) if other.count() <= FEW_ROWS else other, key, how)


def with_row_key(docs: DataFrame, key: str, keep: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """docs with a key for each row, so that null and repeated ids stay apart.

    Keys differ from one evaluation to the next where an input is not a file, or is split anew; they are
    therefore written once with the rows, and all that is later joined by them reads the same table.
    """
    return keep(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut where their texts exceed ``limit`` bytes (one row at least), with flat bytes and offsets."""
    for batch in batches:
        raw, at = flat(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), raw[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor) that spreads the bits of uint64 values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: The Mersenne prime that hashes of ranges are taken modulo, and their two bases: drawn once by ``secrets.randbelow``, and kept so that
#: runs repeat.  Modulo a prime, two different ranges of n symbols are equal for n of its bases at most, whatever the symbols
#: are; modulo a power of two all odd bases fail on the same (Thue-Morse) words.
PRIME = (1 << 61) - 1
BASES = (1000209743312065607, 54303900931196429)
#: Symbols that are summed at once: what a hash takes beside its places does not grow with the text.
STRIP = 1 << 16

_P, _LOW = np.uint64(PRIME), np.uint64((1 << 31) - 1)


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a * b modulo PRIME, of numbers up to PRIME."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW, b >> np.uint64(31), b & _LOW
    middle = a1 * b0 + a0 * b1
    return reduced(((a1 * b1) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a0 * b0)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


@cache
def power_table(base: int, n: int = STRIP) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo PRIME, by doubling."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = times(out[:more], np.uint64(pow(base, done, PRIME)))
        done += more
    return out


def prefix_sums(symbols: np.ndarray, places: np.ndarray, base: int) -> np.ndarray:
    """The sum of symbols[m] * base ** m for m < place, modulo PRIME, at ascending places; symbols: bytes, or numbers below PRIME."""
    out = np.zeros(len(places), np.uint64)
    table, before = power_table(base), 0
    cuts = np.searchsorted(places, np.arange(0, len(symbols) + STRIP, STRIP))
    strip_sum = np.zeros(STRIP + 1, np.uint64), np.zeros(STRIP + 1, np.uint64)
    for k, first in enumerate(range(0, len(symbols), STRIP)):
        part = symbols[first : first + STRIP]
        if symbols.dtype == np.uint8:  # sums of products with halves of the powers stay below 2 ** 64
            v, power = part.astype(np.uint64) + np.uint64(1), table[: len(part)]
            low, high = v * (power & _LOW), v * (power >> np.uint64(31))
        else:
            v = times(part, table[: len(part)])
            low, high = v & _LOW, v >> np.uint64(31)
        np.cumsum(low, out=strip_sum[0][1 : len(part) + 1])
        np.cumsum(high, out=strip_sum[1][1 : len(part) + 1])
        last = first + STRIP >= len(symbols)
        mine = slice(cuts[k], len(places) if last else cuts[k + 1])
        at = np.append(places[mine] - first, len(part))
        scale = np.uint64(pow(base, first, PRIME))
        sums = reduced(times(reduced(reduced(strip_sum[0][at]) + times(reduced(strip_sum[1][at]), np.uint64(1 << 31))), scale) + np.uint64(before))
        out[mine], before = sums[:-1], int(sums[-1])
    return out


def range_hash(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Hashes (below PRIME) of symbols[start:end] that do not depend on where the range stands; symbols: bytes, or such hashes."""
    if np.all(starts[1:] >= ends[:-1]) and np.all(starts <= ends):
        sums = prefix_sums(symbols, np.column_stack((starts, ends)).ravel(), base).reshape(-1, 2)
        begin, end = sums[:, 0], sums[:, 1]
    elif 2 * len(starts) > len(symbols):
        sums = prefix_sums(symbols, np.arange(len(symbols) + 1), base)
        begin, end = sums[starts], sums[ends]
    else:
        places, where = np.unique(np.concatenate((starts, ends)), return_inverse=True)
        begin, end = np.split(prefix_sums(symbols, places, base)[where], [len(starts)])
    inverse = pow(base, -1, PRIME)
    far = np.arange(0, len(symbols) + 1, STRIP)
    back = times(power_table(inverse)[starts % STRIP], np.array([pow(inverse, int(f), PRIME) for f in far], np.uint64)[starts // STRIP])
    return times(reduced(end + (_P - begin)), back)


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in raw) of all words of the rows, and the n + 1 offsets of each row's words."""
    solid = ~SPACE_BYTES[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = solid[:-1]
    inner = at[(at > 0) & (at < len(raw))]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(len(raw), bool)
    after[:-1] = solid[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length) for all pairs."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def excerpts(text: Column, longest: int, parts: int = 4) -> Column:
    """The text, or of one over ``longest`` bytes evenly spread parts of so many bytes at most together."""
    size = longest // parts // 4  # characters have 4 bytes at most
    apart = F.greatest(F.lit(0), F.length(text) - size) / (parts - 1)
    cut = F.concat_ws(" ", *(F.substring(text, (apart * i).cast("int") + 1, F.lit(size)) for i in range(parts)))
    return F.when(F.octet_length(text) <= longest, text).otherwise(cut)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, longest: int) -> list[tuple[str, int]]:
    """Texts and labels to fit a classifier on: at most ``per_class`` rows of each class (rounded up to 16), by hashed id.

    ``learn`` tells the rows of labels that may be learned from.  Of documents of over ``longest`` bytes
    excerpts are learned from, which bounds what comes to the driver.  An id that stands in several rows of
    either table is learned from once: with its smallest label and its smallest text.
    """
    # Ranked in 16 parts per class: no class meets in one task, and each task sends only its first rows.
    part = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(16))
    order = W.partitionBy("_label", "_part").orderBy(F.xxhash64("doc_id"), "doc_id")
    usable = labels.filter(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    picked = usable.groupBy("doc_id").agg(F.min(label).alias("_label")).withColumn("_part", part)
    picked = picked.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= -(-per_class // 16))
    picked = F.broadcast(picked.select("doc_id", "_label"))  # 2 * per_class rows, rounded up
    text = excerpts(F.coalesce("text", F.lit("")), longest)
    rows = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id").agg(F.min(text).alias("text"), F.min("_label").alias("_label")).collect()
    return [(r["text"], r["_label"]) for r in sorted(rows, key=lambda r: r["doc_id"])]
