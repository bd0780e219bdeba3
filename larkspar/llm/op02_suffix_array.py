"""Removal of repeated byte strings with a Burrows-Wheeler transform per shard.

1. Every window of ``length`` bytes gets its anchor (see anchors.py); windows whose anchor hash occurs
   once in the corpus are unique and go no further.
2. The contents that may recur are dealt by anchor hash.  Where one anchor stands in very many different
   contents (the edge of a passage that many texts share), its windows are split by their offset
   into classes with a longer common core, again and again; a class of one window has one content.
3. A shard joins its contents, builds the suffix array and its Burrows-Wheeler transform, and derives
   common prefixes by increasing value: an interval of suffixes that share a string is extended backward
   by every byte before it, breadth first; where an extended interval ends at a border that is not
   set yet, the border's value is the level.  At ``length`` the expansion stops: borders still not set
   stand between suffixes that share ``length`` bytes.
4. Repeated windows go back to all occurrences of their content, and the texts lose what they cover.

Null counts as empty; texts shorter than ``length`` stay whole; windows never cross texts, but may
recur within one.  Repeated rows and ids are texts of their own.  A character may be cut; the digest is of
the remaining bytes.  An empty table has an empty result.  Other columns are carried through; those that are
named as a result's are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspar.llm.anchors import Grain, crowded, digests, recurring, runs, segments
from larkspar.llm.common import Scratch, blocks, fresh, others, ranges, small_batches, stored, table, with_row_key

LENGTH, GRAM = 400, 32
BLOCK_BYTES = 1_500_000
#: Bytes of contents that one transform is built of, about; and a group of more bytes than GROUP_BYTES is split.
#: Together they stay below 2 ** 21, so that three ranks fit into one key and a task holds some 200 MB.
SHARD_BYTES, GROUP_BYTES = 600_000, 1_400_000
#: Symbols (9 bits each) that make the first key of a suffix.
PACKED = 7

CONTENT = "key long, d1 long, d2 long, windows int, low int, high int, anchor int, content binary, n long"


def suffix_array(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered by their first ``depth`` symbols at least (ties by position), and the packed first keys."""
    n = len(codes)
    padded = np.r_[codes, np.zeros(PACKED, codes.dtype)].astype(np.uint64)
    packed = np.zeros(n, np.uint64)
    for k in range(PACKED):
        packed = packed << np.uint64(9) | padded[k : n + k]
    order = np.argsort(packed, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0

    def number(members: np.ndarray, same: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Ranks (place of the first equal) of sorted members; same: equal to the one before."""
        place = base + np.arange(len(members))
        rank[members] = np.maximum.accumulate(np.where(same, 0, place)) if len(members) else place
        tied = same.copy()
        tied[:-1] |= same[1:]
        return members[tied]

    sorted_keys = packed[order]
    open_ = number(order, np.r_[False, sorted_keys[1:] == sorted_keys[:-1]], np.zeros(n, np.int64))
    rank[:n] += 1  # 0 is past the end
    done = PACKED
    while done < depth and len(open_):
        bits = np.uint64(21)
        after = rank[np.minimum(open_ + done, n)].astype(np.uint64)
        beyond = rank[np.minimum(open_ + 2 * done, n)].astype(np.uint64)
        own = rank[open_]
        key = own.astype(np.uint64) << (bits * np.uint64(2)) | after << bits | beyond
        by = np.argsort(key, kind="stable")
        open_, key, own = open_[by], key[by], own[by]
        same = np.r_[False, key[1:] == key[:-1]]
        head = np.r_[True, own[1:] != own[:-1]]
        place = np.arange(len(open_))
        inside = place - np.maximum.accumulate(np.where(head, place, 0))
        value = own + inside
        rank[open_] = value[np.maximum.accumulate(np.where(same, 0, place))]
        tied = same.copy()
        tied[:-1] |= same[1:]
        open_ = open_[tied]
        done *= 3
    return np.argsort(rank[:n], kind="stable"), packed


def long_common_prefixes(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and for each place in it whether it shares ``length`` symbols with the place before."""
    n = len(codes)
    order, packed = suffix_array(codes, length)
    bwt = codes[order - 1]
    back = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)  # where the suffix one symbol longer stands
    step[back] = np.arange(n)
    common = np.full(n + 1, -1, np.int16)
    common[0] = common[n] = 0
    # Values below PACKED show in the packed keys; the expansion begins with the intervals of PACKED symbols.
    differ = packed[order[1:]] ^ packed[order[:-1]]
    level = min(PACKED, length)
    inner = common[1:n]
    for k in range(level):
        inner[(inner < 0) & (differ >= np.uint64(1) << np.uint64(9 * (PACKED - 1 - k)))] = k
    borders = np.flatnonzero(common >= 0)
    low, high = borders[:-1], borders[1:] - 1
    fresh = common[high + 1] == level - 1
    fresh &= high + 1 < n
    low, high = low[fresh], high[fresh]
    while level < length and len(low):
        single = low == high
        at = step[low[single]]
        new_low, new_high = [at], [at]
        low, high = low[~single], high[~single]
        if len(low):
            sizes = high - low + 1
            member = ranges(low, sizes)
            target = step[member]
            # Within an interval the targets of one symbol are neighbours, and those of different symbols are not mixed.
            key = np.repeat(np.arange(len(low)), sizes) * 512 + bwt[member]
            by = np.lexsort((target, key))
            key, target = key[by], target[by]
            head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            new_low.append(target[head])
            new_high.append(target[np.r_[head[1:], len(key)] - 1])
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        fresh = common[high + 1] < 0
        low, high = low[fresh], high[fresh]
        common[high + 1] = level
        level += 1
    return order, common[:n] < 0


def repeated_windows(contents: list[bytes], windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each window of each content also starts elsewhere among the contents; and the contents' offsets."""
    sizes = np.array([len(c) for c in contents])
    begin = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    codes = raw.astype(np.uint16) + 1
    codes[begin + sizes] = 0
    order, shared = long_common_prefixes(codes, length)
    own = np.zeros(len(codes), bool)
    own[ranges(begin, windows)] = True
    counts = own[order]
    # Two neighbours count only if both are windows; then neither reaches a separator within the length.
    pair = shared & counts
    pair[1:] &= counts[:-1]
    pair[0] = False
    hit = pair.copy()
    hit[:-1] |= pair[1:]
    found = np.zeros(len(codes), bool)
    found[order[hit]] = True
    return found, begin


def find_segments(docs: DataFrame, grain: Grain) -> DataFrame:
    """Segments of the texts of docs (_row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in blocks(batches, BLOCK_BYTES):
            s = segments(raw, at, grain)
            row = batch.column("_row").to_numpy()[s.row]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(s.key), *(pa.array(x.astype(np.int32)) for x in (s.anchor, s.first, s.last))], ["_row", "key", "anchor", "first", "last"])

    return docs.mapInArrow(run, "_row long, key long, anchor int, first int, last int")


def cut_contents(candidates: DataFrame, grain: Grain) -> DataFrame:
    """The occurrences of segments of candidates (_row, text, segments); the first of a content in a block holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in blocks(batches, BLOCK_BYTES):
            lists = batch.column("segments")
            counts = np.diff(lists.offsets.to_numpy())
            item = lists.flatten()
            key, anchor, first, last = (item.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("key", "anchor", "first", "last"))
            row = np.repeat(np.arange(batch.num_rows), counts)
            start, end = at[row] + first, at[row] + last + grain.span
            d1, d2 = digests(raw, start, end)
            yield occurrence_batch(key, d1, d2, batch.column("_row").to_numpy()[row], first, last, anchor - first, [(raw, start, end)])

    return candidates.mapInArrow(run, "_row long, first int, " + CONTENT)


def occurrence_batch(key, d1, d2, row, first, last, anchor, source) -> pa.RecordBatch:
    raw, start, end = source[0]
    order = np.lexsort((d2, d1, key))
    head = np.r_[True, (key[order][1:] != key[order][:-1]) | (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])] if len(order) else np.zeros(0, bool)
    begins = np.flatnonzero(head)
    holder = np.zeros(len(key), np.int64)
    holder[order[begins]] = np.diff(np.r_[begins, len(order)])
    data = memoryview(np.ascontiguousarray(raw))
    content = [bytes(data[a:b]) if n else None for a, b, n in zip(start.tolist(), end.tolist(), holder.tolist(), strict=True)]
    windows = last - first + 1
    # Offsets of the anchor in the windows: from low (the last window) to high (the first).
    columns = [row, first.astype(np.int32), key, d1, d2, windows.astype(np.int32), (anchor - windows + 1).astype(np.int32), anchor.astype(np.int32), anchor.astype(np.int32)]
    names = ["_row", "first", "key", "d1", "d2", "windows", "low", "high", "anchor"]
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(content, pa.binary()), pa.array(holder)], [*names, "content", "n"])


def split_classes(contents: DataFrame, span: int) -> DataFrame:
    """Each content's windows in two classes by the anchor's offset, dealt by the class's common core.

    Classes halve a fixed grid of offsets: ``class_low`` to ``class_high`` of the row.
    Returns parent digests with skip (windows before the part) and the columns of a content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                lo, hi = r["class_low"], r["class_high"]
                middle = (lo + hi) // 2
                for a, b in ((lo, middle), (middle + 1, hi)):
                    low, high = max(a, r["low"]), min(b, r["high"])
                    if a > b or low > high:
                        continue
                    skip = r["high"] - high
                    part = r["content"][skip : skip + high - low + span]
                    # The bytes that all windows of the class hold: it is the same part of the text for every content.
                    core = r["content"][r["anchor"] - a : r["anchor"] - b + span]
                    own, group = hashlib.sha256(part).digest(), hashlib.sha256(b"%d,%d,%d," % (r["key"], a, b) + core).digest()
                    whole = lambda x: int.from_bytes(x, "little", signed=True)
                    out.append((r["d1"], r["d2"], r["key"], skip, a, b, whole(group[:8]), whole(own[:8]), whole(own[8:16]), high - low + 1, low, high, r["anchor"] - skip, part, r["n"]))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PARTS.values(), strict=True)], list(PARTS))

    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return contents.mapInArrow(run, ", ".join(f"{k} {names[t]}" for k, t in PARTS.items()))


PARTS = {
    "parent1": pa.int64(), "parent2": pa.int64(), "parent_key": pa.int64(), "skip": pa.int32(), "class_low": pa.int32(), "class_high": pa.int32(), "key": pa.int64(), "d1": pa.int64(), "d2": pa.int64(),
    "windows": pa.int32(), "low": pa.int32(), "high": pa.int32(), "anchor": pa.int32(), "content": pa.binary(), "n": pa.int64(),
}


def different(contents: DataFrame) -> DataFrame:
    """Each content once, with how often it stands; partial sums are made before contents meet."""
    same = ("windows", "low", "high", "anchor", "class_low", "class_high")
    return contents.groupBy("key", "d1", "d2").agg(*[F.max(c).alias(c) for c in same], F.first("content").alias("content"), F.sum("n").alias("n"))


def repeats_in_shards(contents: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows (key, d1, d2, begin, end) of different contents, by a transform of each shard's contents."""

    def solve(group: list[tuple]) -> Iterator[tuple]:
        found, begin = repeated_windows([r[4] for r in group], np.array([r[3] for r in group]), length)
        for r, at in zip(group, begin.tolist(), strict=True):
            if r[5] > 1:  # the whole content recurs
                yield r[0], r[1], r[2], 0, r[3]
            else:
                for a, b in zip(*runs(found[at : at + r[3]]), strict=True):
                    yield r[0], r[1], r[2], int(a), int(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*solve(group), strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.int32(),) * 2, strict=True)], ["key", "d1", "d2", "begin", "end"])

        group: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "d1", "d2", "windows", "content", "n")), strict=True):
                if size >= SHARD_BYTES and group[-1][0] != r[0]:
                    yield out(group)
                    group, size = [], 0
                size += len(r[4]) + 1
                group.append(r)
        if group:
            yield out(group)

    dealt = contents.select("key", "d1", "d2", "windows", "content", "n").repartition("key").sortWithinPartitions("key", "d1", "d2")
    return dealt.mapInArrow(run, "key long, d1 long, d2 long, begin int, end int")


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """docs: _row, text. For each _row with repeats the list ``spans`` of covered (begin, end) bytes, which may overlap."""
    grain = Grain(length, min(GRAM, 1 << (length // 2).bit_length() - 1))
    base = ["base_key", "base1", "base2"]
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.stored(find_segments(docs, grain), "segments")
        again = recurring(found.withColumn("places", F.lit(1)), "_row", "anchor", "first", "last").groupBy("_row").agg(F.collect_list(F.struct("key", "anchor", "first", "last")).alias("segments"))  # bounded by the row's own text
        occurrences = scratch.stored(cut_contents(docs.join(again, "_row"), grain), "occurrences")
        scratch.drop(found)
        contents = occurrences.filter("content IS NOT NULL").select("key", "d1", "d2", "windows", "low", "high", "anchor", "content", "n")
        contents = scratch.stored(different(contents.withColumns({"class_low": F.lit(0), "class_high": F.lit(grain.choices - 1)})), "contents")
        places = occurrences.select("_row", "first", "key", "d1", "d2")
        links = repeats = None  # links: of the parts of split contents, where they stand in these
        while True:
            hot = scratch.stored(crowded(contents, F.col("windows") + (length - 1), GROUP_BYTES).select("key"), "crowded")
            split = not hot.isEmpty()
            found = repeats_in_shards(contents.join(hot, "key", "left_anti") if split else contents, length)
            if links is None:
                found = found.toDF(*base, "begin", "end")
            else:
                found = links.join(found, ["key", "d1", "d2"]).select(*base, (F.col("begin") + F.col("skip")).alias("begin"), (F.col("end") + F.col("skip")).alias("end"))
            repeats = found if repeats is None else repeats.unionByName(found)
            if not split:
                break
            # The crowded groups in finer classes; their contents are few beside the occurrences, which stay where they are.
            parts = scratch.stored(split_classes(contents.join(F.broadcast(hot), "key"), length), "parts")  # a crowded group has GROUP_BYTES
            contents = scratch.stored(different(parts.select(*contents.columns)), "contents")
            of = parts.select("parent_key", "parent1", "parent2", F.col("skip").alias("more"), "key", "d1", "d2").distinct()
            if links is None:
                links = of.select(F.col("parent_key").alias("base_key"), F.col("parent1").alias("base1"), F.col("parent2").alias("base2"), F.col("more").alias("skip"), "key", "d1", "d2")
            else:
                above = links.withColumnsRenamed({"key": "parent_key", "d1": "parent1", "d2": "parent2"})
                links = above.join(of, ["parent_key", "parent1", "parent2"]).select(*base, (F.col("skip") + F.col("more")).alias("skip"), "key", "d1", "d2")
            links = scratch.stored(links, "links")
        places = places.withColumnsRenamed({"key": "base_key", "d1": "base1", "d2": "base2"})
        spans = places.join(repeats, base).select("_row", (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("end") + (length - 1)).alias("end"))
        return stored(spans.groupBy("_row").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "spans")


def without_spans(rows: DataFrame, spans: DataFrame, rest: list[T.StructField], keep_text: bool = False) -> DataFrame:
    """rows (_row, row: a struct of other columns, text): these columns, n_bytes, n_removed, n_spans, kept_sha256, and on request what is left."""
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in blocks(batches, BLOCK_BYTES):
            cover = np.zeros(len(raw) + 1, np.int32)
            lists = batch.column("spans")
            counts = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0)
            item = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), counts)
            begin, end = (at[row] + item.field(f).to_numpy(zero_copy_only=False) for f in ("begin", "end"))
            np.add.at(cover, begin, 1)
            np.add.at(cover, end, -1)
            gone = np.cumsum(cover[:-1]) > 0
            removed = np.r_[0, np.cumsum(gone)]
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            inner = at[:-1][at[:-1] < len(raw)]
            starts[inner] = gone[inner]
            begun = np.r_[0, np.cumsum(starts)]
            kept = [raw[a:b][~gone[a:b]].tobytes() if removed[b] > removed[a] else raw[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            columns = [batch.column("row"), pa.array(np.diff(at)), pa.array(np.diff(removed[at])), pa.array(np.diff(begun[at])), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            names = ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    out = rows.join(spans, "_row", "left").drop("_row").mapInArrow(run, schema)
    return out.select(*[F.col("row").getField(f.name).alias(f.name) for f in rest], *[c for c in out.columns if c != "row"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """docs without text, with what the removal of repeated strings of ``length`` bytes leaves of it.

    Adds n_bytes, n_removed, n_spans, kept_sha256, and on request kept: the remaining bytes.
    """
    rest = others(docs, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text)
    rows = with_row_key(small_batches(docs).select(F.struct(F.lit(0).alias(fresh(docs, "_key")), *[F.col(f"`{f.name}`") for f in rest]).alias("row"), "text"), "_row")
    return without_spans(rows, repeated_spans(rows.select("_row", "text"), length), rest, keep_text)


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
