"""Removal of repeated word passages with sharded Aho-Corasick automata.

1. Every window of ``length`` words gets its anchor (see anchors.py); windows whose anchor hash occurs
   once in the corpus are unique and go no further.
2. Recurring passages are confirmed: windows are compared word by word within the group of their anchor, or
   - where an anchor stands in very many different contents - counted by a BLAKE2 digest of their words, by an
   aggregation over all tasks.  Each run of recurring windows of a content is one passage; equal contents are brought together before.
3. Documents are dealt in shards of bounded size, and to each shard go the passages of contents that its documents have:
   they cover all that recurs there.  A shard's passages are compiled into automata, with a character per
   word, and all its documents are streamed, whole, through them.
4. The words that the automata locate are removed.

Words are runs of bytes that are not ASCII white space, unchanged.  Null has none.  Windows never
cross texts, but may recur within one.  Repeated rows and ids are texts of their own.  An empty table has an
empty result.  Other columns are carried through; those that are named as a result's are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspar.llm.anchors import Grain, Segments, crowded, digests, recurring, runs, segments
from larkspar.llm.common import BASES, Scratch, blocks, flat, fresh, others, range_hash, ranges, small_batches, stored, table, with_row_key, word_spans

LENGTH, GRAM = 35, 8
BLOCK_BYTES = 1_000_000
#: Contents whose windows are counted at once; an anchor with more different ones is counted over all tasks.
BATCH_CONTENTS, GROUP_CONTENTS = 2_000, 1_000
#: Bytes of the documents of a shard, about; words of the passages of one automaton, and of one piece of a passage at
#: most: some 50 MB each.  The first stays below the 1,056,767 characters that words become; the second is the depth of
#: the trie, which the library frees by recursion.
SHARD_BYTES, AUTOMATON, PIECE = 1_000_000, 400_000, 5_000
#: Words of a text that are streamed at once, and the longest window.
STREAMED, LONGEST = 100_000, 2_500
#: Words become characters from here on: above the code points that may not stand alone.
FIRST_CHARACTER = 0xE000


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of the words, the rows' offsets in words, and two hashes of each word."""
    start, end, word_at = word_spans(raw, at)
    return start, end, word_at, tuple(range_hash(raw, start, end, b) for b in BASES)


def find_segments(docs: DataFrame, grain: Grain) -> DataFrame:
    """Segments, in words, of the texts of docs (_row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in blocks(batches, BLOCK_BYTES):
            start, end, word_at = word_spans(raw, at)
            s: Segments = segments(range_hash(raw, start, end), word_at, grain, by_key=True)
            row = batch.column("_row").to_numpy()[s.row]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(s.key), *(pa.array(x.astype(np.int32)) for x in (s.first, s.last, s.places))], ["_row", "key", "first", "last", "places"])

    return docs.mapInArrow(run, "_row long, key long, first int, last int, places int")


def cut_contents(candidates: DataFrame, grain: Grain) -> DataFrame:
    """Contents of the segments of candidates (shard, text, segments), each once for a shard's texts of a block.

    shard, key, d1, d2, windows; and in one of a content's rows content (its words, joined by a space) and n (how often it
    stands in the block).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in blocks(batches, BLOCK_BYTES):
            lists = batch.column("segments")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            item = lists.flatten()
            key, first, last = (item.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("key", "first", "last"))
            shard = batch.column("shard").to_numpy()[row]
            start, end, word_at, hashes = words_of(raw, at)
            begin, stop = word_at[row] + first, word_at[row] + last + grain.span
            d1, d2 = digests(hashes[0], begin, stop, hashes[1])
            order = np.lexsort((shard, d2, d1, key))
            other = np.ones(len(order), bool)
            other[1:] = (np.diff(key[order]) != 0) | (np.diff(d1[order]) != 0) | (np.diff(d2[order]) != 0)
            heads = np.flatnonzero(other)
            n = np.zeros(len(order), np.int64)
            n[heads] = np.diff(np.r_[heads, len(order)])
            other[1:] |= np.diff(shard[order]) != 0
            one, n = order[other], n[other]
            data = raw.tobytes()
            texts = [" ".join([str(data[a:b], "utf-8") for a, b in zip(start[i:j].tolist(), end[i:j].tolist(), strict=True)]) if k else None for i, j, k in zip(begin[one].tolist(), stop[one].tolist(), n.tolist(), strict=True)]
            columns = [shard[one], key[one], d1[one], d2[one], (last - first + 1)[one].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(texts, pa.string()), pa.array(n)], ["shard", "key", "d1", "d2", "windows", "content", "n"])

    return candidates.mapInArrow(run, "shard int, key long, d1 long, d2 long, windows int, content string, n long")


def window_names(content: pa.Array | pa.ChunkedArray, windows: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows of some contents: the content's number, and a number that equal windows have, and no others.

    Words are numbered, then pairs of numbers, pairs of these, and so on up to the window: nothing is taken for
    equal because a hash is.
    """
    texts = [t.split(" ") for t in content.to_pylist()]
    known: dict[str, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    x = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(sizes.sum()))
    n = 1
    while n < span:
        step = min(n, span - n)
        x = np.unique(x[: len(x) - step] << 32 | x[step:], return_inverse=True)[1]
        n += step
    return np.repeat(np.arange(len(windows)), windows), x[ranges(np.cumsum(sizes) - sizes, windows)]


def window_digests(content: pa.Array, windows: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of some contents: the content's number, and 128 bits of the window's words."""
    raw, at = flat(content)
    start, end, word_at = word_spans(raw, at)
    begin, data = ranges(word_at[:-1], windows), memoryview(raw)
    found = b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(start[begin].tolist(), end[begin + span - 1].tolist(), strict=True))
    both = np.frombuffer(found, np.int64).reshape(-1, 2)
    return np.repeat(np.arange(len(windows)), windows), both[:, 0].copy(), both[:, 1].copy()


def grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of about ``size`` rows that are never cut within a key, of batches sorted by key."""
    waiting: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        waiting.append(batch)
        count += batch.num_rows
        if count >= size:
            whole = pa.Table.from_batches(waiting)
            key = whole.column("key").to_numpy()
            cut = int(np.searchsorted(np.r_[True, key[1:] != key[:-1]].cumsum(), np.r_[True, key[1:] != key[:-1]].sum()))
            if cut:
                yield whole.slice(0, cut)
            waiting = whole.slice(cut).combine_chunks().to_batches()
            count = len(whole) - cut
    if waiting:
        yield pa.Table.from_batches(waiting)


def confirmed(contents: DataFrame, hot: DataFrame, grain: Grain, scratch: Scratch) -> DataFrame:
    """The recurring passages (key, d1, d2, passage) of contents (key, d1, d2, windows, content, n; each once).

    hot: keys with so many contents that their windows are counted over all tasks.
    """
    passage = "key long, d1 long, d2 long, passage string"

    def passages(t: pa.Table | pa.RecordBatch, again: np.ndarray) -> pa.RecordBatch:
        """Runs of the windows ``again``, as words, of each content; a run does not go on in the next content."""
        windows = t.column("windows").to_numpy().astype(np.int64)
        at = np.r_[0, np.cumsum(windows)]
        edge = np.diff(np.r_[0, again.astype(np.int8), 0])
        heads = at[:-1][at[:-1] < len(again)]
        begins = np.union1d(np.flatnonzero(edge == 1), heads[again[heads]])
        inner = at[1:-1]
        ends = np.union1d(np.flatnonzero(edge == -1), inner[again[inner - 1]])
        owner = np.searchsorted(at, begins, "right") - 1
        texts = []
        content = t.column("content").to_pylist()
        words, last = [], -1
        for o, i, j in zip(owner.tolist(), (begins - at[owner]).tolist(), (ends - at[owner]).tolist(), strict=True):
            if o != last:
                words, last = content[o].split(" "), o
            texts.append(" ".join(words[i : j - 1 + grain.span]))
        return pa.RecordBatch.from_arrays([*(pa.array(t.column(c).to_numpy()[owner]) for c in ("key", "d1", "d2")), pa.array(texts, pa.string())], ["key", "d1", "d2", "passage"])

    def in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, BATCH_CONTENTS):
            if len(t):
                windows = t.column("windows").to_numpy().astype(np.int64)
                owner, name = window_names(t.column("content"), windows, grain.span)
                yield passages(t, (np.bincount(name)[name] > 1) | (t.column("n").to_numpy()[owner] > 1))

    def all_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = batch.column("windows").to_numpy().astype(np.int64)
            owner, w1, w2 = window_digests(batch.column("content"), windows, grain.span)
            place = ranges(np.zeros(len(windows), np.int64), windows)
            columns = [batch.column(c).to_numpy()[owner] for c in ("key", "d1", "d2", "n")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(place.astype(np.int32)), pa.array(w1), pa.array(w2)], ["key", "d1", "d2", "n", "place", "w1", "w2"])

    def by_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("places")
            at = np.cumsum(np.r_[0, batch.column("windows").to_numpy()])
            again = np.zeros(int(at[-1]), bool)
            again[np.repeat(at[:-1], np.diff(lists.offsets.to_numpy())) + lists.flatten().to_numpy()] = True
            yield passages(batch, again)

    calm = contents.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInArrow(in_groups, passage)
    dense = contents.join(F.broadcast(hot.select("key")), "key")  # a hot key has GROUP_CONTENTS contents
    each = scratch.stored(dense.mapInArrow(all_windows, "key long, d1 long, d2 long, n long, place int, w1 long, w2 long"), "windows")  # made once, read twice
    often = each.groupBy("w1", "w2").agg(F.sum("n").alias("n")).filter("n > 1").select("w1", "w2")
    places = each.join(often, ["w1", "w2"]).groupBy("key", "d1", "d2").agg(F.collect_set("place").alias("places"))
    found = dense.join(places, ["key", "d1", "d2"]).select("key", "d1", "d2", "windows", "content", "places").mapInArrow(by_places, passage)
    return calm.unionByName(found)


class Automata:
    """The automata of a shard's passages.

    A passage is a run of recurring windows: one of over PIECE words is taken in pieces that have ``span - 1`` words in
    common, so that each window is in one of them.
    """

    def __init__(self, span: int) -> None:
        self.span, self.piece = span, max(PIECE, 2 * span)
        self.shard, self.waiting, self.size, self.made = None, [], 0, []

    def begin(self, shard: int) -> None:
        self.shard, self.waiting, self.size, self.made = shard, [], 0, []

    def add(self, passage: str) -> None:
        words = passage.split(" ")
        for first in range(0, max(1, len(words) - self.span + 1), self.piece - self.span + 1):
            part = words[first : first + self.piece]
            if self.size + len(part) > AUTOMATON:
                self.compile()
            self.waiting.append(part)
            self.size += len(part)

    def compile(self) -> None:
        known: dict[str, str] = {}
        automaton = ahocorasick.Automaton()
        for words in self.waiting:
            for w in words:
                if w not in known:
                    known[w] = chr(FIRST_CHARACTER + 1 + len(known))
            automaton.add_word("".join([known[w] for w in words]), len(words))
        if self.waiting:
            automaton.make_automaton()
            self.made.append((known, automaton))
        self.waiting, self.size = [], 0

    def located(self, n: int, words_of: Callable[[int, int], list[str]]) -> Iterator[tuple[int, int]]:
        """Begins and ends of all places of the passages in a text of n words, which are asked for in strips.

        Strips have piece - 1 words in common, so that each place is in one of them.
        """
        self.compile()
        other = chr(FIRST_CHARACTER)
        for first in range(0, max(1, n - self.piece + 1), STREAMED) if self.made else ():
            words = words_of(first, min(n, first + STREAMED + self.piece - 1))
            for known, automaton in self.made:
                for last, size in automaton.iter("".join([known.get(w, other) for w in words])):
                    yield first + last + 1 - size, first + last + 1


def streamed(docs: DataFrame, passages: DataFrame, span: int, rest: list[T.StructField], keep_text: bool) -> DataFrame:
    """docs (shard, text, row: a struct of other columns) through the automata of their shard's passages (shard, passage)."""
    made = "n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    inner = docs.schema["row"]
    schema = T.StructType([inner, *T.StructType.fromDDL(made).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = Automata(span)
        for batch, raw, at in blocks(batches, BLOCK_BYTES):
            shards, passage = batch.column("shard").to_pylist(), batch.column("passage").to_pylist()
            start, end, word_at = word_spans(raw, at)
            gone = np.zeros(len(start) + 1, np.int32)
            data = raw.tobytes()
            for i, (shard, p) in enumerate(zip(shards, passage, strict=True)):
                if shard != automata.shard:
                    automata.begin(shard)
                if p is not None:
                    automata.add(p)
                elif automata.made or automata.waiting:
                    a, b = word_at[i], word_at[i + 1]
                    for x, y in automata.located(int(b - a), lambda i, j, a=a: [str(data[x:y], "utf-8") for x, y in zip(start[a + i : a + j].tolist(), end[a + i : a + j].tolist(), strict=True)]):
                        gone[a + x] += 1
                        gone[a + y] -= 1
            stay = np.cumsum(gone[:-1]) == 0
            is_doc = np.flatnonzero([p is None for p in passage])
            if not len(is_doc):
                continue
            kept_at = np.r_[0, np.cumsum(stay)][word_at]
            a, b = start[stay], end[stay]
            # All kept words, each with a space behind it, in one go.
            sizes = b - a + 1
            joined = np.append(raw, np.uint8(0x20))[ranges(a, sizes)]
            ends = np.cumsum(sizes)
            joined[ends - 1] = 0x20
            cuts = np.r_[0, ends][kept_at]
            view = memoryview(joined)
            kept = [view[i : max(i, j - 1)] for i, j in zip(cuts[is_doc].tolist(), cuts[is_doc + 1].tolist(), strict=True)]
            n_words, n_kept = np.diff(word_at)[is_doc], np.diff(kept_at)[is_doc]
            columns = [batch.column("row").take(pa.array(is_doc)), pa.array(n_words), pa.array(n_words - n_kept), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            names = ["row", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns.append(pa.array([str(k, "utf-8") for k in kept], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    nothing = F.lit(None)
    of_docs = docs.select("shard", "row", F.coalesce("text", F.lit("")).alias("text"), nothing.cast("string").alias("passage"))
    of_passages = passages.select("shard", nothing.cast(inner.dataType).alias("row"), F.lit("").alias("text"), "passage")
    dealt = of_passages.unionByName(of_docs).repartition("shard").sortWithinPartitions("shard", F.col("passage").isNull())
    out = dealt.mapInArrow(run, schema)
    return out.select(*[F.col("row").getField(f.name).alias(f.name) for f in rest], *[c for c in out.columns if c != "row"])


def remove_phrases(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """docs without text, with what the removal of repeated windows of ``length`` words leaves of it.

    Adds n_words, n_removed, kept_sha256, and on request kept: the kept words joined by a space.  A window has 2 to
    LONGEST words.
    """
    if not 2 <= length <= LONGEST:
        raise ValueError(f"windows have 2 to {LONGEST} words, not {length}")
    grain = Grain(length, min(GRAM, 1 << (length // 2).bit_length() - 1))
    rest = others(docs, "n_words", "n_removed", "kept_sha256", *["kept"] * keep_text)
    key = fresh(docs, "_key")
    rows = with_row_key(small_batches(docs).select(F.struct(F.lit(0).alias(key), *[F.col(f"`{f.name}`") for f in rest]).alias("row"), "text"), "_row")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("_row"), F.lit(size // SHARD_BYTES + 1)).cast("int"))
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.stored(find_segments(rows.select("_row", "text"), grain), "segments")
        again = recurring(found, "_row", "first", "last").groupBy("_row").agg(F.collect_list(F.struct("key", "first", "last")).alias("segments"))  # bounded by the row's own text
        cut = scratch.stored(cut_contents(rows.select("_row", "shard", "text").join(again, "_row"), grain), "cut")
        scratch.drop(found)
        contents = cut.filter("content IS NOT NULL").groupBy("key", "d1", "d2").agg(F.max("windows").alias("windows"), F.first("content").alias("content"), F.sum("n").alias("n"))
        contents = scratch.stored(contents, "contents")
        hot = scratch.stored(crowded(contents, F.lit(1), GROUP_CONTENTS), "hot")
        passages = scratch.stored(confirmed(contents, hot, grain, scratch), "passages")
        scratch.drop(contents)
        routed = stored(cut.select("shard", "key", "d1", "d2").distinct().join(passages, ["key", "d1", "d2"]).select("shard", "passage").distinct(), "routed")
    return streamed(rows, routed, length, rest, keep_text)


def op4_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    return remove_phrases(table(spark, sf_dir, "documents").select("doc_id", "text"))
