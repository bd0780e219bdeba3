"""Exact n-gram Jaccard join by blocked sparse matrix products.

Documents with equal sets of shingles are one class at once.  Between classes:

1. Each set is ordered by ascending frequency, as far as it is known; two sets that are similar enough share
   one of their first shingles (their number follows from the set's size), and in the smaller set it is one of fewer still.
   Of shingles that stand in the same sets one is enough.
2. Sets that share such a shingle are compared by size and by a bitmap of the set, whose differing bits are never
   more than the sets' differing shingles.  What may still be similar is joined into clusters; of a
   cluster only a spanning forest leaves the task.  The sets of a hot shingle are first compared in blocks;
   only if these leave several clusters are the blocks, by ranges of sizes, compared in pairs.
   Bitmaps are bounded, so that sets of many more shingles all look alike: large clusters of such sets are
   told apart once more, by bitmaps that are as wide as the sets are large.
3. A cluster's sets become a sparse incidence matrix: each set is written as its difference from one set of the
   cluster, so that copies with few edits have few entries.  Blocks of bounded size are multiplied with each
   other's transpose; the overlap of two sets follows from that of their differences.  Pairs whose overlap so
   far and rest of entries cannot reach the bound that their sizes set are discarded.
4. The links that remain make the components.

Nothing is capped: a shingle or cluster of very many documents takes more blocks.  Null texts and
texts without words have the empty set and are linked with nothing.  With fewer words than a shingle has,
the whole sequence is the only one.  Repeated rows are equal sets.  A null doc_id takes part, but a
component is named by its smallest id that is not null.  An empty table has an empty result.  Other columns,
whatever their names, are ignored by ``jaccard_components`` and carried through by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspar.llm.common import BASES, Scratch, blocks, fresh, mixed, range_hash, ranges, small_batches, stored, table, with_few, with_row_key, word_spans
from larkspar.operators.components import components, forest

SHINGLE, PERCENT = 3, 90
BLOCK_BYTES = 2_000_000
#: A shingle that stands in more sets than this is frequent, if it comes to at most so many shingles.
FREQUENT, MOST_FREQUENT = 256, 200_000
#: Sets that meet in one block because of one shingle, and pairs that are compared at once.
BUCKET_BLOCK, PAIRS_AT_ONCE = 1_024, 400_000
#: Entries and sets of one block of a cluster, about; columns that are multiplied densely at once, and
#: the holders of a column from which on that is done instead of listing its pairs.
CLUSTER_BLOCK, CLUSTER_ROWS, COLUMNS, DENSE = 150_000, 1_000, 4_096, 24
#: Bits of a bitmap: the power of two next to the set's size, within these; bytes of the wide ones of one block, about.
LEAST_BITS, MOST_BITS, WIDE_BLOCK = 128, 4_096, 8_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and the n + 1 offsets."""
    start, end, word_at = word_spans(raw, at)
    lowered = LOWER[raw]
    word = mixed(range_hash(lowered, start, end)) ^ mixed(range_hash(lowered, start, end, BASES[1]) + np.uint64(1))
    counts = np.diff(word_at)
    shingles = np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)
    row = np.repeat(np.arange(len(counts)), shingles)
    first = ranges(word_at[:-1], shingles)
    last = np.minimum(first + k, word_at[1:][row])
    value = mixed((last - first).astype(np.uint64))
    for i in range(k):  # a chain of finalisers, no sum of products
        value = np.where(first + i < last, mixed(value + word[np.minimum(first + i, last - 1)]), value)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[keep], row[keep]
    return value, np.searchsorted(row, np.arange(len(counts) + 1))


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def bitmap_bits(sizes: np.ndarray, most: int | None = MOST_BITS) -> np.ndarray:
    return np.clip(2 ** np.ceil(np.log2(np.maximum(sizes, 1))), LEAST_BITS, most).astype(np.int64)


def bitmaps(values: np.ndarray, at: np.ndarray, most: int | None = MOST_BITS) -> list[bytes]:
    """Per row the parity of the shingles that fall on each bit."""
    out = []
    for i, bits in enumerate(bitmap_bits(np.diff(at), most).tolist()):
        odd = np.bincount((values[at[i] : at[i + 1]] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8)).tobytes())
    return out


def frequencies(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles, ascending, and the binary logarithm of how often they stand.

    A task reports the shingles that several of its texts hold.  What it misses only costs comparisons:
    any order finds all pairs.  At most MOST_FREQUENT come to the driver; these are the most frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw, at in blocks(batches, BLOCK_BYTES):
            token, n = np.unique(shingle_sets(raw, at, k)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token[n > 1].view(np.int64)), pa.array(n[n > 1])], ["token", "n"])

    with Scratch(rows.sparkSession) as scratch:
        counts = rows.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > FREQUENT)
        counts = scratch.stored(counts.withColumn("level", F.floor(F.log2("n")).cast("int")), "counts")
        levels = {r[0]: r[1] for r in counts.groupBy("level").count().collect()}
        least, total = 0, 0
        for level in sorted(levels, reverse=True):
            total += levels[level]
            if total > MOST_FREQUENT:
                least = level + 1
                break
        found = counts.filter(F.col("level") >= least).select("token", "level").toPandas()
    token = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], found["level"].to_numpy(np.uint64)[order]


def first_parts(rows: DataFrame, k: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row: size, digest of the set (d1, d2), the first shingles in order, and the bitmap."""
    late = rows.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT hashes and levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, level = late.value
        for batch, raw, at in blocks(batches, BLOCK_BYTES):
            value, set_at = shingle_sets(raw, at, k)
            size = np.diff(set_at)
            row = np.repeat(np.arange(len(size)), size)
            key = value >> np.uint64(6)
            if len(known):
                place = np.minimum(np.searchsorted(known, value), len(known) - 1)
                key |= np.where(known[place] == value, level[place], np.uint64(0)) << np.uint64(58)
            ordered = value[np.lexsort((key, row))]
            some = np.where(size > 0, size - -(-size * percent // 100) + 1, 0)
            firsts = ordered[ranges(set_at[:-1], some)].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(some)].astype(np.int32)), pa.array(firsts))
            d1, d2 = (sums(mixed(value + np.uint64(b)), set_at).view(np.int64) for b in BASES)
            columns = [batch.column("_row"), batch.column("doc_id"), pa.array(size), pa.array(d1), pa.array(d2), lists, pa.array(bitmaps(value, set_at), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "doc_id", "size", "d1", "d2", "firsts", "bitmap"])

    return rows.mapInArrow(run, "_row long, doc_id long, size long, d1 long, d2 long, firsts array<long>, bitmap binary")


def maybe_similar(bucket_rows: DataFrame, percent: int, keys: tuple[str, ...], at_once: int = 20_000) -> DataFrame:
    """Edges u, v of a spanning forest of sets that share a first shingle and may be similar.

    bucket_rows: the keys, side (pairs of different sides only count, or of any where it is -1), _row, label, size, smaller
    (whether it can be the smaller set of a pair here), bitmap.  Sets with one label are known to be in one cluster.
    About ``at_once`` rows are compared at once, or those of one key.
    """

    def pairs_of(t: pa.Table, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of rows behind it, in order of size, with the same keys and a size near enough."""
        columns = [t.column(c).to_numpy() for c in keys]
        head = np.r_[True, np.any([c[1:] != c[:-1] for c in columns], 0)]
        line = (np.cumsum(head) - 1) << 40
        i = np.arange(len(head))
        more = np.searchsorted(line + size, line + size * 100 // percent, "right") - i - 1
        return i, np.where(t.column("smaller").to_numpy(), more, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_tables(batches, keys, at_once):
            rows, size, side = (t.column(c).to_numpy() for c in ("_row", "size", "side"))
            maps = [np.frombuffer(b, np.uint8) for b in t.column("bitmap").to_pylist()]
            bits = np.array([8 * len(m) for m in maps])
            levels = sorted(set(bits.tolist()))
            folded = {w: np.stack([fold(m, w) for m in maps if 8 * len(m) >= w]).view(np.uint64) for w in levels}
            place = {w: np.cumsum(bits >= w) - 1 for w in levels}
            i, more = pairs_of(t, size)
            name, first, number = np.unique(rows, return_index=True, return_inverse=True)
            _, head, group = np.unique(t.column("label").to_numpy()[first], return_index=True, return_inverse=True)
            label = known = head[group]
            cut = np.cumsum(more)
            at = 0
            while at < len(i):
                stop = max(at + 1, int(np.searchsorted(cut, (cut[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
                a = np.repeat(i[at:stop], more[at:stop])
                b = ranges(i[at:stop] + 1, more[at:stop])
                at = stop
                keep = ((side[a] != side[b]) | (side[a] < 0)) & (label[number[a]] != label[number[b]])
                a, b = a[keep], b[keep]
                most = (size[a] + size[b]) * (100 - percent) // (100 + percent)
                width = np.minimum(bits[a], bits[b])
                near = np.zeros(len(a), bool)
                for w in levels:
                    of = np.flatnonzero(width == w)
                    for part in np.array_split(of, max(1, len(of) * w // 64 // 2_000_000 + 1)):
                        near[part] = np.bitwise_count(folded[w][place[w][a[part]]] ^ folded[w][place[w][b[part]]]).sum(1, dtype=np.int64) <= most[part]
                a, b = number[a[near]], number[b[near]]
                label = forest(len(name), np.r_[a, np.arange(len(name))], np.r_[b, label]) if len(a) else label
            moved = np.flatnonzero(label != known)
            yield pa.RecordBatch.from_arrays([pa.array(name[moved]), pa.array(name[label[moved]])], ["u", "v"])

    dealt = bucket_rows.repartition(*keys).sortWithinPartitions(*keys, "size")
    return dealt.mapInArrow(run, "u long, v long")


def fold(bitmap: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap of fewer bits."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, bits // 8), 0)


def key_tables(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], size: int) -> Iterator[pa.Table]:
    """Tables of about ``size`` rows that are never cut within a key, of batches sorted by the keys."""
    waiting: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        count += batch.num_rows
        if count >= size:
            whole = pa.Table.from_batches(waiting)
            columns = [whole.column(k).to_numpy() for k in keys]
            last = np.all([c == c[-1] for c in columns], 0)
            cut = int(np.argmax(last))
            if cut:
                yield whole.slice(0, cut)
            waiting = whole.slice(cut).combine_chunks().to_batches()
            count = len(whole) - cut
    if waiting:
        yield pa.Table.from_batches(waiting)


def overlaps(values: np.ndarray, at: np.ndarray, needed: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Which of the pairs ``alive`` of sparse rows share at least ``needed`` values: a symmetric matrix.

    The rows are an incidence matrix by columns.  A column with few holders adds its pairs one by one; columns
    with many are multiplied as blocks of the rows that still have open pairs.
    """
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((owner, values))
    owner, value = owner[order], values[order]
    head = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
    holders = np.diff(np.r_[head, len(value)])
    overlap = np.zeros((n, n), np.int32)
    rest = np.bincount(owner[np.repeat(holders > 1, holders)], minlength=n)  # shared entries that are yet to come

    dense = np.flatnonzero(holders >= DENSE)
    for first in range(0, len(dense), COLUMNS):
        part = dense[first : first + COLUMNS]
        alive &= overlap + np.minimum(rest[:, None], rest[None, :]) >= needed
        active = np.flatnonzero(alive.any(1))
        if not len(active):
            return alive
        entries, column = ranges(head[part], holders[part]), np.repeat(np.arange(len(part)), holders[part])
        place = np.full(n, -1)
        place[active] = np.arange(len(active))
        at_row = place[owner[entries]]
        block = np.zeros((len(active), len(part)), np.float32)
        block[at_row[at_row >= 0], column[at_row >= 0]] = 1
        overlap[np.ix_(active, active)] += (block @ block.T).astype(np.int32)
        rest -= np.bincount(owner[entries], minlength=n)

    sparse = np.flatnonzero((holders > 1) & (holders < DENSE))
    alive &= overlap + np.minimum(rest[:, None], rest[None, :]) >= needed
    if len(sparse) and alive.any():
        entries = ranges(head[sparse], holders[sparse])
        more = np.repeat(np.cumsum(holders[sparse]), holders[sparse]) - np.arange(len(entries)) - 1
        holder, cut = owner[entries], np.cumsum(more)
        begin = 0
        while begin < len(entries):
            end = max(begin + 1, int(np.searchsorted(cut, (cut[begin - 1] if begin else 0) + PAIRS_AT_ONCE, "right")))
            a = np.repeat(holder[begin:end], more[begin:end])
            b = holder[ranges(np.arange(begin, end) + 1, more[begin:end])]
            np.add.at(overlap, (a, b), 1)
            np.add.at(overlap, (b, a), 1)
            begin = end
    return alive & (overlap >= needed)


def differences(members: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Members of clusters (node, component, copies, blocks) with their set as a difference.

    The set that names the cluster is dealt to each of its blocks.  Per member: _row, component, copies, size of the set,
    base (size of the naming set), lost (shingles of that which the set lacks), delta (what only one of the two holds).
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in blocks(batches, BLOCK_BYTES):
            value, set_at = shingle_sets(raw, at, k)
            data = value.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", "component", "blocks", "copies")), pa.array([data[8 * i : 8 * j] for i, j in zip(set_at[:-1].tolist(), set_at[1:].tolist(), strict=True)], pa.binary())], ["_row", "component", "blocks", "copies", "set"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, base = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for row, component, copies, names, data in zip(*(batch.column(c).to_pylist() for c in ("_row", "component", "copies", "names", "set")), strict=True):
                own = np.frombuffer(data, np.uint64)
                if names:
                    name, base = component, own
                    continue
                assert component == name
                delta = np.setxor1d(own, base, assume_unique=True)
                out.append((row, component, copies, len(own), len(base), (len(base) - len(own) + len(delta)) // 2, delta.tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], ["_row", "component", "copies", "size", "base", "lost", "delta"])

    full = with_few(rows, members.withColumnRenamed("node", "_row"), "_row").select("_row", "text", "component", "blocks", "copies").mapInArrow(sets, "_row long, component long, blocks int, copies long, set binary")
    own = F.array(F.struct(F.pmod(F.xxhash64("_row"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("names")))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(True).alias("names")))
    dealt = full.withColumn("to", F.explode(F.when(F.col("_row") == F.col("component"), F.concat(own, every)).otherwise(own)))
    dealt = dealt.select("component", "to.block", "to.names", "_row", "copies", "set").repartition("component", "block").sortWithinPartitions("component", "block", F.desc("names"))
    return dealt.mapInArrow(run, "_row long, component long, copies long, size long, base long, lost long, delta binary")


def linked(deltas: DataFrame, percent: int) -> DataFrame:
    """Exact links within clusters (see differences): u, v of a forest, and degrees.

    Rows: u, v (equal where a set is a tree's root), links: how many documents the set is linked with here.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_tables(batches, ("component", "bi", "bj"), 1):
            key = [t.column(c).to_numpy() for c in ("component", "bi", "bj")]
            heads = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in key], 0)])
            for a, b in zip(heads.tolist(), np.r_[heads[1:], len(t)].tolist(), strict=True):
                part = t.slice(a, b - a)
                rows, block, copies, size, base, lost = (part.column(c).to_numpy() for c in ("_row", "block", "copies", "size", "base", "lost"))
                size, kept = size.astype(np.int32), (base - lost).astype(np.int32)
                # Of two sets: shared = base - lost - lost' + shared differences, and 100 * shared >= percent * (both - shared).
                total = size[:, None] + size[None, :]
                needed = -(-total * percent // (100 + percent)) - kept[:, None] + lost.astype(np.int32)[None, :]
                alive = 100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :])
                if key[1][a] != key[2][a]:
                    alive &= block[:, None] != block[None, :]
                np.fill_diagonal(alive, False)
                raw = part.column("delta").to_pylist()
                link = overlaps(np.frombuffer(b"".join(raw), np.uint64), np.r_[0, np.cumsum([len(x) // 8 for x in raw])], needed, alive)
                i, j = np.nonzero(link)
                label = forest(len(rows), i, j)
                links = link @ copies
                out = np.flatnonzero((links > 0) | (label != np.arange(len(rows))))
                yield pa.RecordBatch.from_arrays([pa.array(rows[out]), pa.array(rows[label[out]]), pa.array(links[out])], ["u", "v", "links"])

    entries = F.octet_length("delta") / 8
    weights = deltas.groupBy("component").agg(F.ceil(F.greatest(F.sum(entries) / CLUSTER_BLOCK, F.count("*") / CLUSTER_ROWS)).cast("int").alias("blocks"))
    met = deltas.join(weights, "component").withColumn("block", F.pmod(F.xxhash64("_row"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
    dealt = met.select("component", "bi", "bj", "block", "_row", "copies", "size", "base", "lost", "delta").repartition("component", "bi", "bj").sortWithinPartitions("component", "bi", "bj", "_row")
    return dealt.mapInArrow(products, "u long, v long, links long")


def shingle_rows(parts: DataFrame, copies: DataFrame, percent: int) -> DataFrame:
    """The first shingles (token) of the rows that are no copies (_row), with size and smaller: whether a pair whose smaller set
    this is may have it as its first common one."""
    one = with_few(parts, copies, "_row", "left_anti").select("_row", F.col("size").cast("int").alias("size"), F.posexplode("firsts").alias("place", "token"))
    return one.select("_row", "token", "size", (F.col("place") <= F.col("size") - F.ceil(F.col("size").cast("long") * F.lit(2 * percent) / F.lit(100 + percent))).alias("smaller"))


def worth_comparing(tokens: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The rows of tokens whose shingle several sets have that may be similar; of shingles that stand in the same sets one."""
    # Most stand once: they are dealt out once and counted there, as counts before that would hold (and spill) nearly every shingle.
    held = tokens.withColumn("n", F.count("*").over(W.partitionBy("token")))
    common = scratch.stored(held.filter("n > 1").drop("n"), "common")
    # The least set's size with a bit that is 0 if it can be the smaller one; sets by the sums (without carry) of their hashes.
    row = F.xxhash64("_row", "smaller")
    least = F.min(F.col("size").cast("long") * 2 + (~F.col("smaller")).cast("int")).alias("least")
    counts = common.groupBy("token").agg(F.count("*").alias("n"), F.max(F.col("smaller").cast("int")).alias("any"), least, F.max("size").alias("most"), F.bit_xor(row).alias("a"), F.bit_xor(F.xxhash64(row, F.lit(1))).alias("b"))
    # Of two sets the smaller must be able to be it, and be large enough; if both are of one size, either.
    size = F.floor(F.col("least") / 2)
    two = (size == F.col("most")) | ((F.col("least") % 2 == 0) & (size * 100 >= F.col("most") * percent))
    counts = counts.filter((F.col("any") == 1) & ((F.col("n") > 2) | two)).groupBy("n", "a", "b").agg(F.min("token").alias("token")).select("token", "n")
    return with_few(common, scratch.stored(counts, "counts"), "token")


def clusters_of(tokens: DataFrame, parts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Clusters (node, component) of sets that may be similar; tokens: see shingle_rows."""
    held = scratch.stored(worth_comparing(tokens, percent, scratch), "held")
    maps = parts.select("_row", "bitmap")
    blocks_of = F.ceil(F.col("n") / BUCKET_BLOCK)
    block = F.when(F.col("n") > BUCKET_BLOCK, F.pmod(F.xxhash64("_row", "token"), blocks_of)).otherwise(0).cast("int")
    alone = held.join(maps, "_row").select("token", block.alias("block"), F.lit(-1).alias("side"), "_row", F.col("_row").alias("label"), "size", "smaller", "bitmap")
    edges = scratch.stored(maybe_similar(alone, percent, ("token", "block")), "edges")
    joined = components(edges)
    hot = held.filter(F.col("n") > BUCKET_BLOCK)
    if hot.isEmpty():
        return joined
    # A hot shingle whose sets are in one cluster by now is done; the others' blocks are compared in pairs, by ranges of sizes.
    of_hot = hot.join(joined.withColumnRenamed("node", "_row"), "_row", "left").withColumn("label", F.coalesce("component", "_row"))
    open_ = of_hot.groupBy("token").agg((F.min("label") != F.max("label")).alias("open")).filter("open").select("token")
    of_open = of_hot.join(open_, "token").join(maps, "_row")
    band = F.floor(F.log("size") / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    met = of_open.withColumn("blocks", blocks_of.cast("int")).withColumn("side", F.pmod(F.xxhash64("_row"), F.col("blocks")).cast("int"))
    met = met.withColumn("band", F.explode(F.array(band, band - 1))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"bi": F.least("side", "other"), "bj": F.greatest("side", "other")})
    met = met.select("token", "band", "bi", "bj", F.when(F.col("bi") == F.col("bj"), -1).otherwise(F.col("side")).alias("side"), "_row", "label", "size", "smaller", "bitmap")
    return components(joined.toDF("u", "v").unionByName(maybe_similar(met, percent, ("token", "band", "bi", "bj"))))


def told_apart(clusters: DataFrame, sizes: DataFrame, rows: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """The clusters (node, component); those of more than one block with sets beyond MOST_BITS shingles are compared anew, by wide bitmaps.

    sizes: size of the set of each node.  A wide bitmap has a quarter of a byte for each shingle at most, so that a pair of blocks
    takes far less than the differences of its sets would.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in blocks(batches, BLOCK_BYTES):
            maps = bitmaps(*shingle_sets(raw, at, k), None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", "component", "size")), pa.array(maps, pa.binary())], ["_row", "component", "size", "bitmap"])

    members = clusters.join(sizes, "node")
    large = members.groupBy("component").agg(F.sum("size").alias("total"), F.max("size").alias("most"))
    large = scratch.stored(large.filter((F.col("total") > CLUSTER_BLOCK) & (F.col("most") > MOST_BITS)).select("component"), "large")
    if large.isEmpty():
        return clusters
    long = scratch.stored(with_few(members, large, "component").withColumnRenamed("node", "_row"), "long")
    maps = scratch.stored(with_few(rows, long, "_row").select("_row", "text", "component", "size").mapInArrow(run, "_row long, component long, size long, bitmap binary"), "wide")
    needed = F.greatest(F.count("*") / BUCKET_BLOCK, F.sum(F.octet_length("bitmap")) / WIDE_BLOCK)
    met = with_few(maps, maps.groupBy("component").agg(F.ceil(needed).cast("int").alias("blocks")), "component")
    met = met.withColumn("side", F.pmod(F.xxhash64("_row"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"bi": F.least("side", "other"), "bj": F.greatest("side", "other")})
    side = F.when(F.col("bi") == F.col("bj"), -1).otherwise(F.col("side"))
    met = met.select("component", "bi", "bj", side.alias("side"), "_row", F.col("_row").alias("label"), "size", F.lit(True).alias("smaller"), "bitmap")
    edges = scratch.stored(maybe_similar(met, percent, ("component", "bi", "bj"), 1), "edges")
    return with_few(clusters, large, "component", "left_anti").select("node", "component").unionByName(components(edges))


def found_components(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """rows: _row, doc_id, text. Per row: _row, doc_id, n_shingles, component (a _row), component_id, n_links."""
    with Scratch(rows.sparkSession) as scratch:
        parts = scratch.stored(first_parts(rows, k, percent, frequencies(rows, k)), "parts")
        classes = scratch.stored(parts.filter("size > 0").groupBy("d1", "d2", "size").agg(F.min("_row").alias("node"), F.count("*").alias("copies"), F.min("doc_id").alias("least")), "classes")
        slim = scratch.stored(parts.select("_row", "doc_id", "size", "d1", "d2"), "slim")
        same = slim.filter("size > 0").join(classes.select("d1", "d2", "size", "node"), ["d1", "d2", "size"]).filter("_row <> node").select("_row")
        clusters = clusters_of(shingle_rows(parts, scratch.stored(same, "copies"), percent), parts, percent, scratch)
        scratch.drop(parts)
        clusters = told_apart(clusters, classes.select("node", "size"), rows.select("_row", "text"), k, percent, scratch)

        members = clusters.join(classes.select("node", "size", "copies"), "node")
        weights = members.groupBy("component").agg(F.ceil(F.greatest(F.sum("size") / CLUSTER_BLOCK, F.count("*") / CLUSTER_ROWS)).cast("int").alias("blocks"))
        members = scratch.stored(members.join(weights, "component").select("node", "component", "copies", "blocks"), "members")
        deltas = scratch.stored(differences(members, rows.select("_row", "text"), k), "differences")
        links = scratch.stored(linked(deltas, percent), "links")
        joined = components(links.select("u", "v"))
        degree = links.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))

        named = classes.join(joined, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        named = scratch.stored(named.join(least, "component").select("d1", "d2", "size", "component", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
        found = slim.join(named, ["d1", "d2", "size"], "left")
        alone = F.col("size") == 0
        return stored(found.select("_row", "doc_id", F.col("size").alias("n_shingles"), F.when(alone, F.col("_row")).otherwise(F.col("component")).alias("component"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "components")


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: _row, doc_id, n_shingles, component (a _row), component_id, n_links (with other documents)."""
    with Scratch(docs.sparkSession) as scratch:
        return found_components(with_row_key(small_batches(docs).select(F.col("doc_id").cast("long"), "text"), "_row", scratch.stored), k, percent)


def one_of_each(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """docs with one row of each component: the smallest doc_id, and of its repeated rows one."""
    key = fresh(docs, "_row")
    rows = with_row_key(small_batches(docs), key)
    found = found_components(rows.select(F.col(key).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), k, percent)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("x")).select(F.col("x._row").alias("_row"))
    gone = stored(found.select("_row").join(first, "_row", "left_anti").withColumnRenamed("_row", key), "gone")
    return with_few(rows, gone, key, "left_anti").drop(key)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, n_links."""
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")
