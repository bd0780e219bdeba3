"""Quality classification by a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of it.  Learned filters over a few neighbouring
bytes run along each chunk; each filter's responses are max-pooled within the chunk, the chunks are
combined by their maximum and their mean, and a logistic unit makes one probability of them.  The
filters are kept as one table per byte position, so that a convolution is a sum of table rows.

Null counts as empty; an empty text is scored as one chunk of padding.  A text of any length is scored whole, in strips of
chunks.  Equal texts have equal scores; repeated rows are scored each.  Without labels to learn from, or with one label only,
all scores are the same; an empty table has an empty result.  Other columns are carried through; one named score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspar.llm.common import blocks, held_out, labelled_sample, others, ranges, small_batches, table

WIDTH, STRIDE, FILTERS = 8, 4, 16
#: Chunks start every CHUNK - OVERLAP bytes; both are multiples of STRIDE.
CHUNK, OVERLAP = 512, 64
#: Bytes of a long text that are taken at once: whole chunks.
STRIP = 2_000 * (CHUNK - OVERLAP) + OVERLAP
#: Documents per class that are learned from at most, and their bytes at most.
SAMPLE_DOCS, SAMPLE_LONGEST = 1_200, 16_000
EPOCHS, BATCH, RATE = 6, 24, 0.02
BLOCK_BYTES = 2_000_000


def chunk_starts(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of each chunk of rows of bytes; an empty row has one empty chunk."""
    sizes = np.diff(at)
    step = CHUNK - OVERLAP
    counts = np.maximum(1, -(-np.maximum(sizes - OVERLAP, 1) // step))
    row = np.repeat(np.arange(len(sizes)), counts)
    inside = ranges(np.zeros(len(sizes), np.int64), counts) * step
    return row, at[row] + inside, np.minimum(CHUNK, sizes[row] - inside)


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 * FILTERS: of the maximum and of the mean over chunks
    offset: np.ndarray  # 1

    @classmethod
    def fresh(cls, seed: int) -> Network:
        r = np.random.default_rng(seed)
        f = np.float32
        return cls(r.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(f), np.zeros(FILTERS, f), r.normal(0, 0.3, 2 * FILTERS).astype(f), np.zeros(1, f))

    def pooled(self, raw: np.ndarray, at: np.ndarray):
        """Rows of chunks, each filter's largest response in each chunk, and the byte where it stands."""
        row, start, length = chunk_starts(at)
        padded = np.r_[raw, np.zeros(CHUNK + WIDTH, np.uint8)]
        places = np.maximum(1, -(-(length - WIDTH) // STRIDE) + 1)
        place = np.repeat(start, places) + ranges(np.zeros(len(places), np.int64), places) * STRIDE
        end = np.repeat(start + length, places)
        heads = np.cumsum(places) - places
        response = np.repeat(self.bias[None, :], len(place), 0)
        for k in range(WIDTH):
            byte = padded[place + k]
            if k:
                byte = np.where(place + k < end, byte, 0)  # beyond the chunk's end: padding
            else:
                byte = np.where(place < end, byte, 0)
            response += self.filters[k].take(byte, axis=0)
        return row, place, end, heads, places, padded, response

    def features(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each row the largest and the mean of its chunks' maxima; texts beyond a strip are taken strip by strip."""
        if len(at) == 2 and at[1] - at[0] > STRIP:
            step = STRIP - OVERLAP
            cuts = [raw[at[0] + i : min(at[1], at[0] + i + STRIP)] for i in range(0, int(at[1] - at[0] - OVERLAP), step)]
            tops = [self.chunk_tops(cut, np.array([0, len(cut)]))[1] for cut in cuts]
            top, row = np.concatenate(tops), np.zeros(sum(map(len, tops)), np.int64)
        else:
            row, top = self.chunk_tops(raw, at)
        first = np.searchsorted(row, np.arange(len(at) - 1))
        chunks = np.diff(np.r_[first, len(row)])[:, None]
        return np.concatenate([np.maximum.reduceat(top, first, axis=0), np.add.reduceat(top, first, axis=0) / chunks], 1)

    def chunk_tops(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, _, _, heads, _, _, response = self.pooled(raw, at)
        return row, np.maximum(np.maximum.reduceat(response, heads, axis=0), 0)

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return np.zeros(0)
        z = self.features(raw, at).astype(np.float64) @ self.weights.astype(np.float64) + float(self.offset[0])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def gradients(self, raw: np.ndarray, at: np.ndarray, y: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
        """Of the weighted logistic loss, for all parameters."""
        row, place, end, heads, places, padded, response = self.pooled(raw, at)
        n, chunks = len(at) - 1, len(heads)
        peak = np.maximum.reduceat(response, heads, axis=0)
        is_peak = response == np.repeat(peak, places, 0)
        where = np.full((chunks, FILTERS), len(response))
        at_row, at_filter = np.nonzero(is_peak)
        np.minimum.at(where, (np.repeat(np.arange(chunks), places)[at_row], at_filter), at_row)
        top = np.maximum(peak, 0)
        first = np.searchsorted(row, np.arange(n))
        count = np.diff(np.r_[first, chunks])
        high = np.maximum.reduceat(top, first, axis=0)
        x = np.concatenate([high, np.add.reduceat(top, first, axis=0) / count[:, None]], 1)
        p = 1 / (1 + np.exp(-np.clip(x @ self.weights + self.offset, -40, 40)))
        d = (p - y) * share / n
        to_top = (d[:, None] * self.weights[None, FILTERS:] / count[:, None])[row] + (d[:, None] * self.weights[None, :FILTERS])[row] * (top == high[row])
        to_top = (to_top * (peak > 0)).astype(np.float32)
        g = np.zeros_like(self.filters)
        filters = np.broadcast_to(np.arange(FILTERS), where.shape)
        for k in range(WIDTH):
            byte = np.where(place[where] + k < end[where], padded[place[where] + k], 0)
            np.add.at(g[k], (byte, filters), to_top)
        return [g, to_top.sum(0), (x * d[:, None]).sum(0), np.array([d.sum()])]

    @classmethod
    def fit(cls, examples: list[tuple[str, int]], prior: float = 0.5, seed: int = 7) -> Network:
        """Adam over mini-batches; together the examples of label 1 count as the part ``prior`` of all.

        A short excerpt of each example is learned from as well, so that short texts are not strange.
        """
        net, r = cls.fresh(seed), np.random.default_rng(seed)
        starts = [int(r.integers(0, max(1, len(t) - 30))) for t, _ in examples]
        examples = [*examples, *((t[i : i + int(r.integers(10, 250))], y) for i, (t, y) in zip(starts, examples, strict=True) if len(t) > 60)]
        texts = [np.frombuffer(t.encode(), np.uint8) for t, _ in examples]
        y = np.array([label for _, label in examples], np.float32)
        if not len(y) or y.min() == y.max():
            net.weights[:] = 0
            net.offset[:] = 0 if not len(y) else (4 if y[0] else -4)
            return net
        share = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean())).astype(np.float32)
        values = [net.filters, net.bias, net.weights, net.offset]
        mean, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
        step, steps = 0, EPOCHS * -(-len(y) // BATCH)
        for _ in range(EPOCHS):
            order = r.permutation(len(y))
            for at in range(0, len(y), BATCH):
                part = order[at : at + BATCH]
                raw = np.concatenate([texts[i] for i in part])
                ends = np.r_[0, np.cumsum([len(texts[i]) for i in part])]
                step += 1
                rate = RATE * (1 - step / (steps + 1))
                for v, g, m, s in zip(values, net.gradients(raw, ends, y[part], share[part]), mean, square, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return net


def scored(docs: DataFrame, score, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without text, with score: ``score(raw, at)`` of a block of texts, shipped to the executors once."""
    shared = docs.sparkSession.sparkContext.broadcast(score)  # a fitted model: its size does not depend on the data
    rest = others(docs, "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in blocks(batches, block_bytes):
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(shared.value(raw, at), pa.float64())], [*(f.name for f in rest), "score"])

    return small_batches(docs).select("text", *[F.col(f"`{f.name}`") for f in rest]).mapInArrow(run, T.StructType([*rest, T.StructField("score", T.DoubleType())]))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Learns labels.quality outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 3, 1)
    labels = table(spark, sf_dir, "labels")
    # The share of label 1 among all rows that may be learned from: short texts say little, and lean to what is usual.
    prior = labels.filter(~out & F.col("quality").isin(0, 1)).agg(F.coalesce(F.avg("quality"), F.lit(0.5))).first()[0]
    net = Network.fit(labelled_sample(docs, labels, "quality", ~out, SAMPLE_DOCS, SAMPLE_LONGEST), prior)
    return scored(docs, net.score).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
