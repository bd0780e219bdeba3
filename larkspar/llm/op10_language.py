"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of its text is built; as a table of
transitions it recognises every substring of the sample.  A text is parsed greedily into the longest
phrases that occur in the sample; phrases times log2 of the sample's length, per symbol of the text, is
the cross entropy, and the language with the lowest wins.  Texts are parsed whole.  Stretches of a
fixed number of symbols are parsed in step, in all languages; then each stretch is begun again with the phrase that
the one before ended in, until both ways begin a phrase at one place, from where on they are the same.

Symbols are the bytes of the lower-cased letters; whatever is no letter counts as one space.  A text
that is null or has no letter is ``und`` with score 0; so is every text where nothing can be learned.
Ties go to the language that sorts first; repeated rows are texts of their own; an empty table has an empty
result.  Other columns are carried through; columns named lang_pred or score are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from larkspar.llm.common import blocks, flat, fresh, held_out, ranges, small_batches, table

#: What is learned from: documents per language at most, their bytes before excerpts are taken, and bytes per language.
SAMPLE_DOCS, SAMPLE_LONGEST, SAMPLE_BYTES = 100, 8_000, 24_000
#: Excerpts of a longer document, evenly spread.
EXCERPTS = 4
STRETCH = 2_048
BLOCK_BYTES = 3_000_000
UNKNOWN = "und"

LETTER = np.zeros(256, bool)
LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def letters(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of lower-cased text with each run of other bytes before a letter as one space."""
    is_letter = LETTER[raw]
    keep = is_letter.copy()
    keep[:-1] |= is_letter[1:]  # the last byte before a letter stands for the run
    last = at[1:][at[:-1] < at[1:]] - 1
    keep[last] = is_letter[last]
    out = np.where(is_letter, raw, 0x20).astype(np.uint8)[keep]
    return out, np.r_[0, np.cumsum(keep)][at]


def automaton(sample: bytes) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of the sample; state 0 is the empty string."""
    edges, link, length = [{}], [-1], [0]
    last = 0
    for c in sample:
        now = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = now
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                split = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[now] = split
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = split
                    p = link[p]
        last = now
    return edges


@dataclass
class Languages:
    """The automata of all languages in one table.

    ``steps[state * width + symbol]`` is twice the next state, plus 1 where a new phrase begins.
    """

    names: list[str]
    code: np.ndarray
    width: int
    starts: np.ndarray
    steps: np.ndarray
    bits: np.ndarray

    @classmethod
    def learn(cls, samples: dict[str, bytes]) -> Languages:
        names = sorted(samples)
        seen = sorted(set().union(*(set(s) for s in samples.values()))) if samples else []
        code = np.full(256, len(seen))
        code[seen] = range(len(seen))
        width = len(seen) + 1  # the last symbol occurs in no sample
        tables, starts = [], []
        for name in names:
            edges = automaton(samples[name])
            root = sum(len(t) for t in tables)
            steps = np.full((len(edges), width), -1, np.int64)
            for state, out in enumerate(edges):
                for c, target in out.items():
                    steps[state, code[c]] = 2 * (root + target)
            # One more state stands before each text and behind a symbol without transitions: there every symbol begins a phrase.
            start = root + len(edges)
            fresh = np.where(steps[0] >= 0, steps[0], 2 * start) | 1
            steps = np.where(steps < 0, fresh[None, :], steps)
            steps = np.concatenate([steps, fresh[None, :]])
            tables.append(steps.astype(np.int32))
            starts.append(start)
        bits = np.array([math.log2(len(samples[n]) + 2) for n in names])
        return cls(names, code.astype(np.uint8), width, np.array(starts), np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32), bits)

    def entropies(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Cross entropy in bits per symbol of each row (lower-cased UTF-8) for each language; NaN without letters."""
        text, at = letters(raw, at)
        sizes = np.diff(at)
        cuts = np.maximum(-(-sizes // STRETCH), 1)
        row = np.repeat(np.arange(len(sizes)), cuts)
        begin = at[row] + ranges(np.zeros(len(sizes), np.int64), cuts) * STRETCH
        length = np.minimum(at[row + 1] - begin, STRETCH)
        order = np.argsort(-length, kind="stable")
        begin, length, row = begin[order], length[order], row[order]
        symbols = self.code[text]
        state = np.repeat(self.starts[:, None], len(row), 1)
        phrases = np.zeros((len(self.names), len(row)), np.int64)
        active = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")
        for t, n in enumerate(active.tolist()):
            x = self.steps[state[:, :n] * self.width + symbols[begin[:n] + t][None, :]]
            phrases[:, :n] += x & 1
            state[:, :n] = x >> 1
        place = np.empty(len(row), np.int64)
        place[order] = np.arange(len(row))  # where each stretch, in order of the text, stands
        first = np.cumsum(cuts) - cuts
        for j in range(1, int(cuts.max(initial=1))):
            self.go_on(place[first[cuts > j] + j], place[first[cuts > j] + j - 1], symbols, begin, length, state, phrases)
        total = np.stack([np.bincount(row, p, len(sizes)) for p in phrases], 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return total * self.bits[None, :] / sizes[:, None]


    def go_on(self, own: np.ndarray, before: np.ndarray, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray, phrases: np.ndarray) -> None:
        """Corrects stretches ``own`` (phrases, last state) as those that follow on ``before``."""
        carried, fresh = state[:, before], np.repeat(self.starts[:, None], len(own), 1)
        for t in range(int(length[own].max())):
            on = np.flatnonzero((carried != fresh).any(0) & (t < length[own]))
            if not len(on):
                break
            x = symbols[begin[own[on]] + t][None, :]
            a, b = self.steps[carried[:, on] * self.width + x], self.steps[fresh[:, on] * self.width + x]
            phrases[:, own[on]] += (a & 1) - (b & 1)
            carried[:, on], fresh[:, on] = a >> 1, b >> 1
        apart = carried != fresh
        state[:, own] = np.where(apart, carried, state[:, own])


def excerpt(text: Column) -> Column:
    """The text, or of one over SAMPLE_LONGEST bytes evenly spread parts; ASCII other than letters is one space there."""
    part = SAMPLE_LONGEST // EXCERPTS // 4  # characters have 4 bytes at most
    plain = F.trim(F.regexp_replace(text, r"[\x00-\x7F&&[^A-Za-z]]+", " "))
    apart = F.greatest(F.lit(0), F.length(plain) - part) / (EXCERPTS - 1)
    parts = [F.substring(plain, (apart * i).cast("int") + 1, F.lit(part)) for i in range(EXCERPTS)]
    return F.when(F.octet_length(text) <= SAMPLE_LONGEST, text).otherwise(F.concat_ws(" ", *parts))


def sample(docs: DataFrame, learn: Column) -> dict[str, bytes]:
    """A bounded sample of text per value of lang; of long texts excerpts."""
    fit = docs.filter(learn & F.col("lang").isNotNull() & has_letter(F.col("text")))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = fit.select("doc_id", "lang").distinct().select("doc_id", "lang", F.row_number().over(order).alias("n")).filter(F.col("n") <= SAMPLE_DOCS)
    picked = F.broadcast(ids.select(F.col("doc_id").alias("id"), F.col("lang").alias("l")))  # SAMPLE_DOCS for each language
    # An id that stands in several rows is learned from once, with its smallest text.
    rows = fit.join(picked, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("l"))).groupBy("doc_id", "lang").agg(F.min(F.lower(excerpt(F.col("text")))).alias("text")).collect()
    out: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], hash_order(r["doc_id"] or 0), r["text"])):
        if len(out.get(r["lang"], b"")) < SAMPLE_BYTES:
            text, _ = letters(*flat(pa.array([r["text"]])))
            out[r["lang"]] = (out.get(r["lang"], b"") + b" " + text.tobytes())[: SAMPLE_BYTES + SAMPLE_LONGEST]
    return {k: v for k, v in out.items() if v.strip()}


def has_letter(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\p{L}")


def hash_order(doc_id: int) -> int:
    """A fixed scrambled order of ids."""
    return doc_id * 0x9E3779B97F4A7C15 % (1 << 64)


def identify(docs: DataFrame, languages: Languages, carry_text: bool = True) -> DataFrame:
    """docs (without their text, if it need not be carried) with lang_pred and score.

    The score is the runner-up's part of the two best entropies: 0.5 for a tie.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(languages)  # bounded by SAMPLE_BYTES and the number of languages
    lower, letter = fresh(docs, "_lower"), fresh(docs, "_letter")
    rest = [f for f in docs.schema.fields if f.name.lower() not in ("lang_pred", "score") and (carry_text or f.name != "text")]
    schema = T.StructType([*rest, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Languages = shared.value
        for batch, raw, at in blocks(batches, BLOCK_BYTES, lower):
            is_text = np.array(batch.column(letter).to_pylist(), bool)
            pred, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if model.names:
                e = model.entropies(raw, at)
                best = np.where(np.isnan(e), np.inf, e)
                first = best.argmin(1)
                rows = np.arange(len(best))
                low = best[rows, first]
                best[rows, first] = np.inf
                second = best.min(1)
                with np.errstate(invalid="ignore"):
                    margin = np.where(np.isinf(second), 1.0, second / (low + second))
                known = is_text & np.isfinite(low)
                pred[known], score[known] = np.array(model.names, object)[first[known]], margin[known]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*(f.name for f in rest), "lang_pred", "score"])

    text = F.coalesce("text", F.lit(""))
    made = small_batches(docs).withColumns({lower: F.lower(text), letter: has_letter(text)})
    return made.select(*[F.col(f"`{f.name}`") for f in rest], lower, letter).mapInArrow(run, schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. Learns from documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 3, 1)
    languages = Languages.learn(sample(docs.select("doc_id", "text", "lang"), ~out))
    found = identify(docs.select("doc_id", "text"), languages, carry_text=False)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
