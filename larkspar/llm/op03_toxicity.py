"""Toxicity by compression distance, with zstandard dictionaries.

Two dictionaries are trained on labelled text: one on the words of ordinary documents, one on the
passages of toxic documents that ordinary ones do not hold.  A text is cut into windows of whole words;
each is compressed on the background of ordinary text, with and without the toxic passages behind that.
How much shorter the second is, is the window's gain: without toxic passages there is next to none.  The
two largest gains, the sums of gains over two calibrated thresholds and the number of windows make the score, by a
logistic unit fitted on labelled documents that the dictionaries have not seen.

The whole text is scored.  Null counts as empty; a text without words has no gain.  Equal texts have equal scores;
repeated rows are scored each.  Without labels to learn from, or with one label only, all scores are the same; an empty table
has an empty result.  Other columns are carried through; one named score is replaced.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspar.llm.common import held_out, labelled_sample, table
from larkspar.llm.op05_quality import scored

#: Labelled documents per class that are learned from at most, and their bytes at most.
SAMPLE_DOCS, SAMPLE_LONGEST = 2_500, 16_000
#: The part of the sample that dictionaries are trained on; the rest calibrates.
TRAINED = 0.6
WINDOW = 64
GRAM, GRAM_LEAST, GRAM_ODDS = 5, 6, 3.6
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 3_072
LEVEL = 3
#: How far the second threshold of gains is above the first.
HIGHER = 3
BLOCK_BYTES = 2_000_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def windows(text: bytes) -> list[bytes]:
    """Runs of whole words of WINDOW bytes at least (the last may be shorter), with one space around each word."""
    out, run, size = [], [], 0
    for word in WORD.findall(text):
        run.append(word)
        size += len(word) + 1
        if size >= WINDOW:
            out.append(b" " + b" ".join(run) + b" ")
            run, size = [], 0
    if run:
        out.append(b" " + b" ".join(run) + b" ")
    return out


def spaced(text: str) -> list[bytes]:
    return [b" " + w + b" " for w in WORD.findall(text.lower().encode())]


def in_documents(texts: list[list[bytes]], grams: bool) -> Counter:
    """In how many documents each word, or each gram of a word, stands."""
    seen: Counter = Counter()
    for words in texts:
        seen.update({w[i : i + GRAM] for w in set(words) for i in range(len(w) - GRAM + 1)} if grams else set(words))
    return seen


def toxic_passages(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> Counter:
    """The parts of words of toxic documents that are covered by grams which ordinary documents hardly hold."""
    t, o = in_documents(toxic, True), in_documents(ordinary, True)
    odds = lambda g: np.log((t[g] + 0.5) / (len(toxic) + 1)) - np.log((o[g] + 0.5) / (len(ordinary) + 1))
    telling = {g for g, n in t.items() if n >= GRAM_LEAST and odds(g) > GRAM_ODDS}
    found: Counter = Counter()
    for word, n in Counter(w for words in toxic for w in words).items():
        at = [i for i in range(len(word) - GRAM + 1) if word[i : i + GRAM] in telling]
        first = last = -1
        for i in at:
            if first >= 0 and i <= last:
                last = i + GRAM
            else:
                if first >= 0:
                    found[word[first:last]] += n
                first, last = i, i + GRAM
        if first >= 0:
            found[word[first:last]] += n
    return found


def dictionary(parts: Counter, size: int, per_sample: int) -> bytes:
    """A trained zstandard dictionary's bytes; where there is too little to train on, the parts themselves."""
    pool = [p for p, n in sorted(parts.items()) for _ in range(min(n, 40))]
    random.Random(0).shuffle(pool)
    samples = [b"".join(pool[i : i + per_sample]) for i in range(0, len(pool), per_sample)]
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(p for p, _ in parts.most_common())[:size]


@dataclass
class Classifier:
    ordinary: bytes
    toxic: bytes
    threshold: int = 2
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))
    _pair: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pair": None}

    def compressors(self) -> tuple:
        if self._pair is None:
            p = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, dict_size=1 << 16, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
            made = []
            for data in (self.ordinary, self.ordinary + self.toxic):
                d = zstandard.ZstdCompressionDict(data or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=p)
                made.append(zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress)
            self._pair = tuple(made)
        return self._pair

    def gains(self, text: bytes) -> list[int]:
        plain, primed = self.compressors()
        return [len(plain(w)) - len(primed(w)) for w in windows(text)]

    def features(self, gains: list[int]) -> list[float]:
        first, second = (sorted(gains, reverse=True) + [0, 0])[:2]
        high = lambda least: np.log1p(sum(g for g in gains if g >= least))
        return [1.0, first / 8, second / 8, high(self.threshold), high(self.threshold + HIGHER), np.log1p(len(gains))]

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        data, ends = raw.tobytes(), at.tolist()
        texts = (str(data[a:b], "utf-8").lower().encode() for a, b in zip(ends[:-1], ends[1:], strict=True))
        x = np.array([self.features(self.gains(t)) for t in texts]).reshape(-1, 6)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))

    @classmethod
    def fit(cls, examples: list[tuple[str, int]]) -> Classifier:
        r = random.Random(11)
        order = list(examples)
        r.shuffle(order)
        cut = int(len(order) * TRAINED)
        trained, rest = order[:cut], order[cut:]
        toxic, ordinary = ([spaced(t) for t, y in trained if y == label] for label in (1, 0))
        out = cls(dictionary(in_documents(ordinary, False), ORDINARY_BYTES, 12), dictionary(toxic_passages(toxic, ordinary), TOXIC_BYTES, 8))
        y = np.array([y for _, y in rest], float)
        if not len(y) or y.min() == y.max():
            out.weights = np.array([0.0 if not len(y) else 8 * y[0] - 4, 0, 0, 0, 0, 0])
            return out
        gains = [out.gains(t.lower().encode()) for t, _ in rest]
        best = None
        for threshold in range(1, 8):
            out.threshold = threshold
            x = np.array([out.features(g) for g in gains])
            w = logistic(x, y)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            loss = -np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))
            if best is None or loss < best[0]:
                best = loss, threshold, w
        _, out.threshold, out.weights = best
        return out


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a light ridge, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Learns labels.toxic outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 0)
    model = Classifier.fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", ~out, SAMPLE_DOCS, SAMPLE_LONGEST))
    return scored(docs, model.score, BLOCK_BYTES).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
