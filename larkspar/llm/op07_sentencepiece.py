"""SentencePiece encoding and decoding with a BPE model, by vectorised merge rounds.

The model's pieces never hold a space mark behind another character and never hold a character that
the model spells as bytes, so a text falls into independent words there.  The words of a block that
are not yet known are laid out in flat arrays of symbols; each round finds, per word, the smallest rank
of a neighbouring pair and merges its leftmost occurrences at once, then compacts the arrays, until no
pair is left.  Words met before come from a bounded table of each Python worker.

Null and empty texts have no tokens and decode to the empty text.  Words of any length go through the same
rounds: of a word of many thousand symbols each round takes all places of one pair.  Equal texts have equal ids; repeated rows
are encoded each; an empty table has an empty result.  Other columns are carried through; those that are named as a
result's are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspar.llm.common import blocks, others, small_batches, table

SPACE = "▁"
#: Words that a worker keeps at most; beyond that it starts anew.
KEPT_WORDS = 250_000
BLOCK_BYTES = 4_000_000


class Merger:
    """Tables of a BPE model, and the merge rounds."""

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(re.search(f"[^{SPACE}]{SPACE}", pieces[i]) for i in plain):
            raise ValueError("a piece of the model crosses words")
        self.unknown = sp.unk_id()
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(sp.is_byte(i) for i in range(size)) else None
        self.symbols = {pieces[i]: i for i in plain}
        self.text = {i: pieces[i].replace(SPACE, " ") for i in plain}
        for c in sorted({c for i in plain for c in pieces[i]} - self.symbols.keys()):
            self.symbols[c] = size + len(self.symbols)  # a character that only occurs inside of pieces
        self.piece_count = size
        self.digits = [str(i) for i in range(size)]
        score = {i: sp.get_score(i) for i in plain}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {i: order[s] for i, s in score.items()}
        self.width = size + len(self.symbols) + 1
        pairs = {}
        for i in plain:
            p = pieces[i]
            for cut in range(1, len(p)):
                a, b = self.symbols.get(p[:cut]), self.symbols.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = i
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.ranks = np.array([self.rank[i] for i in self.made.tolist()], np.int64)
        # A merge is done everywhere at once only if no pair that it makes possible ranks before it.
        self.single = np.zeros(self.width, bool)
        for key, i in pairs.items():
            for part in divmod(key, self.width):
                if part in self.rank and self.rank[i] <= self.rank[part]:
                    self.single[part] = True
        known = "".join(re.escape(c) for c in self.symbols if len(c) == 1)
        #: A word: space marks and what follows them; or one character that the model has no symbol for.
        self.words = re.compile(f"[^{known}]|{SPACE}+[{known.replace(SPACE, '')}]*|[{known.replace(SPACE, '')}]+")
        self.cache: dict[str, tuple[str, str]] = {}
        self.chunks: dict[str, tuple[str, str]] = {}

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Indexes of pairs in the tables, or -1."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def rounds(self, flat: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the symbols of many words; word: the ascending word number of each symbol."""
        done_symbols, done_words = [], []
        none = np.iinfo(np.int64).max
        pair = np.full(len(flat), -1)
        inner = word[:-1] == word[1:]
        pair[:-1][inner] = self.lookup(flat[:-1][inner], flat[1:][inner])
        while len(flat):
            rank = np.where(pair >= 0, self.ranks[pair], none)
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[heads, len(word)])
            best = np.minimum.reduceat(rank, heads)
            if (ended := best == none).any():  # compaction: words without a pair leave
                out = np.repeat(ended, sizes)
                done_symbols.append(flat[out])
                done_words.append(word[out])
                stay = ~out
                flat, word, pair, rank = flat[stay], word[stay], pair[stay], rank[stay]
                sizes, best = sizes[~ended], best[~ended]
                if not len(flat):
                    break
                heads = np.cumsum(sizes) - sizes
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            new_word = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            # Leftmost merges: in a run of adjacent hits every other one; one merge per word where order matters.
            run = np.r_[True, hit[1:] != hit[:-1] + 1] | new_word
            place = np.arange(len(hit))
            inside = place - np.maximum.accumulate(np.where(run, place, 0))
            risky = self.single[self.made[pair[hit]]]
            first_of_word = np.maximum.accumulate(np.where(new_word, place, 0))
            risky_word = np.maximum.reduceat(risky, np.flatnonzero(new_word))[np.cumsum(new_word) - 1]
            hit = hit[np.where(risky_word, place == first_of_word, inside % 2 == 0)]
            flat[hit] = self.made[pair[hit]]
            keep = np.ones(len(flat), bool)
            keep[hit + 1] = False
            touched = np.zeros(len(flat), bool)
            touched[hit] = True
            touched[np.maximum(hit - 1, 0)] = True
            # Where the symbol before was swallowed itself, its head stands one place further left.
            touched[np.maximum(hit - 2, 0)] = True
            flat, word, pair, touched = flat[keep], word[keep], pair[keep], touched[keep]
            look = np.flatnonzero(touched[:-1])
            pair[touched] = -1
            look = look[word[look] == word[look + 1]]
            pair[look] = self.lookup(flat[look], flat[look + 1])
        if not done_words:
            return flat, word
        order = np.argsort(np.concatenate(done_words), kind="stable")
        return np.concatenate(done_symbols)[order], np.concatenate(done_words)[order]

    def spelled(self, word: str, symbols: list[int]) -> tuple[str, str]:
        """Ids of a word's symbols joined by commas, and what they decode to."""
        if len(word) == 1 and word not in self.symbols:
            if self.byte is None:
                return str(self.unknown), " ⁇ "
            raw = word.encode()
            return ",".join(str(self.byte[b]) for b in raw), raw.decode()
        if max(symbols) < self.piece_count:
            return ",".join([self.digits[s] for s in symbols]), "".join([self.text[s] for s in symbols])
        names = {i: c for c, i in self.symbols.items()}
        parts = [self.spelled(names[s], []) if s >= self.piece_count and self.byte is None else (",".join(str(self.byte[b]) for b in names[s].encode()), names[s]) if s >= self.piece_count else (str(s), self.text[s]) for s in symbols]
        return ",".join(p[0] for p in parts), "".join(p[1] for p in parts)

    def forget(self) -> None:
        self.cache.clear()
        self.chunks.clear()

    def learn(self, words: list[str]) -> None:
        """Encodes words into the table."""
        code, short = self.symbols, []
        for w in words:
            if len(w) == 1:
                self.cache[w] = self.spelled(w, [code.get(w, -1)])
            else:
                short.append(w)
        if not short:
            return
        sizes = np.fromiter(map(len, short), np.int64, len(short))
        flat = np.fromiter(map(code.__getitem__, "".join(short)), np.int64, int(sizes.sum()))
        flat, word = self.rounds(flat, np.repeat(np.arange(len(short)), sizes))
        ends = np.searchsorted(word, np.arange(len(short)), "right").tolist()
        flat, begin = flat.tolist(), 0
        for w, end in zip(short, ends, strict=True):
            self.cache[w] = self.spelled(w, flat[begin:end])
            begin = end

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text the ids joined by commas, and the text that they decode to."""
        # A chunk starts at a single space (left out) or at a line break; chunks recur, so that few need to be split.
        plain = [not ("  " in t or " \n" in t or SPACE in t or t[:1] in " \n" or t[-1:] in ("", " ")) for t in texts]
        split = [t.replace("\n", " \n").split(" ") if p else self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t, p in zip(texts, plain, strict=True)]
        for kept in (self.cache, self.chunks):
            if len(kept) > KEPT_WORDS:
                kept.clear()
        new = {c: self.words.findall(c if c[:1] == "\n" else SPACE + c) for c in set().union(*(s for s, p in zip(split, plain, strict=True) if p)) - self.chunks.keys()}
        self.learn(list(set().union(*new.values(), *(s for s, p in zip(split, plain, strict=True) if not p)) - self.cache.keys()))
        for chunk, words in new.items():
            found = [self.cache[w] for w in words]
            self.chunks[chunk] = found[0] if len(found) == 1 else (",".join([f[0] for f in found]), "".join([f[1] for f in found]))
        out = []
        for words, p in zip(split, plain, strict=True):
            kept = self.chunks if p else self.cache
            found = [kept[w] for w in words]
            # decode() drops the space that encoding puts first
            out.append((",".join([f[0] for f in found]), "".join([f[1] for f in found])[1:]))
        return out


@lru_cache(maxsize=2)
def merger(model: str) -> Merger:
    return Merger(model)


def encode(docs: DataFrame, model: str, ids: bool = False) -> DataFrame:
    """docs and its columns with n_tokens, ids_sha256 and decoded_sha256, and on request the list of ids.

    ``model`` is the path of a SentencePiece BPE model, which each executor has.
    """
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    rest = others(docs, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids)
    schema = T.StructType([*rest, *T.StructType.fromDDL(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(model)
        for batch, _, _ in blocks(batches, BLOCK_BYTES):
            done = m.encode([t or "" for t in batch.column("text").to_pylist()])
            columns = [batch.column(f.name) for f in rest]
            columns.append(pa.array([x.count(",") + 1 if x else 0 for x, _ in done], pa.int64()))
            columns.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x, _ in done], pa.string()))
            columns.append(pa.array([hashlib.sha256(y.encode()).hexdigest() for _, y in done], pa.string()))
            names = [*(f.name for f in rest), "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.array([[int(i) for i in x.split(",")] if x else [] for x, _ in done], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        m.forget()  # an idle worker should not hold memory that the next stage needs

    return small_batches(docs).select("text", *[F.col(f"`{f.name}`") for f in rest]).mapInArrow(run, schema)


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_model())
