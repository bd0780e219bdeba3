"""Fill-in-middle transformation over seekable compressed frames.

1. Each text is stored as independent zstandard frames of about FRAME_BYTES, cut behind a unit, with the units, code
   points and bytes that stand before each frame.  A unit is a word with the white space before it; white space at the
   end is one more.  The frames are a table: whatever reads a text later decompresses the frames that it needs.
2. Form and cuts of a document follow from a digest of its id and from its number of units, in Spark's columns.
3. A cut is looked up in the cumulative counts, and only the frame that holds it is decompressed to find its place.  The
   parts are then streamed in the order of the form, a frame at a time, into a digest and into the output's own frames.
4. The text is rebuilt from the output's frames and the form alone: the markers are searched in a stream, and the
   parts between them go, frame by frame, into the second digest.

Null counts as empty; an empty text, and one that holds a marker, stays plain.  A null doc_id counts as the empty
string in the digest.  Repeated rows and ids are texts of their own.  Texts of any length are handled a frame at a time
beside their row.  An empty table has an empty result.  Other columns are carried through; those that are named as a
result's are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspar.llm.common import SPACE_BYTES, blocks, fresh, others, small_batches, stored, table, word_spans

SEED, RATE, SUFFIX_FIRST = 42, 50, 80
FRAME_BYTES, BLOCK_BYTES, LEVEL = 1 << 16, 4_000_000, 3
#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

FRAMES = "array<struct<units: long, chars: long, bytes: long, data: binary>>"


def code_points(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def unit_ends(data: bytes) -> np.ndarray:
    """Where the units of data end: behind each word, and at the end of white space that no word follows."""
    solid = ~SPACE_BYTES[np.frombuffer(data, np.uint8)]
    ends = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    return np.append(ends, len(data)) if len(data) else ends


@dataclass
class Frames:
    """A text as compressed frames, with the number of units, code points and bytes before each."""

    data: list[bytes] = field(default_factory=list)
    units: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    bytes: list[int] = field(default_factory=list)
    n: int = 0
    n_chars: int = 0
    n_bytes: int = 0

    def add(self, data: bytes, units: int, packer: zstandard.ZstdCompressor) -> None:
        self.data.append(packer.compress(data))
        self.units.append(self.n)
        self.chars.append(self.n_chars)
        self.bytes.append(self.n_bytes)
        self.n, self.n_chars, self.n_bytes = self.n + units, self.n_chars + code_points(data), self.n_bytes + len(data)

    def place(self, unit: int, opener: zstandard.ZstdDecompressor) -> tuple[int, int]:
        """Bytes and code points before the end of so many units; one frame is decompressed at most."""
        if unit in (0, self.n):
            return (0, 0) if unit == 0 else (self.n_bytes, self.n_chars)
        k = int(np.searchsorted(self.units, unit, "right")) - 1
        if unit == self.units[k]:
            return self.bytes[k], self.chars[k]
        data = opener.decompress(self.data[k])
        end = int(unit_ends(data)[unit - self.units[k] - 1])
        return self.bytes[k] + end, self.chars[k] + code_points(data[:end])

    def read(self, begin: int, end: int, opener: zstandard.ZstdDecompressor) -> Iterator[bytes]:
        """The bytes from begin to end; only frames that hold some of them are decompressed, one at a time."""
        k = max(0, int(np.searchsorted(self.bytes, begin, "right")) - 1)
        while k < len(self.data) and self.bytes[k] < end:
            data = opener.decompress(self.data[k])
            yield data[max(0, begin - self.bytes[k]) : end - self.bytes[k]]
            k += 1

    def find(self, what: bytes, begin: int, opener: zstandard.ZstdDecompressor) -> int:
        """Where ``what`` begins first, from ``begin`` on; it may lie across frames."""
        kept, at = b"", begin
        for data in self.read(begin, self.n_bytes, opener):
            here = kept + data
            if (found := here.find(what)) >= 0:
                return at + found
            kept = here[max(0, len(here) - len(what) + 1) :]
            at += len(here) - len(kept)
        raise ValueError(f"the output has no {what!r}")


def framed(chunks: Iterable[bytes], packer: zstandard.ZstdCompressor) -> tuple[Frames, str]:
    """Frames of about FRAME_BYTES of a stream, and its sha256."""
    out, digest, waiting = Frames(), hashlib.sha256(), b""
    for chunk in chunks:
        digest.update(chunk)
        waiting += chunk
        if len(waiting) >= FRAME_BYTES:
            out.add(waiting, 0, packer)
            waiting = b""
    if waiting:
        out.add(waiting, 0, packer)
    return out, digest.hexdigest()


def arranged(text: Frames, form: str, first: int, second: int, opener: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    """The output: the parts of the text, cut at bytes first and second, in the order of the form."""
    parts = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, text.n_bytes)}
    if form == "plain":
        yield from text.read(0, text.n_bytes, opener)
        return
    for mark in (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE):
        yield mark
        yield from text.read(*parts[mark], opener)


def rebuilt(output: Frames, form: str, opener: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    """The text, from an output and its form."""
    if form == "plain":
        yield from output.read(0, output.n_bytes, opener)
        return
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    at = [output.find(order[0], 0, opener)]
    for mark in order[1:]:
        at.append(output.find(mark, at[-1] + len(mark), opener))
    ends = dict(zip(order, [*at[1:], output.n_bytes], strict=True))
    begins = dict(zip(order, at, strict=True))
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.read(begins[mark] + len(mark), ends[mark], opener)


def frame_arrays(texts: list[Frames]) -> pa.ListArray:
    flat = lambda name, kind: pa.array([x for t in texts for x in getattr(t, name)], kind)
    items = pa.StructArray.from_arrays([*(flat(n, pa.int64()) for n in ("units", "chars", "bytes")), flat("data", pa.binary())], ["units", "chars", "bytes", "data"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(t.data) for t in texts)]).astype(np.int32)), items)


def frame_store(docs: DataFrame, *made: str) -> DataFrame:
    """docs (their other columns in the struct row) as frames: row, n units, n_chars, n_bytes, marked (holds a marker), frames."""
    rest = others(docs, *made)
    inner = F.struct(F.lit(0).alias(fresh(docs, "_key")), *[F.col(f"`{f.name}`") for f in rest])
    rows = small_batches(docs).select(inner.alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch, raw, at in blocks(batches, BLOCK_BYTES):
            data, texts, marked = memoryview(np.ascontiguousarray(raw)), [], []
            _, ends, word_at = word_spans(raw, at)
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                own, text = ends[word_at[i] : word_at[i + 1]], Frames()
                tail = int(b > a and bool(SPACE_BYTES[raw[b - 1]]))
                done, units = a, 0
                while done < b:
                    # To the first end of a unit that is FRAME_BYTES away, or to the end of the text.
                    k = int(np.searchsorted(own, done + FRAME_BYTES)) if b - done > FRAME_BYTES else len(own)
                    last = k >= len(own) - 1
                    stop, upto = (b, len(own) + tail) if last else (int(own[k]), k + 1)
                    text.add(bytes(data[done:stop]), upto - units, packer)
                    done, units = stop, upto
                texts.append(text)
                whole = bytes(data[a:b])
                marked.append(any(m in whole for m in (PREFIX, SUFFIX, MIDDLE)))
            columns = [batch.column("row"), *(pa.array([getattr(t, n) for t in texts], pa.int64()) for n in ("n", "n_chars", "n_bytes")), pa.array(marked, pa.bool_()), frame_arrays(texts)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "n", "n_chars", "n_bytes", "marked", "frames"])

    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(f"n long, n_chars long, n_bytes long, marked boolean, frames {FRAMES}").fields])
    return stored(rows.mapInArrow(run, schema), "frames")


def drawn(doc_id: Column, seed: int) -> list[Column]:
    """The first four groups of 8 hexadecimal digits of the id's digest, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, keep_output: bool = False) -> DataFrame:
    """docs without text, as n units, form, prefix_chars, middle_chars, output_sha256 and restored_sha256.

    ``rate`` percent of the documents are transformed, ``suffix_first`` percent of these as spm.  On request output: the
    output as frames (units and chars before a frame are those of the output's bytes; join and decompress data to read it).
    """
    made = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *["output"] * keep_output]
    rest = others(docs, *made)
    texts = frame_store(docs, *made)
    h = drawn(F.col("row").getField("doc_id"), seed)
    plain = (F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= rate)
    cuts = [h[i] % (F.col("n") + 1) for i in (0, 1)]
    planned = texts.withColumns({"form": F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm"), "first": F.least(*cuts), "second": F.greatest(*cuts)})
    result = f"n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string{f', output {FRAMES}' * keep_output}"
    schema = T.StructType([texts.schema["row"], *T.StructType.fromDDL(result).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, opener = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for batch in batches:
            lists, found, outputs = batch.column("frames"), [], []
            item, at = lists.flatten(), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            units, chars, starts, data = (item.field(f).to_pylist() for f in ("units", "chars", "bytes", "data"))
            numbers = (batch.column(c).to_pylist() for c in ("n", "n_chars", "n_bytes", "form", "first", "second"))
            for i, (n, n_chars, n_bytes, form, first, second) in enumerate(zip(*numbers, strict=True)):
                own = slice(at[i], at[i + 1])
                text = Frames(data[own], units[own], chars[own], starts[own], n, n_chars, n_bytes)
                (a, a_chars), (b, b_chars) = ((0, None), (0, None)) if form == "plain" else (text.place(first, opener), text.place(second, opener))
                output, digest = framed(arranged(text, form, a, b, opener), packer)
                restored = hashlib.sha256()
                for chunk in rebuilt(output, form, opener):
                    restored.update(chunk)
                found.append((n, form, a_chars, None if b_chars is None else b_chars - a_chars, digest, restored.hexdigest()))
                if keep_output:
                    outputs.append(output)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [batch.column("row"), *(pa.array(c, k) for c, k in zip(list(zip(*found, strict=True)) or [[]] * 6, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays([*columns, *([frame_arrays(outputs)] if keep_output else [])], ["row", *made])

    out = planned.select("row", "n", "n_chars", "n_bytes", "form", "first", "second", "frames").mapInArrow(run, schema)
    return out.select(*[F.col("row").getField(f.name).alias(f.name) for f in rest], *made)


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS x FROM documents),
h AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(x, i, 8) AS BIGINT)) AS h FROM d),
c AS (SELECT doc_id, t, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, array_to_string(u[:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
