"""Fill-in-the-middle transformation over an index of distinct texts.

Documents are dealt by a 64-bit hash of their text.  Where they meet, they are
grouped by the text itself, so equal hashes never stand for equal texts.  Each
distinct text enters the index once, as the Elias-Fano list of the byte offsets
at which its code points begin.  The index is joined back to the documents, and a
document's seeded cut is two selections on its list; no text is decoded or
scanned to find a cut.

The texts are shuffled once: the grouping and the join read the same exchange, and
the index itself holds no text.  A hash that more than ``copies`` and more than a
thousandth of all rows share is dealt in parts of that size, each of which
indexes its text once; the list of such hashes has a thousand rows at most and is
broadcast.  Where two texts of one hash meet, their SHA-256 tells which list is whose.

The seed of a document are the first four numbers of 32 bits in the SHA-256 of
``1:`` and its decimal doc_id.

Edge cases: a null text counts as empty, an empty text stays plain; a text that
holds one of the three marks stays plain; rows with equal doc_id are separate rows
with equal cuts; a null doc_id has no digits; an empty table gives an empty result;
other columns are ignored, whatever their names.  A retried scan must number its
rows alike, so ``docs`` is a table, or was written before.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULT_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_INDEX_SCHEMA = "key long, part long, first_doc_id long, copies long, digest binary, marked boolean, list binary"
_HEAD = struct.Struct("<QQB")
_EVERY = 512


# ------------------------------------------------------------------ Elias-Fano


def code_point_offsets(raw: bytes) -> np.ndarray:
    """Byte offsets at which the code points of a UTF-8 text begin, and its length."""
    octets = np.frombuffer(raw, np.uint8)
    return np.append(np.flatnonzero((octets & 0xC0) != 0x80), len(octets))


def elias_fano(values: np.ndarray) -> bytes:
    """A rising list of numbers: low bits packed, high bits in unary, and the place of every 512th one among these."""
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // max(1, n)).bit_length() - 1)
    at = (values >> low) + np.arange(n)
    high = np.zeros((int(at[-1]) + 1) if n else 0, bool)
    high[at] = True
    bits = ((values[:, None] >> np.arange(low)) & 1).astype(bool).ravel() if low else np.zeros(0, bool)
    parts = (at[::_EVERY].astype("<u8").tobytes(), np.packbits(bits, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes())
    return _HEAD.pack(n, len(parts[1]), low) + b"".join(parts)


def length(blob: bytes) -> int:
    """How many numbers a list holds."""
    return _HEAD.unpack_from(blob)[0]


def select(blob: bytes, i: int) -> int:
    """The i-th number of a list, reading one stretch of 512 numbers at most."""
    n, lows, low = _HEAD.unpack_from(blob)
    if not 0 <= i < n:
        raise IndexError(i)
    places = np.frombuffer(blob, "<u8", -(-n // _EVERY), _HEAD.size)
    first = _HEAD.size + places.nbytes
    s = i // _EVERY
    start = int(places[s])
    stop = int(places[s + 1]) // 8 + 1 if s + 1 < len(places) else len(blob) - first - lows
    stretch = np.unpackbits(np.frombuffer(blob, np.uint8, stop - start // 8, first + lows + start // 8), bitorder="little")
    stretch[: start % 8] = 0
    at = start // 8 * 8 + int(np.flatnonzero(stretch)[i % _EVERY])
    value = at - i
    for k in range(i * low + low - 1, i * low - 1, -1):
        value = value << 1 | blob[first + k // 8] >> k % 8 & 1
    return value


# ------------------------------------------------------------------------ cuts


def seeds(doc_id: int | None) -> tuple[int, int, int, int]:
    """h1 to h4 of a document."""
    text = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(text[i : i + 8], 16) for i in range(0, 32, 8))


def form_of(marked: bool, n: int, h3: int, h4: int, percent: int = 90, spm_percent: int = 20) -> str:
    if not n or marked or h3 % 100 >= percent:
        return "plain"
    return "spm" if h4 % 100 < spm_percent else "psm"


def arrange(prefix: bytes, middle: bytes, suffix: bytes, form: str) -> bytes:
    """The three parts behind their marks, in the order of the form."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text from an output and its form; the marks stand in no text, so their first places are the cuts."""
    if form == "plain":
        return output
    second, third = (SUFFIX if form == "psm" else PREFIX).encode(), MIDDLE.encode()
    a = output.index(second, 3)
    b = output.index(third, a + 3)
    one, two, middle = output[3:a], output[a + 3 : b], output[b + 3 :]
    return one + middle + two if form == "psm" else two + middle + one


# ----------------------------------------------------------------------- index


def dealt(docs: DataFrame, copies: int = 512, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(key, part, doc_id, text): the documents dealt by their text's hash, hot hashes in parts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", key(F.col("text")).cast("long"))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    most = max(copies, rows.count() // 1000)
    hot = counts.where(F.col("n") > most).select("key", F.ceil(F.col("n") / most).alias("parts"))
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(hot), "key", "left")
    part = F.coalesce(F.pmod("row", "parts"), F.lit(0)).cast("long")
    return numbered.select("key", part.alias("part"), "doc_id", "text").repartition("key", "part")


def text_index(rows: DataFrame) -> DataFrame:
    """One row per distinct text (and part): its smallest doc_id, copies, digest, whether it holds a mark, and its list."""
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    texts = rows.groupBy("key", "part", "text").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("copies"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tk.give_back()
            raw = batch.column("text").cast(pa.large_binary()).to_pylist()
            digests = pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary())
            lists = pa.array([elias_fano(code_point_offsets(t)) for t in raw], pa.binary())
            yield pa.record_batch([*(batch.column(c) for c in ("key", "part", "first_doc_id", "copies")), digests, batch.column("marked"), lists], names=[c.split()[0] for c in _INDEX_SCHEMA.split(", ")])

    return texts.withColumn("marked", marked).mapInArrow(build, _INDEX_SCHEMA)


def transform(docs: DataFrame, percent: int = 90, spm_percent: int = 20, copies: int = 512, with_output: bool = False, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Each document's form, cuts in code points and digests of its output and of the text rebuilt from it.

    ``percent`` of the documents that can be cut are cut, ``spm_percent`` of these
    with the suffix first.  ``with_output`` adds the output itself.
    """
    rows = dealt(docs, copies, key)
    index = text_index(rows).withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("key", "part")))
    d, i = rows.alias("d"), index.alias("i")
    mine = (F.col("i.texts") == 1) | (F.col("i.digest") == F.unhex(F.sha2("d.text", 256)))
    both = d.join(i.hint("shuffle_hash"), (F.col("d.key") == F.col("i.key")) & (F.col("d.part") == F.col("i.part")) & mine)
    names = [c.split()[0] for c in RESULT_SCHEMA.split(", ")] + ["output"] * with_output
    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output_sha256": pa.string(), "restored_sha256": pa.string(), "output": pa.string()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tk.give_back()
            columns: dict[str, list] = {c: [] for c in kinds}
            texts = batch.column("text").cast(pa.large_binary())
            for doc_id, text, marked, blob in zip(batch.column("doc_id").to_pylist(), texts, batch.column("marked").to_pylist(), batch.column("list"), strict=True):
                raw, offsets = text.as_py(), blob.as_py()
                n = length(offsets) - 1
                h1, h2, h3, h4 = seeds(doc_id)
                form = form_of(marked, n, h3, h4, percent, spm_percent)
                output, sizes = raw, (None, None)
                if form != "plain":
                    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                    x, y = select(offsets, a), select(offsets, b)
                    output, sizes = arrange(raw[:x], raw[x:y], raw[y:], form), (a, b - a)
                again = restore(output, form)
                for c, v in zip(kinds, (doc_id, n, form, *sizes, hashlib.sha256(output).hexdigest(), hashlib.sha256(again).hexdigest(), output.decode() if with_output else None), strict=True):
                    columns[c].append(v)
            made = {c: pa.array(v, kinds[c]) for c, v in columns.items()}
            yield pa.record_batch([made[c] for c in names], names=names)

    wanted = both.select("d.doc_id", "d.text", "i.marked", "i.list")
    return wanted.mapInArrow(cut, RESULT_SCHEMA + ", output string" * with_output)
