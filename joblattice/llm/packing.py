"""Packing documents into sequences of fixed length.

First-fit decreasing with a tournament tree of bin capacities, run on its own in
each of many randomised groups of documents.  A document's token ids (and one
end id) are cut only where they exceed a whole sequence; the cut-off head pieces
fill sequences exactly, and the rest is packed: largest first, each into the
first open sequence with room, which a binary tree of maxima over the open
sequences' free space finds in logarithmic time.

Groups are formed by a hash of doc_id, the first piece's checksum, and a running number
among equal rows of a batch, so a group stays near ``group_docs`` documents at every table
size, whatever repeats, and a retried task makes the same groups.  Only piece lengths and
checksums are shuffled, never the token ids.

Edge cases: a null or empty text is the end id alone; equal doc_ids are packed
as separate documents; very long documents give many pieces; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

PIECE_SCHEMA = "doc_id long, doc_tokens long, grp long, start array<long>, length array<long>, crc array<long>"
RESULT_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CACHE: dict = {}
_CACHE_WORDS = 400_000


def _tokenizer(path: str):
    if ("t", path) not in _CACHE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _CACHE["t", path] = Tokenizer.from_file(path)
        _CACHE["w", path] = {}
        vocab = _CACHE["t", path].get_vocab()
        _CACHE["e", path] = np.zeros(max(vocab.values()) + 1, bool)
        _CACHE["e", path][[i for t, i in vocab.items() if t.endswith("</w>")]] = True
    return _CACHE["t", path], _CACHE["w", path]


def _learn(words: list[str], tokenizer, known: dict, ends: np.ndarray) -> None:
    """Encode words of letters only, 500 to a text; exactly their last tokens are word ends."""
    for i in range(0, len(words), 10_000):
        part = words[i : i + 10_000]
        texts = [" ".join(part[j : j + 500]) for j in range(0, len(part), 500)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        cuts = np.flatnonzero(ends[ids]) + 1
        if len(cuts) != len(part):
            continue  # left to the word-by-word way
        raw, at = ids.tobytes(), 0
        for w, cut in zip(part, (4 * cuts).tolist(), strict=True):
            known[w] = raw[at:cut]
            at = cut


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of each text, back to back, and the bounds of each text in them.

    The tokenizer drops white space and never joins across it, so each distinct
    word is encoded once and the texts are put together from the words' ids.
    """
    tokenizer, known = _tokenizer(path)
    words = tk.split_words(texts)
    # A full stop or comma after an ASCII letter or digit is always a token of its own, and case is ignored.
    stopped = pc.match_substring_regex(words.vocab, "[A-Za-z0-9][.,]$")
    marked = pc.match_substring_regex(words.vocab, "[\\x{0300}-\\x{036f}]")
    core = pc.if_else(stopped, pc.utf8_rtrim(words.vocab, characters=".,"), words.vocab)
    core = pc.if_else(marked, core, pc.ascii_lower(core)).dictionary_encode()
    stems = core.dictionary.to_pylist()
    if len(known) > _CACHE_WORDS:
        known.clear()
    lone = pc.match_substring_regex(core.dictionary, r"^\p{L}+$").to_pylist()
    _learn([w for w, one in zip(stems, lone, strict=True) if w not in known and one], tokenizer, known, _CACHE["e", path])
    odd = [w for w in stems if w not in known]
    for i in range(0, len(odd), 20_000):
        part = odd[i : i + 20_000]
        for w, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
            known[w] = array("I", e.ids).tobytes()
    comma = pc.and_(stopped, pc.ends_with(words.vocab, ",")).to_numpy(zero_copy_only=False)
    tail = np.where(comma, 1, np.where(stopped.to_numpy(zero_copy_only=False), 2, 0)).tolist()
    marks = [b"", *(array("I", tokenizer.encode(m, add_special_tokens=False).ids).tobytes() for m in ",.")]
    of_stem = [known[w] for w in stems]
    blobs = [of_stem[c] + marks[t] for c, t in zip(core.indices.to_pylist(), tail, strict=True)]
    flat = np.frombuffer(b"".join(blobs), "<u4")
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    begin = np.cumsum(sizes) - sizes
    per_word = sizes[words.ids]
    ends = np.cumsum(per_word)
    total = int(ends[-1]) if len(ends) else 0
    take = np.repeat(begin[words.ids] - (ends - per_word), per_word) + np.arange(total)
    bounds = np.concatenate(([0], ends))[words.bounds]
    return flat[take], bounds


def pieces(docs: DataFrame, tokenizer_path: str, length: int, end_id: int, groups: int, seed: int) -> DataFrame:
    """One row per document: its pieces' starts, lengths and checksums."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tk.give_back()
            for at in range(0, batch.num_rows, 3000):
                yield _cut(batch.slice(at, 3000), tokenizer_path, length, end_id, groups, seed)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE_SCHEMA)


def _cut(batch: pa.RecordBatch, path: str, length: int, end_id: int, groups: int, seed: int) -> pa.RecordBatch:
    ids, bounds = encode_texts(batch.column(1), path)
    end = np.array([end_id], "<u4").tobytes()
    starts, lengths, crcs, totals = [], [], [], []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        raw = ids[a:b].tobytes() + end
        n = len(raw) // 4
        s = range(0, n, length)
        starts.append(list(s))
        lengths.append([min(length, n - i) for i in s])
        crcs.append([zlib.crc32(raw[4 * i : 4 * (i + length)]) for i in s])
        totals.append(n)
    doc_id = batch.column(0)
    key = np.array([-1 if d is None else d for d in doc_id.to_pylist()], np.int64).view(np.uint64)
    first = np.array([c[0] for c in crcs], np.uint64)  # a retried task deals its rows alike, whatever their order
    mixed = tk.mix(tk.mix(key + np.uint64(seed)) + (first << np.uint64(32)) + np.array(totals, np.uint64))
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    begins = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
    nth = np.zeros(len(ranked), np.uint64)  # the first, second, ... of equal rows: which is which makes no difference
    nth[order] = np.arange(len(ranked)) - np.repeat(begins, np.diff(np.append(begins, len(ranked))))
    grp = tk.mix(mixed + nth * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(groups)
    cols = [doc_id, pa.array(totals, pa.int64()), pa.array(grp.astype(np.int64))]
    cols += [pa.array(x, pa.list_(pa.int64())) for x in (starts, lengths, crcs)]
    return pa.record_batch(cols, names=[c.split()[0] for c in PIECE_SCHEMA.split(", ")])


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each size, and the number of bins.

    The tournament tree holds at each leaf the free space of a bin (unopened
    bins: all of it) and at each inner node the larger of its children; going
    down to the left child wherever it has room finds the first fitting bin.
    """
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    opened = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        where[i], offset[i] = node - leaves, capacity - tree[node]
        opened = max(opened, node - leaves + 1)
        tree[node] -= size
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return where, offset, opened


def _pack_group(key, table):
    n = table.num_rows
    starts, lengths, crcs = (table.column(c).to_pylist() for c in ("start", "length", "crc"))
    owner = np.repeat(np.arange(n), [len(s) for s in starts])
    size = np.fromiter(chain.from_iterable(lengths), np.int64, len(owner))
    return owner, starts, size, crcs


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, group_docs: int = 8192, seed: int = 0) -> DataFrame:
    """One row per piece: where its ids come from and where they go."""
    groups = max(1, -(-docs.count() // group_docs))

    def place(key, table):
        owner, starts, size, crcs = _pack_group(key, table)
        where, offset, _ = first_fit_decreasing(size, length)
        flat = pa.array(owner)
        return pa.table(
            {
                "doc_id": table.column("doc_id").take(flat),
                "start": pa.array(np.fromiter(chain.from_iterable(starts), np.int64, len(owner))),
                "length": pa.array(size),
                "ids_crc32": pa.array(np.fromiter(chain.from_iterable(crcs), np.int64, len(owner))),
                "doc_tokens": table.column("doc_tokens").take(flat),
                "sequence_id": pa.array(where + (key[0].as_py() << 32)),
                "offset": pa.array(offset),
            }
        )

    cut = pieces(docs, tokenizer_path, length, end_id, groups, seed)
    return cut.groupBy("grp").applyInArrow(place, RESULT_SCHEMA)


def materialise(docs: DataFrame, packed: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """The sequences themselves: sequence_id and its ids in order (doc_id must be unique)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bounds = encode_texts(batch.column(1), tokenizer_path)
            full = [ids[a:b].tolist() + [end_id] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(full, pa.list_(pa.int64()))], names=["doc_id", "all_ids"])

    coded = docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, all_ids array<long>")
    parts = packed.join(coded, "doc_id").select("sequence_id", "offset", F.slice("all_ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids"))
    whole = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return whole.select("sequence_id", F.flatten("p.ids").alias("ids"))


def padding_ratio(packed: DataFrame, length: int = 2048) -> DataFrame:
    """Padding against ids; a sequence whose length is a power of two needs none."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    exact = F.expr("bit_count(used) = 1")
    pad = F.sum(F.when(exact, 0).otherwise(length - F.col("used")))
    return used.agg(F.count(F.lit(1)).alias("sequences"), F.sum("used").alias("ids"), pad.alias("padding"))
