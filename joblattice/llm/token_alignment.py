"""Aligning the tokens of two tokenizers, and counting linked pairs over a corpus.

Both tokenizers cut the same bytes: a space and the text.  Byte offsets at which
tokens of both end cut them into groups; a token of A and one of B are linked if
their byte ranges overlap.  Ranges that overlap do so in one stretch between two
neighbouring ends of either side, so the links of a text are exactly these
stretches, and marks on the bytes of a whole batch find them all at once.

Counting: a pair is one int64 key (A's id in the upper, B's in the lower 32 bits).
A task reduces each document to its distinct pairs, then its whole partition to
sorted keys with partial counts (``np.unique``), flushed whenever ``most_pairs``
of them are held.  The partial counts are partitioned by ranges of the key and
sorted there by Spark; runs of equal keys are summed while they stream by, and
each range becomes one shard: a sorted array of keys and one of counts, in the
shared folder.  A lookup maps the shards into memory and searches them by
bisection, shard after shard, so a task holds no shard, however many there are.
Where the shared folder is no mounted folder, shards are read through pyarrow's file systems.

Texts are encoded once; the ids are stored in the shared folder, and both passes
over them (counts, then lookups) derive the links from the ids.  The highest count
of each A id is a list no longer than A's vocabulary; it and the list of shards
are all that the driver sees.

Edge cases: texts null, empty or whose tokens don't join to the same bytes have no
tokens and count no pair; strings of special tokens are plain text; rows with equal
or null doc_id are separate documents; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .store import forget, shared_folder, written

TOKEN_SCHEMA = "doc_id long, a binary, b binary"
SHARD_SCHEMA = "first long, last long, n long, path string, best_ids array<long>, best_counts array<long>"
RESULT_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_CACHE: dict = {}
_BATCH_BYTES = 1 << 20
_CACHE_WORDS = 400_000


# ------------------------------------------------------------------ tokenizers


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """The bytes of all ids, back to back, and where each begins and how long it is."""

    data: np.ndarray
    begin: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, pieces: list[bytes]) -> Vocabulary:
        size = np.array([len(p) for p in pieces], np.int64)
        return cls(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, joined."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.begin[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class ByteLevel:
    """A tokenizers file of byte-level BPE; encodes the text as it is."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte = _byte_level()
        vocab = self.tokenizer.get_vocab()
        pieces = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            pieces[i] = bytes(byte[c] for c in piece)
        self.vocabulary = Vocabulary.of(pieces)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and the text, for each text."""
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model; puts a space before the text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.vocabulary = Vocabulary.of([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("a piece goes on after a word's end: words can't be encoded one by one")
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _loaded(kind: type, path: str):
    if (kind, path) not in _CACHE:
        _CACHE[kind, path] = kind(path)
    return _CACHE[kind, path]


# -------------------------------------------------------------------- encoding


def _learn(words: list[str], tokenizer: ByteLevel | Pieces) -> list[bytes]:
    """The ids of each word behind a space, 500 words to a text; exactly the first token of a word begins with the space."""
    v, out = tokenizer.vocabulary, []
    parts = [words[i : i + 500] for i in range(0, len(words), 500)]
    for part, ids in zip(parts, tokenizer.encode([" ".join(p) for p in parts]), strict=True):
        coded = np.array(ids, "<u4")
        starts = np.flatnonzero(v.data[v.begin[coded]] == 32)
        if len(starts) != len(part):
            out += [np.array(x, "<u4").tobytes() for x in tokenizer.encode(part)]
            continue
        raw, cuts = coded.tobytes(), [*(4 * starts).tolist(), 4 * len(coded)]
        out += [raw[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def ids_of(texts: list[str], *tokenizers: ByteLevel | Pieces) -> list[list[bytes]]:
    """For each tokenizer the ids of a space and each text, little-endian, 32 bits each.

    No tokenizer here joins across a single space between two characters that are
    no white space, so each distinct word is encoded once, with the space before
    it, and remembered.  A text with other white space at the edge of a word, or
    with the sign that stands for a space, is encoded as a whole.
    """
    split = [t.split(" ") for t in texts]
    every = set().union(*split)
    odd = {w for w in every if not w or w[0].isspace() or w[-1].isspace() or "▁" in w}
    whole = [i for i, words in enumerate(split) if not odd.isdisjoint(words)] if odd else []
    told = set(whole)
    out = []
    for tokenizer in tokenizers:
        known = tokenizer.known
        if len(known) > _CACHE_WORDS:
            known.clear()
        new = [w for w in every if w not in known and w not in odd]
        known.update(zip(new, _learn(new, tokenizer), strict=True))
        mine = [b"" if i in told else b"".join(map(known.__getitem__, words)) for i, words in enumerate(split)]
        for i, ids in zip(whole, tokenizer.encode([texts[i] for i in whole]), strict=True):
            mine[i] = np.array(ids, "<u4").tobytes()
        out.append(mine)
    return out


def _portions(texts: pa.Array, size: int = _BATCH_BYTES) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (int(ends[a - 1]) if a else 0) + size, side="right")))
        yield a, b
        a = b


def _kind(size_a: np.ndarray, size_b: np.ndarray) -> str:
    """How ids are stored: 16 bits while both vocabularies fit."""
    return "<u2" if max(len(size_a), len(size_b)) <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, a, b): the ids of both tokenizers as :func:`_kind` stores them; none where the bytes differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _loaded(ByteLevel, path_a), _loaded(Pieces, path_b)
        kind = _kind(one.vocabulary.size, two.vocabulary.size)
        for batch in batches:
            texts = tk.one_array(batch.column(1))
            for x, y in _portions(texts):
                tk.give_back()
                mine = texts.slice(x, y - x).to_pylist()
                rows = []
                for text, *ids in zip(mine, *ids_of(mine, one, two), strict=True):
                    raw = np.frombuffer((" " + text).encode(), np.uint8)
                    a, b = (np.frombuffer(x, "<u4") for x in ids)
                    same = bool(text) and np.array_equal(one.vocabulary.joined(a), raw) and np.array_equal(two.vocabulary.joined(b), raw)
                    rows.append((a.astype(kind).tobytes(), b.astype(kind).tobytes()) if same else (b"", b""))
                yield pa.record_batch([batch.column(0).slice(x, y - x), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))], names=["doc_id", "a", "b"])

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TOKEN_SCHEMA), "tokens", compression="zstd")


# ------------------------------------------------------------------- alignment


def _before(marks: np.ndarray) -> np.ndarray:
    """How many marks stand before each place."""
    return np.cumsum(marks, dtype=np.int32) - marks


class Aligned:
    """The links and groups of a batch of documents, all at once."""

    def __init__(self, a: list[bytes], b: list[bytes], size_a: np.ndarray, size_b: np.ndarray):
        kind = np.dtype(_kind(size_a, size_b))
        self.n_a, self.n_b = (np.array([len(x) // kind.itemsize for x in side], np.int64) for side in (a, b))
        self.a, self.b = (np.frombuffer(b"".join(side), kind).astype(np.int64) for side in (a, b))
        self.end_a, self.end_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        last = np.concatenate(([0], self.end_a))[np.cumsum(self.n_a)]  # where each document ends, in bytes
        # Everything is found by marks on the batch's bytes, so nothing is sorted or searched.
        in_a, in_b = (np.zeros(int(last[-1]) + 1 if len(last) else 1, bool) for _ in range(2))
        in_a[self.end_a], in_b[self.end_b] = True, True
        either, both = in_a | in_b, in_a & in_b
        ends = np.flatnonzero(either)
        self.pair = self.a[_before(in_a)[ends]] << 32 | self.b[_before(in_b)[ends]]
        self.n_links = np.diff(np.cumsum(either, dtype=np.int64)[last], prepend=0)
        self.n_groups = np.diff(np.cumsum(both, dtype=np.int64)[last], prepend=0)
        self.groups = _before(both)
        self.all_groups = int(np.count_nonzero(both))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Each document's distinct pairs, all documents together: document and pair."""
        doc = np.repeat(np.arange(len(self.n_links)), self.n_links)
        order = np.lexsort((self.pair, doc))
        doc, pair = doc[order], self.pair[order]
        first = np.ones(len(pair), bool)
        first[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
        return doc[first], pair[first]

    def digests(self, text_a: pa.Array, text_b: pa.Array) -> list[str]:
        """SHA-256 of each document's groups, spelled ``a1,a2|b1;a3|b2,b3``; nothing for no tokens.

        ``text_a`` holds ``id,`` of all ids, then ``id|`` of all; ``text_b`` ``id,``, then ``id;``.
        """
        group_a, group_b = self.groups[self.end_a], self.groups[self.end_b]
        in_a = np.bincount(group_a, minlength=self.all_groups)
        in_b = np.bincount(group_b, minlength=self.all_groups)
        place_a = np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[group_a]
        place_b = np.arange(len(self.b)) + np.cumsum(in_a)[group_b]
        last_a, last_b = (np.zeros(len(side), np.int64) for side in (self.a, self.b))
        last_a[np.cumsum(in_a) - 1], last_b[np.cumsum(in_b) - 1] = 1, 1
        words = np.empty(len(self.a) + len(self.b), np.int64)
        words[place_a] = self.a + last_a * (len(text_a) // 2)
        words[place_b] = len(text_a) + self.b + last_b * (len(text_b) // 2)
        spelled = pa.concat_arrays([text_a, text_b]).take(pa.array(words)) if len(words) else pa.array([], pa.large_string())
        offsets = np.frombuffer(spelled.buffers()[1], np.int64)[: len(words) + 1] if len(words) else np.zeros(1, np.int64)
        data = memoryview(spelled.buffers()[2]) if len(words) else memoryview(b"")
        cuts = offsets[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))].tolist()
        return [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def _spelled(size: int, marks: str) -> pa.Array:
    return pa.array([f"{i}{m}" for m in marks for i in range(size)], pa.large_string())


def _batches(batches: Iterator[pa.RecordBatch], size_a: np.ndarray, size_b: np.ndarray) -> Iterator[tuple[pa.Array, Aligned]]:
    """Aligned portions of a task's rows of ids."""
    for batch in batches:
        for x, y in _portions(batch.column(1), 2 * _BATCH_BYTES):
            tk.give_back()
            a, b = (batch.column(c).slice(x, y - x).to_pylist() for c in (1, 2))
            yield batch.column(0).slice(x, y - x), Aligned(a, b, size_a, size_b)


# -------------------------------------------------------------------- counting


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def partial_counts(tokens: DataFrame, size_a: np.ndarray, size_b: np.ndarray, most_pairs: int = 2_000_000) -> DataFrame:
    """(key, c): for each partition, in how many of its documents each pair is linked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 50_000):
                yield pa.record_batch([pa.array(keys[i : i + 50_000]), pa.array(counts[i : i + 50_000])], names=["key", "c"])

        keys = counts = np.zeros(0, np.int64)
        for _, aligned in _batches(batches, size_a, size_b):
            new, n = np.unique(aligned.distinct()[1], return_counts=True)
            keys, counts = summed(np.concatenate((keys, new)), np.concatenate((counts, n.astype(np.int64))))
            if len(keys) > most_pairs:
                yield from rows()
                keys = counts = np.zeros(0, np.int64)
        yield from rows()

    return tokens.mapInArrow(count, "key long, c long")


def _put(path: str, data: bytes) -> None:
    """Write a file of the shared folder at once: aside, then renamed, so that a retried task leaves no half."""
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    aside = f"{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(aside) as out:
        out.write(data)
    files.move(aside, name)


def _mapped(path: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a shard, mapped into memory where the shared folder is mounted."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        whole = np.memmap(at.path, np.int64, mode="r")
    else:
        from pyarrow import fs

        files, name = fs.FileSystem.from_uri(path)
        with files.open_input_stream(name) as source:
            whole = np.frombuffer(source.read(), np.int64)
    return whole[:n], whole[n:]


def shards(partial: DataFrame, folder: str, ranges: int) -> DataFrame:
    """Sorted count shards by ranges of the key: one row per shard, with the highest count of each A id in it."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:  # sorted: the last key may go on in the next batch
            k, c = (np.concatenate((h, batch.column(i).to_numpy())) for i, h in enumerate(held))
            k, c = summed(k, c)
            keys.append(k[:-1])
            counts.append(c[:-1])
            held = (k[-1:], c[-1:])
        k, c = np.concatenate([*keys, held[0]]), np.concatenate([*counts, held[1]])
        if not len(k):
            return
        path = f"{folder}/{TaskContext.get().partitionId():06d}"
        _put(path, k.tobytes() + c.tobytes())
        ids = k >> 32
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        row = [pa.array([int(x)]) for x in (k[0], k[-1], len(k))] + [pa.array([path])]
        row += [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (ids[first], np.maximum.reduceat(c, first))]
        yield pa.record_batch(row, names=[x.split()[0] for x in SHARD_SCHEMA.split(", ")])

    dealt = partial.repartitionByRange(ranges, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(store, SHARD_SCHEMA)


class Counts:
    """The corpus-wide counts: a list of shards, and the highest count of each A id."""

    def __init__(self, spark_rows: list, ids_a: int):
        self.shards = sorted((r.first, r.last, r.n, r.path) for r in spark_rows)
        self.best = np.zeros(ids_a, np.int64)
        for r in spark_rows:
            np.maximum.at(self.best, np.array(r.best_ids, np.int64), np.array(r.best_counts, np.int64))

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys (0: no document holds the pair linked)."""
        out = np.zeros(len(keys), np.int64)
        for first, last, n, path in self.shards:
            x, y = np.searchsorted(keys, first), np.searchsorted(keys, last, side="right")
            if x == y:
                continue
            k, c = _mapped(path, n)
            at = np.searchsorted(k, keys[x:y])
            out[x:y] = np.where(k[at] == keys[x:y], c[at], 0)
        return out


def pair_counts(tokens: DataFrame, size_a: np.ndarray, size_b: np.ndarray, shard_pairs: int = 1_000_000) -> Counts:
    """Count all linked pairs of stored tokens into shards of about ``shard_pairs``."""
    spark = tokens.sparkSession
    partial = written(partial_counts(tokens, size_a, size_b), "partial-counts", compression="zstd")
    ranges = max(1, -(-partial.count() // shard_pairs))
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    if urlparse(folder).scheme in ("", "file"):
        os.makedirs(urlparse(folder).path, exist_ok=True)
    rows = shards(partial, folder, ranges).collect()  # in all as many ids as A has, and one more for each shard
    forget(partial)
    return Counts(rows, len(size_a))


def align(docs: DataFrame, path_a: str, path_b: str, shard_pairs: int = 1_000_000) -> DataFrame:
    """Per document: tokens, groups, links, and what the corpus-wide counts say of its links."""
    size_a, size_b = (_loaded(kind, path).vocabulary.size for kind, path in ((ByteLevel, path_a), (Pieces, path_b)))
    tokens = encoded(docs, path_a, path_b)
    known = pair_counts(tokens, size_a, size_b, shard_pairs)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _spelled(len(size_a), ",|"), _spelled(len(size_b), ",;")
        for doc_id, x in _batches(batches, size_a, size_b):
            keys, of = np.unique(x.pair, return_inverse=True)
            count = known.of(keys)
            best = (count == known.best[keys >> 32])[of]
            count = count[of]
            cuts = np.concatenate(([0], np.cumsum(x.n_links)))
            n_best, total = (np.diff(np.concatenate(([0], np.cumsum(v)))[cuts]) for v in (best, count))
            columns = [doc_id, *(pa.array(v.astype(np.int64)) for v in (x.n_a, x.n_b, x.n_groups, x.n_links, n_best, total)), pa.array(x.digests(*texts), pa.string())]
            yield pa.record_batch(columns, names=[c.split()[0] for c in RESULT_SCHEMA.split(", ")])

    return tokens.mapInArrow(judge, RESULT_SCHEMA)
