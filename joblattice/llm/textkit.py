"""Vectorised word handling for one Arrow batch of texts.

A word is a maximal run of characters outside ``\\x20`` and ``\\x09-\\x0D``.
"""

from __future__ import annotations

import ctypes
import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_LIBC = ctypes.CDLL(None)
_TRIM = getattr(_LIBC, "malloc_trim", None)
_MALLOPT = getattr(_LIBC, "mallopt", None)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


@dataclass
class Words:
    """Words of a batch: text ``i`` owns ``ids[bounds[i]:bounds[i + 1]]``."""

    bounds: np.ndarray
    ids: np.ndarray
    vocab: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1, dtype=np.int32), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        return vocab_hashes(self.vocab, seed)[self.ids]


@functools.cache
def _map_large_arrays() -> None:
    """Let this process map arrays of 512 KB or more one by one, Arrow's too, so that each goes back when it is freed."""
    if _MALLOPT is not None:
        m_trim_threshold, m_mmap_threshold = -1, -3
        _MALLOPT(m_trim_threshold, 1 << 20)
        _MALLOPT(m_mmap_threshold, 1 << 19)
        pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Hand memory that numpy and Arrow have freed back to the system, as Python workers outlive their tasks.

    For use in tasks only: from the first call on, the process maps large arrays one by one.
    """
    _map_large_arrays()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def one_array(column) -> pa.Array:
    """A column as a single plain string array, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) and np.frombuffer(column.buffers()[1], np.int64)[column.offset]:
        # Case kernels misread a slice whose values don't begin the buffer: give it a buffer of its own.
        column = column.take(pa.array(np.arange(len(column))))
    return column


def split_words(column) -> Words:
    """Words of each text; a null text has none."""
    lists = pc.ascii_split_whitespace(one_array(column))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    bounds = bounds - (bounds[0] if len(bounds) else 0)
    blank = pc.index_in(pa.scalar("", coded.dictionary.type), coded.dictionary).as_py()
    if blank is not None:
        keep = ids != blank
        kept_before = np.concatenate(([0], np.cumsum(keep)))
        bounds, ids = kept_before[bounds], ids[keep]
    return Words(bounds, ids, coded.dictionary)


def vocab_hashes(vocab: pa.Array, seed: int = 0) -> np.ndarray:
    raw = vocab.cast(pa.large_binary()).to_pylist()
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in raw), np.uint64, len(raw))


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all bits depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def window_hashes(word_hash: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words, whichever texts they lie in."""
    n = len(word_hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = word_hash[:n].copy()
    for j in range(1, width):
        h *= _ODD
        h += word_hash[j : n + j]
    return mix(h)


def window_starts(bounds: np.ndarray, width: int) -> np.ndarray:
    """Mask over word positions: a window of ``width`` words of one text starts here."""
    n = int(bounds[-1])
    ok = np.zeros(n + 1, np.int32)
    ends = np.maximum(bounds[1:] - width + 1, bounds[:-1])
    np.add.at(ok, bounds[:-1], 1)
    np.add.at(ok, ends, -1)
    return np.cumsum(ok[:n]).astype(bool)


def covered(start_mask: np.ndarray, width: int) -> np.ndarray:
    """Positions covered by the windows of ``width`` that start at the mask."""
    n = len(start_mask)
    edge = np.zeros(n + width + 1, np.int32)
    at = np.flatnonzero(start_mask)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:n]) > 0


def joined(words: Words, keep: np.ndarray | None = None) -> pa.Array:
    """Each text's (kept) words joined by one space."""
    ids, bounds = words.ids, words.bounds
    if keep is not None:
        before = np.concatenate(([0], np.cumsum(keep)))
        ids, bounds = ids[keep], before[bounds]
    values = words.vocab.take(pa.array(ids))
    lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), values)
    return pc.binary_join(lists, pa.scalar(" ", values.type))


def lower_ascii(column) -> pa.Array:
    """A-Z lower-cased, everything else as it is."""
    return pc.ascii_lower(one_array(column))
