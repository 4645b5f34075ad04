"""Benchmark decontamination with a distributed positional inverted index.

The training documents are stored as an index in blocks of about ``block_bytes`` of
text.  A block holds its documents' ids and word counts, its distinct terms and,
for each term, the rising list of its positions, as steps of one to five bytes.
Documents lie ``GAP`` positions apart in a block, so nothing matches across two of
them.  Blocks are written by the tasks that read the documents: no word of the
corpus is shuffled to build the index.

Test items are cut into windows of ``width`` words (a shorter item is one window).
Which block a window can occur in is a join on terms: the blocks that hold its
rarest term, and of these the blocks that hold its second rarest.  Spark chooses
how to join, and a term in all blocks is a row a block, whatever its count.  In a
block, the windows routed to it start from the list of the term that is rarest
there, each position less the term's offset, and are intersected with the lists of
the other terms, rarest first, by binary search.  Terms are compared as words, not
as hashes, so matches are exact.

:func:`proximity` asks for all words of a window within a span of so many words,
in any order, from the same lists.

Edge cases: a null or empty text has no words; an item without words matches
nothing; equal items match alike; rows with equal doc_id are separate rows; a null
doc_id or item_id is carried (a null item_id stands in no list of items, but its
words are hit); empty tables give empty or clean results; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .store import written

GAP = 64
WIDTH = 10
INDEX_SCHEMA = "block long, doc_ids array<long>, n_words array<long>, terms array<string>, counts array<long>, steps binary"
_MATCH_SCHEMA = "doc_id long, n_words long, n_hit long, items array<long>, windows long"
_PLACE_SCHEMA = "doc_id long, window long, position long"
_BREAKS = np.frombuffer(bytes(32 if c < 0x30 or 0x3A <= c < 0x61 and not 0x41 <= c <= 0x5A or 0x7B <= c < 0x80 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)), np.uint8)


# ----------------------------------------------------------------------- words


def plain_words(column) -> tk.Words:
    """Words of letters, digits and characters beyond ASCII, A-Z lower-cased; a null text has none."""
    texts = tk.one_array(column)
    if not len(texts):
        return tk.split_words(texts)
    _, offsets, data = texts.buffers()
    spaced = _BREAKS[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
    return tk.split_words(pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(spaced), None, 0, texts.offset))


def windows_of(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(window, words, items): the distinct windows of all items, numbered by rank, and the ids of the items that hold each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = plain_words(batch.column(1))
            spelled = words.vocab.to_pylist()
            ids, lists = [], []
            for item, a, b in zip(batch.column(0).to_pylist(), words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
                mine = [spelled[i] for i in words.ids[a:b].tolist()]
                for i in range(max(1, len(mine) - width + 1) if mine else 0):
                    ids.append(item)
                    lists.append(mine[i : i + width])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.string()))], names=["item", "words"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(cut, "item long, words array<string>")
    distinct = rows.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return distinct.select(F.monotonically_increasing_id().alias("window"), "words", "items")


# ----------------------------------------------------------------------- index


def pack_steps(steps: np.ndarray) -> bytes:
    """Numbers from 0 as one to five bytes of seven bits, lowest first; the top bit says that more follow."""
    size = 1 + sum((steps >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    begin = ends - size
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        out[begin[has] + k] = (steps[has] >> 7 * k & 127 | (size[has] > k + 1) << 7).astype(np.uint8)
    return out.tobytes()


def unpack_steps(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    last = np.flatnonzero(raw < 128)
    begin = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(int((last - begin).max()) + 1 if len(last) else 0):
        has = last - begin >= k
        out[has] |= (raw[begin[has] + k] & 127).astype(np.int64) << 7 * k
    return out


def _block_of(words: tk.Words, doc_ids: pa.Array) -> list:
    """The columns of a block, without its number."""
    counts = words.counts
    base = np.concatenate(([0], np.cumsum(counts + GAP)))[:-1]
    position = np.arange(len(words.ids)) + np.repeat(base - words.bounds[:-1], counts)
    order = np.argsort(words.ids, kind="stable")
    used = np.bincount(words.ids, minlength=len(words.vocab)).astype(np.int64)
    listed = position[order]
    first = np.cumsum(used) - used
    steps = np.diff(listed, prepend=0)
    begins = first[used > 0]
    steps[begins] = listed[begins]
    return [doc_ids.to_pylist(), counts.tolist(), words.vocab.filter(pa.array(used > 0)), used[used > 0], pack_steps(steps)]


def build_index(docs: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """The stored index of all documents: one row per block, in the shared folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = tk.one_array(batch.column(1))
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            a = 0
            while a < len(ends):
                b = max(a + 1, int(np.searchsorted(ends, (int(ends[a - 1]) if a else 0) + block_bytes, side="right")))
                tk.give_back()
                doc_ids, n_words, terms, counts, steps = _block_of(plain_words(texts.slice(a, b - a)), batch.column(0).slice(a, b - a))
                lists = [pa.array([doc_ids], pa.list_(pa.int64())), pa.array([n_words], pa.list_(pa.int64()))]
                lists += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (terms.cast(pa.string()), pa.array(counts))]
                yield pa.record_batch([pa.array([number], pa.int64()), *lists, pa.array([steps], pa.binary())], names=[c.split()[0] for c in INDEX_SCHEMA.split(", ")])
                number += 1
                a = b

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, INDEX_SCHEMA), "phrase-index")


# --------------------------------------------------------------------- routing


def routes(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(block, window, words, items): the windows whose two rarest terms a block holds."""
    asked = windows.select(F.explode("words").alias("term")).distinct()
    every = index.select("block", F.explode(F.arrays_zip("terms", "counts")).alias("e")).select("block", F.col("e.terms").alias("term"), F.col("e.counts").alias("n"))
    found = written(every.join(asked, "term"), "asked-terms")
    often = found.groupBy("term").agg(F.sum("n").alias("often"))
    placed = windows.select("window", F.explode(F.array_distinct("words")).alias("term")).join(often, "term", "left")
    by = Window.partitionBy("window").orderBy("often", "term")
    ranked = placed.withColumn("rank", F.row_number().over(by)).where("rank <= 2")
    # A term that no document holds comes first and has no rows to join; a window of one word has one term.
    rarest = ranked.groupBy("window").agg(F.min_by("term", "rank").alias("one"), F.max_by("term", "rank").alias("two"))
    holds = found.select("block", "term")
    of_one = rarest.join(holds.withColumnRenamed("term", "one"), "one")
    of_both = of_one.join(holds.withColumnRenamed("term", "two"), ["block", "two"], "left_semi")
    return of_both.select("block", "window").join(windows, "window")


# ------------------------------------------------------------------ intersection


class _Block:
    """A block's lists, of the asked terms only, as one rising array of (term, position)."""

    def __init__(self, row: dict, asked: pa.Array):
        self.doc_ids, self.n_words = row["doc_ids"].as_py(), np.array(row["n_words"].as_py(), np.int64)
        self.base = np.concatenate(([0], np.cumsum(self.n_words + GAP)))
        terms, counts = row["terms"].values, row["counts"].values.to_numpy()
        code = pc.index_in(terms, value_set=asked.cast(terms.type)).fill_null(-1).to_numpy()  # block's number of a term -> asked number
        of = np.repeat(code, counts)
        listed = _running(unpack_steps(row["steps"].as_py()), counts)
        use = of >= 0
        self.keys = np.sort(of[use].astype(np.int64) << 40 | listed[use])
        self.count = np.bincount(of[use], minlength=len(asked))
        self.first = np.cumsum(self.count) - self.count

    def starts(self, term: np.ndarray, off: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every occurrence: offset-adjusted lists, intersected from the rarest term on.

        ``term`` and ``off`` are window by slot; slots of no term are -1 in ``term``.
        """
        count = np.where(term >= 0, self.count[term], np.iinfo(np.int64).max)
        rank = np.argsort(count, axis=1, kind="stable")
        rows = np.arange(len(term))
        rarest = rank[:, 0]
        n = np.where(active, count[rows, rarest], 0)
        window = np.repeat(rows, n)
        nth = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
        slot = rarest[window]
        start = (self.keys[self.first[term[window, slot]] + nth] & (1 << 40) - 1) - off[window, slot]
        window, start = window[start >= 0], start[start >= 0]
        for r in range(1, term.shape[1]):
            slot = rank[window, r]
            t = term[window, slot]
            want = np.maximum(t, 0) << 40 | start + off[window, slot]
            at = np.minimum(np.searchsorted(self.keys, want), max(0, len(self.keys) - 1))
            good = (t < 0) | (self.keys[at] == want) if len(self.keys) else np.zeros(0, bool)
            window, start = window[good], start[good]
        return window, start

    def within(self, term: np.ndarray, low: np.ndarray, span: int) -> np.ndarray:
        """Does each term have a position in [low, low + span)?"""
        want = np.maximum(term, 0) << 40 | np.maximum(low, 0)
        at = np.minimum(np.searchsorted(self.keys, want), max(0, len(self.keys) - 1))
        if not len(self.keys):
            return np.zeros(len(term), bool)
        return (self.keys[at] >= want) & (self.keys[at] < (np.maximum(term, 0) << 40) + low + span)


def _running(steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions from steps: a running sum that begins anew with each term's list."""
    total = np.cumsum(steps)
    first = np.cumsum(counts) - counts
    before = np.concatenate(([0], total))[first]
    return total - np.repeat(before, counts)


def _slots(words: list[list[str]], asked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Terms and offsets of windows as window by slot."""
    wide = max(map(len, words), default=1)
    number = {t: i for i, t in enumerate(asked.to_pylist())}
    term = np.full((len(words), wide), -1, np.int64)
    for i, w in enumerate(words):
        term[i, : len(w)] = [number[t] for t in w]
    return term, np.tile(np.arange(wide), (len(words), 1))


def _asked(routed: pa.Table) -> tuple[pa.Array, list[list[str]]]:
    words = routed.column("words").to_pylist()
    return pa.array(sorted({t for w in words for t in w}), pa.string()), words


def _search(index: DataFrame, windows: DataFrame, schema: str, find) -> DataFrame:
    """``find(block's row, routed windows)`` for each block."""
    routed = routes(index, windows)

    def each(blocks, asking):
        tk.give_back()
        made = [find({c: blocks.column(c)[i] for c in blocks.column_names}, asking) for i in range(blocks.num_rows)]
        kinds = {"items": pa.list_(pa.int64())}
        names = [c.split()[0] for c in schema.split(", ")]
        return pa.table({c: pa.array([v for m in made for v in m[c]], kinds.get(c, pa.int64())) for c in names})

    return index.groupBy("block").cogroup(routed.groupBy("block")).applyInArrow(each, schema)


def phrase_hits(index: DataFrame, windows: DataFrame) -> DataFrame:
    """Per document: its words, the words inside an occurrence of a window, the items found, and the windows found."""

    def find(row, asking):
        asked, words = _asked(asking)
        block = _Block(row, asked)
        term, off = _slots(words, asked)
        window, start = block.starts(term, off, np.ones(len(words), bool))
        long = np.array([len(w) for w in words], np.int64)
        edge = np.zeros(int(block.base[-1]) + int(long.max(initial=0)) + 1, np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + long[window], -1)
        hit = np.concatenate(([0], np.cumsum(np.cumsum(edge) > 0)))
        n_hit = hit[block.base[:-1] + block.n_words] - hit[block.base[:-1]]
        doc = np.searchsorted(block.base, start, side="right") - 1
        pairs = np.unique(doc * max(1, len(words)) + window)
        cuts = np.searchsorted(pairs // max(1, len(words)), np.arange(len(block.doc_ids) + 1))
        of_window = asking.column("items").to_pylist()
        found = [(pairs[a:b] % max(1, len(words))).tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        items = [sorted({i for w in some for i in of_window[w]}) for some in found]
        return {"doc_id": block.doc_ids, "n_words": block.n_words.tolist(), "n_hit": n_hit.tolist(), "items": items, "windows": list(map(len, found))}

    return _search(index, windows, _MATCH_SCHEMA, find)


def phrase_places(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, window, position): every exact occurrence; positions count words from 0."""

    def find(row, asking):
        asked, words = _asked(asking)
        block = _Block(row, asked)
        window, start = block.starts(*_slots(words, asked), np.ones(len(words), bool))
        doc = np.searchsorted(block.base, start, side="right") - 1
        names = asking.column("window").to_pylist()
        return {"doc_id": [block.doc_ids[d] for d in doc.tolist()], "window": [names[w] for w in window.tolist()], "position": (start - block.base[doc]).tolist()}

    return _search(index, windows, _PLACE_SCHEMA, find)


def proximity(index: DataFrame, windows: DataFrame, span: int = 20) -> DataFrame:
    """(doc_id, window, position): where a stretch of ``span`` words that holds all words of a window begins, in any order.

    A stretch begins with one of the window's words; a window's repeated words
    count once.  ``span`` is ``GAP`` at most, so that no stretch reaches into the next document.
    """
    if not 0 < span <= GAP:
        raise ValueError(f"span is 1 to {GAP}")

    def find(row, asking):
        asked, words = _asked(asking)
        block = _Block(row, asked)
        out: dict[str, list] = {"doc_id": [], "window": [], "position": []}
        number = {t: i for i, t in enumerate(asked.to_pylist())}
        for name, w in zip(asking.column("window").to_pylist(), words, strict=True):
            terms = np.array(sorted({number[t] for t in w}, key=lambda t: block.count[t]), np.int64)
            if not block.count[terms[0]]:
                continue
            a = block.first[terms[0]]
            near = block.keys[a : a + block.count[terms[0]]] & (1 << 40) - 1
            for t in terms[1:]:  # every other term less than a span away, rarest first
                near = near[block.within(np.full(len(near), t), near - span + 1, 2 * span - 1)]
            begins = [np.zeros(0, np.int64)]
            for t in terms:
                a = block.first[t]
                mine = block.keys[a : a + block.count[t]] & (1 << 40) - 1
                close = np.searchsorted(near, mine + span) > np.searchsorted(near, mine)
                begins.append(mine[close])
            start = np.unique(np.concatenate(begins))
            for t in terms:
                start = start[block.within(np.full(len(start), t), start, span)]
            doc = np.searchsorted(block.base, start, side="right") - 1
            out["doc_id"] += [block.doc_ids[d] for d in doc.tolist()]
            out["window"] += [name] * len(start)
            out["position"] += (start - block.base[doc]).tolist()
        return out

    return _search(index, windows, _PLACE_SCHEMA, find)


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_bytes: int = 4 << 20) -> DataFrame:
    """Per document: words, words hit, items with occurring windows, a digest of their ids as strings, and whether any word is hit."""
    windows = written(windows_of(items, width), "windows")
    hits = phrase_hits(build_index(docs, block_bytes), windows)
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    digest = F.sha2(F.array_join(ids, ","), 256)
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
