"""Substring deduplication with a log-structured fingerprint index.

The index is a table of immutable runs.  A run holds the distinct hashes of all
windows of ``width`` words of one batch of documents, sorted, and cut into
buckets by their leading bits; a row is one bucket of one run.  Runs carry a
rank: a lower rank is earlier.  Merging the runs of a bucket in rank order tells
for each run which of its hashes an earlier run already holds, as one bit per
hash.  Each hash (64 bits) comes with 16 bits of a second, independent hash;
a hit counts only if the check value agrees too, so two different windows are
taken for one with a chance of 2**-80 per pair.

A bulk load makes one run per range of doc_id, so that "an earlier run" means
"a smaller doc_id"; inside a run, the batch itself settles which document is
the smallest.  Later batches (:func:`append_batch`) are merged with the stored runs
only, and once these are many, :func:`compact` merges them into one run of a new
generation, with as many buckets as its size asks for.

Edge cases: a null text has no words; a text shorter than ``width`` words has
no window and keeps everything; rows with equal doc_id do not precede each
other; a null doc_id comes after every other; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .store import delete, forget, move, written

RUN_SCHEMA = "bucket int, rank long, n long, hashes binary, checks binary"
RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_CHECK_SEED = 77


def _pack(sorted_hashes: np.ndarray) -> bytes:
    """First hash, width in bytes, then the steps between neighbours in that width."""
    steps = np.diff(sorted_hashes)
    wide = int(steps.max()) if len(steps) else 0
    size = max(1, (wide.bit_length() + 7) // 8)
    body = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
    return int(sorted_hashes[0]).to_bytes(8, "little") + bytes([size]) + body


def _unpack(blob: bytes) -> np.ndarray:
    first, size = int.from_bytes(blob[:8], "little"), blob[8]
    body = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, size)
    steps = np.zeros((len(body), 8), np.uint8)
    steps[:, :size] = body
    out = np.empty(len(body) + 1, np.uint64)
    out[0] = first
    out[1:] = steps.view("<u8").ravel()
    return np.cumsum(out, dtype=np.uint64)


class _Batch:
    """Words and windows of one batch of documents, in order of doc_id."""

    def __init__(self, table: pa.Table, width: int):
        ids = table.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.rows = order
        self.ids = [ids[i] for i in order]
        texts = tk.one_array(table.column("text")).take(pa.array(order, pa.int64()))
        self.words = tk.split_words(texts)
        starts = tk.window_starts(self.words.bounds, width)
        self.at = np.flatnonzero(starts)
        vocab = self.words.vocab
        h = tk.window_hashes(tk.vocab_hashes(vocab)[self.words.ids], width)[self.at]
        self.order = np.argsort(h, kind="stable").astype(np.int64)
        ranked = h[self.order]
        self.first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(h) else np.zeros(0, np.int64)
        self.unique = ranked[self.first]
        c = tk.window_hashes(tk.vocab_hashes(vocab, _CHECK_SEED)[self.words.ids], width)[self.at]
        self.checks = (c[self.order[self.first]] >> np.uint64(48)).astype(np.uint16)

    def buckets(self, bits: int) -> Iterator[tuple[int, slice]]:
        if not len(self.unique):
            return
        top = (self.unique >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.unique), np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(top)) + 1, [len(top)]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(top[a]), slice(int(a), int(b))

    def repeated(self, seen: np.ndarray, width: int) -> np.ndarray:
        """Word positions covered by a window that also starts in an earlier document."""
        flag = np.zeros(len(self.words.ids), bool)
        if len(self.at):
            group = np.zeros(len(self.order), np.int64)
            group[self.first[1:]] = 1
            group = np.cumsum(group)
            codes = np.array([i if i is not None else np.iinfo(np.int64).max for i in self.ids], np.int64)
            doc = codes[self.words.owner()[self.at[self.order]]]
            hit = seen[group] | (doc > doc[self.first][group])
            flag[self.at[self.order[hit]]] = True
        return tk.covered(flag, width)


def _run_rows(batch: _Batch, rank: int, bits: int) -> pa.RecordBatch:
    rows = [(b, rank, s.stop - s.start, _pack(batch.unique[s]), batch.checks[s].tobytes()) for b, s in batch.buckets(bits)]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["bucket", "rank", "n", "hashes", "checks"])


def plan_ranges(docs: DataFrame, run_bytes: int) -> tuple[Column, int, int]:
    """How a bulk load is cut: the run of a row, the number of runs, and the bits of a bucket."""
    size, n = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    size = size or 0
    runs = max(1, min(-(-size // run_bytes), n or 1))
    bits = max(0, int(np.ceil(np.log2(max(1, size * 1.3 / (2 * run_bytes))))))
    if runs == 1:
        return F.lit(0).cast("long"), 1, bits
    parts = [i / runs for i in range(1, runs)]
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", parts, 100 * runs)).first()[0] or []))
    edges = F.array(*[F.lit(int(c)) for c in cuts])
    last = F.lit(len(cuts) + 1).cast("long")
    rank = F.size(F.filter(edges, lambda e: e < F.col("doc_id"))).cast("long")
    return F.when(F.col("doc_id").isNull(), last).otherwise(rank), len(cuts) + 2, bits


def runs_of(batches: DataFrame, width: int, bits: int) -> DataFrame:
    """The index rows of batches (columns rank, doc_id, text): one run per rank."""

    def build(key, table):
        tk.give_back()
        return pa.Table.from_batches([_run_rows(_Batch(table, width), key[0].as_py(), bits)])

    return batches.groupBy("rank").applyInArrow(build, RUN_SCHEMA)


def merge_join(runs: DataFrame) -> DataFrame:
    """For each run and bucket, a bit per hash: does a run of lower rank hold it?"""

    def merge(key, table):
        tk.give_back()
        table = table.sort_by("rank")
        ranks = table.column("rank").to_pylist()
        parts = [_unpack(b) for b in table.column("hashes").to_pylist()]
        h = np.concatenate(parts)
        c = np.concatenate([np.frombuffer(b, np.uint16) for b in table.column("checks").to_pylist()])
        order = np.argsort(h, kind="stable")
        hs, cs = h[order], c[order]
        same = hs[1:] == hs[:-1]
        if np.any(same & (cs[1:] != cs[:-1])):
            order = np.lexsort((np.arange(len(h)), c, h))
            hs, cs = h[order], c[order]
            same = (hs[1:] == hs[:-1]) & (cs[1:] == cs[:-1])
        seen = np.zeros(len(h), bool)
        seen[order[1:]] = same
        ends = np.cumsum([len(p) for p in parts])
        bits = [np.packbits(seen[e - len(p) : e]).tobytes() for p, e in zip(parts, ends, strict=True)]
        return pa.table({"rank": pa.array(ranks, pa.int64()), "bucket": pa.array([key[0].as_py()] * len(ranks), pa.int32()), "seen": pa.array(bits, pa.binary())})

    return runs.groupBy("bucket").applyInArrow(merge, "rank long, bucket int, seen binary")


def _drop_repeats(batches: DataFrame, seen: DataFrame, width: int, bits: int, with_text: bool) -> DataFrame:
    """Marks applied to the batches; columns besides rank, doc_id and text are carried along."""
    schema = RESULT_SCHEMA + (", kept_text string" if with_text else "")
    carried = [f for f in batches.schema.fields if f.name not in ("rank", "doc_id", "text")]  # c0, c1, ...
    names = [f.split()[0] for f in schema.split(", ")] + [f.name for f in carried]
    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in carried)

    def apply(docs, marks):
        if not docs.num_rows:
            kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string()}
            return pa.table({c: pa.array([], kinds[c] if c in kinds else docs.column(c).type) for c in names})
        tk.give_back()
        batch = _Batch(docs, width)
        known = dict(zip(marks.column("bucket").to_pylist(), marks.column("seen").to_pylist(), strict=True))
        old = np.zeros(len(batch.unique), bool)
        for b, s in batch.buckets(bits):
            if b in known:
                old[s] = np.unpackbits(np.frombuffer(known[b], np.uint8), count=s.stop - s.start).astype(bool)
        gone = batch.repeated(old, width)
        before = np.concatenate(([0], np.cumsum(gone)))[batch.words.bounds]
        text = tk.joined(batch.words, ~gone)
        offsets, data = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1].tolist(), memoryview(text.buffers()[2] or b"")
        cols = {
            "doc_id": pa.array(batch.ids, pa.int64()),
            "n_words": pa.array(batch.words.counts, pa.int64()),
            "n_removed": pa.array(np.diff(before), pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string()),
        }
        if with_text:
            original = tk.one_array(docs.column("text")).take(pa.array(batch.rows, pa.int64()))
            whole = pa.array(np.diff(before) == 0)
            cols["kept_text"] = pc.if_else(whole, original, text).cast(pa.string())
        for f in carried:
            cols[f.name] = docs.column(f.name).take(pa.array(batch.rows, pa.int64()))
        return pa.table(cols)

    return batches.groupBy("rank").cogroup(seen.groupBy("rank")).applyInArrow(apply, schema)


def deduplicate(docs: DataFrame, width: int = 13, run_bytes: int = 4 << 20, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Bulk load: each document without the words that a smaller document already has.

    A word goes if a window of ``width`` words that covers it also starts in a
    document with a smaller doc_id.  Returns doc_id, n_words, n_removed and
    kept_sha256 (and kept_text: the text itself where nothing goes): the kept
    words, joined by one space; and the columns named in ``carry``, under their names with ``carried_``.
    ``run_bytes`` bounds the text of one run, and so the memory of one task.
    """
    along = {f"c{i}": c for i, c in enumerate(carry)}
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(n) for n, c in along.items()])
    rank, _, bits = plan_ranges(docs, run_bytes)
    batches = docs.select(rank.alias("rank"), "doc_id", "text", *along)
    out = _drop_repeats(batches, merge_join(runs_of(batches, width, bits)), width, bits, with_text)
    return out.withColumnsRenamed({n: f"carried_{c}" for n, c in along.items()})


def stored_runs(spark: SparkSession, index_path: str) -> tuple[DataFrame, int, int | None]:
    """The runs of the newest generation of an index, its number, and the bits of its buckets (None: nothing stored)."""
    runs = RUN_SCHEMA.split(", ")
    try:
        rows = spark.read.schema(f"{RUN_SCHEMA}, generation int, bits int, batch string").parquet(index_path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], RUN_SCHEMA), 0, None
    newest = rows.agg(F.max(F.struct("generation", "bits"))).first()[0]
    if newest is None:
        return spark.createDataFrame([], RUN_SCHEMA), 0, None
    return rows.where(F.col("generation") == newest.generation).select(*[c.split()[0] for c in runs]), newest.generation, newest.bits


def _store(runs: DataFrame, index_path: str, generation: int, bits: int) -> None:
    """Write runs aside, then move them into the index at once, so that a job that dies leaves no half of a run."""
    name = uuid.uuid4().hex
    aside = f"{index_path}/_aside-{name}"
    runs.write.parquet(aside)
    move(runs.sparkSession, aside, f"{index_path}/generation={generation}/bits={bits}/batch={name}")


def append_batch(index_path: str, docs: DataFrame, width: int = 13, bits: int = 6, with_text: bool = False, most_runs: int = 32, bucket_hashes: int = 2_000_000) -> DataFrame:
    """Incremental use: merge a new batch with the stored runs, then store its own run.

    The batch counts as later than every stored run.  Inside the batch, smaller
    doc_ids come first.  Returns the result read back from the shared folder,
    since the stored runs change under it.  Once there are more than ``most_runs``
    stored runs, they are compacted into a new generation of the index, with more
    buckets if one would hold more than ``bucket_hashes`` hashes; ``bits`` are those
    of a new index.  One batch is appended at a time.
    """
    spark: SparkSession = docs.sparkSession
    history, generation, known = stored_runs(spark, index_path)
    bits = bits if known is None else known
    top = history.agg(F.max("rank")).first()[0]
    base = 0 if top is None else top + 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rank, _, _ = plan_ranges(docs, 4 << 20)
    batches = docs.select((rank + base).alias("rank"), "doc_id", "text")
    new = written(runs_of(batches, width, bits), "runs")
    marks = merge_join(history.unionByName(new)).where(F.col("rank") >= base)
    out = written(_drop_repeats(batches, marks, width, bits, with_text), "batch")
    _store(new, index_path, generation, bits)
    forget(new)
    runs, generation, bits = stored_runs(spark, index_path)
    if bits is not None and runs.select("rank").distinct().count() > most_runs:
        wide = int(np.ceil(np.log2(max(1, runs.agg(F.sum("n")).first()[0] / bucket_hashes))))
        _store(compact(runs, max(bits, wide)), index_path, generation + 1, max(bits, wide))
        delete(spark, f"{index_path}/generation={generation}")
    return out


def compact(runs: DataFrame, bits: int | None = None) -> DataFrame:
    """One run per bucket that holds all hashes of ``runs``, under the lowest rank; its buckets cut into those of ``bits``, if given."""
    types = {"bucket": pa.int32(), "rank": pa.int64(), "n": pa.int64(), "hashes": pa.binary(), "checks": pa.binary()}

    def merge(key, table):
        tk.give_back()
        h = np.concatenate([_unpack(b) for b in table.column("hashes").to_pylist()])
        c = np.concatenate([np.frombuffer(b, np.uint16) for b in table.column("checks").to_pylist()])
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        keep = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        h, c = h[keep], c[keep]
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.full(len(h), key[0].as_py())
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(h)])).tolist()
        lowest = min(table.column("rank").to_pylist())
        rows = [(int(bucket[a]), lowest, b - a, _pack(h[a:b]), c[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types.values(), strict=True)], schema=pa.schema(types))

    return runs.groupBy("bucket").applyInArrow(merge, RUN_SCHEMA)
